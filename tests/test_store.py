"""The library's store: changes touch only their buckets, numbers are taken once, and a stream's batches apply once."""

import glob

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cadenza.operators import library
from cadenza.sources import store
from cadenza.streaming import sync

KIND = "id string, title string, updated_at string"


def songs(spark, n: int, title: str = "first", day: int = 1):
    return spark.range(n).select(F.concat(F.lit("s"), "id").alias("id"), F.lit(title).alias("title"), F.lit(f"2024-01-{day:02d} 00:00:00").alias("updated_at"))


def content(spark, root) -> dict:
    return {r.id: (r.title, r.updated_at) for r in store.current(spark, root, "songs", KIND).collect()}


def files(root: str, spark) -> dict[int, set[str]]:
    seen = store.manifest(spark, root)
    return {k: set(glob.glob(f"{path.removeprefix('file://')}/*.parquet")) for (_, k), path in seen.folders.items() if path}


@pytest.fixture()
def root(spark, tmp_path):
    store.commit(spark, str(tmp_path), {"songs": songs(spark, 1000)}, buckets=8)
    return str(tmp_path)


def test_a_save_leaves_other_buckets_files(spark, root):
    before = files(root, spark)
    assert set(before) == set(range(8)) and all(before.values())
    mine = songs(spark, 1000, "second", 2).where(store.bucket(F.col("id"), 8) == 3).limit(10)
    ids = {r.id for r in mine.collect()}
    shelf = store.Library(spark, root, "songs", KIND, "dev")
    shelf.save(mine.withColumn("at", F.lit(1)), order="at")
    after = files(root, spark)
    assert all(after[k] == before[k] for k in range(8) if k != 3) and not after[3] & before[3]
    assert content(spark, root) == {f"s{i}": (("second", "2024-01-02 00:00:00") if f"s{i}" in ids else ("first", "2024-01-01 00:00:00")) for i in range(1000)}


def test_a_bucket_can_be_emptied_and_filled(spark, root):
    shelf = store.Library(spark, root, "songs", KIND, "dev")
    mine = songs(spark, 1000).where(store.bucket(F.col("id"), 8) == 5)
    kept = 1000 - mine.count()
    assert shelf.remove(mine.select("id")).count() == kept
    assert store.manifest(spark, root).folders["songs", 5] is None
    assert shelf.save(mine.limit(1).withColumn("at", F.lit(1)), order="at").count() == kept + 1
    assert shelf.save(mine.limit(0).withColumn("at", F.lit(1)), order="at").count() == kept + 1


def test_numbers_are_taken_once(spark, root, monkeypatch):
    seen = store.manifest(spark, root)
    store.commit(spark, root, {"songs": songs(spark, 5)}, buckets=8)
    with pytest.raises(store.Conflict):
        store.publish(spark, root, store.Manifest(seen.n + 1, seen.folders))
    assert len(content(spark, root)) == 5
    # a change that meets another commit is made again on what that left
    published, calls = store.publish, []

    def late(spark, root, after):
        calls.append(after.n)
        if len(calls) == 1:
            published(spark, root, store.Manifest(after.n, {**store.manifest(spark, root).folders, ("others", 0): None}))
        published(spark, root, after)

    monkeypatch.setattr(store, "publish", late)
    store.change(spark, root, "songs", KIND, songs(spark, 2).select("id"), lambda rows: rows.withColumn("title", F.lit("third")) if rows.columns else rows)
    assert calls == [seen.n + 2, seen.n + 3] and ("others", 0) in store.manifest(spark, root).folders


def test_a_table_that_never_was(spark, tmp_path):
    assert store.current(spark, str(tmp_path), "songs", KIND).count() == 0
    shelf = store.Library(spark, str(tmp_path), "songs", KIND, "dev")
    assert shelf.save(songs(spark, 3).withColumn("at", F.lit(1)), order="at").count() == 3


def arriving(spark, root: str):
    """Three batches: an update, a row that is older than the table's, and a new one, of which the last comes twice."""
    for n, (ids, title, day) in enumerate([(40, "cloud", 3), (60, "old", 1), (1010, "late", 4)]):
        rows = songs(spark, ids, title, day)
        (rows if n < 2 else rows.where("id >= 's99'").unionByName(songs(spark, 1010, "later", 5).where("id = 's1001'"))).coalesce(1).write.mode("append").parquet(f"{root}/arriving")
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{root}/arriving")


def test_a_stream_that_stops_after_its_commit_applies_each_batch_once(spark, root):
    changes, apply = arriving(spark, root), sync.applying(root, "songs", KIND, source="cloud")
    began = store.manifest(spark, root).n

    def breaks(batch, number):
        apply(batch, number)
        if number == 1:
            raise RuntimeError("stopped before its checkpoint")

    with pytest.raises(StreamingQueryException):
        sync.synchronising(changes, root, "songs", KIND, source="cloud", apply=breaks).awaitTermination()
    assert store.manifest(spark, root).batches == {"cloud": 1}
    sync.synchronising(changes, root, "songs", KIND, source="cloud").awaitTermination()
    seen = store.manifest(spark, root)
    assert seen.n == began + 3 and seen.batches == {"cloud": 2}
    once = library.synchronised(songs(spark, 1000), sync.newest(spark.read.schema(KIND).parquet(f"{root}/arriving")))[0]
    assert content(spark, root) == {r.id: (r.title, r.updated_at) for r in once.collect()}
    assert content(spark, root)["s1001"] == ("later", "2024-01-05 00:00:00") and content(spark, root)["s50"][0] == "first" and content(spark, root)["s7"][0] == "cloud"
