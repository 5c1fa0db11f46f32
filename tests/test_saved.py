"""The score source, saved tables and order keys, against literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza import dims
from cadenza.operators import library
from cadenza.operators import structure_rows as tabular
from cadenza.sources import gp, saved, score_files

GPIF = "<GPIF><GPVersion>7</GPVersion><Score><Title> T </Title></Score></GPIF>"


@pytest.fixture
def scores(spark):
    score_files.register(spark)
    return spark.read.format("scores")


FILES = [
    ("good", gp.zipped({gp.ENTRY: GPIF}), None),
    ("sub/good", gp.zipped({gp.ENTRY: GPIF}), None),
    ("empty", b"", "not-a-zip"),
    ("null", None, "not-a-zip"),
    ("text", b"hello", "not-a-zip"),
    ("short", b"PK", "not-a-zip"),
    ("broken", b"PK\x03\x04broken", "corrupt"),
    ("other", gp.zipped({"readme.txt": "no score"}), "not-a-gp-file"),
    ("gpx", b"BCFZ1234", "gpx-container"),
    ("gp5", b"\x18FICHIER GUITAR PRO v5.00", "legacy-binary"),
    ("no xml", gp.zipped({gp.ENTRY: "GPIF"}), "corrupt"),
    ("no entry text", gp.zipped({gp.ENTRY: ""}), "corrupt"),
]


def test_files_written_and_read_by_the_source(spark, scores, tmp_path):
    frame = spark.createDataFrame([(n, bytearray(c) if c is not None else None, "extra") for n, c, _ in FILES], "path string, content binary, xml string")
    for _ in range(2):  # written again, each file is there once
        frame.write.format("scores").mode("append").save(f"file://{tmp_path}")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    read = gp.scored(scores.load(f"file://{tmp_path}"))
    got = {r["path"].removeprefix(f"file://{tmp_path}/"): (r["error"], r["message"]) for r in read.collect()}
    assert got == {n: (e, dims.GP_ERRORS.get(e)) for n, _, e in FILES}
    assert {r["title"] for r in gp.metadata(read).collect()} == {"T"}


def test_source_sniffs_as_the_columns_do(spark, scores, tmp_path):
    frame = spark.createDataFrame([(n, bytearray(c or b"")) for n, c, _ in FILES], "path string, content binary")
    assert {r["path"]: r["error"] for r in gp.parsed(frame).collect()} == {n: e for n, _, e in FILES}


def test_source_deals_files_to_tasks(scores, tmp_path):
    for k in range(20):
        (tmp_path / f"{k}.gp").write_bytes(b"x" * 1000)
    read = scores.option("run_bytes", 5 * (score_files.FILE_COST + 1000)).load(str(tmp_path))
    sizes = [r["n"] for r in read.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sizes == [5] * 4


def test_source_of_an_empty_folder_has_no_rows(scores, tmp_path):
    assert scores.load(str(tmp_path)).count() == 0


def test_source_of_no_folder_raises(scores, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        scores.load(str(tmp_path / "nowhere")).count()


def test_source_needs_names(spark, scores, tmp_path):
    with pytest.raises(Exception, match="needs a name"):
        spark.createDataFrame([(None, bytearray(b""))], "path string, content binary").write.format("scores").mode("append").save(str(tmp_path))


ROWS = "id string, device_id string, title string, at int"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_device_reads_one_part_and_upsert_moves_nothing(spark, no_broadcast, tmp_path):
    old = [(f"s{k}", None if k % 10 == 9 else "hot" if k % 3 == 0 else f"d{k % 7}", "old", 0) for k in range(300)]
    new = [(f"s{k}", "d1", "new", k % 2) for k in range(250, 320)] + [("s250", "d1", "last", 9)]
    table = saved.save(spark.createDataFrame(old, ROWS), "saved_old", str(tmp_path / "old"))
    batch = saved.save(spark.createDataFrame(new, ROWS), "saved_new", str(tmp_path / "new"))
    try:
        one = saved.of_device(table, "hot")
        assert f"PartitionFilters: [isnotnull({saved.PART}" in plan(one)
        assert sorted(r["id"] for r in one.collect()) == sorted(r[0] for r in old if r[1] == "hot")
        assert saved.of_device(table, None).count() == 300 and saved.of_device(table, "none").count() == 0
        after = library.upsert(table.drop("at"), batch, order="at")
        assert "Exchange" not in plan(after)
        want = {r[0]: r[1:3] for r in old} | {r[0]: r[1:3] for r in new}
        assert {r["id"]: (r["device_id"], r["title"]) for r in after.collect()} == want
    finally:
        spark.sql("DROP TABLE saved_old")
        spark.sql("DROP TABLE saved_new")


def test_generations_default_only_where_the_column_is_absent(spark, tmp_path):
    path = str(tmp_path / "t")
    saved.add_generation(spark.createDataFrame([("a",), (None,)], "id string"), path, 1)
    saved.add_generation(spark.createDataFrame([("b", None, "x"), ("c", 90, "x")], "id string, bpm int, unknown string"), path, 2)
    kind = "id string, bpm int, mode string"
    got = saved.generations(spark, path, kind, {"bpm": (2, F.lit(120)), "mode": (3, F.lit("major"))})
    assert got.columns == ["id", "bpm", "mode"]
    assert sorted(got.collect(), key=str) == sorted([("a", 120, "major"), (None, 120, "major"), ("b", None, "major"), ("c", 90, "major")], key=str)


def moved(ids, section, over):
    """By list operations."""
    if section not in ids or over not in ids:
        return ids
    at = ids.index(over)
    left = [x for x in ids if x != section]
    return [*left[:at], section, *left[at:]]


def test_moves_write_one_row_and_equal_lists(spark):
    rng = random.Random(5)
    docs = {d: [f"{d}-{k}" for k in range(1 + d % 6)] for d in range(40)}
    sections = spark.createDataFrame([(d, s, float(k)) for d, ids in docs.items() for k, s in enumerate(ids)], "doc int, section_id string, at double")
    for _ in range(4):
        wanted = [(d, rng.choice([*ids, "none"]), rng.choice([*ids, "none"])) for d, ids in docs.items()]
        changes = tabular.moves(sections, spark.createDataFrame(wanted, "doc int, section_id string, over string")).collect()
        after = {d: moved(docs[d], s, o) for d, s, o in wanted}
        assert len(changes) == sum(after[d] != docs[d] for d in docs)  # one row where anything changes
        docs = after
        rows = tabular.rekeyed(sections, spark.createDataFrame(changes, sections.schema)).collect() if changes else sections.collect()
        sections = spark.createDataFrame(rows, sections.schema)
        assert {d: [r["section_id"] for r in sorted(rows, key=lambda r: r["at"]) if r["doc"] == d] for d in docs} == docs


def test_a_thousand_moves_into_one_gap(spark):
    """A thousand documents, each with a gap as it is after that many halvings: from a wide one down to none."""
    rows = []
    for d in range(1000):
        low, high = 1.0, 1.0 + 2.0 ** -min(d, 52)
        rows += [(d, "a", low), (d, "b", high), (d, "c", high + 1), (d, "d", high + 2)]
    sections = spark.createDataFrame(rows, "doc int, section_id string, at double")
    wanted = sections.select("doc").distinct().select("doc", F.lit("d").alias("section_id"), F.lit("b").alias("over"))
    changes = tabular.moves(sections, wanted)
    counts = {r["doc"]: r["count"] for r in changes.groupBy("doc").count().collect()}
    assert [counts[d] for d in range(52)] == [1] * 52 and {counts[d] for d in range(52, 1000)} == {4}
    after = tabular.rekeyed(sections, changes)
    order = after.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "section_id"))), lambda x: x["section_id"]), "").alias("o"))
    assert [tuple(r) for r in order.select("o").distinct().collect()] == [("adbc",)]


def test_moves_of_no_rows(spark):
    sections = spark.createDataFrame([], "doc int, section_id string, at double")
    assert tabular.moves(sections, spark.createDataFrame([], "doc int, section_id string, over string")).count() == 0
