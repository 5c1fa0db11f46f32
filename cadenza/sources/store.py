"""The library's tables in a folder: hash buckets of ids, one pointer file a commit, and a session of edits.

A table lies in buckets by the hash of its ids. A change reads and writes only the buckets of the ids that it touches, each
into a fresh folder; the files of the others stay as they are. Then one small file, the manifest, makes all of it visible
together: it names the folder of every bucket of every table, so readers follow the newest one and see all of a commit or
nothing of it, and a table that is being read is never overwritten.

A manifest's number can be taken once: of two commits at the same time the second gets a ``Conflict``. A change of rows is
then made again on what the first left; a commit of whole tables is the caller's to repeat. A commit may carry the number of a
stream's batch, which tells a restarted stream what it has already applied.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import library
from cadenza.sources import tables as wire

#: Buckets of a table; more for larger tables, as a change rewrites whole buckets.
BUCKETS = 32


class Conflict(RuntimeError):
    """Another commit took the number."""


@dataclass
class Manifest:
    """What a commit shows: (table, bucket) to its folder, or None where the bucket is empty; the last batch of each stream."""

    n: int = -1
    folders: dict[tuple[str, int], str | None] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def buckets(self, name: str) -> int:
        return sum(table == name for table, _ in self.folders)


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, root: str) -> Manifest:
    """The newest one; a folder without any commit has an empty one."""
    folder, files = _place(spark, f"{root}/commits")
    numbers = [int(name[:-5]) for f in (files.listStatus(folder) if files.exists(folder) else []) if (name := f.getPath().getName()).endswith(".json") and name[0] not in "_."]
    if not numbers:
        return Manifest()
    said = json.loads(spark.read.text(f"{root}/commits/{max(numbers):012d}.json", wholetext=True).first()[0])  # a line for each table and bucket
    return Manifest(max(numbers), {(name, k): path for name, k, path in said["folders"]}, said["batches"])


def publish(spark: SparkSession, root: str, after: Manifest) -> None:
    """Write a manifest under its number, which must be free."""
    text = json.dumps({"folders": [[name, k, path] for (name, k), path in after.folders.items()], "batches": after.batches})
    staged, files = _place(spark, f"{root}/staged/{uuid.uuid4().hex}.json")
    out = files.create(staged)
    out.write(text.encode())
    out.close()
    target, _ = _place(spark, f"{root}/commits/{after.n:012d}.json")
    files.mkdirs(target.getParent())
    gateway = spark.sparkContext._gateway
    fs = gateway.jvm.org.apache.hadoop.fs
    plain = gateway.new_array(getattr(fs, "Options$Rename"), 0)  # doesn't overwrite
    try:
        fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(files.makeQualified(staged), files.makeQualified(target), plain)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            raise Conflict(f"commit {after.n} of {root} is taken") from e
        raise


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def staged(root: str, name: str, df: DataFrame, buckets: int) -> dict[int, str | None]:
    """The rows in a fresh folder, and the folder of each bucket."""
    folder = f"{root}/tables/{name}-{uuid.uuid4().hex}"
    df.withColumn("bucket", bucket(F.col("id"), buckets)).hint("rebalance", "bucket").write.mode("errorifexists").partitionBy("bucket").parquet(folder)
    places = {k: f"{folder}/bucket={k}" for k in range(buckets)}
    found = {k: _place(df.sparkSession, path) for k, path in places.items()}
    return {k: places[k] if files.exists(path) else None for k, (path, files) in found.items()}


def commit(spark: SparkSession, root: str, changed: dict[str, DataFrame], *, buckets: int = BUCKETS) -> None:
    """The tables as they are now, whole. One manifest makes them visible together. A second commit of the same number raises
    a ``Conflict``."""
    before = manifest(spark, root)
    folders = {at: path for at, path in before.folders.items() if at[0] not in changed}
    for name, df in changed.items():
        folders |= {(name, k): path for k, path in staged(root, name, df, buckets).items()}
    publish(spark, root, Manifest(before.n + 1, folders, before.batches))


def current(spark: SparkSession, root: str, name: str, schema: str, *, only: set[int] | None = None, seen: Manifest | None = None) -> DataFrame:
    """The table as last committed, or some buckets of it; one that never was is empty."""
    seen = seen or manifest(spark, root)
    paths = [path for (table, k), path in seen.folders.items() if table == name and path and (only is None or k in only)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def change(spark: SparkSession, root: str, name: str, schema: str, keys: DataFrame, make: Callable[[DataFrame], DataFrame], *, batch: tuple[str, int] | None = None) -> None:
    """Rows of some ids become what ``make`` makes of them: it gets the table's rows in these ids' buckets and gives them back
    changed, without touching other ids. ``batch`` names a stream and its batch; one that was applied isn't again."""
    while True:
        before = manifest(spark, root)
        if batch and before.batches.get(batch[0], -1) >= batch[1]:
            return
        buckets = before.buckets(name) or BUCKETS
        touched = {r[0] for r in keys.select(bucket(F.col("id"), buckets)).distinct().collect()}  # as many as there are buckets
        made = make(current(spark, root, name, schema, only=touched, seen=before))
        places = staged(root, name, made, buckets) if touched else {}
        folders = {(name, k): None for k in range(buckets)} | before.folders | {(name, k): places[k] for k in touched}
        try:
            publish(spark, root, Manifest(before.n + 1, folders, before.batches | ({batch[0]: batch[1]} if batch else {})))
            return
        except Conflict:  # on what the other commit left
            continue


@dataclass
class Library:
    """A table of records with ids in a folder: every change is committed, its push is put in the outbox, and listings
    read anew."""

    spark: SparkSession
    root: str
    name: str
    schema: str
    device: str

    def table(self) -> DataFrame:
        return current(self.spark, self.root, self.name, self.schema)

    def list(self) -> DataFrame:
        return library.list_recent(self.table())

    def save(self, records: DataFrame, *, order: str) -> DataFrame:
        """Records replace those with their ids; the listing after."""
        change(self.spark, self.root, self.name, self.schema, records.select("id"), lambda rows: library.upsert(rows, records, order=order))
        wire.push_rows(records.drop(order), self.device).write.mode("append").text(f"{self.root}/outbox/posts")
        return self.list()

    def remove(self, keys: DataFrame, *, guard: Column | None = None) -> DataFrame:
        change(self.spark, self.root, self.name, self.schema, keys, lambda rows: library.delete(rows, keys, ["id"], guard=guard))
        wire.push_deletes(keys, self.device).write.mode("append").text(f"{self.root}/outbox/deletes")
        return self.list()
