"""Shared helpers: the shared work folder, written intermediate tables, distributed ranks, joins on hot keys.

Texts go through Python in small batches. Where a table is written here, the setting is lowered meanwhile and then put back,
also after a failure. Where a result is given back that is still to be computed, ``text_batches`` replaces Spark's default
for the session; a bound that the caller has chosen stays.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
DEFAULT_BATCH = "10000"
#: Rows of a batch where a row holds a text.
TEXTS = 1000
#: Rows that one ranking group is sized for.
RANK_GROUP_ROWS = 100_000
#: A key is hot if it holds more than one in HOT_KEYS of the rows, and HOT_ROWS rows: there are fewer than HOT_KEYS of them.
HOT_KEYS, HOT_ROWS = 10_000, 1000


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only in local mode (tests, a laptop), and only where the setting is absent, a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cadenza-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class _Open(threading.local):
    """The open ``scratch`` blocks of a thread, innermost last: the paths that ``written`` has made in them."""

    def __init__(self):
        self.blocks: list[list[str]] = []


_open = _Open()


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/cadenza-{name}-{uuid.uuid4().hex}"
    if _open.blocks:
        _open.blocks[-1].append(path)
    return path


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """No more than ``rows`` rows in a batch that goes to Python, for what runs in the block."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def text_batches(spark: SparkSession) -> None:
    """Batches of TEXTS rows from now on, unless the caller has chosen a bound."""
    if spark.conf.get(BATCH_SETTING) == DEFAULT_BATCH:
        spark.conf.set(BATCH_SETTING, str(TEXTS))


def written(df: DataFrame, name: str, *, batches: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back. ``batches`` bounds the rows of the
    batches that go to Python meanwhile.

    Unlike a cached frame it outlives its executors, and Spark knows its true size.
    """
    path = fresh_dir(df.sparkSession, name)
    if batches is None:
        df.write.parquet(path)
    else:
        with small_batches(df.sparkSession, batches):
            df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        for path in {x.rpartition("/")[0] for x in table.inputFiles()}:
            if "/cadenza-" in path:
                _delete(table.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete what is made in the block when it ends, but for the paths that the block takes off the list."""
    made: list[str] = []
    _open.blocks.append(made)
    try:
        yield made
    finally:
        _open.blocks.remove(made)
        for path in made:
            _delete(spark, path)


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, *, keys: int = HOT_KEYS, least: int | None = None, merge: bool = False) -> DataFrame:
    """The inner join of ``rows`` with ``keyed``, a written table with one row a key; its column ``n`` says how many
    rows have the key. Hot keys, fewer than ``keys`` whatever the input and of more than ``least`` rows (HOT_ROWS), are broadcast, so that
    no task gets all rows of one; the others are joined as Spark likes, or with ``merge`` by a shuffle at every size."""
    total, most = keyed.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    least = max(HOT_ROWS if least is None else least, -(-total // keys))
    known = keyed.hint("merge") if merge else keyed
    if most <= least:
        return rows.join(known.drop(n), on)
    hot, cold = keyed.where(F.col(n) > least).drop(n), known.where(F.col(n) <= least).drop(n)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def running(df: DataFrame, key: Column, order: list[Column], *, out: str, group: Column, value: Column | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` (or the count) over the rows of ``key`` that come before, in two levels.

    ``group`` deals the rows of a key into groups of a bounded size and must be a function of the row's values. The
    order runs group by group, and by ``order`` inside a group, so no task has to hold all rows of a key.
    """
    df = df.withColumn("_k", key).withColumn("_g", group).withColumn("_v", (F.lit(1) if value is None else value).cast("long"))
    within = Window.partitionBy("_k", "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_k").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy("_k", "_g").agg(F.sum("_v").alias("_n"))
    starts = sizes.select(F.col("_k").alias("_sk"), F.col("_g").alias("_sg"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        df.withColumn("_r", F.coalesce(F.sum("_v").over(within), F.lit(0)))
        .join(starts, F.col("_k").eqNullSafe(F.col("_sk")) & (F.col("_g") == F.col("_sg")))
        .withColumn(out, F.col("_start") + F.col("_r"))
        .drop("_k", "_g", "_v", "_r", "_sk", "_sg", "_start")
    )


def dealt(spread: Column, rows: int) -> Column:
    """A group number for ``running``: hash groups of about RANK_GROUP_ROWS of the ``rows`` rows."""
    return F.pmod(spread, F.lit(max(1, -(-rows // RANK_GROUP_ROWS))))


def drawn(texts: DataFrame, rows: int, key: str, text: str) -> DataFrame:
    """The first ``rows`` rows of a hash order: a bounded sample, however often an id repeats."""
    order = F.xxhash64(key, F.crc32(F.col(text).cast("binary")), F.lit(9))
    return texts.orderBy(order, key).limit(rows).repartition(max(1, -(-rows // 250)))
