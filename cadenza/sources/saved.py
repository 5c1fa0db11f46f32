"""Saved tables of the library in Spark's catalogue: laid out by device and id, and files of several schema generations.

Layout. A table is partitioned by a hash of its device into a fixed number of parts, as devices have no bound, and bucketed
by id inside them. Reading a device reads one part; joining two tables by id (upsert, delete, synchronise) moves no row. A
device that holds a third of the rows is spread over all buckets.

Generations. Files of one generation share their columns and lie in a folder of their own. Of a column that was added later,
older files take its default; a null that a newer file holds stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.library import conformed

PART = "device_part"


def device_part(device: Column, parts: int) -> Column:
    """A device's part; rows without a device have one too."""
    return F.pmod(F.xxhash64(device), F.lit(parts)).cast("int")


def save(table: DataFrame, name: str, path: str, *, parts: int = 16, buckets: int = 8) -> DataFrame:
    """``table`` (id, device_id and others) as the catalogue's table ``name``, with its files under ``path``; what is read back.
    A name that is taken raises."""
    laid = table.withColumn(PART, device_part(F.col("device_id"), parts)).repartition(buckets, "id")  # one file a part and bucket
    laid.write.partitionBy(PART).bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(name)
    return table.sparkSession.table(name)


def of_device(table: DataFrame, device: str | None, *, parts: int = 16) -> DataFrame:
    """A device's rows, from its part only; without a device, all rows."""
    found = table if device is None else table.where(F.col(PART) == device_part(F.lit(device), parts)).where(F.col("device_id") == device)
    return found.drop(PART)


def add_generation(rows: DataFrame, path: str, generation: int) -> None:
    rows.write.mode("append").parquet(f"{path}/generation={generation}")


def generations(spark: SparkSession, path: str, kind: str, added: dict[str, tuple[int, Column]]) -> DataFrame:
    """All files under ``path`` as one table of the columns ``kind``. ``added`` names each later column's generation and the
    default that rows of older ones take."""
    found = spark.read.option("mergeSchema", "true").parquet(path)
    table = conformed(found, kind + ", generation int")
    filled = {name: F.when(F.col("generation") < first, value).otherwise(F.col(name)) for name, (first, value) in added.items()}
    return table.withColumns(filled).drop("generation")
