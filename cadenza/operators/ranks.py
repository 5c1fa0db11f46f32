"""Places within a key, without gathering a key in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.sources.shared import written


def numbered(rows: DataFrame, key: list[str], order: list[Column], out: str) -> DataFrame:
    """``rows`` with ``out``, the place from 0 in the key by ``order``.

    The rows are range-partitioned by key and order and written; a row's number in its range, and the sizes of the ranges
    before, give its place. A key that holds much of the table lies in many ranges, so no task holds all of it; without a
    key the whole table is numbered the same way. ``order`` must be total, or equal rows take any order among them.
    """
    by = [*(F.col(k) for k in key), *order]
    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))  # what precedes it in the id is the range
    runs = placed.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    starts = runs.select(*(F.col(k).alias(f"_k_{k}") for k in key), F.col("_range").alias("_k_range"), shift.alias("_shift"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key), F.col("_range") == F.col("_k_range"))
    return placed.join(starts, same).withColumn(out, (F.col("_at") + F.col("_shift")).cast("int")).select(*rows.columns, out)
