"""Synchronisation as a stream: rows that arrive from the other copy are applied to a stored table, each batch once.

A batch is applied in one commit of the store, which carries the batch's number. If the stream stops between the commit and
its own checkpoint, the restarted stream brings the same batch again, and the commit's number says that it has been applied.
Only the buckets of the arriving ids are read and written.

Nulls: a row without an id is dropped; one without a time never replaces another. Of several rows of an id in a batch the
latest counts, of equally late ones any. A batch without rows changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadenza.operators import library
from cadenza.sources import store

Apply = Callable[[DataFrame, int], None]


def newest(changes: DataFrame) -> DataFrame:
    """One row for each id: the latest."""
    row = F.struct(*changes.columns)
    return changes.where("id is not null").groupBy("id").agg(F.coalesce(F.max_by(row, "updated_at"), F.any_value(row)).alias("row")).select("row.*")


def applying(root: str, name: str, schema: str, *, source: str) -> Apply:
    """What a stream does with a batch: rows that are newer than the table's replace them, and new ones are added."""

    def run(batch: DataFrame, number: int) -> None:
        latest = newest(batch)
        store.change(batch.sparkSession, root, name, schema, latest.select("id"), lambda rows: library.synchronised(rows, latest.select(*rows.columns))[0], batch=(source, number))

    return run


def synchronising(changes: DataFrame, root: str, name: str, schema: str, *, source: str, apply: Apply | None = None) -> StreamingQuery:
    """Start applying a stream of changed rows to a stored table, over all that is there now."""
    run = apply or applying(root, name, schema, source=source)
    return changes.writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/streams/{source}").trigger(availableNow=True).start()
