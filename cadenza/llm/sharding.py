"""Sharding by jump consistent hashing.

A key goes to one of ``n`` shards by a pure function of the key and ``n``: no ring, no table, no state. When a shard is
appended, only 1/(n+1) of the keys move, and all of those go into the new shard.

Nulls: a null key is one fixed key like any other; a null text has size 1 and no checksum (null). Repeated rows each
get a slot of their own. Columns that aren't named are ignored, so their names can't clash. An empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm._work import dealt, running, written

STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key. The loop runs a number of times that is logarithmic in ``shards``."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard, at = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = at[live]
        state[live] = state[live] * STEP + np.uint64(1)
        draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        at[live] = np.floor((shard[live] + 1) * (2.0**31 / draw)).astype(np.int64)
        live = live[at[live] < shards]
    return shard


@F.pandas_udf(T.IntegerType())
def jump_shard(key: pd.Series, shards: pd.Series) -> pd.Series:
    out = np.zeros(len(key), np.int32)
    for n in shards.unique():
        these = (shards == n).to_numpy()
        out[these] = jump(key.to_numpy()[these], int(n))
    return pd.Series(out)


def assign(docs: DataFrame, *, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, size, text_crc32, shard, slot and grown_shard (the shard if one more is appended) of each row.

    Slots are gapless from 0 in each shard. They are ranked in hash groups of the rows of a shard, so that no task has
    to hold a shard; only ids and sizes are shuffled, never texts.
    """
    keyed = docs.select(
        F.col(key).alias("key"),
        F.xxhash64(F.col(key)).alias("hashed"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
    )
    placed = written(
        keyed.withColumn("shard", jump_shard("hashed", F.lit(shards))).withColumn("grown_shard", jump_shard("hashed", F.lit(shards + 1))),
        "sharding",
    )
    slots = running(
        placed,
        F.col("shard"),
        [F.col("key"), F.col("text_crc32"), F.col("size")],
        out="slot",
        group=dealt(F.xxhash64("key", "text_crc32"), placed.count() // shards),
    )
    return slots.select(F.col("key").alias(key), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
