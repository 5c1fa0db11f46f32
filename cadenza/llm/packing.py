"""Packing tokenised documents into sequences by minimum bin slack.

How many pieces there are of each length (at most ``capacity`` numbers) is all that the plan needs: for each bin, the
longest piece left is the seed, and a subset-sum over bitsets of the lengths left, longest first, finds the fullest
feasible combination. The combination is removed as often as the counts allow, so the plan has some thousand patterns
whatever the corpus' size. Spark then places every piece: a piece's rank among those of its length says in which
repetition of which pattern it goes.

Ranks need no shuffle of the pieces: the written table of pieces has, for each piece, the partition that made it and its
number among that partition's pieces of the same length; the partitions' counts give the rest.

Nulls: a null text is empty; every document ends with the closing id, so an empty one has one piece of length 1. A null
doc_id is kept. Repeated rows are documents of their own. Columns that aren't named are ignored. Only documents longer
than a sequence are cut. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm._work import TEXTS, written

CAPACITY = 1024
CLOSING = 2
#: Below this code point both tokenizers' patterns know the same letters and digits.
COMMON = 0x250
PIECE = "piece int, start long, length long, ids array<int>, ids_crc32 long, part int, nth long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def exact(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def quick(path: str):
    """The same vocabulary and merges through a faster library, or None if the file isn't plain byte-level BPE."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    if model.get("normalizer") or (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {x["content"] for x in model["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("from_file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), special


def encode(text: str, path: str) -> np.ndarray:
    """The ids that ``tokenizers`` gives. Texts in common scripts take the faster way to the same ids."""
    fast = quick(path)
    if fast is not None and (text.isascii() or max(text) < chr(COMMON)) and not any(s in text for s in fast[1]):
        return np.array(fast[0].encode_ordinary(text), np.int32)
    return np.array(exact(path).encode(text, add_special_tokens=False).ids, np.int32)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be shorter than a sequence."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, closing: int = CLOSING, key: str = "doc_id") -> DataFrame:
    """A written table: key, piece, start, length, ids, their crc32 as little-endian unsigned 32-bit numbers, and part and nth, the
    piece's number in its partition and length."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, ids, sums = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                got = np.append(encode(text or "", path), np.int32(closing))
                for number, (start, length) in enumerate(cuts(len(got), capacity)):
                    rows.append((row, number, start, length, seen[length]))
                    seen[length] += 1
                    sums.append(zlib.crc32(got[start : start + length].astype("<u4").data))
                ids.append(got)
            if not rows:
                continue
            row, number, start, length, nth = np.array(rows, np.int64).T
            bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(row)),
                    pa.array(number.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids))),
                    pa.array(sums, pa.int64()),
                    pa.array(np.full(len(row), part, np.int32)),
                    pa.array(nth),
                ],
                ["key", "piece", "start", "length", "ids", "ids_crc32", "part", "nth"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return written(docs.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind}, {PIECE}"), "pieces", batches=TEXTS)


Pattern = tuple[list[tuple[int, int]], int]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns ([(length, how many)], times), in all using each length as often as it is counted."""
    left = {k: n for k, n in counts.items() if n}
    out: list[Pattern] = []
    while left:
        seed = max(left)
        uses = {seed: 1}
        room = capacity - seed
        for length, n in fullest({k: n - (k == seed) for k, n in left.items() if k <= room}, room):
            uses[length] = uses.get(length, 0) + n
        times = min(left[k] // n for k, n in uses.items())
        out.append((sorted(uses.items(), reverse=True), times))
        for k, n in uses.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The lengths that together fill ``room`` best, by a subset-sum over bitsets; long lengths are preferred."""
    if room <= 0 or not counts:
        return []
    reach, levels, whole = 1, [], (1 << room + 1) - 1
    for length in sorted(counts, reverse=True):
        levels.append((length, reach))
        step, many = 1, min(counts[length], room // length)
        while many > 0:  # 1, 2, 4, ... and the rest: every number up to many
            take = min(step, many)
            reach |= reach << length * take & whole
            many -= take
            step *= 2
        if reach >> room & 1:
            break
    target, out = reach.bit_length() - 1, []
    for length, before in reversed(levels):
        k = 0
        while not before >> target & 1:
            target -= length
            k += 1
        if k:
            out.append((length, k))
    return out


def place(pieces: DataFrame, table: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: rows that come from the written ``table`` of all pieces, with any columns
    besides length, part and nth."""
    sizes = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(sizes, "sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    lengths, firsts, repeats, sequences, offsets = [], [], [], [], []
    used: dict[int, int] = {}
    sequence = 0
    for uses, times in plan(counts, capacity):
        at = 0
        for length, k in uses:
            lengths.append(length)
            firsts.append(used.get(length, 0))
            repeats.append(k)
            sequences.append(sequence)
            offsets.append(at)
            used[length] = used.get(length, 0) + k * times
            at += k * length
        sequence += times
    span = max([1, *used.values()])
    order = np.lexsort((firsts, lengths)) if lengths else np.zeros(0, int)
    spans = {k: np.array(v, np.int64)[order] for k, v in (("length", lengths), ("first", firsts), ("repeat", repeats), ("sequence", sequences), ("offset", offsets))}
    keys = spans["length"] * span + spans["first"]

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, at = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        k = np.searchsorted(keys, size * span + at, side="right") - 1
        turn, nth = np.divmod(at - spans["first"][k], spans["repeat"][k])
        return pd.DataFrame({"sequence_id": spans["sequence"][k] + turn, "offset": spans["offset"][k] + nth * size})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(starts, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length")))
    placed = ranked.withColumn("_slot", slot(F.col("length"), F.col("_before") + F.col("nth")))
    return placed.select(*pieces.columns, "_slot.sequence_id", "_slot.offset")
