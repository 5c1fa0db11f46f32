"""Language identification with language-bitmask n-gram filters.

Each n-gram of 2, 3 or 4 characters belongs to the languages in which it is common. A bit-sliced Bloom filter stores, at
each of its positions, a mask with one bit a language; the masks at an n-gram's positions, combined by AND, are all
languages that contain it, in one lookup whatever the number of languages. The languages' bits over a text's n-grams
are counted, each count is corrected for that language's false-positive rate, and the largest decides.

Texts are lower-cased; what isn't a letter counts as one space, and n-grams without a letter are skipped. A text longer
than CHUNK characters is read in steps that overlap, so that each n-gram counts once, whatever CHUNK is.

Nulls: a null text and one without letters are ``und`` with score 0; rows with a null lang or doc_id aren't learned
from. A text with letters always gets a learned language: equal shares go to the one that sorts first, and where no
n-gram is known to any, the one with the most labelled texts is named, with score 0. Only without any labelled text is
every answer ``und``. Repeated rows each get a row. Results come beside the caller's row, whose columns may have any
names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm._work import TEXTS, text_batches, written

UNKNOWN = "und"
SIZES = (2, 3, 4)
#: Texts of each language that the filters are built from: the first of a hash order, so never more than these.
TRAIN_ROWS = 1500
POSITIONS = 1 << 20
PROBES = 3
#: An n-gram belongs to a language if it is this common there, against the language in which it is most common.
SHARE = 0.2
LEAST = 3
CHUNK = 1 << 19
PRIME = np.uint64(0x100000001B3)
MIXES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def held_out(key: str = "doc_id") -> Column:
    """Whether the crc32 of the id as text is divisible by 5. Rows without an id are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(x).isalpha() for x in range(0x110000)), bool, 0x110000)


def coded(parts: list[str], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(code point or 32, row) of the characters between two spaces a text, runs of what isn't a letter shrunk to one."""
    points = np.frombuffer((" " + "  ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.array(rows), [len(x) + 2 for x in parts])
    letter = letters()[points]
    keep = np.ones(len(points), bool)
    keep[1:] = letter[1:] | letter[:-1] | (row[1:] != row[:-1])
    return np.where(letter, points, np.uint32(32))[keep], row[keep]


def collapsed(text: str) -> np.ndarray:
    """The codes of one long text, made step by step."""
    out = [np.array([32], np.uint32)]
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        out.append(np.where(letters()[points], points, np.uint32(32)))
    codes = np.concatenate([*out, out[0]])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep]


def stretches(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(codes, rows, how many n-grams may begin here): texts together, or a step of a long one with what overlaps."""
    rows, parts, held = [], [], 0
    for row, text in enumerate(texts):
        if parts and held + len(text) > CHUNK:
            code, which = coded(parts, rows)
            yield code, which, len(code)
            rows, parts, held = [], [], 0
        if len(text) > CHUNK:
            code = collapsed(text)
            for at in range(0, len(code), CHUNK):
                step = code[at : at + CHUNK + max(SIZES) - 1]
                yield step, np.full(len(step), row), CHUNK
            continue
        rows.append(row)
        parts.append(text)
        held += len(text)
    if parts:
        code, which = coded(parts, rows)
        yield code, which, len(code)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(64-bit n-gram hashes, row of each), in chunks."""
    for points, row, starts in stretches([x.lower() for x in texts]):
        code, letter = points.astype(np.uint64), points != 32
        key = code.copy()
        for n in range(2, max(SIZES) + 1):
            key = key[:-1] * PRIME + code[n - 1 :]
            if n in SIZES and len(key):
                whole = row[: len(key)] == row[n - 1 :]
                whole[starts:] = False
                if n == 2:
                    whole &= letter[:-1] | letter[1:]
                yield key[whole] * MIXES[0] ^ key[whole] >> np.uint64(29), row[: len(key)][whole]


def positions(keys: np.ndarray, probe: int) -> np.ndarray:
    return (keys * MIXES[probe] >> np.uint64(64 - POSITIONS.bit_length() + 1)).astype(np.int64)


@dataclass
class Filters:
    """planes: a mask of up to 64 languages at each position; miss: each language's false-positive rate; usual: the
    number of the language with the most labelled texts."""

    languages: list[str]
    planes: list[np.ndarray]
    miss: np.ndarray
    usual: int = 0

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        hits, total = np.zeros((len(self.languages), len(texts))), np.zeros(len(texts))
        for keys, row in grams(texts):
            total += np.bincount(row, minlength=len(texts))
            at = [positions(keys, p) for p in range(PROBES)]
            for j, plane in enumerate(self.planes):
                mask = plane[at[0]]
                for p in at[1:]:
                    mask &= plane[p]
                for k in range(min(64, len(self.languages) - 64 * j)):
                    hits[64 * j + k] += np.bincount(row, mask >> plane.dtype.type(k) & plane.dtype.type(1), minlength=len(texts))
        return hits, total

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        hits, total = self.counts(texts)
        if not len(self.languages):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        true = (hits - total * self.miss[:, None]) / (1 - self.miss[:, None])
        share = np.clip(true / np.maximum(total, 1), 0, 1)
        score = share.max(axis=0)
        best = np.where(score > 0, share.argmax(axis=0), self.usual)
        # every n-gram has a letter, so a text without any n-gram has none
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, total, strict=True)], score


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch.column("code").to_numpy()
        for keys, row in grams([x or "" for x in batch.column("text").to_pylist()]):
            for k in np.unique(lang):
                gram, n = np.unique(keys[lang[row] == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(np.full(len(gram), k, np.int32)), pa.array(n)], ["gram", "code", "n"])


def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("gram").to_numpy().view(np.uint64)
        for p in range(PROBES):
            yield pa.RecordBatch.from_arrays([pa.array(positions(keys, p)), batch.column("code")], ["at", "code"])


def fit(docs: DataFrame, *, rows: int = TRAIN_ROWS) -> Filters:
    """Filters from the texts outside the held-out fold. What comes to the driver is one row a filter position."""
    spark = docs.sparkSession
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").count().orderBy("lang").collect()
    languages = [x["lang"] for x in sizes]
    if not languages:
        return Filters([], [], np.zeros(0))
    usual = max(range(len(sizes)), key=lambda k: (sizes[k]["count"], -k))
    # a hash decides, drawn with a margin; then the first rows of the hash order count, so that a repeated id can't add more
    plan = spark.createDataFrame([(x["lang"], k, int(min(1.0, 2 * rows / x["count"]) * (1 << 20))) for k, x in enumerate(sizes)], "lang string, code int, below long")
    drawn = F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary")), F.lit(5))
    chosen = known.join(F.broadcast(plan), "lang").withColumn("drawn", drawn).where(F.pmod("drawn", F.lit(1 << 20)) < F.col("below"))
    chosen = chosen.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("drawn", "doc_id"))).where(F.col("n") <= rows)
    counted = chosen.select("text", "code").mapInArrow(gram_counts, "gram long, code int, n long").groupBy("gram", "code").agg(F.sum("n").alias("n"))
    counted = written(counted, "grams", batches=TEXTS)
    total = counted.groupBy("code").agg(F.sum("n").alias("total"))
    rated = counted.join(F.broadcast(total), "code").withColumn("rate", F.col("n") / F.col("total"))
    most = rated.groupBy("gram").agg(F.max("rate").alias("most"))
    member = rated.join(most, "gram").where((F.col("rate") >= SHARE * F.col("most")) & (F.col("n") >= LEAST)).select("gram", "code")
    planes, miss = [], []
    for j in range(0, len(languages), 64):
        own = member.where(F.col("code").between(j, j + 63)).select("gram", (F.col("code") - j).alias("code"))
        filled = own.mapInArrow(probes, "at long, code int").groupBy("at").agg(F.expr("bit_or(shiftleft(1L, code))").alias("mask")).toPandas()
        kind = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if min(64, len(languages) - j) <= n)
        plane = np.zeros(POSITIONS, kind)
        plane[filled["at"].to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64).view(np.uint64).astype(kind)
        planes.append(plane)
        miss += [float(np.mean(plane >> kind(k) & kind(1))) ** PROBES for k in range(min(64, len(languages) - j))]
    return Filters(languages, planes, np.array(miss), usual)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """(row, lang_pred, score): the caller's row as a struct, and the prediction, which sees the text only; no shuffle."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # POSITIONS masks: a fixed size

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def found(text: pd.Series) -> pd.DataFrame:
        lang, score = shared.value.predict([x if isinstance(x, str) else "" for x in text])
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return docs.select(F.struct("*").alias("row"), found(F.col("text")).alias("found")).select("row", "found.lang_pred", "found.score")
