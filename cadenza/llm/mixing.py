"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in a hash order, are one stream of words that is cut into blocks of BLOCK words. The slots of
the mix are golden-ratio points mapped through the sources' cumulative shares, so that every stretch of the mix has each
source near its share. A source's slots are ranked in schedule order; slot r takes block r modulo the source's number of
blocks, so no word comes a third time before all have come twice. The last slot of a source is cut where the target ends.

Targets: sources in code-point order, null last, have the weights given, repeating. They share EPOCHS times all words; a
source stops at MOST times its own size, and the excess is shared again by weight until none is above.

Nulls: a null text has no words and is never taken; a null source is a source, sorted last; a null doc_id is kept.
Documents without words are returned with taken 0. Very long texts are counted whole and span many blocks. Repeated rows
are documents of their own; documents with equal hashes go by id and checksum. The columns of a table may have any names:
the mix as rows keeps them all. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm._work import RANK_GROUP_ROWS, dealt, hot_join, running, text_batches, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
EPOCHS = 1.5
MOST = 2.0
BLOCK = 1024
#: Copies of one document that are made in one place.
REPEATED = 1000
_word = re.compile(WORD.encode())
GOLDEN = (math.sqrt(5) - 1) / 2


def targets(sizes: list[int], weights: list[float], *, epochs: float = EPOCHS, most: float = MOST) -> list[float]:
    """The words that each source is to give."""
    left, out, open_ = epochs * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_ and left > 0:
        total = sum(weights[k] for k in open_)
        share = {k: left * weights[k] / total for k in open_}
        over = [k for k in open_ if share[k] > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = share[k]
            break
        for k in over:
            out[k] = most * sizes[k]
            left -= out[k]
        open_ = [k for k in open_ if share[k] <= most * sizes[k]]
    return out


@dataclass
class Source:
    code: int
    name: str | None
    size: int
    target: float

    @property
    def words(self) -> int:
        return round(self.target)

    @property
    def blocks(self) -> int:
        return -(-self.size // BLOCK)

    @property
    def slots(self) -> int:
        """Slots until the target is reached: whole rounds over the blocks, then some of them."""
        if not self.size:
            return 0
        rounds, rest = divmod(self.words, self.size)
        return rounds * self.blocks + -(-rest // BLOCK)


@dataclass
class Mix:
    """docs: one row a document, with its place in its source's stream. taken: one row for each stretch of words of a
    document that a slot takes, with the slot's place in the mix."""

    docs: DataFrame
    taken: DataFrame
    sources: list[Source]


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, most: float = MOST, key: str = "doc_id") -> Mix:
    spark = docs.sparkSession
    sized = written(
        docs.select(F.col(key).alias("key"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc")),
        "sized",
    )
    # one row a source
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    wanted = targets([x["size"] for x in found], [weights[k % len(weights)] for k in range(len(found))], epochs=epochs, most=most)
    sources = [Source(k, x["source"], x["size"], t) for k, (x, t) in enumerate(zip(found, wanted, strict=True))]
    fields = "code int, name string, source_size long, target double, words long, blocks long, slots long"
    table = spark.createDataFrame([(s.code, s.name, s.size, float(s.target), s.words, s.blocks, s.slots) for s in sources], fields)
    named = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    order = F.xxhash64("key", "crc", F.lit(6))
    streams = written(running(named, F.col("code"), [order, F.col("key"), F.col("crc"), F.col("size")], out="start", group=dealt(order, sum(x["n"] for x in found)), value=F.col("size")), "streams")
    slots = schedule(spark, sources)
    held = slots.join(F.broadcast(table.select("code", "source_size", "words", "blocks")), "code")
    block, epoch = F.col("rank") % F.col("blocks"), F.floor(F.col("rank") / F.col("blocks"))
    held = held.withColumn("block", block).withColumn("epoch", epoch)
    length = F.least(F.lit(BLOCK), F.col("source_size") - F.col("block") * BLOCK)
    held = held.withColumn("take", F.least(length, F.col("words") - F.col("epoch") * F.col("source_size") - F.col("block") * BLOCK)).where("take > 0")
    spans = streams.where("size > 0").select("code", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))).alias("block"))
    begin = F.greatest("start", F.col("block") * BLOCK)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK, F.col("block") * BLOCK + F.col("take"))
    taken = (
        held.select("code", "block", "epoch", "place", "take")
        .join(spans, ["code", "block"])
        .select("code", "start", "place", "epoch", (begin - F.col("start")).alias("word"), (end - begin).alias("words"))
        .where("words > 0")
    )
    return Mix(streams, taken, sources)


def schedule(spark, sources: list[Source]) -> DataFrame:
    """(place, code, rank): the slots of the mix in their order. rank counts a source's slots from 0.

    A margin of points is drawn and each source stops at its own number of slots; the few slots that a source may still
    lack come at the end.
    """
    need = np.array([s.slots for s in sources], float)
    total = int(need.sum())
    bounds = [float(x) for x in np.cumsum(need) / max(1, total)]
    last = max(0, len(sources) - 1)
    # a point belongs to the first source whose bound is above it: one row a source
    reach = F.array(*(F.lit(x) for x in bounds)) if bounds else F.array(F.lit(1.0))

    def source_of(point: Column) -> Column:
        return F.least(F.size(F.filter(reach, lambda x: x <= point)), F.lit(last)).cast("int")

    drawn = int(total * 1.01) + 64 if total else 0
    point = (F.col("place") + 0.5) * GOLDEN
    coded = written(spark.range(drawn).select(F.col("id").alias("place")).withColumn("code", source_of(point - F.floor(point))), "points")
    ranks = running(coded, F.col("code"), [F.col("place")], out="rank", group=F.floor(F.col("place") / RANK_GROUP_ROWS))
    table = spark.createDataFrame([(s.code, s.slots) for s in sources], "code int, slots long")
    came = table.join(coded.groupBy("code").count(), "code", "left").where("coalesce(count, 0) < slots")
    late = came.select((F.lit(drawn) + F.col("code")).alias("place"), "code", F.explode(F.expr("sequence(coalesce(count, 0), slots - 1)")).alias("rank"))
    return ranks.join(F.broadcast(table), "code").where("rank < slots").select("place", "code", "rank").union(late)


def totals(found: Mix) -> DataFrame:
    """(key, size, source_size, target, taken) of each document."""
    words = found.taken.groupBy("code", "start").agg(F.sum("words").alias("taken"))
    joined = found.docs.withColumn("at", F.when(F.col("size") > 0, F.col("start"))).join(words.withColumnRenamed("start", "at"), ["code", "at"], "left")
    return joined.select("key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


@F.pandas_udf(T.StringType())
def first_words(text: pd.Series, words: pd.Series) -> pd.Series:
    """The text up to the end of its first words."""
    out = []
    for x, n in zip(text, words, strict=True):
        at, data = 0, x.encode()
        for found, m in enumerate(_word.finditer(data)):
            if found + 1 == n:
                at = m.end()
                break
        out.append(data[:at].decode())
    return pd.Series(out)


def rows(docs: DataFrame, found: Mix, *, key: str = "doc_id") -> DataFrame:
    """The mix as rows with the columns of ``docs``: one for each time that a document comes, its text cut (and n_chars
    with it) where the source's target ends. Texts are matched by id, source and checksum. Rows that are equal in these
    are copies of one document: the mix has as many of them, and their other columns are those of one of them."""
    text_batches(docs.sparkSession)
    same = ["hash", "crc"]
    parts = found.taken.groupBy("code", "start", "epoch").agg(F.sum("words").alias("part"))
    each = found.docs.where("size > 0").join(parts, ["code", "start"]).groupBy("code", "start", "key", "source", "crc", "size").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    each = written(each.select(F.xxhash64("key", "source").alias("hash"), "crc", "size", "parts"), "parts")
    many = written(each.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")).withColumn("n", F.col("copies")), "copies")
    each = written(hot_join(each, many, same, "n"), "each")
    whole = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(key), F.col("source")).alias("hash"), F.crc32(F.col("text").cast("binary")).alias("crc"))
    joined = whole.join(each.where("copies = 1"), same).select("row", "parts", "size")
    again = each.where("copies > 1")
    if not again.isEmpty():  # otherwise the texts are shuffled once at most
        joined = joined.unionByName(copied(whole, again))
    part = joined.select("row", "size", F.explode("parts").alias("part"))
    text = F.col("row")["text"]
    row = F.col("row").withField("text", F.when(F.col("part") >= F.col("size"), text).otherwise(first_words(text, F.col("part"))))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(row["text"]).cast(docs.schema["n_chars"].dataType))
    return part.select(row.alias("row")).select("row.*")


def copied(whole: DataFrame, again: DataFrame) -> DataFrame:
    """Rows of documents that come several times. A group of copies may hold much of the table, so that one row stands for
    all, and it is repeated in steps of REPEATED."""
    texts = whole.groupBy("hash", "crc").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    groups = again.groupBy("hash", "crc", "size", "parts").agg(F.count(F.lit(1)).alias("times"))  # few ways to be taken
    step = F.explode(F.sequence(F.lit(0), F.col("times") - 1, F.lit(REPEATED))).alias("from")
    steps = texts.join(groups.select("hash", "crc", "size", "parts", "times", step), ["hash", "crc"]).repartition("hash", "crc", "from")
    each = F.array_repeat("parts", F.least(F.lit(REPEATED), F.col("times") - F.col("from")).cast("int"))
    return steps.select("row", F.explode(each).alias("parts"), "size")
