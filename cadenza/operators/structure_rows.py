"""Edits of structure documents as tables: bars, sections and listings are rows, keyed by document.

The forms of ``documents`` hold a document in one row, which suits documents of up to some thousand bars. These have no
such bound: every edit is a join or a filter, and the new order comes from ``ranks.numbered``, so that a document which
holds much of the table is spread over many tasks.

``bars``: doc, bar_id and the bar's own columns, one row a bar. ``sections``: doc, section_id, at (any ordered key of the
section's place) and own columns. ``listings``: doc, section_id, at, pos, bar_id, one row for each bar that a section lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.ranks import numbered

LAST = 1 << 40  # a pos after all others


def reindexed(bars: DataFrame, listings: DataFrame) -> DataFrame:
    """The listed bars in section order, numbered from 0: unassigned bars go, ids without a bar are dropped."""
    found = listings.select("doc", "at", "pos", "bar_id").join(bars, ["doc", "bar_id"])
    return numbered(found, ["doc"], [F.col("at"), F.col("pos")], "bar_index").drop("at", "pos")


def section_places(sections: DataFrame) -> DataFrame:
    """``sections`` with their place from 0."""
    return numbered(sections, ["doc"], [F.col("at")], "place")


def moves(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """The new keys (doc, section_id, at) once each section of ``wanted`` (doc, section_id, over; one row a document at most)
    takes the place of the section ``over``: after it, if it stood before, and before it, if it stood after.

    One row a move: a key between those of its new neighbours, or one beyond the outermost. Where two keys leave no room
    between them, the whole document is numbered anew, so all its sections are rows. Unknown ids, or one place, give none.
    ``at`` is a double, and no two sections of a document share one."""
    placed = section_places(sections.select("doc", "section_id", "at"))
    here = wanted.select("doc", "section_id", "over").join(placed.select("doc", "section_id", F.col("place").alias("_old")), ["doc", "section_id"])
    there = placed.select("doc", F.col("section_id").alias("over"), F.col("at").alias("_at"), F.col("place").alias("_new"))
    step = F.when(F.col("_old") < F.col("_new"), 1).otherwise(-1)
    pairs = here.join(there, ["doc", "over"]).where("_old <> _new").withColumn("_step", step).withColumn("place", F.col("_new") + F.col("_step"))
    beyond = pairs.join(placed.select("doc", "place", F.col("at").alias("_beyond")), ["doc", "place"], "left")
    key = F.coalesce((F.col("_at") + F.col("_beyond")) / 2, F.col("_at") + F.col("_step"))
    found = beyond.withColumn("_key", key).withColumn("_room", (F.col("_key") != F.col("_at")) & ~F.col("_key").eqNullSafe(F.col("_beyond")))
    one = found.where("_room").select("doc", "section_id", F.col("_key").alias("at"))
    tight = found.where("not _room").select("doc", F.col("section_id").alias("_moved"), (F.col("_new") + F.col("_step") / 2).alias("_key"))
    anew = placed.join(tight, "doc").select("doc", "section_id", F.when(F.col("section_id") == F.col("_moved"), F.col("_key")).otherwise(F.col("place").cast("double")).alias("at"))
    return one.unionByName(anew)


def rekeyed(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """``rows`` of sections or listings with the keys of ``changes`` (doc, section_id, at)."""
    new = changes.select("doc", "section_id", F.col("at").alias("_at"))
    return rows.join(new, ["doc", "section_id"], "left").withColumn("at", F.coalesce("_at", "at")).select(*rows.columns)


def without(listings: DataFrame, bars: DataFrame) -> DataFrame:
    """``listings`` less those of the bars (doc, bar_id)."""
    return listings.join(bars.select("doc", "bar_id"), ["doc", "bar_id"], "left_anti")


def moved(listings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each bar of ``wanted`` (doc, bar_id, and its new section's section_id and at, null if there is none) comes last in that section, or is
    gone from all."""
    return without(listings, wanted).unionByName(wanted.where("section_id is not null").select("doc", "section_id", "at", F.lit(LAST).alias("pos"), "bar_id"))


def added(bars: DataFrame, listings: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``new`` bars (doc, bar_id, section_id, at and the bar's own columns) come last in their sections."""
    rows = new.select("doc", "section_id", "at", F.lit(LAST).alias("pos"), "bar_id")
    return bars.unionByName(new.drop("section_id", "at")), listings.unionByName(rows)


def removed_bars(bars: DataFrame, listings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return without(bars, gone), without(listings, gone)


def removed_sections(sections: DataFrame, bars: DataFrame, listings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sections of ``gone`` (doc, section_id) go with their bars, and repeats of them become sections of their own."""
    key = gone.select("doc", "section_id")
    theirs = listings.join(key, ["doc", "section_id"], "left_semi").select("doc", "bar_id").distinct()
    left = sections.join(key, ["doc", "section_id"], "left_anti")
    if "repeat_of" in sections.columns:
        named = key.withColumnRenamed("section_id", "repeat_of").withColumn("_gone", F.lit(True))
        left = left.join(named, ["doc", "repeat_of"], "left").withColumn("repeat_of", F.when(F.col("_gone").isNull(), F.col("repeat_of"))).select(*sections.columns)
    return left, without(bars, theirs), without(listings.join(key, ["doc", "section_id"], "left_anti"), theirs)


def duplicated(sections: DataFrame, bars: DataFrame, listings: DataFrame, wanted: DataFrame, *, after: Column, new_id: Column, bar_name: Column, fallback: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A copy of each section of ``wanted`` (doc, section_id) with new ids, at the place ``after`` (an expression over at).
    ``bar_name`` names the copied bars, over ``n``, the bar's number in the section from 0. repeat_of isn't copied; a listed
    id without a bar gets a bar with the ``fallback`` signature."""
    key = wanted.select("doc", "section_id")
    source = sections.join(key, ["doc", "section_id"], "left_semi").withColumns({"at": after, "section_id": new_id})
    if "repeat_of" in sections.columns:
        source = source.withColumn("repeat_of", F.lit(None).cast("string"))
    listed = numbered(listings.join(key, ["doc", "section_id"], "left_semi"), ["doc", "section_id"], [F.col("pos")], "n")
    named = listed.withColumns({"_new": bar_name, "at": after, "section_id": new_id})
    copies = named.select("doc", "bar_id", "_new").join(bars, ["doc", "bar_id"], "left").withColumn("time_signature", F.coalesce("time_signature", fallback))
    copies = copies.withColumn("bar_id", F.col("_new")).select(*bars.columns)
    rows = named.select("doc", "section_id", "at", "pos", F.col("_new").alias("bar_id"))
    return sections.unionByName(source.select(*sections.columns)), bars.unionByName(copies), listings.unionByName(rows.select(*listings.columns))
