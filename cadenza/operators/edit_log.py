"""A log of mixed edits of structure documents, each of which sees what those before it left.

``log``: doc, seq (a positive long, which orders a document's edits), op, section_id, bar_id, over. The ops are add_bar,
remove_bar, move_bar (to the end of section_id), add_section (last), remove_section (its bars go with it) and reorder
(section_id takes the place of ``over``). Tables are those of ``structure_rows``; ``new_bars`` and ``new_sections`` hold the
columns of what the log adds.

Only the order of sections depends on one edit after another: a sorted pass over the sections and their edits keeps one
document's section ids. A bar that an edit names is followed by joins instead: it stands in the section of its latest placement,
unless it was removed, a section was absent when the bar was put there, or the section went while the bar was in it. The others
stay while their section does. So no task holds a document's bars, but to number those of documents of up to ``RUN``; the
placements of one bar are the rows of one window.

A bar that no section lists goes with the first edit that numbers the bars anew (all but add_section, and reorder where it
changes nothing), unless that edit places it. A bar is listed once at most, and what is added has a new id. Edits of what
isn't there (any more, or yet) and ops of other names do nothing; a bar that comes into a section that isn't there is gone.
Documents without edits lose their unlisted bars only. ``doc``, ids and seq aren't null; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import ranks
from cadenza.operators.scans import RUN, longer
from cadenza.operators.structure_rows import LAST
from cadenza.sources.shared import written

NUMBERING = ("add_bar", "remove_bar", "move_bar", "remove_section")
OF_BARS = ("add_bar", "remove_bar", "move_bar")
OF_SECTIONS = ("add_section", "remove_section", "reorder")


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, section_id, place, moved) from a document's sections and edits in their order. ``moved`` is the seq of the first
    reorder that changed something; a document that has it, but no section, is one row without a section."""
    doc, ids, moved, seen, schema = None, [], None, False, None

    def rows() -> pa.RecordBatch:
        n = max(1, len(ids))
        columns = ([doc] * n, ids or [None], list(range(n)), [moved] * n)
        types = (schema.field("doc").type, schema.field("section_id").type, pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc", "section_id", "place", "moved"])

    for batch in batches:
        schema = batch.schema
        for of, seq, op, one, over in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc", "seq", "op", "section_id", "over")), strict=True):
            if not seen or of != doc:
                if seen:
                    yield rows()
                doc, ids, moved, seen = of, [], None, True
            if op == "add_section":
                ids.append(one)
            elif op == "remove_section" and one in ids:
                ids.remove(one)
            elif op == "reorder" and one in ids and over in ids and one != over:
                at = ids.index(over)
                ids.remove(one)
                ids.insert(at, one)
                moved = seq if moved is None else moved
    if seen:
        yield rows()


def ordered(sections: DataFrame, log: DataFrame) -> DataFrame:
    """(doc, section_id, place, moved): the sections that are left, in their order."""
    none = F.lit(None).cast(sections.schema["section_id"].dataType)
    first = sections.select("doc", F.lit(0).cast("long").alias("seq"), F.lit("add_section").alias("op"), "section_id", none.alias("over"), "at")
    edits = log.where(F.col("op").isin(*OF_SECTIONS)).select("doc", "seq", "op", "section_id", "over", F.lit(None).cast(sections.schema["at"].dataType).alias("at"))
    rows = first.unionByName(edits).repartition("doc").sortWithinPartitions("doc", "seq", "at")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("doc", "section_id")}
    return written(rows.mapInArrow(walked, f"doc {kinds['doc']}, section_id {kinds['section_id']}, place int, moved long"), "ordered")


def lives(sections: DataFrame, log: DataFrame) -> DataFrame:
    """(doc, section_id, born, removed) of all sections that ever were; removed is null for those that are left."""
    born = sections.select("doc", "section_id", F.lit(0).cast("long").alias("born")).unionByName(log.where("op = 'add_section'").select("doc", "section_id", F.col("seq").alias("born")))
    gone = log.where("op = 'remove_section'").select("doc", "section_id", F.col("seq").alias("_gone"))
    return born.join(gone, ["doc", "section_id"], "left").groupBy("doc", "section_id", "born").agg(F.min(F.when(F.col("_gone") > F.col("born"), F.col("_gone"))).alias("removed"))


def placements(bars: DataFrame, listings: DataFrame, log: DataFrame) -> DataFrame:
    """(doc, bar_id, seq, section_id, pos, next): where each bar was put, and when next."""
    listed = listings.select("doc", "bar_id", F.lit(0).cast("long").alias("seq"), "section_id", "pos")
    loose = bars.join(listings, ["doc", "bar_id"], "left_anti")
    loose = loose.select("doc", "bar_id", F.lit(0).cast("long").alias("seq"), F.lit(None).cast(listings.schema["section_id"].dataType).alias("section_id"), F.lit(0).cast("long").alias("pos"))
    put = log.where("op in ('add_bar', 'move_bar')").select("doc", "bar_id", "seq", "section_id", (F.lit(LAST) + F.col("seq")).alias("pos"))
    known = bars.select("doc", "bar_id", F.lit(0).cast("long").alias("_born")).unionByName(log.where("op = 'add_bar'").select("doc", "bar_id", F.col("seq").alias("_born")))
    rows = listed.unionByName(loose).unionByName(put).join(known, ["doc", "bar_id"]).where("seq >= _born")
    gone = log.where("op = 'remove_bar'").groupBy("doc", "bar_id").agg(F.max("seq").alias("_gone"))
    rows = rows.join(gone, ["doc", "bar_id"], "left").where("_gone is null or _gone < _born")
    return rows.drop("_born", "_gone").withColumn("next", F.lead("seq").over(Window.partitionBy("doc", "bar_id").orderBy("seq")))


def followed(sections: DataFrame, placed: DataFrame, log: DataFrame, order: DataFrame, *, new_bars: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What is left of the bars after the whole log, in parts: the bars that no edit names, as in ``placed``; the sections (doc,
    section_id, at) in which they stay; the edited bars that are listed, with at and _known, whether a bar has a row of its own;
    and a table with each document once a bar at least. ``placed``: bars with section_id and pos, both null where no section
    lists the bar. ``order``: what ``ordered`` gives.

    Bars that no edit names stay where they are while their section does. Only the others are followed by their placements.
    """
    edited = log.where(F.col("op").isin(*OF_BARS)).select("doc", "bar_id").distinct().withColumn("_edited", F.lit(True))
    every = written(placed.join(edited, ["doc", "bar_id"], "left"), "placed")
    few = every.where("_edited").drop("_edited")
    lived, places = lives(sections, log), order.select("doc", "section_id", F.col("place").cast("double").alias("at"))
    kept = lived.where("born = 0 and removed is null").join(places, ["doc", "section_id"]).select("doc", "section_id", "at")
    still = every.where("_edited is null and section_id is not null").select(*placed.columns)

    numbering = log.where(F.col("op").isin(*NUMBERING)).select("doc", "seq").unionByName(order.where("moved is not null").select("doc", F.col("moved").alias("seq")))
    first = numbering.groupBy("doc").agg(F.min("seq").alias("_first"))
    listings = few.where("section_id is not null").select("doc", "section_id", "pos", "bar_id")
    where = placements(few, listings, log).join(lived, ["doc", "section_id"], "left").join(first, "doc", "left")
    loose = (F.col("seq") == 0) & F.col("section_id").isNull()
    there = F.coalesce((F.col("born") <= F.col("seq")) & (F.col("removed").isNull() | (F.col("removed") > F.col("next"))), F.lit(False))
    stays = F.when(loose, F.coalesce(F.col("next") <= F.col("_first"), F.lit(False))).otherwise(there)
    last = where.groupBy("doc", "bar_id").agg(F.bool_and(stays).alias("_stays"), F.max_by(F.struct("section_id", "pos"), "seq").alias("_at")).where("_stays")
    left = last.select("doc", F.col("_at.section_id").alias("section_id"), F.col("_at.pos").alias("pos"), "bar_id").join(places, ["doc", "section_id"])
    own = few.drop("section_id", "pos")
    own = own if new_bars is None else own.unionByName(new_bars.select(*own.columns))
    left = left.join(own.withColumn("_known", F.lit(True)), ["doc", "bar_id"], "left").withColumn("_known", F.col("_known").isNotNull())
    return still, kept, left.select(*placed.columns, "at", "_known"), every.select("doc").unionAll(log.where("op = 'add_bar'").select("doc"))


def joined(still: DataFrame, kept: DataFrame, left: DataFrame) -> DataFrame:
    """The parts that ``followed`` gives as one table."""
    return still.join(kept, ["doc", "section_id"]).withColumn("_known", F.lit(True)).select(*left.columns).unionByName(left)


def applied(sections: DataFrame, bars: DataFrame, listings: DataFrame, log: DataFrame, *, new_bars: DataFrame | None = None, new_sections: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sections, bars and listings after the whole log; ``structure_rows.reindexed`` numbers the bars."""
    order = ordered(sections, log)
    placed = bars.join(listings.select("doc", "bar_id", "section_id", "pos"), ["doc", "bar_id"], "left")
    rows = joined(*followed(sections, placed, log, order, new_bars=new_bars)[:3])
    named = sections if new_sections is None else sections.unionByName(new_sections.select(*sections.columns))
    named = named.drop("at").join(order.where("section_id is not null").select("doc", "section_id", F.col("place").cast("double").alias("at")), ["doc", "section_id"])
    if "repeat_of" in sections.columns:
        gone = log.where("op = 'remove_section'").select("doc", F.col("section_id").alias("repeat_of")).distinct().withColumn("_gone", F.lit(True))
        named = named.join(gone, ["doc", "repeat_of"], "left").withColumn("repeat_of", F.when(F.col("_gone").isNull(), F.col("repeat_of")))
    return named.select(*sections.columns), rows.where("_known").select(*bars.columns), rows.select("doc", "section_id", "at", "pos", "bar_id")


def numbered(sections: DataFrame, placed: DataFrame, log: DataFrame, *, new_bars: DataFrame | None = None, run: int = RUN) -> DataFrame:
    """The listed bars after the whole log with bar_index, their place in the document; ``placed`` as in ``followed``.

    Where no document has more than ``run`` bars, one shuffle by document gives bars the places of their sections and their own."""
    still, kept, left, bound = followed(sections, placed, log, ordered(sections, log), new_bars=new_bars)
    out = [*placed.columns, "bar_index"]
    if longer(bound, ["doc"], run):
        rows = joined(still, kept, left).where("_known").drop("_known")
        return ranks.numbered(rows, ["doc"], [F.col("at"), F.col("pos")], "bar_index").select(*out)
    heads = kept.withColumn("_head", F.lit(True))
    rows = still.unionByName(left.where("_known").drop("_known"), allowMissingColumns=True).unionByName(heads, allowMissingColumns=True).repartition("doc")
    of_section = F.max(F.when(F.col("_head"), F.col("at"))).over(Window.partitionBy("doc", "section_id"))
    rows = rows.withColumn("at", F.coalesce("at", of_section)).where("_head is null and at is not null")
    place = F.row_number().over(Window.partitionBy("doc").orderBy("at", "pos")) - 1
    return rows.withColumn("bar_index", place.cast("int")).select(*out)
