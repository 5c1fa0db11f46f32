"""Edits of nested documents, as Column expressions: a document stays one row, so no edit shuffles. Each listed id is looked
up among the document's bars, which suits up to some thousand bars; ``structure_rows`` has the edits for larger ones.

A structure document is ``bars`` (id, index, time_signature, color, accents) and ``sections`` (id, name, color, bar_ids,
repeat_of, comment, bars_per_row); sections refer to bars by id, in order. A transcription document is ``sections`` of
``steps``. Every function returns the new columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza import dims
from cadenza.functions import theory as th

BAR = "struct<id:string,index:int,time_signature:string,color:string,accents:array<int>>"
SECTION = "struct<id:string,name:string,color:string,bar_ids:array<string>,repeat_of:string,comment:string,bars_per_row:int>"
LEGACY = "struct<id:string,type:string,custom_label:string,name:string,color:string,bar_ids:array<string>,repeat_of:string,comment:string>"
STEP = "struct<degree:int,label:string,intervals:array<int>,beats:double,offset_eighths:double,confidence:string>"
SONG_SECTION = f"struct<id:string,type:string,custom_label:string,steps:array<{STEP}>>"

Value = Column | str


def col(x: Value) -> Column:
    return F.col(x) if isinstance(x, str) else x


def changed(items: Column, which: Callable[[Column], Column], edit: Callable[[Column], Column]) -> Column:
    return F.transform(items, lambda x: F.when(which(x), edit(x)).otherwise(x))


def section_bars(section: Column, bars: Column) -> Column:
    """The section's bars in its order; ids without a bar are dropped, and of bars with equal ids the last counts."""
    found = F.transform(section["bar_ids"], lambda i: F.try_element_at(F.filter(bars, lambda b: b["id"] == i), F.lit(-1)))
    return F.filter(found, lambda b: b.isNotNull())


def reindexed(bars: Value, sections: Value) -> Column:
    """The bars in section order, numbered from 0: unassigned bars go, a bar that is listed twice comes twice."""
    bars, sections = col(bars), col(sections)
    ordered = F.flatten(F.transform(sections, lambda s: section_bars(s, bars)))
    return F.transform(ordered, lambda b, i: b.withField("index", i.cast("int")))


def add_bar(bars: Value, sections: Value, section_id: Column, signature: Column, new_id: Column) -> tuple[Column, Column]:
    bars, sections = col(bars), col(sections)
    bar = F.struct(new_id.alias("id"), F.size(bars).alias("index"), signature.alias("time_signature"), F.lit(None).cast("string").alias("color"), F.lit(None).cast("array<int>").alias("accents"))
    after = changed(sections, lambda s: s["id"] == section_id, lambda s: s.withField("bar_ids", F.array_append(s["bar_ids"], new_id)))
    return reindexed(F.array_append(bars, bar), after), after


def remove_bar(bars: Value, sections: Value, bar_id: Column) -> tuple[Column, Column]:
    left = F.filter(col(bars), lambda b: b["id"] != bar_id)
    after = F.transform(col(sections), lambda s: s.withField("bar_ids", F.array_remove(s["bar_ids"], bar_id)))
    return reindexed(left, after), after


def set_time_signature(bars: Value, bar_id: Column, signature: Column) -> Column:
    """Accents beyond the new signature's dots go; none left is null."""

    def edit(b: Column) -> Column:
        kept = F.filter(b["accents"], lambda a: a < th.dots(signature))
        return b.withField("time_signature", signature).withField("accents", F.when(F.size(kept) > 0, kept))

    return changed(col(bars), lambda b: b["id"] == bar_id, edit)


def set_bar_color(bars: Value, bar_id: Column, color: Column) -> Column:
    return changed(col(bars), lambda b: b["id"] == bar_id, lambda b: b.withField("color", color))


def toggled(accents: Column, dot: Column) -> Column:
    """Membership of ``dot`` turned over; sorted, and null if none is left."""
    have = F.coalesce(accents, F.array().cast("array<int>"))
    after = F.when(F.array_contains(have, dot), F.array_remove(have, dot)).otherwise(F.array_sort(F.array_append(have, dot)))
    return F.when(F.size(after) > 0, after)


def toggle_accent(bars: Value, bar_id: Column, dot: Column) -> Column:
    return changed(col(bars), lambda b: b["id"] == bar_id, lambda b: b.withField("accents", toggled(b["accents"], dot)))


def new_section(new_id: Column, name: Column, color: Column, bar_ids: Column, comment: Column, per_row: Column) -> Column:
    parts = (new_id.alias("id"), name.alias("name"), color.alias("color"), bar_ids.alias("bar_ids"), F.lit(None).cast("string").alias("repeat_of"), comment.alias("comment"), per_row.alias("bars_per_row"))
    return F.struct(*parts).cast(SECTION)


def add_section(sections: Value, new_id: Column, name: Column, color: Column) -> Column:
    none = F.lit(None)
    return F.array_append(col(sections), new_section(new_id, name, color, F.array().cast("array<string>"), none.cast("string"), none.cast("int")))


def duplicate_section(bars: Value, sections: Value, section_id: Column, fallback: Column, bar_name: Callable[[Column], Column], new_id: Column) -> tuple[Column, Column]:
    """A copy with new ids right after its source; repeat_of isn't copied. ``bar_name`` gives the new id of the n-th
    copied bar. Both columns are null if there is no such section."""
    bars, sections = col(bars), col(sections)
    source = F.get(F.filter(sections, lambda s: s["id"] == section_id), F.lit(0))

    def copy(bar_id: Column, n: Column) -> Column:
        first = F.get(F.filter(bars, lambda b: b["id"] == bar_id), F.lit(0))
        parts = (bar_name(n).alias("id"), F.lit(0).alias("index"), F.coalesce(first["time_signature"], fallback).alias("time_signature"), first["color"].alias("color"), first["accents"].alias("accents"))
        return F.struct(*parts).cast(BAR)

    copies = F.transform(source["bar_ids"], copy)
    own = new_section(new_id, source["name"], source["color"], F.transform(copies, lambda b: b["id"]), source["comment"], source["bars_per_row"])
    at = F.array_position(F.transform(sections, lambda s: s["id"]), section_id).cast("int")
    after = F.when(source.isNotNull(), F.concat(F.slice(sections, F.lit(1), at), F.array(own), F.slice(sections, at + 1, F.size(sections))))
    return F.when(source.isNotNull(), reindexed(F.concat(bars, copies), after)), after


def remove_section(bars: Value, sections: Value, section_id: Column) -> tuple[Column, Column]:
    """The section goes with its bars, and repeats of it become sections of their own."""
    bars, sections = col(bars), col(sections)
    gone = F.flatten(F.transform(F.filter(sections, lambda s: s["id"] == section_id), lambda s: s["bar_ids"]))
    left = F.filter(sections, lambda s: s["id"] != section_id)
    after = changed(left, lambda s: s["repeat_of"] == section_id, lambda s: s.withField("repeat_of", F.lit(None).cast("string")))
    return reindexed(F.filter(bars, lambda b: ~F.array_contains(gone, b["id"])), after), after


def set_section(sections: Value, section_id: Column, field: str, value: Column) -> Column:
    """``field`` is name, color, comment or bars_per_row."""
    return changed(col(sections), lambda s: s["id"] == section_id, lambda s: s.withField(field, value))


def moved(items: Column, old: Column, new: Column) -> Column:
    """The item at place ``old`` taken out and put in at ``new`` (places from 1)."""
    left = F.concat(F.slice(items, F.lit(1), old - 1), F.slice(items, old + 1, F.size(items)))
    return F.concat(F.slice(left, F.lit(1), new - 1), F.slice(items, old, F.lit(1)), F.slice(left, new, F.size(items)))


def reorder_sections(bars: Value, sections: Value, active: Column, over: Column) -> tuple[Column, Column]:
    """Unknown ids, or one place, change nothing, and then the bars aren't numbered anew."""
    bars, sections = col(bars), col(sections)
    ids = F.transform(sections, lambda s: s["id"])
    old, new = F.array_position(ids, active).cast("int"), F.array_position(ids, over).cast("int")
    moves = (old > 0) & (new > 0) & (old != new)
    after = F.when(moves, moved(sections, F.greatest(old, F.lit(1)), F.greatest(new, F.lit(1)))).otherwise(sections)
    return F.when(moves, reindexed(bars, after)).otherwise(bars), after


def move_bar(bars: Value, sections: Value, bar_id: Column, section_id: Column) -> tuple[Column, Column]:
    """The bar comes last in the section; if there is no such section, the bar is gone."""

    def edit(s: Column) -> Column:
        without = F.array_remove(s["bar_ids"], bar_id)
        return s.withField("bar_ids", F.when(s["id"] == section_id, F.array_append(without, bar_id)).otherwise(without))

    after = F.transform(col(sections), edit)
    return reindexed(bars, after), after


def migrated_section(raw: Column) -> Column:
    """A section of the old shape (type and custom_label) with name and color."""
    kind = F.coalesce(raw["type"], F.lit("custom"))
    label = F.coalesce(*(F.when(kind == t, F.lit(n)) for t, n, _ in dims.SECTION_TYPES), kind)
    color = F.coalesce(*(F.when(kind == t, F.lit(c)) for t, _, c in dims.SECTION_TYPES), F.lit(dims.PALETTE[0]))
    named = F.when((kind == "custom") & (F.coalesce(raw["custom_label"], F.lit("")) != ""), raw["custom_label"]).otherwise(label)
    done = raw["name"].isNotNull() & raw["color"].isNotNull()
    parts = (
        raw["id"].alias("id"),
        F.when(done, raw["name"]).otherwise(named).alias("name"),
        F.when(done, raw["color"]).otherwise(color).alias("color"),
        raw["bar_ids"].alias("bar_ids"),
        raw["repeat_of"].alias("repeat_of"),
        raw["comment"].alias("comment"),
        F.lit(None).cast("int").alias("bars_per_row"),
    )
    return F.struct(*parts).cast(SECTION)


def migrated(bars: Value, legacy: Value, orphans_id: Column) -> Column:
    """The sections in the new shape; bars in no section are collected in one more."""
    sections = F.transform(col(legacy), migrated_section)
    known = F.flatten(F.transform(sections, lambda s: s["bar_ids"]))
    left = F.transform(F.filter(col(bars), lambda b: ~F.array_contains(known, b["id"])), lambda b: b["id"])
    none = F.lit(None)
    extra = new_section(orphans_id, F.lit(dims.ORPHANS_NAME), F.lit(dims.ORPHANS_COLOR), left, none.cast("string"), none.cast("int"))
    return F.when(F.size(left) > 0, F.array_append(sections, extra)).otherwise(sections)


def unassigned(bars: DataFrame, listed: DataFrame, *, on: list[str]) -> DataFrame:
    """Bars, as rows, that no section lists; for documents too large to be a row."""
    return bars.join(listed, on, "left_anti")


# steps and transcription documents


def append_step(steps: Value, step: Column) -> Column:
    """No more than 64 steps."""
    return F.when(F.size(col(steps)) < dims.MAX_STEPS, F.array_append(col(steps), step)).otherwise(col(steps))


def remove_step(steps: Value, index: Column) -> Column:
    return F.filter(col(steps), lambda s, i: i != index)


def set_step(steps: Value, index: Column, field: str, value: Column) -> Column:
    """``field`` beats (clamped) or confidence of the step at ``index``."""
    value = th.clamp_step_beats(value) if field == "beats" else value
    return F.transform(col(steps), lambda s, i: F.when(i == index, s.withField(field, value)).otherwise(s))


def in_section(sections: Value, index: Column, edit: Callable[[Column], Column]) -> Column:
    """``edit`` of the steps of the section at ``index``; an index that isn't there changes nothing."""
    return F.transform(col(sections), lambda s, i: F.when(i == index, s.withField("steps", edit(s["steps"]))).otherwise(s))


def add_song_section(sections: Value, new_id: Column, kind: Column, label: Column) -> tuple[Column, Column]:
    """The sections and the new active index."""
    section = F.struct(new_id.alias("id"), kind.alias("type"), label.alias("custom_label"), F.array().cast(f"array<{STEP}>").alias("steps")).cast(SONG_SECTION)
    return F.array_append(col(sections), section), F.size(col(sections))


def remove_song_section(sections: Value, index: Column, active: Column) -> tuple[Column, Column]:
    """One section or none left over is emptied whatever the index; the active index is clamped, not shifted."""
    left = F.filter(col(sections), lambda s, i: i != index)
    few = F.size(col(sections)) <= 1
    none = F.array().cast(f"array<{SONG_SECTION}>")
    return F.when(few, none).otherwise(left), F.when(few, F.lit(0)).otherwise(F.least(active, F.size(left) - 1))


def display_label(section: Column) -> Column:
    label = F.coalesce(*(F.when(section["type"] == t, F.lit(n)) for t, n, _ in dims.SECTION_TYPES))
    return F.coalesce(F.nullif(section["custom_label"], F.lit("")), label)


def focus_after(focus: Column, removed: Column) -> Column:
    """The focused section once ``removed`` is gone: none, if it was that."""
    return F.when(~focus.eqNullSafe(removed), focus)


def picked(selected: Column, clicked: Column) -> Column:
    """A chord picker's root: clicking the selected one lets it go."""
    return F.when(~clicked.eqNullSafe(selected), clicked)


def can_add(steps: Value) -> Column:
    return F.size(col(steps)) < dims.MAX_STEPS


def opened(sections: Value, load: Column) -> Column:
    """A transcription's state (sections, active): a song's sections where it is loaded, or else cleared; the first is active."""
    none = F.array().cast(f"array<{SONG_SECTION}>")
    return F.struct(F.when(load, col(sections)).otherwise(none).alias("sections"), F.lit(0).alias("active"))


def with_active(state: Column, index: Column) -> Column:
    """The active index as given; it isn't clamped."""
    return state.withField("active", index)
