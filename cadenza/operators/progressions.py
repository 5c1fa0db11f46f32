"""Steps of a progression: resolution against a key, chromatic steps, analysis and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza import dims
from cadenza.functions import theory as th
from cadenza.operators.harmony import harmonic_field


def resolve_steps(steps: DataFrame) -> DataFrame:
    """Steps (degree, label, intervals) with key_root and is_minor get chord_name, note_names, function, notes and
    field_degree. A degree that the field doesn't hold falls back to the label and the intervals."""
    field = harmonic_field(steps.sparkSession).select(*(F.col(c).alias(f"_{c}") for c in ("key_root", "is_minor", "field_index", "chord_name", "note_names", "function", "notes")))
    joined = steps.join(F.broadcast(field), (F.col("key_root") == F.col("_key_root")) & (F.col("is_minor") == F.col("_is_minor")) & (F.col("degree") == F.col("_field_index")), "left")
    own = th.transposed(F.col("key_root"), F.coalesce("intervals", F.array().cast("array<int>")))
    root_name = th.preferred_root_name(F.col("key_root"))
    return joined.select(
        *steps.columns,
        F.coalesce("_chord_name", "label").alias("chord_name"),
        F.coalesce("_note_names", F.transform(own, lambda n: th.note_name(n, root_name))).alias("note_names"),
        F.col("_function").alias("function"),
        F.coalesce("_notes", own).alias("notes"),
        F.col("_field_index").alias("field_degree"),
    )


def common_chromatic_steps(keys: DataFrame) -> DataFrame:
    """The twelve common chromatic chords in each row's key: notes, label and key-relative intervals."""
    crossed = keys.join(F.broadcast(dims.chromatic(keys.sparkSession)))
    root = th.pitch_class(F.col("key_root") + F.col("above"))
    return crossed.select(*keys.columns, "category", "label", th.transposed(root, F.col("intervals")).alias("notes"), th.transposed(F.col("above"), F.col("intervals")).alias("step_intervals"))


def manual_chromatic_steps(rows: DataFrame) -> DataFrame:
    """A chord of type_id on root_note in key_root: notes, label spelled for the key, key-relative intervals."""
    kinds = dims.chord_types(rows.sparkSession).select(F.col("type_id").alias("_id"), "symbol", F.col("intervals").alias("_iv"))
    joined = rows.join(F.broadcast(kinds), F.col("type_id") == F.col("_id"))
    name = th.note_name(F.col("root_note"), th.preferred_root_name(F.col("key_root")))
    return joined.select(
        *rows.columns,
        th.transposed(F.col("root_note"), F.col("_iv")).alias("notes"),
        F.concat(name, "symbol").alias("label"),
        th.key_relative(F.col("root_note"), F.col("key_root"), F.col("_iv")).alias("step_intervals"),
    )


def analyze(resolved: DataFrame, *, song: str = "song", pos: str = "pos") -> DataFrame:
    """One row a song: the joined labels, the sentences that hold (null with fewer than two steps or none), and the
    count of each function with its share of the most frequent one."""
    order = Window.partitionBy(song).orderBy(pos)
    f = F.col("function")
    marked = resolved.withColumn("_cadence", (f == "SD") & (F.lead("function", 1).over(order) == "D") & (F.lead("function", 2).over(order) == "T"))
    per = marked.groupBy(song).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_or("_cadence"), F.lit(False)).alias("_cadence"),
        F.min_by(F.coalesce(f, F.lit("-")), pos).alias("_first"),
        F.max_by(F.coalesce(f, F.lit("-")), pos).alias("_last"),
        F.bool_or(f.isNull()).alias("_chromatic"),
        *(F.count_if(f == x).alias(f"n_{x.lower()}") for x in ("T", "SD", "D")),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), "label"))), lambda s: s["label"]), " - ").alias("labels"),
    )
    a = dims.ANALYSIS
    ends = F.when((F.col("_first") == "T") & (F.col("_last") == "T"), a["circular"]).when((F.col("_first") == "T") & (F.col("_last") == "D"), a["suspended"]).when(F.col("_first") != "T", a["moving"])
    said = F.concat_ws(" ", F.when(F.col("_cadence"), a["cadence"]), ends, F.when(F.col("_chromatic"), a["chromatic"]))
    most = F.greatest("n_t", "n_sd", "n_d", F.lit(1))
    return per.select(song, "n", "labels", F.when((F.col("n") >= 2) & (said != ""), said).alias("analysis"), "n_t", "n_sd", "n_d", *((F.col(f"n_{x}") / most).alias(f"share_{x}") for x in ("t", "sd", "d")))


def totals(steps: DataFrame, *by: str) -> DataFrame:
    """Beats, where a missing length is 4; eighths rounded a step; steps; unsure steps."""
    beats = F.coalesce("beats", F.lit(4.0))
    return steps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.sum(beats).alias("beats"),
        F.sum(F.floor(beats * 2 + 0.5)).alias("eighths"),
        F.count_if(F.col("confidence") == "unsure").alias("n_unsure"),
    )


def review(steps: DataFrame, *, song: str = "song", section: str = "section", pos: str = "pos") -> DataFrame:
    """Each step with the step before and after it in the song, and whether a review starts there: at the first unsure
    step, or else at the first step."""
    order = Window.partitionBy(song).orderBy(section, pos)
    first = steps.groupBy(song).agg(F.min(F.struct((~F.col("confidence").eqNullSafe("unsure")).alias("sure"), F.col(section).alias("s"), F.col(pos).alias("p"))).alias("_start"))
    out = steps.withColumns({"previous_label": F.lag("label").over(order), "next_label": F.lead("label").over(order)})
    return out.join(first, song).withColumn("start", (F.col("_start.s") == F.col(section)) & (F.col("_start.p") == F.col(pos))).drop("_start")


def to_play(steps: DataFrame, *, active: Column, loop: Column, section: str = "section") -> DataFrame:
    """The steps that a player plays: those of the active section where it loops, or else all."""
    return steps.where(~loop | (F.col(section) == active))


def has_steps(sections: Column) -> Column:
    """Whether any section (a struct with ``steps``) has one."""
    return F.coalesce(F.exists(sections, lambda s: F.size(s["steps"]) > 0), F.lit(False))


def flattened(songs: DataFrame, *, song: str = "song") -> DataFrame:
    """Nested songs (sections of steps) as a row a step, with both places from 0."""
    each = songs.select(song, F.posexplode("sections").alias("section", "_s"))
    return each.select(song, "section", F.posexplode("_s.steps").alias("pos", "step"))


def diatonic_steps(keys: DataFrame) -> DataFrame:
    """The step that each chord of a key's field makes: its degree from 0 and numeral; the length is left open, and read as 4."""
    field = harmonic_field(keys.sparkSession).select(F.col("key_root").alias("_root"), F.col("is_minor").alias("_minor"), F.col("field_index").alias("degree"), F.col("numeral").alias("label"))
    joined = keys.join(F.broadcast(field), (F.col("key_root") == F.col("_root")) & (F.col("is_minor") == F.col("_minor")))
    return joined.select(*keys.columns, "degree", "label", F.lit(None).cast("double").alias("beats"))


def explained(steps: DataFrame, explanations: DataFrame) -> DataFrame:
    """Steps with the text for their degree in their mode (is_minor, degree, text); null where there is none."""
    known = explanations.select(F.col("is_minor").alias("_minor"), F.col("degree").alias("_degree"), "text")
    return steps.join(known, (F.col("is_minor") == F.col("_minor")) & (F.col("degree") == F.col("_degree")), "left").drop("_minor", "_degree")
