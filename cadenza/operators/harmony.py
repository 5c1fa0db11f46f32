"""From pitches to chords, from chords to degrees of a key.

Bars are rows with ``harmony`` and ``root`` arrays of MIDI numbers. Matching is one broadcast lookup of a 12-bit mask of
pitch classes; only the carry-forward needs the bars of a song together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza import dims
from cadenza.functions import theory as th
from cadenza.operators.scans import RUN, Last, scanned


def match_bars(bars: DataFrame) -> DataFrame:
    """``bars`` with kind ('chord', 'unclear', 'no-chord-data'), root_pc, quality, intervals and symbol.

    The harmony decides, or the root track where the harmony is empty. Of several readings, the one whose root is the
    lowest note of the root track is taken if it is the only one; otherwise the bar is unclear. No shuffle.
    """
    harmony, root = (F.coalesce(F.col(c), F.array().cast("array<int>")) for c in ("harmony", "root"))
    source = F.when(F.size(harmony) > 0, harmony).otherwise(root)
    low = th.pitch_class(F.array_min(root)).cast("int")
    masks = dims.template_masks(bars.sparkSession)
    keyed = bars.withColumns({"_mask": th.mask(source), "_low": low, "_silent": F.size(source) == 0})
    found = keyed.join(F.broadcast(masks), F.col("_mask") == F.col("mask"), "left")
    agreeing = F.filter("readings", lambda r: r["root"] == F.col("_low"))
    chosen = F.when(F.size("readings") == 1, F.get("readings", F.lit(0))).when(F.size(agreeing) == 1, F.get(agreeing, F.lit(0)))
    out = found.withColumn("_chosen", chosen)
    kind = F.when(F.col("_silent"), "no-chord-data").when(F.col("_chosen").isNotNull(), "chord").otherwise("unclear")
    return out.select(*bars.columns, kind.alias("kind"), F.col("_chosen.root").alias("root_pc"), "_chosen.quality", "_chosen.intervals", "_chosen.symbol")


def field_of(keys: DataFrame) -> DataFrame:
    """Each row (key_root, is_minor and its own columns) with the seven chords of its key; a row without a key has none."""
    return keys.join(F.broadcast(harmonic_field(keys.sparkSession)), ["key_root", "is_minor"])  # 168 rows


def harmonic_field(spark: SparkSession) -> DataFrame:
    """The seven chords of each of the 24 keys, spelled by the key's sharp name."""
    crossed = dims.keys(spark).join(F.broadcast(dims.field_templates(spark)), "is_minor")  # 168 rows
    root = th.pitch_class(F.col("key_root") + F.col("above")).cast("int")
    key_name = th.note_name(F.col("key_root"))
    notes = th.transposed(F.col("chord_root"), F.col("intervals"))
    return crossed.withColumn("chord_root", root).select(
        "key_root",
        "is_minor",
        (F.col("degree") - 1).alias("field_index"),
        "degree",
        "numeral",
        "type_id",
        "function",
        "chord_root",
        "symbol",
        F.concat(th.note_name(F.col("chord_root"), key_name), "symbol").alias("chord_name"),
        notes.alias("notes"),
        F.transform(notes, lambda n: th.note_name(n, key_name)).alias("note_names"),
        "intervals",
        th.family(F.col("intervals")).alias("family"),
    )


def analyze_bars(matched: DataFrame, *, song: str = "song", bar: str = "bar", run: int = RUN) -> DataFrame:
    """Matched bars with key_root, is_minor and quarter_beats become steps: detected, carried, degree, label,
    step_intervals, beats, confidence. ``bar`` counts from 0; the output's ``number`` from 1.

    A bar without a chord carries the last chord's step forward with its own length, marked unsure. No task holds more than
    ``run`` bars of a song.
    """
    field = harmonic_field(matched.sparkSession).select(
        F.col("key_root").alias("_key"), F.col("is_minor").alias("_minor"), F.col("chord_root").alias("_root"), F.col("family").alias("_family"), F.col("field_index").alias("_degree"), F.col("numeral").alias("_numeral")
    )
    own = th.family(F.col("intervals"))
    joined = matched.join(F.broadcast(field), (F.col("key_root") == F.col("_key")) & (F.col("is_minor") == F.col("_minor")) & (F.col("root_pc") == F.col("_root")), "left")
    fits = F.col("_degree").isNotNull() & ((own == "NOTHIRD") | (own == F.col("_family")))
    spelled = th.note_name(F.col("root_pc"), th.preferred_root_name(F.col("key_root")))
    kind = "struct<degree:int,label:string,intervals:array<int>>"
    step = F.when(fits, F.struct(F.col("_degree").alias("degree"), F.col("_numeral").alias("label"), F.lit(None).cast("array<int>").alias("intervals")).cast(kind)).otherwise(
        F.struct(F.lit(None).cast("int").alias("degree"), F.concat(spelled, "symbol").alias("label"), th.key_relative(F.col("root_pc"), F.col("key_root"), F.col("intervals")).alias("intervals")).cast(kind)
    )
    stepped = joined.withColumn("_own", F.when(F.col("kind") == "chord", step))
    stepped = scanned(stepped, [song], [F.col(bar)], {"_before": Last(F.col("_own"), inclusive=False)}, run=run)
    carried = stepped.withColumn("_before", F.when(F.col("_own").isNull(), F.col("_before")))
    held = F.coalesce("_own", "_before")
    return carried.select(
        *matched.columns,
        (F.col(bar) + 1).alias("number"),
        F.when(F.col("kind") == "chord", F.concat(th.note_name(F.col("root_pc")), "quality")).alias("detected"),
        F.col("_before").isNotNull().alias("carried"),
        held["degree"].alias("degree"),
        F.coalesce(held["label"], F.lit(dims.UNKNOWN)).alias("label"),
        held["intervals"].alias("step_intervals"),
        th.clamp_beats(F.col("quarter_beats")).alias("beats"),
        F.when(F.col("_own").isNull(), "unsure").alias("confidence"),
    )


def summarise(analyzed: DataFrame, *by: str) -> DataFrame:
    """Counts of diatonic, chromatic, unclear and silent bars; each bar is in one of them."""
    return analyzed.groupBy(*by).agg(
        F.count_if(~F.col("carried") & F.col("degree").isNotNull()).alias("diatonic"),
        F.count_if(~F.col("carried") & (F.col("kind") == "chord") & F.col("degree").isNull()).alias("chromatic"),
        F.count_if(F.col("kind") == "unclear").alias("unclear"),
        F.count_if(F.col("kind") == "no-chord-data").alias("no_data"),
    )


def outcome_shares(matched: DataFrame) -> DataFrame:
    """How many bars came out how, and the rounded percentage; an empty input has no rows."""
    counts = matched.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("kind", "n", F.floor(100 * F.col("n") / F.col("total") + 0.5).cast("long").alias("percent"))


def assemble_sections(analyzed: DataFrame, *, song: str = "song", bar: str = "bar", size: int = dims.MAX_STEPS) -> DataFrame:
    """Fixed runs of ``size`` bars: (song, section from 1, label, steps in order)."""
    step = F.struct(F.col(bar).alias("bar"), "degree", "label", F.col("step_intervals").alias("intervals"), "beats", "confidence")
    return (
        analyzed.groupBy(song, (F.floor(F.col(bar) / size) + 1).cast("int").alias("section"))
        .agg(F.sort_array(F.collect_list(step)).alias("steps"))
        .select(song, "section", F.concat(F.lit("Parte "), F.col("section").cast("string")).alias("section_label"), "steps")
    )


def bar_class(analyzed: DataFrame) -> DataFrame:
    """Analysed bars with ``bar_class``: unclear, no-data, diatonic or chromatic."""
    kind = F.when(F.col("kind") == "unclear", "unclear").when(F.col("kind") == "no-chord-data", "no-data")
    return analyzed.withColumn("bar_class", F.coalesce(kind, F.when(F.col("degree").isNotNull(), "diatonic").otherwise("chromatic")))


def non_empty(pitches: DataFrame, tracks: list[str], *, by: list[str], first: int) -> DataFrame:
    """Of rows (by..., bar, track, pitches) those of the tracks that have pitches: their count, and the first ones by bar and track."""
    found = pitches.where(F.col("track").isin(tracks) & (F.size("pitches") > 0))
    order = Window.partitionBy(*by).orderBy("bar", "track")
    ranked = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= first)  # Spark cuts the rows before it shuffles them
    shown = ranked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_n", "bar", "track"))).alias("first"))
    counts = found.groupBy(*by).agg(F.count(F.lit(1)).alias("n_bars"))
    return counts.join(shown, by).withColumn("first", F.transform("first", lambda x: F.struct(x["bar"].alias("bar"), x["track"].alias("track"))))


def key_state(keys: DataFrame) -> DataFrame:
    """Rows (key_root, is_minor) as the state after a change of key: the new field, and nothing selected or highlighted."""
    field = harmonic_field(keys.sparkSession).groupBy(F.col("key_root").alias("_root"), F.col("is_minor").alias("_minor")).agg(F.sort_array(F.collect_list(F.struct("degree", "chord_name"))).alias("field"))
    joined = keys.join(F.broadcast(field), (F.col("key_root") == F.col("_root")) & (F.col("is_minor") == F.col("_minor")))  # 24 keys
    none = F.lit(None).cast("int")
    return joined.withColumns({"field": F.transform("field", lambda x: x["chord_name"]), "selected": none, "highlighted": F.array().cast("array<int>")}).drop("_root", "_minor")


def select_chord(states: DataFrame, index: Column) -> DataFrame:
    """Rows (key_root, is_minor) with the chord at ``index`` of the key's field selected: its notes, coloured by its
    function. A null index, or one that the field doesn't have, selects nothing."""
    colors = F.coalesce(*(F.when(F.col("function") == f, F.lit(c)) for f, c in dims.FUNCTION_COLORS.items()), F.lit("#fff"))
    field = harmonic_field(states.sparkSession).select(F.col("key_root").alias("_root"), F.col("is_minor").alias("_minor"), F.col("field_index").alias("selected"), F.col("notes").alias("highlighted"), colors.alias("color"))
    joined = states.withColumn("_index", index).join(F.broadcast(field), (F.col("key_root") == F.col("_root")) & (F.col("is_minor") == F.col("_minor")) & (F.col("_index") == F.col("selected")), "left")
    return joined.drop("_root", "_minor", "_index")
