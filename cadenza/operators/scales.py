"""Scales: notes, steps, comparison. Everything is array expressions on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza import dims
from cadenza.functions import theory as th


def scale_notes(roots: DataFrame, *, root: str = "root_note") -> DataFrame:
    """Each row with each scale: notes, names and the steps between them. 20 fixed scales a row."""
    scales = F.broadcast(dims.scales(roots.sparkSession))
    crossed = roots.join(scales)
    notes = th.transposed(F.col(root), F.col("intervals"))
    return crossed.withColumn("notes", notes).withColumns(
        {"names": F.transform("notes", lambda n: th.note_name(n, th.note_name(F.col(root)))), "steps": th.step_labels(F.col("intervals"))}
    )


def notes_of(roots: DataFrame, *, root: str = "root_note", scale: str = "scale_id") -> DataFrame:
    """The notes of each row's scale; an unknown scale has none."""
    found = roots.join(F.broadcast(dims.scales(roots.sparkSession).select(F.col("scale_id").alias("_id"), "intervals")), F.col(scale) == F.col("_id"), "left")
    empty = F.array().cast("array<int>")
    return found.withColumn("notes", F.coalesce(th.transposed(F.col(root), F.col("intervals")), empty)).drop("_id", "intervals")


def chord_notes(rows: DataFrame, *, root: str = "root_note", kind: str = "type_id") -> DataFrame:
    """The notes of each row's chord; an unknown type has none."""
    found = rows.join(F.broadcast(dims.chord_types(rows.sparkSession).select(F.col("type_id").alias("_id"), "intervals")), F.col(kind) == F.col("_id"), "left")
    empty = F.array().cast("array<int>")
    return found.withColumn("notes", F.coalesce(th.transposed(F.col(root), F.col("intervals")), empty)).drop("_id", "intervals")


def classified(a: Column, b: Column) -> tuple[Column, Column]:
    """The union in first-seen order, and 'a', 'b' or 'shared' for each note. With b null, a as it is, all 'a'."""
    union = F.when(b.isNull(), a).otherwise(F.array_union(a, b))
    kind = F.transform(union, lambda n: F.when(b.isNull(), "a").when(F.array_contains(a, n) & F.array_contains(b, n), "shared").when(F.array_contains(a, n), "a").otherwise("b"))
    return union, kind


def differing_degrees(a: Column, b: Column) -> Column:
    """Ordinals, from the second, of the positions at which two interval lists differ or one has ended."""
    longest = F.greatest(F.size(a), F.size(b))
    places = F.filter(F.sequence(F.lit(0), longest - 1), lambda i: (i >= 1) & ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.transform(places, lambda i: F.concat((i + 1).cast("string"), F.lit("o")))


def compare(pairs: DataFrame) -> DataFrame:
    """Rows with notes_a, notes_b, intervals_a, intervals_b get shared, only_a, only_b, union, kinds, degrees."""
    union, kinds = classified(F.col("notes_a"), F.col("notes_b"))
    return pairs.withColumns(
        {
            "shared": F.array_intersect("notes_a", "notes_b"),
            "only_a": F.array_except("notes_a", "notes_b"),
            "only_b": F.array_except("notes_b", "notes_a"),
            "union": union,
            "kinds": kinds,
            "degrees": differing_degrees(F.col("intervals_a"), F.col("intervals_b")),
        }
    )


def strip(root: Column, notes_a: Column, notes_b: Column) -> Column:
    """Twelve slots from the root: the note, and whether each scale has it."""

    def slot(i: Column) -> Column:
        note = th.pitch_class(root + i).cast("int")
        return F.struct(note.alias("note"), F.array_contains(notes_a, note).alias("in_a"), F.array_contains(notes_b, note).alias("in_b"))

    return F.transform(F.sequence(F.lit(0), F.lit(11)), slot)


def bass_positions(rows: DataFrame, *, notes: str = "notes") -> DataFrame:
    """For each row of distinct notes, one (string, fret) a note: the lowest fret at the voiced octave from 1, or else an
    octave above. Per string only the first fret with the note counts. Columns position, note, string_no, fret."""
    voiced = rows.withColumn("_voiced", th.voiced(F.col(notes), F.lit(1)))
    each = voiced.select(*rows.columns, F.posexplode("_voiced").alias("position", "_v"))
    # a note that comes again has the octave of its last place
    octave = F.element_at(F.filter(F.transform(th.voiced(F.col(notes), F.lit(1)), lambda v: F.struct(v["note"].alias("n"), v["octave"].alias("o"))), lambda v: v["n"] == F.col("_v.note")), -1)["o"]
    strings = F.array(*(F.struct(F.lit(k).alias("no"), F.lit(n).alias("open"), F.lit(o).alias("octave")) for k, (n, o) in enumerate(dims.BASS)))

    def place(s: Column) -> Column:
        fret = th.pitch_class(F.col("_v.note") - s["open"])
        high = F.floor((s["octave"] * 12 + s["open"] + fret) / 12)
        return F.struct((high - F.col("_octave")).alias("above"), fret.cast("int").alias("fret"), s["no"].alias("no"))

    found = each.withColumn("_octave", octave).withColumn("_best", F.array_min(F.filter(F.transform(strings, place), lambda p: p["above"].isin(0, 1))))
    return found.where("_best is not null").select(*rows.columns, "position", F.col("_v.note").alias("note"), F.col("_best.no").alias("string_no"), F.col("_best.fret").alias("fret"))


def neck(spark, highlighted: list[int] | None = None) -> DataFrame:
    """Every fret of every string: note, octave, whether an octave starts there, and whether it is highlighted."""
    strings = spark.createDataFrame([(k, n, o) for k, (n, o) in enumerate(dims.BASS)], "string_no int, open int, open_octave int")
    high = F.floor((F.col("open_octave") * 12 + F.col("open") + F.col("fret")) / 12)
    before = F.floor((F.col("open_octave") * 12 + F.col("open") + F.col("fret") - 1) / 12)
    frets = strings.withColumn("fret", F.explode(F.sequence(F.lit(0), F.lit(dims.FRETS))))
    note = th.pitch_class(F.col("open") + F.col("fret")).cast("int")
    return frets.select(
        "string_no",
        "fret",
        note.alias("note"),
        high.cast("int").alias("octave"),
        ((F.col("fret") > 0) & (high != before)).alias("octave_start"),
        F.array_contains(th.literal(highlighted or [-1]), note).alias("highlighted"),
    )


def piano(rows: DataFrame, *, notes: str = "notes", voicing: str | None = None, octaves: tuple[int, int] = (3, 4)) -> DataFrame:
    """Every key of the octaves for each row: octave, note, whether it is black, and whether it is highlighted: its note
    is in ``notes`` and, with a ``voicing`` that has the note, at the octave that the note has there last."""
    each = rows.withColumn("octave", F.explode(F.sequence(F.lit(octaves[0]), F.lit(octaves[1])))).withColumn("note", F.explode(F.sequence(F.lit(0), F.lit(11))))
    here = F.lit(True)
    if voicing is not None:
        last = F.get(F.reverse(F.filter(F.col(voicing), lambda v: v["note"] == F.col("note"))), 0)
        here = F.coalesce(last["octave"] == F.col("octave"), F.lit(True))
    return each.withColumns({"is_black": F.col("note").isin(1, 3, 6, 8, 10), "highlighted": F.array_contains(notes, F.col("note")) & here})


def shown_frets(frets: DataFrame, *, notes: Column, positions: Column, show_all: Column) -> DataFrame:
    """Frets (string_no, fret, note) with whether they are highlighted and shown: those in ``positions`` (text
    "string-fret") where that isn't null, or else those whose note is in ``notes``; all are shown where ``show_all`` holds."""
    here = F.concat(F.col("string_no").cast("string"), F.lit("-"), F.col("fret").cast("string"))
    lit = F.when(positions.isNotNull(), F.array_contains(positions, here)).otherwise(F.array_contains(notes, F.col("note")))
    return frets.withColumn("highlighted", lit).withColumn("shown", F.col("highlighted") | show_all)


def shortcuts(keys: DataFrame, pressed: Column) -> DataFrame:
    """Piano keys (octave, note) with the computer key that plays them, and whether it is among the ``pressed`` ones."""
    known = keys.sparkSession.createDataFrame([(n, o, k.upper(), k) for k, n, o in dims.KEY_MAP], "note int, octave int, shortcut string, _key string")
    joined = keys.join(F.broadcast(known), ["note", "octave"], "left")
    return joined.withColumn("is_pressed", F.coalesce(F.array_contains(pressed, F.col("_key")), F.lit(False))).drop("_key")


def default_scale(root: Column, is_minor: Column) -> Column:
    """The notes of the scale that a key is heard by: aeolian in minor, else major."""
    known = {i: iv for i, _, iv in dims.SCALES}
    return th.transposed(root, F.when(is_minor, th.literal(known["aeolian"])).otherwise(th.literal(known["major"])))
