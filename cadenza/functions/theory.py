"""Music theory as Column expressions: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza import dims


def literal(values: list) -> Column:
    return F.array(*(F.lit(v) for v in values))


def pitch_class(x: Column) -> Column:
    return F.pmod(x, F.lit(12))


def named(index: Column, names: list[str]) -> Column:
    return F.get(literal(names), pitch_class(index).cast("int"))


def note_name(index: Column, root_name: Column | None = None) -> Column:
    """Flats in flat keys, else sharps."""
    if root_name is None:
        return named(index, dims.SHARPS)
    return F.when(root_name.isin(dims.FLAT_KEYS), named(index, dims.FLATS)).otherwise(named(index, dims.SHARPS))


def preferred_root_name(index: Column) -> Column:
    flat = named(index, dims.FLATS)
    return F.when(flat.isin(dims.FLAT_KEYS), flat).otherwise(named(index, dims.SHARPS))


def tone_string(index: Column, octave: Column) -> Column:
    return F.concat(named(index, dims.SHARPS), octave.cast("int").cast("string"))


def midi_note_name(midi: Column) -> Column:
    """A negative number has no name, as the index isn't wrapped."""
    name = F.get(literal(dims.SHARPS), (midi % 12).cast("int"))
    return F.concat(name, (F.floor(midi / 12) - 1).cast("string"))


def note_index(name: Column) -> Column:
    """The index of a note's name, sharps before flats; -1 for other names."""
    sharp, flat = (F.array_position(literal(x), name) for x in (dims.SHARPS, dims.FLATS))
    return F.when(sharp > 0, sharp - 1).otherwise(flat - 1).cast("int")


def transposed(root: Column, intervals: Column) -> Column:
    return F.transform(intervals, lambda i: pitch_class(root + i).cast("int"))


def key_relative(root: Column, key: Column, intervals: Column) -> Column:
    return F.transform(intervals, lambda i: pitch_class(root - key + i).cast("int"))


def mask(pitches: Column) -> Column:
    """The pitch classes as a 12-bit mask. Null pitches don't count."""
    classes = F.filter(pitches, lambda p: p.isNotNull())
    return F.aggregate(classes, F.lit(0), lambda m, p: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), pitch_class(p).cast("int"))))


def family(intervals: Column) -> Column:
    has = lambda k: F.array_contains(F.transform(intervals, pitch_class), k)
    return F.when(has(4) & has(8), "AUG").when(has(3) & has(6), "DIM").when(has(4), "MAJ").when(has(3), "MIN").otherwise("NOTHIRD")


def half_steps(x: Column) -> Column:
    """Rounded to halves, ties upwards."""
    return F.floor(x * 2 + 0.5) / 2


def clamp_step_beats(beats: Column) -> Column:
    return F.when(F.isnan(beats), beats).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(8.0), half_steps(F.least(beats, F.lit(1e6))))))


def clamp_beats(beats: Column) -> Column:
    """As clamp_step_beats, but what isn't a finite number is 4."""
    finite = beats.isNotNull() & ~F.isnan(beats) & (F.abs(beats) < float("inf"))
    return F.when(finite, clamp_step_beats(beats)).otherwise(F.lit(4.0))


def step_eighths(beats: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.coalesce(beats, F.lit(4.0)) * 2 + 0.5)).cast("long")


def voiced(notes: Column, base: Column) -> Column:
    """(note, octave) of each note: the octave rises whenever a note isn't above the one before."""
    kind = "array<struct<note:int,octave:int>>"
    start = F.array().cast(kind)

    def add(done: Column, note: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = (note <= last["note"]).cast("int")
        octave = F.when(F.size(done) == 0, base.cast("int")).otherwise(last["octave"] + up)
        return F.concat(done, F.array(F.struct(note.cast("int").alias("note"), octave.cast("int").alias("octave"))).cast(kind))

    return F.aggregate(notes, start, add)


def step_labels(intervals: Column) -> Column:
    """Names of the steps between neighbours: ST, T, T+ST, or semitones and ``st``."""
    gaps = F.zip_with(F.slice(intervals, 2, F.greatest(F.size(intervals) - 1, F.lit(0))), F.slice(intervals, 1, F.greatest(F.size(intervals) - 1, F.lit(0))), lambda b, a: b - a)
    return F.transform(gaps, lambda d: F.when(d == 1, "ST").when(d == 2, "T").when(d == 3, "T+ST").otherwise(F.concat(d.cast("string"), F.lit("st"))))


def dots(signature: Column) -> Column:
    return F.when(signature == "4/4", 8).when(signature.isin("3/4", "6/8"), 6).when(signature == "2/4", 4)


def signature_beats(signature: Column) -> Column:
    """Quarter-note beats of ``n/d``; 4 if it can't be read."""
    parts = F.split(F.trim(F.coalesce(signature, F.lit("4/4"))), "/")
    n, d = (F.get(parts, k).try_cast("double") for k in (0, 1))
    return F.when(n.isNotNull() & d.isNotNull() & (d > 0), n * 4 / d).otherwise(F.lit(4.0))


def rgb(color: Column) -> Column:
    digits = F.regexp_replace(color, "#", "")
    return F.array(*(F.conv(F.substring(digits, k, 2), 16, 10).cast("int") for k in (1, 3, 5)))


def lighter(color: Column, amount: float) -> Column:
    """Mixed with white by ``amount``."""
    return F.transform(rgb(color), lambda c: F.least(F.lit(255.0), c + (255 - c) * F.lit(amount)))


def frequency(midi: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (midi - 69) / 12.0)


def slug(title: Column) -> Column:
    """A file name: letters, digits and white space only, the latter as ``_``."""
    return F.regexp_replace(F.regexp_replace(title, r"(?U)[^a-zA-Z0-9\s]", ""), r"(?U)\s+", "_")


def beats_label(beats: Column) -> Column:
    return F.concat(F.when(beats % 1 == 0, beats.cast("long").cast("string")).otherwise(F.format_string("%.1f", beats)), F.lit("t"))


def joined(values: Column, separator: str = ",") -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), separator)


def next_color(color: Column, palette: list[str]) -> Column:
    """The palette's colour after this one, around; the first after a colour that isn't in it."""
    at = F.coalesce(F.array_position(literal(palette), color), F.lit(0))
    return F.get(literal(palette), (at % len(palette)).cast("int"))


def beat_label(eighth: Column, labels: list[str]) -> Column:
    """The label of an eighth in its measure."""
    return F.get(literal(labels), F.pmod(eighth, F.lit(len(labels))).cast("int"))


def dot_title(dot: Column) -> Column:
    """The title of a dot of a bar: its beat, or the half after it."""
    beat = (F.floor(dot / 2) + 1).cast("string")
    return F.when(dot % 2 == 0, F.concat(F.lit("Tempo "), beat)).otherwise(F.concat(beat, F.lit("e")))


def chord_count_label(n: Column) -> Column:
    return F.when(n == 1, F.lit("1 acorde")).otherwise(F.concat(n.cast("string"), F.lit(" acordes")))


def key_label(root: Column, is_minor: Column) -> Column:
    return F.concat(note_name(root), F.lit(" "), F.when(is_minor, "menor").otherwise("maior"))


def interval_label(interval: Column, labels: list[str]) -> Column:
    """The short name of 0 to 11 semitones; null for others."""
    return F.get(literal(labels), interval.cast("int"))
