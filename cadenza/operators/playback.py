"""Playback as data: onsets of steps on a grid of eighths, timelines, positions, and label segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import theory as th
from cadenza.operators.scans import RUN, Last, Sum, Total, scanned
from cadenza.sources.shared import written


def offsets(steps: DataFrame, *, song: str = "song", pos: str = "pos", run: int = RUN) -> DataFrame:
    """Steps with dur (eighths, at least 1), begin (eighths before) and total (of the song). No task holds more than ``run`` steps
    of a song."""
    dur = steps.withColumn("dur", th.step_eighths(F.col("beats")))
    return scanned(dur, [song], [F.col(pos)], {"begin": Sum(F.col("dur"), inclusive=False), "total": Total(F.col("dur"))}, run=run)


def placed(steps: DataFrame, *, song: str, pos: str) -> DataFrame:
    """(song, index, begin, dur, total, offset) of steps, null offsets as 0."""
    return offsets(steps, song=song, pos=pos).select(song, F.col(pos).cast("long").alias("index"), "begin", "dur", "total", F.coalesce("offset_eighths", F.lit(0)).alias("offset"))


def told(rows: DataFrame, song: str, line: Column, now: Column, soon: Column) -> DataFrame:
    """The events of steps at eighths (the columns of ``placed``, tick, sub and eighth): the cell of the timeline where ``line``
    holds, the step where ``now`` holds, and the step an eighth early where ``soon`` holds. A step of no song (null) isn't heard."""
    heard, sub, offset = F.col(song).isNotNull(), F.col("sub"), F.col("offset")
    now, soon = heard & now & ((offset >= 0) | (F.col("eighth") <= 0)), heard & soon & (offset < 0) & (offset >= -1)
    each = rows.withColumn("_kind", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    kind = F.col("_kind")
    each = each.where(((kind == 0) & line) | ((kind == 1) & now) | ((kind == 2) & soon))
    value = F.when(kind == 0, F.pmod("eighth", "total")).otherwise(F.col("index"))
    at = F.when(kind == 0, sub).when(kind == 1, sub + F.greatest(offset, F.lit(0))).otherwise(sub + 1 + offset)
    return each.select(song, "tick", "eighth", F.when(kind == 0, "timeline").otherwise("step").alias("type"), value.cast("long").alias("value"), at.cast("double").alias("at"))


def events(steps: DataFrame, ticks: DataFrame, *, song: str = "song", pos: str = "pos") -> DataFrame:
    """Events of each song at each tick (tick: the global eighth at which it comes; each covers two eighths).

    Columns song, tick, eighth, type ('timeline' or 'step'), value (cycle position or step index) and at, in eighths
    from the tick. ``ticks`` is one list for all songs, or has the song's column and is each song's own; it may be a stream.
    A step comes at its onset, or later by a positive offset; an offset of -1 brings it an eighth early, and any negative
    one at its onset only in the first eighths.

    One list is bounded and goes to all steps, of which each gives the events in its own eighths, so that after the onsets nothing
    is shuffled. Where it is a stream, the onsets are written once and each batch only reads them. Lists of songs are joined by
    cycle position; for those of ``cycle_ticks``, ``cycle_events`` does without.
    """
    own = song in ticks.columns
    onsets = placed(steps, song=song, pos=pos)
    cells = ticks.withColumn("sub", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("eighth", F.col("tick") + F.col("sub"))
    cycle, after, begin = F.pmod("eighth", "total"), F.pmod(F.col("eighth") + 1, F.col("total")), F.col("begin")
    if not own:
        inside, soon = (cycle >= begin) & (cycle < begin + F.col("dur")), (after == begin) & (F.col("offset") < 0)
        each = written(onsets, "onsets").join(cells, inside | soon) if ticks.isStreaming else onsets.join(F.broadcast(cells), inside | soon)
        return told(each, song, inside, cycle == begin, after == begin)
    grid = onsets.groupBy(song).agg(F.first("total").alias("total")).join(cells, song)
    line = grid.select(song, "tick", "eighth", F.lit("timeline").alias("type"), cycle.cast("long").alias("value"), F.col("sub").cast("double").alias("at"))
    found = [line]
    for at, now in ((cycle, True), (after, False)):
        steps_at = grid.withColumn("begin", at).join(onsets.drop("total"), [song, "begin"])
        found.append(told(steps_at, song, F.lit(False), F.lit(now), F.lit(not now)))
    return found[0].unionAll(found[1]).unionAll(found[2])


def cycle_events(steps: DataFrame, *, song: str = "song", pos: str = "pos") -> DataFrame:
    """The events of ``events`` at ``cycle_ticks``, of which each step gives those in its own eighths: no ticks are joined, and
    nothing is shuffled after the onsets."""
    total, begin = F.col("total"), F.col("begin")
    first, last = F.lit(-2).cast("long"), total - 1 + total % 2  # a tick covers two eighths
    until = begin + F.col("dur") - 1
    # the rounds in which an eighth of the step, or the one before it, is in the cycle
    rounds = F.sequence(-F.floor((until - first) / total), F.floor((last - begin + 1) / total))
    shift = F.col("_round") * total
    each = placed(steps, song=song, pos=pos).withColumn("_round", F.explode(rounds))
    each = each.withColumn("eighth", F.explode(F.sequence(F.greatest(first, begin + shift - 1), F.least(last, until + shift))))
    each = each.withColumn("sub", F.pmod("eighth", F.lit(2))).withColumn("tick", F.col("eighth") - F.col("sub"))
    since = F.col("eighth") - begin - shift
    return told(each, song, since >= 0, since == 0, since == -1)


def cycle_ticks(steps: DataFrame, *, song: str = "song") -> DataFrame:
    """(song, tick): each song's ticks from two eighths before the start over one whole cycle."""
    length = steps.groupBy(song).agg(F.sum(th.step_eighths(F.col("beats"))).cast("long").alias("total"))
    return length.select(song, F.explode(F.sequence(F.lit(-2).cast("long"), F.col("total") - 1, F.lit(2).cast("long"))).alias("tick"))


def at_position(steps: DataFrame, positions: DataFrame, *, song: str = "song", pos: str = "pos") -> DataFrame:
    """The step at each (song, position): begin <= position < begin + dur. A position outside is the first step, at 0.

    Each step is dealt to its eighths, so that the range join is an equi-join.
    """
    placed = offsets(steps, song=song, pos=pos)
    each = placed.select(F.col(song).alias("_song"), F.col(pos).alias("index"), "begin", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("dur") - 1)).alias("_at"))
    found = positions.join(each, (F.col(song) == F.col("_song")) & (F.floor("position") == F.col("_at")), "left")
    return found.select(*positions.columns, F.coalesce("index", F.lit(0)).cast("long").alias("index"), F.coalesce("begin", F.lit(0)).cast("long").alias("begin"))


def timeline(steps: DataFrame, *, song: str = "song", pos: str = "pos") -> DataFrame:
    """A cell for each eighth of each step: downbeat, measure start and chord start. Lengths aren't rounded."""
    eighths = F.coalesce("beats", F.lit(4.0)) * 2
    offset = F.coalesce("offset_eighths", F.lit(0))
    cells = steps.where(eighths > 0).withColumn("e", F.explode(F.sequence(F.lit(0), F.ceil(eighths).cast("int") - 1)))
    start = F.when(offset > 0, offset.cast("double")).when(offset < 0, eighths + offset).otherwise(F.lit(0.0))
    return cells.select(song, pos, "label", "e", (F.col("e") % 2 == 0).alias("is_downbeat"), (F.col("e") % 8 == 0).alias("is_measure_start"), (F.col("e") == start).alias("is_chord_start"))


def ticks(count: int, spark) -> DataFrame:
    """The batch twin of the metronome: tick n comes at eighth 2n, beat n % 4."""
    return spark.range(count).select(F.col("id").alias("n"), (F.col("id") * 2).alias("tick"), (F.col("id") % 4).cast("int").alias("beat"))


def practice_bpm(bpm: Column, percent: Column) -> Column:
    """The tempo at a practice speed, which is clamped to 50..150 and snapped to fives."""
    speed = F.greatest(F.lit(50), F.least(F.lit(150), F.floor(percent / 5 + 0.5) * 5))
    return F.floor(bpm * speed / 100 + 0.5).cast("long")


def metronome_bpm(bpm: Column, step: int) -> Column:
    return F.greatest(F.lit(40), F.least(F.lit(200), bpm + step))


def coverage(segments: DataFrame, *, by: str) -> DataFrame:
    """Label durations of each ``by`` (start and end as whole microseconds), and their share of all time."""
    per = segments.groupBy(by, "label").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("duration_us"), F.count(F.lit(1)).alias("n"))
    total = per.groupBy(by).agg(F.sum("duration_us").alias("total_us"))
    return per.join(total, by).select(by, "label", "n", "duration_us", F.when(F.col("total_us") > 0, F.floor(F.lit(10000) * F.col("duration_us") / F.col("total_us") + 0.5)).otherwise(F.lit(0)).cast("long").alias("share_bp"))


def segment_lines(segments: DataFrame) -> DataFrame:
    """Segments as tab-separated lines with three decimals."""
    return segments.select(F.format_string("%.3f\t%.3f\t%s", F.col("start_us") / 1e6, F.col("end_us") / 1e6, F.col("label")).alias("value"))


def active_step(steps: DataFrame, positions: DataFrame, *, song: str = "song", pos: str = "pos") -> DataFrame:
    """The step that sounds at each (song, eighth): lengths aren't rounded, a position before the start or beyond the end
    has none (-1). Steps are dealt to the whole eighths in them, so that the range join is an equi-join."""
    order = Window.partitionBy(song).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    long = F.coalesce("beats", F.lit(4.0)) * 2
    placed = steps.withColumn("_long", long).withColumn("_from", F.coalesce(F.sum("_long").over(order), F.lit(0.0))).where(F.ceil(F.col("_from") + F.col("_long")) > F.ceil("_from"))
    each = placed.select(F.col(song).alias("_song"), F.col(pos).alias("_pos"), F.explode(F.sequence(F.ceil("_from"), F.ceil(F.col("_from") + F.col("_long")) - 1)).alias("_at"))
    found = positions.join(each, (F.col(song) == F.col("_song")) & (F.col("eighth") == F.col("_at")), "left")
    return found.select(*positions.columns, F.coalesce("_pos", F.lit(-1)).cast("int").alias("active"))


def durations(segments: DataFrame) -> DataFrame:
    """Each label's whole time, the longest first; equal ones by label."""
    return segments.groupBy("label").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("duration_us")).orderBy(F.desc("duration_us"), "label")


def covering(segments: DataFrame, moments: DataFrame, *, by: str, at: str = "at_us", run: int = RUN) -> DataFrame:
    """``moments`` with the label, start_us and end_us of the segment of their ``by`` that covers them: start <= moment < end.

    One sorted pass over segments and moments together: the last segment that began is carried to a moment, across ranges too,
    so that a segment's length costs nothing. Segments of one ``by`` may touch but not overlap; of several that begin at once the
    longest counts, and segments without length cover nothing. A moment in no segment, or with a null ``by`` or time, has nulls.
    """
    found = F.struct("start_us", "end_us", "label").alias("_segment")
    told = F.struct(*(F.col(c) for c in moments.columns))
    known = segments.where("start_us < end_us").select(F.col(by).alias("_by"), F.col("start_us").alias("_x"), F.lit(0).alias("_kind"), F.col("end_us").alias("_tie"), found)
    asked = moments.select(F.col(by).alias("_by"), F.col(at).alias("_x"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_tie"), told.alias("_moment"))
    both = known.unionByName(asked, allowMissingColumns=True)
    last = scanned(both, ["_by"], [F.col("_x"), F.col("_kind"), F.col("_tie")], {"_last": Last(F.col("_segment"))}, run=run).where("_kind = 1")
    inside = F.col("_by").isNotNull() & (F.col("_x") < F.col("_last.end_us"))
    return last.select("_moment.*", *(F.when(inside, F.col(f"_last.{c}")).alias(c) for c in ("label", "start_us", "end_us")))


def debounced(taps: DataFrame, gap_us: int, *, by: str = "key", at: str = "at_us", run: int = RUN) -> DataFrame:
    """(by, at) of the taps that come at least ``gap_us`` after the last one that was accepted; the first one is.

    The batch twin of the stream. A tap's successor is the first tap that would be accepted after it, found in one sorted pass
    over taps and their earliest next times. Then pointers are doubled: in each round the taps known to be accepted hand this
    on over 1, 2, 4, ... successors, so that a chain of n taps takes a logarithmic number of joins, whatever its key's size.
    Taps at the same time are one; those without a time or key aren't any. An empty table gives no rows.
    """
    nodes = taps.select(F.col(by).alias("k"), F.col(at).cast("long").alias("t")).where("k is not null and t is not null").distinct()
    line = nodes.select("k", F.col("t").alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("of")).unionByName(nodes.select("k", (F.col("t") + gap_us).alias("x"), F.lit(0).alias("kind"), F.col("t").alias("of")))
    # from late to early, a tap before the time that asks for it
    late = scanned(line, ["k"], [F.desc("x"), F.desc("kind")], {"next": Last(F.when(F.col("kind") == 1, F.col("x")))}, run=run)
    jump = written(late.where("kind = 0 and next is not null").select("k", F.col("of").alias("t"), "next"), "jump")
    known = written(nodes.groupBy("k").agg(F.min("t").alias("t")), "accepted")
    while not (more := written(known.join(jump, ["k", "t"]).select("k", F.col("next").alias("t")), "accepted")).isEmpty():
        known = written(known.unionByName(more), "accepted")
        beyond = jump.select("k", F.col("t").alias("next"), F.col("next").alias("then"))
        jump = written(jump.join(beyond, ["k", "next"]).select("k", "t", F.col("then").alias("next")), "jump")
    return known.select(F.col("k").alias(by), F.col("t").alias(at))
