"""Quiz: questions drawn by a portable hash, scores, streaks and answer states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza import dims
from cadenza.functions import theory as th
from cadenza.operators.harmony import harmonic_field
from cadenza.operators.scans import RUN, Last, Streak, Sum, scanned

PRIME = 2147483647


def drawn(seed: Column, salt: int, n: int) -> Column:
    """A number below n from a seed: linear congruential arithmetic that any SQL engine can repeat."""
    return (((F.pmod(seed, F.lit(1000003)) * 48271 + salt * 69621 + 11) % PRIME * 16807 % PRIME) % n).cast("int")


def shuffled(values: Column, seed: Column, salt: int) -> Column:
    """The values in the order of a hash of seed and place."""
    keyed = F.transform(values, lambda v, i: F.struct(((F.pmod(seed, F.lit(1000003)) * 48271 + (i + 1) * 40692 + salt * 69621) % PRIME * 16807 % PRIME).alias("k"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def optioned(rows: DataFrame, correct: Column, labels: Column) -> DataFrame:
    """Rows with correct, and options: the correct label and three others, in drawn order."""
    others = F.filter(labels, lambda x: x != correct)
    return rows.withColumn("correct", correct).withColumn("options", shuffled(F.concat(F.array(F.col("correct")), F.slice(shuffled(others, F.col("seed"), 3), 1, 3)), F.col("seed"), 4))


def interval_questions(seeds: DataFrame) -> DataFrame:
    names = [n for k, n in dims.INTERVAL_NAMES if k > 0]
    root, semitones = drawn(F.col("seed"), 1, 12), drawn(F.col("seed"), 2, 12) + 1
    rows = seeds.withColumns({"root": root, "tip_key": semitones}).withColumn("notes", F.array(F.col("root"), th.pitch_class(F.col("root") + F.col("tip_key")).cast("int")))
    labels = th.literal(names)
    return optioned(rows, F.get(labels, F.col("tip_key") - 1), labels).select(*seeds.columns, "notes", "correct", "options", F.col("tip_key").cast("string").alias("tip_key"))


def chord_type_questions(seeds: DataFrame) -> DataFrame:
    kinds = {t[0]: t for t in dims.CHORD_TYPES}
    ids = dims.QUIZ_CHORD_TYPES
    pick = drawn(F.col("seed"), 2, len(ids))
    labels = th.literal([kinds[i][1] for i in ids])
    intervals = F.array(*(th.literal(kinds[i][3]) for i in ids))
    rows = seeds.withColumns({"root": drawn(F.col("seed"), 1, 12), "pick": pick})
    rows = rows.withColumn("notes", th.transposed(F.col("root"), F.get(intervals, F.col("pick"))))
    return optioned(rows, F.get(labels, F.col("pick")), labels).select(*seeds.columns, "notes", "correct", "options", F.get(th.literal(ids), F.col("pick")).alias("tip_key"))


def degree_questions(seeds: DataFrame) -> DataFrame:
    """Seeds with key_root and is_minor; notes of the chord and of the tonic."""
    field = harmonic_field(seeds.sparkSession)
    per_key = field.groupBy(F.col("key_root").alias("_key"), F.col("is_minor").alias("_minor")).agg(F.sort_array(F.collect_list(F.struct("field_index", "numeral", "notes"))).alias("field"))  # 24 rows
    rows = seeds.join(F.broadcast(per_key), (F.col("key_root") == F.col("_key")) & (F.col("is_minor") == F.col("_minor"))).withColumn("pick", drawn(F.col("seed"), 2, 7))
    chosen = F.get("field", F.col("pick"))
    out = optioned(rows, chosen["numeral"], F.transform("field", lambda c: c["numeral"]))
    return out.select(*seeds.columns, chosen["notes"].alias("notes"), F.get("field", F.lit(0))["notes"].alias("reference"), "correct", "options", F.col("pick").cast("string").alias("tip_key"))


def chord_id_questions(seeds: DataFrame) -> DataFrame:
    """A root and type; distractors: another type on the root, the type on a nearby root, then drawn chords, without
    repeats."""
    kinds = {t[0]: t for t in dims.CHORD_TYPES}
    ids = dims.QUIZ_CHORD_IDS
    symbols, intervals = th.literal([kinds[i][2] for i in ids]), F.array(*(th.literal(kinds[i][3]) for i in ids))
    n = len(ids)
    rows = seeds.withColumns({"root": drawn(F.col("seed"), 1, 12), "pick": drawn(F.col("seed"), 2, n)})
    label = lambda root, kind: F.concat(th.preferred_root_name(root), F.get(symbols, kind))
    other = (F.col("pick") + 1 + drawn(F.col("seed"), 5, n - 1)) % n
    same_root = F.array(label(F.col("root"), other))
    nearby = F.array(*(label(F.col("root") + k, F.col("pick")) for k in (5, 7, 3, 4, 2)))
    filling = F.array(*(label(drawn(F.col("seed"), 10 + k, 12), drawn(F.col("seed"), 40 + k, n)) for k in range(12)))
    rows = rows.withColumn("correct", label(F.col("root"), F.col("pick")))
    first = F.array_except(F.array_distinct(same_root), F.array(F.col("correct")))
    two = F.concat(first, F.slice(F.array_except(nearby, F.concat(first, F.array(F.col("correct")))), F.lit(1), F.lit(2) - F.size(first)))
    rest = F.array_except(F.concat(F.array_distinct(filling), F.array_distinct(nearby)), F.concat(two, F.array(F.col("correct"))))
    three = F.slice(F.concat(two, rest), 1, 3)
    out = rows.withColumn("options", shuffled(F.concat(F.array(F.col("correct")), three), F.col("seed"), 4))
    return out.select(*seeds.columns, th.transposed(F.col("root"), F.get(intervals, F.col("pick"))).alias("notes"), "correct", "options", F.get(th.literal(ids), F.col("pick")).alias("tip_key"))


def diatonic_chord_questions(seeds: DataFrame) -> DataFrame:
    """Seeds with key_root and is_minor: a chord of the key against others of it."""
    types = dims.chord_types(seeds.sparkSession)
    first = types.groupBy("symbol").agg(F.min_by("type_id", "pos").alias("type_of"))
    field = harmonic_field(seeds.sparkSession).join(F.broadcast(first), "symbol", "left")
    per_key = field.groupBy(F.col("key_root").alias("_key"), F.col("is_minor").alias("_minor")).agg(
        F.sort_array(F.collect_list(F.struct("field_index", "chord_name", "notes", F.coalesce("type_of", F.lit("major")).alias("type_of")))).alias("field")
    )
    rows = seeds.join(F.broadcast(per_key), (F.col("key_root") == F.col("_key")) & (F.col("is_minor") == F.col("_minor"))).withColumn("pick", drawn(F.col("seed"), 2, 7))
    chosen = F.get("field", F.col("pick"))
    out = optioned(rows, chosen["chord_name"], F.transform("field", lambda c: c["chord_name"]))
    return out.select(*seeds.columns, chosen["notes"].alias("notes"), "correct", "options", chosen["type_of"].alias("tip_key"))


def scores(actions: DataFrame, *, session: str = "session", order: list[str], run: int = RUN) -> DataFrame:
    """Each counted answer with the running score after it: correct, total, streak, best_streak.

    Actions have ``action`` ('question', 'answer', 'changeMode', 'resetScore', 'toggleKeyLimited') and ``ok``. Only the
    first answer after a question counts; the last three actions start a new score, and all but resetScore take the
    question away. An answer whose ``ok`` is null is wrong. No task holds more than ``run`` actions of a session.
    """
    by, kind = [F.col(c) for c in order], F.col("action")
    state = F.when(kind == "question", "asked").when(kind == "answer", "answered").when(kind.isin("changeMode", "toggleKeyLimited"), "none")
    marked = scanned(actions, [session], by, {"_state": Last(state, inclusive=False)}, run=run)
    counts, resets = (kind == "answer") & (F.col("_state") == "asked"), kind.isin("changeMode", "resetScore", "toggleKeyLimited")
    marked = marked.withColumns({"_counts": F.coalesce(counts, F.lit(False)), "_reset": F.coalesce(resets, F.lit(False)), "_right": F.coalesce("ok", F.lit(False))})
    marked = marked.where("_counts or _reset")
    hit, miss, reset = F.col("_counts") & F.col("_right"), F.col("_counts") & ~F.col("_right"), F.col("_reset")
    sums = {"correct": Sum(hit.cast("long"), since=reset), "total": Sum(F.col("_counts").cast("long"), since=reset), ("streak", "best_streak"): Streak(hit, miss, reset)}
    return scanned(marked, [session], by, sums, run=run).where("_counts").select(*actions.columns, "correct", "total", "streak", "best_streak")


def percent(correct: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(100 * correct / total + 0.5)).otherwise(F.lit(0)).cast("long")


def band(percent_: Column) -> Column:
    return F.when(percent_ >= 70, "good").when(percent_ >= 40, "fair").otherwise("poor")


def option_states(questions: DataFrame, *, chosen: str = "chosen") -> DataFrame:
    """A row an option: right, wrong or other once an answer is chosen, open before."""
    each = questions.select("*", F.posexplode("options").alias("place", "option"))
    state = F.when(F.col(chosen).isNull(), "open").when(F.col("option") == F.col("correct"), "right").when(F.col("option") == F.col(chosen), "wrong").otherwise("other")
    return each.withColumn("state", state)


def questions(seeds: DataFrame, mode: Column, *, limit_to_key: Column) -> DataFrame:
    """A question of each row's mode (interval, chordType, degree or chordId); a chord to identify is one of the key's where
    ``limit_to_key`` holds."""
    asked = seeds.withColumns({"_mode": mode, "_limit": limit_to_key})
    kinds = {
        "interval": (F.col("_mode") == "interval", interval_questions),
        "chordType": (F.col("_mode") == "chordType", chord_type_questions),
        "degree": (F.col("_mode") == "degree", degree_questions),
        "chordId": ((F.col("_mode") == "chordId") & ~F.col("_limit"), chord_id_questions),
        "keyed": ((F.col("_mode") == "chordId") & F.col("_limit"), diatonic_chord_questions),
    }
    made = [make(asked.where(which)).select(*seeds.columns, F.col("_mode").alias("mode"), "notes", "correct", "options", "tip_key") for which, make in kinds.values()]
    return reduce(DataFrame.unionByName, made)


def with_tips(questions: DataFrame, tips: DataFrame) -> DataFrame:
    """Questions with the tip of their mode and key (mode, tip_key, tip); null where there is none."""
    return questions.join(tips, ["mode", "tip_key"], "left")
