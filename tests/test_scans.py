"""Scans over keys of any size: equal to plain windows and to plain loops, wherever runs are cut; and what is built on them."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import harmony, playback, quiz, scans
from cadenza.operators.scans import Last, Streak, Sum, Total
from cadenza.plans import bindings as bind
from cadenza.plans import catalogue
from cadenza.streaming import sessions

SF_DIR = "/root/testdata/sf0.001"
WHOLE = 1 << 20


def table(n: int = 700) -> list[tuple]:
    """A key that holds over a third of the rows, one without a name, and small ones."""
    rng = random.Random(5)
    keys = ["hot"] * 3 + [None, "a", "b", "c", "d"]
    return [(rng.choice(keys), i // 2, i, rng.choice([None, 1, 2, 5]), rng.random() < 0.6, rng.random() < 0.05, rng.choice([None, None, f"v{i}"])) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(table(), "k string, at long, i long, n long, ok boolean, cut boolean, v string").repartition(5)


def every() -> dict:
    return {
        "last": Last(F.col("v")),
        "before": Last(F.col("v"), inclusive=False),
        "sum": Sum(F.col("n")),
        "sum_before": Sum(F.col("n"), inclusive=False),
        "since": Sum(F.col("n"), since=F.col("cut")),
        "total": Total(F.col("n")),
        ("streak", "best"): Streak(F.col("ok") & ~F.col("cut"), ~F.col("ok") & ~F.col("cut"), F.col("cut")),
    }


def brute(given: list[tuple]) -> list[tuple]:
    out = []
    for key in {r[0] for r in given}:
        mine = sorted((r for r in given if r[0] == key), key=lambda r: (r[1], r[2]))
        last, total, since, streak, best = None, 0, 0, 0, 0
        known = [r[3] for r in mine if r[3] is not None]
        for k, at, i, n, ok, cut, v in mine:
            before, was = last, total
            last, total = v or last, total + (n or 0)
            since = (0 if cut else since) + (n or 0)
            streak = 0 if cut or not ok else streak + 1
            best = 0 if cut else max(best, streak)
            out.append((k, i, last, before, total, was, since, sum(known) if known else None, streak, best))
    return sorted(out, key=lambda r: r[1])


@pytest.mark.parametrize("run", [WHOLE, 1, 3, 40])
def test_scans_equal_a_loop(rows, run):
    got = scans.scanned(rows, ["k"], [F.col("at"), F.col("i")], every(), run=run).collect()
    names = ("k", "i", "last", "before", "sum", "sum_before", "since", "total", "streak", "best")
    assert sorted((tuple(r[c] for c in names) for r in got), key=lambda r: r[1]) == brute(table())


def test_an_empty_table(spark, rows):
    none = rows.limit(0)
    assert scans.scanned(none, ["k"], [F.col("i")], every()).count() == 0
    assert scans.scanned(none, ["k"], [F.col("i")], every(), run=0).count() == 0


def test_no_task_holds_much_of_a_hot_key(spark):
    """Runs are short, and Spark deals them evenly: no task has twice its share."""
    hot = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 500).otherwise(-1).alias("k"), "id")
    laid = scans.runs(hot, ["k"], [F.col("id")], 100)
    assert laid.groupBy("k", "_run").count().agg(F.max("count")).first()[0] <= 100
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        windowed = laid.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k", "_run")))
        sizes = [r["rows"] for r in windowed.groupBy(F.spark_partition_id()).agg(F.sum("n"), F.count(F.lit(1)).alias("rows")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(sizes) == 4 and max(sizes) < 2 * 60_000 / 4


def test_runs_rise_in_the_order_of_the_key(rows):
    laid = scans.runs(rows, ["k"], [F.col("at"), F.col("i")], 7).select("k", "i", "_run").collect()
    for key in {r.k for r in laid}:
        mine = [r["_run"] for r in sorted(laid, key=lambda r: r.i) if r.k == key]
        assert mine == sorted(mine)


def collected(frame) -> list[str]:
    return sorted(map(str, frame.collect()))


def test_operators_give_the_same_however_runs_are_cut(spark):
    """A third of the bars, steps and actions are of one song or session."""
    bars = bind.bars(spark, SF_DIR).withColumn("song", F.when(F.col("bar") % 3 == 0, 0).otherwise(F.col("song"))).withColumn("bar", F.col("bar") * 1000 + F.col("key_root"))
    bars = harmony.match_bars(bars.dropDuplicates(["song", "bar"]))
    assert collected(harmony.analyze_bars(bars)) == collected(harmony.analyze_bars(bars, run=50))
    steps = bind.steps(spark, SF_DIR)
    assert collected(playback.offsets(steps)) == collected(playback.offsets(steps, run=3))
    actions = catalogue.quiz_actions(bind.table(spark, SF_DIR, "events")).withColumn("session", F.when(F.col("event_id") % 3 > 0, F.lit(1)).otherwise(F.col("session")))
    assert collected(quiz.scores(actions, order=["ts", "event_id"])) == collected(quiz.scores(actions, order=["ts", "event_id"], run=20))


# segments and moments


@pytest.mark.parametrize("run", [WHOLE, 9])
def test_segment_that_covers_a_moment(spark, run):
    """One user's segments lie end to end; a moment at an end belongs to the next one."""
    at, segments = 0, []
    rng = random.Random(8)
    for n in range(200):
        size = rng.choice([0, 1, 7, 10**12])
        if n % 9:  # else a gap
            segments.append(("u" if n % 3 else "w", at, at + size, f"s{n}"))
        at += size
    moments = [(k, x, n) for n, (k, x) in enumerate([(s[0], s[1] + d) for s in segments for d in (-1, 0, 1)] + [("nobody", 5), (None, 5), ("u", None), ("u", -10), ("w", at + 5)])]
    got = playback.covering(spark.createDataFrame(segments, "by string, start_us long, end_us long, label string"), spark.createDataFrame(moments, "by string, at_us long, n long"), by="by", run=run).collect()
    assert len(got) == len(moments)
    for r in got:
        inside = [s for s in segments if s[0] == r.by and r.at_us is not None and s[1] <= r.at_us < s[2]]
        assert (r.start_us, r.end_us, r.label) == (inside[0][1:] if inside else (None, None, None))


def greedy(times: list[int], gap: int) -> list[int]:
    out: list[int] = []
    for t in sorted(times):
        if not out or t - out[-1] >= gap:
            out.append(t)
    return out


@pytest.mark.parametrize("run", [WHOLE, 11])
def test_debounce_equals_the_greedy_chain_and_the_stream(spark, tmp_path, run):
    rng = random.Random(2)
    taps = [(1, rng.randint(0, 9000)) for _ in range(300)] + [(2, 100 * i) for i in range(70)] + [(3, 5), (3, 5), (4, 0), (4, 99), (4, 100)]
    frame = spark.createDataFrame(taps, "key long, at_us long")
    got = sorted(map(tuple, playback.debounced(frame.unionByName(spark.createDataFrame([(None, 3), (9, None)], frame.schema)), 100, run=run).collect()))
    assert got == sorted((k, t) for k in (1, 2, 3, 4) for t in greedy([x for y, x in taps if y == k], 100))
    if run == WHOLE:
        frame.coalesce(1).write.parquet(f"{tmp_path}/taps")
        stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/taps")
        assert sorted(map(tuple, sessions.drained(sessions.debounced(stream, 100), f"{tmp_path}/out").collect())) == got
    assert playback.debounced(frame.limit(0), 100).count() == 0


def test_keys_are_counted_only_where_their_hash_is_full(spark, monkeypatch):
    rows = spark.createDataFrame([(k, n) for k in (1, 2, None) for n in range(4)], "k int, n int")
    counted, whole = [], scans.longest
    monkeypatch.setattr(scans, "longest", lambda *a: counted.append(a) or whole(*a))
    assert not scans.longer(rows, ["k"], 1000) and not scans.longer(rows.limit(0), ["k"], 0) and not counted
    assert scans.longer(rows, ["k"], 3) and not scans.longer(rows, ["k"], 4)
    monkeypatch.setattr(scans, "HASHES", 1)
    assert scans.longer(rows, ["k"], 3) and not scans.longer(rows, ["k"], 4)
