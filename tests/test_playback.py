"""Playback, quiz, streams, score files and other sources, on literal cases."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from cadenza.operators import playback, quiz
from cadenza.sources import gp, tables
from cadenza.streaming import sessions

STEPS = "song int, pos int, label string, beats double, offset_eighths int"


def events(spark, steps, ticks):
    rows = [(1, n, str(n), beats, offset) for n, (beats, offset) in enumerate(steps)]
    made = playback.events(spark.createDataFrame(rows, STEPS), spark.createDataFrame([(t,) for t in ticks], "tick long"))
    return sorted((r["tick"], r["type"], r["value"], r["at"]) for r in made.collect() if r["type"] == "step")


def test_a_step_comes_at_its_onset(spark):
    assert events(spark, [(2.0, None), (1.0, None)], [0]) == [(0, "step", 0, 0.0)]
    assert events(spark, [(2.0, None), (1.0, None)], [0, 2, 4, 6]) == [(0, "step", 0, 0.0), (4, "step", 1, 0.0), (6, "step", 0, 0.0)]


def test_a_step_may_come_early_or_late(spark):
    assert (0, "step", 1, 1.0) in events(spark, [(1.0, None), (1.0, -1)], [0])
    assert events(spark, [(1.0, 1), (1.0, None)], [0]) == [(0, "step", 0, 1.0)]
    assert events(spark, [(1.0, -3), (1.0, None)], [4]) == []  # further ahead than one eighth is lost
    assert events(spark, [(1.0, -3), (1.0, None)], [0]) == [(0, "step", 0, 0.0)]


def loop(steps, tick):
    """The same rules, one eighth after another."""
    durations = [max(1, int(b * 2 + 0.5)) for b, _ in steps]
    begins, total, out = [sum(durations[:k]) for k in range(len(steps))], sum(durations), []
    for sub in (0, 1):
        g = tick + sub
        for k, (_, offset) in enumerate(steps):
            if begins[k] == g % total and (offset >= 0 or g <= 0):
                out.append((tick, "step", k, float(sub + max(offset, 0))))
            if begins[k] == (g + 1) % total and offset == -1:
                out.append((tick, "step", k, float(sub + 1 + offset)))
    return out


def test_events_equal_a_plain_loop(spark):
    steps = [(0.5 + 0.5 * (k * 7 % 5), k * 3 % 5 - 2) for k in range(9)]
    ticks = range(-2, 40, 2)
    assert events(spark, steps, ticks) == sorted(x for t in ticks for x in loop(steps, t))


def test_each_song_plays_its_whole_cycle(spark):
    long = [(1, n, str(n), 2.0, None) for n in range(40)]  # 160 eighths
    steps = spark.createDataFrame([*long, (2, 0, "a", 1.5, None), (2, 1, "b", 1.0, 0)], STEPS)
    got = playback.events(steps, playback.cycle_ticks(steps)).collect()
    ticks = {s: sorted({r["tick"] for r in got if r["song"] == s}) for s in (1, 2)}
    assert ticks == {1: list(range(-2, 160, 2)), 2: [-2, 0, 2, 4]}
    assert {r["value"] for r in got if r["song"] == 1 and r["type"] == "step"} == set(range(40))
    assert sorted((r["tick"], r["value"], r["at"]) for r in got if r["song"] == 2 and r["type"] == "step") == sorted((t, v, a) for t in ticks[2] for t, _, v, a in loop([(1.5, 0), (1.0, 0)], t))


def random_songs(spark):
    rng = random.Random(5)
    rows = [(song, n, str(n), rng.choice([None, 0.1, 0.5, 1.0, 1.5, 4.0]), rng.choice([None, -3, -1, -1, 0, 2])) for song in range(60) for n in range(rng.choice([1, 1, 2, 5]))]
    return spark.createDataFrame([*rows, (None, 0, "0", 1.0, -1)], STEPS)


def test_a_whole_cycle_takes_no_join(spark):
    steps = random_songs(spark)
    made = playback.cycle_events(steps)
    songs = playback.events(steps, playback.cycle_ticks(steps))
    assert made.where("song is not null").count() > 500
    assert sorted(map(str, made.where("song is not null").collect())) == sorted(map(str, songs.collect()))
    assert {(r["type"], r["tick"]) for r in made.where("song is null").collect()} == {("timeline", -2), ("timeline", 0)}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_a_list_of_ticks_takes_no_shuffle_after_the_onsets(spark):
    steps, ticks = random_songs(spark), spark.range(9).select((F.col("id") * 2 - 2).alias("tick"))
    made = playback.events(steps, ticks)
    songs = playback.events(steps, steps.select("song").distinct().join(ticks))
    assert sorted(map(str, made.where("song is not null").collect())) == sorted(map(str, songs.collect()))
    assert {r["type"] for r in made.where("song is null").collect()} == {"timeline"}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "SortMergeJoin" not in plan


def test_batches_of_ticks_dont_place_steps_anew(spark, tmp_path):
    steps, ticks = random_songs(spark), spark.range(9).select((F.col("id") * 2 - 2).alias("tick"))
    ticks.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("tick long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = sessions.playback(steps, stream)
    assert "Window" not in made._jdf.queryExecution().analyzed().toString()
    got = sessions.drained(made, f"file://{tmp_path}/out")
    assert sorted(map(str, got.collect())) == sorted(map(str, playback.events(steps, ticks).collect()))


def test_positions(spark):
    steps = spark.createDataFrame([(1, 0, "a", 2.0, None), (1, 1, "b", None, None)], STEPS)
    at = spark.createDataFrame([(1, p) for p in (0, 3, 4, 11, 12)], "song int, position int")
    got = playback.at_position(steps, at).orderBy("position").collect()
    assert [(r["index"], r["begin"]) for r in got] == [(0, 0), (0, 0), (1, 4), (1, 4), (0, 0)]


def test_tempo_and_segments(spark):
    one = spark.range(1)
    got = one.select(playback.practice_bpm(F.lit(100), F.lit(73)), playback.practice_bpm(F.lit(100), F.lit(10)), playback.metronome_bpm(F.lit(198), 5), playback.metronome_bpm(F.lit(41), -5)).first()
    assert tuple(got) == (75, 50, 200, 40)
    segments = spark.createDataFrame([("u", 0, 750, "a"), ("u", 750, 1000, "b"), ("v", 5, 5, "c")], "user string, start_us long, end_us long, label string")
    assert {(r["user"], r["label"]): r["share_bp"] for r in playback.coverage(segments, by="user").collect()} == {("u", "a"): 7500, ("u", "b"): 2500, ("v", "c"): 0}


ACTIONS = "session long, ts long, event_id long, action string, ok boolean"


def played(actions):
    return [(1, n, n, a, ok) for n, (a, ok) in enumerate(actions)]


GAME = played(
    [("answer", True), ("question", None), ("answer", True), ("answer", False), ("question", None), ("answer", True), ("question", None), ("answer", False), ("question", None), ("answer", True)]
    + [("resetScore", None), ("answer", True), ("question", None), ("answer", True), ("changeMode", None), ("answer", True), ("question", None), ("answer", False), ("toggleKeyLimited", None), ("answer", True)]
)
SCORED = [(2, 1, 1, 1, 1), (5, 2, 2, 2, 2), (7, 2, 3, 0, 2), (9, 3, 4, 1, 2), (13, 1, 1, 1, 1), (17, 0, 1, 0, 0)]


def test_only_the_first_answer_counts(spark):
    got = quiz.scores(spark.createDataFrame(GAME, ACTIONS), order=["ts", "event_id"]).orderBy("event_id").collect()
    assert [(r["event_id"], r["correct"], r["total"], r["streak"], r["best_streak"]) for r in got] == SCORED
    one = spark.range(1)
    assert tuple(one.select(quiz.percent(F.lit(2), F.lit(3)), quiz.percent(F.lit(0), F.lit(0)), *(quiz.band(F.lit(p)) for p in (70, 69, 40, 39))).first()) == (67, 0, "good", "fair", "fair", "poor")


def test_the_stream_scores_alike(spark, tmp_path):
    for k in range(0, len(GAME), 7):  # three files, one a micro-batch
        spark.createDataFrame(GAME[k : k + 7], ACTIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ACTIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sessions.drained(sessions.quiz_scores(stream), f"file://{tmp_path}/out").orderBy("event_id").collect()
    assert [(r["event_id"], r["correct"], r["total"], r["streak"], r["best_streak"]) for r in got] == SCORED


def test_taps_count_from_the_last_that_was_accepted(spark, tmp_path):
    spark.createDataFrame([(1, t) for t in (0, 60, 99, 120, 180, 219, 220)], "key long, at_us long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, at_us long").parquet(str(tmp_path / "in"))
    assert sorted(r["at_us"] for r in sessions.drained(sessions.debounced(stream, 100), f"file://{tmp_path}/out").collect()) == [0, 120, 220]


def test_held_keys_dont_repeat(spark, tmp_path):
    rows = [(1, 1, "a", True), (1, 2, "a", True), (1, 3, "b", True), (1, 4, "a", False), (1, 5, "a", True), (2, 1, "a", True)]
    spark.createDataFrame(rows, "player long, at_us long, note string, down boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("player long, at_us long, note string, down boolean").parquet(str(tmp_path / "in"))
    got = sessions.drained(sessions.pressed(stream), f"file://{tmp_path}/out").collect()
    assert sorted((r["player"], r["at_us"], r["note"]) for r in got) == [(1, 1, "a"), (1, 3, "b"), (1, 5, "a"), (2, 1, "a")]


def test_ticks(spark):
    assert [tuple(r) for r in playback.ticks(5, spark).collect()] == [(0, 0, 0), (1, 2, 1), (2, 4, 2), (3, 6, 3), (4, 8, 0)]
    assert sessions.tick_source(spark, 120).isStreaming


@pytest.mark.parametrize("make", [quiz.interval_questions, quiz.chord_type_questions, quiz.degree_questions, quiz.chord_id_questions, quiz.diatonic_chord_questions])
def test_questions_have_four_distinct_options_with_the_right_one(spark, make):
    seeds = spark.range(300).select(F.col("id").alias("seed"), (F.col("id") % 12).cast("int").alias("key_root"), (F.col("id") % 2 == 1).alias("is_minor"))
    rows = make(seeds).collect()
    assert len(rows) == 300
    assert all(len(set(r["options"])) == len(r["options"]) == 4 and r["correct"] in r["options"] for r in rows)
    assert len({r["options"].index(r["correct"]) for r in rows}) == 4
    assert rows == make(seeds).collect()  # the same seed, the same question


def test_option_states(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"], "b", "c"), (2, ["a"], "a", None)], "id int, options array<string>, correct string, chosen string")
    got = quiz.option_states(rows).orderBy("id", "place").collect()
    assert [r["state"] for r in got] == ["other", "right", "wrong", "open"]


# score files


def note(i, midi):
    return f'<Note id="{i}"><Properties><Property name="Fret"><Fret>3</Fret></Property><Property name="Midi"><Number>{midi}</Number></Property></Properties></Note>'


SCORE = f"""<?xml version="1.0" encoding="utf-8"?><GPIF><GPVersion>7</GPVersion><Score><Title> 1984 </Title><Artist></Artist></Score>
<Tracks><Track id="0"><Name>Guitar</Name></Track><Track id="1"><Name>Guitar</Name></Track><Track id="2"><Name>Bass</Name></Track></Tracks>
<MasterBars><MasterBar><Time>3/4</Time><Bars>0 1 2</Bars></MasterBar><MasterBar><Time>x/y</Time><Bars>3 4 5</Bars></MasterBar><MasterBar><Bars>0 6 9</Bars></MasterBar></MasterBars>
<Bars><Bar id="0"><Voices>0 -1 -1 -1</Voices></Bar><Bar id="1"><Voices>1 -1 -1 -1</Voices></Bar><Bar id="2"><Voices>2 -1 -1 -1</Voices></Bar>
<Bar id="3"><Voices>-1</Voices></Bar><Bar id="4"><Voices>-1 -1 -1 -1</Voices></Bar><Bar id="5"><Voices>7</Voices></Bar><Bar id="6"><Voices>1</Voices></Bar></Bars>
<Voices><Voice id="0"><Beats>0</Beats></Voice><Voice id="1"><Beats>1 1 2</Beats></Voice><Voice id="2"><Beats>2</Beats></Voice></Voices>
<Beats><Beat id="0"><Notes>9</Notes></Beat><Beat id="1"><Notes>0 1 2</Notes></Beat><Beat id="2"><Notes>3</Notes></Beat><Beat id="3"></Beat></Beats>
<Notes>{note(0, 67)}{note(1, 60)}{note(2, 64)}{note(3, 36)}{note(9, 50)}</Notes></GPIF>"""


def zipped(name, data):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr(name, data)
    return buffer.getvalue()


FILES = {
    "good": zipped(gp.ENTRY, SCORE),
    "gpx": b"BCFZ" + b"\0" * 80,
    "legacy": b"\x18FICHIER GUITAR PRO v5.00" + b"\0" * 80,
    "text": b"hello",
    "broken": b"PK\x03\x04broken",
    "other": zipped("readme.txt", "x"),
    "bad xml": zipped(gp.ENTRY, "<GPIF><Score>"),
}


@pytest.fixture(scope="module")
def scores(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("scores")
    for name, data in FILES.items():
        (folder / f"{name.replace(' ', '_')}.gp").write_bytes(data)
    files = gp.read_files(spark, str(folder)).withColumn("path", F.regexp_extract("path", r"([^/]+)\.gp$", 1))
    return gp.parsed(files).cache()


def test_what_files_are(scores):
    assert {r["path"]: r["error"] for r in scores.collect()} == {"good": None, "gpx": "gpx-container", "legacy": "legacy-binary", "text": "not-a-zip", "broken": "corrupt", "other": "not-a-gp-file", "bad_xml": "corrupt"}
    assert scores.where("(error is null) <> (message is null)").count() == 0
    empty = scores.sparkSession.createDataFrame([("empty", b"")], "path string, content binary")
    assert gp.parsed(empty).first()["error"] == "not-a-zip"


def test_score_metadata_and_bars(scores):
    (m,) = gp.metadata(scores).collect()
    assert (m["version"], m["title"], m["artist"], m["tracks"], m["n_bars"], m["has_chords"]) == ("7", "1984", "", ["Guitar", "Guitar", "Bass"], 3, False)
    assert [(r["bar"], r["time_signature"], r["quarter_beats"]) for r in gp.master_bars(scores).orderBy("bar").collect()] == [(0, "3/4", 3.0), (1, "x/y", 4.0), (2, "4/4", 4.0)]


def test_pitches_of_every_bar_and_track(scores):
    got = {(r["bar"], r["track_index"]): r["pitches"] for r in gp.bar_pitches(scores).collect()}
    assert got == {(0, 0): [50], (0, 1): [36, 60, 64, 67], (0, 2): [36], (1, 0): [], (1, 1): [], (1, 2): [], (2, 0): [50], (2, 1): [36, 60, 64, 67], (2, 2): []}


def test_of_tracks_with_one_name_the_last_counts(scores):
    rows = gp.bars_for(scores, "Guitar", "Tuba").orderBy("bar").collect()
    assert [(r["harmony"], r["root"]) for r in rows] == [([36, 60, 64, 67], []), ([], []), ([36, 60, 64, 67], [])]


def test_no_nodes_of_scores_go_through_the_driver(spark, scores, tmp_path):
    scores.write.parquet(str(tmp_path / "scores"))  # a small file, whatever it explodes to
    read = spark.read.schema(scores.schema).parquet(str(tmp_path / "scores"))
    made = gp.bars_for(read, "Guitar", "Bass")
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert [(r["harmony"], r["root"], r["quarter_beats"]) for r in made.orderBy("bar").collect()] == [([36, 60, 64, 67], [36], 3.0), ([], [], 4.0), ([36, 60, 64, 67], [], 4.0)]


# other sources


def test_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text('release_date,name,popularity,artists\n2020-01-01,"A, b",5,"X, Y"\n', encoding="utf-8")
    row = tables.read_playlist(spark, str(tmp_path / "p.csv")).first()
    assert (row["name"], row["popularity"], row["artists"]) == ("A, b", 5, ["X", "Y"])
    made = tables.synthetic_segments(spark, ["C", "Am"], 2.0)
    tables.write_segments(made, str(tmp_path / "segments"))
    assert sorted(tables.read_segments(spark, str(tmp_path / "segments")).collect()) == sorted(made.collect()) == [(0, 2_000_000, "C"), (2_000_000, 4_000_000, "Am")]
    assert tables.read_snapshot(spark, str(tmp_path / "absent"), "id string").count() == 0
    tables.save(made, str(tmp_path / "saved"))
    assert tables.read_snapshot(spark, str(tmp_path / "saved"), "start_us long, end_us long, label string").count() == 2
    pushed = tables.push_rows(spark.createDataFrame([("a", True, None)], "id string, is_example boolean, degree int"), "d1").first()["value"]
    assert pushed == '{"id":"a","is_example":1,"degree":null,"device_id":"d1"}'
