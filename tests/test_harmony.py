"""Chord matching, analysis, theory, scales and progressions, on literal cases."""

import pytest
from pyspark.sql import functions as F

from cadenza import dims
from cadenza.functions import theory as th
from cadenza.operators import harmony, progressions, scales

BARS = "song int, bar int, harmony array<int>, root array<int>, key_root int, is_minor boolean, quarter_beats double"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def analyzed(spark, bars, key=0, minor=False):
    rows = [(1, n, harmony_, root, key, minor, beats) for n, (harmony_, root, beats) in enumerate(bars)]
    return harmony.analyze_bars(harmony.match_bars(spark.createDataFrame(rows, BARS)))


def steps(spark, bars, key=0, minor=False):
    return analyzed(spark, bars, key, minor).orderBy("bar").collect()


@pytest.mark.parametrize(("intervals", "family"), [([0, 4, 7], "MAJ"), ([0, 4, 7, 10], "MAJ"), ([0, 3, 7], "MIN"), ([0, 3, 6], "DIM"), ([0, 4, 8], "AUG"), ([0, 5, 7], "NOTHIRD")])
def test_family(spark, intervals, family):
    assert value(spark, th.family(th.literal(intervals))) == family


def test_diatonic_bar(spark):
    (bar,) = steps(spark, [([60, 64, 67], [], 4.0)])
    assert (bar["degree"], bar["label"], bar["carried"], bar["number"], bar["detected"], bar["confidence"]) == (0, "I", False, 1, "Cmaj", None)


def test_chromatic_bar_is_spelled_for_its_key(spark):
    (bar,) = steps(spark, [([61, 65, 68], [], 4.0)])
    assert (bar["degree"], bar["label"], bar["step_intervals"], bar["beats"]) == (None, "C#", [1, 5, 8], 4.0)
    (bar,) = steps(spark, [([61, 65, 68], [], 4.0)], key=10)
    assert (bar["label"], bar["step_intervals"]) == ("Db", [3, 7, 10])


def test_silent_bar_carries_the_last_chord_with_its_own_length(spark):
    first, second = steps(spark, [([60, 64, 67], [], 4.0), ([], [], 3.0)])
    assert (second["carried"], second["degree"], second["beats"], second["confidence"]) == (True, 0, 3.0, "unsure")
    assert first["confidence"] is None


def test_nothing_to_carry(spark):
    for bar in steps(spark, [([], [], 4.0), (None, None, None)]):
        assert (bar["label"], bar["confidence"], bar["carried"], bar["kind"], bar["beats"]) == ("?", "unsure", False, "no-chord-data", 4.0)


def test_lengths_are_clamped(spark):
    assert [b["beats"] for b in steps(spark, [([60, 64, 67], [], 20.0), ([60, 64, 67], [], 3.5), ([60, 64, 67], [], float("nan"))])] == [8.0, 3.5, 4.0]


def test_two_readings_are_decided_by_the_lowest_root_note(spark):
    six = [60, 64, 67, 69]  # C6 or Am7
    kinds = [(b["kind"], b["quality"], b["root_pc"]) for b in steps(spark, [(six, [45], 4.0), (six, [36, 45], 4.0), (six, [40], 4.0), (six, [], 4.0), ([], [36, 43], 4.0)])]
    assert kinds == [("chord", "min7", 9), ("chord", "6", 0), ("unclear", None, None), ("unclear", None, None), ("chord", "5", 0)]


def test_summary_is_a_partition_of_the_bars(spark):
    got = harmony.summarise(analyzed(spark, [([60, 64, 67], [], 4.0), ([61, 65, 68], [], 4.0), ([60, 61], [], 4.0), ([], [], 4.0)]), "song").first()
    assert tuple(got) == (1, 1, 1, 1, 1)


def test_sections_of_64_bars(spark):
    made = harmony.assemble_sections(analyzed(spark, [([60, 64, 67], [], 4.0)] * 130)).orderBy("section").collect()
    assert [(len(r["steps"]), r["section_label"]) for r in made] == [(64, "Parte 1"), (64, "Parte 2"), (2, "Parte 3")]


def test_field_of_every_key(spark):
    rows = harmony.harmonic_field(spark).collect()
    assert len(rows) == 168
    by_key = {(r["key_root"], r["is_minor"], r["degree"]): r for r in rows}
    assert by_key[0, False, 5]["chord_name"] == "G7" and by_key[0, False, 5]["notes"] == [7, 11, 2, 5]
    assert by_key[9, True, 1]["chord_name"] == "Am7" and by_key[5, False, 4]["note_names"][0] == "Bb"
    assert all(len({r["chord_root"] for r in rows if (r["key_root"], r["is_minor"]) == k}) == 7 for k in {(r["key_root"], r["is_minor"]) for r in rows})


STEPS = "song int, pos int, key_root int, is_minor boolean, degree int, label string, intervals array<int>"


def test_steps_fall_back_to_label_and_intervals(spark):
    rows = [(1, 0, 0, False, 4, "V", None), (1, 1, 0, False, 7, "x", [0, 3]), (1, 2, 0, False, None, "y", None)]
    got = progressions.resolve_steps(spark.createDataFrame(rows, STEPS)).orderBy("pos").collect()
    assert [(r["chord_name"], r["notes"], r["field_degree"], r["function"]) for r in got] == [("G7", [7, 11, 2, 5], 4, "D"), ("x", [0, 3], None, None), ("y", [], None, None)]


def test_chromatic_steps(spark):
    keys = spark.createDataFrame([(0,)], "key_root int")
    made = {r["label"]: r for r in progressions.common_chromatic_steps(keys).collect()}
    assert len(made) == 12 and made["V7/V"]["notes"] == made["V7/V"]["step_intervals"] == [2, 6, 9, 0]
    own = progressions.manual_chromatic_steps(spark.createDataFrame([(2, "dom7", 0)], "root_note int, type_id string, key_root int")).first()
    assert (own["label"], own["notes"], own["step_intervals"]) == ("D7", [2, 6, 9, 0], [2, 6, 9, 0])


def said(spark, degrees):
    rows = [(1, n, 0, False, d, str(d), [1, 5, 8] if d is None else None) for n, d in enumerate(degrees)]
    return progressions.analyze(progressions.resolve_steps(spark.createDataFrame(rows, STEPS))).first()


def test_analysis_sentences(spark):
    a = dims.ANALYSIS
    assert said(spark, [0, 3, 4, 0])["analysis"] == f"{a['cadence']} {a['circular']}"
    assert said(spark, [0, 4])["analysis"] == a["suspended"]
    assert said(spark, [0, None])["analysis"] == a["chromatic"]
    assert said(spark, [3, 0])["analysis"] == a["moving"]
    assert said(spark, [0])["analysis"] is None and said(spark, [0, 1])["analysis"] is None


def test_review_starts_at_the_first_unsure_step(spark):
    rows = [(1, 0, 0, "a", "sure"), (1, 0, 1, "b", None), (1, 1, 2, "c", "unsure"), (1, 1, 3, "d", "unsure"), (2, 0, 0, "e", None)]
    got = progressions.review(spark.createDataFrame(rows, "song int, section int, pos int, label string, confidence string")).orderBy("song", "pos").collect()
    assert [r["start"] for r in got] == [False, False, True, False, True]
    assert [(r["previous_label"], r["next_label"]) for r in got][:2] == [(None, "b"), ("a", "c")]


def test_scale_pairs(spark):
    union, kinds = scales.classified(th.literal([0, 2, 4]), th.literal([0, 3, 4]))
    assert value(spark, union) == [0, 2, 4, 3] and value(spark, kinds) == ["shared", "a", "shared", "b"]
    union, kinds = scales.classified(th.literal([0, 0, 2]), F.lit(None).cast("array<int>"))
    assert value(spark, union) == [0, 0, 2] and value(spark, kinds) == ["a", "a", "a"]
    assert value(spark, scales.differing_degrees(th.literal([0, 2, 4, 5]), th.literal([0, 2, 3]))) == ["3o", "4o"]


def test_scale_and_chord_notes(spark):
    rows = spark.createDataFrame([(2, "dorian", "min7"), (2, "no such scale", "no such chord")], "root_note int, scale_id string, type_id string")
    assert [r["notes"] for r in scales.notes_of(rows).collect()] == [[2, 4, 5, 7, 9, 11, 0], []]
    assert [r["notes"] for r in scales.chord_notes(rows).collect()] == [[2, 5, 9, 0], []]


@pytest.mark.parametrize(("beats", "clamped"), [(0.1, 0.5), (1.24, 1.0), (1.26, 1.5), (20.0, 8.0), (float("inf"), 8.0)])
def test_clamped_steps(spark, beats, clamped):
    assert value(spark, th.clamp_step_beats(F.lit(beats))) == clamped


def test_names_and_voicing(spark):
    assert [value(spark, th.note_index(F.lit(n))) for n in ("C", "C#", "Db", "H")] == [0, 1, 1, -1]
    assert [value(spark, th.midi_note_name(F.lit(m))) for m in (60, 21, 69)] == ["C4", "A0", "A4"]
    assert [value(spark, th.preferred_root_name(F.lit(k))) for k in (1, 6, 8, 11)] == ["Db", "Gb", "Ab", "B"]
    assert [tuple(v) for v in value(spark, th.voiced(th.literal([7, 11, 2, 5]), F.lit(3)))] == [(7, 3), (11, 3), (2, 4), (5, 4)]
    assert [tuple(v) for v in value(spark, th.voiced(th.literal([0, 0]), F.lit(1)))] == [(0, 1), (0, 2)]
    assert value(spark, th.step_labels(th.literal([0, 2, 3, 6, 11]))) == ["T", "ST", "T+ST", "5st"]
    assert value(spark, th.slug(F.lit("Olá, mundo  novo!"))) == "Ol_mundo_novo"
    assert abs(value(spark, th.frequency(F.lit(81))) - 880) < 1e-9
    assert [value(spark, th.beats_label(F.lit(b))) for b in (4.0, 1.5)] == ["4t", "1.5t"]
    assert value(spark, th.rgb(F.lit("#3b82f6"))) == [59, 130, 246] and value(spark, th.lighter(F.lit("#000000"), 0.2)) == [51.0, 51.0, 51.0]


def test_bass(spark):
    rows = spark.createDataFrame([(1, [0, 4, 7])], "id int, notes array<int>")
    got = {r["position"]: (r["note"], r["string_no"], r["fret"]) for r in scales.bass_positions(rows).collect()}
    assert got == {0: (0, 1, 3), 1: (4, 0, 0), 2: (7, 0, 3)}  # no C1 on the neck: C2 where its fret is lowest
    assert scales.neck(spark, [0]).where("highlighted and octave_start").count() == 4
