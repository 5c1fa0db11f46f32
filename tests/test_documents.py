"""Edits of structure and transcription documents, layout, and the library, on literal cases."""

import pytest
from pyspark.sql import functions as F

from cadenza import dims
from cadenza.operators import documents as docs
from cadenza.operators import layout, library


def bar(i, index=0, signature="4/4", accents=None):
    return (i, index, signature, None, accents)


def section(i, bar_ids, repeat_of=None, comment=None):
    return (i, i.title(), "#111111", bar_ids, repeat_of, comment, None)


@pytest.fixture
def document(spark):
    def make(bars, sections):
        return spark.createDataFrame([(bars, sections)], f"bars array<{docs.BAR}>, sections array<{docs.SECTION}>")

    return make


def run(df, *columns):
    got = df.select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()
    return [got[k] for k in range(len(columns))]


BARS = [bar("b1", 0), bar("b2", 1)]


def test_moved_bar_comes_last_and_bars_are_numbered_anew(document):
    df = document(BARS, [section("intro", ["b1"]), section("verse", ["b2"])])
    bars, sections = run(df, *docs.move_bar("bars", "sections", F.lit("b1"), F.lit("verse")))
    assert [s["bar_ids"] for s in sections] == [[], ["b2", "b1"]]
    assert [(b["id"], b["index"]) for b in bars] == [("b2", 0), ("b1", 1)]
    bars, sections = run(df, *docs.move_bar("bars", "sections", F.lit("b1"), F.lit("nowhere")))
    assert [b["id"] for b in bars] == ["b2"]


def test_accents_beyond_the_new_signature_go(document):
    df = document([bar("b1", accents=[0, 1, 2, 3, 4])], [section("intro", ["b1"])])
    (bars,) = run(df, docs.set_time_signature("bars", F.lit("b1"), F.lit("2/4")))
    assert bars[0]["accents"] == [0, 1, 2, 3] and bars[0]["time_signature"] == "2/4"
    (bars,) = run(document([bar("b1", accents=[5])], []), docs.set_time_signature("bars", F.lit("b1"), F.lit("2/4")))
    assert bars[0]["accents"] is None


def test_accents_toggle(document):
    df = document([bar("b1", accents=[3])], [])
    toggle = lambda dot: run(df, docs.toggle_accent("bars", F.lit("b1"), F.lit(dot)))[0][0]["accents"]
    assert toggle(1) == [1, 3] and toggle(3) is None


def test_duplicate_comes_after_its_source(document):
    df = document([bar("b1"), bar("b2")], [section("intro", ["b1"], repeat_of="verse"), section("verse", ["b2"])])
    bars, sections = run(df, *docs.duplicate_section("bars", "sections", F.lit("intro"), F.lit("4/4"), lambda n: F.concat(F.lit("n"), n.cast("string")), F.lit("new")))
    assert [s["id"] for s in sections] == ["intro", "new", "verse"]
    assert [b["id"] for b in bars] == ["b1", "n0", "b2"]
    assert sections[1]["repeat_of"] is None
    assert run(df, *docs.duplicate_section("bars", "sections", F.lit("no"), F.lit("4/4"), lambda n: F.lit("n"), F.lit("new"))) == [None, None]


def test_duplicate_of_a_bar_that_is_gone_has_the_fallback_signature(document):
    df = document([], [section("intro", ["lost"])])
    bars, _ = run(df, *docs.duplicate_section("bars", "sections", F.lit("intro"), F.lit("3/4"), lambda n: F.lit("n0"), F.lit("new")))
    assert [(b["id"], b["time_signature"]) for b in bars] == [("n0", "3/4")]


def test_removed_section_frees_its_repeats(document):
    df = document(BARS, [section("intro", ["b1"]), section("again", ["b2"], repeat_of="intro")])
    bars, sections = run(df, *docs.remove_section("bars", "sections", F.lit("intro")))
    assert [b["id"] for b in bars] == ["b2"] and sections[0]["repeat_of"] is None


def test_reordering(document):
    df = document(BARS, [section("a", ["b1"]), section("b", []), section("c", ["b2"])])
    bars, sections = run(df, *docs.reorder_sections("bars", "sections", F.lit("a"), F.lit("c")))
    assert [s["id"] for s in sections] == ["b", "c", "a"] and [b["id"] for b in bars] == ["b2", "b1"]
    bars, sections = run(df, *docs.reorder_sections("bars", "sections", F.lit("a"), F.lit("zzz")))
    assert [s["id"] for s in sections] == ["a", "b", "c"] and [b["id"] for b in bars] == ["b1", "b2"]


def test_bars_and_sections_are_added_and_removed(document):
    df = document(BARS, [section("a", ["b1", "b2"])])
    bars, sections = run(df, *docs.add_bar("bars", "sections", F.lit("a"), F.lit("6/8"), F.lit("b3")))
    assert [(b["id"], b["index"]) for b in bars] == [("b1", 0), ("b2", 1), ("b3", 2)] and sections[0]["bar_ids"] == ["b1", "b2", "b3"]
    bars, sections = run(df, *docs.remove_bar("bars", "sections", F.lit("b1")))
    assert [(b["id"], b["index"]) for b in bars] == [("b2", 0)] and sections[0]["bar_ids"] == ["b2"]
    (sections,) = run(df, docs.add_section("sections", F.lit("z"), F.lit("Z"), F.lit("#222222")))
    assert sections[-1]["id"] == "z" and sections[-1]["bar_ids"] == []
    (sections,) = run(df, docs.set_section("sections", F.lit("a"), "bars_per_row", F.lit(3)))
    assert sections[0]["bars_per_row"] == 3
    (bars,) = run(df, docs.set_bar_color("bars", F.lit("b2"), F.lit("#333333")))
    assert [b["color"] for b in bars] == [None, "#333333"]


def test_migration_collects_orphans(spark):
    legacy = [("s1", "verso", None, None, None, ["b1"], None, None), ("s2", "custom", "Mine", None, None, [], None, None), ("s3", None, "", None, None, [], None, None), ("s4", "intro", None, "Kept", "#abcdef", [], None, None)]
    df = spark.createDataFrame([(BARS, legacy)], f"bars array<{docs.BAR}>, sections array<{docs.LEGACY}>")
    (sections,) = run(df, docs.migrated("bars", "sections", F.lit("orphans")))
    assert [(s["name"], s["color"]) for s in sections] == [("Verso", "#3b82f6"), ("Mine", "#9ca3af"), ("Personalizado", "#9ca3af"), ("Kept", "#abcdef"), (dims.ORPHANS_NAME, dims.ORPHANS_COLOR)]
    assert sections[-1]["bar_ids"] == ["b2"]


def step(label, beats=None):
    return (0, label, None, beats, None, None)


def test_steps(spark):
    df = spark.createDataFrame([([step("a"), step("b", 2.0)], [step("x")] * 64)], f"steps array<{docs.STEP}>, full array<{docs.STEP}>")
    extra = F.get("steps", F.lit(0))
    added, capped, removed, beats, sure, same = run(
        df,
        docs.append_step("steps", extra),
        docs.append_step("full", extra),
        docs.remove_step("steps", F.lit(0)),
        docs.set_step("steps", F.lit(1), "beats", F.lit(20.0)),
        docs.set_step("steps", F.lit(0), "confidence", F.lit("sure")),
        docs.remove_step("steps", F.lit(9)),
    )
    assert [s["label"] for s in added] == ["a", "b", "a"] and len(capped) == 64
    assert [s["label"] for s in removed] == ["b"] and [s["label"] for s in same] == ["a", "b"]
    assert [s["beats"] for s in beats] == [None, 8.0] and [s["confidence"] for s in sure] == ["sure", None]


def test_transcription_sections(spark):
    one = ("s1", "verso", None, [step("a")])
    df = spark.createDataFrame([([one], [one, ("s2", "custom", "", [])])], f"one array<{docs.SONG_SECTION}>, two array<{docs.SONG_SECTION}>")
    (added, active), (emptied, at), (left, clamped) = (
        run(df, *docs.add_song_section("one", F.lit("n"), F.lit("solo"), F.lit(None).cast("string"))),
        run(df, *docs.remove_song_section("one", F.lit(0), F.lit(0))),
        run(df, *docs.remove_song_section("two", F.lit(0), F.lit(1))),
    )
    assert [s["id"] for s in added] == ["s1", "n"] and active == 1
    assert (emptied, at) == ([], 0) and [s["id"] for s in left] == ["s2"] and clamped == 0
    edited, untouched = run(df, docs.in_section("two", F.lit(0), lambda s: docs.remove_step(s, F.lit(0))), docs.in_section("two", F.lit(7), lambda s: docs.remove_step(s, F.lit(0))))
    assert [len(s["steps"]) for s in edited] == [0, 0] and [len(s["steps"]) for s in untouched] == [1, 0]
    assert run(df, docs.display_label(F.get("two", F.lit(0))), docs.display_label(F.get("two", F.lit(1)))) == ["Verso", "Personalizado"]


def test_sections_flow_into_columns(spark):
    rows = [(1, k, 2, None, None) for k in range(60)] + [(2, 1, 0, None, None)]
    boxes = layout.section_boxes(spark.createDataFrame(rows, "doc long, section long, n_bars int, bars_per_row int, comment string"), "a4")
    assert boxes.where("doc = 2").count() == 0  # no bars
    placed = layout.flow(boxes, "a4", header=20.0).orderBy("section").collect()
    bottom = dims.PAGES["a4"]["pageH"] - dims.PAGES["a4"]["margin"]
    assert all(p["y"] + 10.5 <= bottom for p in placed)
    assert [(p["page"], p["col"]) for p in placed] == sorted((p["page"], p["col"]) for p in placed) and {p["page"] for p in placed} == {1, 2}
    places = layout.bar_places(boxes, "a4").where("section = 0 and doc = 1").orderBy("number").collect()
    assert [(p["x"], p["y"]) for p in places] == [(0.0, 5.0), (9.0, 5.0)]


def test_wrapped_comments():
    assert layout.wrapped("aa bb cccccccccc d", 9.0) == ["aa bb", "cccccccccc", "d"] and layout.wrapped("", 9.0) == []


# the library


def test_union_by_id(spark):
    local, cloud = (spark.createDataFrame([(x,) for x in ids], "id string") for ids in (["local", "shared"], ["cloud", "shared"]))
    cloud_only, local_only = library.merge_union(local, cloud)
    assert [r["id"] for r in cloud_only.collect()] == ["cloud"] and [r["id"] for r in local_only.collect()] == ["local"]


def test_last_write_wins_compares_text(spark):
    local = spark.createDataFrame([("old", "2024-01-01"), ("same", "2024-01-02"), ("local", "2024-01-01")], "id string, updated_at string")
    cloud = spark.createDataFrame([("old", "2024-02-01"), ("same", "2024-01-01"), ("new", "2023-01-01")], "id string, updated_at string")
    apply, push = library.merge_last_write_wins(local, cloud)
    assert sorted(r["id"] for r in apply.collect()) == ["new", "old"] and [r["id"] for r in push.collect()] == ["local"]
    table, _ = library.synchronised(local, cloud)
    assert dict(table.collect()) == {"old": "2024-02-01", "same": "2024-01-02", "local": "2024-01-01", "new": "2023-01-01"}


def test_upsert_update_and_delete(spark):
    table = spark.createDataFrame([("a", "A", 1, "t0"), ("b", "B", 0, "t0")], "id string, title string, is_example int, updated_at string")
    batch = spark.createDataFrame([("b", "B1", 0, "t1", 1), ("b", "B2", 0, "t1", 2), ("c", "C", 0, "t1", 3)], "id string, title string, is_example int, updated_at string, at int")
    assert sorted((r["id"], r["title"]) for r in library.upsert(table, batch, order="at").collect()) == [("a", "A"), ("b", "B2"), ("c", "C")]
    patches = spark.createDataFrame([("a", None, True), ("b", "x", None)], "id string, title string, set_title boolean")
    got = library.partial_update(table, patches, ["title"], now=F.lit("t9")).orderBy("id").collect()
    assert [(r["title"], r["updated_at"]) for r in got] == [(None, "t9"), ("B", "t0")]
    keys = table.select("id")
    assert [r["id"] for r in library.delete(table, keys, ["id"], guard=F.col("is_example") == 1).collect()] == ["a"]
    assert library.delete(table, keys, ["id"]).count() == 0


def test_examples_are_seeded_once_and_decoded(spark):
    none = spark.createDataFrame([], library.PROGRESSION)
    seeded = library.seeded(none, "t0")
    assert seeded.count() == 7 and library.seeded(seeded, "t1").count() == 7
    listed = library.list_progressions(library.decoded(seeded), "minor").collect()
    assert [r["id"] for r in listed] == ["andaluza", "menor-basica"] and all(r["is_example"] for r in listed)
    last = listed[0]["steps"][-1]
    assert (last["degree"], last["label"], last["intervals"]) == (None, "V", [7, 11, 2])
    assert '"degree":null' in seeded.where("id = 'andaluza'").first()["steps"]
    assert library.by_id(seeded, "pop").count() == 1 and library.by_id(seeded, "none").count() == 0


def test_reads_and_guards(spark):
    table = spark.createDataFrame([("a", 0, "d1"), ("b", None, "d2"), ("c", 90, "d1")], "id string, bpm int, device_id string")
    assert [r["bpm"] for r in library.structures_read(table).orderBy("id").collect()] == [120, 120, 90]
    assert library.by_device(table, "d1").count() == 2 and library.by_device(table, None).count() == 3
    one = spark.range(1)
    title = lambda t, f: one.select(library.import_title(F.lit(t), F.lit(f), "Untitled").alias("x")).first()["x"]
    assert [title(" ", "My song.GP"), title("T", "f.gp"), title(None, "")] == ["My song", "T", "Untitled"]
    saves = lambda t, n: one.select(library.can_save(F.lit(t), F.array_repeat(F.lit(1), n)).alias("x")).first()["x"]
    assert [saves("t", 1), saves(" ", 1), saves("t", 0)] == [True, False, False]
