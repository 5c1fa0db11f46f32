"""More registered queries: the library's tables and their sources, and the small operators beside the main ones."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza import dims
from cadenza.functions import theory as th
from cadenza.operators import documents as docs
from cadenza.operators import harmony, layout, library, playback, progressions, quiz, ranks, scales
from cadenza.operators import structure_rows as tabular
from cadenza.plans import bindings as bind
from cadenza.plans.catalogue import QUERIES, analyzed, archive, matched, nth_section, query, seeds, segments, songs, stored, structure_tables, structures, text
from cadenza.sources import gp, shared, store, tables
from cadenza.streaming import sessions, sync

__all__ = ["QUERIES"]
NOW = "2030-01-01 00:00:00"


def number(id_: str = "id") -> Column:
    return F.substring(id_, 2, 20).cast("long")


# listings, reads and changes


@query
def list_by_mode(spark, sf_dir):
    return library.list_progressions(stored(spark, sf_dir), "minor").select("id", "mode", "is_example", "created_at")


@query
def list_all(spark, sf_dir):
    """Every progression with its place in the listing of all modes."""
    return ranks.numbered(library.list_progressions(stored(spark, sf_dir)), [], library.by_example(), "place").select("id", "mode", "place")


@query
def list_songs(spark, sf_dir):
    return ranks.numbered(library.list_recent(stored(spark, sf_dir)), [], library.by_update(), "place").select("id", "updated_at", "place")


@query
def list_structures(spark, sf_dir):
    """Stored structures as they are listed: tempo, and sections of the old shape (without name and colour) migrated."""
    n = F.col("doc")
    kinds = th.literal([t for t, _, _ in dims.SECTION_TYPES])
    none = F.lit(None).cast("string")

    def legacy(s: Column, i: Column) -> Column:
        return F.struct(s["id"].alias("id"), F.get(kinds, ((n + i) % 8).cast("int")).alias("type"), none.alias("custom_label"), none.alias("name"), none.alias("color"), s["bar_ids"].alias("bar_ids"), s["repeat_of"].alias("repeat_of"), s["comment"].alias("comment")).cast(docs.LEGACY)

    made = structures(spark, sf_dir).withColumn("sections", F.transform("sections", legacy))
    table = made.select(F.concat(F.lit("t"), n.cast("string")).alias("id"), F.when(n % 3 > 0, (n % 3 - 1).cast("int")).alias("bpm"), F.lpad((n % 1000).cast("string"), 4, "0").alias("updated_at"), "bars", "sections")
    listed = library.list_structures(table, F.concat(F.lit("orphans-"), F.col("id")))
    return listed.select("id", "bpm", F.size("sections").alias("n_sections"), F.array_join(F.transform("sections", lambda s: s["name"]), "|").alias("names"))


@query
def example_count(spark, sf_dir):
    return stored(spark, sf_dir).where("is_example = 1").agg(F.count(F.lit(1)).alias("n"))


@query
def example_split(spark, sf_dir):
    examples, own = library.split_examples(stored(spark, sf_dir))
    return examples.select("id", F.lit("example").alias("kind")).unionAll(own.select("id", F.lit("own").alias("kind")))


def progression_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored progressions, with steps as JSON text."""
    step = F.transform(F.sequence(F.lit(0), (number() % 4).cast("int")), lambda k: F.concat(F.lit('{"degree":'), F.when(k % 3 < 2, k.cast("string")).otherwise("null"), F.lit(',"label":"s'), k.cast("string"), F.lit('"}')))
    return stored(spark, sf_dir).select("id", F.col("title").alias("name"), F.lit("").alias("description"), F.concat(F.lit("["), F.array_join(step, ","), F.lit("]")).alias("steps"), "mode", F.lit("piano").alias("preset_id"), "bpm", "is_example", "created_at")


@query
def seeded_library(spark, sf_dir):
    """A library without examples gets the seven; steps are read from their JSON."""
    table = library.seeded(progression_rows(spark, sf_dir).where("is_example = 0"), NOW)
    made = library.decoded(table)
    return made.select("id", "name", "mode", "is_example", F.size("steps").alias("n_steps"), F.array_join(F.transform("steps", lambda s: F.coalesce(s["degree"].cast("string"), F.lit("-"))), ",").alias("degrees"))


@query
def inserted_rows(spark, sf_dir):
    """Every tenth order is inserted under a new id; what reads back, and how many rows there are then."""
    table = stored(spark, sf_dir).select("id", "title", "bpm")
    after, back = library.inserted(table, table.where(number() % 10 == 0).withColumn("id", F.concat(F.lit("n"), F.substring("id", 2, 20))))
    count = after.agg(F.count(F.lit(1)).alias("n_rows"))  # one row
    return back.join(F.broadcast(count))


@query
def new_ids(spark, sf_dir):
    return bind.table(spark, sf_dir, "part").select("p_partkey", library.new_id(F.lit("bar"), F.col("p_partkey"), F.lit(None)).alias("new_id"))


@query
def point_reads(spark, sf_dir):
    table = stored(spark, sf_dir).select("id", "title")
    return library.by_id(table, "s1").unionAll(library.by_id(table, "s32")).unionAll(library.by_id(table, "missing"))


@query
def valid_rows(spark, sf_dir):
    """Rows that the stored table's constraints let in, where some have no mode and some an unknown one."""
    mode = F.when(number() % 11 == 0, F.lit(None)).when(number() % 11 == 1, "dorian").otherwise(F.col("mode"))
    return library.valid(stored(spark, sf_dir).withColumn("mode", mode)).select("id", "mode")


@query
def stored_schemas(spark, sf_dir):
    """The columns of the stored tables, here and in the remote store, and in how many rows each is filled when the library's
    rows are made to conform to them."""
    local = {"saved_progressions": library.PROGRESSION, "songs": library.SONG, "structures": library.STRUCTURE}
    rows = stored(spark, sf_dir)

    def filled(store: str, name: str, kind: str) -> DataFrame:
        table = library.conformed(rows, kind)
        counts = table.agg(*(F.count(c).alias(c) for c in table.columns))
        each = [F.struct(F.lit(store).alias("store"), F.lit(name).alias("name"), F.lit(k).alias("place"), F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(c).alias("n_filled")) for k, (c, t) in enumerate(table.dtypes)]
        return counts.select(F.inline(F.array(*each)))

    made = [filled(store, name, kind + extra) for store, extra in (("local", ""), ("cloud", ", device_id string")) for name, kind in local.items()]
    return reduce(DataFrame.unionAll, made)


@query
def upsert_defaults(spark, sf_dir):
    """Records as the remote store takes them: what they leave out is filled in, then they replace rows."""
    table = stored(spark, sf_dir).select("id", "artist", "bpm", "created_at")
    key = number()
    batch = table.where(key % 3 == 0).select("id", F.when(key % 2 == 0, F.col("artist")).alias("artist"), F.when(key % 4 == 0, F.col("bpm")).alias("bpm"), F.when(key % 5 == 0, F.col("created_at")).alias("created_at"), key.alias("at"))
    return library.upsert(table, library.with_defaults(batch, library.defaults(F.lit(NOW))), order="at")


@query
def device_or_all(spark, sf_dir):
    """A device's rows, and all rows where no device is named."""
    table = stored(spark, sf_dir).select("id", "device_id")
    return library.by_device(table, "d4").withColumn("asked", F.lit("d4")).unionAll(library.by_device(table, None).withColumn("asked", F.lit("all")))


@query
def presets(spark, sf_dir):
    known = spark.createDataFrame([(x,) for x in dims.PRESET_IDS], "preset_id string")
    ids = th.literal([*dims.PRESET_IDS, "kazoo"])
    rows = bind.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 > 0, F.get(ids, (F.col("p_partkey") % 7).cast("int"))).alias("preset_id"))
    return library.with_preset(rows, known).select("p_partkey", "preset")


@query
def device_settings(spark, sf_dir):
    """A setting that three devices have, and its default."""
    rows = stored(spark, sf_dir).select("id", "device_id")
    settings = spark.createDataFrame([("d1", "theme", "dark"), ("d2", "theme", "light"), ("d2", "size", "9"), ("d7", "theme", "dark")], "device_id string, name string, value string")
    return tables.with_setting(rows, settings, "theme", "system").select("id", "device_id", "theme")


# synchronising and the store


@query
def push_rows(spark, sf_dir):
    local, _ = bind.local_and_cloud(spark, sf_dir)
    return tables.push_rows(local.select("id", "title", "is_example"), "dev")


@query
def push_deletes(spark, sf_dir):
    local, _ = bind.local_and_cloud(spark, sf_dir)
    return tables.push_deletes(local.where(number() % 5 == 0), "dev")


def synced(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    local, cloud = bind.local_and_cloud(spark, sf_dir)
    third = lambda df: df.where(number() % 3 == 2)
    return library.sync_all((local, cloud), (third(local), cloud), (local, third(cloud)))


@query
def sync_library(spark, sf_dir):
    """All three collections after a synchronisation, committed in one step and read back."""
    root = shared.fresh_dir(spark, "library")
    made = synced(spark, sf_dir)
    store.commit(spark, root, {name: after for name, (after, _) in made.items()})
    kind = "id string, title string, updated_at string"
    read = [store.current(spark, root, name, kind).select("id", "title", "updated_at", F.lit(name).alias("collection")) for name in made]
    return read[0].unionAll(read[1]).unionAll(read[2])


@query
def sync_pushes(spark, sf_dir):
    made = [push.select("id", F.lit(name).alias("collection")) for name, (_, push) in synced(spark, sf_dir).items()]
    return made[0].unionAll(made[1]).unionAll(made[2])


@query
def sync_stream(spark, sf_dir):
    """The other copy's rows arrive as a stream, a file a batch, and the last write wins."""
    root, kind = shared.fresh_dir(spark, "library"), "id string, title string, updated_at string"
    local, cloud = (t.select("id", "title", "updated_at") for t in bind.local_and_cloud(spark, sf_dir))
    store.commit(spark, root, {"songs": local})
    for part in range(2):
        cloud.where(number() % 2 == part).coalesce(4).write.mode("append").parquet(f"{root}/arriving")
    changes = spark.readStream.schema(kind).option("maxFilesPerTrigger", 4).parquet(f"{root}/arriving")
    sync.synchronising(changes, root, "songs", kind, source="cloud").awaitTermination()
    return store.current(spark, root, "songs", kind)


@query
def library_session(spark, sf_dir):
    """A session of edits: a table is committed, records are saved over it, some are removed, and it is listed anew."""
    kind = "id string, title string, updated_at string, is_example int"
    shelf = store.Library(spark, shared.fresh_dir(spark, "shelf"), "songs", kind, "dev")
    table = stored(spark, sf_dir).select("id", "title", "updated_at", "is_example")
    store.commit(spark, shelf.root, {"songs": table})
    saved = table.where(number() % 4 == 0).select("id", F.concat(F.lit("saved "), "title").alias("title"), F.lit(NOW).alias("updated_at"), "is_example", number().alias("at"))
    shelf.save(saved, order="at")
    return shelf.remove(table.where(number() % 6 == 0).select("id"), guard=F.col("is_example") == 1)


@query
def snapshot_pull(spark, sf_dir):
    """Rows of a snapshot that is there, and of one that isn't."""
    _, cloud = bind.local_and_cloud(spark, sf_dir)
    path = shared.fresh_dir(spark, "snapshot")
    kind = "id string, title string, updated_at string"
    tables.save(cloud.select("id", "title", "updated_at"), path)
    return tables.read_snapshot(spark, path, kind).unionAll(tables.read_snapshot(spark, f"{path}-absent", kind))


# files


@query
def segment_files(spark, sf_dir):
    """Label segments written as tab-separated lines and read back, to the millisecond."""
    path = shared.fresh_dir(spark, "segments")
    made = segments(spark, sf_dir)
    tables.write_segments(made, path)
    return tables.read_segments(spark, path)


@query
def synthetic_segments(spark, sf_dir):
    """Each song's steps as label segments of two seconds."""
    return tables.laid_out(bind.steps(spark, sf_dir), F.col("pos"), 2.0).select("song", "start_us", "end_us", "label")


@query
def playlist_file(spark, sf_dir):
    """Parts as tracks of a CSV file, whose artists are a list in one field."""
    path = shared.fresh_dir(spark, "playlist")
    key = F.col("p_partkey")
    artist = F.concat(F.lit("a"), (key % 5).cast("string"))
    rows = bind.table(spark, sf_dir, "part").select(F.format_string("20%02d-01-01", key % 30).alias("release_date"), F.concat(F.lit('track "'), key.cast("string"), F.lit('", live')).alias("name"), (key % 101).cast("int").alias("popularity"), F.concat_ws(", ", artist, F.when(key % 2 == 0, F.lit("b"))).alias("artists"))
    rows.write.csv(path, header=True, escape='"', quoteAll=True)
    return tables.read_playlist(spark, path).select("release_date", "name", "popularity", F.array_join("artists", "|").alias("artists"))


def track_pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each (bar, track) of a song."""
    bars = bind.bars(spark, sf_dir)
    each = F.explode(F.array(F.struct(F.lit("Gtr").alias("track"), F.col("harmony").alias("pitches")), F.struct(F.lit("Bass").alias("track"), F.col("root").alias("pitches"))))
    return bars.select("song", "bar", each.alias("x")).select("song", "bar", "x.track", "x.pitches")


@query
def pitch_files(spark, sf_dir):
    """Pitches of each bar and track, written as JSON and read back."""
    path = shared.fresh_dir(spark, "pitches")
    tables.write_pitches(track_pitches(spark, sf_dir), path)
    return tables.read_pitches(spark, path).select("song", "bar", "track", text("pitches").alias("pitches"))


@query
def chord_files(spark, sf_dir):
    path = shared.fresh_dir(spark, "chords")
    tables.write_chords(matched(spark, sf_dir).select("song", "bar", "kind", "root_pc", "quality", "intervals"), path)
    return tables.read_chords(spark, path).select("song", "bar", "kind", "root_pc", "quality", text("intervals").alias("intervals"))


@query
def track_counts(spark, sf_dir):
    """How many bars of a song's two tracks aren't empty, and the first fifteen of them."""
    made = harmony.non_empty(track_pitches(spark, sf_dir), ["Gtr", "Bass"], by=["song"], first=15)
    return made.select("song", "n_bars", F.array_join(F.transform("first", lambda x: F.concat_ws(":", x["bar"].cast("string"), x["track"])), ",").alias("first"))


BROKEN = {1: b"BCFS1234", 2: b"\x18FICHIER GUITAR PRO v5.00", 3: b"not a zip", 5: b"PK\x03\x04broken"}


@query
def score_messages(spark, sf_dir):
    """Files of all kinds, written, read with Spark's binary reader, and what users are told about each."""
    @F.pandas_udf(T.BinaryType())
    def other(n: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([gp.zipped({"readme.txt": "no score"}) if i % 7 == 4 else gp.zipped({gp.ENTRY: CHORDED}) if i % 7 == 6 else BROKEN.get(i % 7, c) for i, c in zip(n, content, strict=True)])

    pages = bind.table(spark, sf_dir, "pages").select("page_id")
    good = archive(pages.where("page_id % 7 = 0 and page_id % 10 not in (3, 6, 9) or page_id % 7 > 0"))
    files = good.withColumn("content", other(F.substring("path", 6, 20).cast("long"), "content"))
    scores = gp.parsed(files)
    return scores.select("path", "error", "message").join(gp.metadata(scores).select("path", "has_chords"), "path", "left")


CHORDED = '<?xml version="1.0"?><GPIF><GPVersion>7</GPVersion><MasterBars><MasterBar><Bars>0</Bars></MasterBar></MasterBars><Beats><Beat id="0"><Chord>1</Chord></Beat></Beats></GPIF>'


# steps, keys and quizzes


@query
def steps_to_play(spark, sf_dir):
    """Every third song loops over its active section; the others play whole."""
    active, loop = (F.col("song") % 3).cast("int"), F.col("song") % 3 == 1
    return progressions.to_play(bind.steps(spark, sf_dir), active=active, loop=loop).select("song", "section", "pos")


def nested_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs of two sections: the first four steps and the rest."""
    one = lambda id_, steps: F.struct(F.lit(id_).alias("id"), F.lit("verso").alias("type"), F.lit("").alias("custom_label"), steps.alias("steps")).cast(docs.SONG_SECTION)
    return songs(spark, sf_dir).select("song", F.array(one("a", F.slice("steps", 1, 4)), one("b", F.slice("steps", F.lit(5), F.greatest(F.size("steps") - 4, F.lit(0))))).alias("sections"))


@query
def song_overview(spark, sf_dir):
    """What a song's card says: whether anything can be played, its chords, and its key."""
    made = nested_songs(spark, sf_dir)
    rest = F.transform("sections", lambda s, i: F.when(i == 0, s.withField("steps", F.slice(s["steps"], 1, 0))).otherwise(s))
    n = F.aggregate("sections", F.lit(0), lambda a, s: a + F.size(s["steps"]))
    key = th.key_label((F.col("song") % 12).cast("int"), F.floor(F.col("song") / 12) % 2 == 1)
    return made.select("song", progressions.has_steps(F.col("sections")).alias("has_steps"), progressions.has_steps(rest).alias("has_more"), th.chord_count_label(n).alias("chords"), key.alias("key"))


@query
def review_rows(spark, sf_dir):
    made = progressions.flattened(nested_songs(spark, sf_dir))
    return made.select("song", "section", "pos", F.col("step.label").alias("label"))


@query
def active_step(spark, sf_dir):
    """The step that sounds at every fifth eighth of a song, from before its start to beyond its end."""
    steps = bind.steps(spark, sf_dir)
    return playback.active_step(steps, steps.select("song", (F.col("pos") * 11 - 1).cast("long").alias("eighth")))


@query
def label_durations(spark, sf_dir):
    made = playback.durations(segments(spark, sf_dir))
    return ranks.numbered(made, [], [F.desc("duration_us"), F.asc("label")], "place")


@query
def bar_classes(spark, sf_dir):
    return harmony.bar_class(analyzed(spark, sf_dir)).select("song", "number", "bar_class")


@query
def diatonic_steps(spark, sf_dir):
    """The steps that the field of each part's key makes."""
    return progressions.diatonic_steps(bind.part_keys(spark, sf_dir)).select("p_partkey", "key_root", "is_minor", "degree", "label", F.coalesce("beats", F.lit(4.0)).alias("beats"))


@query
def explained_degrees(spark, sf_dir):
    texts = spark.range(14).select((F.col("id") % 2 == 1).alias("is_minor"), F.floor(F.col("id") / 2).cast("int").alias("degree"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).where("degree <> 5")
    return progressions.explained(bind.steps(spark, sf_dir), texts).select("song", "pos", "text")


@query
def key_changes(spark, sf_dir):
    """Each nation's root, in both modes, as a new key: its field, and nothing selected."""
    keys = bind.roots(spark, sf_dir).withColumn("is_minor", F.explode(F.array(F.lit(False), F.lit(True)))).withColumnRenamed("root_note", "key_root")
    made = harmony.key_state(keys)
    return made.select("n_nationkey", "is_minor", F.array_join("field", "|").alias("field"), "selected", F.size("highlighted").alias("n_highlighted"))


@query
def selected_chords(spark, sf_dir):
    """A chord of the field selected, by index; index 7 isn't there, and some select none."""
    rows = bind.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 12).cast("int").alias("key_root"), (F.col("p_partkey") % 2 == 1).alias("is_minor"))
    made = harmony.select_chord(rows, F.when(F.col("p_partkey") % 9 < 8, (F.col("p_partkey") % 9).cast("int")))
    return made.select("p_partkey", "selected", text("highlighted").alias("highlighted"), "color")


@query
def default_scales(spark, sf_dir):
    """The scale that each part's key is heard by."""
    return bind.part_keys(spark, sf_dir).select("p_partkey", "key_root", "is_minor", text(scales.default_scale(F.col("key_root"), F.col("is_minor"))).alias("notes"))


@query
def shown_frets(spark, sf_dir):
    """Frets of each nation's root: by position for some, by note for others, and all shown for some."""
    n = F.col("n_nationkey")
    frets = bind.roots(spark, sf_dir).join(F.broadcast(scales.neck(spark).drop("highlighted")))
    at = F.when(n % 3 == 0, F.array(F.concat(F.lit("0-"), (n % 13).cast("string")), F.lit("2-4")))
    made = scales.shown_frets(frets, notes=F.array("root_note"), positions=at, show_all=n % 2 == 0)
    return made.select("n_nationkey", "string_no", "fret", "highlighted", "shown")


@query
def shortcut_keys(spark, sf_dir):
    rows = bind.roots(spark, sf_dir).withColumn("notes", F.array("root_note"))
    pressed = F.array(F.get(th.literal([k for k, _, _ in dims.KEY_MAP]), (F.col("n_nationkey") % 18).cast("int")))
    return scales.shortcuts(scales.piano(rows), pressed).select("n_nationkey", "octave", "note", "shortcut", "is_pressed")


@query
def small_labels(spark, sf_dir):
    """Interval, beat, dot and colour labels for each part."""
    key = F.col("p_partkey")
    color = F.when(key % 13 == 12, "#000000").otherwise(F.get(th.literal(dims.PALETTE), (key % 13).cast("int")))
    rows = bind.table(spark, sf_dir, "part")
    return rows.select("p_partkey", th.interval_label(key % 13, dims.INTERVAL_LABELS).alias("interval"), th.beat_label(key, dims.BEAT_LABELS).alias("beat"), th.dot_title((key % 8).cast("int")).alias("dot"), th.next_color(color, dims.PALETTE).alias("next_color"))


@query
def question_mix(spark, sf_dir):
    """A question of a mode for each seed; half of the chords to identify are of the key."""
    rows = seeds(spark, sf_dir)
    mode = F.get(th.literal(dims.QUIZ_MODES), (F.col("seed") % 4).cast("int"))
    made = quiz.questions(rows, mode, limit_to_key=F.col("seed") % 8 >= 4)
    return made.select("seed", "mode", text("notes").alias("notes"), "correct", F.array_join("options", "|").alias("options"), "tip_key")


@query
def quiz_tips(spark, sf_dir):
    """Questions on intervals with the tip of their key, where there is one."""
    made = quiz.interval_questions(seeds(spark, sf_dir)).withColumn("mode", F.lit("interval"))
    tips = spark.range(1, 11).select(F.lit("interval").alias("mode"), F.col("id").cast("string").alias("tip_key"), F.concat(F.lit("tip "), F.col("id").cast("string")).alias("tip"))
    return quiz.with_tips(made, F.broadcast(tips)).select("seed", "tip_key", "tip")


@query
def tick_stream(spark, sf_dir):
    """Playback events of a stream of ticks, two a batch, for all songs."""
    folder = shared.fresh_dir(spark, "ticks")
    playback.ticks(6, spark).select("tick").repartition(3).write.parquet(f"{folder}/in")
    ticks = spark.readStream.schema("tick long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return sessions.drained(sessions.playback(bind.steps(spark, sf_dir), ticks), f"{folder}/out")


# documents


@query
def bar_counts(spark, sf_dir):
    """How many bars each document's card shows."""
    return structures(spark, sf_dir).select("doc", F.size("bars").alias("n_bars"))


@query
def add_section(spark, sf_dir):
    made = structures(spark, sf_dir).select("doc", F.posexplode(docs.add_section("sections", F.lit("new"), F.lit("fresh"), F.lit("#112233"))).alias("place", "s"))
    return made.select("doc", "place", F.col("s.id").alias("section_id"), F.col("s.name").alias("name"), F.size("s.bar_ids").alias("n_bars"))


@query
def section_colors(spark, sf_dir):
    """The colour that each bar of a section shows: its own, or the section's."""
    made = structures(spark, sf_dir)
    bars = made.select("doc", F.explode("bars").alias("b")).select("doc", F.col("b.id").alias("bar_id"), F.col("b.color").alias("own"))
    colors = made.select("doc", F.explode("sections").alias("s")).select("doc", F.col("s.color").alias("section_color"), F.explode("s.bar_ids").alias("bar_id"))
    return bars.join(colors, ["doc", "bar_id"]).select("doc", "bar_id", layout.bar_color(F.col("own"), F.col("section_color")).alias("color"))


@query
def remove_repeated(spark, sf_dir):
    """Every section repeats the one before it; the second goes, so that the third repeats none, and the focus moves."""
    made = structure_tables(spark, sf_dir)
    placed = tabular.section_places(made.sections)
    before = placed.select("doc", (F.col("place") + 1).alias("place"), F.col("section_id").alias("repeat_of"))
    sections = placed.join(before, ["doc", "place"], "left")
    gone = placed.where("place = 1").select("doc", "section_id")
    left, _, _ = tabular.removed_sections(sections.drop("place"), made.bars, made.listings, gone)
    focused = left.join(gone.withColumnRenamed("section_id", "gone"), "doc", "left")
    wanted = F.when(F.col("doc") % 2 == 0, F.col("gone")).otherwise("other")
    return focused.select("doc", "section_id", "repeat_of", docs.focus_after(wanted, F.col("gone")).alias("focus"))


@query
def repeated_array(spark, sf_dir):
    """The same on documents in one row: the first section goes."""
    made = structures(spark, sf_dir)
    with_repeats = F.transform("sections", lambda s, i: s.withField("repeat_of", F.when(i > 0, F.col("sections")[0]["id"])))
    made = made.withColumn("sections", with_repeats)
    left = docs.remove_section("bars", "sections", nth_section(0))[1]
    return made.select("doc", F.posexplode(left).alias("place", "s")).select("doc", "place", F.col("s.id").alias("section_id"), F.col("s.repeat_of").alias("repeat_of"))


@query
def picker(spark, sf_dir):
    """A picker's root after a click, and whether there is room for a chord."""
    key = F.col("p_partkey")
    rows = bind.table(spark, sf_dir, "part")
    selected = F.when(key % 5 > 0, (key % 3).cast("int"))
    steps = F.sequence(F.lit(1), (key % 100 + 1).cast("int"))
    return rows.select("p_partkey", docs.picked(selected, (key % 4).cast("int")).alias("root"), docs.can_add(steps).alias("can_add"))


@query
def set_active_section(spark, sf_dir):
    """The active section set, as it is given, and the sections cleared or loaded."""
    made = nested_songs(spark, sf_dir)
    state = docs.opened("sections", F.col("song") % 2 == 0)
    return made.select("song", docs.with_active(state, (F.col("song") % 4).cast("int")).alias("x")).select("song", F.size("x.sections").alias("n_sections"), F.col("x.active").alias("active"))

