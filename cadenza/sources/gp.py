"""Guitar Pro scores (zip files that hold ``Content/score.gpif``) as DataFrames.

Files are read with Spark's binaryFile source. What the container is, the XML and the score's graph of bars, voices,
beats and notes are DataFrame expressions and joins by id; only unzipping one entry is Python, in Arrow batches.
"""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza import dims
from cadenza.functions import theory as th

ENTRY = "Content/score.gpif"
PROPERTY = "STRUCT<_name:STRING,Number:STRING,Items:STRUCT<Item:ARRAY<STRING>>>"
SCORE = f"""GPVersion STRING, Score STRUCT<Title:STRING,Artist:STRING>,
Tracks STRUCT<Track:ARRAY<STRUCT<_id:STRING,Name:STRING,Staves:STRUCT<Staff:ARRAY<STRUCT<Properties:STRUCT<Property:ARRAY<{PROPERTY}>>>>>>>>,
MasterBars STRUCT<MasterBar:ARRAY<STRUCT<Time:STRING,Bars:STRING>>>,
Bars STRUCT<Bar:ARRAY<STRUCT<_id:STRING,Voices:STRING>>>,
Voices STRUCT<Voice:ARRAY<STRUCT<_id:STRING,Beats:STRING>>>,
Beats STRUCT<Beat:ARRAY<STRUCT<_id:STRING,Notes:STRING,Chord:STRING>>>,
Notes STRUCT<Note:ARRAY<STRUCT<_id:STRING,Properties:STRUCT<Property:ARRAY<{PROPERTY}>>>>>"""


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content). Spark's reader leaves files of no bytes out."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def container_error(content: Column) -> Column:
    """Why a file can't be a score, from its first bytes; null if it may be one."""
    magic = F.hex(F.substring(content, 1, 4))
    head = F.decode(F.substring(content, 1, 64), "ISO-8859-1")
    return F.when(magic.isin("4243465A", "42434653"), "gpx-container").when(F.contains(head, F.lit("FICHIER GUITAR PRO")), "legacy-binary").when(~magic.eqNullSafe("504B0304"), "not-a-zip")


def entry(data: bytes) -> tuple[str | None, str | None]:
    """(error, xml) of a zip file's score."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return (None, z.read(ENTRY).decode("utf-8", "replace")) if ENTRY in z.namelist() else ("not-a-gp-file", None)
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError):
        return "corrupt", None


def entry_of(data: bytes) -> tuple[str | None, str | None]:
    """(error, xml) of any file, its first bytes looked at as ``container_error`` does."""
    if data[:4] in (b"BCFZ", b"BCFS"):
        return "gpx-container", None
    if b"FICHIER GUITAR PRO" in data[:64]:
        return "legacy-binary", None
    return entry(data) if data[:4] == b"PK\x03\x04" else ("not-a-zip", None)


@F.pandas_udf(T.StructType([T.StructField("error", T.StringType()), T.StructField("xml", T.StringType())]))
def unzipped(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([entry(data) for data in content], columns=["error", "xml"])


def zipped(entries: dict[str, str]) -> bytes:
    """A zip file of the entries."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return buffer.getvalue()


def parsed(files: DataFrame) -> DataFrame:
    """(path, error, message, score): error is null where score is read."""
    first = files.withColumn("_why", container_error(F.col("content")))
    open_ = first.withColumn("_entry", F.when(F.col("_why").isNull(), unzipped(F.when(F.col("_why").isNull(), F.col("content")).otherwise(F.lit(b"")))))
    return scored(open_.select("path", F.coalesce("_why", "_entry.error").alias("error"), F.col("_entry.xml").alias("xml")))


def scored(entries: DataFrame) -> DataFrame:
    """(path, error, message, score) of entries (path, error, xml)."""
    rooted = F.regexp_like(F.coalesce("xml", F.lit("")), F.lit(r"(?s)<GPIF[\s>].*</GPIF>\s*$"))
    score = F.from_xml(F.when(rooted, F.col("xml")), SCORE, {"mode": "PERMISSIVE"})
    read = entries.withColumn("score", score)
    error = F.coalesce("error", F.when(~rooted | F.col("score").isNull() | F.col("score.GPVersion").isNull() & F.col("score.MasterBars").isNull(), "corrupt"))
    read = read.withColumn("error", error)
    message = F.coalesce(*(F.when(F.col("error") == k, F.lit(m)) for k, m in dims.GP_ERRORS.items()))
    return read.select("path", "error", message.alias("message"), F.when(F.col("error").isNull(), F.col("score")).alias("score"))


def trimmed(x: Column) -> Column:
    return F.trim(F.coalesce(x.cast("string"), F.lit("")))


def has_chords(score: Column) -> Column:
    """Whether the author wrote chords: a chord or diagram collection with items, or a beat with a chord."""
    named = lambda p: p["_name"].isin("ChordCollection", "DiagramCollection") & (F.size(p["Items"]["Item"]) > 0)
    staff = lambda s: F.coalesce(F.exists(s["Properties"]["Property"], named), F.lit(False))
    track = lambda t: F.coalesce(F.exists(t["Staves"]["Staff"], staff), F.lit(False))
    beat = F.exists(score["Beats"]["Beat"], lambda b: b["Chord"].isNotNull())
    return F.coalesce(F.exists(score["Tracks"]["Track"], track), F.lit(False)) | F.coalesce(beat, F.lit(False))


def metadata(scores: DataFrame) -> DataFrame:
    good = scores.where("error is null")
    s = F.col("score")
    bars = F.coalesce(F.size(s["MasterBars"]["MasterBar"]), F.lit(0))
    tracks = F.coalesce(F.transform(s["Tracks"]["Track"], lambda t: t["Name"]), F.array().cast("array<string>"))
    return good.select("path", s["GPVersion"].alias("version"), trimmed(s["Score"]["Title"]).alias("title"), trimmed(s["Score"]["Artist"]).alias("artist"), tracks.alias("tracks"), F.greatest(bars, F.lit(0)).alias("n_bars"), has_chords(s).alias("has_chords"))


def master_bars(scores: DataFrame) -> DataFrame:
    """(path, bar, time_signature, quarter_beats, bar_ids)."""
    each = scores.where("error is null").select("path", F.posexplode("score.MasterBars.MasterBar").alias("bar", "m"))
    signature = F.trim(F.coalesce("m.Time", F.lit("4/4")))
    return each.select("path", "bar", signature.alias("time_signature"), th.signature_beats(F.col("m.Time")).alias("quarter_beats"), split(F.col("m.Bars")).alias("bar_ids"))


def split(ids: Column) -> Column:
    return F.split(F.trim(ids), r"\s+")


def _nodes(scores: DataFrame, group: str, item: str, value: Column, name: str) -> DataFrame:
    """(path, <name>_id, value) of a group; of equal ids the last counts."""
    each = scores.where("error is null").select("path", F.posexplode(f"score.{group}.{item}").alias("n", "x"))
    return each.groupBy("path", F.col("x._id").alias(f"{name}_id")).agg(F.max_by(value, "n").alias("value"))


def bar_pitches(scores: DataFrame) -> DataFrame:
    """(path, bar, track_index, track, pitches) of every bar and track, silent ones too; pitches sorted and distinct.

    All joins are by sorted shuffles: Spark takes the size of exploded nodes from the file of scores, which is far smaller.
    """
    each = scores.where("error is null").select("path", F.posexplode("score.MasterBars.MasterBar").alias("bar", "m"), F.col("score.Tracks.Track").alias("tracks"))
    grid = each.select("path", "bar", split(F.col("m.Bars")).alias("bar_ids"), F.posexplode("tracks").alias("track_index", "t"))
    grid = grid.select("path", "bar", "track_index", F.col("t.Name").alias("track"), F.get("bar_ids", F.col("track_index")).alias("bar_id"))
    bars = _nodes(scores, "Bars", "Bar", F.col("x.Voices"), "bar").where(F.trim("value") != "-1")
    voices = _nodes(scores, "Voices", "Voice", F.col("x.Beats"), "voice")
    beats = _nodes(scores, "Beats", "Beat", F.col("x.Notes"), "beat")
    midi = F.get(F.filter("x.Properties.Property", lambda p: p["_name"] == "Midi"), F.lit(0))["Number"].try_cast("int")
    notes = _nodes(scores, "Notes", "Note", midi, "note").where("value is not null").withColumnRenamed("value", "midi")
    walk = grid.join(bars.hint("merge"), ["path", "bar_id"]).select("path", "bar", "track_index", F.explode(split(F.col("value"))).alias("voice_id"))
    walk = walk.join(voices.hint("merge"), ["path", "voice_id"]).where("value is not null").select("path", "bar", "track_index", F.explode(split(F.col("value"))).alias("beat_id"))
    walk = walk.join(beats.hint("merge"), ["path", "beat_id"]).where("value is not null").select("path", "bar", "track_index", F.explode(split(F.col("value"))).alias("note_id"))
    found = walk.join(notes.hint("merge"), ["path", "note_id"]).groupBy("path", "bar", "track_index").agg(F.array_sort(F.collect_set("midi")).alias("pitches"))
    out = grid.join(found.hint("merge"), ["path", "bar", "track_index"], "left")
    return out.select("path", "bar", "track_index", "track", F.coalesce("pitches", F.array().cast("array<int>")).alias("pitches"))


def bars_for(scores: DataFrame, harmony_track: str, root_track: str) -> DataFrame:
    """Bars of each file for the matcher: (song, bar, harmony, root, quarter_beats). Of tracks of one name the last
    counts; a track that isn't there is silent."""
    tracks, none = {"harmony": harmony_track, "root": root_track}, F.array().cast("array<int>")
    last = lambda t: F.max_by("pitches", F.when(F.col("track") == t, F.col("track_index")))
    own = bar_pitches(scores).where(F.col("track").isin(*tracks.values())).groupBy("path", "bar").agg(*(last(t).alias(name) for name, t in tracks.items()))
    out = master_bars(scores).select("path", "bar", "quarter_beats").join(own.hint("merge"), ["path", "bar"], "left")
    return out.withColumns({name: F.coalesce(name, none) for name in tracks}).withColumnRenamed("path", "song")
