"""Other inputs and the outputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.playback import segment_lines

PLAYLIST = "release_date string, name string, popularity int, artists string"


def read_playlist(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of tracks; the artists are a list in one field."""
    raw = spark.read.csv(path, header=True, schema=PLAYLIST, multiLine=True, escape='"')
    return raw.withColumn("artists", F.transform(F.split("artists", ","), lambda a: F.trim(a)))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Label segments from tab-separated lines of start, end (seconds) and label."""
    raw = spark.read.csv(path, sep="\t", schema="start double, end double, label string")
    micros = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return raw.select(micros("start").alias("start_us"), micros("end").alias("end_us"), "label")


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The other copy's rows; one that can't be found has none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def laid_out(labels: DataFrame, place: Column, seconds: float) -> DataFrame:
    """Rows one after another, each as long: with start_us and end_us by their ``place`` from 0 in their song."""
    long_ = int(seconds * 1_000_000)
    at = place.cast("long")
    return labels.withColumns({"start_us": at * long_, "end_us": (at + 1) * long_})


def synthetic_segments(spark: SparkSession, labels: list[str], seconds: float) -> DataFrame:
    """Labels one after another, each as long."""
    each = spark.createDataFrame([(labels,)], "labels array<string>").select(F.posexplode("labels").alias("n", "label"))
    return laid_out(each, F.col("n"), seconds).select("start_us", "end_us", "label")


def write_segments(segments: DataFrame, path: str) -> None:
    segment_lines(segments.orderBy("start_us")).write.mode("overwrite").text(path)


def write_pitches(pitches: DataFrame, path: str) -> None:
    pitches.write.mode("overwrite").json(path)


def write_chords(matched: DataFrame, path: str) -> None:
    """Matched bars as JSON lines; fields that a bar's kind doesn't have are left out."""
    matched.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def save(table: DataFrame, path: str) -> None:
    """The new state of a table beside the old one; the path is a fresh folder that the caller then points to, as a
    table that is being read can't be overwritten."""
    table.write.mode("errorifexists").parquet(path)


def push_rows(table: DataFrame, device: str) -> DataFrame:
    """Rows as the remote store takes them: one JSON text each, booleans as 0 and 1, with the device."""
    cols = [F.col(f.name).cast("int").alias(f.name) if f.dataType.simpleString() == "boolean" else F.col(f.name) for f in table.schema]
    return table.select(F.to_json(F.struct(*cols, F.lit(device).alias("device_id")), {"ignoreNullFields": "false"}).alias("value"))


def push_deletes(keys: DataFrame, device: str) -> DataFrame:
    """The ids to delete remotely, one JSON text each, with the device."""
    return keys.select(F.to_json(F.struct("id", F.lit(device).alias("device_id"))).alias("value"))


def read_pitches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("song long, bar int, track string, pitches array<int>").json(path)


def read_chords(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("song long, bar int, kind string, root_pc int, quality string, intervals array<int>").json(path)


def with_setting(rows: DataFrame, settings: DataFrame, name: str, default: str) -> DataFrame:
    """Rows (device_id) with a scalar setting (device_id, name, value) of their device; the default where it has none."""
    known = settings.where(F.col("name") == name).select("device_id", F.col("value").alias(name))
    return rows.join(known, "device_id", "left").withColumn(name, F.coalesce(name, F.lit(default)))
