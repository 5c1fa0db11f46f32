"""How the driver's tables stand for music. The mapping is this engine's own; no table holds real notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza import dims
from cadenza.functions import theory as th

#: Unique where (l_orderkey, l_linenumber) isn't.
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lineitem row is a bar of the song of its supplier: song, bar, harmony, root, quarter_beats, key_root, is_minor."""
    line = table(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_suppkey", "l_returnflag", "l_quantity")
    pk, ln, flag = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_returnflag")
    template = F.get(F.array(*(th.literal(t[1]) for t in dims.TEMPLATES)), ((pk * 7 + ln) % 18).cast("int"))
    tuned = F.transform(template, lambda i: (i + 48 + pk % 12).cast("int"))
    loose = F.array((40 + (pk * ln * 5) % 30).cast("int"), (41 + (pk * ln * 11) % 30).cast("int"))
    none = F.array().cast("array<int>")
    low = (24 + (pk + F.when(ln == 7, 1).otherwise(0)) % 12).cast("int")
    root = F.when((flag == "N") & (ln == 4), F.array(low, (31 + pk % 12).cast("int"))).when(flag == "N", F.array(low)).when(flag == "R", F.array((24 + (pk + ln) % 12).cast("int"))).otherwise(none)
    song = F.col("l_suppkey")
    nth = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*LINE_ORDER)) - 1
    return line.select(
        song.alias("song"),
        nth.alias("bar"),
        F.when(ln == 4, none).when(flag == "R", loose).otherwise(tuned).alias("harmony"),
        root.alias("root"),
        (F.col("l_quantity") / 6).alias("quarter_beats"),
        (song % 12).cast("int").alias("key_root"),
        (F.floor(song / 12) % 2 == 1).alias("is_minor"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lineitem row is a step of the song of its order: degree (or null and intervals), beats, offset, confidence."""
    line = table(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_quantity", "l_returnflag")
    pk, song = F.col("l_partkey"), F.col("l_orderkey")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1
    degree = F.when(pk % 9 < 7, (pk % 9).cast("int"))
    return line.select(
        song.alias("song"),
        nth.alias("pos"),
        (F.floor(nth / 4)).cast("int").alias("section"),
        degree.alias("degree"),
        F.when(degree.isNotNull(), F.concat(F.lit("g"), degree.cast("string"))).otherwise(F.concat(F.lit("x"), (pk % 12).cast("string"))).alias("label"),
        F.when(degree.isNull(), th.transposed(pk, F.array(F.lit(0), F.lit(4), F.lit(7)))).alias("intervals"),
        F.when(F.col("l_quantity") != 24, th.clamp_step_beats(F.col("l_quantity") / 6)).alias("beats"),
        ((pk % 5) - 2).cast("int").alias("offset_eighths"),
        F.when(F.col("l_returnflag") == "R", "unsure").when(F.col("l_returnflag") == "N", "sure").alias("confidence"),
        (song % 12).cast("int").alias("key_root"),
        (F.floor(song / 12) % 2 == 1).alias("is_minor"),
    )


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation is a root note."""
    return table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 12).cast("int").alias("root_note"))


def chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is a chord on a root in a key."""
    kind = F.get(th.literal([t[0] for t in dims.CHORD_TYPES]), (F.col("p_size") % 9).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 12).cast("int").alias("root_note"), kind.alias("type_id"), F.pmod(F.floor(F.col("p_partkey") / 12), F.lit(12)).cast("int").alias("key_root"))


def part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is a key: p_partkey, key_root, is_minor."""
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", (n % 12).cast("int").alias("key_root"), (F.floor(n / 12) % 2 == 1).alias("is_minor"))


def local_and_cloud(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two copies of a library of orders: ids, titles and timestamps in the two text formats."""
    orders = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    at = lambda n: F.col("o_orderdate") + F.make_interval(hours=(cust % n).cast("int"))
    sql = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    iso = F.concat(F.date_format(at(7), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))
    local = orders.where(key % 3 != 0).select(F.concat(F.lit("s"), key.cast("string")).alias("id"), F.concat(F.lit("local "), cust.cast("string")).alias("title"), sql(at(5)).alias("updated_at"), (key % 2 == 0).alias("is_example"), F.col("o_orderpriority").alias("artist"))
    cloud = orders.where(key % 4 != 0).select(F.concat(F.lit("s"), key.cast("string")).alias("id"), F.concat(F.lit("cloud "), cust.cast("string")).alias("title"), F.when(key % 2 == 0, iso).otherwise(sql(at(7))).alias("updated_at"), (key % 2 == 0).alias("is_example"), F.col("o_orderpriority").alias("artist"))
    return local, cloud
