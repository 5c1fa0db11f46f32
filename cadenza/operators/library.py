"""The library: listings, point reads, upserts, partial updates, deletes, and synchronising two copies.

Tables are DataFrames keyed by ``id``; every change is one set-based join instead of a statement a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza import dims
from cadenza.operators.documents import STEP, migrated

PROGRESSION = "id string, name string, description string, steps string, mode string, preset_id string, bpm int, is_example int, created_at string"
SONG = "id string, title string, artist string, key_note int, mode string, original_bpm int, preset_id string, sections string, created_at string, updated_at string"
STRUCTURE = "id string, title string, artist string, bpm int, bars string, sections string, created_at string, updated_at string"


def examples(spark: SparkSession, created_at: str) -> DataFrame:
    """The seven seed progressions as stored rows, steps as JSON that keeps a null degree and drops absent fields."""
    rows = [(i, n, d, [tuple(s) for s in steps], mode, preset, bpm, 1, created_at) for i, n, d, mode, preset, bpm, steps in dims.EXAMPLES]
    kind = "array<struct<degree:int,label:string,intervals:array<int>,offsetEighths:int>>"
    raw = spark.createDataFrame(rows, f"id string, name string, description string, steps {kind}, mode string, preset_id string, bpm int, is_example int, created_at string")
    return raw.withColumn("steps", steps_json(F.col("steps"), {"intervals": "intervals", "offsetEighths": "offsetEighths"}))


def steps_json(steps: Column, optional: dict[str, str]) -> Column:
    """Steps as JSON text: degree is always written, even null; other fields only where they have a value."""

    def one(s: Column) -> Column:
        degree = F.concat(F.lit('"degree":'), F.coalesce(s["degree"].cast("string"), F.lit("null")))
        rest = F.to_json(F.struct(s["label"].alias("label"), *(s[f].alias(n) for f, n in optional.items())))
        return F.concat(F.lit("{"), degree, F.lit(","), F.substring(rest, 2, 1 << 30))

    return F.concat(F.lit("["), F.array_join(F.transform(steps, one), ","), F.lit("]"))


def seeded(table: DataFrame, created_at: str) -> DataFrame:
    """The table with the examples, if it has none."""
    n = table.where("is_example = 1").limit(1).count()
    return table if n else table.unionByName(examples(table.sparkSession, created_at))


def conformed(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` with the columns and types of a stored table; columns that they don't have are null, others go."""
    fields = [field.split() for field in kind.split(", ")]
    return rows.select(*((F.col(name) if name in rows.columns else F.lit(None)).cast(type_).alias(name) for name, type_ in fields))


def decoded(progressions: DataFrame) -> DataFrame:
    """Stored progressions with steps parsed (malformed JSON fails) and is_example as a boolean."""
    kind = STEP.replace("offset_eighths", "offsetEighths")
    return progressions.withColumn("steps", F.from_json("steps", f"array<{kind}>", {"mode": "FAILFAST"})).withColumn("is_example", F.col("is_example") == 1)


def by_example() -> list[Column]:
    """Examples first, then by creation; equal times by id."""
    return [F.desc("is_example"), F.asc("created_at"), F.asc("id")]


def by_update() -> list[Column]:
    """Last updated first; equal times by id."""
    return [F.desc("updated_at"), F.asc("id")]


def list_progressions(table: DataFrame, mode: str | None = None) -> DataFrame:
    chosen = table if mode is None else table.where(F.col("mode") == mode)
    return chosen.orderBy(*by_example())


def list_recent(table: DataFrame) -> DataFrame:
    """Songs or structures."""
    return table.orderBy(*by_update())


def structures_read(table: DataFrame) -> DataFrame:
    """A missing or zero tempo reads as 120."""
    return table.withColumn("bpm", F.coalesce(F.nullif(F.col("bpm"), F.lit(0)), F.lit(120)))


def list_structures(table: DataFrame, orphans_id: Column) -> DataFrame:
    """Stored structures, last updated first, as they are read: tempo, and sections of the old shape migrated."""
    return list_recent(structures_read(table)).withColumn("sections", migrated("bars", "sections", orphans_id))


def split_examples(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(examples, the user's own)."""
    return table.where("is_example = 1"), table.where("is_example <> 1")


def with_defaults(batch: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Fields that a record leaves out (null) take their defaults."""
    return batch.withColumns({name: F.coalesce(F.col(name), value) for name, value in defaults.items() if name in batch.columns})


def defaults(now: Column) -> dict[str, Column]:
    """What the remote store fills in."""
    return {"description": F.lit(""), "artist": F.lit(""), "preset_id": F.lit(dims.DEFAULT_PRESET), "bpm": F.lit(120), "is_example": F.lit(0), "created_at": now, "updated_at": now}


def new_id(*parts: Column) -> Column:
    """An id that depends on the parts only, so that a task which runs again gives the same."""
    digits = F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
    return F.concat_ws("-", *(F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def inserted(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with the rows appended, and the rows as they read back."""
    after = table.unionByName(rows)
    return after, after.join(rows.select("id"), "id", "left_semi")


def with_preset(rows: DataFrame, presets: DataFrame, default: str = dims.DEFAULT_PRESET) -> DataFrame:
    """Rows with the preset that they name, or the default one where they name none that is known."""
    known = presets.select(F.col("preset_id").alias("_known"))
    joined = rows.join(F.broadcast(known), F.col("preset_id") == F.col("_known"), "left")  # a fixed list
    return joined.withColumn("preset", F.coalesce("_known", F.lit(default))).drop("_known")


def by_id(table: DataFrame, key: str) -> DataFrame:
    return table.where(F.col("id") == key)


def by_device(table: DataFrame, device: str | None) -> DataFrame:
    """A device's rows; without a device, all."""
    return table if device is None else table.where(F.col("device_id") == device)


def upsert(table: DataFrame, batch: DataFrame, *, order: str) -> DataFrame:
    """Rows of the batch replace those with their id; of several in the batch the last by ``order`` counts."""
    last = batch.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(order)))).where("_n = 1").drop("_n", order)
    return table.join(last, "id", "left_anti").unionByName(last)


def partial_update(table: DataFrame, patches: DataFrame, fields: list[str], *, now: Column) -> DataFrame:
    """One patch row an id at most: a ``set_<field>`` flag says whether the field is provided, so null can be set.
    updated_at changes only where something is provided."""
    provided = F.lit(False)
    for f in fields:
        provided = provided | F.coalesce(F.col(f"set_{f}"), F.lit(False))
    renamed = patches.select(F.col("id").alias("_id"), *(F.col(f).alias(f"new_{f}") for f in fields), *(f"set_{f}" for f in fields))
    joined = table.join(renamed, F.col("id") == F.col("_id"), "left")
    new = {f: F.when(F.coalesce(F.col(f"set_{f}"), F.lit(False)), F.col(f"new_{f}")).otherwise(F.col(f)) for f in fields}
    new["updated_at"] = F.when(provided, now).otherwise(F.col("updated_at"))
    return joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in table.columns))


def delete(table: DataFrame, keys: DataFrame, on: list[str], *, guard: Column | None = None) -> DataFrame:
    """Rows with a key in ``keys`` go, unless ``guard`` protects them."""
    if guard is None:
        return table.join(keys, on, "left_anti")
    return table.where(guard).unionByName(table.where(~guard).join(keys, on, "left_anti"))


def merge_union(local: DataFrame, cloud: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(only in the cloud, only local), by id."""
    return cloud.join(local, "id", "left_anti"), local.join(cloud, "id", "left_anti")


def merge_last_write_wins(local: DataFrame, cloud: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cloud rows to apply, local rows to push). Times are compared as text; a local row is pushed only if the cloud
    lacks it."""
    mine = local.select("id", F.col("updated_at").alias("_mine"))
    apply = cloud.join(mine, "id", "left").where(F.col("_mine").isNull() | (F.col("updated_at") > F.col("_mine"))).drop("_mine")
    return apply, local.join(cloud, "id", "left_anti")


def synchronised(local: DataFrame, cloud: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The local table after applying, and the rows to push."""
    apply, push = merge_last_write_wins(local, cloud)
    return local.join(apply, "id", "left_anti").unionByName(apply), push


def sync_all(progressions: tuple[DataFrame, DataFrame], songs: tuple[DataFrame, DataFrame], structures: tuple[DataFrame, DataFrame]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Each collection's (local, cloud) to its (local table after, rows to push): a union for progressions, the last write
    wins for songs and structures. Committing all three tables is one step; see ``sources.store``."""
    local, cloud = progressions
    cloud_only, local_only = merge_union(local, cloud)
    return {"progressions": (local.unionByName(cloud_only), local_only), "songs": synchronised(*songs), "structures": synchronised(*structures)}


def valid(table: DataFrame) -> DataFrame:
    """Rows that the stored table's constraints allow."""
    return table.where(F.col("id").isNotNull() & F.col("mode").isin("major", "minor"))


def can_save(title: Column, content: Column) -> Column:
    return (F.trim(F.coalesce(title, F.lit(""))) != "") & (F.size(content) > 0)


def changed(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """Ids of which any field differs; nulls are equal to each other."""
    other = b.select(F.col("id").alias("_id"), *(F.col(f).alias(f"_{f}") for f in fields))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return a.join(other, F.col("id") == F.col("_id")).where(~same).select("id")


def import_title(title: Column, file_name: Column, fallback: str) -> Column:
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(blank(title), blank(F.regexp_replace(file_name, r"(?i)\.gp$", "")), F.lit(fallback))
