"""More registered queries: score files in a folder, saved tables, and a log of edits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cadenza.operators import edit_log, library
from cadenza.operators import structure_rows as tabular
from cadenza.plans import bindings as bind
from cadenza.plans.catalogue import QUERIES, archive, first_bars, query, stored, structure_tables, text
from cadenza.plans.catalogue_library import NOW, number
from cadenza.sources import gp, saved, score_files, shared

__all__ = ["QUERIES"]


@query
def score_folder(spark, sf_dir):
    """Pages as score files, every 13th of no bytes, written to a folder and read from it by the score source."""
    page = F.substring("path", 6, 20).cast("long")
    files = archive(bind.table(spark, sf_dir, "pages")).withColumn("content", F.when(page % 13 != 0, F.col("content")))
    folder = shared.fresh_dir(spark, "score-files")
    score_files.register(spark)
    files.write.format("scores").mode("append").save(folder)
    scores = shared.written(gp.scored(spark.read.format("scores").load(folder)), "scores")
    made = scores.select("path", "error", "message").join(gp.metadata(scores).select("path", "title", "n_bars"), "path", "left")
    return made.withColumn("path", F.substring_index("path", "/", -1))


@query
def device_tables(spark, sf_dir):
    """Two saved tables laid out by device and id: every third row is pushed again from the next device, and two devices are
    read afterwards."""
    run = uuid.uuid4().hex
    rows = stored(spark, sf_dir).select("id", "title", "updated_at", "device_id")
    key = number()
    pushed = rows.where(key % 3 == 0).select("id", F.concat(F.lit("pushed "), "title").alias("title"), F.lit(NOW).alias("updated_at"), F.concat(F.lit("d"), ((F.substring("device_id", 2, 9).cast("int") + 1) % 10).cast("string")).alias("device_id"))
    table = saved.save(rows, f"cadenza_songs_{run}", shared.fresh_dir(spark, "songs"))
    batch = saved.save(pushed, f"cadenza_pushed_{run}", shared.fresh_dir(spark, "pushed"))
    after = library.upsert(table, batch.withColumn("_at", F.col("updated_at")), order="_at")
    return saved.of_device(after, "d4").unionAll(saved.of_device(after, "d7"))


@query
def evolved_table(spark, sf_dir):
    """Songs saved before and after the tempo was added: 120 where a file doesn't have it, else what the row holds."""
    rows = stored(spark, sf_dir)
    path = shared.fresh_dir(spark, "generations")
    saved.add_generation(rows.where(number() % 3 == 0).select("id", "title", "updated_at"), path, 1)
    saved.add_generation(rows.where(number() % 3 != 0).select("id", "title", "bpm", "updated_at"), path, 2)
    return saved.generations(spark, path, "id string, title string, bpm int, updated_at string", {"bpm": (2, F.lit(120))})


@query
def edit_log_bars(spark, sf_dir):
    """Four edits of each document: a bar is added to the first section, the document's first bar moves to the third section,
    the first section takes the third one's place, and the second one is removed."""
    made = structure_tables(spark, sf_dir)
    at = [F.max(F.when(F.col("place") == k, F.col("section_id"))).alias(name) for k, name in enumerate(("one", "two", "three"))]
    heads = shared.written(tabular.section_places(made.sections).where("place < 3").groupBy("doc").agg(*at), "heads")
    one, two, three = (heads.where(f"{name} is not null").select("doc", F.col(name).alias("section_id")) for name in ("one", "two", "three"))
    edit = lambda rows, seq, op, bar="cast(null as string)", over="cast(null as string)": rows.selectExpr("doc", f"{seq}L as seq", f"'{op}' as op", "section_id", f"{bar} as bar_id", f"{over} as over")
    log = edit(one, 1, "add_bar", bar="'added'")
    log = log.unionByName(edit(three.join(first_bars(spark, sf_dir), "doc"), 2, "move_bar", bar="bar_id"))
    log = log.unionByName(edit(one.join(three.withColumnRenamed("section_id", "third"), "doc"), 3, "reorder", over="third"))
    log = shared.written(log.unionByName(edit(two, 4, "remove_section")), "log")
    new = one.selectExpr("doc", "'added' as bar_id", "'6/8' as time_signature", "cast(null as array<int>) as accents")
    return edit_log.numbered(made.sections, made.placed, log, new_bars=new).select("doc", "bar_id", "bar_index", "time_signature", text("accents").alias("accents"))
