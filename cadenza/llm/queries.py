"""The registered queries of this subpackage: each applies one operator to its whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import alignment, bpe, centroids, language, mixing, neighbours, packing, quality_pu, quality_rules, sharding, simhash, urls, warc
from cadenza.llm._work import TEXTS, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = {"com/": urls.ALLOW, "example.com/en/": urls.BLOCK, "www.example.com/en/": urls.ALLOW, "net/es/": urls.BLOCK, "net/fr/": urls.BLOCK}


def op1_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES, urls.fit(urls.labelled_by_rules(pages, URL_RULES)))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pieces(docs)
    placed = packing.place(pieces.drop("ids"), pieces)
    return placed.select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op3_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = warc.build(warc.write(pages, least=0))
    found = warc.lookup(pages.select(warc.url_key(F.col("url")).alias("url_key")), index)
    return warc.read(found, index.captures, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_bitmask_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs)).select("row.doc_id", "lang_pred", "score")
    return written(found, "languages", batches=TEXTS).withColumn("held_out", language.held_out())


def op6_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.totals(mixing.mix(table(spark, sf_dir, "documents"))).withColumnRenamed("key", "doc_id")


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_pu.score(docs, quality_pu.fit(docs, table(spark, sf_dir, "labels")))


def op8_hashed_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, model).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return written(judged, "judged", batches=TEXTS)


def op10_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.linked(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, nearest_rows=10)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    found = alignment.aligned(table(spark, sf_dir, "documents")).withColumn("groups_sha256", digest).drop("groups")
    found = written(found, "aligned", batches=TEXTS)
    return alignment.counted(found, alignment.pair_counts(found)).withColumnRenamed("key", "doc_id")


def op12_weighted_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def ids_sha256(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids column replaced by how many there are and the digest of the ids as little-endian unsigned 32-bit numbers."""
    for batch in batches:
        ids = batch.column("ids")
        data, bounds = ids.values.to_numpy().astype("<u4").data.cast("B"), ids.offsets.to_numpy()
        digests = [hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        rest = [c for c in batch.schema.names if c != "ids"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(np.diff(bounds).astype(np.int64)), pa.array(digests, pa.string())], [*rest, "n_tokens", "ids_sha256"])


def op13_batched_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents")))
    kind = tokens.schema["key"].dataType.simpleString()
    digest = F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    found = tokens.select("key", "ids", digest).mapInArrow(ids_sha256, f"key {kind}, decoded_sha256 string, n_tokens long, ids_sha256 string")
    return written(found, "tokens", batches=TEXTS).withColumnRenamed("key", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_boosted_url_filter": op1_boosted_url_filter,
    "op2_minimum_slack_packing": op2_minimum_slack_packing,
    "op3_warc_capture_index": op3_warc_capture_index,
    "op4_jump_sharding": op4_jump_sharding,
    "op5_bitmask_language": op5_bitmask_language,
    "op6_golden_mix": op6_golden_mix,
    "op7_pu_quality": op7_pu_quality,
    "op8_hashed_quality_rules": op8_hashed_quality_rules,
    "op9_hilbert_neighbours": op9_hilbert_neighbours,
    "op10_simhash_tiles": op10_simhash_tiles,
    "op11_token_alignment": op11_token_alignment,
    "op12_weighted_centroids": op12_weighted_centroids,
    "op13_batched_bpe": op13_batched_bpe,
}

OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT page_id, strlen(body) AS payload_bytes, hex, CAST(CAST(unhex(hex) AS BIT) AS VARCHAR) AS bits, min(page_id) OVER (PARTITION BY hex) AS first FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_reduce(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER)), lambda x, y: x + y) AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""



def _lloyd_sql(rounds: int = centroids.ROUNDS, k: int = centroids.CENTROIDS, dims: int = centroids.DIMS) -> str:
    """Each round: (a) the nearest centroid of each vector, packed as distance * k + number; (c) the new centroids."""

    def assigned(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(q) AS q, min({k} * list_sum(list_transform(range(1, {dims + 1}), lambda i: (q[i] - m[i]) * (q[i] - m[i])))::BIGINT + c) AS near
  FROM v, c{n} GROUP BY rid
)"""

    def moved(n: int) -> str:
        return f"""s{n} AS (
  SELECT near % {k} AS c, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{n - 1}, range(1, {dims + 1}) AS t(i) GROUP BY ALL
), c{n} AS MATERIALIZED (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{n} GROUP BY c
  UNION ALL SELECT c, m FROM c{n - 1} WHERE c NOT IN (SELECT c FROM s{n})
)"""

    steps = ", ".join([assigned(0)] + [f"{moved(n)}, {assigned(n)}" for n in range(1, rounds + 1)])
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY hash, q) - 1 AS c, q AS m FROM (SELECT sha256('{centroids.SEED}:' || vec_id) AS hash, q FROM v WHERE vec_id IS NOT NULL ORDER BY hash, q LIMIT {k})
), {steps}, d AS (SELECT vec_id, CAST(near % {k} AS INTEGER) AS cluster, near // {k} AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM d JOIN c{rounds} ON c = cluster
"""


OP12_SQL = _lloyd_sql()

#: The others train models, tokenize, or hash in ways that SQL has no functions for; tests hold them against brute force.
ORACLES: dict[str, str] = {"op3_warc_capture_index": OP3_SQL, "op9_hilbert_neighbours": OP9_SQL, "op12_weighted_centroids": OP12_SQL}
