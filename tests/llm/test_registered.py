"""Each registered query on small tables: its columns, their types, and what its contract fixes."""

import re
import zlib

import pytest

from cadenza.llm import queries
from tests.llm.conftest import prose

COLUMNS = {
    "op1_boosted_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op2_minimum_slack_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3_warc_capture_index": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op4_jump_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op5_bitmask_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_golden_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op7_pu_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_hashed_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9_hilbert_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op10_simhash_tiles": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op11_token_alignment": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
    "op12_weighted_centroids": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
    "op13_batched_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, prose(i, 90 if i % 5 else 20, "lo mi ra" if i % 2 else "vös nir æl"), ("aa", "bb")[i % 2], f"s{i % 3}") for i in range(120)]
    docs += [(200 + i, docs[0][1], "aa", None) for i in range(9)] + [(300, None, None, None), (301, "", "aa", "s1")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(i, f"http://www.h{i % 4}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'es')[i % 2]}/{i}", f"<p>{i % 50}</p>") for i in range(150)] + [(900, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    vectors = [(i, [float(i % 7), float(i % 11), float(i % 13) + 1]) for i in range(300)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_a_registered_query(spark, folder, name):
    got = queries.QUERIES[name](spark, folder)
    kinds = {f.name: f.dataType.simpleString() for f in got.schema}
    assert COLUMNS[name].items() <= kinds.items()
    rows = got.collect()
    docs, pages = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/pages.parquet")
    if name in ("op1_boosted_url_filter", "op3_warc_capture_index"):
        assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in pages.collect())
    elif name == "op9_hilbert_neighbours":
        assert len(rows) == 30 and {r.query_id for r in rows} == {0, 100, 200}
    elif name == "op12_weighted_centroids":
        assert not rows  # these vectors have three components
    elif name != "op2_minimum_slack_packing":
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    if "held_out" in kinds:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    if name == "op10_simhash_tiles":
        assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in rows)
        assert {r.component_id for r in rows if r.doc_id in (0, 205)} == {0}
    if name == "op4_jump_sharding":
        assert {r.law for r in rows} == {"key"} and all(r.grown_shard in (r.shard, 16) for r in rows)


def test_every_query_is_described():
    assert set(COLUMNS) == set(queries.QUERIES)
