"""Centroid clustering: against the same rounds in plain integers, and the registered query against its SQL."""

import hashlib
import math
import random

import duckdb
import pytest

from cadenza.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, label int, q string, weight long, cluster int, key string"


def rows(n: int, copies: int) -> list[tuple]:
    rng = random.Random(7)
    vectors = [[rng.gauss(0, 0.3) for _ in range(64)] for _ in range(n)]
    found = [(i, v) for i, v in enumerate(vectors)] + [(n + i, vectors[3]) for i in range(copies)]
    found += [(5, vectors[9]), (5, vectors[9]), (None, vectors[2]), (9000, None), (9001, [0.5] * 63), (9002, [0.5] * 63 + [None]), (9003, [0.5] * 63 + [math.nan]), (9004, [0.5] * 63 + [math.inf]), (9005, [0.0] * 64), (9006, []), (9007, [3e38] * 64)]
    return [(i, v, 1, "own", 3, 7, "own") for i, v in found]


def brute(table: list[tuple]) -> list[tuple]:
    import numpy as np

    kept = []
    for i, v, *_ in table:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v) and abs(v[0]) < 1e30:
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centres = [q for _, q in order[:16]]

    def near(q):
        return min((sum((x - y) ** 2 for x, y in zip(q, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(3):
        mine = [near(q)[1] for _, q in kept]
        for n in range(len(centres)):
            if own := [q for (_, q), m in zip(kept, mine, strict=True) if m == n]:
                centres[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(i, *near(q)) for i, q in kept]
    total = {n: sum(d for _, d, m in last if m == n) for n in range(len(centres))}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), m, d, total[m], sum(total.values()), digests[m]) for i, d, m in last)


NAMES = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def shown(found) -> list[tuple]:
    return sorted((str(r["vec_id"]), *(r[c] for c in NAMES)) for r in found)


@pytest.mark.parametrize(("n", "copies"), [(300, 200), (10, 0), (40, 1500)])
def test_clusters_equal_brute_force(spark, n, copies):
    table = rows(n, copies)
    got = centroids.cluster(spark.createDataFrame(table, SCHEMA).repartition(3)).collect()
    assert shown(got) == brute(table)
    assert all(hashlib.sha256(",".join(map(str, r.centroid)).encode()).hexdigest() == r.centroid_sha256 for r in got)


def test_a_centroid_without_vectors_stays(spark):
    """Equal starts: all vectors go to the smaller number, so the other keeps its place."""
    table = [(i, [1.0] * 64, 1, "", 1, 1, "") for i in range(30)] + [(99, [-1.0] * 64, 1, "", 1, 1, "")]
    got = centroids.cluster(spark.createDataFrame(table, SCHEMA)).collect()
    assert shown(got) == brute(table)


def test_no_vectors(spark):
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, None, 1, "", 1, 1, "")], SCHEMA)).count() == 0
    alone = centroids.cluster(spark.createDataFrame([(None, [1.0] * 64, 1, "", 1, 1, "")], SCHEMA)).collect()
    assert [(r.vec_id, r.cluster) for r in alone] == [(None, 0)]


def test_query_equals_its_sql(spark, tmp_path):
    table = [r for r in rows(250, 120) if r[0] != 9007]
    spark.createDataFrame(table, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = [{"vec_id": None if r[0] is None else int(r[0]), **dict(zip(NAMES, r[1:], strict=True))} for r in con.execute(f"SELECT vec_id, {', '.join(NAMES)} FROM ({queries.OP12_SQL})").fetchall()]
    assert shown(queries.op12_weighted_centroids(spark, str(tmp_path)).collect()) == shown(want)
