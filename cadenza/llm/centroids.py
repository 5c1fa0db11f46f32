"""Centroid clustering of quantised vectors, on distinct vectors with multiplicities.

Vectors are quantised to integers; equal ones are grouped, and Lloyd rounds run over the distinct ones, each weighted by its
multiplicity. A task sums, for each centroid, the weights and the weighted components of its vectors; Spark adds these up,
so that a round moves one small row for each task and centroid, and the driver sees one for each centroid. All sums are of
integers and exact in any order. The last assignment is joined back to the ids; vectors with very many copies are joined by
broadcasting those few.

Nulls: vectors that are null, of another length, or hold a null or non-finite component are left out, as are those with a
component of LARGEST or more after quantisation, whose squared distances no long can hold. Null ids get a row but never start
a centroid. Equal distances go to the smaller number. Repeated rows each get a row; where an id repeats, its vectors start in
their own order. With fewer vectors than centroids there are as many centroids as vectors. Columns other than the id and the
vector are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm._work import hot_join, written

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, "1"
#: Quantised components are below this: a squared distance then fits into a long.
LARGEST = 1 << 27
#: Vectors that are compared at once.
STRIP = 1 << 13


def quantised(vectors: DataFrame, *, key: str, vector: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(key, q) of the vectors that take part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double") * scale)
    fit = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    known = vectors.select(F.col(key).alias("key"), x.alias("x")).where((F.size("x") == dims) & fit)
    return known.select("key", F.transform("x", lambda v: F.floor(v).cast("int")).alias("q"))


def starts(rows: DataFrame, *, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The vectors whose ids hash lowest, in the order of their hashes: k of them at most."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = rows.where("key is not null").select(order.alias("hash"), "q").orderBy("hash", "q").limit(k).collect()
    return np.array([r["q"] for r in first], np.int64)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid and its squared distance; in exact integers."""
    number, distance = np.empty(len(q), np.int64), np.empty(len(q), np.int64)
    for at in range(0, len(q), STRIP):
        part = q[at : at + STRIP]
        apart = np.stack([np.square(part - c).sum(axis=1) for c in centroids])
        number[at : at + STRIP] = apart.argmin(axis=0)
        distance[at : at + STRIP] = apart.min(axis=0)
    return number, distance


Batches = Iterator[pa.RecordBatch]


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("q").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)


def sums(centroids: np.ndarray):
    """One row for each centroid of a task: its weight and its weighted sums."""

    def run(batches: Batches) -> Batches:
        weight, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for batch in batches:
            q, many = matrix(batch), batch.column("weight").to_numpy()
            if len(q):
                number, _ = nearest(q, centroids)
                np.add.at(weight, number, many)
                np.add.at(total, number, q * many[:, None])
        used = np.flatnonzero(weight)
        lists = pa.array(list(total[used]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(weight[used], pa.int64()), lists], ["cluster", "weight", "total"])

    return run


def assigning(centroids: np.ndarray):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                number, distance = nearest(matrix(batch), centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number.astype(np.int32)), pa.array(distance)], [*batch.schema.names, "cluster", "distance"])

    return run


def lloyd(distinct: DataFrame, centroids: np.ndarray, *, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after some rounds over a written table (q, weight). An empty centroid stays."""
    for _ in range(rounds if len(centroids) else 0):
        parts = distinct.mapInArrow(sums(centroids), "cluster long, weight long, total array<long>")
        whole = parts.groupBy("cluster").agg(F.sum("weight").alias("weight"), F.array(*[F.sum(F.col("total")[i]) for i in range(centroids.shape[1])]).alias("total"))
        centroids = centroids.copy()
        for r in whole.collect():  # a row for each centroid
            centroids[r["cluster"]] = [s // r["weight"] for s in r["total"]]
    return centroids


def cluster(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) of each vector that takes part."""
    spark = vectors.sparkSession
    rows = quantised(vectors, key=key, vector=vector, dims=dims, scale=scale)
    distinct = written(rows.groupBy("q").agg(F.count(F.lit(1)).alias("weight")), "distinct")
    centroids = lloyd(distinct, starts(rows, k=k, seed=seed), rounds=rounds)
    if not len(centroids):  # no vector, or none with an id
        centroids = np.zeros((1, dims), np.int64)
    found = written(distinct.mapInArrow(assigning(centroids), "q array<int>, weight long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["sum"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("weight")).alias("sum")).collect()}  # a row a centroid
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = [(n, inertia.get(n, 0), sum(inertia.values()), c, digests[n]) for n, c in enumerate(centroids.tolist())]
    names = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    placed = hot_join(rows, found, ["q"], "weight").join(F.broadcast(names), "cluster")  # k rows
    return placed.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
