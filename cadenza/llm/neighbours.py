"""Nearest neighbours by windows along shifted Hilbert curves.

Equal vectors are one point. The points lie along several Hilbert curves, each over another random projection to a few
dimensions and another shift. A point's rank along a curve, from 0 to 1, comes from the sorted keys of a bounded sample;
points with equal keys are dealt over their ranks by a hash. Spark splits each curve into parts of about PART ranks, a
query goes to each part that its window of ranks touches, and the points of the windows are compared on the original
vectors. The curves' results are merged and reranked: every result row comes from a window.

The windows' width is measured: for a bounded sample of queries the true neighbours are found among all points, and the
windows are as wide as it takes to hold ``AIM`` of them on some curve, at every size of the table. Where vectors cluster
the windows are narrow. Vectors without structure need windows that hold much of the table, and cost accordingly.

Nulls: vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without an id.
Vectors are compared with those of their own length. Repeated rows, or ids with several vectors, are rows of their own:
each is a candidate, and a query leaves out just its own row. Equal distances go to the smaller id. With fewer candidates
than asked for, all are returned. Columns that aren't named are ignored. An empty table, or one without queries, gives no
rows. Ids and vectors have a fixed size, so that there are no long texts to mind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm._work import hot_join, written

NEAREST = 10
CURVES = 3
PROJECTED, BITS = 6, 10
#: Points of a part: what one group holds.
PART = 8192
#: Share of the sampled queries' true neighbours that the windows must hold, and the least points on each side.
AIM, LEAST = 0.97, 1024
#: Points that the projections are scaled by, keys that ranks are told by, queries that widths are measured on: hash
#: samples of about these sizes.
SPREAD_ROWS, KEY_ROWS, WIDTH_ROWS = 2000, 65_536, 256
TILE = 256


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of cells (points x dimensions, below 2**bits)."""
    x = [c.astype(np.uint64) for c in cells.T]
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0]) ^ swap
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - one), turn)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | ((x[i] ^ turn) >> np.uint64(b) & one)
    return key.astype(np.int64)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


@dataclass
class Curves:
    """A projection, its spread and its shift for each curve, and the sorted sample of its keys."""

    centre: np.ndarray
    maps: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    keys: list[np.ndarray]

    def places(self, vectors: np.ndarray) -> list[np.ndarray]:
        out = []
        with np.errstate(over="ignore", invalid="ignore"):
            for axes, spread, shift in self.maps:
                unit = np.nan_to_num((vectors - self.centre) @ axes / (8 * spread) + 0.5 + 0.25 * (shift - 0.5), posinf=1.0, neginf=0.0).clip(0, 1 - 1e-9)
                out.append(hilbert((unit * (1 << BITS)).astype(np.uint64), BITS))
        return out

    def ranks(self, vectors: np.ndarray, jitter: np.ndarray) -> list[np.ndarray]:
        """The points' ranks, from 0 to 1. ``jitter`` (0 to 1) deals points with equal keys."""
        out = []
        for place, keys in zip(self.places(vectors), self.keys, strict=True):
            low, high = np.searchsorted(keys, place), np.searchsorted(keys, place, side="right")
            # between two sampled keys the rank grows with the key
            before, after = keys[np.maximum(low - 1, 0)], keys[np.minimum(low, len(keys) - 1)]
            part = np.clip((place - before) / np.maximum(after - before, 1), 0, 1)
            # a key that was sampled more than once holds a stretch of ranks
            rank = np.where(high > low, low + jitter * np.maximum(high - low - 1, 0), np.maximum(low - 1 + part, 0))
            out.append((rank / (len(keys) + 1)).clip(0, 1 - 1e-12))
        return out


def share_of(rows: int, of: int, seed: int) -> Column:
    """A hash sample of about ``rows`` of ``of`` points."""
    return F.pmod(F.xxhash64(F.lit(seed), "mark"), F.lit(1 << 20)) < int(min(1.0, rows / max(1, of)) * (1 << 20))


def fitted(points: DataFrame, count: int, size: int) -> Curves:
    drawn = points.where(share_of(SPREAD_ROWS, count, 1)).select("vector").orderBy("vector").toPandas()
    sample = np.stack(drawn["vector"].to_list()).astype(float) if len(drawn) else np.zeros((1, size))
    centre, rng = sample.mean(axis=0), np.random.default_rng(9)
    maps = []
    for _ in range(CURVES):
        axes = np.linalg.qr(rng.standard_normal((size, min(PROJECTED, size))))[0]
        maps.append((axes, ((sample - centre) @ axes).std(axis=0) + 1e-12, rng.random(axes.shape[1])))
    curves = Curves(centre, maps, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in curves.places(matrix(batch.column("vector"), size))], [f"k{c}" for c in range(CURVES)])

    keys = points.where(share_of(KEY_ROWS, count, 2)).select("vector").mapInArrow(run, ", ".join(f"k{c} long" for c in range(CURVES))).toPandas()
    curves.keys = [np.sort(keys[f"k{c}"].to_numpy(np.int64)) if len(keys) else np.zeros(1, np.int64) for c in range(CURVES)]
    return curves


def jitter(mark: np.ndarray) -> np.ndarray:
    return (mark.astype(np.int64).view(np.uint64) >> np.uint64(11)).astype(float) / (1 << 53)


def close(x: np.ndarray, y: np.ndarray, within: np.ndarray | None, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, square): for each row of ``x`` the nearest ``most`` rows of ``y`` where ``within``, ties to the smaller ``first``."""
    with np.errstate(over="ignore", invalid="ignore"):
        norms = (y**2).sum(axis=1)
        square = (x**2).sum(axis=1)[:, None] + norms[None, :] - 2 * x @ y.T
        slack = 1e-9 * ((x**2).sum(axis=1)[:, None] + norms.max(initial=0.0))
        square = np.where(np.isfinite(square), square, 0.0)  # too large for the short formula: compared exactly
        if within is not None:
            square = np.where(within, square, np.inf)
        keep = min(len(y), most + 4)
        last = np.partition(square, keep - 1, axis=1)[:, keep - 1]
        i, j = np.nonzero((square <= last[:, None] + slack) & np.isfinite(square))
        exact = np.cumsum((x[i] - y[j]) ** 2, axis=1)[:, -1] if len(i) else np.zeros(0)  # term by term, as SQL adds
    order = np.lexsort((first[j], exact, i))
    i, j, exact = i[order], j[order], exact[order]
    near = np.arange(len(i)) - np.searchsorted(i, i) < most
    return i[near], j[near], exact[near]


def width(points: DataFrame, curves: Curves, count: int, asked: int, size: int, most: int) -> float:
    """Half the width of the windows, as a share of the ranks: what it takes to hold AIM of the sample's neighbours."""
    drawn = points.where(F.col("asked") & share_of(WIDTH_ROWS, asked, 3)).select("rep", "mark", "vector").orderBy("mark", "rep").toPandas()
    least = LEAST / max(1, count)
    if not len(drawn):
        return least
    reps, queries = drawn["rep"].to_numpy(np.int64), np.stack(drawn["vector"].to_list()).astype(float)
    own = curves.ranks(queries, jitter(drawn["mark"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None  # a query's nearest of this task's points: a bounded number
        for batch in batches:
            vectors, rep, mark = matrix(batch.column("vector"), size), batch.column("rep").to_numpy(), batch.column("mark").to_numpy()
            if not len(rep):
                continue
            i, j, exact = close(queries, vectors, reps[:, None] != rep[None, :], rep, most)
            gap = np.min([np.abs(own[c][i] - r[j]) for c, r in enumerate(curves.ranks(vectors, jitter(mark)))], axis=0)
            new = np.stack([i, exact, gap])
            best = new if best is None else np.concatenate([best, new], axis=1)
            best = best[:, np.lexsort((best[1], best[0]))]
            best = best[:, np.arange(best.shape[1]) - np.searchsorted(best[0], best[0]) < most]
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(best[0].astype(np.int32)), pa.array(best[1]), pa.array(best[2])], ["q", "square", "gap"])

    found = points.select("rep", "mark", "vector").mapInArrow(run, "q int, square double, gap double")
    gaps = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("square"))).where(F.col("n") <= most).select("gap").toPandas()["gap"]
    return max(least, float(np.quantile(gaps, AIM)) * 1.001 if len(gaps) else least)


LAID = "curve int, part int, asks boolean, rank double, rep long, first long, vector binary"


def laid_out(points: DataFrame, curves: Curves, parts: int, half: float, size: int) -> DataFrame:
    """Each point once a curve, and each query once for each part that its window touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, rep, first = matrix(batch.column("vector"), size), batch.column("rep").to_numpy(), batch.column("first").to_numpy()
            asks = np.flatnonzero(batch.column("asked").to_numpy(zero_copy_only=False))
            blobs = pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary())
            for c, rank in enumerate(curves.ranks(vectors, jitter(batch.column("mark").to_numpy()))):
                low = ((rank[asks] - half) * parts).astype(int).clip(0, parts - 1)
                many = ((rank[asks] + half) * parts).astype(int).clip(0, parts - 1) - low + 1
                begin = np.cumsum(many) - many
                who = np.r_[np.arange(len(rep)), np.repeat(asks, many)]
                part = np.r_[(rank * parts).astype(int), np.repeat(low - begin, many) + np.arange(many.sum())]
                for at in range(0, len(who), 4096):
                    w = who[at : at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(w), c, np.int32)), pa.array(part[at : at + 4096].astype(np.int32)), pa.array(np.arange(at, at + len(w)) >= len(rep)), pa.array(rank[w]), pa.array(rep[w]), pa.array(first[w]), blobs.take(pa.array(w))],
                        ["curve", "part", "asks", "rank", "rep", "first", "vector"],
                    )

    kind = stored(points)
    return points.select("rep", "mark", "first", "asked", "vector").mapInArrow(run, LAID)


def stored(points: DataFrame) -> type:
    return np.float32 if points.schema["vector"].dataType.elementType.simpleString() == "float" else np.float64


def compared(size: int, half: float, most: int, kind: type):
    """For a part of a curve: the nearest points of each query among those of its window that lie in the part."""

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        rank, rep, first = (group.column(c).to_numpy() for c in ("rank", "rep", "first"))
        x = np.frombuffer(b"".join(group.column("vector").to_pylist()), kind).reshape(-1, size).astype(float)
        points, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
        order = points[np.argsort(rank[points], kind="stable")]
        queries = queries[np.argsort(rank[queries], kind="stable")]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(queries), TILE):
            q = queries[at : at + TILE]
            low, high = np.searchsorted(rank[order], [rank[q[0]] - half, rank[q[-1]] + half + 1e-15])
            p = order[low:high]
            if not len(p):
                continue
            i, j, square = close(x[q], x[p], np.abs(rank[q][:, None] - rank[p][None, :]) <= half, first[p], most)
            out.append((rep[q[i]], rep[p[j]], first[p[j]], square))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["asked", "rep", "first", "square"])

    return run


def search(vectors: DataFrame, asked: Column, *, nearest_rows: int = NEAREST, key: str = "vec_id", vector: str = "embedding", half: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows for which ``asked`` (an expression over the id, as ``id``) holds.
    ``half`` sets half the width of the windows instead of measuring it."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    plain = F.transform(F.col(vector).cast(kind), lambda x: x + F.lit(0).cast(kind[6:-1]))  # no negative zero
    good = vectors.select(F.col(key).cast("long").alias("id"), plain.alias("vector")).where(usable(F.col("vector")) & F.col("id").isNotNull())
    sizes = [r["size"] for r in good.groupBy(F.size("vector").alias("size")).count().orderBy("size").collect()]  # a row a length
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for size in sizes:
        out = out.unionByName(of_size(good.where(F.size("vector") == size), asked, size, nearest_rows, half))
    return out


def of_size(good: DataFrame, asked: Column, size: int, nearest_rows: int, half: float | None) -> DataFrame:
    k = nearest_rows + 1  # the query's own row may be among them
    # two hashes tell vectors apart; of equal vectors no more than the k smallest ids can be results
    same = ["mark", "twin"]
    named = good.select("id", asked.alias("asked"), F.xxhash64("vector").alias("mark"), F.xxhash64(F.lit(1), "vector").alias("twin"), "vector")
    queries = written(named.where("asked").select("id", *same), "queries")
    few = named.withColumn("n", F.row_number().over(Window.partitionBy(*same).orderBy("id"))).where(F.col("n") <= k)
    points = few.groupBy(*same).agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids"))
    points = points.join(queries.groupBy(*same).agg(F.count(F.lit(1)).alias("asks")), same, "left").withColumn("asks", F.coalesce("asks", F.lit(0)))
    points = written(points.select(F.monotonically_increasing_id().alias("rep"), *same, F.element_at("ids", 1).alias("first"), "asks", (F.col("asks") > 0).alias("asked"), "ids", "vector"), "points")
    count, many = points.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    curves = fitted(points, count, size)
    half = width(points, curves, count, many, size, k) if half is None else half
    parts = max(1, -(-count // PART))
    laid = laid_out(points, curves, parts, half, size).repartition(max(12, min(20_000, CURVES * parts)), "curve", "part")
    found = laid.groupBy("curve", "part").applyInArrow(compared(size, half, k, stored(points)), "asked long, rep long, first long, square double")
    order = Window.partitionBy("asked").orderBy("square", "first", "rep")
    best = written(found.dropDuplicates(["asked", "rep"]).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n"), "nearest")
    # back from points to rows
    each = best.join(points.select("rep", "ids"), "rep").select("asked", "rep", "square", F.explode("ids").alias("vec_id"))
    each = each.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy("square", "vec_id"))).where(F.col("n") <= k)
    lists = each.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("square", "vec_id", "rep"))).alias("near")).withColumnRenamed("asked", "own")
    lists = written(lists.join(points.select(F.col("rep").alias("own"), *same, "asks"), "own"), "lists")
    own = hot_join(queries, lists, same, "asks")
    at = F.array_position(F.transform("near", lambda x: (x["vec_id"] == F.col("id")) & (x["rep"] == F.col("own"))), F.lit(True))
    rest = F.slice(F.filter("near", lambda x, i: i + 1 != at), 1, nearest_rows)
    return own.select(F.col("id").alias("query_id"), F.posexplode(rest).alias("rank", "hit")).select("query_id", (F.col("rank") + 1).alias("rank"), "hit.vec_id", F.sqrt("hit.square").alias("score"))
