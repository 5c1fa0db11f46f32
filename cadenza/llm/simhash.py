"""Near-duplicates by SimHash, with tiled exact comparison of fingerprints.

Fingerprints: each text is lower-cased (A-Z), split at ASCII white space, and cut into word shingles; bit b of the
fingerprint is set if it is set in over half of the shingles' XXH64 values (seed 42, unsigned). Fingerprints that differ
in few enough bits are linked; linked fingerprints form components.

Comparison: the distinct fingerprints are sorted by population count into tiles. Two fingerprints within the radius have
population counts within the radius, so tile pairs that are further apart are skipped; the others are compared whole,
with numpy exclusive-or and bit counts. No link is lost, and a tile pair gives back a spanning forest of its links,
never all pairs. Equal texts have equal fingerprints and so are compared once, however many copies there are.

Hot groups: rows of a fingerprint that very many rows share, and the links of a fingerprint that very many others link
to, are joined by broadcasting those few keys, so that no task gets a whole group.

Nulls and texts without words have the fingerprint zero, which is linked like any other. Very long texts are read whole.
A null doc_id gets a result row but is never the id of a component, unless all ids in it are null. Repeated rows each get
a row; a bit that is set in exactly half of the shingles isn't set. Columns that aren't named are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm._work import TEXTS, discard, hot_join, written

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 8192
#: Rows of a tile that are compared with another tile at once.
STRIP = 128
#: Links that a task holds before it reduces them to a forest.
HELD = 1 << 20
#: Links that may meet in one task.
HOT_LINKS = 100_000
#: Up to so many links (of two numbers), one task finds all components at once.
ONE_TASK = 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    sizes = [len(w) for w in words]
    starts = list(accumulate((s + 1 for s in sizes), initial=0))
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:])), np.uint64, len(words) - shingle + 1)  # noqa: B905
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprints(text: pd.Series, shingle: pd.Series) -> pd.Series:
    k = int(shingle.iloc[0]) if len(shingle) else SHINGLE
    return pd.Series(np.array([fingerprint(x.encode(), k) if isinstance(x, str) else 0 for x in text], np.uint64).view(np.int64))


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of TILE fingerprints, in the order in which they come."""
    held, count, part = [], 0, TaskContext.get().partitionId()
    made = 0

    def tile(values: np.ndarray) -> pa.RecordBatch:
        nonlocal made
        ones = np.bitwise_count(values.view(np.uint64))
        made += 1
        return pa.RecordBatch.from_pydict({"part": [part], "nth": [made], "low": [int(ones.min())], "high": [int(ones.max())], "prints": [values.tobytes()]}, TILES)

    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False))
        count += len(held[-1])
        while count >= TILE:
            values = np.concatenate(held)
            yield tile(values[:TILE])
            held, count = [values[TILE:]], count - TILE
    if count:
        yield tile(np.concatenate(held))


TILES = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("prints", pa.binary())])


def forest(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of each node that isn't a root, for the graph of n nodes with the edges u-v."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            break
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def compare(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The spanning forest of the links of two tiles that are sorted by population count."""
    nodes = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    x, y = a.view(np.uint64), b.view(np.uint64)
    ones_x, ones_y = np.bitwise_count(x).astype(int), np.bitwise_count(y).astype(int)
    us, vs, held = [], [], 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        return forest(len(nodes), np.concatenate(us), np.concatenate(vs))

    for at in range(0, len(x), STRIP):
        strip = x[at : at + STRIP]
        near = np.searchsorted(ones_y, [ones_x[at] - radius, ones_x[min(at + STRIP, len(x)) - 1] + radius + 1])
        left = max(int(near[0]), at) if same else int(near[0])
        if left >= near[1]:
            continue
        i, j = np.nonzero(np.bitwise_count(strip[:, None] ^ y[None, left : near[1]]) <= radius)
        us.append(i + at)
        vs.append(j + left + shift)
        held += len(i)
        if held > HELD:
            u, v = reduced()
            us, vs, held = [u], [v], len(u)
    u, v = reduced() if us else (np.zeros(0, int), np.zeros(0, int))
    return nodes[u], nodes[v]


LINKS = "u long, v long"


def compared(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, a, b in zip(batch.column("same").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                u, v = compare(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), same, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def tile_links(prints: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints of column ``fp`` which differ in at most ``radius`` bits."""
    distinct = prints.select("fp").distinct()
    count = distinct.count()
    parts = max(1, -(-count // TILE))
    ones = F.bit_count("fp")
    cut = written(distinct.repartitionByRange(parts, ones, "fp").sortWithinPartitions(ones, "fp").mapInArrow(tiles, "part int, nth int, low int, high int, prints binary"), "tiles")
    # the order of tiles: one row for each TILE fingerprints, without the fingerprints, so one task holds count / TILE rows
    numbered = cut.select("part", "nth", "low", "high", F.row_number().over(Window.orderBy("part", "nth")).alias("tile"))
    reach = numbered.select("tile", F.explode(F.sequence("low", F.lit(64))).alias("ones")).groupBy("ones").agg(F.max("tile").alias("last"))  # 65 rows at most
    pairs = numbered.join(F.broadcast(reach), F.least(F.col("high") + radius, F.lit(64)) == F.col("ones"))
    pairs = written(pairs.select(F.col("part").alias("pa"), F.col("nth").alias("na"), F.col("tile").alias("ta"), F.explode(F.sequence("tile", "last")).alias("tb")), "pairs")
    names = numbered.select(F.col("tile").alias("tb"), F.col("part").alias("pb"), F.col("nth").alias("nb"))
    left = cut.select(F.col("part").alias("pa"), F.col("nth").alias("na"), F.col("prints").alias("a"))
    right = cut.select(F.col("part").alias("pb"), F.col("nth").alias("nb"), F.col("prints").alias("b"))
    each = max(1, min(4000, -(-pairs.count() // 8)))
    both = pairs.join(names, "tb").join(left, ["pa", "na"]).join(right, ["pb", "nb"]).select("ta", "tb", (F.col("ta") == F.col("tb")).alias("same"), "a", "b")
    return written(both.repartition(max(12, each), "ta", "tb").select("same", "a", "b").mapInArrow(compared(radius), LINKS), "links", batches=64)


def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the links u-v that a task reads, in which roots are smallest nodes."""
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    u, v = (np.concatenate([x[k] for x in held]) if held else np.zeros(0, np.int64) for k in (0, 1))
    names, which = np.unique(np.concatenate([u, v]), return_inverse=True)
    node, root = forest(len(names), which[: len(u)], which[len(u) :])
    yield pa.RecordBatch.from_arrays([pa.array(names[node]), pa.array(names[root])], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that is reachable; nodes without links are absent.

    Up to ONE_TASK links, whose size is known as they are written, are joined up in one task. Beyond that: alternating large-star and small-star steps, each written to the shared folder; the number of rounds grows with the
    logarithm of the size of a component. Where there are so many links that one node's could be more than HOT_LINKS (rows of
    two numbers), those of hot nodes are split. What a round read is deleted once the next is written.
    """
    pairs = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    if pairs.count() <= ONE_TASK:
        return written(pairs.coalesce(1).mapInArrow(rooted, "node long, root long"), "roots")
    before = None
    while True:
        state = pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("u", "v", F.lit(1)), F.lit(1 << 30))).alias("s")).first()
        if before == state:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, split = state, state["n"] > HOT_LINKS
        read, pairs = pairs, small_star(large_star(pairs, split), split)
        discard(read)


def joined(rows: DataFrame, lowest: DataFrame, split: bool) -> DataFrame:
    """Rows (u, v) with the ``m`` of their u."""
    return hot_join(rows, written(lowest, "stars"), ["u"], "n") if split else rows.join(lowest.drop("n"), "u")


def large_star(pairs: DataFrame, split: bool) -> DataFrame:
    both = pairs.union(pairs.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return written(joined(both, least, split).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")


def small_star(large: DataFrame, split: bool) -> DataFrame:
    lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    small = joined(large, lowest, split).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    made = written(small.union(lowest.select("u", "m")).distinct(), "stars")
    discard(large)
    return made


def lowest_of(roots: DataFrame, first: DataFrame, node: str) -> DataFrame:
    """(node, component_id, root, n) of each node of the written ``first`` (node, first: its smallest key, n: its rows)."""
    member = roots.union(roots.select("root", "root").distinct())
    known = member.join(first.select(F.col(node).alias("node"), "first"), "node")
    lowest = written(known.groupBy("root").agg(F.min("first").alias("lowest"), F.count(F.lit(1)).alias("nodes")), "lowest")
    merged = hot_join(member, lowest, ["root"], "nodes").select(F.col("node").alias(node), "lowest", "root")
    return written(first.join(merged, node, "left").select(node, F.coalesce("lowest", "first").alias("component_id"), F.coalesce("root", node).alias("root"), "n"), "named")


def linked(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id, root) of each row; root is the component's smallest fingerprint and names it for sure, as
    an id may come in more than one."""
    marked = written(docs.select(F.col(key).alias("key"), fingerprints(F.col(text), F.lit(shingle)).alias("fp")), "marked", batches=TEXTS)
    first = written(marked.groupBy("fp").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")), "first")
    named = lowest_of(components(tile_links(first, radius=radius)), first, "fp")
    return hot_join(marked, named, ["fp"], "n").select(F.col("key").alias(key), "fp", "component_id", "root")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the row with the smallest id stays. Rows without an
    id stay only where no row of their component has one; of rows that repeat an id and a fingerprint, one stays. The
    columns of ``docs`` may have any names."""
    found = linked(docs, key=key, text=text, shingle=shingle, radius=radius)
    return one_of_found(docs, found, fingerprints(F.col(text), F.lit(shingle)), key=key)


def one_of_found(docs: DataFrame, found: DataFrame, mark: Column, *, key: str) -> DataFrame:
    """``one_of_each`` of the rows' (key, fp, component_id, root); ``mark`` gives the fp of a row of ``docs``."""
    hashed = F.xxhash64("key")  # never null
    found = written(found.select(F.col(key).alias("key"), "fp", "component_id", "root").withColumn("hash", hashed), "linked")
    rows = written(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).withColumn("rows", F.col("n")), "rows")
    kept = found.where(F.col("key").eqNullSafe(F.col("component_id"))).groupBy("key", "hash", "root").agg(F.min("fp").alias("fp"))
    kept = written(hot_join(kept, rows, ["hash"], "n").select("key", "hash", "fp", "rows"), "kept")
    once, again = kept.where("rows = 1 and key is not null"), kept.where("rows > 1 or key is null")
    whole = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), mark.alias("fp"))
    # the ids that stay grow with the input, so they are never broadcast: the plan is one at every size
    single = whole.select("row", "key").join(once.select("key").hint("merge"), "key", "left_semi").select("row.*")
    if again.isEmpty():  # ids are unique: the texts are shuffled once at most
        return single
    keys = written(again.groupBy("hash").agg(F.first("rows").alias("n")), "again")
    copies = hot_join(whole.withColumn("hash", hashed), keys, ["hash"], "n").groupBy("hash", "key", "fp").agg(F.first("row").alias("row"))  # copies go before the shuffle
    wanted = again.select(F.col("hash").alias("_hash"), F.col("key").alias("_key"), F.col("fp").alias("_fp"))
    repeated = copies.join(wanted, (F.col("hash") == F.col("_hash")) & (F.col("fp") == F.col("_fp")) & F.col("key").eqNullSafe(F.col("_key")), "left_semi")
    return single.unionByName(repeated.select("row.*"))
