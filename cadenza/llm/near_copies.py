"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Nodes are distinct texts, as word sequences: lower-cased (A-Z) and split at ASCII white space. A text of fewer words than
a shingle is one shingle. Sets hold XXH3 values of 64 bits, and ``id``, XXH64 of the words, names a node.

Candidates: SimHash fingerprints of 128 bits over the distinct shingles. Two sets of the given similarity differ in 19 bits
on average with a deviation of 4, so that a share of about 1e-5 of such pairs lies beyond ``RADIUS`` and is missed, and far
fewer of more similar ones; unrelated texts differ in 64 with a deviation of 6. A second fingerprint of WIDE bits goes with
them: candidates that differ in more of its bits than a pair of the given similarity may (``WIDE_RADIUS``, four deviations
above the mean as well) aren't listed. Nodes are sorted by the size of their sets into tiles, whose number goes by the number
of nodes alone; sizes whose ratio is below the similarity can't belong together, so such tile pairs are skipped without losing
a link. The others are compared whole.

Verification: in each of two rounds the texts of listed candidates are read once more for their sets, which are compared exactly. Sets
of texts that very many pairs share are broadcast, a bounded number. Components go over verified pairs.

Large groups: the first round compares each tile with itself, so that groups of copies grow together; the second compares
all tile pairs. In a tile pair each node lists its ``FEW`` nearest candidates by the second fingerprint and the first one, and two components no more
than ``FEW`` pairs between them. Of its unlisted candidates a tile pair gives a spanning forest, whose components are the groups
that aren't settled. Groups of one component are done. The nodes of the others are cut, group by group, into tiles that hold their sets;
tiles of one group are compared whole, candidates of different components exactly in the task, and links between components come
back. So no candidate is dropped, and pairs of a group are never rows.

Nulls and texts without words are one node without shingles, which is like no other. Very long texts are read whole. Equal
distances are listed in the order of ids. The columns of a table may have any names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm._work import HOT_ROWS, TEXTS, discard, hot_join, written
from cadenza.llm.simhash import HELD, SEED, STRIP, components, forest, lowest_of, one_of_found

SHINGLE = 5
#: A similarity of 4 / 5 or more makes near copies.
LIKE, OF = 4, 5
#: Bits of 128.
RADIUS = 36
FEW = 4
#: Bits of the second fingerprint, and how many may differ: 155 do on average at the similarity, with a deviation of 11.4.
WIDE, WIDE_RADIUS = 1024, 203
#: Nodes of a tile: few tiles keep down what is sent to tile pairs, many keep the tasks small.
TILES, TILE_FROM, TILE_TO = 24, 4096, 65_536
#: Keys that are broadcast; more are joined by a shuffle of the texts.
KEYS = 1 << 18
#: Fewer sets than these are broadcast, of texts that are in over 1 / HOT_SETS of the pairs.
HOT_SETS = 100

#: Tiles of nodes with their sets, and their bytes: few tiles keep down what is sent, and bytes bound a task's memory.
SET_TILES, SET_FROM, SET_TO = 8, 1 << 16, 1 << 24
#: Candidates whose second fingerprints are compared at once.
AT_ONCE = 1 << 16

NODE = np.dtype([("hi", "u8"), ("lo", "u8"), ("id", "i8"), ("label", "i8"), ("n", "i4"), ("wide", "u8", WIDE // 64)])
#: With the group of unlisted candidates.
GROUPED = np.dtype([("grp", "i8"), *NODE.descr])


def shingles(words: list[bytes]) -> np.ndarray:
    """128-bit values of the distinct shingles, as two columns, sorted by the first."""
    if not words:
        return np.zeros((0, 2), np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh3_128_digest
    if len(words) <= SHINGLE:
        found = digest(joined, SEED)
    else:
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        found = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[SHINGLE:])])  # noqa: B905
    values = np.frombuffer(found, np.uint64).reshape(-1, 2)
    return values[np.unique(values[:, 0], return_index=True)[1]]


def split(text: str | None) -> tuple[int, list[bytes]]:
    """The node's id and the words."""
    words = text.encode().lower().split() if isinstance(text, str) else []
    return int(np.array(xxhash.xxh64_intdigest(b" ".join(words), SEED), np.uint64).view(np.int64)), words


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    ones = np.zeros(128, np.int64)
    for at in range(0, len(values), 1 << 13):
        part = np.ascontiguousarray(values[at : at + (1 << 13)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    hi, lo = np.packbits(2 * ones > len(values), bitorder="little").view(np.int64)
    return int(hi), int(lo)


@F.pandas_udf(T.LongType())
def node_of(text: pd.Series) -> pd.Series:
    return pd.Series([split(x)[0] for x in text], dtype="int64")


TURNS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WIDE // 64 + 1)], np.uint64)


def wide(values: np.ndarray) -> bytes:
    """A fingerprint of WIDE bits over 64-bit values, each of which is stretched by multiplication and mixing."""
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(values), 1 << 12):
        x = values[at : at + (1 << 12), None] * TURNS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(values), bitorder="little").tobytes()


@F.pandas_udf(T.StructType().add("id", T.LongType()).add("n", T.IntegerType()).add("hi", T.LongType()).add("lo", T.LongType()).add("wide", T.BinaryType()))
def marks(text: pd.Series) -> pd.DataFrame:
    rows = []
    for x in text:
        node, words = split(x)
        values = shingles(words)
        rows.append((node, len(values), *fingerprint(values), wide(values[:, 0])))
    return pd.DataFrame(rows, columns=["id", "n", "hi", "lo", "wide"])


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The id and the sorted shingles of each text."""
    for batch in batches:
        found = [split(x) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([shingles(w)[:, 0].tobytes() for _, w in found], pa.binary())], ["id", "shingles"])


@F.pandas_udf(T.BooleanType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: bytes, y: bytes) -> bool:
        u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(u, v, assume_unique=True))
        return OF * both >= LIKE * (len(u) + len(v) - both)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def nodes_of(batch: pa.RecordBatch, kind: np.dtype) -> np.ndarray:
    rows = np.zeros(batch.num_rows, kind)
    for name in kind.names:
        column = batch.column(batch.schema.get_field_index(name))
        if name == "wide":
            rows[name] = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            continue
        values = column.to_numpy(zero_copy_only=False)
        rows[name] = values.view(np.uint64) if name in ("hi", "lo") else values
    return rows


def cut(size: int):
    """Rows of ``size`` nodes, in the order in which they come."""

    def tile(values: np.ndarray, part: int, nth: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": [part], "nth": [nth], "low": [int(values["n"][0])], "high": [int(values["n"][-1])], "n": [len(values)], "nodes": [values.tobytes()]}, CUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, made = np.zeros(0, NODE), TaskContext.get().partitionId(), 0
        for batch in batches:
            held = np.concatenate([held, nodes_of(batch, NODE)])
            while len(held) >= size:
                made += 1
                yield tile(held[:size], part, made)
                held = held[size:]
        if len(held):
            yield tile(held, part, made + 1)

    return run


CUT = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("n", pa.int64()), ("nodes", pa.binary())])


def sizes_of(labels: np.ndarray) -> np.ndarray:
    """How many nodes have the label of each."""
    _, which, many = np.unique(labels, return_inverse=True, return_counts=True)
    return many[which]


def wide_apart(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many bits of the second fingerprints of the candidates a[i], b[j] differ."""
    return np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(a[i[at : at + AT_ONCE]] ^ b[j[at : at + AT_ONCE]]).sum(axis=1, dtype=np.int64) for at in range(0, len(i), AT_ONCE))])


def near(a: np.ndarray, b: np.ndarray, same: bool, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The candidates a[i], b[j] of different labels of two tiles that are sorted by n, a strip of ``a`` at a time, in the order
    of i; and how many bits of their second fingerprints differ. Labels may change between strips."""
    sizes = b["n"].astype(np.int64)
    hi, lo, wide_b = (np.ascontiguousarray(b[c]) for c in ("hi", "lo", "wide"))
    for at in range(0, len(a), STRIP):
        strip = a[at : at + STRIP]
        n = strip["n"].astype(np.int64)
        left = max(int(np.searchsorted(sizes, -(-LIKE * n[0] // OF))), at if same else 0)
        right = int(np.searchsorted(sizes, OF * n[-1] // LIKE, "right"))
        if left >= right:
            continue
        apart = np.bitwise_count(strip["hi"][:, None] ^ hi[None, left:right]) + np.bitwise_count(strip["lo"][:, None] ^ lo[None, left:right])
        i, j = np.nonzero(apart <= radius)
        j = j + left
        small, large = np.minimum(n[i], sizes[j]), np.maximum(n[i], sizes[j])
        right_ones = (strip["label"][i] != b["label"][j]) & (OF * small >= LIKE * large)
        if same:
            right_ones &= j > i + at
        i, j = i[right_ones], j[right_ones]
        bits = wide_apart(strip["wide"], wide_b, i, j)
        close = bits <= WIDE_RADIUS
        if close.any():
            yield i[close] + at, j[close], bits[close]


def firsts(i: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    return np.flatnonzero(np.r_[True, i[1:] != i[:-1]])


def listings(a: np.ndarray, b: np.ndarray, same: bool, few: int, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The candidates of ``near``, and which of them are listed."""
    many_a, many_b = sizes_of(a["label"]), sizes_of(b["label"])
    between: dict[tuple[int, int], int] = {}  # listed pairs between two components of several nodes
    for i, j, bits in near(a, b, same, radius):
        starts = firsts(i)
        order = np.lexsort((j, bits, i))
        rank = np.empty(len(i), np.int64)
        rank[order] = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
        listed = rank < few
        listed[starts] = True
        for k in np.flatnonzero(listed & (many_a[i] > 1) & (many_b[j] > 1)):
            pair = (int(a["label"][i[k]]), int(b["label"][j[k]]))
            between[pair] = between.get(pair, 0) + 1
            listed[k] = between[pair] <= few
        yield i, j, listed


def compare(a: np.ndarray, b: np.ndarray, same: bool, few: int = FEW, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The listed candidates (u, v) of two tiles that are sorted by n, and the ids of nodes with unlisted ones."""
    u, v, x, y = parted(a, b, same, few, radius)
    return u, v, np.unique(np.concatenate([x, y]))


def parted(a: np.ndarray, b: np.ndarray, same: bool, few: int = FEW, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The listed candidates (u, v) of two tiles that are sorted by n, and a spanning forest (x, y) of the unlisted ones."""
    ids, shift = (a["id"], 0) if same else (np.concatenate([a["id"], b["id"]]), len(a))
    us, vs, xs, ys, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for i, j, listed in listings(a, b, same, few, radius):
        us.append(ids[i[listed]])
        vs.append(ids[j[listed] + shift])
        xs.append(i[~listed])
        ys.append(j[~listed] + shift)
        held += len(xs[-1])
        if held > HELD:
            x, y = forest(len(ids), np.concatenate(xs), np.concatenate(ys))
            xs, ys, held = [x], [y], len(x)
    x, y = forest(len(ids), np.concatenate(xs), np.concatenate(ys))
    return np.concatenate(us), np.concatenate(vs), ids[x], ids[y]


def compared(few: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, a, b in zip(batch.column("same").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                u, v, x, y = parted(np.frombuffer(b"".join(a), NODE), np.frombuffer(b"".join(b), NODE), same, few)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, x])), pa.array(np.concatenate([v, y])), pa.array(np.arange(len(u) + len(x)) < len(u))], ["u", "v", "listed"])

    return run


CUT_SETS = pa.schema([("part", pa.int32()), ("nth", pa.int32()), *((end, pa.struct([("grp", pa.int64()), ("n", pa.int32())])) for end in ("low", "high")), ("n", pa.int64()), ("nodes", pa.binary())])


def cut_sets(size: int):
    """Rows of nodes with their sets, of about ``size`` bytes (``n``), in the order in which they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, nodes, sets, held = TaskContext.get().partitionId(), 0, [], [], 0

        def strip() -> pa.RecordBatch:
            values = np.concatenate(nodes)
            ends = [{"grp": int(x["grp"]), "n": int(x["n"])} for x in (values[0], values[-1])]
            return pa.RecordBatch.from_pydict({"part": [part], "nth": [made], "low": ends[:1], "high": ends[1:], "n": [held], "nodes": [len(values).to_bytes(8, "little") + values.tobytes() + b"".join(sets)]}, CUT_SETS)

        for batch in batches:
            rows = nodes_of(batch, GROUPED)
            for k, of in enumerate(batch.column(batch.schema.get_field_index("shingles")).to_pylist()):
                nodes.append(rows[k : k + 1])
                sets.append(of)
                held += GROUPED.itemsize + len(of)
                if held >= size:
                    made += 1
                    yield strip()
                    nodes, sets, held = [], [], 0
        if nodes:
            made += 1
            yield strip()

    return run


def opened(blobs: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The nodes and the sets of the strips of a tile."""
    nodes, sets = [], []
    for blob in blobs:
        count = int.from_bytes(blob[:8], "little")
        nodes.append(np.frombuffer(blob, GROUPED, count, 8))
        values = np.frombuffer(blob[8 + count * GROUPED.itemsize :], np.uint64)
        sets += np.split(values, np.cumsum(nodes[-1]["n"], dtype=np.int64)[:-1])
    return np.concatenate(nodes), sets


def alike_ones(of: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sorted sets ``others``, none of them empty, are alike to ``of``."""
    sizes, values = np.array([len(x) for x in others]), np.concatenate(others)
    hits = of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values
    both = np.add.reduceat(hits, np.cumsum(sizes) - sizes, dtype=np.int64)
    return OF * both >= LIKE * (len(of) + sizes - both)


def links(a: np.ndarray, sets_a: list[np.ndarray], b: np.ndarray, sets_b: list[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of labels that join all which alike nodes of one group have, of two tiles that are sorted by group and n: a spanning
    forest. Candidates whose labels were joined before aren't compared."""
    a = a.copy()
    b = a if same else b.copy()
    names, which = np.unique(np.concatenate([a["label"], b["label"]]), return_inverse=True)
    top, us, vs = np.arange(len(names)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    of_a, of_b = which[: len(a)], which[len(a) :]
    for grp in np.intersect1d(a["grp"], b["grp"]):
        (from_a, to_a), (from_b, to_b) = (np.searchsorted(x["grp"], [grp, grp + 1]) for x in (a, b))
        for i, j, _ in near(a[from_a:to_a], b[from_b:to_b], same):
            i, j, starts = i + from_a, j + from_b, firsts(i)
            ok = np.concatenate([alike_ones(sets_a[i[x]], [sets_b[k] for k in j[x:y]]) for x, y in zip(starts, np.r_[starts[1:], len(i)], strict=True)])
            if ok.any():
                node, root = forest(len(top), top[of_a[i[ok]]], top[of_b[j[ok]]])
                us.append(names[node])
                vs.append(names[root])
                over = np.arange(len(top))
                over[node] = root
                top = over[top]
                a["label"], b["label"] = names[top[of_a]], names[top[of_b]]
    return np.concatenate(us), np.concatenate(vs)


def linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for same, a, b in zip(batch.column("same").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            left = opened(a)
            u, v = links(*left, *(left if same else opened(b)), same)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def broadcast_bytes(spark: SparkSession) -> int:
    """The size up to which Spark itself broadcasts a table."""
    setting = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(setting)) if not setting.startswith("-") else 0


def gathered(strips: DataFrame, size: int) -> DataFrame:
    """The written strips of ``cut`` as tiles (tile, low, high, nodes: its strips in order) of fewer than twice ``size`` nodes.
    Tiles go by the nodes before a strip and not by the ranges, so that many small ranges don't make many tiles."""
    # one row a strip, without the nodes, so one task holds about as many rows as there are ranges and tiles
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    places = strips.select("part", "nth", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / size).alias("tile"))
    strip = F.struct("part", "nth", "low", "high", "nodes")
    tiles = strips.join(places, ["part", "nth"]).groupBy("tile").agg(F.sort_array(F.collect_list(strip)).alias("s"))
    made = written(tiles.select("tile", F.array_min("s.low").alias("low"), F.array_max("s.high").alias("high"), F.col("s.nodes").alias("nodes")), "tiles")
    discard(strips)
    return made


def candidates(nodes: DataFrame, few: int, *, alone: bool) -> tuple[DataFrame, bool]:
    """(u, v, listed) of listed candidates and of a spanning forest of the unlisted ones of each tile pair, from (id, n, hi, lo,
    label); and whether these are of all tile pairs. ``alone``: each tile is compared with itself only."""
    count = nodes.count()
    size = min(TILE_TO, max(TILE_FROM, count // TILES))
    order = ("n", "hi", "id")
    ranged = nodes.select(*NODE.names).repartitionByRange(max(1, -(-count // size)), *order).sortWithinPartitions(*order)
    tiles = gathered(written(ranged.mapInArrow(cut(size), "part int, nth int, low int, high int, n long, nodes binary"), "strips"), size)
    one = tiles.select(F.col("tile").alias("ta"), "high")
    two = tiles.select(F.col("tile").alias("tb"), "low")
    same = F.col("ta") == F.col("tb")
    # rows of whole tiles, without the nodes
    reach = same if alone else (F.col("tb") >= F.col("ta")) & (F.col("low").cast("long") * LIKE <= F.col("high").cast("long") * OF)
    pairs = written(one.join(F.broadcast(two), reach).select("ta", "tb"), "pairs")
    left = tiles.select(F.col("tile").alias("ta"), F.col("nodes").alias("a"))
    right = tiles.select(F.col("tile").alias("tb"), F.col("nodes").alias("b"))
    tasks = max(12, min(4000, -(-pairs.count() // 4)))
    if count * NODE.itemsize <= broadcast_bytes(nodes.sparkSession):  # pairs are dealt before the nodes come, so that no node is shuffled
        both = pairs.repartition(tasks, "ta", "tb").join(F.broadcast(left), "ta").join(F.broadcast(right), "tb")
    else:
        both = pairs.join(left, "ta").join(right, "tb").repartition(tasks, "ta", "tb")
    found = written(both.select(same.alias("same"), "a", "b").mapInArrow(compared(few), "u long, v long, listed boolean"), "candidates", batches=16)
    whole = not alone or tiles.count() <= 1
    discard(tiles, pairs)
    return found, whole


def sets_of(docs: DataFrame, wanted: DataFrame, *, key: str, text: str) -> DataFrame:
    """(id, shingles) of the nodes ``wanted`` (id, first: the smallest key of its rows), in one pass over the texts. Up to KEYS
    keys are broadcast, so that no text is shuffled."""
    count = wanted.count()
    keys = wanted.where("first is not null").select(F.col("first").alias("_first"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = rows.join(F.broadcast(keys) if count <= KEYS else keys.hint("merge"), F.col("key") == F.col("_first"), "left_semi").select("text")
    if not wanted.where("first is null").isEmpty():
        found = found.unionAll(rows.where("key is null").select("text"))
    made = written(found.mapInArrow(sets, "id long, shingles binary"), "sets", batches=TEXTS)
    every, different = made.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    if every == different == count:
        return made
    # rows that share a key may have other texts, and rows without one may repeat a text
    once = written(made.join(wanted.select("id"), "id", "left_semi").groupBy("id").agg(F.first("shingles").alias("shingles")), "sets")
    discard(made)
    return once


def joined(pairs: DataFrame, known: DataFrame, end: str, out: str) -> DataFrame:
    """Pairs with the set of their ``end`` (u or v) as ``out``; sets of hot ends are broadcast, and the others shuffled."""
    of = known.select(F.col("id").alias(end), F.col("shingles").alias(out))
    total, most = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    least = max(HOT_ROWS, -(-total // HOT_SETS))
    if most <= least:
        return pairs.join(of, end)
    hot = written(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select(end), "hot")
    rest = pairs.join(F.broadcast(hot), end, "left_anti").join(of, end)
    return pairs.join(F.broadcast(of.join(F.broadcast(hot), end)), end).unionByName(rest)


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, *, key: str, text: str) -> DataFrame:
    """The pairs (u, v) that are alike, of a written table."""
    ends = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    wanted = written(nodes.join(ends, "id", "left_semi").select("id", "first"), "wanted")
    known = sets_of(docs, wanted, key=key, text=text)
    both = joined(joined(pairs, known, "u", "a"), known, "v", "b")
    made = written(both.where(alike("a", "b")).select("u", "v"), "verified", batches=64)
    discard(wanted, known)
    return made


def labelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes with the root of their component as ``label``."""
    return nodes.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")


def unsettled(nodes: DataFrame, roots: DataFrame, unlisted: DataFrame) -> DataFrame:
    """The labelled nodes, with their group ``grp``, of those groups of unlisted candidates that are in several components."""
    groups = components(unlisted)
    member = groups.select(F.col("node").alias("id"), F.col("root").alias("grp")).unionAll(groups.select("root", "root").distinct())
    rows = written(labelled(nodes.join(member, "id"), roots).select(*GROUPED.names, "first"), "grouped")
    several = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    keyed = written(several.select("grp", F.col("n").alias("rows")), "several")
    return written(hot_join(rows, keyed, ["grp"], "rows"), "unsettled")


def settled(docs: DataFrame, rows: DataFrame, *, key: str, text: str) -> DataFrame:
    """Links (u, v) between the components of the nodes of ``unsettled``, whose candidates are compared exactly in tiles."""
    total = rows.agg(F.coalesce(F.sum(F.col("n").cast("long") * 8 + GROUPED.itemsize), F.lit(0))).first()[0]
    size = min(SET_TO, max(SET_FROM, total // SET_TILES))
    known = sets_of(docs, rows.select("id", "first"), key=key, text=text)
    order = ("grp", "n", "hi", "id")
    ranged = rows.select(*GROUPED.names).join(known, "id").repartitionByRange(max(1, -(-total // size)), *order).sortWithinPartitions(*order)
    end = "struct<grp: long, n: int>"
    tiles = gathered(written(ranged.mapInArrow(cut_sets(size), f"part int, nth int, low {end}, high {end}, n long, nodes binary"), "strips", batches=64), size)
    one, two = tiles.select(F.col("tile").alias("ta"), "high"), tiles.select(F.col("tile").alias("tb"), "low")
    # rows of whole tiles; two tiles share at most the group that ends one and begins the other
    reach = (F.col("high.grp") == F.col("low.grp")) & (F.col("tb") > F.col("ta")) & (F.col("low.n").cast("long") * LIKE <= F.col("high.n").cast("long") * OF)
    pairs = written(one.select("ta", F.col("ta").alias("tb")).unionAll(one.join(F.broadcast(two), reach).select("ta", "tb")), "pairs")
    left = tiles.select(F.col("tile").alias("ta"), F.col("nodes").alias("a"))
    right = tiles.select(F.col("tile").alias("tb"), F.col("nodes").alias("b"))
    both = pairs.join(left, "ta").join(right, "tb").repartition(max(12, min(4000, pairs.count())), "ta", "tb")
    made = written(both.select((F.col("ta") == F.col("tb")).alias("same"), "a", "b").mapInArrow(linking, "u long, v long"), "settled", batches=1)
    discard(tiles, pairs, known)
    return made


def linked(docs: DataFrame, *, key: str = "doc_id", text: str = "text", few: int = FEW) -> DataFrame:
    """(key, fp, component_id, root) of each row: fp is the node's id, root the smallest in its component."""
    marked = written(docs.select(F.col(key).alias("key"), marks(F.col(text)).alias("m")), "marked", batches=TEXTS).select("key", "m.*")
    nodes = written(marked.groupBy("id", "n", "hi", "lo", "wide").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("rows")), "nodes")

    def grown(roots: DataFrame, more: DataFrame) -> DataFrame:  # a component goes on as a star
        return roots if more.isEmpty() else written(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(more)), "roots")

    def ends(found: DataFrame) -> DataFrame:
        return found.where("listed").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    found, whole = candidates(nodes.withColumn("label", F.col("id")), few, alone=True)
    pairs = written(ends(found), "listed")
    roots = written(components(verified(docs, nodes, pairs, key=key, text=text)), "roots")
    if not whole:
        found, _ = candidates(written(labelled(nodes, roots).select(*NODE.names), "left"), few, alone=False)
        pairs = written(ends(found).join(pairs, ["u", "v"], "left_anti"), "listed")
        roots = grown(roots, verified(docs, nodes, pairs, key=key, text=text))
    unlisted = written(found.where("not listed").select("u", "v").distinct(), "unlisted")
    if not unlisted.isEmpty():
        rows = unsettled(nodes, roots, unlisted)
        if not rows.isEmpty():
            roots = grown(roots, settled(docs, rows, key=key, text=text))
    named = lowest_of(roots, nodes.select("id", "first", F.col("rows").alias("n")), "id")
    return hot_join(marked.select("key", "id"), named, ["id"], "n").select(F.col("key").alias(key), F.col("id").alias("fp"), "component_id", "root")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` less near copies, by the rules of ``simhash.one_of_each``."""
    return one_of_found(docs, linked(docs, key=key, text=text), node_of(F.col(text)), key=key)
