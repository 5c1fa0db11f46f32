"""Alignment of two tokenizers over the same text.

Tokens of both sides are laid out by the bytes that they stand for. The ends of a text's tokens rise on both sides; a merge
of the two runs finds the ends that they share, and these cut the text into groups, the smallest stretches that both sides
cover with whole tokens. Each pair of an A token and a B token of one group is a link. A batch of texts is one stretch of
bytes for the merge, as every text ends on both sides. Spark counts in how many documents a pair of ids is linked, takes
each id's highest count, and joins both back to the documents' links.

A document's links go as distinct pairs with how often they come, so that repeats inside it are one row. A batch with very
many pairs is worked off in slices by A id. Most rows are of few pairs: those that hold more than one in HOT_PAIRS of the rows,
fewer than HOT_PAIRS whatever the input, are joined by a broadcast where the documents' links are, so that no task gets all rows of
one; only the rows of the others are shuffled. The plan is one at every size.

Nulls: a null text has no tokens, as an empty one and one whose tokens' bytes differ from a space and the text (a normalising
tokenizer, or unknown pieces). A null key is kept. Repeated rows are documents of their own. Very long texts are aligned
whole. Of pairs that tie for the highest count of an id all are best. Columns other than the key and the text are ignored,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm._work import hot_join, written
from cadenza.llm.bpe import chunks, vocabulary
from cadenza.llm.packing import COMMON, quick, tokenizer_path

#: Fixed value: the sign for a space in pieces.
SPACE = "▁"
#: Bits that an id takes in the keys of pairs, and pairs that a slice holds.
ID_BITS, HELD = 20, 1 << 22
#: Pairs that are broadcast are fewer than this, of some 50 bytes.
HOT_PAIRS = 1 << 16
#: Rows of a partition are numbered below this.
ROWS = 1 << 40
SHAPE = "nth int, at long, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, times array<long>"


class ByteLevel:
    """Side A: a byte-level file; a space goes before the text, and special tokens' strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact, self.fast = Tokenizer.from_file(path), quick(path)
        self.exact.encode_special_tokens = True
        self.entries = vocabulary(path).entries

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        def one(text: str) -> np.ndarray:
            if self.fast is not None and (text.isascii() or max(text) < chr(COMMON)):
                return np.array(self.fast[0].encode_ordinary(text), np.uint32)
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)

        return [one(f" {t}") for t in texts]


class Pieces:
    """Side B: a piece file, which puts the space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.entries = [self.bytes_of(i) for i in range(self.model.get_piece_size())]

    def bytes_of(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(SPACE, " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def side_a(path: str) -> ByteLevel:
    return ByteLevel(path)


@lru_cache(maxsize=2)
def side_b(path: str) -> Pieces:
    return Pieces(path)


def shared_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The values that two rising runs share: a stable sort merges the runs with a pointer into each."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[1:][both[1:] == both[:-1]]


def distinct(group: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (group, token), in order, and how often each comes."""
    key, times = np.unique(group << ID_BITS | token, return_counts=True)
    return key >> ID_BITS, key & (1 << ID_BITS) - 1, times


def pairs(doc: np.ndarray, ga: np.ndarray, a: np.ndarray, gb: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Slices of the distinct (doc, a, b) of all groups, with how often each is linked; ``doc`` is that of each group."""
    ga, a, many_a = distinct(ga, a)
    gb, b, many_b = distinct(gb, b)
    size = np.bincount(gb, minlength=len(doc))
    first = np.cumsum(size) - size
    slices = max(1, -(-int(size[ga].sum()) // HELD))
    for nth in range(slices):
        mine = np.flatnonzero(a % slices == nth)
        reach = size[ga[mine]]
        left = np.repeat(mine, reach)
        right = np.arange(len(left)) + np.repeat(first[ga[mine]] - (np.cumsum(reach) - reach), reach)
        key = doc[ga[left]] << 2 * ID_BITS | a[left] << ID_BITS | b[right]
        order = np.argsort(key)
        key, times = key[order], (many_a[left] * many_b[right])[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        times = np.add.reduceat(times, starts) if len(starts) else times
        key, mask = key[starts], (1 << ID_BITS) - 1
        yield key >> 2 * ID_BITS, (key >> ID_BITS & mask).astype(np.int32), (key & mask).astype(np.int32), times


def shown(ga: np.ndarray, a: np.ndarray, gb: np.ndarray, b: np.ndarray, numbers: list[str]) -> tuple[list[str], np.ndarray]:
    """All tokens in the order of groups, A before B, each with the sign after it; and the place after each group."""
    size_a, size_b = np.bincount(ga), np.bincount(gb)
    until_a, until_b = np.cumsum(size_a), np.cumsum(size_b)
    last_a, last_b = np.r_[ga[1:] != ga[:-1], True], np.r_[gb[1:] != gb[:-1], True]
    base = len(numbers) // 3
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + (until_b - size_b)[ga]] = a + base * np.where(last_a, 1, 0)
    out[np.arange(len(b)) + until_a[gb]] = b + base * np.where(last_b, 2, 0)
    return [numbers[i] for i in out.tolist()], until_a + until_b


def aligning(path_a: str, path_b: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side = (side_a(path_a), side_b(path_b))
        sizes = [np.fromiter(map(len, s.entries), np.int64, len(s.entries)) for s in side]
        ids = range(max(map(len, sizes)))
        numbers = [f"{i}{sign}" for sign in ",|;" for i in ids]
        at = TaskContext.get().partitionId() * ROWS
        for frame in frames:
            done = 0
            for texts in chunks(t if isinstance(t, str) else None for t in frame["text"]):
                keys = frame["key"].iloc[done : done + len(texts)]
                done += len(texts)
                yield from aligned_texts(texts, keys, at, side, sizes, numbers)
                at += len(texts)

    return run


def aligned_texts(texts: list[str], keys: pd.Series, at: int, side: tuple, sizes: list[np.ndarray], numbers: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of some texts: one for each, and more where the pairs take more than one slice."""
    some = [n for n, t in enumerate(texts) if t]
    tokens = [s.encode([texts[n] for n in some]) for s in side]
    fits = [k for k, n in enumerate(some) if all(b"".join(map(s.entries.__getitem__, x[k].tolist())) == b" " + texts[n].encode() for s, x in zip(side, tokens, strict=True))]
    some, tokens = [some[k] for k in fits], [[x[k] for k in fits] for x in tokens]
    n_a, n_b, n_groups, n_links = (np.zeros(len(texts), np.int64) for _ in range(4))
    n_a[some], n_b[some] = ([len(x) for x in t] for t in tokens)
    groups = [""] * len(texts)
    found: Iterator[tuple[np.ndarray, ...]] = iter(())
    if some:
        a, b = (np.concatenate(t).astype(np.int64) for t in tokens)
        ends_a, ends_b = (np.cumsum(s[t]) for s, t in zip(sizes, (a, b), strict=True))
        ends = shared_ends(ends_a, ends_b)
        ga, gb = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        until = ga[np.cumsum(n_a[some]) - 1] + 1  # groups up to the end of each text
        n_groups[some] = np.diff(np.r_[0, until])
        doc = np.repeat(np.array(some), n_groups[some])
        n_links[some] = np.add.reduceat(np.bincount(ga) * np.bincount(gb), np.r_[0, until[:-1]])
        strings, places = shown(ga, a, gb, b, numbers)
        from_ = 0
        for n, to in zip(some, places[until - 1].tolist(), strict=True):
            groups[n] = "".join(strings[from_:to])[:-1]
            from_ = to
        found = pairs(doc, ga, a, gb, b)
    rows = pd.DataFrame({"key": keys.to_numpy(), "nth": np.int32(0), "at": at + np.arange(len(texts)), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": groups})
    whole = np.arange(len(texts) + 1)
    for nth, (owner, *columns) in enumerate(found):
        cut = np.searchsorted(owner, whole)
        lists = {name: [x[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)] for name, x in zip(("a", "b", "times"), columns, strict=True)}
        part = rows.assign(**lists) if nth == 0 else rows.assign(nth=np.int32(nth), groups="", n_a=0, n_b=0, n_groups=0, n_links=0, **lists)[np.diff(cut) > 0]
        yield part
    if not some:
        yield rows.assign(a=[[]] * len(texts), b=[[]] * len(texts), times=[[]] * len(texts))


def aligned(docs: DataFrame, *, a: str | None = None, b: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document, at nth 0: its key, how many tokens, groups and links it has, the groups, and its distinct pairs (a,
    b, times). ``at`` numbers documents; where the pairs take several slices, further rows of the same ``at`` have those."""
    kind = docs.schema[key].dataType.simpleString()
    run = aligning(a or tokenizer_path(), b or tokenizer_path("piece_bpe_32k.model"))
    named = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))  # pandas would make floats of numbers with nulls
    return named.mapInPandas(run, f"key string, {SHAPE}").withColumn("key", F.col("key").cast(kind))


def links(table: DataFrame) -> DataFrame:
    """(at, a, b, times) of a written table of ``aligned``."""
    return table.select("at", F.inline(F.arrays_zip("a", "b", "times")))


def pair_counts(table: DataFrame) -> DataFrame:
    """A written table of id pairs: (a, b, n: the documents that hold it linked, best_a, best_b: is n its A or B id's highest)."""
    counts = written(links(table).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "counts")
    of_a, of_b = (counts.groupBy(side).agg(F.max("n").alias(f"most_{side}")) for side in ("a", "b"))
    both = counts.join(of_a, "a").join(of_b, "b")
    return written(both.select("a", "b", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b")), "pair_counts")


def counted(table: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents of a written table of ``aligned``, with n_best, n_best_b and count_sum of their links."""
    known = hot_join(links(table), counts.withColumn("rows", F.col("n")), ["a", "b"], "rows", keys=HOT_PAIRS, least=1, merge=True)
    sums = known.groupBy("at").agg(
        F.sum(F.when(F.col("best_a"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.when(F.col("best_b"), F.col("times")).otherwise(0)).alias("n_best_b"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    docs = table.where("nth = 0").drop("nth", "a", "b", "times").join(sums, "at", "left")
    return docs.fillna(0, ["n_best", "n_best_b", "count_sum"]).drop("at")
