"""Byte-level BPE encoding and decoding by batched merge rounds.

A text is cut into words as the tokenizer's pattern does. The symbols of all words that a task hasn't met lie in one flat
array. In each round every word finds its lowest-ranked pair: keys of neighbouring symbols are looked up by binary search
among the sorted keys of all merges, and a minimum over each word's stretch of the array gives its rank. All places of that
pair are merged at once, from the left where they overlap; merges that a new symbol takes part in always rank behind the
one that made it, so this is what one merge at a time gives. Only pairs beside a merge are looked up again, and words
without a pair leave the array. Words that were met are kept, up to KEPT bytes of them.

Strings of special tokens in a text become these tokens, as ``encode`` of the tokenizers library has it without further
settings. Decoding looks up the bytes of ids and replaces what isn't UTF-8.

Nulls: a null text is empty and has no ids. A null key is kept. Repeated rows are encoded each for itself. Very long texts,
and very long words in them, are encoded whole. Of equal ranks in a word the leftmost place goes first. Columns other than
the key and the text are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.packing import COMMON, exact, tokenizer_path

#: The pattern that cuts texts into words, and the bytes that stand for themselves in a vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Ids are below this.
SPAN = 1 << 20
NONE = np.iinfo(np.int32).max
#: Bytes of words that a task keeps the ids of.
KEPT = 1 << 22
#: Characters of texts that are encoded at once; a longer text goes alone.
CHUNK = 1 << 20


def byte_of() -> dict[str, int]:
    """The byte of each character of a vocabulary file's byte-level entries."""
    hidden = (b for b in range(256) if b not in SHOWN)
    return {chr(b): b for b in SHOWN} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """The merges and entries of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cut = file["model"], file.get("pre_tokenizer") or {}
        if file.get("normalizer") or model.get("type", "BPE") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or model.get("byte_fallback"):
            raise ValueError(f"{path} isn't plain byte-level BPE")
        byte, vocab = byte_of(), model["vocab"]
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.first = np.zeros(256, np.int32)
        for c, b in byte.items():
            self.first[b] = vocab[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * SPAN + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(order.astype(np.int32), np.int32(NONE))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        entries = {i: s.encode() for s, i in self.special.items()} | {i: bytes(byte[c] for c in s) for s, i in vocab.items() if s not in self.special}
        size = max(entries, default=-1) + 1
        self.entries = [entries.get(i, b"") for i in range(size)]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is no such merge."""
        key = left.astype(np.int64) * SPAN + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(NONE))

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(symbol), NONE, np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.rank(symbol[inside], symbol[inside + 1])
        out_symbol, out_word = [symbol[:0]], [word[:0]]
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(word)]))
            over = low == NONE
            if over.any():
                out_symbol.append(symbol[over])
                out_word.append(word[over])
                symbol, word, rank, low = symbol[~over], word[~over], rank[~over], low[~over]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == low)
            fresh = np.r_[True, hit[1:] != hit[:-1] + 1]  # where places overlap, every other one of the run
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            stays = np.ones(len(symbol), bool)
            stays[hit + 1] = False
            at = np.cumsum(stays)[hit] - 1
            symbol, word, rank = symbol[stays], word[stays], rank[stays]
            beside = np.unique(np.concatenate([at, at[at > 0] - 1]))
            last = beside[(beside == len(word) - 1) | (word[np.minimum(beside + 1, len(word) - 1)] != word[beside])]
            rank[beside] = self.rank(symbol[beside], symbol[np.minimum(beside + 1, len(symbol) - 1)])
            rank[last] = NONE
        ids, owner = np.concatenate(out_symbol), np.concatenate(out_word)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts and keeps the ids of the words that it has met."""

    def __init__(self, path: str):
        self.path, self.vocabulary = path, vocabulary(path)
        self.words = regex.compile(PATTERN)
        found = sorted(map(regex.escape, self.vocabulary.special), key=len, reverse=True)
        self.special = regex.compile(f"({'|'.join(found)})") if found else None
        self.forget()

    def forget(self) -> None:
        special = self.vocabulary.special
        self.known: dict[str | int, int] = {i: n for n, i in enumerate(special.values())}  # a special token is kept by its id
        self.ids = np.array([*special.values()], np.int32)
        self.ends = np.arange(len(special) + 1, dtype=np.int64)

    def cut(self, text: str) -> list[str | int]:
        """The words of a text and the special tokens in it."""
        special = self.vocabulary.special
        if self.special is None or not any(s in text for s in special):
            return self.cut_plain(text)
        out: list[str | int] = []
        for part in self.special.split(text):
            if part:
                out += [special[part]] if part in special else self.cut_plain(part)
        return out

    def cut_plain(self, text: str) -> list[str]:
        if text.isascii() or max(text) < chr(COMMON):  # both patterns know the same letters and digits there
            return self.words.findall(text)
        return [text[a:b] for _, (a, b) in exact(self.path).pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's end (a 0 in front)."""
        if len(self.ids) * 4 > KEPT:
            self.forget()
        cut = [self.cut(t) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(w for c in cut for w in c) if w not in self.known]
        if new:
            ids, sizes = self.vocabulary.merged([w.encode() for w in new])
            self.known |= {w: n for n, w in enumerate(new, len(self.known))}
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
        which = np.fromiter((self.known[w] for c in cut for w in c), np.int64, sum(map(len, cut)))
        size = self.ends[which + 1] - self.ends[which]
        until = np.r_[0, np.cumsum(size)]
        ids = self.ids[np.repeat(self.ends[which] - until[:-1], size) + np.arange(until[-1])]
        return ids, until[np.r_[0, np.cumsum([len(c) for c in cut])]]


def chunks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Runs of texts of CHUNK characters, or of one longer text."""
    held, size = [], 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > CHUNK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


Batches = Iterator[pa.RecordBatch]


def encoding(path: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        encoder = Encoder(path)
        for batch in batches:
            at, keys = 0, batch.column(0)
            for texts in chunks(batch.column(1).to_pylist()):
                ids, ends = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], ["key", "ids"])
                at += len(texts)

    return run


def encoded(docs: DataFrame, *, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of each row."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(encoding(path or tokenizer_path()), f"key {kind}, ids array<int>")


def decoding(path: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        entries = vocabulary(path).entries
        for batch in batches:
            ids = batch.column("ids")
            data, ends, none = ids.values.to_numpy(), ids.offsets.to_numpy(), ids.is_null().to_pylist()
            texts = [None if none[n] else b"".join(map(entries.__getitem__, data[ends[n] : ends[n + 1]].tolist())).decode(errors="replace") for n in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decoded(tokens: DataFrame, *, path: str | None = None) -> DataFrame:
    """(key, ids) with the text that they stand for, as ``decoded``; null ids have none."""
    kind = tokens.schema["key"].dataType.simpleString()
    return tokens.select("key", "ids").mapInArrow(decoding(path or tokenizer_path()), f"key {kind}, ids array<int>, decoded string")
