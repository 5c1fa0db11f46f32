"""Hashed n-gram features of UTF-8 texts, with numpy over whole batches.

Texts are taken together in chunks of about CHUNK bytes. A text longer than that is read in steps which overlap: each
n-gram counts once, where it begins, whatever CHUNK is. Words are never cut.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BITS = 17
SIZE = 1 << BITS
FAMILIES = ("chars", "words", "pairs")
PRIME = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
MIX = np.uint64(0x9E3779B97F4A7C15)
SPACES = b" \t\n\r\x0b\x0c"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_space = re.compile(rb"[ \t\n\r\x0b\x0c]")
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of the prime and of its inverse."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        out = []
        for base in (PRIME, INVERSE):
            x = np.full(max(n, CHUNK + 64), base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = _powers[0] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """The rows of a chunk, and for each family the slots of its n-grams and the bounds of the rows among them."""
    rows: list[int] = []
    parts: list[bytes] = []
    held = 0

    def one() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        data, bounds, which = chunk(rows, parts)
        return which, instances(data, bounds)

    for row, text in enumerate(texts):
        if parts and held + len(text) > CHUNK:
            yield one()
            rows, parts, held = [], [], 0
        if len(text) > CHUNK:
            for found in steps(text):
                yield np.array([row]), [(slot, np.array([0, len(slot)])) for slot in found]
            continue
        rows.append(row)
        parts.append(text)
        held += len(text)
    if parts:
        yield one()


def steps(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The slots of each family in a long text, step by step."""
    data = np.frombuffer(text, np.uint8)
    none = np.zeros(0, np.int64)
    for at in range(0, len(data), CHUNK):
        yield quads(data[at : at + CHUNK + 3]), none, none
    at, last = 0, np.zeros(0, np.uint64)
    while at < len(text):
        found = _space.search(text, min(at + CHUNK, len(text)))
        end = found.start() if found else len(text)
        hashed = piece_hashes(text[at:end])
        joined = np.concatenate([last, hashed])
        yield none, slots(hashed), pair_slots(joined)
        at, last = end, joined[-1:]


def piece_hashes(piece: bytes) -> np.ndarray:
    """The words' hashes in a piece that ends with a word; what is longer than CHUNK is hashed block by block."""
    data = np.frombuffer(piece, np.uint8)
    starts, ends = word_bounds(data, np.array([0, len(data)]))
    if len(data) <= 2 * CHUNK or not len(starts):
        return word_hashes(data, starts, ends)
    head, total, power = int(starts[-1]), 0, powers(CHUNK)[0]
    for at in range(head, int(ends[-1]), CHUNK):
        block = data[at : min(at + CHUNK, int(ends[-1]))].astype(np.uint64) + np.uint64(1)
        total += int((block * power[: len(block)]).sum()) * pow(int(PRIME), at - head, 1 << 64)
    total += (int(ends[-1]) - head) * int(MIX)
    return np.append(word_hashes(data[:head], starts[:-1], ends[:-1]), np.uint64(total % (1 << 64)))


def chunk(rows: list[int], parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=bounds[1:])
    return np.frombuffer(b"".join(parts), np.uint8), bounds, np.array(rows)


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word never crosses a piece."""
    inside = ~IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word."""
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return (total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * MIX


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes * MIX >> np.uint64(64 - BITS)).astype(np.int64)


def quads(data: np.ndarray) -> np.ndarray:
    """The slot of each four bytes in a row."""
    if len(data) < 4:
        return np.zeros(0, np.int32)
    quad = data[:-3].astype(np.uint32) | data[1:-2].astype(np.uint32) << 8 | data[2:-1].astype(np.uint32) << 16 | data[3:].astype(np.uint32) << 24
    return (quad * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int32)


def pair_slots(hashed: np.ndarray) -> np.ndarray:
    return slots(hashed[:-1] * PRIME + hashed[1:]) if len(hashed) > 1 else np.zeros(0, np.int64)


def within(slot: np.ndarray, bounds: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the slots, one for each place, whose ``reach`` next places lie in the same row; and the rows' bounds."""
    n = int(bounds[-1])
    whole = np.zeros(n, bool)
    whole[: len(slot)] = True
    for back in range(1, reach + 1):
        at = bounds[1:-1] - back
        whole[at[at >= 0]] = False
    kept = np.concatenate([[0], np.cumsum(whole)])
    return slot[whole[: len(slot)]], kept[bounds]


def instances(data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family the hashed slot of each n-gram of the chunk, and the bounds of the rows among them."""
    starts, ends = word_bounds(data, bounds)
    hashed = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, bounds)
    return [within(quads(data), bounds, 3), (slots(hashed), first), within(pair_slots(hashed), first, 1)]


def mean_weights(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """For each text the sum, over the families, of the mean weight of its n-grams. weights: FAMILIES x SIZE."""
    total = np.zeros((len(FAMILIES), len(texts)))
    count = np.zeros((len(FAMILIES), len(texts)))
    for rows, families in chunks(texts):
        for k, (slot, at) in enumerate(families):
            running = np.zeros(len(slot) + 1)
            np.cumsum(weights[k][slot], out=running[1:])
            np.add.at(total[k], rows, running[at[1:]] - running[at[:-1]])
            np.add.at(count[k], rows, at[1:] - at[:-1])
    return (total / np.maximum(count, 1)).sum(axis=0)


def sparse(texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text the slots (family * SIZE + slot) and their shares of the family's n-grams."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    count = np.zeros((len(FAMILIES), len(texts)))
    for rows, families in chunks(texts):
        for k, (slot, at) in enumerate(families):
            for j, row in enumerate(rows):
                found[row].append(slot[at[j] : at[j + 1]].astype(np.int64) + k * SIZE)
                count[k][row] += at[j + 1] - at[j]
    ids, shares = [], []
    for row, parts in enumerate(found):
        slot, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
        ids.append(slot.astype(np.int32))
        shares.append((n / np.maximum(count[slot >> BITS, row], 1)).astype(np.float32))
    return ids, shares


def encoded(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Rows:
    """Sparse rows for a linear model. Products go over STEP entries at a time, so that little is copied."""

    STEP = 1 << 19

    def __init__(self, ids: list[np.ndarray], shares: list[np.ndarray]):
        self.bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        self.ids = np.concatenate(ids) if len(ids) else np.zeros(0, np.int32)
        self.shares = np.concatenate(shares) if len(shares) else np.zeros(0, np.float32)

    def blocks(self) -> Iterator[tuple[slice, slice]]:
        row, n = 0, len(self.bounds) - 1
        while row < n:
            end = max(row + 1, int(np.searchsorted(self.bounds, self.bounds[row] + self.STEP, side="right")) - 1)
            yield slice(row, end), slice(self.bounds[row], self.bounds[end])
            row = end

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.bounds) - 1)
        for rows, at in self.blocks():
            running = np.concatenate([[0.0], np.cumsum(self.shares[at] * weights[self.ids[at]])])
            bounds = self.bounds[rows.start : rows.stop + 1] - at.start
            out[rows] = running[bounds[1:]] - running[bounds[:-1]]
        return out

    def back(self, per_row: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for rows, at in self.blocks():
            each = np.repeat(per_row[rows], np.diff(self.bounds[rows.start : rows.stop + 1]))
            out += np.bincount(self.ids[at], self.shares[at] * each, minlength=size)
        return out


def gathered(table: pa.Table) -> list[tuple[float, np.ndarray, np.ndarray, bytes]]:
    """(y, ids, shares, dense) of the rows of a bounded sample, in an order that doesn't depend on tasks."""
    cols = [table.column(c).to_pylist() for c in ("y", "ids", "shares")]
    dense = table.column("dense").to_pylist() if "dense" in table.column_names else [b""] * table.num_rows
    rows = sorted(zip(*cols, dense, strict=True), key=lambda x: (zlib.crc32(x[1]), x[0], x[1]))
    return [(y, np.frombuffer(i, np.int32), np.frombuffer(s, np.float32), d) for y, i, s, d in rows]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
