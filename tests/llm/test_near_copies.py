"""Near copies of the pipeline's near-dedup stage, against all pairs."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from cadenza.llm import near_copies
from tests.llm.conftest import awkward_rows, prose


def brute_set(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows: list[tuple[int, str | None]]) -> list[int]:
    known = [brute_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(x: int) -> int:
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(known):
        for j in range(i):
            b = known[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                top[root(i)] = root(j)
    return sorted({root(i): min(k for m, (k, _) in enumerate(rows) if root(m) == root(i)) for i in range(len(rows))}.values())


def edited(seed: int, words: int, changes: int) -> str:
    """``changes`` words of a text replaced, evenly spread."""
    out = prose(seed, words).split()
    for c in range(changes):
        out[(2 * c + 1) * words // (2 * changes)] = f"w{c}"
    return " ".join(out)


def edited_rows() -> list[tuple[int, str | None]]:
    rows = [(r[0], r[1]) for r in awkward_rows() if r[0] not in (None, 7)]
    for k, (words, changes) in enumerate([(248, 3), (248, 5), (400, 8), (600, 12), (90, 1), (1500, 30), (248, 9), (400, 20), (60, 2)]):
        base = prose(500 + k, words)
        rows += [(100 + 10 * k, base), (101 + 10 * k, edited(500 + k, words, changes).upper())]
    base = prose(600, 300).split()
    rows += [(1000 + c, " ".join([*base[: c * 7], "new", *base[c * 7 + 1 :]])) for c in range(40)]  # a group of copies
    return rows


def test_the_stage_keeps_one_of_edited_copies(spark):
    rows = edited_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_kept(rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
    assert {100, 110, 120}.issubset(want) and not {101, 111, 121} & set(want) and {161, 171} <= set(want)


@pytest.mark.parametrize("few", [1, 3])
def test_more_rounds_give_the_same(spark, few):
    rows = edited_rows()[-60:]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = near_copies.linked(docs, few=few).collect()
    assert sorted({r["component_id"] for r in found}) == brute_kept(rows)


def test_many_candidates_and_hot_ends_give_the_same(spark, monkeypatch):
    """The plans for more keys than are broadcast, for ends that very many pairs share, and for more links than one task takes."""
    from cadenza.llm import _work, simhash

    monkeypatch.setattr(near_copies, "KEYS", 0)
    monkeypatch.setattr(near_copies, "HOT_ROWS", 0)
    monkeypatch.setattr(_work, "HOT_ROWS", 2)
    monkeypatch.setattr(near_copies, "HOT_SETS", 30)
    monkeypatch.setattr(simhash, "ONE_TASK", 0)
    rows = edited_rows()[-70:]
    found = near_copies.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted({r["component_id"] for r in found}) == brute_kept(rows)


def test_what_is_unlisted_is_marked():
    rng = np.random.default_rng(1)
    nodes = np.zeros(300, near_copies.NODE)
    nodes["id"] = nodes["label"] = np.arange(300)
    nodes["n"] = np.sort(rng.integers(50, 70, 300))
    base = rng.integers(0, 1 << 63, (6, 2)).astype(np.uint64)
    nodes["hi"], nodes["lo"] = (base[np.arange(300) % 6, k] ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)) for k in (0, 1))
    bits = np.bitwise_count(nodes["hi"][:, None] ^ nodes["hi"]) + np.bitwise_count(nodes["lo"][:, None] ^ nodes["lo"])
    close = (bits <= near_copies.RADIUS) & (5 * np.minimum.outer(nodes["n"], nodes["n"]) >= 4 * np.maximum.outer(nodes["n"], nodes["n"]))
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True)}
    for few in (4, 1000):
        got, more = set(), set()
        for a, b, same in [(nodes[:170], nodes[:170], True), (nodes[:170], nodes[170:], False), (nodes[170:], nodes[170:], True)]:
            u, v, unlisted = near_copies.compare(a, b, same, few)
            got |= set(zip(u.tolist(), v.tolist(), strict=True))
            more |= set(unlisted.tolist())
        assert got <= want and all(set(p) <= more for p in want - got)
        assert (few == 1000) == (got == want) == (not more)


def test_awkward_rows(spark, awkward, empty):
    kept = near_copies.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(ids) == Counter(set(ids)) and None in ids and 8 in ids and 4 in ids and 5 not in ids and 2 not in ids
    twice = spark.createDataFrame([(5, prose(1, 90)), (5, prose(2, 90)), (None, prose(3, 90)), (None, prose(4, 90)), (None, prose(3, 90)), (6, edited(1, 90, 1)), (None, edited(3, 90, 1))], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in near_copies.one_of_each(twice).collect()) == ["5", "5", "None", "None"]
    assert near_copies.one_of_each(empty).count() == 0


def test_tiles_follow_nodes_and_not_ranges(spark):
    """Many small ranges make as many tiles as few large ones, with each node once and in order of size."""
    rows = spark.range(1000).selectExpr("id as hi", "id as lo", "id", "id as label", "cast(id % 50 as int) as n", "cast(repeat('x', 128) as binary) as wide").select(*near_copies.NODE.names)
    for parts in (1, 40):
        ranged = rows.repartitionByRange(parts, "n", "id").sortWithinPartitions("n", "id")
        strips = near_copies.written(ranged.mapInArrow(near_copies.cut(100), "part int, nth int, low int, high int, n long, nodes binary"), "strips")
        tiles = near_copies.gathered(strips, 100).orderBy("tile").collect()
        held = [np.frombuffer(b"".join(t["nodes"]), near_copies.NODE) for t in tiles]
        assert len(tiles) == 10 and max(map(len, held)) < 200
        assert [(t["low"], t["high"]) for t in tiles] == [(h["n"].min(), h["n"].max()) for h in held]
        nodes = np.concatenate(held)
        assert (np.diff(nodes["n"]) >= 0).all() and sorted(nodes["id"]) == list(range(1000))


def dense_rows() -> list[tuple[int, str]]:
    """A group of copies, and texts beside it that are candidates of all of them but near copies of none."""
    base = prose(700, 300).split()

    def changed(k: int, words: list[int]) -> str:
        return " ".join(f"x{k}" if i in words else w for i, w in enumerate(base))

    copies = [(k, changed(k, [7 * (k % 40) + 5])) for k in range(150)]
    beside = [(1000 + k, changed(1000 + k, [*range(k % 25 + 3, 300, 28)])) for k in range(40)]
    return copies + beside


@pytest.mark.parametrize("tile", [1 << 16, 1 << 14])
def test_the_pairs_of_a_dense_group_are_no_rows(spark, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "SET_FROM", tile, raising=False)
    rows, seen, verified, settled = dense_rows(), [], near_copies.verified, getattr(near_copies, "settled", None)

    def counted(docs, nodes, pairs, **names):
        seen.append(pairs.count())
        return verified(docs, nodes, pairs, **names)

    def links(docs, nodes, **names):
        seen.append(nodes.count())
        made = settled(docs, nodes, **names)
        seen.append(made.count())
        return made

    monkeypatch.setattr(near_copies, "verified", counted)
    monkeypatch.setattr(near_copies, "settled", links, raising=False)
    found = near_copies.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted({r["component_id"] for r in found}) == brute_kept(rows)
    assert sum(seen) <= 8 * len(rows), seen


def test_links_of_tiles_join_what_is_alike():
    """Tiles that share a group, against all pairs; nothing is joined over groups, and labels that are one already aren't compared."""
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 1 << 63, 60).astype(np.uint64) for _ in range(4)]
    sets = [np.unique(np.r_[base[k % 4][rng.random(60) < 0.97], rng.integers(0, 1 << 63, 1 + k % 5).astype(np.uint64)]) for k in range(80)]
    nodes = np.zeros(80, near_copies.GROUPED)
    nodes["id"] = nodes["label"] = np.arange(80)
    nodes["grp"], nodes["n"] = np.arange(80) // 4 % 2, [len(x) for x in sets]
    order = np.lexsort((nodes["id"], nodes["n"], nodes["grp"]))
    nodes, sets = nodes[order], [sets[k] for k in order]
    nodes["label"][:3] = nodes["label"][0]

    def groups(pairs) -> set[frozenset]:
        top = {int(x): int(x) for x in nodes["label"]}
        for u, v in pairs:
            old, new = top[int(u)], top[int(v)]
            top = {k: new if t == old else t for k, t in top.items()}
        return {frozenset(k for k in top if top[k] == t) for t in top.values()}

    want = [(nodes["label"][i], nodes["label"][j]) for i in range(80) for j in range(i) if nodes["grp"][i] == nodes["grp"][j] and 5 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 4 * (len(sets[i]) + len(sets[j]) - both)]
    got = []
    for a, b in [(slice(0, 55), slice(0, 55)), (slice(0, 55), slice(55, 80)), (slice(55, 80), slice(55, 80))]:
        u, v = near_copies.links(nodes[a], sets[a], nodes[b], sets[b], a == b)
        assert len(u) < len(set(nodes["label"][a]) | set(nodes["label"][b]))
        got += zip(u, v, strict=True)
    assert groups(got) == groups(want) and 2 < len(groups(want)) < 20
