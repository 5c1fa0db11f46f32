"""Sharding, mixing, packing, language, quality: against brute force on small fixtures."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import _features, language, mixing, packing, quality_pu, quality_rules, queries, sharding
from tests.llm.conftest import SCHEMA, awkward_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# sharding


def jump_one(key: int, shards: int) -> int:
    """The published loop, one key at a time."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_matches_the_loop_and_moves_only_into_the_new_shard():
    keys = np.random.default_rng(0).integers(-(1 << 63), (1 << 63) - 1, 3000)
    now, grown = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert now.tolist() == [jump_one(int(k), 16) for k in keys]
    assert set(grown[grown != now]) == {16}
    assert 0.03 < (grown != now).mean() < 0.09


def test_sharding_awkward(spark, awkward, empty):
    got = sharding.assign(awkward, shards=4).collect()
    assert len(got) == awkward.count()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    text = {r[0]: r[1] for r in awkward_rows() if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            data = text[r.doc_id]
            assert r["size"] == len((data or "").encode()) + 1
            assert r.text_crc32 == (None if data is None else zlib.crc32(data.encode()))
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.assign(empty).count() == 0


# mixing


def test_targets_share_the_excess():
    got = mixing.targets([10, 1000, 100], [3, 1, 2])
    assert got[0] == 20
    assert sum(got) == pytest.approx(1665)
    assert all(t <= 2 * s for t, s in zip(got, [10, 1000, 100], strict=True))
    assert mixing.targets([], []) == []
    assert mixing.targets([0, 0], [1, 2]) == [0, 0]


def test_mix_awkward(spark, awkward, empty):
    got = mixing.totals(mixing.mix(awkward)).collect()
    rows = awkward_rows()
    assert Counter(r["size"] for r in got) == Counter(len(WORD.findall(x[1] or "")) for x in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    taken, target = defaultdict(int), {}
    source = {(r[0], len(WORD.findall(r[1] or ""))): r[3] for r in rows}
    for r in got:
        name = source[r.key, r["size"]]
        taken[name] += r.taken
        target[name] = r.target
    assert all(abs(taken[k] - target[k]) <= 1 for k in target)
    again = mixing.totals(mixing.mix(awkward)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.totals(mixing.mix(empty)).count() == 0


def test_mix_rows_hold_the_words_taken(awkward):
    found = mixing.mix(awkward)
    rows = mixing.rows(awkward, found)
    assert rows.columns == awkward.columns
    assert {(r["row"], r["crc"], r["_part"]) for r in rows.collect()} == {("own", "own", 3)}
    words = defaultdict(int)
    for r in rows.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    want = defaultdict(int)
    for r in mixing.totals(found).collect():
        want[r.key] += r.taken
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in want.items() if v}


def test_a_hot_document_is_mixed_like_others(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATED", 7)
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rows = [(1, prose(1, 30), "a")] * 90 + [(i, prose(i, 30), "ab"[i % 2]) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = mixing.mix(docs)
    words = Counter()
    for r in mixing.rows(docs, found).collect():
        words[r.doc_id] += len(r.text.split())
    want = Counter()
    for r in mixing.totals(found).collect():
        want[r.key] += r.taken
    assert words == want


def test_schedule_is_even(spark):
    sources = [mixing.Source(0, "a", 500_000, 300_000.0), mixing.Source(1, "b", 90_000, 100_000.0)]
    rows = mixing.schedule(spark, sources).orderBy("place").collect()
    counts = Counter(r.code for r in rows)
    assert counts == {s.code: s.slots for s in sources}
    assert all(sorted(r["rank"] for r in rows if r.code == c) == list(range(n)) for c, n in counts.items())
    codes = np.array([r.code for r in rows])
    share = counts[1] / len(rows)
    for n in range(50, len(rows), 25):
        assert abs((codes[:n] == 1).sum() - share * n) < 4


# packing


def test_plan_uses_every_piece_and_comes_near_the_bound():
    rng = np.random.default_rng(1)
    counts = Counter(int(x) for x in np.minimum(1024, rng.exponential(300, 20_000).astype(int) + 1))
    plan = packing.plan(dict(counts))
    used = Counter()
    for uses, times in plan:
        assert sum(k * n for k, n in uses) <= 1024
        for k, n in uses:
            used[k] += n * times
    assert used == counts
    bins, bound = sum(t for _, t in plan), -(-sum(k * n for k, n in counts.items()) // 1024)
    assert bins <= bound * 1.01 + 2


@pytest.mark.parametrize(("counts", "room"), [({3: 2, 5: 1, 7: 4}, 20), ({4: 1, 6: 2}, 9), ({2: 9}, 7), ({}, 5), ({8: 1}, 5)])
def test_fullest_against_brute_force(counts, room):
    best = 0
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1)}
    best = max(s for s in sums if s <= room)
    got = packing.fullest({k: n for k, n in counts.items() if k <= room}, room)
    assert sum(k * n for k, n in got) == best
    assert all(n <= counts[k] for k, n in got)


def test_both_ways_to_encode_agree():
    texts = ["Hello  world\n\n x's I'll 123abc", "Größe für", "naïve \x1d\x85 \xa0 ok", "日本語 テスト", "a<|endoftext|>b", "", " ", "ǅ Ⅷ ²³", prose(5, 300)]
    path = packing.tokenizer_path()
    for t in texts:
        assert packing.encode(t, path).tolist() == packing.exact(path).encode(t, add_special_tokens=False).ids


def test_packing_awkward(awkward, empty):
    got = queries.packed(awkward).collect()
    path = packing.tokenizer_path()
    want = Counter()
    for row in awkward_rows():
        ids = np.array([*packing.exact(path).encode(row[1] or "", add_special_tokens=False).ids, 2], "<u4")
        for n, (start, length) in enumerate(packing.cuts(len(ids), 1024)):
            want[row[0], n, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for spans in at.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 1024
    assert queries.packed(empty).count() == 0


# language


def languages(spark):
    stems = {"aa": "lo mi ra ten gu sel vor", "bb": "ché vös nir æl umb", "cc": "sza prz nko wie"}
    rows = [(i, prose(i, 40, stems[lang]), lang) for i, lang in enumerate(sorted(stems) * 80)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_held_out(spark):
    docs = languages(spark)
    got = language.identify(docs, language.fit(docs)).select("row.lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_filters_return_all_languages_with_few_false_ones():
    keys = np.arange(1, 5001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    plane = np.zeros(language.POSITIONS, np.uint8)
    for p in range(language.PROBES):
        np.bitwise_or.at(plane, language.positions(keys, p), np.uint8(1))
        np.bitwise_or.at(plane, language.positions(keys[:2000], p), np.uint8(2))
    masks = np.full(len(keys), 255, np.uint8)
    for p in range(language.PROBES):
        masks &= plane[language.positions(keys, p)]
    assert (masks & 1 == 1).all()
    assert (masks[:2000] & 2 == 2).all()
    assert (masks[2000:] & 2 == 2).mean() < 0.01


def test_language_awkward(spark, awkward, empty):
    rows = spark.createDataFrame([(100 + i, t) for i, t in enumerate(["Ω", "日本語のテキスト", "Привет мир", "12 34", "", "\u0301"])], "doc_id long, text string")
    both = awkward.unionByName(rows, allowMissingColumns=True)
    got = language.identify(both, language.fit(awkward)).select("row.text", "lang_pred", "score").collect()
    assert len(got) == both.count()
    for r in got:
        if any(c.isalpha() for c in r[0] or ""):
            assert r[1] in ("aa", "bb")
        else:
            assert (r[1], r[2]) == ("und", 0.0)
    unknown = {r[0]: (r[1], r[2]) for r in got}
    usual = language.fit(awkward)
    assert unknown["日本語のテキスト"] == (usual.languages[usual.usual], 0.0)
    nothing = language.fit(empty)
    assert language.identify(empty, nothing).count() == 0
    assert language.identify(awkward, nothing).where("lang_pred <> 'und'").count() == 0


def brute_grams(text: str) -> list[str]:
    flat = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    return [flat[i : i + n] for n in (2, 3, 4) for i in range(len(flat) - n + 1) if flat[i : i + n].strip()]


def test_prediction_against_brute_force(monkeypatch):
    """Exact sets of n-grams instead of filters: the same shares, but for the filters' few false positives."""
    stems = {"aa": "lo mi ra ten gu sel vor", "bb": "ché lo mi vös nir", "cc": "sza prz nko wie"}
    known = {lang: set(brute_grams(" ".join(prose(i, 300, s) for i in range(3)))) for lang, s in stems.items()}
    kind = np.uint8
    plane = np.zeros(language.POSITIONS, kind)
    codes = {}
    for k, grams in enumerate(known.values()):
        for gram in sorted(grams):
            codes[gram] = gram
        text = " ".join(prose(i, 300, list(stems.values())[k]) for i in range(3))
        for keys, _ in language.grams([text]):
            for p in range(language.PROBES):
                np.bitwise_or.at(plane, language.positions(keys, p), kind(1 << k))
    miss = np.array([float(np.mean(plane >> kind(k) & kind(1))) ** language.PROBES for k in range(3)])
    filters = language.Filters(list(known), [plane], miss)
    texts = [prose(50 + i, 12, s) for i in range(10) for s in stems.values()] + ["Ω", "", "x 1 y", "lo! lo? LO"]
    got, scores = filters.predict(texts)
    for text, lang, score in zip(texts, got, scores, strict=True):
        grams = brute_grams(text)
        share = {k: sum(g in v for g in grams) / max(1, len(grams)) for k, v in known.items()}
        best = max(share.values())
        assert score == pytest.approx(best, abs=0.02)
        assert lang == ("und" if not grams else max(share, key=share.get) if best else "aa")
    for chunk in (16, 61):
        monkeypatch.setattr(language, "CHUNK", chunk)
        again, other = filters.predict(texts)
        assert again == got and np.allclose(other, scores)


def test_the_held_out_fold_is_not_learned_from(spark):
    docs = languages(spark)
    wrong = docs.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert "zz" not in language.fit(wrong).languages


# quality


def brute_counts(text: str) -> tuple:
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_counts_against_brute_force():
    texts = [x[1] or "" for x in awkward_rows()] + ["a b c a b c a b c", "x x x x", "a b c", "\u2003wide\u2003space", "a\x1cb", "l\n l\nl \nl", "a b a b a b"]
    for t in texts:
        assert quality_rules.counts(t.encode()) == brute_counts(t), t[:50]


def labelled(spark, n=600):
    rows, marks = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(i, 80) if good else " ".join(w + "***" for w in prose(i, 80).split())
        rows.append((i, text))
        marks.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality_rules_learn(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, quality_rules.fit(docs, labels)).select("row.doc_id", "kept").collect()}
    assert np.mean([got[i] == (i % 4 != 0) for i in got]) > 0.98


def test_quality_rules_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (9, 0)], "doc_id long, quality int")
    model = quality_rules.fit(awkward, labels)
    got = quality_rules.judge(awkward, model).select("row.doc_id", *(x.split()[0] for x in quality_rules.STATS.split(", ")), "base_failed", "kept").collect()
    assert len(got) == awkward.count()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((x[0], *brute_counts(x[1] or "")) for x in awkward_rows())
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert not any(r.kept for r in got if r.base_failed)
    none = quality_rules.fit(empty, labels)
    assert none is None
    assert quality_rules.judge(empty, none).count() == 0


def test_pu_learns_from_positives_and_unlabelled_text(spark):
    docs, labels = labelled(spark)
    model = quality_pu.fit(docs, labels.where("quality = 1"), prior=0.75)
    got = {r.doc_id: r.score for r in quality_pu.score(docs, model).collect()}
    good = np.array([got[i] for i in got if i % 4])
    bad = np.array([got[i] for i in got if not i % 4])
    assert (good >= 0.3).mean() > 0.98
    assert (bad < 0.3).mean() > 0.95


def test_the_prior_comes_from_positives_and_unlabelled_text(spark):
    docs, labels = labelled(spark, 2400)
    for share in (4, 2):  # one in four is bad, then one in two
        some = docs.where(F.col("doc_id") % 4 < share)
        model = quality_pu.fit(some, labels.where("quality = 1"))
        assert model.prior == pytest.approx(1 - 1 / share, abs=0.08)


def test_pu_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (3, 1), (9, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = quality_pu.score(awkward, quality_pu.fit(awkward, labels)).collect()
    assert len(got) == awkward.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.doc_id: r.held_out for r in got if r.doc_id} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in {x[0] for x in awkward_rows()} if i}
    assert quality_pu.score(empty, quality_pu.fit(empty, labels)).count() == 0


def test_long_texts_give_what_short_ones_do(monkeypatch):
    """n-grams of texts that are longer than CHUNK, with and without spaces, against any other CHUNK."""
    long_ones = [prose(1, 520_000), "x" * 1_500_000, prose(2, 30) + " " + "yz" * 1_200_000 + " end", prose(3, 40), ""]
    assert len(long_ones[0]) > 3 << 20
    weights = np.random.default_rng(0).standard_normal((len(_features.FAMILIES), _features.SIZE))
    texts = [t.encode() for t in long_ones]

    def found():
        ids, shares = _features.sparse(texts)
        grams = [Counter() for _ in texts]
        for keys, row in language.grams(long_ones):
            keys, row = np.asarray(keys), np.asarray(row)
            for r in np.unique(row):
                value, n = np.unique(keys[row == r], return_counts=True)
                grams[r].update(dict(zip(value.tolist(), n.tolist(), strict=True)))
        return ids, shares, _features.mean_weights(texts, weights), grams

    one = found()
    monkeypatch.setattr(_features, "CHUNK", 8 << 20)
    monkeypatch.setattr(language, "CHUNK", 8 << 20)
    monkeypatch.setattr(_features, "_powers", {})
    two = found()
    for a, b in zip(one[0] + one[1], two[0] + two[1], strict=True):
        assert np.array_equal(a, b)
    assert np.allclose(one[2], two[2]) and one[3] == two[3]
    words = long_ones[2].split()
    assert len(words) == 32  # a run without spaces is one word
    chars, count = len(texts[0]) - 3, len(texts[0].split())
    share = 1 / np.array([chars, count, count - 1])
    for k in range(3):
        got = one[1][0][one[0][0] >> _features.BITS == k] / share[k]
        assert got.sum() == pytest.approx(1 / share[k], rel=1e-4)


def test_schema_has_clashing_names():
    assert {"size", "score", "shard", "kept"} <= {x.split()[0] for x in SCHEMA.split(", ")}
