"""SimHash, neighbours, WARC, URL filters and the pipeline."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import _work, neighbours, simhash, urls, warc
from tests.llm.conftest import CLASHES, EXTRA, awkward_rows, prose


def brute_print(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints: list[int], radius: int) -> list[int]:
    root = list(range(len(prints)))

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(prints))]


def near_texts() -> list[tuple[int, str | None]]:
    rows = [(r[0], r[1]) for r in awkward_rows() if r[0] is not None and r[0] != 7]
    for g in range(6):
        base = prose(100 + g, 200).split()
        for c in range(12):
            words = list(base)
            words[(c * 17) % 200] = f"w{c}"
            rows.append((1000 + 100 * g + c, " ".join(words).upper() if c % 3 else " ".join(words)))
    return rows


def test_simhash_against_brute_force(spark):
    rows = near_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    prints = [brute_print(t) for _, t in rows]
    tops = brute_groups(prints, 4)
    first = {}
    for (i, _), t in zip(rows, tops, strict=True):
        first[t] = min(first.get(t, i), i)
    want = Counter((i, p, first[t]) for (i, _), p, t in zip(rows, prints, tops, strict=True))
    got = simhash.linked(docs).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    kept = simhash.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(first.values()))


def test_tiles_lose_no_link(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 300)
    near = base[:100] ^ (np.int64(1) << rng.integers(0, 62, 100)) ^ (np.int64(1) << rng.integers(0, 62, 100))
    values = np.unique(np.concatenate([base, near]))
    values = values[np.lexsort((values, np.bitwise_count(values.view(np.uint64))))]
    monkeypatch.setattr(simhash, "HELD", 50)
    cut = 170
    edges = [simhash.compare(values[:cut], values[:cut], True, 4), simhash.compare(values[:cut], values[cut:], False, 4), simhash.compare(values[cut:], values[cut:], True, 4)]
    place = {int(v): k for k, v in enumerate(values)}
    node, root = simhash.forest(len(values), np.array([place[int(x)] for u, _ in edges for x in u]), np.array([place[int(x)] for _, v in edges for x in v]))
    top = np.arange(len(values))
    top[node] = root
    assert top.tolist() == brute_groups([int(v) & (1 << 64) - 1 for v in values], 4)


@pytest.mark.parametrize("at_once", [simhash.ONE_TASK, 0])
def test_components_of_a_long_chain(spark, monkeypatch, at_once):
    monkeypatch.setattr(simhash, "ONE_TASK", at_once)
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 300)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(chain).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {200: 100, 300: 100}
    assert simhash.components(chain.limit(0)).count() == 0
    loops = spark.createDataFrame([(-5, 7), (7, -5), (3, 3), (-9, 7)], "u long, v long")
    assert {r.node: r.root for r in simhash.components(loops).collect()} == {-5: -9, 7: -9}


def test_simhash_awkward(spark, awkward, empty):
    got = simhash.linked(awkward).collect()
    assert len(got) == awkward.count()
    blank = {r.component_id for r in got if r.fp == 0}
    assert blank == {4}
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids) == Counter(set(ids))
    assert None in ids and 8 in ids
    twice = spark.createDataFrame([(5, prose(1, 90)), (5, prose(2, 90)), (None, prose(3, 90)), (None, prose(4, 90)), (None, prose(3, 90))], "doc_id long, text string")
    assert simhash.one_of_each(twice).count() == 4
    assert simhash.linked(empty).count() == 0
    assert simhash.one_of_each(empty).count() == 0


# neighbours


def brute_near(rows: list[tuple], every: int, k: int) -> Counter:
    good = [(i, v) for i, v in rows if i is not None and v and not any(x is None or not np.isfinite(x) for x in v) and any(v)]
    out = Counter()
    for at, (q, x) in enumerate(good):
        if q % every == 0:
            rest = [(i, v) for n, (i, v) in enumerate(good) if n != at and len(v) == len(x)]
            near = sorted((float(np.cumsum((np.array(x) - np.array(v)) ** 2)[-1]), i) for i, v in rest)[:k]
            out.update((q, n + 1, i, float(np.sqrt(s))) for n, (s, i) in enumerate(near))
    return out


def vectors(n: int, size: int = 12) -> list[tuple]:
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, size)) * 3
    rows = [(i, (centres[i % 8] + rng.standard_normal(size)).round(3).tolist()) for i in range(n)]
    same = rows[3][1]
    rows += [(n + i, same) for i in range(150)]
    return [*rows, (9001, None), (9100, [0.0] * size), (9200, [float("nan")] + [1.0] * (size - 1)), (9300, [None] + [1.0] * (size - 1)), (None, same), (9400, [float("inf")] * size), rows[7], rows[0]]


def test_neighbours_of_whole_windows_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 64)
    monkeypatch.setattr(neighbours, "TILE", 16)
    rows = [*vectors(900), (11, [1.0, 2.0]), (20, [1.0, 3.0]), (1e9, None)]  # two of another length
    table = spark.createDataFrame([(None if i is None else int(i), v, 0.5) for i, v in rows], "vec_id long, embedding array<double>, score double").repartition(4)
    got = Counter(tuple(r) for r in neighbours.search(table, F.col("id") % 10 == 0, nearest_rows=10, half=2.0).collect())
    assert got == brute_near(rows, 10, 10)


@pytest.mark.parametrize("clustered", [True, False])
def test_windows_hold_most_neighbours(spark, monkeypatch, clustered):
    monkeypatch.setattr(neighbours, "PART", 256)
    monkeypatch.setattr(neighbours, "LEAST", 16)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 16))
    if clustered:
        x = rng.standard_normal((60, 16))[np.arange(3000) % 60] * 6 + x * 0.3
        x[:1000] = x[0] + rng.standard_normal((1000, 16)) * 1e-7  # a third of the rows nearly the same
    rows = [(i, v.tolist()) for i, v in enumerate(x.round(9))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    halves = []
    measured = neighbours.width
    monkeypatch.setattr(neighbours, "width", lambda *a: halves.append(measured(*a)) or halves[-1])
    got = {(r[0], r[2]) for r in neighbours.search(table, F.col("id") % 100 == 0).collect()}
    want = {(q, i) for q, _, i, _ in brute_near(rows, 100, 10)}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
    assert not clustered or halves[0] < 0.3


def test_neighbours_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    few = [(0, [1.0, 2.0]), (5, [2.0, 2.0]), (10, [1.0, 2.0])]
    got = Counter(tuple(r) for r in neighbours.search(spark.createDataFrame(few, kind), F.col("id") % 10 == 0).collect())
    assert got == brute_near(few, 10, 10)
    assert neighbours.search(spark.createDataFrame([], kind), F.col("id") % 10 == 0).count() == 0
    assert neighbours.search(spark.createDataFrame([(1, [1.0])], kind), F.col("id") % 10 == 0).count() == 0


def test_hilbert_steps_to_adjacent_cells():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    place = neighbours.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    along = cells[np.argsort(place)].astype(int)
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


# archives


def pages() -> list[tuple]:
    same = "<p>same</p>" * 40
    rows = [(i, f"https://{'www.' * (i % 2)}h{i % 7}.example.com/p/{i}?q={i}", f"<html>{prose(i, 30)}</html>") for i in range(300)]
    rows += [(400 + i, "https://hot.example.com/", same) for i in range(80)]
    return [*rows, (500, None, None), (501, None, ""), (502, "no scheme", "x"), (503, "http://ü.example/ä\r\nb: c", "ß"), (None, "http://n.example/", same), (None, "http://n2.example/", "lonely"), (504, "http://z.example/", "z" * 300_000)]


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 10)
    monkeypatch.setattr(warc, "INDEX_ROWS", 60)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    table = spark.createDataFrame([(*r, "x") for r in pages()], "page_id long, url string, html string, payload string").repartition(3)
    index = warc.build(warc.write(table))
    assert len(index.files) > 3
    keys = table.select(warc.url_key(F.col("url")).alias("url_key")).union(spark.createDataFrame([("com,absent)/",), ("",), ("zzz",)], "url_key string"))
    got = warc.read(warc.lookup(keys, index), index.captures).collect()
    first = {}
    for i, _, html in pages():
        data = (html or "").encode()
        if i is not None:
            first[data] = min(first.get(data, i), i)
    want = Counter()
    for i, _, html in pages():
        data = (html or "").encode()
        shared = sum((h or "").encode() == data for _, _, h in pages()) > 1
        refers = first[data] if shared and data in first and i != first[data] else None
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    texts = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert bytes(texts[503]) == "ß".encode() and len(texts[504]) == 300_000
    one = warc.read(warc.lookup(spark.createDataFrame([("com,example,hot)/",)], "url_key string"), index), 80).collect()
    assert len(one) == 80


def test_warc_least_and_empty(spark):
    kind = "page_id long, url string, html string"
    rows = [(1, "http://a/", "ab"), (2, "http://b/", "ab"), (3, "http://c/", "abcd"), (4, "http://d/", "abcd")]
    index = warc.build(warc.write(spark.createDataFrame(rows, kind), least=3))
    found = warc.read(warc.lookup(spark.createDataFrame(rows, kind).select(warc.url_key(F.col("url")).alias("url_key")), index), 4)
    assert {(r.page_id, r.refers_to) for r in found.collect()} == {(1, None), (2, None), (3, None), (4, 3)}
    nothing = spark.createDataFrame([], kind)
    index = warc.build(warc.write(nothing))
    assert index.files == []
    assert warc.read(warc.lookup(nothing.select(warc.url_key(F.col("url")).alias("url_key")), index), 0).count() == 0


def test_a_damaged_record_is_noticed():
    data = warc.record(1, "http://a/", b"payload", None)
    assert warc.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(data.replace(b"payload", b"pay1oad"))


# URLs


RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block"}


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("https://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/"),
        ("https://www.example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/"),
        ("https://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/"),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/"),
        ("https://example.com", "example.com", "", None),
        ("https://example.com?x=/en/", "example.com", "", None),
        ("ftp://b.net/es/1#/", "b.net", "/es/1", "net/es/"),
        ("b.net/es/", "", "", None),
        ("x://y://z/a", "y:", "//z/a", None),
        ("http://ÄB.com/É", "Äb.com", "/É", "com/"),
        ("http://a\nb.com/\nq", "a\nb.com", "/\nq", "com/"),
        ("", "", "", None),
        (None, "", "", None),
    ],
)
def test_url_parts_and_rules(spark, url, host, path, rule):
    table = spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")
    got = urls.judge(table, RULES, urls.Filter(None, {}, 0.0)).first()
    assert (got.host, got.path, got.rule) == (host, path, rule)
    assert got.verdict == (RULES[rule] if rule else "allow")


def test_trees_learn_lexical_signs(spark):
    rows = [(i, f"http://h{i % 9}.example.org/{'a/' * (i % 3)}{i * 7919 if i % 2 else 'page'}{'?x=1&y=2' if i % 2 else ''}", i % 2) for i in range(600)]
    table = spark.createDataFrame(rows, "page_id long, url string, label int")
    got = urls.judge(table, {}, urls.fit(table)).join(table.select("page_id", "label"), "page_id").collect()
    assert np.mean([(r.verdict == "block") == bool(r.label) for r in got]) > 0.97


def test_urls_without_a_rule_count_as_weak_allow(spark):
    rows = [(i, f"http://h{i % 9}.example.net/{('es', 'en')[i % 2]}/{i}") for i in range(400)]
    table = spark.createDataFrame(rows, "page_id long, url string")
    labelled = urls.labelled_by_rules(table, RULES)
    assert sorted((r.label, r.weight, r["count"]) for r in labelled.groupBy("label", "weight").count().collect()) == [(0.0, 0.5, 200), (1.0, 1.0, 200)]
    judged = {r.page_id: (r.rule, r.verdict) for r in urls.judge(table, RULES, urls.fit(labelled)).collect()}
    assert all(judged[i] == ("net/es/", "block") for i in range(0, 400, 2))
    echo = urls.fit(urls.labelled_by_rules(table.where("page_id % 2 = 0"), RULES, undecided=0.0))
    assert echo.trees is None  # one class only: nothing to learn


def test_a_hot_url_is_learned_from_once(spark):
    rows = [(i, "http://hot.com/a" if i < 500 else f"http://h.com/{i}", float(i % 2)) for i in range(1000)]
    table = spark.createDataFrame(rows, "page_id long, url string, label double")
    assert urls.fit(table, rows=100).trees is not None


def test_urls_one_class_and_empty(spark):
    table = spark.createDataFrame([(1, "http://a.com/", 1), (2, None, 1)], "page_id long, url string, label int")
    assert {r.verdict for r in urls.judge(table, {}, urls.fit(table)).collect()} == {"allow"}
    none = table.limit(0)
    assert urls.judge(none, RULES, urls.fit(none)).count() == 0


def test_entropy_and_counts(spark):
    row = urls.lexical(spark.createDataFrame([(1, "http://ab.com/x/y1.html?p=1&q=2")], "page_id long, url string")).first()
    text = "http://ab.com/x/y1.html?p=1&q=2"
    shares = np.array(list(Counter(text).values())) / len(text)
    assert row.entropy == pytest.approx(-(shares * np.log2(shares)).sum())
    assert (row.depth, row.parameters, row.ending, row.tld, row.url_length) == (2, 2, "html", "com", len(text))


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = []
    for i in range(150):
        lang = ("aa", "bb")[i % 2]
        stems = {"aa": "lo mi ra ten gu", "bb": "ché vös nir æl"}[lang]
        rows.append((i, prose(i, 90, stems), lang, f"s{i % 3}", None))
    rows += [(200 + i, rows[0][1], "aa", "s0", None) for i in range(20)]  # copies
    rows += [(300 + i, " ".join(f"{w}***" for w in prose(i, 90).split()), "aa", "s1", None) for i in range(60)]
    rows += [(400, None, "aa", None, None), (401, "1 2 3 " * 40, "aa", "s2", None), (None, prose(999, 90, "lo mi ra ten gu"), "aa", "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.lit(EXTRA[kind]).cast(kind).alias(name) for name, kind in CLASHES.items()))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 300)) for r in rows if r[0] is not None and r[0] < 360], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        assert at.columns == docs.columns, name
        found = at.collect()
        kept.append([r.doc_id for r in found])
        assert all(r[name] == EXTRA[kind] for r in found for name, kind in CLASHES.items()), name
    assert not any(i is not None and i >= 300 for i in kept[0])
    assert set(kept[0]) >= set(range(150))
    assert set(kept[1]) >= set(range(150)) and len(kept[1]) == len(kept[0])
    assert not any(i is not None and i >= 200 for i in kept[2]) and len(kept[2]) == len(set(kept[2])) == 151
    words = sum(len(r.text.split()) for r in at.collect())
    assert words == pytest.approx(1.5 * 151 * 90, abs=3)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(kept[3])
    assert max(r.offset + r.length for r in out) <= 1024


def test_pipeline_of_nothing(spark, tmp_path, empty):
    import corpus_pipeline

    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(_work, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(k, i) for k in range(6) for i in range(50 if k == 2 else 2)], "k int, i int")
    keyed = _work.written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 4").withColumn("v", F.col("k") * 10), "keyed")
    got = Counter((r.k, r.i, r.v) for r in _work.hot_join(rows, keyed, ["k"], "n").collect())
    assert got == Counter((r.k, r.i, r.k * 10) for r in rows.collect() if r.k != 4)


def test_scratch_and_discard(spark):
    import pathlib

    folder = lambda df: pathlib.Path(df.inputFiles()[0].removeprefix("file:")).parent
    with _work.scratch(spark):
        inside = folder(_work.written(spark.range(3), "inside"))
        assert inside.exists()
    outside = _work.written(spark.range(3), "outside")
    assert not inside.exists() and folder(outside).exists()
    gone = folder(outside)
    _work.discard(outside)
    assert not gone.exists()


def test_session_settings_stay(spark, awkward):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "777")
    try:
        simhash.linked(awkward).collect()
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "777"
        with pytest.raises(RuntimeError), _work.small_batches(spark, 16):
            assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "16"
            raise RuntimeError
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "777"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
