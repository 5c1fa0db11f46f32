"""BPE rounds and tokenizer alignment: against the tokenizers libraries and a brute-force alignment."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cadenza.llm import alignment, bpe, packing, queries
from cadenza.llm._work import written
from tests.llm.conftest import SCHEMA, awkward_rows, prose

PATH = packing.tokenizer_path()
ODD = [*map(chr, range(1, 0x250)), *(list(" \n\t'stremlld aaaa éñ") * 12), *(["日", "本", "語", "́", "‍", "😀", "ا", "　", " ", "\x85", "\x1c", "१", "½", "▁", "<|endoftext|>", "<|endof", "<0x41>", "<s>", "<unk>"] * 6)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(n)]


# encoding and decoding


def test_rounds_give_what_the_library_gives(library):
    rng = random.Random(3)
    texts = odd_texts(4000, 1) + ["a" * 5001, "ab" * 3000, " " * 4001, "\n" * 333, "".join(rng.choices("abcdefghij", k=20_000)), "", prose(5, 3000)]
    encoder = bpe.Encoder(PATH)
    for held in bpe.chunks(texts):
        ids, ends = encoder.encode(held)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [x.ids for x in library.encode_batch(held, add_special_tokens=False)]


def test_words_that_were_forgotten_are_encoded_again(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 64)
    encoder = bpe.Encoder(PATH)
    for text in odd_texts(200, 2):
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_the_quick_tokenizer_of_packing_gives_the_same_ids():
    exact = packing.exact(PATH)
    for text in odd_texts(4000, 4):
        assert packing.encode(text, PATH).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_ranks_are_found_by_pair():
    v = bpe.vocabulary(PATH)
    left, right = v.first[[ord("h"), ord("q")]], v.first[[ord("e"), ord("\n")]]
    rank = v.rank(left, right)
    assert v.entries[v.made[rank[0]]] == b"he" and rank[1] == bpe.NONE


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Vocabulary(packing.tokenizer_path("word_bpe_49k.json"))


def test_encoding_awkward(spark, awkward, empty, library):
    got = bpe.decoded(bpe.encoded(awkward)).collect()
    texts = [r[1] or "" for r in awkward_rows()]
    assert sorted((str(r.key), r.decoded) for r in got) == sorted((str(r[0]), t) for r, t in zip(awkward_rows(), texts, strict=True))
    assert all(list(r.ids) == library.encode(r.decoded, add_special_tokens=False).ids for r in got)
    assert bpe.decoded(bpe.encoded(empty)).count() == 0


def test_ids_that_are_no_text_are_replaced(spark, library):
    broken = [library.encode("é", add_special_tokens=False).ids, [int(bpe.vocabulary(PATH).first[0xC3])], [], None]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(broken)], "key long, ids array<int>")
    assert {r.key: r.decoded for r in bpe.decoded(rows).collect()} == {0: "é", 1: "�", 2: "", 3: None}


def test_bpe_query(spark, tmp_path, library):
    texts = [*odd_texts(60, 6), prose(8, 500), "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_batched_bpe(spark, str(tmp_path)).collect()}
    for n, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[n].n_tokens, got[n].ids_sha256, got[n].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


# alignment


def aligned_one(text: str | None, a: Tokenizer, b: SentencePieceProcessor, bytes_a: list[bytes]) -> list[tuple[list[int], list[int]]]:
    """The groups of one text, end by end."""
    if not text:
        return []
    ids = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    parts = [bytes_a[i] for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
    if any(b"".join(x) != f" {text}".encode() for x in parts):
        return []
    groups, x, y, i, j = [([], [])], 0, 0, 0, 0
    while i < len(ids[0]) or j < len(ids[1]):
        if x <= y:
            groups[-1][0].append(ids[0][i])
            x += len(parts[0][i])
            i += 1
        else:
            groups[-1][1].append(ids[1][j])
            y += len(parts[1][j])
            j += 1
        if x == y:
            groups.append(([], []))
    return groups[:-1]


def brute(texts: list[str | None]) -> list[tuple]:
    a, b = Tokenizer.from_file(PATH), SentencePieceProcessor(model_file=packing.tokenizer_path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    bytes_a = bpe.vocabulary(PATH).entries
    found = [aligned_one(t, a, b, bytes_a) for t in texts]
    links = [[(x, y) for g in groups for x in g[0] for y in g[1]] for groups in found]
    count = defaultdict(int)
    for each in links:
        for pair in set(each):
            count[pair] += 1
    most_a, most_b = defaultdict(int), defaultdict(int)
    for (x, y), n in count.items():
        most_a[x], most_b[y] = max(most_a[x], n), max(most_b[y], n)
    out = []
    for groups, each in zip(found, links, strict=True):
        shown = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        counts = [count[p] for p in each]
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(each), sum(count[p] == most_a[p[0]] for p in each), sum(count[p] == most_b[p[1]] for p in each), sum(counts), shown))
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_b", "count_sum", "groups")


def test_alignment_equals_brute_force(spark):
    texts = [*odd_texts(150, 9), *[prose(n, 60) for n in range(40)], "the same text", "the same text", "日本語の文章" * 20, "x" * 700, " " * 90, "", None, "<|endoftext|> plain", prose(77, 2000)]
    docs = spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    table = written(alignment.aligned(docs), "aligned")
    got = {int(r.key): tuple(r[c] for c in NAMES) for r in alignment.counted(table, alignment.pair_counts(table)).collect()}
    assert got == dict(enumerate(brute(texts)))


@pytest.mark.parametrize("hot", [1, 300, 1 << 16])
def test_counts_are_joined_by_one_plan_at_every_size(spark, monkeypatch, hot):
    """Also a table of counts that Spark would broadcast: pairs of few rows are shuffled, and only those."""
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot, raising=False)
    texts = [*[prose(n, 40) for n in range(30)], "the same text", "the same text", None]
    docs = spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    table = written(alignment.aligned(docs), "aligned")
    made = alignment.counted(table, alignment.pair_counts(table))
    assert {int(r.key): tuple(r[c] for c in NAMES) for r in made.collect()} == dict(enumerate(brute(texts)))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 1 and plan.count("strategy=broadcast") == (0 if hot == 1 else 2), plan


def test_slices_hold_the_same_pairs(monkeypatch):
    rng = np.random.default_rng(0)
    doc = np.sort(rng.integers(0, 9, 60))
    ga, gb = np.sort(np.r_[np.arange(60), rng.integers(0, 60, 300)]), np.sort(np.r_[np.arange(60), rng.integers(0, 60, 300)])
    a, b = rng.integers(0, 40, len(ga)), rng.integers(0, 40, len(gb))
    want = defaultdict(int)
    for g, x in zip(ga, a, strict=True):
        for y in b[gb == g]:
            want[doc[g], x, y] += 1
    for held in (1 << 22, 100):
        monkeypatch.setattr(alignment, "HELD", held)
        slices = [list(zip(*(c.tolist() for c in s), strict=True)) for s in alignment.pairs(doc, ga, a, gb, b)]
        assert (len(slices) > 1) == (held == 100)
        assert {(d, x, y): n for s in slices for d, x, y, n in s} == want


def test_alignment_awkward(spark, awkward, empty):
    table = written(alignment.aligned(awkward), "aligned")
    got = alignment.counted(table, alignment.pair_counts(table)).collect()
    want = brute([r[1] for r in awkward_rows()])
    assert sorted((str(r.key), *(r[c] for c in NAMES)) for r in got) == sorted((str(r[0]), *w) for r, w in zip(awkward_rows(), want, strict=True))
    none = written(alignment.aligned(empty), "aligned")
    assert alignment.counted(none, alignment.pair_counts(none)).count() == 0


def test_alignment_query(spark, tmp_path):
    texts = [*odd_texts(30, 12), prose(8, 300), "", None]
    spark.createDataFrame([(n, t, "aa", None, 0) for n, t in enumerate(texts)], SCHEMA.split(", size")[0]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_token_alignment(spark, str(tmp_path)).collect()}
    for n, want in enumerate(brute(texts)):
        assert tuple(got[n][c] for c in NAMES[:-1]) == want[:-1]
        assert got[n].groups_sha256 == (hashlib.sha256(want[-1].encode()).hexdigest() if want[-1] else "")


def test_pieces_carry_the_checksum_of_their_ids(spark):
    docs = spark.createDataFrame([(1, prose(4, 900)), (2, None), (3, "x")], "doc_id long, text string")
    got = packing.pieces(docs, capacity=64).collect()
    assert len(got) > 10 and all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
