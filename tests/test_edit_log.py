"""Random logs of edits against the edits made one after another on lists."""

import random

import pytest

from cadenza.operators import edit_log
from cadenza.operators import structure_rows as tabular


def in_turn(sections, bars, log):
    """``sections``: [id, bar ids], in order; ``bars``: ids. The listed bars at the end, in order, and the section ids."""
    sections, bars = [[i, list(b)] for i, b in sections], set(bars)
    for op, section, bar, over in log:
        ids = [i for i, _ in sections]
        if op == "add_section":
            sections.append([section, []])
            continue
        if op == "reorder":
            if section not in ids or over not in ids or section == over:
                continue
            moved = sections.pop(ids.index(section))
            sections.insert(ids.index(over), moved)
        if op == "add_bar":
            bars.add(bar)
        if op in ("move_bar", "remove_bar"):
            for s in sections:
                s[1] = [b for b in s[1] if b != bar]
        if op in ("add_bar", "move_bar"):
            for s in sections:
                if s[0] == section and bar in bars:
                    s[1].append(bar)
        if op == "remove_bar":
            bars.discard(bar)
        if op == "remove_section":
            bars -= {b for i, bs in sections if i == section for b in bs}
            sections = [s for s in sections if s[0] != section]
        bars &= {b for _, bs in sections for b in bs}
    return [b for _, bs in sections for b in bs if b in bars], [i for i, _ in sections]


def random_case(rng):
    sections = [[f"s{k}", [f"b{k}{n}" for n in range(rng.randrange(4))]] for k in range(rng.randrange(5))]
    bars = [b for _, bs in sections for b in bs] + ["loose0", "loose1"]
    log, names, known = [], [s for s, _ in sections] + ["nowhere"], [*bars, "nobody"]
    for k in range(rng.randrange(12)):
        op = rng.choice(["add_bar", "remove_bar", "move_bar", "move_bar", "add_section", "remove_section", "reorder", "reorder"])
        section, bar, over = rng.choice(names), rng.choice(known), rng.choice(names)
        if op == "add_bar":
            known.append(bar := f"n{k}")
        if op == "add_section":
            names.append(section := f"t{k}")
        log.append((op, section, bar, over))
    return sections, bars, log


def tables(spark, cases):
    s = [(d, i, float(k)) for d, (ss, _, _) in enumerate(cases) for k, (i, _) in enumerate(ss)]
    b = [(d, i) for d, (_, bs, _) in enumerate(cases) for i in bs]
    ls = [(d, i, float(k), n, bar) for d, (ss, _, _) in enumerate(cases) for k, (i, bs) in enumerate(ss) for n, bar in enumerate(bs)]
    log = [(d, 10 * (k + 1), *e) for d, (_, _, es) in enumerate(cases) for k, e in enumerate(es)]
    new_b = [(d, e[2]) for d, (_, _, es) in enumerate(cases) for e in es if e[0] == "add_bar"]
    new_s = [(d, e[1], None) for d, (_, _, es) in enumerate(cases) for e in es if e[0] == "add_section"]
    frame = spark.createDataFrame
    return (
        frame(s, "doc long, section_id string, at double"), frame(b, "doc long, bar_id string"), frame(ls, "doc long, section_id string, at double, pos long, bar_id string"),
        frame(log, "doc long, seq long, op string, section_id string, bar_id string, over string"), frame(new_b, "doc long, bar_id string"), frame(new_s, "doc long, section_id string, at double"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs(spark, seed):
    rng = random.Random(seed)
    cases = [random_case(rng) for _ in range(300)]
    sections, bars, listings, log, new_bars, new_sections = tables(spark, cases)
    after, left, listed = edit_log.applied(sections, bars, listings, log, new_bars=new_bars, new_sections=new_sections)
    got_bars, got_sections = {}, {}
    for r in tabular.reindexed(left, listed).orderBy("doc", "bar_index").collect():
        got_bars.setdefault(r["doc"], []).append(r["bar_id"])
    for r in after.orderBy("doc", "at").collect():
        got_sections.setdefault(r["doc"], []).append(r["section_id"])
    for d, case in enumerate(cases):
        want_bars, want_sections = in_turn(*case)
        assert (got_bars.get(d, []), got_sections.get(d, [])) == (want_bars, want_sections), case


def test_nothing(spark):
    empty = [t.limit(0) for t in tables(spark, [random_case(random.Random(3))])]
    assert [t.count() for t in edit_log.applied(*empty[:4])] == [0, 0, 0]


def test_only_edited_bars_are_followed(spark, monkeypatch):
    case = [["s0", [f"b{n:02}" for n in range(30)]], ["s1", ["c"]]], [f"b{n:02}" for n in range(30)] + ["c", "loose"], [("move_bar", "s1", "b07", None), ("remove_bar", None, "b08", None)]
    followed, whole = [], edit_log.placements
    monkeypatch.setattr(edit_log, "placements", lambda bars, *a: followed.append(bars.count()) or whole(bars, *a))
    sections, bars, listings, log, _, _ = tables(spark, [case])
    _, left, listed = edit_log.applied(sections, bars, listings, log)
    assert [r["bar_id"] for r in tabular.reindexed(left, listed).orderBy("bar_index").collect()] == in_turn(*case)[0]
    assert followed == [2]


@pytest.mark.parametrize("run", [1, 1 << 20])
def test_numbers_of_documents_long_and_short(spark, run):
    rng = random.Random(4)
    cases = [random_case(rng) for _ in range(100)]
    sections, bars, listings, log, new_bars, _ = tables(spark, cases)
    placed = bars.join(listings.drop("at"), ["doc", "bar_id"], "left")
    got = {}
    for r in edit_log.numbered(sections, placed, log, new_bars=new_bars, run=run).collect():
        got.setdefault(r["doc"], {})[r["bar_index"]] = r["bar_id"]
    for d, case in enumerate(cases):
        assert got.get(d, {}) == dict(enumerate(in_turn(*case)[0])), case
