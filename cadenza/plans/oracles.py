"""DuckDB SQL for the registered queries, written from the rules and not from the DataFrame code.

Common table expressions hold the fixed vocabularies and the bindings; ``joined`` CTEs work on rows where the engine
works on arrays.
"""

from __future__ import annotations

from cadenza import dims

ORACLES: dict[str, str] = {}


def lit(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(lit, x)) + "]"
    return str(x)


def values(rows: list) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, row)) + ")" for row in rows)


SHARPS, FLATS = lit(dims.SHARPS), lit(dims.FLATS)


def wrap(x: str) -> str:
    return f"((({x}) % 12 + 12) % 12)"


def name(index: str, root: str | None = None) -> str:
    sharp = f"{SHARPS}[{wrap(index)} + 1]"
    if root is None:
        return sharp
    return f"(CASE WHEN {root} IN ('F', 'Bb', 'Eb', 'Ab', 'Db', 'Gb') THEN {FLATS}[{wrap(index)} + 1] ELSE {sharp} END)"


def preferred(index: str) -> str:
    flat = f"{FLATS}[{wrap(index)} + 1]"
    return f"(CASE WHEN {flat} IN ('F', 'Bb', 'Eb', 'Ab', 'Db', 'Gb') THEN {flat} ELSE {SHARPS}[{wrap(index)} + 1] END)"


def moved(root: str, intervals: str) -> str:
    return f"list_transform({intervals}, lambda i: CAST({wrap(f'{root} + i')} AS INTEGER))"


def text(x: str) -> str:
    return f"array_to_string({x}, ',')"


def family(x: str) -> str:
    has = lambda k: f"list_contains({x}, {k})"
    return f"CASE WHEN {has(4)} AND {has(8)} THEN 'AUG' WHEN {has(3)} AND {has(6)} THEN 'DIM' WHEN {has(4)} THEN 'MAJ' WHEN {has(3)} THEN 'MIN' ELSE 'NOTHIRD' END"


KINDS = f"kinds(pos, type_id, type_label, symbol, intervals) AS ({values([(k, *t) for k, t in enumerate(dims.CHORD_TYPES)])})"
SCALES = f"scales(pos, scale_id, scale_label, intervals) AS ({values([(k, *s) for k, s in enumerate(dims.SCALES)])})"
FIELD = f"""{KINDS}, templates7(is_minor, degree, numeral, type_id, fn, above) AS ({values(dims.FIELD)}),
keys AS (SELECT CAST(r AS INTEGER) AS key_root, m AS is_minor FROM range(12) t(r), (VALUES (FALSE), (TRUE)) u(m)),
field AS (
  SELECT key_root, k.is_minor, CAST(degree AS INTEGER) AS degree, numeral, t.type_id, fn, symbol, intervals, CAST((key_root + above) % 12 AS INTEGER) AS chord_root,
    {name('key_root + above', name('key_root'))} || symbol AS chord_name, {moved('key_root + above', 'intervals')} AS notes, {family('intervals')} AS family
  FROM keys k JOIN templates7 t ON k.is_minor = t.is_minor JOIN kinds USING (type_id)
)"""
ORDER = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"
VOCABULARY = f"vocabulary(t, quality, intervals, symbol) AS ({values([(k, *t) for k, t in enumerate(dims.TEMPLATES)])})"
MATCHED = f"""{VOCABULARY},
bars AS (SELECT l_suppkey AS song, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {ORDER}) - 1 AS INTEGER) AS bar, l_partkey AS pk, l_linenumber AS ln, l_returnflag AS f, l_quantity AS q FROM lineitem),
harmony AS (
  SELECT song, bar, unnest(CASE WHEN ln = 4 THEN [] WHEN f = 'R' THEN [40 + (pk * ln * 5) % 30, 41 + (pk * ln * 11) % 30] ELSE list_transform(intervals, lambda i: i + 48 + pk % 12) END) AS midi
  FROM bars JOIN vocabulary ON t = (pk * 7 + ln) % 18
),
bass AS (
  SELECT song, bar, unnest(CASE WHEN f = 'N' AND ln = 4 THEN [24 + pk % 12, 31 + pk % 12] WHEN f = 'N' THEN [24 + (pk + CASE WHEN ln = 7 THEN 1 ELSE 0 END) % 12] WHEN f = 'R' THEN [24 + (pk + ln) % 12] ELSE [] END) AS midi FROM bars
),
hm AS (SELECT song, bar, bit_or(CAST(1 << CAST(midi % 12 AS INTEGER) AS INTEGER)) AS mask FROM harmony GROUP BY ALL),
bm AS (SELECT song, bar, bit_or(CAST(1 << CAST(midi % 12 AS INTEGER) AS INTEGER)) AS mask, min(midi) % 12 AS low FROM bass GROUP BY ALL),
readings AS (
  SELECT CAST(r AS INTEGER) AS root, quality, symbol, v.intervals, list_reduce(list_transform(list_distinct({moved('r', 'v.intervals')}), lambda p: CAST(1 << p AS INTEGER)), lambda a, b: a + b) AS mask
  FROM range(12) x(r), vocabulary v
),
tallied AS (
  SELECT b.song, b.bar, b.pk, b.q, hm.mask IS NULL AND bm.mask IS NULL AS silent, count(c.root) AS n, count(c.root) FILTER (c.root = bm.low) AS agree,
    list(struct_pack(root := c.root, quality := c.quality, intervals := c.intervals, symbol := c.symbol)) FILTER (c.root IS NOT NULL) AS all_of,
    list(struct_pack(root := c.root, quality := c.quality, intervals := c.intervals, symbol := c.symbol)) FILTER (c.root = bm.low) AS agreeing
  FROM bars b LEFT JOIN hm USING (song, bar) LEFT JOIN bm USING (song, bar) LEFT JOIN readings c ON c.mask = coalesce(hm.mask, bm.mask) GROUP BY ALL
),
matched AS (SELECT *, CASE WHEN n = 1 THEN all_of[1] WHEN n > 1 AND agree = 1 THEN agreeing[1] END AS c, CASE WHEN silent THEN 'no-chord-data' WHEN n = 1 OR (n > 1 AND agree = 1) THEN 'chord' ELSE 'unclear' END AS kind FROM tallied)"""

ORACLES["match_bar"] = f"WITH {MATCHED} SELECT song, bar, kind, c.root AS root_pc, c.quality AS quality, {text('c.intervals')} AS intervals FROM matched"
ORACLES["outcome_shares"] = f"WITH {MATCHED} SELECT kind, count(*) AS n, CAST(floor(100.0 * count(*) / sum(count(*)) OVER () + 0.5) AS BIGINT) AS percent FROM matched GROUP BY kind"

CLAMPED = "greatest(0.5, least(8.0, floor(CAST({} AS DOUBLE) * 2 + 0.5) / 2))"
ANALYZED = f"""{MATCHED}, {FIELD},
own AS (
  SELECT m.song, m.bar, kind, c, CAST(song % 12 AS INTEGER) AS key_root, {CLAMPED.format('q / 6')} AS beats, CASE WHEN kind = 'chord' THEN {family('c.intervals')} END AS fam, (song // 12) % 2 = 1 AS is_minor FROM matched m
),
steps AS (
  SELECT o.*, CASE WHEN fam = 'NOTHIRD' OR fam = f.family THEN f.degree - 1 END AS own_degree, CASE WHEN fam = 'NOTHIRD' OR fam = f.family THEN f.numeral END AS own_numeral
  FROM own o LEFT JOIN field f ON f.key_root = o.key_root AND f.is_minor = o.is_minor AND f.chord_root = o.c.root
),
labelled AS (
  SELECT *, CASE WHEN kind = 'chord' THEN struct_pack(degree := own_degree, label := coalesce(own_numeral, {name('c.root', preferred('key_root'))} || c.symbol),
    intervals := CASE WHEN own_numeral IS NULL THEN {text(moved('c.root - key_root', 'c.intervals'))} END) END AS step FROM steps
),
analyzed AS (
  SELECT *, last_value(step IGNORE NULLS) OVER (PARTITION BY song ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM labelled
),
done AS (
  SELECT song, bar, CAST(bar + 1 AS INTEGER) AS number, kind, CASE WHEN kind = 'chord' THEN {name('c.root')} || c.quality END AS detected, kind <> 'chord' AND prior IS NOT NULL AS carried,
    coalesce(step, prior).degree AS degree, coalesce(coalesce(step, prior).label, '?') AS label, coalesce(step, prior).intervals AS step_intervals, beats, CASE WHEN kind <> 'chord' THEN 'unsure' END AS confidence
  FROM analyzed
)"""
ORACLES["analyze_bars"] = f"WITH {ANALYZED} SELECT song, number, kind, detected, carried, CAST(degree AS INTEGER) AS degree, label, step_intervals, beats, confidence FROM done"
ORACLES["bar_summary"] = f"""WITH {ANALYZED} SELECT song, count(*) FILTER (NOT carried AND degree IS NOT NULL) AS diatonic, count(*) FILTER (kind = 'chord' AND degree IS NULL) AS chromatic,
  count(*) FILTER (kind = 'unclear') AS unclear, count(*) FILTER (kind = 'no-chord-data') AS no_data FROM done GROUP BY song"""
ORACLES["assemble_sections"] = f"""WITH {ANALYZED} SELECT song, CAST(bar // 64 + 1 AS INTEGER) AS section, 'Parte ' || (bar // 64 + 1) AS section_label, CAST(count(*) AS INTEGER) AS n_steps, string_agg(label, ' ' ORDER BY bar) AS labels, sum(beats) AS beats FROM done GROUP BY ALL"""
PART_KEYS = "part_keys AS (SELECT p_partkey, CAST(p_partkey % 12 AS INTEGER) AS key_root, (p_partkey // 12) % 2 = 1 AS is_minor FROM part)"
ORACLES["harmonic_field"] = f"""WITH {FIELD}, {PART_KEYS} SELECT p_partkey, key_root, is_minor, degree, numeral, fn AS "function", chord_name, {text('notes')} AS notes,
  {text(f"list_transform(notes, lambda n: {name('n', name('key_root'))})")} AS note_names, family FROM field JOIN part_keys USING (key_root, is_minor)"""

STEP_NAME = "CASE {d} WHEN 1 THEN 'ST' WHEN 2 THEN 'T' WHEN 3 THEN 'T+ST' ELSE {d} || 'st' END"
ORACLES["scale_notes"] = f"""WITH {SCALES} SELECT n_nationkey, scale_id, {text(moved('n_nationkey', 'intervals'))} AS notes,
  {text(f"list_transform(intervals, lambda i: {name('n_nationkey + i', name('n_nationkey'))})")} AS names,
  {text(f"list_transform(range(2, len(intervals) + 1), lambda k: {STEP_NAME.format(d='(intervals[k] - intervals[k - 1])')})")} AS steps FROM nation, scales"""
ORACLES["scale_compare"] = f"""WITH {SCALES}, n AS (SELECT n_nationkey, scale_id, intervals, {moved('n_nationkey', 'intervals')} AS notes FROM nation, scales),
p AS (SELECT a.n_nationkey, a.scale_id AS scale_a, b.scale_id AS scale_b, a.notes AS na, b.notes AS nb, a.intervals AS ia, b.intervals AS ib FROM n a JOIN n b ON a.n_nationkey = b.n_nationkey AND a.scale_id <> b.scale_id),
u AS (SELECT *, list_concat(na, list_filter(nb, lambda x: NOT list_contains(na, x))) AS un FROM p)
SELECT n_nationkey, scale_a, scale_b, {text('list_filter(na, lambda x: list_contains(nb, x))')} AS shared, {text('list_filter(na, lambda x: NOT list_contains(nb, x))')} AS only_a, {text('list_filter(nb, lambda x: NOT list_contains(na, x))')} AS only_b,
  {text('un')} AS "union", {text("list_transform(un, lambda x: CASE WHEN list_contains(na, x) AND list_contains(nb, x) THEN 'shared' WHEN list_contains(na, x) THEN 'a' ELSE 'b' END)")} AS kinds,
  {text("list_transform(list_filter(range(2, greatest(len(ia), len(ib)) + 1), lambda k: ia[k] IS DISTINCT FROM ib[k]), lambda k: k || 'o')")} AS degrees,
  array_to_string(list_transform(range(12), lambda k: CASE WHEN list_contains(na, (n_nationkey + k) % 12) AND list_contains(nb, (n_nationkey + k) % 12) THEN 's' WHEN list_contains(na, (n_nationkey + k) % 12) THEN 'a' WHEN list_contains(nb, (n_nationkey + k) % 12) THEN 'b' ELSE '-' END), '') AS strip
FROM u"""
CHROMATIC = f"common(category, label, above, type_id) AS ({values(dims.CHROMATIC)})"
ORACLES["chromatic_steps"] = f"""WITH {KINDS}, {CHROMATIC} SELECT p_partkey, CAST(p_partkey % 12 AS INTEGER) AS key_root, category, label, {text(moved('p_partkey + above', 'intervals'))} AS notes, {text(moved('above', 'intervals'))} AS step_intervals
FROM part, common JOIN kinds USING (type_id)"""
CHORDS = f"{KINDS}, chords AS (SELECT p_partkey, p_partkey % 12 AS root_note, (p_partkey // 12) % 12 AS key_root, k.* FROM part JOIN kinds k ON k.pos = p_size % 9)"
ORACLES["manual_chromatic_steps"] = f"""WITH {CHORDS} SELECT p_partkey, {name('root_note', preferred('key_root'))} || symbol AS label, {text(moved('root_note', 'intervals'))} AS notes, {text(moved('root_note - key_root', 'intervals'))} AS step_intervals FROM chords"""
VOICED = "list_transform(range(1, len(notes) + 1), lambda k: struct_pack(note := notes[k], octave := {base} + len(list_filter(range(2, k + 1), lambda j: notes[j] <= notes[j - 1]))))"
ORACLES["note_functions"] = f"""WITH {CHORDS}, c AS (SELECT *, {moved('root_note', 'intervals')} AS notes FROM chords), v AS (SELECT *, {VOICED.format(base=3)} AS voices FROM c)
SELECT p_partkey, {preferred('root_note')} AS root_name, CAST(root_note AS INTEGER) AS root_index, {name('root_note')} || '3' AS tone, {SHARPS}[(p_partkey % 128) % 12 + 1] || ((p_partkey % 128) // 12 - 1) AS midi_name, {family('intervals')} AS family,
  CAST(list_reduce(list_transform(list_distinct(notes), lambda p: CAST(1 << p AS INTEGER)), lambda a, b: a + b) AS INTEGER) AS mask, {text("list_transform(voices, lambda x: x.note || '@' || x.octave)")} AS voicing, 'R_n' || p_partkey || '_' || type_id AS slug FROM v"""
ORACLES["colors"] = f"""WITH p AS (SELECT p_partkey, {lit(dims.PALETTE)}[p_partkey % 12 + 1] AS color FROM part), b AS (SELECT *, list_transform([2, 4, 6], lambda k: CAST('0x' || substr(color, k, 2) AS INTEGER)) AS rgb FROM p)
SELECT p_partkey, color, {text('rgb')} AS rgb, {text('list_transform(rgb, lambda c: CAST(floor(c + (255 - c) * 0.5) AS INTEGER))')} AS light FROM b"""
BASS = f"strings(no, open, oct) AS ({values([(k, n, o) for k, (n, o) in enumerate(dims.BASS)])})"
ORACLES["bass_positions"] = f"""WITH {CHORDS}, {BASS}, c AS (SELECT p_partkey, {moved('root_note', 'intervals')} AS notes FROM chords), v AS (SELECT p_partkey, unnest(range(len(notes))) AS position, unnest({VOICED.format(base=1)}) AS x FROM c),
f AS (SELECT p_partkey, position, x.note AS note, x.octave AS target, no, fret, (oct * 12 + open + fret) // 12 AS octave, row_number() OVER (PARTITION BY p_partkey, position, no ORDER BY fret) AS nth FROM v, strings, range(13) t(fret) WHERE (open + fret) % 12 = x.note),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, position ORDER BY octave - target, fret, no) AS best FROM f WHERE nth = 1 AND octave IN (target, target + 1))
SELECT p_partkey, CAST(position AS INTEGER) AS position, note, no AS string_no, CAST(fret AS INTEGER) AS fret FROM r WHERE best = 1"""
ORACLES["bass_neck"] = f"""WITH {CHORDS}, {BASS} SELECT p_partkey, no AS string_no, CAST(fret AS INTEGER) AS fret, CAST((open + fret) % 12 AS INTEGER) AS note, CAST((oct * 12 + open + fret) // 12 AS INTEGER) AS octave, fret > 0 AND (open + fret) % 12 = 0 AS octave_start, list_contains({moved('root_note', 'intervals')}, CAST((open + fret) % 12 AS INTEGER)) AS highlighted FROM chords, strings, range(13) t(fret)"""

STEPS = f"""steps AS (
  SELECT l_orderkey AS song, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS INTEGER) AS pos, l_partkey AS pk, CASE WHEN l_partkey % 9 < 7 THEN CAST(l_partkey % 9 AS INTEGER) END AS degree,
    CASE WHEN l_partkey % 9 < 7 THEN 'g' || (l_partkey % 9) ELSE 'x' || (l_partkey % 12) END AS label, CASE WHEN l_partkey % 9 >= 7 THEN {moved('l_partkey', '[0, 4, 7]')} END AS intervals,
    CASE WHEN l_quantity <> 24 THEN {CLAMPED.format('l_quantity / 6')} END AS beats, CAST(l_partkey % 5 - 2 AS INTEGER) AS off, CASE l_returnflag WHEN 'R' THEN 'unsure' WHEN 'N' THEN 'sure' END AS confidence,
    CAST(l_orderkey % 12 AS INTEGER) AS key_root, (l_orderkey // 12) % 2 = 1 AS is_minor FROM lineitem
)"""
RESOLVED = f"""{STEPS}, {FIELD}, resolved AS (
  SELECT s.*, f.chord_name AS field_name, f.fn, f.degree - 1 AS field_degree, CASE WHEN f.degree IS NULL THEN {moved('s.key_root', 's.intervals')} ELSE f.notes END AS notes
  FROM steps s LEFT JOIN field f ON f.key_root = s.key_root AND f.is_minor = s.is_minor AND f.degree - 1 = s.degree
)"""
ORACLES["step_resolution"] = f"""WITH {RESOLVED} SELECT song, pos, coalesce(field_name, label) AS chord_name,
  {text(f"list_transform(notes, lambda n: CASE WHEN field_degree IS NULL THEN {name('n', preferred('key_root'))} ELSE {name('n', name('key_root'))} END)")} AS note_names, fn AS "function", {text('notes')} AS notes, field_degree FROM resolved"""
A = dims.ANALYSIS
ORACLES["progression_analysis"] = f"""WITH {RESOLVED}, led AS (SELECT *, lead(fn, 1) OVER w AS f1, lead(fn, 2) OVER w AS f2 FROM resolved WINDOW w AS (PARTITION BY song ORDER BY pos)),
g AS (SELECT song, count(*) AS n, string_agg(label, ' - ' ORDER BY pos) AS labels, coalesce(bool_or(fn = 'SD' AND f1 = 'D' AND f2 = 'T'), FALSE) AS cad, list(coalesce(fn, '-') ORDER BY pos) AS fs, count(*) FILTER (fn = 'T') AS n_t, count(*) FILTER (fn = 'SD') AS n_sd, count(*) FILTER (fn = 'D') AS n_d FROM led GROUP BY song),
s AS (SELECT *, concat_ws(' ', CASE WHEN cad THEN {lit(A['cadence'])} END, CASE WHEN fs[1] = 'T' AND fs[-1] = 'T' THEN {lit(A['circular'])} WHEN fs[1] = 'T' AND fs[-1] = 'D' THEN {lit(A['suspended'])} WHEN fs[1] <> 'T' THEN {lit(A['moving'])} END, CASE WHEN list_contains(fs, '-') THEN {lit(A['chromatic'])} END) AS said FROM g)
SELECT song, n, labels, CASE WHEN n >= 2 AND said <> '' THEN said END AS analysis, n_t, n_sd, n_d, CAST(n_t AS DOUBLE) / greatest(n_t, n_sd, n_d, 1) AS share_t, CAST(n_sd AS DOUBLE) / greatest(n_t, n_sd, n_d, 1) AS share_sd, CAST(n_d AS DOUBLE) / greatest(n_t, n_sd, n_d, 1) AS share_d FROM s"""
ORACLES["function_histogram"] = f"""WITH {RESOLVED} SELECT is_minor, coalesce(fn, 'chromatic') AS "function", count(*) AS n FROM resolved GROUP BY ALL"""
ORACLES["section_totals"] = f"""WITH {STEPS} SELECT song, CAST(pos // 4 AS INTEGER) AS section, count(*) AS n_steps, sum(coalesce(beats, 4)) AS beats, CAST(sum(floor(coalesce(beats, 4) * 2 + 0.5)) AS BIGINT) AS eighths, count(*) FILTER (confidence = 'unsure') AS n_unsure FROM steps GROUP BY ALL"""
ORACLES["review_steps"] = f"""WITH {STEPS}, w AS (SELECT *, lag(label) OVER w AS previous_label, lead(label) OVER w AS next_label, row_number() OVER (PARTITION BY song ORDER BY coalesce(confidence, '') <> 'unsure', pos) AS rk FROM steps WINDOW w AS (PARTITION BY song ORDER BY pos))
SELECT song, CAST(pos // 4 AS INTEGER) AS section, pos, label, previous_label, next_label, rk = 1 AS start FROM w"""

DURATIONS = f"{STEPS}, d AS (SELECT song, pos, off, CAST(greatest(1, floor(coalesce(beats, 4) * 2 + 0.5)) AS BIGINT) AS dur FROM steps), placed AS (SELECT *, CAST(sum(dur) OVER (PARTITION BY song ORDER BY pos) - dur AS BIGINT) AS begin_, CAST(sum(dur) OVER (PARTITION BY song) AS BIGINT) AS total FROM d)"
ORACLES["playback_events"] = f"""WITH {DURATIONS}, grid AS (SELECT DISTINCT song, total, 2 * t - 2 AS tick, sub, 2 * t - 2 + sub AS eighth, ((2 * t - 2 + sub) % total + total) % total AS cycle FROM placed, range(16) x(t), range(2) y(sub)),
e AS (
  SELECT song, tick, eighth, 'timeline' AS type, cycle AS value, CAST(sub AS DOUBLE) AS at_ FROM grid
  UNION ALL SELECT g.song, tick, eighth, 'step', p.pos, CAST(sub + greatest(p.off, 0) AS DOUBLE) FROM grid g JOIN placed p ON p.song = g.song AND p.begin_ = g.cycle WHERE p.off >= 0 OR eighth <= 0
  UNION ALL SELECT g.song, tick, eighth, 'step', p.pos, CAST(sub + 1 + p.off AS DOUBLE) FROM grid g JOIN placed p ON p.song = g.song AND p.begin_ = (g.cycle + 1) % g.total WHERE p.off = -1
)
SELECT song, CAST(tick AS BIGINT) AS tick, CAST(eighth AS BIGINT) AS eighth, type, CAST(value AS BIGINT) AS value, at_ AS \"at\" FROM e"""
ORACLES["playback_cycle"] = f"""WITH {DURATIONS}, cycles AS (SELECT DISTINCT song, total, unnest(range(-2, CAST(total AS BIGINT), 2)) AS tick FROM placed),
grid AS (SELECT song, total, tick, sub, tick + sub AS eighth, ((tick + sub) % total + total) % total AS cycle FROM cycles, range(2) y(sub)),
e AS (
  SELECT song, tick, eighth, 'timeline' AS type, cycle AS value, CAST(sub AS DOUBLE) AS at_ FROM grid
  UNION ALL SELECT g.song, tick, eighth, 'step', p.pos, CAST(sub + greatest(p.off, 0) AS DOUBLE) FROM grid g JOIN placed p ON p.song = g.song AND p.begin_ = g.cycle WHERE p.off >= 0 OR eighth <= 0
  UNION ALL SELECT g.song, tick, eighth, 'step', p.pos, CAST(sub + 1 + p.off AS DOUBLE) FROM grid g JOIN placed p ON p.song = g.song AND p.begin_ = (g.cycle + 1) % g.total WHERE p.off = -1
)
SELECT song, CAST(tick AS BIGINT) AS tick, CAST(eighth AS BIGINT) AS eighth, type, CAST(value AS BIGINT) AS value, at_ AS \"at\" FROM e"""
ORACLES["beat_timeline"] = f"""WITH {STEPS}, c AS (SELECT song, pos, off, coalesce(beats, 4) * 2 AS n, unnest(range(CAST(ceil(coalesce(beats, 4) * 2) AS BIGINT))) AS e FROM steps)
SELECT song, pos, CAST(e AS INTEGER) AS e, e % 2 = 0 AS is_downbeat, e % 8 = 0 AS is_measure_start, e = CASE WHEN off > 0 THEN off WHEN off < 0 THEN n + off ELSE 0 END AS is_chord_start FROM c"""
ORACLES["step_at_position"] = f"""WITH {DURATIONS}, q AS (SELECT song, pos * 7 AS position FROM steps)
SELECT q.song, q.position, CAST(coalesce(p.pos, 0) AS BIGINT) AS index, CAST(coalesce(p.begin_, 0) AS BIGINT) AS begin FROM q LEFT JOIN placed p ON p.song = q.song AND p.begin_ <= q.position AND q.position < p.begin_ + p.dur"""
ORACLES["metronome"] = """WITH p AS (SELECT p_partkey, 60 + p_size AS bpm, p_partkey % 140 + 20 AS pct FROM part)
SELECT p_partkey, CAST(floor(bpm * greatest(50, least(150, floor(pct / 5.0 + 0.5) * 5)) / 100.0 + 0.5) AS BIGINT) AS practice, CAST(greatest(40, least(200, bpm - 5)) AS INTEGER) AS slower FROM p"""
ORACLES["segment_coverage"] = """WITH s AS (SELECT user_id, event_type AS label, epoch_us(ts) AS a, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
g AS (SELECT user_id, label, count(*) AS n, CAST(sum(b - a) AS BIGINT) AS duration_us FROM s WHERE b IS NOT NULL GROUP BY ALL)
SELECT user_id, label, n, duration_us, CAST(CASE WHEN sum(duration_us) OVER (PARTITION BY user_id) > 0 THEN floor(10000 * duration_us / CAST(sum(duration_us) OVER (PARTITION BY user_id) AS DOUBLE) + 0.5) ELSE 0 END AS BIGINT) AS share_bp FROM g"""

ORACLES["segment_at_moment"] = """WITH s AS (SELECT user_id, event_type AS label, epoch_us(ts) AS a, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT e.user_id, e.event_id, epoch_us(e.ts) + 7200000000 AS at_us, s.label, s.a AS start_us, s.b AS end_us FROM events e LEFT JOIN s ON s.user_id = e.user_id AND s.a <= epoch_us(e.ts) + 7200000000 AND epoch_us(e.ts) + 7200000000 < s.b"""

ORACLES["quiz_scores"] = """WITH a AS (
  SELECT user_id AS session, ts, event_id, CASE WHEN event_type = 'signup' THEN 'resetScore' WHEN event_id % 23 = 0 THEN 'changeMode' WHEN event_id % 3 = 0 THEN 'question' ELSE 'answer' END AS act, event_type IN ('click', 'purchase') AS ok FROM events
), m AS (
  SELECT *, count(*) FILTER (act IN ('resetScore', 'changeMode')) OVER w AS era, count(*) FILTER (act = 'question') OVER w AS rnd, max(CASE WHEN act = 'question' THEN ts END) OVER w AS last_q, max(CASE WHEN act = 'changeMode' THEN ts END) OVER w AS last_c
  FROM a WINDOW w AS (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
), f AS (SELECT *, row_number() OVER (PARTITION BY session, rnd ORDER BY ts, event_id) AS nth FROM m WHERE act = 'answer' AND last_q IS NOT NULL AND (last_c IS NULL OR last_c < last_q)),
r AS (SELECT *, count(*) FILTER (NOT ok) OVER w AS island, count(*) FILTER (ok) OVER w AS correct, count(*) OVER w AS total FROM f WHERE nth = 1 WINDOW w AS (PARTITION BY session, era ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY session, era, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM r),
b AS (SELECT *, max(streak) OVER (PARTITION BY session, era ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best_streak, CAST(floor(100.0 * correct / total + 0.5) AS BIGINT) AS percent FROM s)
SELECT session, event_id, correct, total, streak, best_streak, percent, CASE WHEN percent >= 70 THEN 'good' WHEN percent >= 40 THEN 'fair' ELSE 'poor' END AS band FROM b"""

SEED = "(event_id % 1000003)"


def drawn(salt: int | str, n: int) -> str:
    return f"((({SEED} * 48271 + ({salt}) * 69621 + 11) % 2147483647 * 16807 % 2147483647) % {n})"


def shuffled(x: str, salt: int, seed: str = SEED) -> str:
    key = f"({seed} * 48271 + i * 40692 + {salt} * 69621) % 2147483647 * 16807 % 2147483647"
    return f"list_transform(list_sort(list_transform(range(1, len({x}) + 1), lambda i: struct_pack(k := {key}, i := i))), lambda s: ({x})[s.i])"


def questions(source: str) -> str:
    """From ``q`` with event_id, notes, correct, labels, tip_key."""
    return f"""{source},
o AS (SELECT *, list_filter(labels, lambda x: x <> correct) AS others FROM q), s AS (SELECT *, {shuffled('others', 3)} AS mixed FROM o), p AS (SELECT *, list_concat([correct], mixed[1:3]) AS four FROM s)
SELECT event_id AS seed, {text('notes')} AS notes, correct, array_to_string({shuffled('four', 4)}, '|') AS options, tip_key FROM p"""


NAMES = lit([n for k, n in dims.INTERVAL_NAMES if k])
ORACLES["interval_questions"] = questions(f"WITH q AS (SELECT event_id, [{drawn(1, 12)}, ({drawn(1, 12)} + {drawn(2, 12)} + 1) % 12] AS notes, {NAMES} AS labels, {NAMES}[{drawn(2, 12)} + 1] AS correct, CAST({drawn(2, 12)} + 1 AS VARCHAR) AS tip_key FROM events)")
KIND = {t[0]: t for t in dims.CHORD_TYPES}
IDS = dims.QUIZ_CHORD_TYPES
LABELS = lit([KIND[i][1] for i in IDS])
ORACLES["chord_type_questions"] = questions(
    f"WITH q AS (SELECT event_id, {moved(drawn(1, 12), f'({lit([KIND[i][3] for i in IDS])})[{drawn(2, 7)} + 1]')} AS notes, {LABELS} AS labels, {LABELS}[{drawn(2, 7)} + 1] AS correct, {lit(IDS)}[{drawn(2, 7)} + 1] AS tip_key FROM events)"
)
PER_KEY = f"{FIELD}, per AS (SELECT key_root, is_minor, list(numeral ORDER BY degree) AS numerals, list(chord_name ORDER BY degree) AS chord_names, list(notes ORDER BY degree) AS all_notes, list(coalesce((SELECT min_by(k.type_id, k.pos) FROM kinds k WHERE k.symbol = field.symbol), 'major') ORDER BY degree) AS types FROM field GROUP BY ALL)"
JOINED = "FROM events JOIN per ON per.key_root = event_id % 12 AND per.is_minor = (event_id % 2 = 1)"
ORACLES["degree_questions"] = questions(f"WITH {PER_KEY}, q AS (SELECT event_id, all_notes[{drawn(2, 7)} + 1] AS notes, numerals AS labels, numerals[{drawn(2, 7)} + 1] AS correct, CAST({drawn(2, 7)} AS VARCHAR) AS tip_key {JOINED})")
ORACLES["diatonic_chord_questions"] = questions(f"WITH {PER_KEY}, q AS (SELECT event_id, all_notes[{drawn(2, 7)} + 1] AS notes, chord_names AS labels, chord_names[{drawn(2, 7)} + 1] AS correct, types[{drawn(2, 7)} + 1] AS tip_key {JOINED})")
CIDS = dims.QUIZ_CHORD_IDS
SYMBOLS = lit([KIND[i][2] for i in CIDS])


def chord_label(root: str, kind: str) -> str:
    return f"({preferred(root)} || {SYMBOLS}[{kind} + 1])"


ORACLES["chord_id_questions"] = f"""WITH a AS (SELECT event_id, {drawn(1, 12)} AS r, {drawn(2, 6)} AS t, {drawn(5, 5)} AS d FROM events),
b AS (SELECT event_id, r, t, {chord_label('r', 't')} AS correct, {chord_label('r', '((t + 1 + d) % 6)')} AS other, list_transform([5, 7, 3, 4, 2], lambda k: {chord_label('(r + k)', 't')}) AS nearby,
  list_transform(range(12), lambda k: {chord_label(drawn('10 + k', 12), drawn('40 + k', 6))}) AS filling FROM a),
c AS (SELECT *, list_filter([other], lambda x: x <> correct) AS one FROM b),
d AS (SELECT *, list_concat(one, list_filter(nearby, lambda x: x <> correct AND NOT list_contains(one, x))[1:2 - len(one)]) AS two FROM c),
pool AS (SELECT event_id, x, min(i) AS i FROM (SELECT event_id, unnest(list_concat(filling, nearby)) AS x, unnest(range(17)) AS i FROM d) GROUP BY ALL),
rest AS (SELECT d.event_id, list(x ORDER BY i) AS rest FROM d JOIN pool USING (event_id) WHERE x <> correct AND NOT list_contains(two, x) GROUP BY ALL),
e AS (SELECT d.*, list_concat([correct], list_concat(two, rest)[1:3]) AS four FROM d JOIN rest USING (event_id))
SELECT event_id AS seed, {text(moved('r', f'({lit([KIND[i][3] for i in CIDS])})[t + 1]'))} AS notes, correct, array_to_string({shuffled('four', 4)}, '|') AS options, {lit(CIDS)}[t + 1] AS tip_key FROM e"""

STORED = """stored AS (
  SELECT o_orderkey AS k, 's' || o_orderkey AS id, 'song ' || (o_orderkey % 1000) AS title, o_orderpriority AS artist, CASE WHEN o_orderkey % 2 = 0 THEN 'major' ELSE 'minor' END AS mode,
    CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 0 ELSE o_orderkey % 100 + 40 END AS INTEGER) AS bpm, CAST(o_orderkey % 5 = 0 AS INTEGER) AS is_example, 'd' || (o_custkey % 10) AS device_id,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS updated_at FROM orders
)"""
ORACLES["list_progressions"] = f"WITH {STORED} SELECT mode, id, CAST(row_number() OVER (PARTITION BY mode ORDER BY is_example DESC, created_at, id) AS INTEGER) AS place FROM stored"
ORACLES["list_recent"] = f"WITH {STORED} SELECT device_id, id, CASE WHEN coalesce(bpm, 0) = 0 THEN 120 ELSE bpm END AS bpm, CAST(row_number() OVER (PARTITION BY device_id ORDER BY updated_at DESC, id) AS INTEGER) AS place FROM stored"
ORACLES["partial_update"] = f"""WITH {STORED} SELECT id, CASE WHEN k % 3 <> 0 AND k % 4 = 0 THEN 'new ' || k ELSE title END AS title, CASE WHEN k % 3 <> 0 AND k % 6 = 0 THEN NULL ELSE bpm END AS bpm,
  CASE WHEN k % 3 <> 0 AND (k % 4 = 0 OR k % 6 = 0) THEN '2030-01-01 00:00:00' ELSE updated_at END AS updated_at FROM stored"""
ORACLES["upsert"] = f"""WITH {STORED}, b AS (SELECT 's' || (o_orderkey // 8 * 7) AS id, 'up ' || max(o_orderkey) AS title, CAST(max_by(o_custkey, o_orderkey) AS INTEGER) AS bpm FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1)
SELECT id, title, bpm FROM stored WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT * FROM b"""
ORACLES["guarded_delete"] = f"WITH {STORED} SELECT id, is_example, device_id FROM stored WHERE k % 3 <> 0 OR is_example = 1"
COPIES = """local AS (SELECT 's' || o_orderkey AS id, 'local ' || o_custkey AS title, strftime(o_orderdate + to_hours(CAST(o_custkey % 5 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS updated_at, o_orderkey % 2 = 0 AS is_example, o_orderpriority AS artist FROM orders WHERE o_orderkey % 3 <> 0),
cloud AS (SELECT 's' || o_orderkey AS id, 'cloud ' || o_custkey AS title, strftime(o_orderdate + to_hours(CAST(o_custkey % 7 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS stamp, CASE WHEN o_orderkey % 2 = 0 THEN replace(stamp, ' ', 'T') || '.000Z' ELSE stamp END AS updated_at, o_orderkey % 2 = 0 AS is_example, o_orderpriority AS artist FROM orders WHERE o_orderkey % 4 <> 0)"""
ORACLES["sync_union"] = f"WITH {COPIES} SELECT id, title, 'pull' AS action FROM cloud WHERE id NOT IN (SELECT id FROM local) UNION ALL SELECT id, title, 'push' FROM local WHERE id NOT IN (SELECT id FROM cloud)"
APPLIED = "SELECT c.id, c.title, c.updated_at FROM cloud c LEFT JOIN local l ON c.id = l.id WHERE l.id IS NULL OR c.updated_at > l.updated_at"
ORACLES["sync_lww"] = f"WITH {COPIES} SELECT *, 'apply' AS action FROM ({APPLIED}) UNION ALL SELECT id, title, updated_at, 'push' FROM local WHERE id NOT IN (SELECT id FROM cloud)"
ORACLES["sync_all"] = f"WITH {COPIES}, a AS ({APPLIED}) SELECT id, title, updated_at FROM local WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT * FROM a"
ORACLES["dirty_rows"] = f"WITH {COPIES} SELECT l.id FROM local l JOIN cloud c ON l.id = c.id WHERE l.title <> replace(c.title, 'cloud', 'local') OR l.artist <> c.artist OR l.is_example <> c.is_example UNION ALL SELECT l.id FROM local l JOIN cloud c ON l.id = c.id WHERE l.updated_at <> c.updated_at"

SIGNATURES = lit(list(dims.DOTS))
DOCUMENTS = f"""nb AS (SELECT l_orderkey AS o, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS BIGINT) AS n, l_partkey AS pk FROM lineitem),
b AS (SELECT o_custkey AS doc, o, n, 'b' || o || '-' || n AS bar_id, {SIGNATURES}[pk % 4 + 1] AS ts, CASE WHEN pk % 3 = 0 THEN [CAST(pk % 4 AS INTEGER), CAST(pk % 4 + 3 AS INTEGER)] END AS accents, (pk + n) % 11 <> 0 AS listed,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o, n) AS nth FROM nb JOIN orders ON o_orderkey = o),
sec AS (SELECT o_custkey AS doc, o_orderkey AS o, 'o' || o_orderkey AS section_id, 'part ' || o_orderstatus AS name, {lit(dims.PALETTE)}[o_orderkey % 12 + 1] AS color, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)"""


def reindexed(rows: str, ts: str = "ts", accents: str = "accents") -> str:
    """From rows with doc, bar_id, and the order a, b."""
    return f"SELECT doc, bar_id, CAST(row_number() OVER (PARTITION BY doc ORDER BY a, b) - 1 AS INTEGER) AS bar_index, {ts} AS time_signature, {text(accents)} AS accents FROM ({rows})"


BAR_IN = "SELECT b.*, s.place AS a, b.n AS b FROM b JOIN sec s ON s.doc = b.doc AND s.o = b.o WHERE listed"
ORACLES["reindex_bars"] = f"WITH {DOCUMENTS} {reindexed(BAR_IN)}"
ORACLES["unassigned_bars"] = f"WITH {DOCUMENTS} SELECT doc, bar_id FROM b WHERE NOT listed"
ORACLES["move_bar"] = f"""WITH {DOCUMENTS}, two AS (SELECT doc, o FROM sec WHERE place = 2), m AS (
  SELECT b.*, s.place AS a, b.n AS b FROM b JOIN sec s ON s.doc = b.doc AND s.o = b.o WHERE listed AND nth <> 1
  UNION ALL SELECT b.*, 2, 1000000 FROM b JOIN two ON two.doc = b.doc WHERE nth = 1
) {reindexed('SELECT * FROM m')}"""
SECTION_ROWS = "sr AS (SELECT s.*, (SELECT string_agg(bar_id, ',' ORDER BY n) FROM b WHERE b.o = s.o AND listed) AS bar_ids, (SELECT count(*) FROM b WHERE b.o = s.o AND listed) AS n_listed FROM sec s)"
ORACLES["duplicate_section"] = f"""WITH {DOCUMENTS}, {SECTION_ROWS}, d AS (SELECT doc FROM sec WHERE place = 2), t AS (
  SELECT doc, CASE WHEN place <= 2 THEN place - 1 ELSE place END AS place, section_id, name, coalesce(bar_ids, '') AS bar_ids, n_listed FROM sr WHERE doc IN (SELECT doc FROM d)
  UNION ALL SELECT doc, 2, 'copy', name, array_to_string(list_transform(range(n_listed), lambda k: 'new-' || k), ','), n_listed FROM sr WHERE place = 2
)
SELECT doc, CAST(place AS INTEGER) AS place, section_id, name, bar_ids, nullif(CAST(sum(n_listed) OVER (PARTITION BY doc) AS BIGINT), 0) AS n_bars FROM t"""
ORACLES["remove_section"] = f"WITH {DOCUMENTS} {reindexed(BAR_IN + ' AND s.place <> 1')}"
ORACLES["reorder_sections"] = f"""WITH {DOCUMENTS}, {SECTION_ROWS}, c AS (SELECT *, count(*) OVER (PARTITION BY doc) AS many FROM sr)
SELECT doc, CAST(CASE WHEN many < 3 OR place > 3 THEN place - 1 WHEN place = 1 THEN 2 ELSE place - 2 END AS INTEGER) AS place, section_id, name, coalesce(bar_ids, '') AS bar_ids FROM c"""
KEPT = "SELECT doc, bar_id, CAST(0 AS INTEGER) AS bar_index, {ts} AS time_signature, {accents} AS accents FROM b"
TOGGLED = "CASE WHEN nth <> 1 THEN accents WHEN list_contains(accents, 1) THEN list_filter(accents, lambda x: x <> 1) ELSE list_sort(list_append(coalesce(accents, []), 1)) END"
ORACLES["toggle_accent"] = f"WITH {DOCUMENTS} {KEPT.format(ts='ts', accents=text(f'({TOGGLED})'))}"
CUT = "CASE WHEN nth <> 1 THEN accents WHEN len(list_filter(accents, lambda x: x < 4)) > 0 THEN list_filter(accents, lambda x: x < 4) END"
ORACLES["set_time_signature"] = f"WITH {DOCUMENTS} {KEPT.format(ts='''CASE WHEN nth = 1 THEN '2/4' ELSE ts END''', accents=text(f'({CUT})'))}"
ORACLES["add_and_remove_bar"] = f"""WITH {DOCUMENTS}, withbars AS (SELECT DISTINCT doc FROM orders o JOIN sec ON doc = o_custkey), m AS (
  SELECT doc, bar_id, ts, accents, a, b FROM ({BAR_IN} AND nth <> 1)
  UNION ALL SELECT doc, 'added', '6/8', NULL, 1, 1000000 FROM sec WHERE place = 1
) {reindexed('SELECT * FROM m')}"""
LABEL_OF = "CASE kind " + " ".join(f"WHEN {lit(t)} THEN {lit(n)}" for t, n, _ in dims.SECTION_TYPES) + " ELSE kind END"
COLOR_OF = "CASE kind " + " ".join(f"WHEN {lit(t)} THEN {lit(c)}" for t, _, c in dims.SECTION_TYPES) + f" ELSE {lit(dims.PALETTE[0])} END"
ORACLES["migrate_sections"] = f"""WITH {DOCUMENTS}, {SECTION_ROWS}, l AS (SELECT *, place - 1 AS i, (doc + place - 1) % 4 = 0 AS new, {lit([t for t, _, _ in dims.SECTION_TYPES] + ['bridge'])}[(doc + place - 1) % 9 + 1] AS kind FROM sr)
SELECT doc, CAST(i AS INTEGER) AS place, section_id, CASE WHEN new THEN name WHEN kind = 'custom' AND (doc + i) % 2 = 0 THEN 'own ' || i ELSE {LABEL_OF} END AS name, CASE WHEN new THEN color ELSE {COLOR_OF} END AS color, CAST(n_listed AS INTEGER) AS n_bars FROM l
UNION ALL SELECT doc, CAST((SELECT count(*) FROM sec WHERE sec.doc = b.doc) AS INTEGER), 'orphans-' || doc, {lit(dims.ORPHANS_NAME)}, {lit(dims.ORPHANS_COLOR)}, CAST(count(*) AS INTEGER) FROM b WHERE NOT listed GROUP BY doc"""
ORACLES["edit_steps"] = f"""WITH {STEPS}, s AS (SELECT song, pos, degree, label, beats FROM steps UNION ALL SELECT song, count(*), 4, 'V', 1.24 FROM steps GROUP BY song HAVING count(*) < 64)
SELECT song, CAST(row_number() OVER (PARTITION BY song ORDER BY pos) - 1 AS INTEGER) AS pos, degree, label, CASE WHEN pos = 0 THEN 5.5 ELSE beats END AS beats FROM s WHERE pos <> 1"""

P = dims.PAGES["a4"]
COLUMN = (P["pageW"] - P["margin"] * 2 - P["colGap"]) / 2
BOXES = f"""r AS (SELECT o_custkey AS doc, o_orderkey AS section, count(l_orderkey) AS n, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 4 + 2 ELSE floor({COLUMN} * 0.45 / {P['barW'] + P['barGap']}) END AS per_row, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS word FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
g AS (SELECT *, ceil(n / per_row) AS n_rows, least(n, per_row) * {P['barW'] + P['barGap']} - {P['barGap']} AS grid_w, ceil(n / per_row) * {P['barH'] + P['barGap']} - {P['barGap']} AS bars_h FROM r WHERE n > 0),
h AS (SELECT *, {COLUMN} - grid_w - {P['commentGap']} >= {P['commentBesideMinW']} AS beside, CASE WHEN {COLUMN} - grid_w - {P['commentGap']} >= {P['commentBesideMinW']} THEN {COLUMN} - grid_w - {P['commentGap']} ELSE {COLUMN} END AS width FROM g)"""
ORACLES["bar_places"] = f"WITH {BOXES}, e AS (SELECT *, unnest(range(n)) AS i FROM h) SELECT doc, section, CAST(i + 1 AS INTEGER) AS number, round(CAST((i % CAST(per_row AS BIGINT)) * {P['barW'] + P['barGap']} AS DOUBLE), 3) AS x, round(CAST({P['barsTopOffset']} + (i // CAST(per_row AS BIGINT)) * {P['barH'] + P['barGap']} AS DOUBLE), 3) AS y FROM e"
DOTS = "CASE ts " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in dims.DOTS.items()) + " END"
ORACLES["bar_dots"] = f"WITH {DOCUMENTS}, e AS (SELECT doc, bar_id, accents, unnest(range({DOTS})) AS dot FROM b) SELECT doc, bar_id, CAST(dot AS INTEGER) AS dot, dot % 2 = 0 AS is_downbeat, coalesce(list_contains(accents, dot), FALSE) AS is_accent FROM e"

COUNTED = f"""{BOXES}, k AS (SELECT *, CASE WHEN word IS NULL THEN 0 ELSE CAST(ceil(4.0 / greatest(1, floor((width / 1.5 + 1) / (length(replace(word, ' ', '')) + 1)))) AS INTEGER) END AS n_lines FROM h),
boxes AS (SELECT *, {P['barsTopOffset']} + CASE WHEN beside THEN greatest(bars_h, n_lines * {P['commentLineHeight']}) ELSE bars_h + CASE WHEN n_lines > 0 THEN 2 + n_lines * {P['commentLineHeight']} ELSE 0 END END AS height FROM k)"""
ORACLES["section_boxes"] = f"""WITH {COUNTED} SELECT doc, section, CAST(per_row AS INTEGER) AS per_row, CAST(n_rows AS BIGINT) AS n_rows, round(CAST(grid_w AS DOUBLE), 3) AS grid_w, round(CAST(bars_h AS DOUBLE), 3) AS bars_h, beside, n_lines, round(CAST(height AS DOUBLE), 3) AS height FROM boxes"""
TOP, BOTTOM, WIDTH = P["margin"], P["pageH"] - P["margin"], COLUMN + P["colGap"]
ORACLES["layout_flow"] = f"""WITH RECURSIVE {COUNTED}, s AS (SELECT doc, section, CAST(height AS DOUBLE) AS height, row_number() OVER (PARTITION BY doc ORDER BY section) AS k FROM boxes),
f AS (
  SELECT doc, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS section, 1 AS page, 0 AS col, CAST(0 AS DOUBLE) AS y, CAST({TOP + 20} AS DOUBLE) AS y0, CAST({TOP + 20} AS DOUBLE) AS y1 FROM s WHERE k = 1
  UNION ALL
  SELECT doc, k, section, page, col, y, CASE WHEN col = 0 THEN y + height + {P['sectionGapY']} ELSE y0 END, CASE WHEN col = 1 THEN y + height + {P['sectionGapY']} ELSE y1 END FROM (
    SELECT s.doc, s.k, s.section, s.height, CASE WHEN full_ AND f.col = 1 THEN f.page + 1 ELSE f.page END AS page, CASE WHEN NOT full_ THEN f.col WHEN f.col = 0 THEN 1 ELSE 0 END AS col,
      CASE WHEN NOT full_ THEN CASE f.col WHEN 0 THEN y0 ELSE y1 END WHEN f.col = 0 THEN y1 ELSE {TOP} END AS y, CASE WHEN full_ AND f.col = 1 THEN {TOP} ELSE y0 END AS y0, CASE WHEN full_ AND f.col = 1 THEN {TOP} ELSE y1 END AS y1
    FROM (SELECT f.*, s2.height AS h2, CASE f.col WHEN 0 THEN f.y0 ELSE f.y1 END + s2.height > {BOTTOM} AS full_ FROM f JOIN s s2 ON s2.doc = f.doc AND s2.k = f.k + 1) f JOIN s ON s.doc = f.doc AND s.k = f.k + 1
  )
)
SELECT doc, section, page, col, CAST({TOP} + col * {WIDTH} AS DOUBLE) AS x, round(CAST(y AS DOUBLE), 3) AS y FROM f WHERE k > 0"""

ORACLES["quiz_stream"] = f"SELECT session, event_id, correct, total, streak, best_streak FROM ({ORACLES['quiz_scores']})"
ORACLES["debounced_taps"] = """WITH RECURSIVE c AS (SELECT user_id AS key, epoch_us(ts) AS at_us FROM events WHERE event_type = 'click'),
t AS (SELECT key, min(at_us) AS at_us FROM c GROUP BY key UNION ALL SELECT t.key, min(c.at_us) FROM t JOIN c ON c.key = t.key AND c.at_us >= t.at_us + 864000000000 GROUP BY t.key) SELECT key, at_us FROM t"""
ORACLES["debounced_batch"] = """WITH RECURSIVE c AS (SELECT user_id AS key, epoch_us(ts) AS at_us FROM events),
t AS (SELECT key, min(at_us) AS at_us FROM c GROUP BY key UNION ALL SELECT t.key, min(c.at_us) FROM t JOIN c ON c.key = t.key AND c.at_us >= t.at_us + 86400000000 GROUP BY t.key) SELECT key, at_us FROM t"""
GOOD = "page_id % 10 NOT IN (3, 6, 9)"
ORACLES["gp_errors"] = f"""SELECT 'page-' || page_id AS path, CASE page_id % 10 WHEN 3 THEN 'gpx-container' WHEN 6 THEN 'legacy-binary' WHEN 9 THEN 'corrupt' END AS error, CASE WHEN {GOOD} THEN 'Page ' || page_id END AS title,
  CASE WHEN {GOOD} THEN CAST(page_id AS VARCHAR) END AS artist, CASE WHEN {GOOD} THEN CAST(1 + page_id % 5 AS INTEGER) END AS n_bars, CASE WHEN {GOOD} THEN FALSE END AS has_chords FROM pages"""
ORACLES["gp_extract"] = f"""WITH {FIELD}, b AS (SELECT page_id, unnest(range(1 + page_id % 5)) AS b FROM pages WHERE {GOOD}), r AS (SELECT *, (page_id + b) % 12 AS r FROM b)
SELECT page_id, CAST(b + 1 AS INTEGER) AS number, (48 + r) || ',' || (52 + r) || ',' || (55 + r) AS harmony, CAST(24 + r AS VARCHAR) AS root, 'chord' AS kind, {name('r')} || 'maj' AS detected, f.degree - 1 AS degree, coalesce(f.numeral, {name('r')}) AS label,
  CASE b % 4 WHEN 1 THEN 3.0 WHEN 2 THEN 3.0 ELSE 4.0 END AS beats FROM r LEFT JOIN field f ON f.key_root = 0 AND NOT f.is_minor AND f.chord_root = r AND f.family = 'MAJ'"""

ORACLES["piano_keys"] = """
WITH t AS (SELECT n_nationkey, list_transform([0, 4, 7], lambda i: (n_nationkey + i) % 12) AS n FROM nation),
v AS (SELECT *, 3 + CASE WHEN n[2] <= n[1] THEN 1 ELSE 0 END AS second FROM t), w AS (SELECT *, [3, second, second + CASE WHEN n[3] <= n[2] THEN 1 ELSE 0 END] AS high FROM v)
SELECT n_nationkey, CAST(o AS INTEGER) AS octave, CAST(k AS INTEGER) AS note, k IN (1, 3, 6, 8, 10) AS is_black, coalesce(high[list_position(n, k)] = o, FALSE) AS highlighted
FROM w, range(3, 5) a(o), range(12) b(k)
"""

ORACLES["labels_and_pitch"] = """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE printf('%.1f', p_size / 2.0) END || 't' AS beats_label, round(440.0 * pow(2.0, (p_partkey % 128 - 69) / 12.0), 4) AS hertz
FROM part
"""

ORACLES["answer_options"] = f"""
WITH q AS (SELECT p_partkey, list_transform(range(4), lambda i: {lit([t[0] for t in dims.CHORD_TYPES])}[(p_partkey + 2 * i) % 9 + 1]) AS o FROM part),
a AS (SELECT p_partkey, o, o[p_partkey % 4 + 1] AS correct, CASE WHEN p_partkey % 5 <> 0 THEN o[p_partkey // 4 % 4 + 1] END AS chosen FROM q)
SELECT p_partkey, CAST(i AS INTEGER) AS place, o[i + 1] AS option,
  CASE WHEN chosen IS NULL THEN 'open' WHEN o[i + 1] = correct THEN 'right' WHEN o[i + 1] = chosen THEN 'wrong' ELSE 'other' END AS state
FROM a, range(4) t(i)
"""

ORACLES["device_rows"] = """
SELECT 's' || o_orderkey AS id, 'd' || (o_custkey % 10) AS device_id FROM orders WHERE o_custkey % 10 = 3 AND o_orderkey % 3 <> 0
"""

ORACLES["import_guards"] = """
WITH p AS (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE ' song ' || p_partkey || ' ' END AS title,
    CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'f' || p_partkey ELSE 'f' || p_partkey || '.gpx' END AS stem FROM part
)
SELECT p_partkey, coalesce(nullif(trim(title), ''), nullif(stem, ''), 'Untitled') AS title, trim(coalesce(title, '')) <> '' AND p_partkey % 3 <> 0 AS can_save FROM p
"""

ORACLES["set_section_fields"] = """
WITH o AS (SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS place, o_orderstatus FROM orders)
SELECT doc, place, CASE WHEN place = 0 THEN 'renamed' ELSE 'part ' || o_orderstatus END AS name, CASE WHEN place = 0 THEN 'again' END AS comment, CASE WHEN place = 0 THEN 6 END AS bars_per_row FROM o
"""

ORACLES["set_bar_color"] = f"""
WITH b AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS n FROM lineitem),
d AS (SELECT o_custkey AS doc, l_orderkey, n, l_partkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, n) AS nth FROM orders JOIN b ON o_orderkey = l_orderkey)
SELECT doc, 'b' || l_orderkey || '-' || n AS bar_id, CASE WHEN nth = 1 THEN '#010203' WHEN l_partkey % 5 = 0 THEN {lit(dims.PALETTE[3])} END AS color FROM d
"""

ORACLES["edit_song_sections"] = f"""
WITH s AS (SELECT l_orderkey AS song, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY l_orderkey)
SELECT song, CAST(song % 2 AS INTEGER) AS active, 0 AS place, CASE WHEN song % 2 = 1 THEN 'a' ELSE 'b' END AS section_id,
  CASE WHEN song % 2 = 1 THEN {lit(dict((t, n) for t, n, _ in dims.SECTION_TYPES)["verso"])} ELSE 'own' END AS label, CASE WHEN song % 2 = 1 THEN n - 1 ELSE 0 END AS n_steps
FROM s
UNION ALL
SELECT song, 1, 1, 'b', 'own', 0 FROM s WHERE song % 2 = 1
"""

ORACLES["held_keys"] = """
WITH k AS (SELECT user_id AS player, epoch_us(ts) AS at_us, event_type NOT IN ('signup', 'purchase') AS down FROM events),
b AS (SELECT *, lag(down, 1, FALSE) OVER (PARTITION BY player ORDER BY at_us) AS before FROM k)
SELECT player, at_us, 'C' AS note FROM b WHERE down AND NOT before
"""
