"""DuckDB SQL for the queries of ``catalogue_library``, written from the rules and not from the DataFrame code."""

from __future__ import annotations

from cadenza import dims
from cadenza.plans.oracles import ANALYZED, APPLIED, COPIES, DOCUMENTS, FIELD, GOOD, MATCHED, ORACLES, PART_KEYS, SCALES, STEPS, STORED, lit, moved, name, text, values

__all__ = ["ORACLES"]
NOW = "'2030-01-01 00:00:00'"

# listings, reads and changes

ORACLES["list_by_mode"] = f"WITH {STORED} SELECT id, mode, is_example, created_at FROM stored WHERE mode = 'minor'"
ORACLES["list_all"] = f"WITH {STORED} SELECT id, mode, CAST(row_number() OVER (ORDER BY is_example DESC, created_at, id) - 1 AS INTEGER) AS place FROM stored"
ORACLES["list_songs"] = f"WITH {STORED} SELECT id, updated_at, CAST(row_number() OVER (ORDER BY updated_at DESC, id) - 1 AS INTEGER) AS place FROM stored"
TYPES = lit([n for _, n, _ in dims.SECTION_TYPES])
ORACLES["list_structures"] = f"""WITH {DOCUMENTS}, n AS (
  SELECT doc, place, {TYPES}[(doc + place - 1) % 8 + 1] AS label FROM sec
  UNION ALL SELECT doc, 1000000, {lit(dims.ORPHANS_NAME)} FROM b WHERE NOT listed GROUP BY doc
)
SELECT 't' || doc AS id, CAST(CASE WHEN doc % 3 = 2 THEN 1 ELSE 120 END AS INTEGER) AS bpm, CAST(count(*) AS INTEGER) AS n_sections, string_agg(label, '|' ORDER BY place) AS names FROM n GROUP BY doc"""
ORACLES["example_count"] = "SELECT count(*) AS n FROM orders WHERE o_orderkey % 5 = 0"
ORACLES["example_split"] = "SELECT 's' || o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'example' ELSE 'own' END AS kind FROM orders"
SEEDS = values([(i, n, mode, True, len(steps), ",".join("-" if s[0] is None else str(s[0]) for s in steps)) for i, n, _, mode, _, _, steps in dims.EXAMPLES])
ORACLES["seeded_library"] = f"""WITH {STORED} SELECT id, title AS name, mode, FALSE AS is_example, CAST(k % 4 + 1 AS INTEGER) AS n_steps, array_to_string(list_transform(range(k % 4 + 1), lambda x: CASE WHEN x % 3 = 2 THEN '-' ELSE CAST(x AS VARCHAR) END), ',') AS degrees
FROM stored WHERE is_example = 0 UNION ALL SELECT * FROM ({SEEDS})"""
ORACLES["inserted_rows"] = f"WITH {STORED}, n AS (SELECT count(*) AS n FROM stored), m AS (SELECT count(*) AS m FROM stored WHERE k % 10 = 0) SELECT 'n' || k AS id, title, bpm, n + m AS n_rows FROM stored, n, m WHERE k % 10 = 0"
ORACLES["new_ids"] = "WITH h AS (SELECT p_partkey, sha256('bar|' || p_partkey || '|') AS h FROM part) SELECT p_partkey, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS new_id FROM h"
ORACLES["point_reads"] = f"WITH {STORED} SELECT id, title FROM stored WHERE id IN ('s1', 's32', 'missing')"
ORACLES["valid_rows"] = f"WITH {STORED} SELECT id, mode FROM stored WHERE k % 11 > 1"
TABLES = {
    "saved_progressions": "id string, name string, description string, steps string, mode string, preset_id string, bpm int, is_example int, created_at string",
    "songs": "id string, title string, artist string, key_note int, mode string, original_bpm int, preset_id string, sections string, created_at string, updated_at string",
    "structures": "id string, title string, artist string, bpm int, bars string, sections string, created_at string, updated_at string",
}
COLUMNS = [(w, t, k, *c.split()) for w in ("local", "cloud") for t, cols in TABLES.items() for k, c in enumerate([*cols.split(", "), *(["device_id string"] if w == "cloud" else [])])]
FILLED = " ".join(f"WHEN '{c}' THEN (SELECT count({c}) FROM stored)" for c in ("id", "title", "artist", "mode", "bpm", "is_example", "device_id", "created_at", "updated_at"))
ORACLES["stored_schemas"] = f'WITH {STORED} SELECT *, CASE "column" {FILLED} ELSE 0 END AS n_filled FROM ({values(COLUMNS)}) t(store, name, place, "column", type)'
ORACLES["upsert_defaults"] = f"""WITH {STORED} SELECT id, CASE WHEN k % 3 = 0 AND k % 2 > 0 THEN '' ELSE artist END AS artist, CASE WHEN k % 3 > 0 THEN bpm WHEN k % 4 = 0 THEN coalesce(bpm, 120) ELSE 120 END AS bpm,
  CASE WHEN k % 3 = 0 AND k % 5 > 0 THEN {NOW} ELSE created_at END AS created_at FROM stored"""
ORACLES["device_or_all"] = f"WITH {STORED} SELECT id, device_id, 'd4' AS asked FROM stored WHERE device_id = 'd4' UNION ALL SELECT id, device_id, 'all' FROM stored"
ORACLES["presets"] = f"SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 OR p_partkey % 7 = 6 THEN 'piano' ELSE {lit(dims.PRESET_IDS)}[p_partkey % 7 + 1] END AS preset FROM part"
ORACLES["device_settings"] = f"WITH {STORED} SELECT id, device_id, CASE device_id WHEN 'd1' THEN 'dark' WHEN 'd2' THEN 'light' WHEN 'd7' THEN 'dark' ELSE 'system' END AS theme FROM stored"

# synchronising and the store

ORACLES["push_rows"] = f"""WITH {COPIES} SELECT '{{"id":"' || id || '","title":"' || title || '","is_example":' || CAST(is_example AS INTEGER) || ',"device_id":"dev"}}' AS value FROM local"""
ORACLES["push_deletes"] = f"""WITH {COPIES} SELECT '{{"id":"' || id || '","device_id":"dev"}}' AS value FROM local WHERE CAST(substr(id, 2) AS BIGINT) % 5 = 0"""
PARTS = f"""{COPIES}, lt AS (SELECT * FROM local WHERE CAST(substr(id, 2) AS BIGINT) % 3 = 2), ct AS (SELECT * FROM cloud WHERE CAST(substr(id, 2) AS BIGINT) % 3 = 2)"""


def last_write(mine: str, theirs: str, collection: str) -> str:
    return f"""SELECT coalesce(l.id, c.id) AS id, CASE WHEN c.id IS NOT NULL AND (l.id IS NULL OR c.updated_at > l.updated_at) THEN c.title ELSE l.title END AS title,
      CASE WHEN c.id IS NOT NULL AND (l.id IS NULL OR c.updated_at > l.updated_at) THEN c.updated_at ELSE l.updated_at END AS updated_at, '{collection}' AS collection FROM {mine} l FULL JOIN {theirs} c ON l.id = c.id"""


ORACLES["sync_library"] = f"""WITH {PARTS} SELECT coalesce(l.id, c.id) AS id, coalesce(l.title, c.title) AS title, coalesce(l.updated_at, c.updated_at) AS updated_at, 'progressions' AS collection FROM local l FULL JOIN cloud c ON l.id = c.id
UNION ALL {last_write('lt', 'cloud', 'songs')} UNION ALL {last_write('local', 'ct', 'structures')}"""
ORACLES["sync_pushes"] = f"""WITH {PARTS} SELECT id, 'progressions' AS collection FROM local WHERE id NOT IN (SELECT id FROM cloud) UNION ALL SELECT id, 'songs' FROM lt WHERE id NOT IN (SELECT id FROM cloud) UNION ALL SELECT id, 'structures' FROM local WHERE id NOT IN (SELECT id FROM ct)"""
ORACLES["sync_stream"] = f"WITH {COPIES}, a AS ({APPLIED}) SELECT id, title, updated_at FROM local WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT * FROM a"
ORACLES["library_session"] = f"""WITH {STORED} SELECT id, CASE WHEN k % 4 = 0 THEN 'saved ' || title ELSE title END AS title, CASE WHEN k % 4 = 0 THEN {NOW} ELSE updated_at END AS updated_at, is_example FROM stored WHERE k % 6 > 0 OR is_example = 1"""
ORACLES["snapshot_pull"] = f"WITH {COPIES} SELECT id, title, updated_at FROM cloud"

# files

SEGMENTS = "s AS (SELECT user_id, event_type AS label, epoch_us(ts) AS a, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)"
ORACLES["segment_files"] = f"WITH {SEGMENTS} SELECT CAST(round(a / 1000.0) * 1000 AS BIGINT) AS start_us, CAST(round(b / 1000.0) * 1000 AS BIGINT) AS end_us, label FROM s WHERE b IS NOT NULL"
ORACLES["synthetic_segments"] = f"WITH {STEPS} SELECT song, CAST(pos * 2000000 AS BIGINT) AS start_us, CAST((pos + 1) * 2000000 AS BIGINT) AS end_us, label FROM steps"
ORACLES["playlist_file"] = """SELECT printf('20%02d-01-01', p_partkey % 30) AS release_date, 'track "' || p_partkey || '", live' AS name, CAST(p_partkey % 101 AS INTEGER) AS popularity, 'a' || (p_partkey % 5) || CASE WHEN p_partkey % 2 = 0 THEN '|b' ELSE '' END AS artists FROM part"""
PITCHES = f"""{MATCHED}, tracks AS (
  SELECT song, bar, 'Gtr' AS track, CASE WHEN ln = 4 THEN [] WHEN f = 'R' THEN [40 + (pk * ln * 5) % 30, 41 + (pk * ln * 11) % 30] ELSE list_transform(intervals, lambda i: i + 48 + pk % 12) END AS pitches FROM bars JOIN vocabulary ON t = (pk * 7 + ln) % 18
  UNION ALL SELECT song, bar, 'Bass', CASE WHEN f = 'N' AND ln = 4 THEN [24 + pk % 12, 31 + pk % 12] WHEN f = 'N' THEN [24 + (pk + CASE WHEN ln = 7 THEN 1 ELSE 0 END) % 12] WHEN f = 'R' THEN [24 + (pk + ln) % 12] ELSE [] END FROM bars
)"""
ORACLES["pitch_files"] = f"WITH {PITCHES} SELECT song, bar, track, {text('pitches')} AS pitches FROM tracks"
ORACLES["chord_files"] = ORACLES["match_bar"]
ORACLES["track_counts"] = f"""WITH {PITCHES}, r AS (SELECT song, bar, track, row_number() OVER (PARTITION BY song ORDER BY bar, track) AS n FROM tracks WHERE len(pitches) > 0)
SELECT song, count(*) AS n_bars, string_agg(bar || ':' || track, ',' ORDER BY n) FILTER (n <= 15) AS first FROM r GROUP BY song"""
ERROR = "CASE page_id % 7 WHEN 1 THEN 'gpx-container' WHEN 2 THEN 'legacy-binary' WHEN 3 THEN 'not-a-zip' WHEN 4 THEN 'not-a-gp-file' WHEN 5 THEN 'corrupt' END"
ORACLES["score_messages"] = f"""WITH e AS (SELECT page_id, {ERROR} AS error FROM pages WHERE page_id % 7 > 0 OR ({GOOD}))
SELECT 'page-' || page_id AS path, error, CASE error {' '.join(f'WHEN {lit(k)} THEN {lit(m)}' for k, m in dims.GP_ERRORS.items())} END AS message, CASE WHEN error IS NULL THEN page_id % 7 = 6 END AS has_chords FROM e"""

# steps, keys and quizzes

ORACLES["steps_to_play"] = f"WITH {STEPS} SELECT song, CAST(pos // 4 AS INTEGER) AS section, pos FROM steps WHERE song % 3 <> 1 OR pos // 4 = song % 3"
ORACLES["song_overview"] = f"""WITH n AS (SELECT l_orderkey AS song, count(*) AS n FROM lineitem GROUP BY 1)
SELECT song, TRUE AS has_steps, n > 4 AS has_more, CASE WHEN n = 1 THEN '1 acorde' ELSE n || ' acordes' END AS chords, {name('song')} || CASE WHEN (song // 12) % 2 = 1 THEN ' menor' ELSE ' maior' END AS key FROM n"""
ORACLES["review_rows"] = f"WITH {STEPS} SELECT song, CASE WHEN pos < 4 THEN 0 ELSE 1 END AS section, CASE WHEN pos < 4 THEN pos ELSE pos - 4 END AS pos, label FROM steps"
ORACLES["active_step"] = f"""WITH {STEPS}, p AS (SELECT song, pos, coalesce(beats, 4) * 2 AS n, sum(coalesce(beats, 4) * 2) OVER (PARTITION BY song ORDER BY pos) - coalesce(beats, 4) * 2 AS a FROM steps)
SELECT s.song, CAST(s.pos * 11 - 1 AS BIGINT) AS eighth, CAST(coalesce(p.pos, -1) AS INTEGER) AS active FROM steps s LEFT JOIN p ON p.song = s.song AND p.a <= s.pos * 11 - 1 AND s.pos * 11 - 1 < p.a + p.n"""
ORACLES["label_durations"] = f"WITH {SEGMENTS}, d AS (SELECT label, CAST(sum(b - a) AS BIGINT) AS duration_us FROM s WHERE b IS NOT NULL GROUP BY label) SELECT *, CAST(row_number() OVER (ORDER BY duration_us DESC, label) - 1 AS INTEGER) AS place FROM d"
ORACLES["bar_classes"] = f"WITH {ANALYZED} SELECT song, number, CASE WHEN kind = 'unclear' THEN 'unclear' WHEN kind = 'no-chord-data' THEN 'no-data' WHEN degree IS NULL THEN 'chromatic' ELSE 'diatonic' END AS bar_class FROM done"
ORACLES["diatonic_steps"] = f"WITH {FIELD}, {PART_KEYS} SELECT p_partkey, key_root, is_minor, CAST(degree - 1 AS INTEGER) AS degree, numeral AS label, CAST(4 AS DOUBLE) AS beats FROM field JOIN part_keys USING (key_root, is_minor)"
ORACLES["explained_degrees"] = f"WITH {STEPS} SELECT song, pos, CASE WHEN degree <> 5 THEN 'text ' || (degree * 2 + CAST(is_minor AS INTEGER)) END AS text FROM steps"
ORACLES["key_changes"] = f"""WITH {FIELD}, f AS (SELECT key_root, is_minor, string_agg(chord_name, '|' ORDER BY degree) AS field FROM field GROUP BY ALL)
SELECT n_nationkey, is_minor, field, CAST(NULL AS INTEGER) AS selected, 0 AS n_highlighted FROM nation JOIN f ON key_root = n_nationkey % 12"""
COLOR = "CASE fn " + " ".join(f"WHEN {lit(f)} THEN {lit(c)}" for f, c in dims.FUNCTION_COLORS.items()) + " END"
ORACLES["selected_chords"] = f"""WITH {FIELD} SELECT p_partkey, CAST(f.degree - 1 AS INTEGER) AS selected, {text('f.notes')} AS highlighted, {COLOR} AS color
FROM part LEFT JOIN field f ON f.key_root = p_partkey % 12 AND f.is_minor = (p_partkey % 2 = 1) AND f.degree - 1 = p_partkey % 9"""
ORACLES["default_scales"] = f"""WITH {SCALES}, {PART_KEYS} SELECT p_partkey, key_root, is_minor, {text(moved('key_root', 's.intervals'))} AS notes FROM part_keys JOIN scales s ON s.scale_id = CASE WHEN is_minor THEN 'aeolian' ELSE 'major' END"""
BASS = f"strings(no, open, oct) AS ({values([(k, n, o) for k, (n, o) in enumerate(dims.BASS)])})"
ORACLES["shown_frets"] = f"""WITH {BASS}, f AS (SELECT n_nationkey, no AS string_no, CAST(fret AS INTEGER) AS fret, CASE WHEN n_nationkey % 3 = 0 THEN (no = 0 AND fret = n_nationkey % 13) OR (no = 2 AND fret = 4) ELSE (open + fret) % 12 = n_nationkey % 12 END AS highlighted FROM nation, strings, range(13) t(fret))
SELECT *, highlighted OR n_nationkey % 2 = 0 AS shown FROM f"""
ORACLES["shortcut_keys"] = f"""WITH k(key, note, octave) AS ({values(dims.KEY_MAP)}), p AS (SELECT n_nationkey, CAST(o AS INTEGER) AS octave, CAST(n AS INTEGER) AS note FROM nation, range(3, 5) a(o), range(12) b(n))
SELECT n_nationkey, p.octave, p.note, upper(key) AS shortcut, coalesce(key = {lit([k for k, _, _ in dims.KEY_MAP])}[n_nationkey % 18 + 1], FALSE) AS is_pressed FROM p LEFT JOIN k ON k.note = p.note AND k.octave = p.octave"""
ORACLES["small_labels"] = f"""SELECT p_partkey, {lit(dims.INTERVAL_LABELS)}[p_partkey % 13 + 1] AS interval, CASE WHEN p_partkey % 2 = 1 THEN 'e' ELSE CAST(p_partkey % 8 // 2 + 1 AS VARCHAR) END AS beat,
  CASE WHEN p_partkey % 2 = 0 THEN 'Tempo ' || (p_partkey % 8 // 2 + 1) ELSE (p_partkey % 8 // 2 + 1) || 'e' END AS dot, {lit(dims.PALETTE)}[CASE WHEN p_partkey % 13 = 12 THEN 1 ELSE (p_partkey % 13 + 1) % 12 + 1 END] AS next_color FROM part"""
MODES = [("interval", "interval_questions", "seed % 4 = 0"), ("chordType", "chord_type_questions", "seed % 4 = 1"), ("degree", "degree_questions", "seed % 4 = 2"), ("chordId", "chord_id_questions", "seed % 8 = 3"), ("chordId", "diatonic_chord_questions", "seed % 8 = 7")]
ORACLES["question_mix"] = " UNION ALL ".join(f"SELECT seed, {lit(mode)} AS mode, notes, correct, options, tip_key FROM ({ORACLES[source]}) WHERE {which}" for mode, source, which in MODES)
ORACLES["quiz_tips"] = f"SELECT seed, tip_key, CASE WHEN CAST(tip_key AS INTEGER) <= 10 THEN 'tip ' || tip_key END AS tip FROM ({ORACLES['interval_questions']})"
ORACLES["tick_stream"] = f"SELECT * FROM ({ORACLES['playback_events']}) WHERE tick BETWEEN 0 AND 10"

# documents

ORACLES["bar_counts"] = f"WITH {DOCUMENTS} SELECT doc, CAST((SELECT count(*) FROM b WHERE b.doc = d.doc) AS INTEGER) AS n_bars FROM (SELECT DISTINCT doc FROM sec) d"
ORACLES["add_section"] = f"""WITH {DOCUMENTS} SELECT doc, CAST(place - 1 AS INTEGER) AS place, section_id, name, CAST((SELECT count(*) FROM b WHERE b.o = s.o AND listed) AS INTEGER) AS n_bars FROM sec s
UNION ALL SELECT doc, CAST(count(*) AS INTEGER), 'new', 'fresh', 0 FROM sec GROUP BY doc"""
ORACLES["section_colors"] = f"WITH {DOCUMENTS} SELECT b.doc, bar_id, CASE WHEN pk % 5 = 0 THEN {lit(dims.PALETTE[3])} ELSE s.color END AS color FROM (SELECT b.*, nb.pk FROM b JOIN nb ON nb.o = b.o AND nb.n = b.n) b JOIN sec s ON s.o = b.o WHERE listed"
ORACLES["remove_repeated"] = f"""WITH {DOCUMENTS}, r AS (SELECT doc, place, section_id, lag(section_id) OVER (PARTITION BY doc ORDER BY place) AS repeat_of, count(*) OVER (PARTITION BY doc) AS many FROM sec)
SELECT doc, section_id, CASE WHEN place <> 3 THEN repeat_of END AS repeat_of, CASE WHEN doc % 2 <> 0 THEN 'other' END AS focus FROM r WHERE place <> 2"""
ORACLES["repeated_array"] = f"WITH {DOCUMENTS} SELECT doc, CAST(place - 2 AS INTEGER) AS place, section_id, CAST(NULL AS VARCHAR) AS repeat_of FROM sec WHERE place > 1"
ORACLES["picker"] = "SELECT p_partkey, CAST(CASE WHEN p_partkey % 5 > 0 AND p_partkey % 3 = p_partkey % 4 THEN NULL ELSE p_partkey % 4 END AS INTEGER) AS root, p_partkey % 100 + 1 < 64 AS can_add FROM part"
ORACLES["set_active_section"] = "SELECT DISTINCT l_orderkey AS song, CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE 0 END AS n_sections, CAST(l_orderkey % 4 AS INTEGER) AS active FROM lineitem"
