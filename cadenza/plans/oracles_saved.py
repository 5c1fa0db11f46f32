"""DuckDB SQL for the queries of ``catalogue_saved``, written from the rules and not from the DataFrame code."""

from __future__ import annotations

from cadenza import dims
from cadenza.plans.oracles import DOCUMENTS, GOOD, ORACLES, STORED, lit, reindexed
from cadenza.plans.oracles_library import NOW

__all__ = ["ORACLES"]

ORACLES["score_folder"] = f"""WITH e AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'not-a-zip' ELSE CASE page_id % 10 WHEN 3 THEN 'gpx-container' WHEN 6 THEN 'legacy-binary' WHEN 9 THEN 'corrupt' END END AS error FROM pages)
SELECT 'page-' || page_id AS path, error, CASE error {' '.join(f'WHEN {lit(k)} THEN {lit(m)}' for k, m in dims.GP_ERRORS.items())} END AS message,
  CASE WHEN error IS NULL AND {GOOD} THEN 'Page ' || page_id END AS title, CASE WHEN error IS NULL THEN CAST(1 + page_id % 5 AS INTEGER) END AS n_bars FROM e"""
ORACLES["device_tables"] = f"""WITH {STORED}, after AS (SELECT id, CASE WHEN k % 3 = 0 THEN 'pushed ' || title ELSE title END AS title, CASE WHEN k % 3 = 0 THEN {NOW} ELSE updated_at END AS updated_at,
  CASE WHEN k % 3 = 0 THEN 'd' || (CAST(substr(device_id, 2) AS INTEGER) + 1) % 10 ELSE device_id END AS device_id FROM stored)
SELECT * FROM after WHERE device_id IN ('d4', 'd7')"""
ORACLES["evolved_table"] = f"WITH {STORED} SELECT id, title, CASE WHEN k % 3 = 0 THEN 120 ELSE bpm END AS bpm, updated_at FROM stored"
ORACLES["edit_log_bars"] = f"""WITH {DOCUMENTS}, many AS (SELECT doc, count(*) AS many FROM sec GROUP BY doc), put AS (
  SELECT b.doc, bar_id, ts, accents, CASE WHEN nth = 1 AND many >= 3 THEN 3 ELSE place END AS a, CASE WHEN nth = 1 AND many >= 3 THEN 1000000 ELSE b.n END AS b, many
    FROM b JOIN sec s ON s.doc = b.doc AND s.o = b.o JOIN many ON many.doc = b.doc WHERE listed
  UNION ALL SELECT doc, 'added', '6/8', NULL, 1, 2000000, many FROM many
) {reindexed('SELECT doc, bar_id, ts, accents, CASE WHEN a = 1 AND many >= 3 THEN 3.5 ELSE a END AS a, b FROM put WHERE a <> 2')}"""
