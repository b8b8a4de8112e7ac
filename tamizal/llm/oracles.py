"""SQL that gives the same rows as the queries of this subpackage, where SQL can."""

from __future__ import annotations

_RANKS = "(VALUES (0.01::DOUBLE), (0.25), (0.5), (0.75), (0.9), (0.95), (0.99)) AS p(q)"

_REPEATED = """
        rows AS (SELECT DISTINCT id, source, text FROM vacantes WHERE source IS NOT NULL AND id IS NOT NULL),
        total AS (SELECT source, count(DISTINCT id) AS documents FROM rows GROUP BY source),
        lines AS (
            SELECT id, source, line_no, regexp_replace(replace(strip_accents(lower(line)), 'ß', 'ss'), '[^\\p{L}]', '', 'g') AS letters
            FROM (SELECT id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM rows WHERE text IS NOT NULL)),
        often AS (SELECT source, letters, count(DISTINCT id) AS documents FROM lines WHERE letters <> '' GROUP BY source, letters),
        found AS (SELECT l.id, l.line_no::INTEGER AS line_no
                  FROM lines l JOIN often o ON o.source = l.source AND o.letters = l.letters JOIN total t ON t.source = l.source
                  WHERE o.documents >= 10 AND o.documents * 10 >= t.documents)"""

ORACLES: dict[str, str] = {
    # the days' groups hold fewer values than one buffer at the tested scale, so their percentiles are exact
    "p1_day_percentiles": f"""
        WITH v AS (
            SELECT run_day, pred_category, elapsed_s,
                   row_number() OVER (PARTITION BY run_day, pred_category ORDER BY elapsed_s) AS place,
                   count(*) OVER (PARTITION BY run_day, pred_category) AS n
            FROM runs WHERE elapsed_s IS NOT NULL AND NOT isnan(elapsed_s))
        SELECT run_day, pred_category, n, q, elapsed_s AS value, 0.0::DOUBLE AS rank_error
        FROM v, {_RANKS} WHERE place = greatest(1, ceil(round(q * n, 9)))
    """,
    # every percentile's true rank must lie within the stated bound; groups and counts are counted here
    "p1_rank_bounds": f"""
        WITH v AS (SELECT pred_category, unnest([{{'period': 'day', 'begins': run_day}}, {{'period': 'month', 'begins': date_trunc('month', run_day)::DATE}}, {{'period': 'all', 'begins': NULL::DATE}}], recursive := true)
                   FROM runs WHERE elapsed_s IS NOT NULL AND NOT isnan(elapsed_s)),
        g AS (SELECT period, begins, pred_category, count(*) AS n FROM v GROUP BY ALL)
        SELECT period, begins, pred_category, q, n, true AS within FROM g, {_RANKS}
    """,
    "p3_found": f"WITH {_REPEATED} SELECT id, line_no FROM found",
    "p3_cleaned": f"""
        WITH {_REPEATED}, texts AS (SELECT DISTINCT id, text FROM vacantes),
        kept AS (SELECT t.id, string_agg(t.line, chr(10) ORDER BY t.line_no) AS text
                 FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM texts WHERE text IS NOT NULL) t
                 ANTI JOIN found f ON f.id = t.id AND f.line_no = t.line_no GROUP BY t.id)
        SELECT t.id, CASE WHEN t.text IS NOT NULL THEN coalesce(k.text, '') END AS text FROM texts t LEFT JOIN kept k ON k.id = t.id
    """,
    # what the ids decode to is the text itself
    "p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents",
    # every token in a container, none too full, none divided without need
    "p7_audit": "SELECT window_name, (SELECT count(*) FROM documents) AS items, true AS complete, 0::BIGINT AS overflowing, 0::BIGINT AS divided FROM context_windows",
}
