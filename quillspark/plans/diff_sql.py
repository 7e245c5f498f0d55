"""SQL of line diffs: the table of common subsequences row by row, then a walk through it."""

from __future__ import annotations

from .lint_corpus import lint_sql


def _lines(text: str) -> str:
    return f"list_transform(CASE WHEN {text} LIKE '%' || chr(10) OR {text} = '' THEN string_split({text}, chr(10))[:-2] ELSE string_split({text}, chr(10)) END, lambda x: regexp_replace(x, '\\r$', ''))"


def line_diff_sql(fixed: str, context: int = 1) -> str:
    """`fixed`: SQL of doc_id and fixed_text."""
    return f"""WITH RECURSIVE {lint_sql()}, fixed AS MATERIALIZED ({fixed}),
both_ AS MATERIALIZED (SELECT doc_id, {_lines("text")} AS o, {_lines("fixed_text")} AS n FROM lint JOIN fixed USING (doc_id) WHERE text <> fixed_text),
heads AS (SELECT *, len(list_filter(range(1, least(len(o), len(n)) + 1), lambda i: o[1:i] = n[1:i])) AS head FROM both_),
tails AS (SELECT *, len(list_filter(range(1, least(len(o), len(n)) - head + 1), lambda i: o[len(o) - i + 1:] = n[len(n) - i + 1:])) AS tail FROM heads),
middles AS MATERIALIZED (SELECT *, o[head + 1:len(o) - tail] AS a, n[head + 1:len(n) - tail] AS b FROM tails),
table_ AS (SELECT doc_id, a, b, len(a) AS i, list_transform(range(0, len(b) + 1), lambda j: 0::BIGINT) AS sums FROM middles
    UNION ALL SELECT doc_id, a, b, i - 1, list_transform(range(1, len(b) + 2), lambda j: list_max(list_transform(range(j, len(b) + 2), lambda k: greatest(sums[k], CASE WHEN k <= len(b) AND b[k] = a[i] THEN sums[k + 1] + 1 ELSE 0 END)))) FROM table_ WHERE i > 0),
rows_ AS MATERIALIZED (SELECT doc_id, i, sums FROM table_),
walk AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS j, NULL::VARCHAR AS op FROM middles
    UNION ALL SELECT doc_id, i + (move <> 'added')::BIGINT, j + (move <> 'removed')::BIGINT, move FROM (SELECT w.doc_id, w.i, w.j,
        CASE WHEN w.i < len(a) AND w.j < len(b) AND a[w.i + 1] = b[w.j + 1] THEN 'same' WHEN w.j >= len(b) OR (w.i < len(a) AND under.sums[w.j + 1] >= here.sums[w.j + 2]) THEN 'removed' ELSE 'added' END AS move
        FROM walk w JOIN middles m USING (doc_id) JOIN rows_ here ON here.doc_id = w.doc_id AND here.i = w.i LEFT JOIN rows_ under ON under.doc_id = w.doc_id AND under.i = w.i + 1 WHERE w.i < len(a) OR w.j < len(b))),
steps AS (SELECT doc_id, 'same' AS op, k AS x, k AS y FROM (SELECT doc_id, unnest(range(1, head + 1)) AS k FROM middles)
    UNION ALL SELECT doc_id, op, head + i, head + j FROM walk JOIN middles USING (doc_id) WHERE op IS NOT NULL
    UNION ALL SELECT doc_id, 'same', len(o) - k, len(n) - k FROM (SELECT doc_id, o, n, unnest(range(0, tail)) AS k FROM middles)),
ordered AS (SELECT doc_id, op, CASE WHEN op <> 'added' THEN x END AS old_line, CASE WHEN op <> 'removed' THEN y END AS new_line, row_number() OVER (PARTITION BY doc_id ORDER BY x + y) AS k FROM steps),
near AS (SELECT *, max((op <> 'same')::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN {context} PRECEDING AND {context} FOLLOWING) = 1 AS kept FROM ordered),
shown AS (SELECT *, lag(kept) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM near)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS ord, CASE WHEN kept THEN op ELSE 'gap' END AS op, coalesce(CASE WHEN kept THEN old_line END, 0)::INT AS old_line, coalesce(CASE WHEN kept THEN new_line END, 0)::INT AS new_line,
    CASE WHEN kept THEN coalesce(o[old_line], n[new_line]) END AS text FROM shown JOIN both_ USING (doc_id) WHERE kept OR before IS NULL OR before"""
