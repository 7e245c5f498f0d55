"""SQL of queries over passages: of pages, of the newest documents, of what a scripted judge says of chunks."""

from __future__ import annotations

from collections.abc import Callable

from ..rules.model import Rule
from .lint_corpus import lint_sql, quoted

_BLANK = r"[\s\p{Z}]"


def _packed(source: str, target: int) -> str:
    """CTEs `parts` and `packed_` over `source` (doc_id, text), and `chunks` (doc_id, chunk_ix, chunk)."""
    joins = f"strlen(chunk) + 2 + strlen(ps[i + 1]) <= {target}"
    return f"""parts AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(regexp_replace(p, '^{_BLANK}+', ''), '{_BLANK}+$', '')), lambda p: p <> '') AS ps FROM {source}),
packed_ AS (SELECT doc_id, 1 AS i, 0::BIGINT AS chunk_ix, ps[1] AS chunk, ps FROM parts WHERE len(ps) > 0
    UNION ALL SELECT doc_id, i + 1, CASE WHEN {joins} THEN chunk_ix ELSE chunk_ix + 1 END, CASE WHEN {joins} THEN chunk || chr(10) || chr(10) || ps[i + 1] ELSE ps[i + 1] END, ps FROM packed_ WHERE i < len(ps)),
chunks AS (SELECT doc_id, chunk_ix, arg_max(chunk, i) AS chunk FROM packed_ GROUP BY doc_id, chunk_ix)"""


def passage_sql(sql: dict[str, str], counted: list[Rule], rows: Callable[[list[Rule]], str], words: str, judged: list[Rule], least: int = 20, most: int = 100) -> dict[str, str]:
    over = f"(words > 0 AND words + ns[i + 1] > {most})"
    source = lint_sql().replace("lint AS (", "corpus AS (", 1)
    blank = "[^\\s\\p{Z}]"
    found = f"""WITH asked AS ({sql["judge_requests"]}), texts AS ({{lint}}), said AS (SELECT a.*, regexp_extract(substring(text, a.start::BIGINT + 1, (a."end" - a.start)::BIGINT), '^{blank}+(?:{_BLANK}+{blank}+){{0,5}}') AS q FROM asked a JOIN texts USING (doc_id)),
        each_ AS (SELECT doc_id, cache_key, start, q, unnest(range(0, 5)) AS ord FROM said),
        judged AS (SELECT doc_id, cache_key, ord::INT AS ord, CASE ord WHEN 1 THEN {quoted(judged[-1].id)} WHEN 2 THEN 'other/rule' ELSE {quoted(judged[0].id)} END AS rule,
            CASE WHEN ord = 0 OR ord = 1 AND (length(q) >= 10 OR q[2] = '#') THEN 'grounded' WHEN ord = 2 THEN 'foreign' WHEN ord = 4 THEN 'denied' ELSE 'not found' END AS status, start, start + length(q) AS stop, CASE ord WHEN 1 THEN 0.7 WHEN 3 THEN 1.0 WHEN 4 THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence FROM each_)"""
    found = found.replace("{lint}", f"WITH {lint_sql()} SELECT doc_id, text FROM lint")
    grounded = "status IN ('grounded', 'denied')"
    return {
        "page_passages": f"""WITH RECURSIVE pages_ AS ({sql["page_texts"]}), cut AS (SELECT page_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: len(regexp_extract_all(s, '\\S+')) >= 3) AS ss FROM pages_),
            sized AS (SELECT *, list_transform(ss, lambda s: len(regexp_extract_all(s, '\\S+'))) AS ns FROM cut),
            run AS (SELECT page_id, ss, ns, 0 AS i, 0::BIGINT AS words, ''::VARCHAR AS open, NULL::VARCHAR AS done FROM sized
            UNION ALL SELECT page_id, ss, ns, i + 1, CASE WHEN {over} THEN ns[i + 1] ELSE words + ns[i + 1] END, CASE WHEN {over} OR words = 0 THEN ss[i + 1] ELSE open || ' ' || ss[i + 1] END, CASE WHEN {over} AND words >= {least} THEN open END FROM run WHERE i < len(ss)),
            all_ AS (SELECT page_id, i, done AS passage FROM run WHERE done IS NOT NULL UNION ALL SELECT page_id, i + 1, open FROM run WHERE i = len(ss) AND words >= {least})
            SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS ix, passage FROM all_""",
        "stratified_passages": f"""WITH RECURSIVE {lint_sql()}, newest AS (SELECT doc_id, text FROM lint WHERE regexp_matches(text, '{blank}') ORDER BY doc_id DESC LIMIT 28), {_packed("newest", 900)},
            counts AS (SELECT doc_id, max(chunk_ix) + 1 AS n, least(max(chunk_ix) + 1, greatest(1, ceil(28 / greatest(1, least(28, (SELECT count(*) FROM lint)))))::BIGINT) AS k FROM chunks GROUP BY doc_id),
            slots AS (SELECT doc_id, n, k, unnest(range(0, k)) AS slot FROM counts), taken AS (SELECT s.doc_id, slot, CASE WHEN length(chunk) > 900 THEN substring(chunk, 1, 900) || '…' ELSE chunk END AS passage FROM slots s JOIN chunks c ON c.doc_id = s.doc_id AND c.chunk_ix = CASE WHEN k = 1 THEN 0 ELSE slot * (n - 1) // (k - 1) END),
            sums AS (SELECT *, sum(strlen(passage)) OVER w AS running, count(*) OVER w AS nth FROM taken WINDOW w AS (ORDER BY doc_id DESC, slot ROWS UNBOUNDED PRECEDING))
            SELECT doc_id, slot::INT AS slot, passage, running::BIGINT AS running FROM sums WHERE running <= 16000 AND nth <= 28""",
        "self_firing_chunks": f"""WITH RECURSIVE {source}, {_packed("corpus", 2000)}, keyed AS (SELECT doc_id AS d, chunk_ix AS c, row_number() OVER (ORDER BY doc_id, chunk_ix) AS doc_id, chunk AS text FROM chunks),
            parsed AS (SELECT *, len(regexp_extract_all(text, {words}))::BIGINT AS word_count, list_filter(regexp_split_to_array(text, '\\n(?:[^\\S\\n]*\\n)+'), lambda b: regexp_matches(b, '\\S')) AS bs FROM keyed), hits AS ({rows(counted)})
            SELECT rule_id, count(*)::BIGINT AS n_chunks, arg_min(d, h.doc_id) AS first_doc, arg_min(c, h.doc_id)::INT AS first_chunk FROM hits h JOIN keyed USING (doc_id) WHERE n > 0 AND (engine = 'phrase' OR n / w * 1000 > thr) GROUP BY rule_id""",
        "judge_findings": f"""{found} SELECT doc_id, cache_key, ord, rule, status, CASE WHEN {grounded} THEN start ELSE -1 END::INT AS start, CASE WHEN {grounded} THEN stop ELSE -1 END::INT AS "end", confidence FROM judged""",
        "judged_scores": f"""{found}, simple AS ({sql["simple_scores"]}), added AS (SELECT doc_id, count(*) AS n, sum(3 * confidence) AS more FROM judged WHERE status = 'grounded' GROUP BY doc_id),
            sums AS (SELECT doc_id, word_count::INT AS word_count, coalesce(n, 0)::BIGINT AS n_judged, penalty + coalesce(more, 0) AS penalty FROM simple LEFT JOIN added USING (doc_id))
            SELECT doc_id, word_count, n_judged, round(penalty, 6)::DOUBLE AS penalty, least(100, greatest(0, round(100 * exp(-(penalty / greatest(word_count, 1) * 1000) / 100))))::INT AS score FROM sums""",
    }
