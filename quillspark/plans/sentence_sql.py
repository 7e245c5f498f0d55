"""SQL of the queries that look at sentences: blocks, sentences and the measures over them, in another dialect.

The dialect's patterns know no look-behind. A block is cut into stretches without
a full stop and runs of stops; whether a run ends a sentence is asked of the text
on either side of it.
"""

from __future__ import annotations

from ..functions.sentences import ABBREVIATIONS, CASE, REPORTER
from ..operators.lint import LEAST_SENTENCES, LEAST_WORDS, PAIR, TRIAD
from ..operators.mining import FAMILIES, LEAST_SENTENCES as LEAST_OF_CAP, LEAST_WORDS as LEAST_CORPUS, OXFORD_WITH, OXFORD_WITHOUT, family_pattern
from ..rules.core import CORE
from .lint_corpus import lint_sql, quoted

W = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
_BLANK = r"[\s\p{Z}]"
_NAMES = "|".join(sorted((a[:-1].replace(".", r"\.") for a in ABBREVIATIONS), key=lambda a: (-len(a), a)))
_BLOCKED = rf"(?:(?:^|[^\p{{L}}\p{{N}}.()'’-])(?:(?i:{_NAMES})|[A-Z]|[0-9]{{1,18}}(?i:d|st|nd|rd|th))|(?:^|\n)[^\S\n]{{0,32}}\(?(?:[0-9]{{1,3}}|[A-Za-z]|[ivxlcIVXLC]{{1,3}})\)?)$"
_WORD = r"\p{L}[\p{L}\p{N}]*(?:['’-][\p{L}\p{N}]+)*"
_NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
_SIGNAL = rf"^[\s\"“‘']*(?:See also|See|But see|Cf\.|Accord|E\.g\.,)\s(?s:.*)(?:{CASE})"
_SEPARATOR = r"\n(?:[^\S\n]*\n)+"


def _own(pattern: str) -> str:
    """A pattern with the dialect's own words spelled out, inside classes too."""
    out, inside = "", False
    i = 0
    while i < len(pattern):
        if pattern[i] == "\\":
            out += (W[1:-1] if inside else W) if pattern[i : i + 2] == r"\w" else pattern[i : i + 2]
            i += 2
            continue
        inside = pattern[i] == "[" or inside and pattern[i] != "]"
        out += pattern[i]
        i += 1
    return quoted(out)


_WORDS = quoted(f"{W}(?:[{W[1:-1]}'’-]*{W})?")
#: blocks (doc_id, b, bstart, btext) and sents (doc_id, b, s, start, text, n, opener, cited).
SENTENCES = f"""WITH {lint_sql()},
docs AS (SELECT *, len(regexp_extract_all(text, {_WORDS}))::BIGINT AS word_count FROM lint),
cut AS (SELECT doc_id, regexp_split_to_array(text, {quoted(_SEPARATOR)}) AS ps, regexp_extract_all(text, {quoted(_SEPARATOR)}) AS ss FROM lint),
pieces AS (SELECT doc_id, i AS b, ps[i] AS raw, (coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ss[1:i - 1], lambda x: length(x))), 0))::BIGINT AS pos FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM cut)),
blocks AS MATERIALIZED (SELECT doc_id, b, pos + length(raw) - length(regexp_replace(raw, {quoted("^" + _BLANK + "+")}, '')) AS bstart, regexp_replace(regexp_replace(raw, {quoted("^" + _BLANK + "+")}, ''), {quoted(_BLANK + "+$")}, '') AS btext FROM pieces WHERE regexp_matches(raw, {quoted(r"[^\s\p{Z}]")})),
tokens AS (SELECT doc_id, b, bstart, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT *, regexp_extract_all(btext, {quoted(r'''[^.!?]+|[.!?]+["'”’)\]]*''')}) AS ts FROM blocks)),
marked AS (SELECT doc_id, b, bstart, i, ts[i] AS t, (regexp_matches(ts[i], '^[.!?]') AND i < len(ts) AND regexp_matches(ts[i + 1], {quoted(r'''^[\s\p{Z}]+[\p{Lu}0-9"“‘'(]''')})
    AND NOT (regexp_matches(ts[i], {quoted(r"^\.(?:[^.!?]|$)")}) AND regexp_matches(right(array_to_string(ts[greatest(1, i - 8):i - 1], ''), 60), {quoted(_BLOCKED)})))::INT AS ends FROM tokens),
placed AS (SELECT *, coalesce(sum(ends) OVER w, 0) AS s, coalesce(sum(length(t)) OVER w, 0) AS pos FROM marked WINDOW w AS (PARTITION BY doc_id, b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
raws AS (SELECT doc_id, b, s, min(bstart + pos)::BIGINT AS start, string_agg(t, '' ORDER BY i) AS raw FROM placed GROUP BY doc_id, b, s),
bare AS (SELECT doc_id, b, s, start + length(raw) - length(regexp_replace(raw, {quoted("^" + _BLANK + "+")}, '')) AS start, regexp_replace(regexp_replace(raw, {quoted("^" + _BLANK + "+")}, ''), {quoted(_BLANK + "+$")}, '') AS text FROM raws),
sents AS MATERIALIZED (SELECT *, start + length(text) AS stop, len(regexp_extract_all(text, {quoted(f"{_WORD}|{_NUMBER}")}))::BIGINT AS n, nullif(lower(regexp_extract(text, {quoted(_WORD)})), '') AS opener,
    regexp_matches(text, {_own(REPORTER.removeprefix("(?U)"))}) OR regexp_matches(text, {_own(_SIGNAL)}) AS cited, row_number() OVER (PARTITION BY doc_id ORDER BY b, s) AS k FROM bare WHERE text <> '')"""

#: Findings `f` (doc_id, start, stop, message) with place and line; those on a line with a directive are off.
_DIRECTIVE = "(?i)prose-(?:disable|enable)"
_PLACED = f"""parts AS (SELECT f.*, substring(text, 1, start) AS before, substring(text, start + 1) AS after FROM f JOIN lint USING (doc_id)),
heads AS (SELECT *, length(before) - length(replace(before, chr(10), '')) + 1 AS line, regexp_extract(before, '[^\\n]*$') AS head FROM parts),
kept AS (SELECT *, head || split_part(after, chr(10), 1) AS whole FROM heads)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start, stop) - 1)::INT AS ord, start::INT AS start, stop::INT AS "end", line::INT AS line,
    (length(head) + length(regexp_replace(head, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) + 1)::INT AS "column", message,
    regexp_replace(regexp_replace(whole, {quoted("^" + _BLANK + "+")}, ''), {quoted(_BLANK + "+$")}, '') AS excerpt FROM kept WHERE NOT regexp_matches(whole, '{_DIRECTIVE}')"""
_RULES = {r.name: r for r in CORE}
_TRIAD = _own(TRIAD.replace(r"\b\w+(?:\s+\w+){0,3}", r"\w+(?:\s+\w+){0,3}"))
#: Words' edges as the characters beside them: each such character stands twice, so that neighbours share none.
_PAIR = _own("(?:^|[^\\w])" + PAIR.replace(r"\b", "") + "(?:[^\\w]|$)")
_TWICE = f"regexp_replace(text, '([^{W[1:-1]}])', '\\1\\1', 'g')"
_METRICS = f"""{SENTENCES},
lens AS (SELECT doc_id, k, b, n::DOUBLE AS n, opener, cited, len(regexp_extract_all(text, {_TRIAD})) AS triads, len(regexp_extract_all({_TWICE}, {_PAIR})) AS pairs, avg(n) OVER (PARTITION BY doc_id) AS mean FROM sents),
steps AS (SELECT *, (n - mean) * (lead(n) OVER (PARTITION BY doc_id ORDER BY k) - mean) AS lag FROM lens),
sums AS (SELECT doc_id, count(*) AS m, count_if(cited) AS cited, sum(n) AS words, sum((n - mean) * (n - mean)) AS square, sum(lag) AS lag, sum(triads) AS triads, sum(pairs) AS pairs FROM steps GROUP BY doc_id),
named AS (SELECT doc_id, b, opener, lead(opener) OVER w AS other, lead(b) OVER w AS b2 FROM lens WHERE opener IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
runs AS (SELECT doc_id, count_if(b = b2) AS beside, count_if(b = b2 AND opener = other) AS same FROM named GROUP BY doc_id)"""
_STATS = f"""{SENTENCES},
texts AS (SELECT count(*) AS files, sum(len(regexp_extract_all(text, {quoted(r"[^\s\p{Z}]+")})))::BIGINT AS words, sum(length(text) - length(replace(text, '—', '')))::BIGINT AS em_dashes, sum(length(text) - length(replace(text, '–', '')))::BIGINT AS en_dashes,
    sum(length(text) - length(replace(text, ';', '')))::BIGINT AS semicolons, sum(len(regexp_extract_all(text, {_own(OXFORD_WITH)})))::BIGINT AS oxford_with, sum(len(regexp_extract_all(text, {_own(OXFORD_WITHOUT)})))::BIGINT AS oxford_without,
    {", ".join(f"sum(len(regexp_extract_all(text, {quoted(family_pattern(n))})))::BIGINT AS {n.replace('-', '_')}" for n in FAMILIES)} FROM lint),
said AS (SELECT count(*)::BIGINT AS sentences, max(n)::INT AS max_sentence, round(sum(n) / count(*), 6)::DOUBLE AS mean_sentence FROM sents WHERE NOT cited AND n > 0),
stats AS (SELECT * FROM texts, said)"""
_CAP = "greatest(30, ceil(max_sentence * 1.2))"
_ABSENT = [
    ("no-em-dash", "em_dashes = 0", "0"), ("no-semicolon", "semicolons = 0", "0"), ("serial-comma", "oxford_without = 0 AND oxford_with >= 3", "oxford_with"),
    ("no-serial-comma", "oxford_with = 0 AND oxford_without >= 3", "oxford_without"), ("sentence-cap", f"sentences >= {LEAST_OF_CAP}", _CAP), *((n, f"{n.replace('-', '_')} = 0", "0") for n in FAMILIES),
]
_LEADING = [r for r in CORE if r.engine == "leading"]
_HEADS = " UNION ALL ".join(f"SELECT doc_id, start, {quoted(r.id)} AS rule_id, {({'error': 5, 'warning': 3, 'suggestion': 1}[r.severity] if r.intent == 'detection' else 0)} AS points FROM sents WHERE regexp_matches(text, {quoted('(?i)^(?:' + '|'.join(f'(?:{p})' for p, _ in r.pairs()) + ')')})" for r in _LEADING)


def _by_metric(name: str, value: str, enough: str) -> str:
    """A document rule: where its measure crosses its threshold, a finding at the first sentence."""
    r = _RULES[name]
    sign = ">" if r.direction == "above" else "<"
    return f"""{_METRICS}, f AS (SELECT doc_id, start, stop, {quoted(r.says())} || ' (' || printf('%.2f', {value}) || ', threshold {r.threshold:.2f})' AS message FROM sums JOIN sents USING (doc_id) WHERE k = 1 AND {enough} AND {value} {sign} {float(r.threshold)}), {_PLACED}"""


SENTENCE_SQL = {
    "sentence_metrics": f"""{_METRICS} SELECT doc_id, coalesce(m, 0)::INT AS n_sentences, coalesce(cited, 0)::INT AS n_citations, CASE WHEN m >= {LEAST_SENTENCES} THEN round(square / m, 6) END AS variance,
        CASE WHEN m >= {LEAST_SENTENCES} AND square > 0 THEN round(lag / square, 6) END AS autocorrelation, CASE WHEN m >= {LEAST_SENTENCES} AND beside > 0 THEN round(same / beside, 6) END AS opener_density,
        CASE WHEN words >= {LEAST_WORDS} THEN round(triads / words * 1000, 6) END AS triads, CASE WHEN words >= {LEAST_WORDS} THEN round(pairs / words * 1000, 6) END AS pairs
        FROM docs LEFT JOIN sums USING (doc_id) LEFT JOIN runs USING (doc_id)""",
    "corpus_stats": f"{_STATS} SELECT * FROM stats",
    "absences": f"{_STATS} " + " UNION ALL ".join(f"SELECT {quoted(n)} AS name, words >= {LEAST_CORPUS} AND {a} AS applies, ({v})::BIGINT AS value FROM stats" for n, a, v in _ABSENT),
    "top_openers": f"{SENTENCES} SELECT opener, count(*)::BIGINT AS n FROM sents WHERE NOT cited AND opener IS NOT NULL GROUP BY opener ORDER BY n DESC, opener LIMIT 5",
    "long_sentences": f"{SENTENCES}, f AS (SELECT doc_id, start, stop, {quoted(_RULES['sentence-length'].says())} AS message FROM sents WHERE n > {_RULES['sentence-length'].max_words}), {_PLACED}",
    "uniform_rhythm": _by_metric("uniform-sentence-rhythm", "square / m", f"m >= {LEAST_SENTENCES}"),
    "triad_overuse": _by_metric("triad-overuse", "triads / words * 1000", f"words >= {LEAST_WORDS}"),
    "opener_runs": f"""{SENTENCES}, turns AS (SELECT *, (opener IS NULL OR opener IS DISTINCT FROM lag(opener) OVER w OR b <> lag(b) OVER w)::INT AS new FROM sents WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
        islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM turns), numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY k) AS nth FROM islands),
        f AS (SELECT doc_id, start, stop, {quoted(_RULES['no-repetitive-openers'].says())} AS message FROM numbered WHERE opener IS NOT NULL AND nth % {_RULES['no-repetitive-openers'].run_length} = 0), {_PLACED}""",
    "leading_hits": f"""{SENTENCES}, f AS ({_HEADS}), lines AS (SELECT f.*, regexp_extract(substring(text, 1, start), '[^\\n]*$') || split_part(substring(text, start + 1), chr(10), 1) AS whole FROM f JOIN lint USING (doc_id)),
        found AS (SELECT doc_id, count(*)::INT AS n_findings, sum(points)::DOUBLE AS penalty, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS fired FROM lines WHERE NOT regexp_matches(whole, '{_DIRECTIVE}') GROUP BY doc_id),
        counts AS (SELECT doc_id, count(*)::INT AS sentence_count FROM sents GROUP BY doc_id)
        SELECT doc_id, word_count::INT AS word_count, coalesce(sentence_count, 0)::INT AS sentence_count, coalesce(n_findings, 0)::INT AS n_findings, coalesce(penalty, 0)::DOUBLE AS penalty,
        least(100, greatest(0, round(100 * exp(-(coalesce(penalty, 0) / greatest(word_count, 1) * 1000) / 100))))::INT AS score, coalesce(fired, '') AS fired_rules FROM docs LEFT JOIN found USING (doc_id) LEFT JOIN counts USING (doc_id)""",
}
