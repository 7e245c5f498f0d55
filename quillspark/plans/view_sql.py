"""SQL of tokens and of windows around findings."""

from __future__ import annotations

from ..operators.render import CLOSING, CONTEXT, LONGEST, OPENING, UNDERLINED
from ..rules.model import RuleSet
from .finding_sql import _column, findings
from .lint_corpus import quoted
from .sentence_sql import _BLANK, _NUMBER, _WORD, SENTENCES

_TOKEN = quoted(f"{_WORD}|{_NUMBER}|{_BLANK.replace('[', '[^')}")
TOKENS = f"""{SENTENCES}, met AS (SELECT doc_id, k, start, regexp_extract_all(text, {_TOKEN}) AS ms, regexp_split_to_array(text, {_TOKEN}) AS ss FROM sents),
each_ AS (SELECT doc_id, k, start, ms, ss, unnest(range(1, len(ms) + 1)) AS i FROM met),
at_ AS (SELECT doc_id, k, i, ms[i] AS t, start + sum(length(ss[i])) OVER w + coalesce(sum(length(ms[i])) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM each_ WINDOW w AS (PARTITION BY doc_id, k ORDER BY i))
SELECT doc_id, (k - 1)::INT AS sentence, (i - 1)::INT AS ord, CASE WHEN regexp_matches(t, '^\\p{{L}}') THEN 'word' WHEN regexp_matches(t, '^[0-9]') THEN 'number' ELSE 'punct' END AS kind, start::INT AS start, (start + length(t))::INT AS "end", t AS text FROM at_"""


def _reach(text: str, side: str) -> str:
    return f"{side}({text}, coalesce(list_min(list_filter(range(1, {CONTEXT} + 1), lambda k: strlen({side}({text}, k)) >= {CONTEXT})), length({text})))"


def window_sql(rules: RuleSet, more: str = "") -> str:
    edge = lambda at, t: f"regexp_matches({t}, {quoted(_BLANK + '$')})" if at == "end" else f"regexp_replace({t}, {quoted('^' + _BLANK + '+')}, '')"
    squashed = lambda t: f"regexp_replace({t}, {quoted(_BLANK + '+')}, ' ', 'g')"
    return f"""{findings(rules)}, cut_ AS (SELECT *, regexp_extract(substring(text, greatest(1, start - {CONTEXT})::BIGINT, least({CONTEXT + 1}, start)::BIGINT), '[^\\n]*$') AS first_,
    substring(text, start::BIGINT + 1, (stop - start)::BIGINT) AS match_, split_part(substring(text, stop::BIGINT + 1, {CONTEXT + 1}), chr(10), 1) AS last_ FROM found),
reached AS (SELECT *, {_reach("first_", "right")} AS left_, {_reach("last_", "left")} AS right_ FROM cut_),
worded AS (SELECT *, length(left_) < length(first_) AS more_left, length(right_) < length(last_) AS more_right,
    CASE WHEN length(left_) < length(first_) AND contains(left_, ' ') THEN substring(left_, strpos(left_, ' ') + 1) ELSE left_ END AS l, CASE WHEN length(right_) < length(last_) AND contains(right_, ' ') THEN regexp_replace(right_, '(?s) [^ ]*$', '') ELSE right_ END AS r FROM reached),
squashed AS (SELECT *, CASE WHEN {edge("end", "l")} THEN {edge("start", "match_")} ELSE match_ END AS m, CASE WHEN CASE WHEN match_ = '' THEN {edge("end", "l")} ELSE {edge("end", "match_")} END THEN {edge("start", "r")} ELSE r END AS r2 FROM worded),
shown AS (SELECT *, regexp_replace({squashed("l")}, '^ +', '') AS b, {squashed("m")} AS whole, regexp_replace({squashed("r2")}, ' +$', '') AS a FROM squashed),
ended AS (SELECT *, CASE WHEN length(whole) > {LONGEST} THEN left(whole, {LONGEST // 2}) || '…' || right(whole, {LONGEST - LONGEST // 2 - 1}) ELSE whole END AS s FROM shown)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start, stop, rule_ix, part_ix) - 1)::INT AS ord, rule_id, line::INT AS line, {_column("start")} AS "column", coalesce(message, says) AS message,
    CASE WHEN more_left THEN '…' ELSE '' END || b || s || a || CASE WHEN more_right THEN '…' ELSE '' END AS "window", CASE WHEN length(s) BETWEEN 1 AND {UNDERLINED} THEN repeat(' ', more_left::INT + length(b)) || repeat('^', length(s)) END AS caret{more} FROM ended"""


def listing_sql(rules: RuleSet) -> str:
    plural = lambda n, one: f"format('{{:,}}', {n}) || ' {one}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END"
    tiers = []
    for tier in ("static", "statistical", "inferential"):
        all_ = sum(r.tier == tier for r in rules.rules)
        run = f"0 of {all_} run" if tier == "inferential" else f"{all_} run"
        tiers.append(f"'{tier}: {run}, ' || {plural(f'coalesce(n_{tier}, 0)', 'finding')}")
    score = "least(100, greatest(0, round(100 * exp(-(coalesce(penalty, 0) / greatest(word_count, 1) * 1000) / 100))))::INT"
    return f"""WITH seen AS ({window_sql(rules, ", severity, tier, intent, points, weight, replacement")}), words_ AS ({SENTENCES} SELECT d.doc_id, word_count, coalesce(n, 0) AS n_sents FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM sents GROUP BY doc_id) USING (doc_id)),
sums AS (SELECT doc_id, count(*) AS n, count(replacement) AS fixes, {", ".join(f"count_if(tier = '{x}') AS n_{x}" for x in ("static", "statistical", "inferential"))}, sum(CASE WHEN intent = 'detection' THEN points * weight ELSE 0 END) AS penalty,
    string_agg(line || ':' || "column" || '  ' || severity || '  ' || message || '  ' || rule_id || chr(10) || '    ' || "window" || coalesce(chr(10) || '    ' || caret, ''), chr(10) ORDER BY ord) AS listing FROM seen GROUP BY doc_id)
SELECT doc_id, {plural("word_count", "word")} || ' · ' || {plural("n_sents", "sentence")} || chr(10) || {" || chr(10) || ".join(tiers)} || chr(10) || 'score ' || {score} || '/100 (without a judge)' || chr(10) ||
    CASE WHEN n IS NULL THEN 'No findings.' ELSE {plural("n", "finding")} || CASE WHEN fixes > 0 THEN ' · ' || format('{{:,}}', fixes) || ' with a fix' ELSE '' END END AS summary, coalesce(listing, 'No findings.') AS listing FROM words_ LEFT JOIN sums USING (doc_id)"""


def brief_sql(diagnostics: str) -> str:
    """`diagnostics`: SQL of all findings with their lines."""
    return f"""WITH found_ AS ({diagnostics}), rules_ AS (SELECT doc_id, rule_id, min(ord) AS first_, string_agg('- line ' || line || ': ' || excerpt || CASE WHEN replacement IS NOT NULL THEN ' -> ' || replacement ELSE '' END, chr(10) ORDER BY ord) AS said FROM found_ GROUP BY doc_id, rule_id)
SELECT doc_id, {quoted(OPENING)} || chr(10) || chr(10) || string_agg('## ' || rule_id || chr(10) || said, chr(10) || chr(10) ORDER BY first_) || chr(10) || chr(10) || {quoted(CLOSING)} AS brief FROM rules_ GROUP BY doc_id"""
