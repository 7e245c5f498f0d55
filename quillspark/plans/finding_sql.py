"""SQL of the queries over all findings: every engine of the core rules, with directives."""

from __future__ import annotations

import hashlib

from ..operators.judge import CONTEXT_CHARS, VERSION
from ..operators.lint import LEAST_SENTENCES, LEAST_WORDS
from ..rules.model import Options, Rule, RuleSet
from .lint_corpus import quoted
from .sentence_sql import _BLANK, _METRICS, SENTENCES, W, _own

_POINTS = {"error": 5, "warning": 3, "suggestion": 1}


def _edges(pattern: str) -> str:
    """Patterns that begin at a word which may be any: the leftmost match begins at one without saying so."""
    return _own(pattern.replace(r"\b\w+(?:\s+\w+){0,3}", r"\w+(?:\s+\w+){0,3}"))


def _twice(pattern: str) -> tuple[str, str]:
    """A block and a pattern for counting: where words may hold letters that the dialect's own word edges do not know, edges are the characters beside them."""
    if r"(?:ed|en)\b" not in pattern:
        return "btext", _edges(pattern)
    beside = pattern.replace(r"(?:ed|en)\b", r"(?:ed|en)(?:[^\w]|$)").replace(r"(?i)\b(?:is|", r"(?i)(?:^|[^\w])(?:is|")
    return f"regexp_replace(btext, '([^{W[1:-1]}])', '\\1\\1', 'g')", _own(beside)


def _values(rules: list[Rule], all_: list[Rule], judged: dict[int, Rule]) -> str:
    rows = [f"({quoted(r.id)}, {ix}, {quoted(r.severity)}, {quoted(r.tier)}, {quoted(r.intent)}, {_POINTS[r.severity]}, {quoted(r.says())}, {float(r.threshold or 0)}::DOUBLE, {r.max_words})" for ix, r in [*((all_.index(r), r) for r in rules), *judged.items()]]
    return "(VALUES " + ", ".join(rows) + ") AS rules(rule_id, rule_ix, severity, tier, intent, points, says, thr, most)"


def findings(rules: RuleSet, options: Options = Options(), judged: dict[int, Rule] | None = None, spans: str = "") -> str:
    """A WITH clause whose last table, `found`, holds all findings that no directive turns off: doc_id, start, stop, rule_id, ..., weight, message, replacement, line.

    `spans` is SQL of further ones (doc_id, start, stop, rule_id, part_ix, weight, message, replacement) of the rules `judged` (by their places);
    directives then turn off these only."""
    judged = judged or {}
    off_for = "r.tier <> 'inferential' OR " if judged else ""
    chosen = [r for r in rules.chosen(options) if r.engine != "inferential"]
    each = []
    for r in chosen:
        for n, (p, fix) in enumerate(r.pairs()):
            if r.engine == "phrase":
                each.append(f"SELECT doc_id, bstart, {quoted(r.id)} AS rule_id, {n} AS part_ix, {quoted(fix) if fix else 'NULL::VARCHAR'} AS fix, regexp_extract_all(btext, {_edges(p)}) AS ms, regexp_split_to_array(btext, {_edges(p)}) AS ss FROM blocks WHERE regexp_matches(btext, {_edges(p)})")
    dense = []
    for r in chosen:
        if r.engine == "density":
            block, counted = _twice(r.pairs()[0][0])
            p = _edges(r.pairs()[0][0])
            dense.append(
                f"SELECT doc_id, {quoted(r.id)} AS rule_id, sum(len(regexp_extract_all({block}, {counted})))::BIGINT AS n, "
                f"arg_min(bstart + length(regexp_split_to_array(btext, {p})[1]) + CASE WHEN {'TRUE' if '(' in r.pairs()[0][0].replace('(?', '').replace(chr(92) + '(', '') else 'FALSE'} THEN strpos(regexp_extract(btext, {p}), regexp_extract(btext, {p}, 1)) - 1 ELSE 0 END, b) FILTER (regexp_matches(btext, {p})) AS start, "
                f"arg_min(length(regexp_extract(btext, {p}, {1 if '(' in r.pairs()[0][0].replace('(?', '').replace(chr(92) + '(', '') else 0})), b) FILTER (regexp_matches(btext, {p})) AS size FROM blocks GROUP BY doc_id"
            )
    heads = [f"SELECT doc_id, start, start + length(regexp_extract(text, {h})) AS stop, {quoted(r.id)} AS rule_id FROM sents WHERE regexp_matches(text, {h})" for r in chosen if r.engine == "leading" for h in [quoted("(?i)^(?:" + "|".join(f"(?:{p})" for p, _ in r.pairs()) + ")")]]
    measured = []
    for r in chosen:
        if r.metric == "sentence-length":
            measured.append(f"SELECT doc_id, start, stop, {quoted(r.id)} AS rule_id, {quoted(r.says())} AS message FROM sents WHERE n > {r.max_words}")
        elif r.metric == "repetitive-openers":
            measured.append(f"SELECT doc_id, start, stop, {quoted(r.id)}, {quoted(r.says())} FROM numbered WHERE opener IS NOT NULL AND nth % {r.run_length} = 0")
        elif r.engine == "statistical":
            value, enough = {"sentence-length-variance": ("square / m", f"m >= {LEAST_SENTENCES}"), "triad-density": ("triads / words * 1000", f"words >= {LEAST_WORDS}")}[r.metric]
            measured.append(f"SELECT doc_id, start, stop, {quoted(r.id)}, {quoted(r.says())} || ' (' || printf('%.2f', {value}) || ', threshold {r.threshold:.2f})' FROM sums JOIN sents USING (doc_id) WHERE k = 1 AND {enough} AND {value} {'>' if r.direction == 'above' else '<'} {float(r.threshold)}")
    contexts = " ".join(f"WHEN rule_id = {quoted(r.id)} THEN NOT regexp_matches(substring(d.text, greatest(1, start + 1 - {r.allow_context[1]}), stop - start + 2 * {r.allow_context[1]}), {_own(r.allow_context[0])})" for r in chosen if r.allow_context)
    names = ", ".join(f"({quoted(x)}, {quoted(r.id)})" for r in rules.rules for x in {r.id, r.name})
    return f"""{_METRICS},
rules AS (SELECT * FROM {_values(chosen, chosen, judged)}),
matched AS ({" UNION ALL ".join(each)}),
phrases AS (SELECT doc_id, rule_id, part_ix, fix, ms[i] AS m, bstart + list_sum(list_transform(ss[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM matched)),
rates AS ({" UNION ALL ".join(dense)}),
turns AS (SELECT *, (opener IS NULL OR opener IS DISTINCT FROM lag(opener) OVER w OR b <> lag(b) OVER w)::INT AS new FROM sents WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY k) AS nth FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM turns)),
spans AS (
    SELECT doc_id, start::BIGINT AS start, (start + length(m))::BIGINT AS stop, rule_id, part_ix, 1 AS weight, NULL AS message, CASE WHEN fix IS NULL THEN NULL WHEN length(letters) > 1 AND letters = upper(letters) THEN upper(fix) WHEN regexp_matches(letters, '^\\p{{Lu}}') THEN upper(fix[1]) || fix[2:] ELSE fix END AS replacement
        FROM (SELECT *, regexp_replace(m, '[^\\p{{L}}]', '', 'g') AS letters FROM phrases)
    UNION ALL SELECT doc_id, start::BIGINT, (start + size)::BIGINT, rule_id, 0, greatest(1, ceil(n - thr * greatest(word_count, 1) / 1000))::INT, says || ' (' || n || ' occurrences in ' || word_count || ' words)', NULL FROM rates JOIN docs USING (doc_id) JOIN rules USING (rule_id) WHERE n > 0 AND n / greatest(word_count, 1) * 1000 > thr
    UNION ALL SELECT doc_id, start, stop, rule_id, 0, 1, NULL, NULL FROM ({" UNION ALL ".join(heads) or "SELECT NULL::BIGINT AS doc_id, NULL::BIGINT AS start, NULL::BIGINT AS stop, NULL::VARCHAR AS rule_id WHERE FALSE"})
    UNION ALL SELECT doc_id, start, stop, rule_id, 0, 1, message, NULL FROM ({" UNION ALL ".join(measured) or "SELECT NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR WHERE FALSE"}) AS t(doc_id, start, stop, rule_id, message){f" UNION ALL ({spans})" if spans else ""}),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS said, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM lint WHERE regexp_matches(text, '(?i)prose-(?:disable|enable)')),
aliases(name, rule_id) AS (VALUES {names}),
told AS (SELECT *, CASE WHEN regexp_matches(said, '(?i)prose-disable-file') THEN 'disable-file' WHEN regexp_matches(said, '(?i)prose-disable-next-line') THEN 'disable-next-line' WHEN regexp_matches(said, '(?i)prose-disable') THEN 'disable' WHEN regexp_matches(said, '(?i)prose-enable') THEN 'enable' END AS keyword FROM lines),
asked AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(regexp_extract(said, '(?is)prose-' || keyword || '(.*)', 1), '-->|\\*/|,', ' ', 'g'), '[\\s\\p{{Z}}]+'), lambda w: w <> '') AS ws FROM told WHERE keyword IS NOT NULL),
orders AS (SELECT doc_id, line, keyword, len(ws) = 0 AS every, list_transform(ws, lambda w: lower(w)) AS ws FROM asked),
placed_ AS (SELECT s.*, d.text, length(substring(d.text, 1, start)) - length(replace(substring(d.text, 1, start), chr(10), '')) + 1 AS line FROM spans s JOIN lint d USING (doc_id) WHERE CASE {contexts or "WHEN FALSE THEN TRUE"} ELSE TRUE END),
meant AS (SELECT o.doc_id, o.line AS said_at, o.keyword, r.rule_id FROM orders o, rules r WHERE o.every OR exists(SELECT 1 FROM aliases x WHERE x.rule_id = r.rule_id AND list_contains(o.ws, lower(x.name)))),
found AS (SELECT p.*, r.* EXCLUDE (rule_id) FROM placed_ p JOIN rules r USING (rule_id)
    WHERE {off_for}(NOT exists(SELECT 1 FROM orders o WHERE o.doc_id = p.doc_id AND o.line = p.line)
    AND NOT exists(SELECT 1 FROM meant m WHERE m.doc_id = p.doc_id AND m.rule_id = p.rule_id AND m.keyword = 'disable-file')
    AND NOT exists(SELECT 1 FROM meant m WHERE m.doc_id = p.doc_id AND m.rule_id = p.rule_id AND m.keyword = 'disable-next-line' AND m.said_at < p.line AND NOT exists(SELECT 1 FROM lines l WHERE l.doc_id = p.doc_id AND l.line > m.said_at AND l.line < p.line AND regexp_matches(l.said, '[^\\s\\p{{Z}}]')))
    AND coalesce((SELECT arg_max(m.keyword, m.said_at) FROM meant m WHERE m.doc_id = p.doc_id AND m.rule_id = p.rule_id AND m.keyword IN ('disable', 'enable') AND m.said_at <= p.line), 'enable') = 'enable'))"""


def judged_sql(rules: RuleSet, options: Options, judged: dict[int, Rule], spans: str) -> str:
    """Judged findings among all: `spans` as for `findings`, confidences by their rules."""
    sure = f"CASE rule_id WHEN {quoted(list(judged.values())[0].id)} THEN 0.9 ELSE 0.7 END"
    return f"""{findings(rules, options, judged, spans)}, all_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop, rule_ix, part_ix) - 1 AS ord FROM found)
SELECT doc_id, ord::INT AS ord, rule_id, severity, start::INT AS start, stop::INT AS "end", line::INT AS line, {_column("start")} AS "column", message, {sure}::DOUBLE AS confidence FROM all_ WHERE tier = 'inferential'"""


def scores(rules: RuleSet, options: Options = Options(), keep: str = "doc_id") -> str:
    return f"""{findings(rules, options)}, totals AS (SELECT doc_id, count(*)::INT AS n_findings, sum(CASE WHEN intent = 'detection' THEN points * weight ELSE 0 END)::DOUBLE AS penalty, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS fired FROM found GROUP BY doc_id),
counts AS (SELECT doc_id, count(*)::INT AS sentence_count FROM sents GROUP BY doc_id)
SELECT {keep}, word_count::INT AS word_count, coalesce(sentence_count, 0)::INT AS sentence_count, coalesce(n_findings, 0)::INT AS n_findings, coalesce(penalty, 0)::DOUBLE AS penalty,
least(100, greatest(0, round(100 * exp(-(coalesce(penalty, 0) / greatest(word_count, 1) * 1000) / 100))))::INT AS score, coalesce(fired, '') AS fired_rules FROM docs LEFT JOIN totals USING (doc_id) LEFT JOIN counts USING (doc_id)"""


def _column(offset: str) -> str:
    head = f"regexp_extract(substring(text, 1, {offset}), '[^\\n]*$')"
    return f"(length({head}) + length(regexp_replace({head}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) + 1)::INT"


_WHOLE = "regexp_extract(substring(text, 1, start), '[^\\n]*$') || split_part(substring(text, start + 1), chr(10), 1)"
_EXCERPT = f"""regexp_replace(regexp_replace({_WHOLE}, {quoted("^" + _BLANK + "+")}, ''), {quoted(_BLANK + "+$")}, '')"""


def diagnostics(rules: RuleSet, options: Options = Options()) -> str:
    return f"""{findings(rules, options)} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start, stop, rule_ix, part_ix) - 1)::INT AS ord, rule_id, severity, tier, intent, start::INT AS start, stop::INT AS "end", coalesce(message, says) AS message, weight::INT AS weight, replacement,
line::INT AS line, {_column("start")} AS "column", (length(substring(text, 1, stop)) - length(replace(substring(text, 1, stop), chr(10), '')) + 1)::INT AS end_line, {_column("stop")} AS end_column,
{_EXCERPT} AS excerpt, NULL::DOUBLE AS confidence, CASE WHEN replacement IS NOT NULL THEN 'machine-applicable' END AS applicability FROM found"""


def finding_sql(core: RuleSet, some: Options, leading_max: int = 3) -> dict[str, str]:
    asked = [r for r in core.rules if r.engine == "inferential"]
    rubric = "\n\n".join(f"## {r.id}\n{r.rubric or r.says()}" for r in asked)
    tiers = ", ".join(f"({i}, {quoted(r.id)}, {quoted(r.tier)})" for i, r in enumerate(core.rules))
    return {
        "scores": scores(core, keep="doc_id, lang, source"),
        "some_disabled": scores(core, some),
        "all_diagnostics": diagnostics(core),
        "dash_context": f"""{findings(core)} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS ord, start::INT AS start, stop::INT AS "end", line::INT AS line, {_column("start")} AS "column", says AS message, {_EXCERPT} AS excerpt FROM found WHERE rule_id = 'core/no-en-dash'""",
        "self_firing": f"{findings(core)} SELECT rule_id, count(DISTINCT doc_id)::BIGINT AS n_docs FROM found WHERE rule_id IN ({', '.join(quoted(r.id) for r in core.rules if r.engine in ('phrase', 'leading'))}) GROUP BY rule_id",
        "judge_requests": f"""{SENTENCES.replace("WITH ", "WITH RECURSIVE ", 1)}, bs AS (SELECT doc_id, list(bstart ORDER BY b) AS starts, list(bstart + length(btext) ORDER BY b) AS stops FROM blocks GROUP BY doc_id),
            packed AS (SELECT doc_id, 1 AS i, 0 AS unit_ix, starts[1] AS start, stops[1] AS stop, stops[1] - starts[1] AS size, starts, stops FROM bs
            UNION ALL SELECT doc_id, i + 1, CASE WHEN size + stops[i + 1] - starts[i + 1] <= {CONTEXT_CHARS} THEN unit_ix ELSE unit_ix + 1 END, CASE WHEN size + stops[i + 1] - starts[i + 1] <= {CONTEXT_CHARS} THEN start ELSE starts[i + 1] END, stops[i + 1],
                CASE WHEN size + stops[i + 1] - starts[i + 1] <= {CONTEXT_CHARS} THEN size + stops[i + 1] - starts[i + 1] ELSE stops[i + 1] - starts[i + 1] END, starts, stops FROM packed WHERE i < len(starts)),
            chunks AS (SELECT doc_id, unit_ix, min(start) AS start, max(stop) AS stop FROM packed GROUP BY doc_id, unit_ix)
            SELECT doc_id, 'chunk' AS unit, unit_ix::INT AS unit_ix, start::INT AS start, stop::INT AS "end", sha256(substring(text, start::BIGINT + 1, (stop - start)::BIGINT) || {quoted(hashlib.sha256(rubric.encode()).hexdigest() + VERSION)}) || ':none' AS cache_key, {quoted(",".join(r.id for r in asked))} AS rules FROM chunks JOIN lint USING (doc_id)""",
        "fixed_texts": f"""{findings(core).replace("WITH ", "WITH RECURSIVE ", 1)}, edits AS (SELECT doc_id, list({{'a': start, 'b': stop, 'r': replacement}} ORDER BY start, stop, rule_ix, part_ix) AS es FROM found WHERE replacement IS NOT NULL GROUP BY doc_id),
            folded AS (SELECT doc_id, text, es, 0 AS i, 0::BIGINT AS pos, ''::VARCHAR AS out_, 0 AS n FROM lint LEFT JOIN edits USING (doc_id)
            UNION ALL SELECT doc_id, text, es, i + 1, CASE WHEN es[i + 1].a >= pos THEN es[i + 1].b ELSE pos END, CASE WHEN es[i + 1].a >= pos THEN out_ || substring(text, pos + 1, es[i + 1].a - pos) || es[i + 1].r ELSE out_ END, n + (es[i + 1].a >= pos)::INT FROM folded WHERE i < len(es))
            SELECT doc_id, out_ || substring(text, pos + 1) AS fixed_text, n::INT AS n_fixes FROM folded WHERE i = coalesce(len(es), 0)""",
        "exit_codes": f"{findings(core)} SELECT doc_id, CASE WHEN count_if(severity = 'error') > 0 OR count_if(severity = 'warning') > {leading_max} THEN 1 ELSE 0 END::INT AS exit_code FROM docs LEFT JOIN found USING (doc_id) GROUP BY doc_id",
        "rule_coverage": f"""{findings(core)}, every(ix, rule_id, tier) AS (VALUES {tiers}), counts AS (SELECT rule_id, count(*) AS n FROM found GROUP BY rule_id)
            SELECT tier, count(*)::BIGINT AS total, count_if(tier <> 'inferential')::BIGINT AS ran, coalesce(sum(n), 0)::BIGINT AS findings, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (tier = 'inferential'), '') AS skipped FROM every LEFT JOIN counts USING (rule_id) GROUP BY tier""",
    }
