"""SQL of examples that are mined from sentences."""

from __future__ import annotations

from .lint_corpus import quoted
from .sentence_sql import SENTENCES, _own


def _mined(rules: list[tuple[str, str, str, str]]) -> str:
    each = []
    for name, flags, seek, inject in rules:
        bad = f"regexp_replace(text, {_own(seek)}, {quoted(inject.replace('$', chr(92)))})"
        each.append(f"SELECT {quoted(name)} AS name, arg_min({bad}, k2) AS bad, arg_min(text, k2) AS good FROM short_ WHERE NOT regexp_matches(text, {_own(flags)}) AND regexp_matches(text, {_own(seek)}) AND regexp_matches({bad}, {_own(flags)}) HAVING count(*) > 0")
    return f"""{SENTENCES}, short_ AS (SELECT *, row_number() OVER (ORDER BY doc_id, start) AS k2 FROM sents WHERE NOT cited AND strlen(text) BETWEEN 20 AND 160 AND NOT contains(text, chr(10))), mined_ AS ({" UNION ALL ".join(each)})"""


def example_sql(families: list[tuple[str, str, str, str]], marks: list[tuple[str, str, str, str]], canonical: dict[str, tuple[str, str]]) -> dict[str, str]:
    known = ", ".join(f"({', '.join(map(quoted, (r[0], *canonical[r[0]])))})" for r in families + marks)
    return {
        "mined_examples": f"{_mined(families)} SELECT * FROM mined_",
        "mined_pairs": f"{_mined(families + marks)} SELECT c.name, coalesce(m.bad, c.bad) AS bad, coalesce(m.good, c.good) AS good, m.bad IS NOT NULL AS mined FROM (VALUES {known}) AS c(name, bad, good) LEFT JOIN mined_ m USING (name)",
    }
