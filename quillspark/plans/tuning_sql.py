"""SQL of thresholds tried on labelled samples: every pair of a machine-written and a human text is compared."""

from __future__ import annotations

from ..operators.evaluate import POINTS


def _samples(scores: str, metrics: str) -> str:
    return f"""WITH samples AS (SELECT s.penalty, s.word_count AS words, s.lang = 'en' AS in_slice, CASE WHEN quality = 1 THEN 'human' ELSE 'ai' END AS label, variance, triads FROM ({scores}) s JOIN ({metrics}) USING (doc_id) JOIN labels USING (doc_id))"""


def _measured(by: str) -> str:
    """AUC over all pairs, from `tried` (by, label, in_slice, penalty, words, extra, fired)."""
    win = "CASE WHEN a.score < h.score THEN 1.0 WHEN a.score = h.score THEN 0.5 ELSE 0 END"
    return f"""scored AS (SELECT *, least(100, greatest(0, round(100 * exp(-((penalty + extra) / greatest(words, 1) * 1000) / 100))))::INT AS score FROM tried),
measured AS (SELECT {by}, coalesce(sum({win}) / nullif(count(*), 0), 0)::DOUBLE AS auc, coalesce(sum(CASE WHEN a.in_slice THEN {win} END) / nullif(count_if(a.in_slice), 0), 0)::DOUBLE AS slice_auc FROM (SELECT * FROM scored WHERE label = 'ai') a JOIN (SELECT * FROM scored WHERE label = 'human') h USING ({by}) GROUP BY {by}),
fired_ AS (SELECT {by}, count_if(fired AND label = 'ai')::BIGINT AS fired_ai, count_if(fired AND label = 'human')::BIGINT AS fired_human FROM tried GROUP BY {by}),
done AS (SELECT * FROM measured JOIN fired_ USING ({by}))"""


def grid_sql(scores: str, metrics: str, top: int = 6) -> str:
    return f"""{_samples(scores, metrics)}, vals AS (SELECT variance AS v, row_number() OVER (ORDER BY variance) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT variance FROM samples WHERE variance IS NOT NULL)),
grid AS (SELECT DISTINCT v AS value, direction FROM vals, (SELECT unnest(range(1, 100)) / 100 AS share), (VALUES ('above'), ('below')) AS d(direction) WHERE k = round((m - 1) * share)::BIGINT),
flags AS (SELECT s.*, value, direction, coalesce(CASE WHEN direction = 'above' THEN variance > value ELSE variance < value END, FALSE) AS fired FROM samples s, grid), tried AS (SELECT *, CASE WHEN fired THEN {POINTS} ELSE 0 END AS extra FROM flags),
{_measured("value, direction")},
first_ AS (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY auc, direction ORDER BY value) = 1)
SELECT value, direction, round(auc, 6) AS auc, round(slice_auc, 6) AS slice_auc, fired_ai, fired_human FROM first_ ORDER BY first_.auc DESC, direction, value LIMIT {top}"""


def checks_sql(scores: str, metrics: str, checks: list[tuple[str, str, float]]) -> str:
    hit = lambda m, d, t: f"coalesce({m} {'>' if d == 'above' else '<'} {t}, FALSE)"
    each = [("base", "0", "FALSE"), ("always", str(POINTS), "TRUE"), *((f"{m} {d} {t:g}", f"{POINTS} * {hit(m, d, t)}::INT", hit(m, d, t)) for m, d, t in checks)]
    each.append(("combined", " + ".join(e for _, e, _ in each[2:]), " OR ".join(f for _, _, f in each[2:])))
    tried = " UNION ALL ".join(f"SELECT '{name}' AS \"check\", label, in_slice, penalty, words, {extra} AS extra, {fired} AS fired FROM samples" for name, extra, fired in each)
    return f"""{_samples(scores, metrics)}, tried AS ({tried}), {_measured('"check"')}
SELECT "check", round(auc, 6) AS auc, round(slice_auc, 6) AS slice_auc, round(auc - (SELECT auc FROM done WHERE "check" = 'base'), 6) AS gain, fired_ai, fired_human, round(coalesce(fired_ai / nullif(fired_ai + fired_human, 0), 0), 6)::DOUBLE AS "precision" FROM done"""
