"""The corpus as files in folders by language and source, with configurations in some of them, and the SQL of what holds where."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lint_corpus import lint_corpus, quoted

USER = {"severity": {"prefer-short-words": "error"}, "thresholds": {"no-empty-emphasis": 1.0}}
ROOT = {"disable": ["no-semicolons", "no such rule"], "severity": {"core/no-hedging": "error"}}
LANGUAGE = {"thresholds": {"no-hedging": 2.0, "no-passive-overuse": 0.5}, "severity": {"prefer-short-words": "suggestion"}, "disable": ["no-ai-cliches"]}
SOURCE = {"enable": ["no-semicolons", "no-hedging", "core/prefer-concise-phrases", "no-marketing-language"], "severity": {"no-semicolons": "info"}}


def place_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their path, and configuration files (path, content)."""
    docs = lint_corpus(spark, sf_dir)
    folder = F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source")
    docs = docs.withColumn("path", F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    held = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source").distinct()
    file = lambda path, options: F.struct(path.alias("path"), F.lit(json.dumps(options)).alias("content"))
    own = held.where(F.col("source").rlike("[02468]$")).select(F.inline(F.array(file(F.concat(folder, F.lit("/.prose/config.json")), SOURCE), file(F.concat(folder, F.lit("/prose.config.json")), ROOT))))
    language = held.where("lang <> 'de'").select("lang").distinct().select(F.inline(F.array(file(F.concat(F.lit("/corpus/"), "lang", F.lit("/prose.config.json")), LANGUAGE))))
    root = held.limit(1).select(F.inline(F.array(file(F.lit("/corpus/.prose/config.json"), ROOT), file(F.lit("/corpus/en/config.json"), SOURCE))))
    return docs, own.unionByName(language).unionByName(root)


def place_sql(parsed: str, rows: str) -> str:
    """`parsed`: a WITH clause with `parsed` (doc_id, lang, source, word_count); `rows`: hits by rule (doc_id, rule_id, engine, intent, points, thr, w, n)."""
    points = {"error": 5, "warning": 3, "suggestion": 1, "info": 1}

    def by_level(default: str, of, name: str) -> str:
        """A CASE over levels and rules of what the layers say."""
        layers = {0: [USER], 1: [USER, ROOT], 2: [USER, LANGUAGE], 3: [USER, SOURCE]}
        cases = []
        for level, stack in layers.items():
            merged = {}
            for layer in stack:
                merged |= {("core/" + k.removeprefix("core/")): v for k, v in layer.get(name, {}).items()}
            cases += [f"WHEN level = {level} AND rule_id = {quoted(k)} THEN {of(v)}" for k, v in merged.items()]
        return f"CASE {' '.join(cases)} ELSE {default} END"

    off = lambda layer: ", ".join(quoted("core/" + x.removeprefix("core/")) for x in layer["disable"])
    on = ", ".join(quoted("core/" + x.removeprefix("core/")) for x in SOURCE["enable"])
    return f"""{parsed}, hits AS ({rows}),
placed AS (SELECT doc_id, CASE WHEN regexp_matches(source, '[02468]$') THEN 3 WHEN lang <> 'de' THEN 2 ELSE 1 END AS level FROM parsed),
own AS (SELECT * REPLACE ({by_level("thr", float, "thresholds")}::DOUBLE AS thr, {by_level("points", points.get, "severity")} AS points) FROM hits JOIN placed USING (doc_id)
    WHERE CASE level WHEN 3 THEN rule_id IN ({on}) WHEN 2 THEN rule_id NOT IN ({off(LANGUAGE)}) ELSE rule_id NOT IN ({off(ROOT)}) END),
fired AS (SELECT *, CASE WHEN engine = 'density' THEN greatest(1, ceil(n - thr * w / 1000))::BIGINT ELSE n END AS weight FROM own WHERE n > 0 AND (engine = 'phrase' OR n / w * 1000 > thr)),
sums AS (SELECT doc_id, sum(CASE WHEN intent = 'detection' THEN points * weight ELSE 0 END)::DOUBLE AS penalty, string_agg(rule_id, ',' ORDER BY rule_id) AS fired FROM fired GROUP BY doc_id)
SELECT doc_id, level::INT AS level, coalesce(penalty, 0)::DOUBLE AS penalty, least(100, greatest(0, round(100 * exp(-(coalesce(penalty, 0) / greatest(word_count, 1) * 1000) / 100))))::INT AS score, coalesce(fired, '') AS fired_rules FROM parsed JOIN placed USING (doc_id) LEFT JOIN sums USING (doc_id)"""
