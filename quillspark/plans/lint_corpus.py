"""The corpus that the registered queries work on: `documents`, each with a snippet chosen by its id.

The tables hold none of the words that lexical rules look for, so a snippet adds
some. The same expression exists for Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNIPPETS = (
    "",
    "\n\nWe utilize this In Order To delve into a TAPESTRY of results. It is powerful; due to the fact that it is robust. Numerous experts agree.",
    "\n\nPerhaps it is likely. Arguably, generally speaking, perhaps it could be said. Perhaps it was noted and perhaps it was changed. Very really.",
    "\n\nWe went home. We saw it. We left early.\n\n!!!\n\nThey ran. They hid. They won. They lost. They sat. They slept.",
    "\n\nSee Smith v. Jones, 12 F.3d 345. Mr. Brown agreed with No. 5 of the 3rd part.\n1. First entry here.\n(ii). Second entry there. The catch: none.",
    "\n\nprose-disable-next-line no-semicolons\n\nalpha; beta; gamma.\nprose-disable prefer-short-words\nWe commence; we purchase.\nprose-enable\nWe commence again.",
    "\n\nGrün 🙂 naïve: we utilize – once, pages 3–4, and a–b. Moreover, it is not only good but also cheap (as said), red, green, and blue.",
    "\n\nGreat question, it seems. In order to facilitate the majority of it, we are able to assist; one two three four five six seven eight nine ten one two three four five six seven eight nine ten one two three four five six seven eight nine ten one two three four five six.",
)


def spread(df: DataFrame) -> DataFrame:
    """A table that is small for the session's cores, dealt over all of them; any other as it is read.

    Rules cost far more than a shuffle of a small table that lies in one row group. The size
    is the one that the plan states; a large table is never shuffled."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if size < SPLIT * cores else df


SPLIT = 128 << 20


def lint_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, source."""
    snippet = F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.pmod("doc_id", F.lit(len(SNIPPETS))) + 1).cast("int"))
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), snippet).alias("text"), "lang", "source")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lint_sql() -> str:
    """The corpus as SQL, to stand in a WITH clause under the name `lint`."""
    cases = " ".join(f"WHEN {i} THEN {quoted(s)}" for i, s in enumerate(SNIPPETS))
    return f"lint AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % {len(SNIPPETS)} {cases} END AS text, lang, source FROM documents)"
