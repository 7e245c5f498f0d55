"""The corpus as parts of Word documents: `lint_corpus` with each text in paragraphs and runs.

A run holds up to five words; line ends and tabs stand in runs of their own. Of seven in a row one
is bold, one lies in a revision of somebody else, and one holds more than its text.
The same cutting exists for Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.review import NAMESPACE, escaped
from .lint_corpus import lint_corpus

TOKEN = r"\n\n|\n|\t|(?:[^\n\t ]+ *){1,5}| +"
BOLD, REVISED, MIXED = 0, 3, 5


def word_xml(text: Column) -> Column:
    """A document part whose projection is the text and a blank line."""

    def one(t: Column, i: Column) -> Column:
        kind = F.pmod(i, F.lit(7))
        said = F.concat(F.lit('<w:t xml:space="preserve">'), escaped(t), F.lit("</w:t>"))
        run = lambda *parts: F.concat(F.lit("<w:r>"), *parts, F.lit("</w:r>"))
        revised = F.concat(F.lit('<w:ins w:id="'), i.cast("string"), F.lit('" w:author="somebody">'), run(said), F.lit("</w:ins>"))
        written = F.when(kind == BOLD, run(F.lit("<w:rPr><w:b/></w:rPr>"), said)).when(kind == REVISED, revised).when(kind == MIXED, run(F.lit("<w:lastRenderedPageBreak/>"), said)).otherwise(run(said))
        return F.when(t == "\n\n", "</w:p><w:p>").when(t == "\n", run(F.lit("<w:br/>"))).when(t == "\t", run(F.lit("<w:tab/>"))).otherwise(written)

    body = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), one), "")
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{NAMESPACE}"><w:body><w:p>'), body, F.lit("</w:p></w:body></w:document>"))


def word_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, xml."""
    return lint_corpus(spark, sf_dir).select("doc_id", word_xml(F.col("text")).alias("xml"))


def word_sql(findings: str) -> str:
    """A WITH clause (recursive) over `findings`: `word_runs` (doc_id, run, s, e, open) and `word_edits` (doc_id, id, start, stop, replacement, kind, a, b)."""
    return f"""{findings.replace("WITH ", "WITH RECURSIVE ", 1)},
tokens_ AS (SELECT doc_id, regexp_extract_all(text, '{TOKEN.replace(chr(92) + "n", chr(10)).replace(chr(92) + "t", chr(9))}') AS ts FROM lint),
cut_ AS (SELECT doc_id, ts[i] AS t, i, sum(length(ts[i])) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM tokens_)),
word_runs AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS run, (e - length(t))::BIGINT AS s, e::BIGINT AS e, (i - 1) % 7 NOT IN ({REVISED}, {MIXED}) AS open FROM cut_ WHERE t[1] NOT IN (chr(10), chr(9))),
word_wanted AS (SELECT f.doc_id, f.start, f.stop, f.replacement, a.run AS a, b.run AS b, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.replacement IS NULL, f.start, f.stop, f.rule_ix, f.part_ix) AS k
    FROM found f LEFT JOIN word_runs a ON a.doc_id = f.doc_id AND a.s <= f.start AND f.start < a.e LEFT JOIN word_runs b ON b.doc_id = f.doc_id AND b.s < f.stop AND f.stop <= b.e),
word_placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS id FROM word_wanted WHERE a IS NOT NULL AND b IS NOT NULL),
word_chosen AS (SELECT doc_id, id, 0::BIGINT AS guard, FALSE AS wins FROM (SELECT DISTINCT doc_id, 0::BIGINT AS id FROM word_placed)
    UNION ALL SELECT p.doc_id, p.id, CASE WHEN p.replacement IS NOT NULL AND p.a = p.b AND p.start >= c.guard THEN p.stop ELSE c.guard END, p.replacement IS NOT NULL AND p.a = p.b AND p.start >= c.guard FROM word_chosen c JOIN word_placed p ON p.doc_id = c.doc_id AND p.id = c.id + 1),
word_edits AS (SELECT p.*, CASE WHEN c.wins THEN 'redline' WHEN a = b THEN 'comment' ELSE 'split' END AS kind FROM word_placed p JOIN word_chosen c ON c.doc_id = p.doc_id AND c.id = p.id)"""


def edit_sql(findings: str) -> str:
    return f"""{word_sql(findings)} SELECT doc_id, id::INT AS id, kind, start::INT AS start, stop::INT AS "end", a::INT AS first_run, b::INT AS last_run, CASE WHEN kind = 'redline' THEN replacement END AS replacement FROM word_edits"""


def review_sql(findings: str) -> str:
    return f"""{word_sql(findings)},
word_made AS (SELECT e.*, x.open AND y.open AS open FROM word_edits e JOIN word_runs x ON x.doc_id = e.doc_id AND x.run = a JOIN word_runs y ON y.doc_id = e.doc_id AND y.run = b),
lines_ AS (SELECT m.doc_id, start, substring(text, coalesce(lag(stop) OVER w, 0)::BIGINT + 1, (start - coalesce(lag(stop) OVER w, 0))::BIGINT) || replacement AS said, stop FROM word_made m JOIN lint USING (doc_id) WHERE open AND kind = 'redline' WINDOW w AS (PARTITION BY m.doc_id ORDER BY start)),
new_ AS (SELECT doc_id, string_agg(said, '' ORDER BY start) AS said, max(stop) AS stop FROM lines_ GROUP BY doc_id),
counts_ AS (SELECT doc_id, count_if(open AND kind = 'redline') AS applied, count_if(open AND kind <> 'redline') AS annotated, count_if(NOT open) AS void FROM word_made GROUP BY doc_id),
lost_ AS (SELECT doc_id, count_if(a IS NULL OR b IS NULL) AS n FROM word_wanted GROUP BY doc_id)
SELECT doc_id, coalesce(applied, 0)::INT AS applied, coalesce(annotated, 0)::INT AS annotated, (coalesce(void, 0) + coalesce(n, 0))::INT AS skipped, md5(coalesce(said, '') || substring(text, coalesce(stop, 0)::BIGINT + 1) || chr(10) || chr(10)) AS accepted_md5, md5(text || chr(10) || chr(10)) AS rejected_md5
FROM lint LEFT JOIN counts_ USING (doc_id) LEFT JOIN lost_ USING (doc_id) LEFT JOIN new_ USING (doc_id)"""
