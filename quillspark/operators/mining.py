"""What a body of writing does and does not do: statistics, absences, samples, candidate rules."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import java, trimmed
from ..rules.model import Options, RuleSet
from ..rules.parts import held
from .evaluate import rule_tests
from .lint import find, parse

# Lists with and without a comma before the last member.
OXFORD_WITH = r"[A-Za-z][\w'’-]*,\s+(?:[A-Za-z][\w'’-]*\s+){0,3}[A-Za-z][\w'’-]*,\s+(?:and|or)\s+[A-Za-z]"
OXFORD_WITHOUT = r"[A-Za-z][\w'’-]*,\s+(?:[A-Za-z][\w'’-]*\s+){1,3}(?:and|or)\s+[A-Za-z]"
# Families of terms, each with its forms and what stands for them.
FAMILIES = {
    "no-utilize": {"utilize": "use", "utilizes": "uses", "utilized": "used", "utilizing": "using"},
    "no-in-order-to": {"in order to": "to"},
    "no-prior-to": {"prior to": "before"},
    "no-subsequent-to": {"subsequent to": "after"},
    "no-commence": {"commence": "begin", "commences": "begins", "commencing": "beginning"},
    "no-endeavor": {"endeavor": "try", "endeavors": "tries", "endeavoring": "trying"},
}
LEAST_WORDS, LEAST_SENTENCES = 300, 30


def family_pattern(name: str) -> str:
    return "|".join(rf"(?:\b{form}\b)" for form in FAMILIES[name])


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row over all documents: counts of words, sentences, marks and serial commas; lengths of sentences."""
    df = parse(docs).withColumn("prose", F.filter("sents", lambda s: ~s["is_citation"] & (s["n_words"] > 0)))
    t = F.col("__t")
    lengths = F.transform("prose", lambda s: s["n_words"].cast("long"))
    return df.select(
        F.regexp_count(t, F.lit(r"(?U)\S+")).alias("w"), F.size("prose").alias("s"), F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("l"), F.array_max(lengths).alias("m"),
        *((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).alias(n) for n, c in (("em", "—"), ("en", "–"), ("semi", ";"))),
        F.regexp_count(t, F.lit(r"(?Ud)" + OXFORD_WITH)).alias("ox1"), F.regexp_count(t, F.lit(r"(?Ud)" + OXFORD_WITHOUT)).alias("ox0"),
        *(F.regexp_count(t, F.lit(java(family_pattern(n)))).alias(f"t{i}") for i, n in enumerate(FAMILIES)),
    ).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("w"), F.lit(0)).alias("words"), F.coalesce(F.sum("s"), F.lit(0)).alias("sentences"), F.coalesce(F.sum("em"), F.lit(0)).alias("em_dashes"), F.coalesce(F.sum("en"), F.lit(0)).alias("en_dashes"),
        F.coalesce(F.sum("semi"), F.lit(0)).alias("semicolons"), F.coalesce(F.sum("ox1"), F.lit(0)).alias("oxford_with"), F.coalesce(F.sum("ox0"), F.lit(0)).alias("oxford_without"),
        F.coalesce(F.max("m"), F.lit(0)).alias("max_sentence"), F.coalesce(F.sum("l") / F.sum("s"), F.lit(0.0)).alias("mean_sentence"),
        *(F.coalesce(F.sum(f"t{i}"), F.lit(0)).alias(n.replace("-", "_")) for i, n in enumerate(FAMILIES)),
    )


def top_openers(docs: DataFrame, top: int = 5) -> DataFrame:
    """The words that begin the most sentences."""
    sents = parse(docs).select(F.explode("sents").alias("s")).where("not s.is_citation and s.opener is not null")
    return sents.groupBy(F.col("s.opener").alias("opener")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "opener").limit(top)


def absences(stats: DataFrame) -> DataFrame:
    """(name, applies, value) of what a large enough body of writing never does."""
    s = F.col
    enough = s("words") >= LEAST_WORDS
    cap = F.greatest(F.lit(30), F.ceil(s("max_sentence") * 1.2))
    rules = [
        ("no-em-dash", enough & (s("em_dashes") == 0), F.lit(0)), ("no-semicolon", enough & (s("semicolons") == 0), F.lit(0)),
        ("serial-comma", enough & (s("oxford_without") == 0) & (s("oxford_with") >= 3), s("oxford_with")), ("no-serial-comma", enough & (s("oxford_with") == 0) & (s("oxford_without") >= 3), s("oxford_without")),
        ("sentence-cap", enough & (s("sentences") >= LEAST_SENTENCES), cap),
        *((n, enough & (s(n.replace("-", "_")) == 0), F.lit(0)) for n in FAMILIES),
    ]
    every = F.array(*(F.struct(F.lit(n).alias("name"), a.alias("applies"), v.cast("long").alias("value")) for n, a, v in rules))
    return stats.select(F.inline(every))


def synthesized(docs: DataFrame, rules: list[tuple[str, str, str, str]], canonical: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(name, bad, good) for candidate rules (name, flags, seek, inject): `good` is the corpus' first sentence (by doc_id and place)
    of 20 to 160 bytes on one line that holds `seek` and that the rule's pattern `flags` not; `bad` is that sentence with the
    first `seek` replaced by `inject` (which may name groups), which the pattern must flag. A rule without such a sentence has its
    pair (bad, good) of `canonical`, or no row; with `canonical` a column `mined` tells which."""
    text = F.col("s.text")
    sents = parse(docs).select("doc_id", F.explode("sents").alias("s")).where(~F.col("s.is_citation") & F.octet_length(text).between(20, 160) & ~F.contains(text, F.lit("\n")))

    def seeks(flags: str, seek: str) -> Column:
        runs = [F.contains(text, F.lit(run)) for run in held(seek)]
        return reduce(or_, runs, F.lit(not runs)) & text.rlike(java(seek)) & ~text.rlike(java(flags))

    def one(name: str, flags: str, seek: str, inject: str) -> Column:
        at, found = F.length(F.split(text, java(seek), 2)[0]), F.regexp_extract(text, java(seek), 0)
        bad = F.concat(F.substr(text, F.lit(1), at), F.regexp_replace(found, java(seek), inject), F.substr(text, at + F.length(found) + 1))
        return F.when(bad.rlike(java(flags)), F.struct(F.lit(name).alias("name"), bad.alias("bad"), text.alias("good")))

    # few sentences hold what a rule seeks, and only those are rewritten, each for the rules that seek it
    sought = sents.select("doc_id", "s", F.explode(F.array_compact(F.array(*(F.when(seeks(*r[1:3]), F.lit(i)) for i, r in enumerate(rules))))).alias("rule"))
    made = reduce(lambda made, z: made.when(F.col("rule") == z[0], one(*z[1])), enumerate(rules), F)
    each = sought.select("doc_id", F.col("s.start").alias("start"), made.alias("e")).where("e is not null")
    first = each.groupBy("e.name").agg(F.min_by(F.struct("e.bad", "e.good"), F.struct("doc_id", "start")).alias("x")).select("name", "x.bad", "x.good")
    if canonical is None:
        return first
    known = docs.sparkSession.createDataFrame([(r[0], *canonical.get(r[0], (None, None))) for r in rules], "name string, bad0 string, good0 string")
    both = known.join(first, "name", "left").withColumn("mined", F.col("bad").isNotNull())
    return both.select("name", F.coalesce("bad", "bad0").alias("bad"), F.coalesce("good", "good0").alias("good"), "mined").where("bad is not null")


def family_seeks() -> list[tuple[str, str, str, str]]:
    """The term families as rules for `synthesized`."""
    return [(n, family_pattern(n), rf"\b{next(iter(forms.values()))}\b", next(iter(forms))) for n, forms in FAMILIES.items()]


def mark_seeks() -> list[tuple[str, str, str, str]]:
    """Rules about marks for `synthesized`, by the names of `absences`."""
    return [("no-em-dash", "—", ", ", "—"), ("no-semicolon", ";", ", ", "; "), ("serial-comma", OXFORD_WITHOUT, r", ([^,;]{1,40}), (and|or)\b", ", $1 $2"), ("no-serial-comma", OXFORD_WITH, r", ([^,;]{1,40}) (and|or)\b", ", $1, $2")]


def canonical_pairs() -> dict[str, tuple[str, str]]:
    """For each rule of `family_seeks` and `mark_seeks` a text that it flags and one that it leaves alone."""
    lists = ("They packed bread, cheese and figs.", "They packed bread, cheese, and figs.")
    marks = {"no-em-dash": ("The door—a red one—was shut.", "The door, a red one, was shut."), "no-semicolon": ("It rained; they stayed.", "It rained, so they stayed."), "serial-comma": lists, "no-serial-comma": lists[::-1]}
    said = "They plan {} the work by noon."
    return marks | {n: tuple(said.format(x) for x in next(iter(forms.items()))) for n, forms in FAMILIES.items()}


def sanitized(candidates: DataFrame) -> DataFrame:
    """Candidate rules (id, pattern, ...) with ids in kebab case and unique, without blank patterns: those that repeat an id get a number."""
    bare = F.trim(F.regexp_replace(F.lower("id"), "[^a-z0-9]+", "-"), F.lit("-"))
    named = candidates.where(F.coalesce("pattern", F.lit("")) != "").withColumn("id", F.when(bare == "", "rule").otherwise(bare))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("lens_ix", "ix"))
    return named.withColumn("__n", nth).withColumn("id", F.when(F.col("__n") > 1, F.concat_ws("-", "id", "__n")).otherwise(F.col("id"))).drop("__n")


MINED = "array<struct<id:string,engine:string,severity:string,description:string,mined_from:string,rationale:string,message:string,examples:array<struct<bad:string,good:string>>,patterns:array<string>>>"
#: Engines that a mined rule may have.
MINED_ENGINES = ("phrase", "leading")


def mined_candidates(answers: DataFrame, model: str = "none") -> DataFrame:
    """Candidate rules from answers (lens_ix, lens, answer) of a model that was asked for rules: lens_ix, ix, id, engine, severity, description,
    rationale, message, examples, patterns (without fixes), and `reason`, why one is refused (null: it is not).

    Ids are made kebab case; severities stay below an error; a description says where a rule comes from. Refused are other engines than
    `MINED_ENGINES`, rules without examples, description or pattern, and those with the id of an earlier one that is not refused."""
    inner = F.regexp_extract("answer", r"(?s)(\[.*\])", 1)
    df = answers.select("lens_ix", "lens", F.posexplode(F.from_json(inner, MINED)).alias("ix", "r")).select("lens_ix", "lens", "ix", "r.*")
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce("id", F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    said = F.regexp_replace(trimmed(F.coalesce("description", F.lit(""))), r"\.+\z", "")
    source = F.when(F.coalesce("mined_from", F.lit("")).rlike(r"(?U)\S"), trimmed(F.col("mined_from"))).otherwise("your corpus sample")
    # a pattern is a text, or an object with one
    patterns = F.filter(F.transform(F.coalesce("patterns", F.array().cast("array<string>")), lambda p: F.coalesce(F.get_json_object(p, "$.pattern"), p)), lambda p: p.rlike(r"\S"))
    engine = F.coalesce("engine", F.lit("phrase"))
    df = df.select(
        "lens_ix", "ix", F.when(bare == "", F.concat(F.lit("mined-"), (F.col("ix") + 1).cast("string"))).otherwise(bare).alias("id"), engine.alias("engine"),
        F.when(F.col("severity").isin("warning", "error"), "warning").otherwise("suggestion").alias("severity"),
        F.concat(said, F.lit(f" (mined by {model}, lens: "), F.coalesce("lens", F.lit("")), F.lit(", from "), source, F.lit(").")).alias("description"), "rationale", "message", "examples", patterns.alias("patterns"),
        F.when(~engine.isin(*MINED_ENGINES), F.concat(F.lit("engine "), engine, F.lit(" is not one of phrase and leading")))
        .when(F.coalesce(F.size("examples"), F.lit(0)) <= 0, "no examples").when(said == "", "no description").when(F.size(patterns) == 0, "no pattern").alias("reason"),
    )
    before = Window.partitionBy("id").orderBy("lens_ix", "ix").rowsBetween(Window.unboundedPreceding, -1)  # one name's candidates
    again = F.coalesce(F.max(F.col("reason").isNull()).over(before), F.lit(False))
    return df.withColumn("reason", F.coalesce("reason", F.when(again, "an id that is taken")))


def packed(parts: Column, size: Column | None = None, target: int = 2000, glue: str = "\n\n") -> Column:
    """Neighbouring parts joined greedily up to `target` bytes; no part is cut."""
    kind = "array<string>"

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce(F.octet_length(last) + len(glue) + F.octet_length(p) <= target, F.lit(False))
        return F.when(joins, F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.concat(last, F.lit(glue), p))).otherwise(F.array_append(acc, p)).cast(kind)

    return F.aggregate(parts, F.array().cast(kind), step)


def paragraph_chunks(docs: DataFrame, target: int = 2000) -> DataFrame:
    """doc_id, chunk_ix and chunk: paragraphs packed to about `target` bytes."""
    return docs.select("doc_id", F.posexplode(_packed_paragraphs(target)).alias("chunk_ix", "chunk"))


def _packed_paragraphs(target: int) -> Column:
    return packed(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n\n"), trimmed), lambda p: p != ""), target=target)


def spread_sample(docs: DataFrame, when: str, slots: int = 28, chars: int = 900, budget: int = 16_000) -> DataFrame:
    """Passages of the newest documents, spread evenly over each: first, middle, last of its chunks of `chars` bytes.

    With fewer documents than slots each gives several. The sample ends before the passage that would exceed
    `budget` bytes. A report: its size is the feature. docs: doc_id, text, and `when` to order by."""
    quota = max(1, -(-slots // max(1, docs.limit(slots).count())))
    some = docs.where(F.coalesce("text", F.lit("")).rlike(r"(?U)\S")).orderBy(F.desc(when), "doc_id").limit(slots)
    n, k = F.size("cs"), F.least(F.lit(quota), F.size("cs"))
    at = F.when(k == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * (n - 1) / (k - 1)).cast("int")))
    taken = some.select("doc_id", when, _packed_paragraphs(chars).alias("cs")).select("doc_id", when, "cs", F.posexplode(at).alias("slot", "ix"))
    cut = taken.select("doc_id", when, "slot", F.get("cs", F.col("ix")).alias("whole"))
    cut = cut.withColumn("passage", F.when(F.length("whole") > chars, F.concat(F.substring("whole", 1, chars), F.lit("…"))).otherwise(F.col("whole"))).drop("whole")
    order = Window.orderBy(F.desc(when), "doc_id", "slot").rowsBetween(Window.unboundedPreceding, 0)  # at most slots documents, some passages each
    running = cut.withColumns({"running": F.sum(F.octet_length("passage")).over(order), "nth": F.count(F.lit(1)).over(order)})
    return running.where((F.col("running") <= budget) & (F.col("nth") <= slots)).drop("nth")


def consistent(candidates: RuleSet, docs: DataFrame) -> DataFrame:
    """(rule_id, ok) of candidate rules: those that fire nowhere in the writing, and whose examples hold."""
    spark = docs.sparkSession
    fired = self_firing_chunks(docs, candidates).select("rule_id", F.lit(True).alias("fires"))
    wrong = rule_tests(spark, candidates).where("not ok").select("rule_id", F.lit(True).alias("wrong")).distinct()
    every = spark.createDataFrame([(r.id,) for r in candidates.rules], "rule_id string")
    df = every.join(fired, "rule_id", "left").join(wrong, "rule_id", "left")
    return df.select("rule_id", (F.col("fires").isNull() & F.col("wrong").isNull()).alias("ok"))


def recency_sample(docs: DataFrame, when: str, slots: int = 28, chars: int = 900, budget: int = 16_000) -> DataFrame:
    """At most `slots` passages of the newest documents, cut to `chars` characters, while they stay inside `budget` bytes.
    A report: its size is the feature. docs: doc_id, text, and `when` to order by."""
    some = docs.where(F.coalesce("text", F.lit("")) != "").orderBy(F.desc(when), "doc_id").limit(slots)
    cut = some.select("doc_id", when, F.substring("text", 1, chars).alias("passage"))
    running = F.sum(F.octet_length("passage")).over(Window.orderBy(F.desc(when), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # `slots` rows
    return cut.withColumn("running", running).where(F.col("running") <= budget)


def first_of_each(candidates: DataFrame) -> DataFrame:
    """Of candidate rules (lens_ix, ix, pattern) with one pattern, whatever its case, the first stays."""
    first = Window.partitionBy(F.lower("pattern")).orderBy("lens_ix", "ix")
    return candidates.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def self_firing(docs: DataFrame, rules: RuleSet) -> DataFrame:
    """Candidate rules that fire on the writing they are mined from, with how many documents they hit."""
    fired = find(docs, rules, Options()).select(F.explode(F.array_distinct(F.transform("findings", lambda f: f["rule_id"]))).alias("rule_id"))
    return fired.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_docs"))


def self_firing_chunks(docs: DataFrame, rules: RuleSet, options: Options = Options(), target: int = 2000) -> DataFrame:
    """Candidate rules that fire on passages of the writing they are mined from: rule_id, how many passages (paragraphs packed to about `target`
    bytes) they hit, and the first of these (doc_id, chunk_ix)."""
    chunks = paragraph_chunks(docs, target).select("doc_id", "chunk_ix", F.col("chunk").alias("text"))
    fired = find(chunks, rules, options).select("doc_id", "chunk_ix", F.explode(F.array_distinct(F.transform("findings", lambda f: f["rule_id"]))).alias("rule_id"))
    return fired.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.min(F.struct("doc_id", "chunk_ix")).alias("x")).select("rule_id", "n_chunks", F.col("x.doc_id").alias("first_doc"), F.col("x.chunk_ix").alias("first_chunk"))
