"""Rules over documents: findings, their positions, and a score.

Everything about a document stays in its row: blocks, sentences and findings
are arrays, and a chain of projections computes them without a shuffle. What
later expressions use more than once is computed once, behind a generator.

Patterns are data, not expressions: one literal array holds them, a document's
lower case tells by plain searches which of them may match at all, and the one
expression that matches a pattern runs over those. A plan's size does not depend
on the number of rules.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import PROSE, markdown_blocks
from ..functions.sentences import sentences
from ..functions.text import blocks, extract, java, kept, let, match_spans, matches, offsets, once, over, trimmed, word_count
from ..rules.core import CORE
from ..rules.model import MACHINE, MAYBE, Options, Rule, RuleSet
from ..rules.parts import as_literal, candidates, counting, folded, keywords, parts
from .suppression import allowed

FINDING = "array<struct<start:int,end:int,rule_ix:int,part_ix:int,rule_id:string,severity:string,tier:string,intent:string,message:string,weight:int,replacement:string,confidence:double>>"
# Shapes that two document metrics count.
TRIAD = r"(?i)\b\w+(?:\s+\w+){0,3},\s+\w+(?:\s+\w+){0,3},\s+and\s+\w+"
PAIR = r"\b[a-z][a-z'’-]{2,}\s+and\s+[a-z][a-z'’-]{2,}\b"
LEAST_SENTENCES, LEAST_WORDS = 8, 50


def core_rules() -> RuleSet:
    return RuleSet(CORE)


@kept
def _all_blocks(markdown: str | None) -> Column:
    plain = F.transform(blocks(F.col("__t")), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["text"].alias("text"), F.lit("paragraph").alias("kind")))
    if markdown is None:
        return plain
    cut = lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.substr(F.col("__t"), b["start"] + 1, b["end"] - b["start"]).alias("text"), b["kind"].alias("kind"))
    return F.when(F.coalesce(F.col(markdown), F.lit(False)), F.transform(markdown_blocks(F.col("__t")), cut)).otherwise(plain)


@kept
def _all_sentences() -> Column:
    def of(b: Column, i: Column) -> Column:
        return F.transform(
            sentences(b["text"]),
            lambda s: F.struct((s["start"] + b["start"]).alias("start"), (s["end"] + b["start"]).alias("end"), s["text"].alias("text"), s["n_words"].alias("n_words"), s["opener"].alias("opener"), s["is_citation"].alias("is_citation"), (~s["is_citation"] & b["kind"].isin(*PROSE)).alias("prose"), i.alias("block_ix")),
        )

    return F.flatten(F.transform("blocks", lambda b, i: F.when(b["kind"] != "code", of(b, i)).otherwise(F.array())))


def parse(docs: DataFrame, text: str = "text", sentences_too: bool = True, words_too: bool = True) -> DataFrame:
    """Adds `words`, `blocks` and `sents` (of all blocks but code, with offsets in the document and block_ix).

    Where `docs` has a column `markdown`, texts for which it is true are read as Markdown."""
    markdown = "markdown" if "markdown" in docs.columns else None
    df = once(docs.withColumn("__t", F.coalesce(F.col(text), F.lit(""))), **({"words": word_count(F.col("__t"))} if words_too else {}), blocks=_all_blocks(markdown))
    if markdown and words_too:  # words of code do not count
        df = df.withColumn("words", F.col("words") - F.aggregate("blocks", F.lit(0), lambda acc, b: acc + F.when(b["kind"] == "code", word_count(b["text"])).otherwise(0)))
    if not sentences_too:
        return df

    return once(df, sents=_all_sentences())


def _row(start: Column, end: Column, rule_ix: Column, part_ix: Column, rule_id: Column, severity: Column, tier: Column, intent: Column, message: Column, weight: Column | None = None, replacement: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), rule_ix.cast("int").alias("rule_ix"), part_ix.cast("int").alias("part_ix"), rule_id.alias("rule_id"), severity.alias("severity"), tier.alias("tier"),
        intent.alias("intent"), message.alias("message"), (F.lit(1) if weight is None else weight).cast("int").alias("weight"), (none if replacement is None else replacement).alias("replacement"), F.lit(None).cast("double").alias("confidence"),
    )


def _finding(rule: Rule, ix: int, span: Column, message: Column | None = None) -> Column:
    return _row(span["start"], span["end"], F.lit(ix), F.lit(0), F.lit(rule.id), F.lit(rule.severity), F.lit(rule.tier), F.lit(rule.intent), F.lit(rule.says()) if message is None else message)


def _of_part(p: Column, span: Column, message: Column | None = None, weight: Column | None = None, replacement: Column | None = None) -> Column:
    return _row(span["start"], span["end"], p["rule_ix"], p["part_ix"], p["rule_id"], p["severity"], p["tier"], p["intent"], p["message"] if message is None else message, weight, replacement)


def _cased(found: Column, fix: Column) -> Column:
    """The replacement in the case of what it replaces."""
    letters = F.regexp_replace(found, r"\P{IsAlphabetic}", "")
    upper = (F.length(letters) > 1) & (letters == F.upper(letters)) & ~letters.rlike(r"\p{IsLowercase}")
    first = F.concat(F.upper(F.substring(fix, 1, 1)), F.substr(fix, F.lit(2)))
    return F.when(upper, F.upper(fix)).when(letters.rlike(r"^\p{IsUppercase}"), first).otherwise(fix)


def _replacement(p: Column, found: Column) -> Column:
    """What takes the place of a match: a template with its groups, or a literal in the case of the match."""
    # a template without a group is literal text, and its case follows the match too
    groups = p["fix"].rlike(r"(?<!\\)\$")
    filled = F.regexp_replace(found, p["pattern"], p["fix"])
    literal = F.when(p["expands"], filled).otherwise(p["fix"])
    as_is = (p["expands"] & groups) | ~p["match_case"]
    return F.when(p["fix"].isNotNull(), F.when(as_is, literal).otherwise(_cased(found, literal)))


def reach(side: Column, window: Column, take) -> Column:
    """Of a stretch of at most `window` characters those next to the match that make up `window` bytes, whole characters."""
    enough = F.filter(F.sequence(F.lit(1), F.greatest(window, F.lit(1))), lambda k: F.octet_length(take(side, k)) >= window)
    return take(side, F.when(window < 1, 0).otherwise(F.coalesce(F.array_min(enough), F.length(side))))


def _around(start: Column, end: Column, text: Column, window: Column) -> Column:
    before = F.substr(F.col("__t"), F.greatest(F.lit(1), start + 1 - window), F.least(window, start))
    after = F.substr(F.col("__t"), end + 1, window)
    return F.concat(reach(before, window, F.right), text, reach(after, window, F.left))


def _units(p: Column) -> Column:
    """The blocks that a part looks at: no code, for `prose` no headings and quotes; scope `all` takes the document for one."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("__t").alias("end"), F.col("__t").alias("text"), F.lit("paragraph").alias("kind")))
    written = F.filter("blocks", lambda b: (b["kind"] != "code") & ((p["scope"] != "prose") | b["kind"].isin(*PROSE)))
    return F.when(p["scope"] == "all", whole).otherwise(written)


def _prose() -> Column:
    return F.filter("sents", lambda s: s["prose"])


def _masked(scope: Column, findings: Column) -> Column:
    """Of a prose rule only what lies inside one sentence that is no citation."""
    inside = lambda f: F.exists("sents", lambda s: s["prose"] & (s["start"] <= f["start"]) & (f["end"] <= s["end"]))
    return F.filter(findings, lambda f: (scope != "prose") | inside(f))


def _phrase(p: Column) -> Column:
    def one(b: Column) -> Column:
        moved = F.transform(match_spans(b["text"], p["pattern"], p["probe"]), lambda s: F.struct((s["start"] + b["start"]).alias("start"), (s["end"] + b["start"]).alias("end"), s["text"].alias("text")))
        fits = lambda s: F.coalesce(~matches(_around(s["start"], s["end"], s["text"], p["window"]), p["context"]), F.lit(True))
        kept = F.when(p["context"].isNull(), moved).otherwise(F.filter(moved, fits))
        return F.transform(kept, lambda s: _of_part(p, s, replacement=_replacement(p, s["text"])))

    return over(_units(p), one)


def _leading(p: Column) -> Column:
    def one(s: Column) -> Column:
        head = extract(s["text"], p["pattern"])
        return _of_part(p, F.struct(s["start"].alias("start"), (s["start"] + F.length(head)).alias("end")))

    sents = F.when(p["scope"] == "prose", _prose()).otherwise(F.col("sents"))
    return F.transform(F.filter(sents, lambda s: matches(s["text"], p["pattern"])), one)


def density_count(pattern: Column | str, within: Column | str = "blocks") -> Column:
    """Matches of a pattern over all blocks."""
    pattern = F.lit(java(counting(pattern))) if isinstance(pattern, str) else pattern
    return F.aggregate(within, F.lit(0), lambda acc, b: acc + F.regexp_count(b["text"], pattern))


def _limit(rule_id: Column, limit: Column, by_doc: bool) -> Column:
    """A rule's threshold, or the one that the document's own options set."""
    return F.coalesce(F.try_element_at(F.col("options.thresholds"), rule_id), limit) if by_doc else limit


def _density(p: Column, by_doc: bool) -> Column:
    words = F.greatest(F.col("words"), F.lit(1))
    threshold = _limit(p["rule_id"], p["threshold"], by_doc)

    def fired(count: Column) -> Column:
        weight = F.greatest(F.lit(1), F.ceil(count - threshold * words / 1000))
        b = F.filter(_units(p), lambda b: matches(b["text"], p["pattern"]))[0]
        whole = extract(b["text"], p["pattern"])
        group = F.when(p["pattern"].rlike(r"(?<!\\)\((?!\?)"), extract(b["text"], p["pattern"], 1)).otherwise("")
        at = b["start"] + F.length(F.split(b["text"], p["pattern"], 2)[0])
        start = at + F.when(group != "", F.position(group, whole) - 1).otherwise(0)
        span = F.struct(start.alias("start"), (start + F.length(F.when(group != "", group).otherwise(whole))).alias("end"))
        message = F.concat(p["message"], F.lit(" ("), count.cast("string"), F.lit(" occurrences in "), F.col("words").cast("string"), F.lit(" words)"))
        return F.when(count / words * 1000 > threshold, F.array(_of_part(p, span, message, weight))).otherwise(F.array().cast(FINDING))

    return let(density_count(p["counts"], _units(p)), fired)


def _with_candidates(df: DataFrame, rows: list[dict]) -> DataFrame:
    """Adds `__at`, the places of the rows that a document may match."""
    df = df.withColumn("__low", folded(F.col("__t"))).withColumn("__words", keywords(rows, F.col("__low")))
    return once(df, __at=candidates(rows, "__low", "__words")).drop("__low", "__words")


def _by_parts(rows: list[dict], at: Column, by_doc: bool) -> Column:
    """Findings of the rows of `parts` at some places."""
    kinds = {"phrase": _phrase, "leading": _leading, "density": lambda p: _density(p, by_doc)}
    used = [k for k in kinds if any(r["kind"] == k for r in rows)]

    def one(p: Column) -> Column:
        found = F.array().cast(FINDING)
        for k in used:
            found = F.when(p["kind"] == k, kinds[k](p).cast(FINDING)).otherwise(found)
        return _masked(p["scope"], found) if any(r["scope"] == "prose" for r in rows) else found

    return F.flatten(F.transform(F.transform(at, lambda i: F.element_at(as_literal(rows), i)), one))


def hit_counts(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds `counts`: for each pattern that may match, rule_id and the number of matches over all blocks."""
    rows = parts(rules)
    df = _with_candidates(parse(docs, sentences_too=False), rows)
    return once(df, counts=F.transform(F.transform("__at", lambda i: F.element_at(as_literal(rows), i)), lambda p: F.struct(p["rule_id"].alias("rule_id"), density_count(p["pattern"], _units(p)).alias("n")))).drop("__at")


def document_metric(metric: str) -> Column:
    """A number over all sentences of a document; null where there are too few."""
    n, sents = F.size("sents"), F.col("sents")
    words = F.transform(sents, lambda s: s["n_words"].cast("double"))
    total = F.aggregate(words, F.lit(0.0), lambda a, x: a + x)
    if metric in ("triad-density", "paired-adjective-rate"):
        pattern = TRIAD if metric == "triad-density" else PAIR
        count = lambda s: F.regexp_count(s["text"], F.lit(java(counting(pattern))))
        if metric == "triad-density":  # without a comma there is none
            hits = F.aggregate(sents, F.lit(0), lambda a, s: a + F.when(F.contains(s["text"], F.lit(",")), count(s)).otherwise(0))
        else:  # nor without its word
            hits = F.aggregate(sents, F.lit(0), lambda a, s: a + F.when(F.contains(s["text"], F.lit("and")), count(s)).otherwise(0))
        return let(total, lambda t: F.when(t >= LEAST_WORDS, hits / t * 1000))
    enough = n >= LEAST_SENTENCES
    if metric in ("sentence-length-variance", "cadence-autocorrelation"):

        def with_mean(z: Column) -> Column:
            apart = F.transform(z["words"], lambda x: x - z["mean"])
            return let(apart, spread)

        def spread(apart: Column) -> Column:
            square = F.aggregate(apart, F.lit(0.0), lambda a, x: a + x * x)
            if metric == "sentence-length-variance":
                return square / n
            less = F.greatest(n - 1, F.lit(0))
            pairs = F.zip_with(F.slice(apart, F.lit(1), less), F.slice(apart, F.lit(2), less), lambda x, y: x * y)
            lag = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
            return let(square, lambda q: F.when(q > 0, lag / q))

        return F.when(enough, let(words, lambda w: let(F.struct(w.alias("words"), (F.aggregate(w, F.lit(0.0), lambda a, x: a + x) / n).alias("mean")), with_mean)))

    def ratio(named: Column) -> Column:
        k = F.greatest(F.size(named) - 1, F.lit(0))
        pairs = F.arrays_zip(F.slice(named, F.lit(1), k).alias("a"), F.slice(named, F.lit(2), k).alias("b"))
        return let(F.filter(pairs, lambda z: z["a"]["block_ix"] == z["b"]["block_ix"]), share)

    def share(inside: Column) -> Column:
        same = F.size(F.filter(inside, lambda z: z["a"]["opener"] == z["b"]["opener"]))
        return F.when(F.size(inside) > 0, same / F.size(inside))

    return F.when(enough, let(F.filter(sents, lambda s: s["opener"].isNotNull()), ratio))


def _repeats(sents: Column, length: int) -> Column:
    """Whether anywhere so many sentences in a row share opener and block."""
    like = lambda a, b: (a["opener"] == b["opener"]) & (a["block_ix"] == b["block_ix"])
    each = lambda i: reduce(and_, (like(F.get(sents, i - k), F.get(sents, i - k - 1)) for k in range(length - 1)))
    last = F.sequence(F.lit(length - 1), F.greatest(F.size(sents) - 1, F.lit(length - 1)))
    return F.coalesce(F.exists(last, each), F.lit(False))


def _statistical(rule: Rule, ix: int, by_doc: bool) -> Column:
    sents = _prose() if rule.scope == "prose" else F.col("sents")
    if rule.metric == "sentence-length":
        most = _limit(F.lit(rule.id), F.lit(float(rule.max_words)), by_doc).cast("int")
        return F.transform(F.filter(sents, lambda s: s["n_words"] > most), lambda s: _finding(rule, ix, s))
    if rule.metric == "repetitive-openers":
        # a run starts where a sentence does not go on; of every run_length-th in it a finding is made
        state = F.struct(F.lit(None).cast("string").alias("opener"), F.lit(-1).alias("block"), F.lit(0).alias("run"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, z: Column) -> Column:
            s, i = z["s"], z["i"]
            goes_on = (s["opener"] == acc["opener"]) & (s["block_ix"] == acc["block"])
            run = F.when(s["opener"].isNull(), 0).when(F.coalesce(goes_on, F.lit(False)), acc["run"] + 1).otherwise(1)
            return let(run, lambda run: F.struct(
                F.when(run != rule.run_length, s["opener"]).alias("opener"), s["block_ix"].alias("block"), F.when(run == rule.run_length, 0).otherwise(run).alias("run"),
                F.when(run == rule.run_length, F.array_append(acc["out"], i)).otherwise(acc["out"]).alias("out"),
            ))

        def found(some: Column) -> Column:
            numbered = F.transform(some, lambda s, i: F.struct(F.struct(s["opener"].alias("opener"), s["block_ix"].alias("block_ix")).alias("s"), i.alias("i")))
            runs = F.transform(F.aggregate(numbered, state, step, lambda acc: acc["out"]), lambda i: _finding(rule, ix, F.get(some, i)))
            return runs if rule.run_length < 2 else F.when(_repeats(some, rule.run_length), runs).otherwise(F.array().cast(FINDING))

        return let(sents, found)
    limit = _limit(F.lit(rule.id), F.lit(float(rule.threshold)), by_doc)

    def judged(value: Column) -> Column:
        fires = value > limit if rule.direction == "above" else value < limit
        # the nearest of two decimals to the binary value, of two equally near ones the even one; `format_string` rounds decimal digits up
        two = lambda x: F.call_function("format_number", x, F.lit("0.00"))
        message = F.concat(F.lit(f"{rule.says()} ("), two(value), F.lit(", threshold "), two(limit), F.lit(")"))
        return F.when(F.coalesce(fires, F.lit(False)), F.array(_finding(rule, ix, F.element_at("sents", 1), message))).otherwise(F.array().cast(FINDING))

    return let(document_metric(rule.metric), judged)


def _fixes(chosen: list[Rule]) -> list[dict]:
    """Of the rows of `parts` those whose findings may have a replacement."""
    return [r for r in parts(chosen) if r.get("fix") is not None]


@kept
def _fix_findings(chosen: tuple[Rule, ...]) -> Column:
    """The findings with a replacement, sorted."""
    return F.array_sort(F.concat(F.array().cast(FINDING), *([_by_parts(rows, F.col("__at"), False)] if (rows := _fixes(list(chosen))) else [])))


@kept
def _findings(chosen: tuple[Rule, ...], by_doc: bool = False) -> Column:
    """All findings of rules, sorted."""
    rows, empty = parts(list(chosen)), F.array().cast(FINDING)
    measured = [_masked(F.lit(r.scope), _statistical(r, ix, by_doc).cast(FINDING)) if r.scope == "prose" else _statistical(r, ix, by_doc).cast(FINDING) for ix, r in enumerate(chosen) if r.engine == "statistical"]
    return F.array_sort(F.concat(empty, *([_by_parts(rows, F.col("__at"), by_doc)] if rows else []), *(F.coalesce(e, empty) for e in measured)))


def _reads_sentences(rule: Rule) -> bool:
    return rule.engine in ("leading", "statistical") or rule.scope == "prose"


def fixes(docs: DataFrame, rules: RuleSet | None = None, options: Options = Options(), text: str = "text") -> DataFrame:
    """The rows of `find` without `words` and `n_sentences`, and of `findings` those with a replacement: what no edit depends on is not searched for."""
    chosen = [r for r in (rules or core_rules()).chosen(options) if r.engine != "inferential"]
    rows = _fixes(chosen)
    df = parse(docs, text, sentences_too=any(r["scope"] == "prose" for r in rows), words_too=False)
    df = once(_with_candidates(df, rows), __found=_fix_findings(tuple(chosen))).drop("__at")
    df = once(df, findings=allowed(F.col("__found"), F.col("__t"), rules or core_rules(), options.directive)).drop("__found")
    return once(df.withColumnRenamed("findings", "__found"), findings=_own_options(F.col("__found"))).drop("__found") if "options" in docs.columns else df


def find(docs: DataFrame, rules: RuleSet | None = None, options: Options = Options(), text: str = "text", late: bool = False) -> DataFrame:
    """Adds `words`, `n_sentences` and `findings`, sorted by place, rule and pattern.

    With `late`, sentences that no rule reads are an expression for one later use, and not made at all where nothing uses them.

    Where `docs` has a column `options` (see `operators.config`), each document's own options come on top of the run's."""
    by_doc = "options" in docs.columns
    chosen = [r for r in (rules or core_rules()).chosen(options) if r.engine != "inferential"]
    rows = parts(chosen)
    late = late and not any(map(_reads_sentences, chosen))
    df = parse(docs, text, sentences_too=not late)
    df = _with_candidates(df, rows)
    df = once(df, __found=_findings(tuple(chosen), by_doc)).drop("__at")
    df = once(df, findings=allowed(F.col("__found"), F.col("__t"), rules or core_rules(), options.directive)).drop("__found")
    if by_doc:
        df = once(df.withColumnRenamed("findings", "__found"), findings=_own_options(F.col("__found"))).drop("__found")
    df = df.withColumn("sents", _all_sentences()) if late else df
    return df.withColumn("n_sentences", F.size("sents"))


def _own_options(findings: Column) -> Column:
    """Of a document's findings those of rules that its own options run, with the severities that they give."""
    enable, disable, severity = (F.col(f"options.{c}") for c in ("enable", "disable", "severity"))
    runs = lambda f: F.coalesce(F.array_contains(enable, f["rule_id"]), F.lit(True)) & ~F.coalesce(F.array_contains(disable, f["rule_id"]), F.lit(False))
    return F.transform(F.filter(findings, runs), lambda f: f.withField("severity", F.coalesce(F.try_element_at(severity, f["rule_id"]), f["severity"]))).cast(FINDING)


def scope_mask(scope: Column, start: Column, end: Column, prose: bool = True) -> Column:
    """Whether a span lies where a scope looks: anywhere for `all`, in one block that is no code for `text`, in one sentence of prose for `prose`.
    Where no scope is that (`prose` is false), sentences are not read."""
    within = lambda z: (z["start"] <= start) & (end <= z["end"])
    looks = F.when(scope == "all", True)
    looks = looks.when(scope == "prose", F.exists("sents", lambda s: s["prose"] & within(s))) if prose else looks
    return looks.otherwise(F.exists("blocks", lambda b: (b["kind"] != "code") & within(b)))


def merged(found: DataFrame, judged: DataFrame, rules: RuleSet, options: Options = Options()) -> DataFrame:
    """`find`'s rows with the findings of a judge (doc_id, rule, status, start, end, explanation, confidence, suggested_rewrite).

    Those that stand in the text count if they lie in their rule's scope, no directive turns them off and
    their confidence reaches the floor; an error becomes a warning, and a rewrite a fix that may be wrong."""
    spark = found.sparkSession
    chosen = [r for r in rules.chosen(options) if r.engine == "inferential"]
    order = {r.id: i for i, r in enumerate(rules.rules)}
    known = spark.createDataFrame([(r.id, order[r.id], "warning" if r.severity == "error" else r.severity, r.intent, r.scope) for r in chosen], "rule string, ix int, severity string, intent string, scope string")
    kept = judged.where((F.col("status") == "grounded") & (F.coalesce("confidence", F.lit(0.0)) >= options.confidence_floor)).join(F.broadcast(known), "rule")  # a row per rule
    message = F.when(F.coalesce(F.trim("explanation"), F.lit("")) == "", F.concat(F.lit("Flagged by "), F.col("rule"), F.lit("."))).otherwise(F.col("explanation"))
    row = _row(F.col("start"), F.col("end"), F.col("ix"), F.lit(0), F.col("rule"), F.col("severity"), F.lit("inferential"), F.col("intent"), message, replacement=F.col("suggested_rewrite")).withField("confidence", F.col("confidence").cast("double"))
    prose = any(r.scope == "prose" for r in chosen)
    by_doc = kept.groupBy("doc_id").agg(F.collect_list(F.struct(row.alias("f"), F.col("scope").alias("scope"))).alias("__judged"))
    df = found.join(by_doc, "doc_id", "left")
    inside = F.transform(F.filter(F.coalesce("__judged", F.array()), lambda z: scope_mask(z["scope"], z["f"]["start"], z["f"]["end"], prose)), lambda z: z["f"])
    df = once(df, __more=inside.cast(FINDING))
    more = allowed(F.col("__more"), F.col("__t"), rules, options.directive)
    return df.withColumn("findings", F.array_sort(F.concat(F.col("findings"), more))).drop("__judged", "__more")


def penalty(findings: str = "findings") -> Column:
    """Points of the findings that speak for detection, by severity and weight, and by the confidence of a judge."""
    points = lambda f: F.when(f["severity"] == "error", 5).when(f["severity"] == "warning", 3).otherwise(1)
    return F.aggregate(findings, F.lit(0.0), lambda acc, f: acc + F.when(f["intent"] == "detection", points(f) * f["weight"] * F.coalesce(f["confidence"], F.lit(1.0))).otherwise(0))


def fixable(findings: Column, maybe: bool = False) -> Column:
    """How many findings have a fix that may be made; those that another one overlaps count too."""
    return F.size(F.filter(findings, lambda f: f["replacement"].isNotNull() & (F.lit(maybe) | (f["tier"] != "inferential"))))


def score_of(penalty: Column, words: Column) -> Column:
    """100 for no penalty, falling with the penalty per thousand words."""
    density = penalty / F.greatest(words, F.lit(1)) * 1000
    return F.least(F.lit(100), F.greatest(F.lit(0), F.round(F.lit(100.0) * F.exp(-density / 100)))).cast("int")


def lint_scores(docs: DataFrame, rules: RuleSet | None = None, options: Options = Options(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """word_count, sentence_count, n_findings, penalty and score of each document."""
    df = find(docs, rules, options, late=True).withColumn("penalty", penalty())
    return df.select(*keep, F.col("words").alias("word_count"), F.col("n_sentences").alias("sentence_count"), F.size("findings").alias("n_findings"), "penalty", score_of(F.col("penalty"), F.col("words")).alias("score"), F.array_distinct(F.transform("findings", lambda f: f["rule_id"])).alias("fired_rules"))


def placed(found: DataFrame) -> DataFrame:
    """The rows of `find` with `placed`: the findings in order with line and column (UTF-16 units, from 1) of both ends and their line as excerpt.

    A text is cut into lines once; a finding looks its place up among their beginnings."""
    df = once(found, __lines=F.split("__t", "\n", -1))
    df = once(df, __starts=offsets(F.transform("__lines", lambda x: F.length(x) + 1)))

    def at(offset: Column) -> Column:
        return let(F.size(F.filter("__starts", lambda s: s <= offset)), lambda n: F.struct(n.alias("line"), _units16(F.substr(F.element_at("__lines", n), F.lit(1), offset - F.element_at("__starts", n))).alias("column")))

    def one(f: Column, i: Column, start: Column, end: Column) -> Column:
        said = F.element_at("__lines", start["line"])
        return F.struct(
            i.alias("ord"), *(f[c].alias(c) for c in ("rule_id", "severity", "tier", "intent", "start", "end", "message", "weight", "replacement")),
            start["line"].alias("line"), start["column"].alias("column"), end["line"].alias("end_line"), end["column"].alias("end_column"),
            trimmed(said).alias("excerpt"), f["confidence"].alias("confidence"), F.when(f["replacement"].isNotNull(), F.when(f["tier"] == "inferential", MAYBE).otherwise(MACHINE)).alias("applicability"),
        )

    each = F.transform("findings", lambda f, i: let(F.struct(at(f["start"]).alias("a"), at(f["end"]).alias("b")), lambda z: one(f, i, z["a"], z["b"])))
    return once(df, placed=each).drop("__lines", "__starts")


def _units16(text: Column) -> Column:
    """The column behind a text at a line's beginning."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2 + 1).cast("int")


def diagnostics(docs: DataFrame, rules: RuleSet | None = None, options: Options = Options(), found: DataFrame | None = None) -> DataFrame:
    """One row per finding of `placed`. `found` takes the place of `find(docs)`."""
    df = placed(find(docs, rules, options) if found is None else found)
    return df.select("doc_id", F.inline("placed"))


def edited(text: Column, edits: Column) -> Column:
    """(text, n): a text with its edits (start, end, replacement; by start) made, and how many were; one that begins before the last one's end, or ends behind the text, is left out."""
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, f: Column) -> Column:
        ok = (f["start"] >= acc["pos"]) & (f["end"] <= F.length(text))
        out = F.concat(acc["out"], F.substr(text, acc["pos"] + 1, f["start"] - acc["pos"]), f["replacement"])
        return F.struct(F.when(ok, f["end"]).otherwise(acc["pos"]).alias("pos"), F.when(ok, out).otherwise(acc["out"]).alias("out"), (acc["n"] + ok.cast("int")).alias("n"))

    return F.aggregate(edits, zero, step, lambda acc: F.struct(F.concat(acc["out"], F.substr(text, acc["pos"] + 1)).alias("text"), acc["n"].alias("n")))


def fixed(docs: DataFrame, rules: RuleSet | None = None, options: Options = Options(), found: DataFrame | None = None, maybe: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `keep`, the text with all replacements made (also those that may be wrong if `maybe`), and how many were; of overlapping ones the first counts.
    `found` takes the place of `fixes(docs)`."""
    df = fixes(docs, rules, options) if found is None else found
    edits = F.filter("findings", lambda f: f["replacement"].isNotNull() & (F.lit(maybe) | (f["tier"] != "inferential")))
    return once(df, __d=edited(F.col("__t"), edits)).select("doc_id", *keep, F.col("__d.text").alias("fixed_text"), F.col("__d.n").alias("n_fixes"))


def changed(docs: DataFrame, rules: RuleSet | None = None, options: Options = Options()) -> DataFrame:
    """The rows of `fixed` whose text differs from what it was: all that a writer has to write."""
    return fixed(docs, rules, options, keep=("__t",)).where("fixed_text <> __t").drop("__t")
