"""Operator 4: personal data by patterns, checksums and context, in SQL functions only.

A regular expression per kind proposes spans; validators confirm them (octets of
an address, Luhn for cards, digit counts for telephone numbers, mod 97 for bank
accounts); words that stand close to a span, on either side, raise or lower its score.
Kinds without a checksum of their own (`ssn`) count only where the context
speaks for them.

Everything is one projection over a row: no shuffle, no Python. Positions come
from splitting the text at the pattern that also extracts the matches. The
patterns are possessive with a look-behind where a shorter match or a later
start in the same run cannot succeed, so that long texts take linear time and
no recursion.

Defined results: a null text counts as empty and has no spans; spans of
different kinds may overlap; repeated rows give repeated results; further
columns of the input are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, offsets

# The kinds in the order of the result and their patterns. \G lets
# an address start where the last one ended, inside a run of the same characters.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: The score of a span that its validator confirms.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.95, "ssn": 0.4}
#: Words near a span that speak for its kind, and words that speak against any.
CONTEXT = {
    "email": r"e-?mail|contact|write to|mailto",
    "ip": r"\bip\b|address|host|server|client",
    "card": r"card|visa|credit|debit|payment",
    "phone": r"phone|call|tel\b|mobile|fax",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "ssn": r"ssn|social|security|taxpayer",
}
AGAINST = r"example|sample|dummy|version|isbn|order no"
WINDOW, RAISE, LOWER, LEAST = 40, 0.2, 0.2, 0.5


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _octets(x: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(bare) <= 3, F.concat(F.lit("0"), bare).cast("int") <= 255).otherwise(False)

    return F.forall(F.split(x, r"\."), small)


def _luhn(x: Column) -> Column:
    back, n = F.reverse(_digits(x)), F.length(_digits(x))

    def value(i: Column) -> Column:
        v = F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def _mod97(x: Column) -> Column:
    bare = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(bare)), F.lit(0), step) == 1


VALID = {
    "email": lambda x: F.lit(True),
    "ip": _octets,
    "card": _luhn,
    "phone": lambda x: F.length(_digits(x)).between(9, 15),
    "iban": _mod97,
    "ssn": lambda x: ~x.rlike("^(?:000|666|9)|-00-|-0000$"),
}


def _placed(found: Column, between: Column) -> Column:
    """Matches with the text on both sides of each (up to the context window, at most to the next match of the kind) and their offsets."""

    def pairs(n: Column) -> Column:
        return F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), n).alias("s"), F.slice(between, F.lit(2), n).alias("a"))

    def with_offsets(both: Column) -> Column:
        at = offsets(F.transform(both, lambda x: F.length(x["s"]) + F.length(x["m"])))
        return F.zip_with(both, at, span)

    def span(x: Column, at: Column) -> Column:
        start = at + F.length(x["s"])
        near = F.lower(F.concat(F.right(x["s"], F.lit(WINDOW)), F.lit("\n"), F.left(x["a"], F.lit(WINDOW))))
        return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("text"), near.alias("near"))

    return let(F.size(found), lambda n: let(pairs(n), with_offsets))


def find_spans(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Adds `into`: for each kind of `KINDS` an array of (start, end, text, score), by start."""
    df, t = docs, F.coalesce(F.col(text), F.lit(""))
    found, between = {}, {}
    for kind, pattern in KINDS.items():
        has = F.contains(t, F.lit(NEEDS[kind])) if kind in NEEDS else t.rlike(r"[0-9][\x20-]?[0-9]")
        found[f"__m_{kind}"] = F.when(has, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumns(found)
    for kind, pattern in KINDS.items():
        between[f"__s_{kind}"] = F.when(F.size(f"__m_{kind}") > 0, F.split(t, pattern, -1)).otherwise(F.array().cast("array<string>"))
    df = df.withColumns(between)

    def scored(kind: str) -> Column:
        spans = F.filter(_placed(F.col(f"__m_{kind}"), F.col(f"__s_{kind}")), lambda x: VALID[kind](x["text"]))

        def one(x: Column) -> Column:
            score = F.lit(PRIOR[kind]) + F.when(x["near"].rlike(CONTEXT[kind]), RAISE).otherwise(0.0) - F.when(x["near"].rlike(AGAINST), LOWER).otherwise(0.0)
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.least(F.lit(1.0), score).alias("score"))

        spans = F.transform(spans, one)
        kept = spans if kind in BASE else F.filter(spans, lambda x: x["score"] >= LEAST)
        return F.when(F.size(f"__m_{kind}") > 0, kept).otherwise(F.array().cast("array<struct<start:int,end:int,text:string,score:double>>"))

    return df.withColumn(into, F.struct(*(scored(k).alias(k) for k in KINDS))).drop(*found, *between)


def _written(kinds: tuple[str, ...], pii: str, mark: Column | None = None) -> Column:
    def name(kind: str):
        return lambda x: F.concat(F.lit(f"{kind}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))

    return F.array_join(F.concat(*(F.transform(F.col(f"{pii}.{k}"), name(k)) for k in kinds)), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each document (doc_id, text)."""
    df = find_spans(docs.select("doc_id", "text"))
    return df.select(
        "doc_id",
        *(F.size(f"pii.{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_written(BASE, "pii").cast("binary"), 256).alias("base_sha256"),
        _written(tuple(KINDS), "pii").alias("spans"),
        F.array_max(F.concat(F.array(F.lit(0.0)), *(F.transform(F.col(f"pii.{k}"), lambda x: x["score"]) for k in KINDS))).alias("top_score"),
    )


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span of `text` by its kind in brackets; of overlapping spans the first
    to start (then the longest) names the replacement, which covers their union."""
    df = find_spans(docs, text, "__pii")

    def edit(kind: str):
        return lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), F.lit(kind).alias("kind"))

    every = F.array_sort(F.concat(*(F.transform(F.col(f"__pii.{k}"), edit(k)) for k in KINDS)))

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.substr(F.col(text), acc["pos"] + 1, x["start"] - acc["pos"]), F.lit("["), x["kind"], F.lit("]"))
        out = F.when(x["start"] >= acc["pos"], new).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], -x["back"]).alias("pos"), out.alias("out"))

    first = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    df = df.withColumn("__all", every)
    done = F.aggregate("__all", first, step, lambda acc: F.concat(acc["out"], F.substr(F.col(text), acc["pos"] + 1)))
    return df.withColumn(text, F.when(F.size("__all") > 0, done).otherwise(F.col(text))).drop("__pii", "__all")
