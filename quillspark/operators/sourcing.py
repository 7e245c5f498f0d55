"""Pages and raw passages made ready: markup and noise removed, passages cut, overlap with other texts found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed

# Elements that go with their content, and those that end a word.
DROPPED = ("script", "style", "nav", "header", "footer")
BREAKING = "p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|blockquote|pre|hr"
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—", "&sect;": "§", "&hellip;": "…"}
_ENTITY = "&(?:" + "|".join(e[1:-1] for e in ENTITIES) + "|#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6});"


def _character(entity: Column) -> Column:
    """The character of an entity; a number that is none stays as written."""
    hex_ = F.regexp_extract(entity, "(?i)^&#x([0-9a-f]+);$", 1)
    number = F.when(hex_ != "", F.conv(hex_, 16, 10)).otherwise(F.regexp_extract(entity, "^&#([0-9]+);$", 1)).try_cast("int")
    whole = number.between(0, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    by_number = F.when(number == 160, " ").when(whole, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    named = F.lit(None).cast("string")
    for name, char in ENTITIES.items():
        named = F.when(entity == name, F.lit(char)).otherwise(named)
    return F.coalesce(named, by_number, entity)


def decoded(text: Column) -> Column:
    """Entities as characters, in one pass: what a decoded entity spells is not decoded again."""
    found = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
    parts = F.zip_with(F.split(text, _ENTITY, -1), found, lambda before, e: F.concat(before, F.coalesce(_character(e), F.lit(""))))
    return F.when(text.rlike(_ENTITY), F.array_join(parts, "")).otherwise(text)


def html_text(html: Column) -> Column:
    """The text of a page: dropped elements (to the end, where one is never closed), tags and comments go, entities are decoded."""
    x = F.coalesce(html, F.lit(""))
    x = F.regexp_replace(x, "(?s)<!--.*?-->", " ")
    for name in DROPPED:
        x = F.regexp_replace(x, f"(?is)<{name}\\b[^>]*>.*?(?:</{name}\\s*>|\\z)", " ")
    x = F.regexp_replace(x, f"(?i)</?(?:{BREAKING})\\b[^>]*>", "\n")
    return decoded(F.regexp_replace(x, "<[^>]+>", ""))


def clean_lines(text: Column) -> Column:
    """Lines trimmed and joined by blanks, without blank ones, page numbers, running heads and footnote marks."""

    def noise(line: Column) -> Column:
        return (line == "") | line.rlike(r"^[0-9]+$") | line.rlike(r"^(?:[0-9]+\s+){0,4}[0-9]+$") | line.rlike(r"(?i)^(?:page\s+[0-9]+.*|table of contents|opinion)$")

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+\z", ""))
    joined = F.array_join(F.filter(lines, lambda x: ~noise(x)), " ")
    return F.regexp_replace(F.regexp_replace(joined, r"(?<=\s|^)\[[0-9]+\](?=\s|$)", ""), r" {2,}", " ")


def cut_preamble(text: Column, markers: tuple[str, ...]) -> Column:
    """From the earliest marker on; the whole text where none occurs."""
    at = F.least(*(F.when(F.contains(text, F.lit(m)), F.locate(m, text)) for m in markers)) if len(markers) > 1 else F.when(F.contains(text, F.lit(markers[0])), F.locate(markers[0], text))
    return F.when(at.isNotNull(), F.substr(text, at)).otherwise(text)


def passages(text: Column, least: int = 100, most: int = 500) -> Column:
    """Sentences of three words or more packed into passages of `least` to `most` words; a short rest is dropped."""
    sents = F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.regexp_count(s, F.lit(r"\S+")) >= 3)
    state = "struct<words:int,open:string,out:array<string>>"
    zero = F.struct(F.lit(0).alias("words"), F.lit("").alias("open"), F.array().cast("array<string>").alias("out")).cast(state)

    def step(acc: Column, s: Column) -> Column:
        n = F.regexp_count(s, F.lit(r"\S+"))
        over = (acc["words"] > 0) & (acc["words"] + n > most)
        closed = F.when(over & (acc["words"] >= least), F.array_append(acc["out"], acc["open"])).otherwise(acc["out"])
        whole = F.when(acc["words"] == 0, s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        return F.struct(F.when(over, n).otherwise(acc["words"] + n).alias("words"), F.when(over, s).otherwise(whole).alias("open"), closed.alias("out")).cast(state)

    return F.aggregate(sents, zero, step, lambda acc: F.when(acc["words"] >= least, F.array_append(acc["out"], acc["open"])).otherwise(acc["out"]))


#: Runs of the items up to which they are sent to every task; 8-byte hashes, about 100 MB at the most.
FEW = 5_000_000


def token_runs(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, run): the runs of n words (lower case, letters and digits) of each `text`, as hashes and as often as they stand."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    few = df.select(key, words.alias("ws")).where(F.size("ws") >= n)
    return few.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("ws", i, F.lit(n)), " ")))).alias("run"))


def _texts_of_runs(df: DataFrame, key: str, n: int) -> DataFrame:
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return df.select(key, words.alias("ws")).where(F.size("ws") >= n).select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.array_join(F.slice("ws", i, F.lit(n)), " ")))).alias("run"))


def verbatim_overlap(docs: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """(item_id, doc_id, runs): documents that share a run of n words with an item.

    The documents that hold the hash of some item's run are found first, without a shuffle where
    the items are few; only those documents' runs are then compared as texts."""
    wanted = token_runs(items, "item_id", n).select("run").distinct()
    few = wanted.limit(FEW + 1).count() <= FEW
    hit = token_runs(docs, "doc_id", n).join(F.broadcast(wanted) if few else wanted, "run", "left_semi").select("doc_id").distinct()
    some = docs.select("doc_id", "text").join(hit, "doc_id", "left_semi")
    left, right = _texts_of_runs(items, "item_id", n), _texts_of_runs(some, "doc_id", n)
    return right.join(left, "run").groupBy("item_id", "doc_id", "run").agg(F.lit(1)).groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("runs"))


def short_overlap(docs: DataFrame, items: DataFrame, least: int = 5, most: int = 7) -> DataFrame:
    """(item_id, doc_id): documents that hold the whole of an item of `least` to `most` words."""
    size = F.size(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != ""))
    each = [verbatim_overlap(docs, items.where(size == n), n).select("item_id", "doc_id") for n in range(least, most + 1)]
    return reduce(DataFrame.unionByName, each)


#: Runs that a text takes from another word by word: of any, and of one that is twice as long and more.
RUN, SHORT_RUN = 8, 5


def plain_tokens(text: Column) -> Column:
    """Words between blanks in lower case, without marks at either end other than apostrophes."""
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{N}']+|[^\p{IsAlphabetic}\p{N}']+\z", "")))
    return F.filter(bare, lambda w: w != "")


def opening(text: Column) -> Column:
    """A text up to its first full stop, exclamation or question mark."""
    return F.regexp_extract(text, r"(?s)^[^.!?]*", 0)


def _runs(words: Column, n: int) -> Column:
    """The distinct runs of n words."""
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))).otherwise(F.array().cast("array<string>"))


def _sized(runs: Column, n: int) -> Column:
    return F.transform(runs, lambda x: F.struct(F.lit(n).alias("n"), x.alias("run")))


def echoes(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, long_runs, short_runs) of `docs` that echo the text of an item: with a run of eight words of it or of its opening, or, where
    the document has less than half its words, with a run of five. Counts are of the item's distinct runs that the document holds.

    Items' runs go to every task as hashes where they are few; only documents that hold one are compared."""
    said = items.select("item_id", plain_tokens(F.col("text")).alias("ws"), plain_tokens(opening(F.coalesce("text", F.lit("")))).alias("os"))
    runs = said.select("item_id", F.size("ws").alias("size"), F.inline(F.concat(_sized(F.array_union(_runs(F.col("ws"), RUN), _runs(F.col("os"), RUN)), RUN), _sized(_runs(F.col("ws"), SHORT_RUN), SHORT_RUN)))).distinct()
    wanted = runs.select(F.xxhash64("run").alias("h")).distinct()
    few = wanted.limit(FEW + 1).count() <= FEW
    held = docs.select("doc_id", plain_tokens(F.col("text")).alias("ws")).withColumn("of", F.size("ws"))
    each = held.select("doc_id", "of", F.explode(F.concat(_runs(F.col("ws"), RUN), _runs(F.col("ws"), SHORT_RUN))).alias("run")).withColumn("h", F.xxhash64("run"))
    met = each.join(F.broadcast(wanted) if few else wanted, "h", "left_semi").select("doc_id", "of", "run").distinct()
    both = met.join(runs, "run").groupBy("item_id", "doc_id").agg(F.count_if(F.col("n") == RUN).alias("long_runs"), F.count_if(F.col("n") == SHORT_RUN).alias("short_runs"), F.max("of").alias("of"), F.max("size").alias("size"))
    return both.where((F.col("long_runs") > 0) | (F.col("short_runs") > 0) & (F.col("of") < F.floor(F.col("size") / 2))).select("item_id", "doc_id", "long_runs", "short_runs")


def without_opening(text: Column) -> Column:
    """A text behind its first full stop, exclamation or question mark; empty without one."""
    return trimmed(F.regexp_extract(text, r"(?s)^[^.!?]*[.!?](.*)\z", 1))
