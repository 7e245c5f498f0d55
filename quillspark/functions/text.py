"""Text expressions: words, match positions, blocks, lines. Offsets count code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"


def java(pattern: str) -> str:
    """A pattern under Unicode classes and `\\n` as the only line end."""
    return "(?Ud)" + pattern


def trimmed(text: Column) -> Column:
    """Without white space (of all of Unicode) at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def word_count(text: Column) -> Column:
    """Words of letters, digits, apostrophes and hyphens, that begin and end in a letter or digit."""
    return F.regexp_count(text, F.lit(r"(?U)\w+(?:['’-]+\w+)*+"))


def kept(make: Callable[..., Column]) -> Callable[..., Column]:
    """Keeps what `make` returns for its (hashable) arguments: an expression names no table, and takes hundreds of calls to the JVM to build."""
    found: dict = {}

    def get(*args) -> Column:
        key = (id(SparkContext._gateway), *args)
        if key not in found:
            found[key] = make(*args)
        return found[key]

    return get


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions may use often, also inside lambdas: the generator keeps the
    optimizer from putting their definitions in the place of each use."""
    one = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select("*", F.explode(F.array(one)).alias("__once")).select(*df.columns, *(F.col(f"__once.{n}").alias(n) for n in columns))


#: Items that a running sum takes at a time: sums append to an array, whose copies grow with the square of this only.
RUNNING = 32


def offsets(lengths: Column) -> Column:
    """Where each item begins, of items with these lengths that stand in a row."""
    zero = F.array(F.lit(0))

    def grown(acc: Column, x: Column) -> Column:
        return F.array_append(acc, F.element_at(acc, -1) + x)

    def whole(sums: Column) -> Column:
        bases = F.aggregate(sums, zero, lambda acc, p: grown(acc, F.element_at(p, -1)))
        return let(bases, lambda z: F.flatten(F.transform(sums, lambda p, i: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x + F.get(z, i)))))

    def parts(all_: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(RUNNING))
        return F.transform(first, lambda i: F.aggregate(F.slice(all_, i, F.lit(RUNNING)), zero, grown))

    return let(lengths, lambda all_: let(parts(all_), whole))


def extract(text: Column, pattern: Column, group: int = 0) -> Column:
    """The first match of a pattern that is a column, or a group of it."""
    return F.call_function("regexp_extract", text, pattern, F.lit(group))


def matches(text: Column, pattern: Column) -> Column:
    """Whether a pattern that is a column matches anywhere; it is compiled once for all texts in a row that meet it, as `regexp_like` does only for literals."""
    return F.regexp_instr(text, pattern) > 0


#: Stand where a text is to be cut; noncharacters, which no text for interchange holds.
CUT, CLOSE = "\ufdd0", "\ufdd2"


def match_spans(text: Column, pattern: Column | str, probe: Column | None = None) -> Column:
    """All non-empty matches, leftmost and not overlapping: array of (start, end, text). `probe` matches every text that `pattern` does.

    The text with a mark on either side of each match is searched once, and cut at the marks."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(parts: Column) -> Column:
        starts = offsets(F.transform(parts, lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0)))
        found = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda p: F.substring_index(p, CLOSE, 1))
        return let(starts, lambda at: F.transform(found, lambda m, i: F.struct(F.get(at, i + 1).alias("start"), (F.get(at, i + 1) + F.length(m)).alias("end"), m.alias("text"))))

    marked = F.split(F.regexp_replace(text, pattern, F.lit(f"{CUT}$0{CLOSE}")), CUT, -1)
    spans = F.filter(let(marked, placed), lambda z: z["end"] > z["start"])
    taken = text.contains(CUT) | text.contains(CLOSE)
    return F.when(matches(text, pattern if probe is None else probe), F.when(taken, _split_spans(text, pattern)).otherwise(spans)).otherwise(F.array().cast(SPAN))


def _split_spans(text: Column, pattern: Column) -> Column:
    """`match_spans` of a text that holds the marks: split at the pattern, it gives what stands between the matches."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    both = let(found, lambda m: F.arrays_zip(m.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)).alias("s")))

    def placed(pairs: Column) -> Column:
        at = offsets(F.transform(pairs, lambda z: F.length(z["s"]) + F.length(z["m"])))
        return F.zip_with(pairs, at, lambda z, o: F.struct((o + F.length(z["s"])).alias("start"), (o + F.length(z["s"]) + F.length(z["m"])).alias("end"), z["m"].alias("text")))

    return F.filter(let(both, placed), lambda z: z["end"] > z["start"])


def pieces(text: Column, pattern: str, behind: bool = True) -> Column:
    """A text cut behind or before each match of a pattern: trimmed pieces as an array of (start, end, text), without blank ones."""

    def bare_end(p: Column) -> Column:
        # most pieces end in a stop: one character tells, and the text is not searched
        return F.when(F.endswith(p, F.lit(".")), p).when(F.right(p, F.lit(1)).rlike(r"(?U)\s"), F.regexp_replace(p, r"(?U)\s+\z", "")).otherwise(p)

    def placed(parts: Column) -> Column:
        # its blanks are counted, not replaced: what stands behind them is copied once
        at = offsets(F.transform(parts, lambda p: F.length(p)))
        blanks = lambda p: F.length(F.regexp_extract(p, r"(?U)\A\s+", 0))
        return F.zip_with(parts, at, lambda p, o: let(blanks(p), lambda n: F.struct((o + n).alias("start"), bare_end(F.when(n == 0, p).otherwise(F.substr(p, n + 1))).alias("text"))))

    whole = let(F.split(F.regexp_replace(text, pattern, "$0" + CUT if behind else CUT + "$0"), CUT, -1), placed)
    return F.transform(F.filter(whole, lambda z: z["text"] != ""), lambda z: F.struct(z["start"].alias("start"), (z["start"] + F.length(z["text"])).alias("end"), z["text"].alias("text")))


def blocks(text: Column) -> Column:
    """Paragraphs of plain text: lines up to a blank one, as an array of (start, end, text)."""
    # blanks before a piece cost less to find than those behind it
    return pieces(text, r"(?Ud)\n(?:[^\S\n]*\n)+", behind=False)


def line_of(text: Column, offset: Column) -> Column:
    """The line of an offset, from 1."""
    before = F.substr(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, offset: Column) -> Column:
    """The column of an offset in UTF-16 units, from 1."""
    last = F.substring_index(F.substr(text, F.lit(1), offset), "\n", -1)
    return (F.octet_length(F.encode(last, "UTF-16BE")) / 2 + 1).cast("int")


def byte_offset(text: Column, offset: Column) -> Column:
    return F.octet_length(F.substr(text, F.lit(1), offset))


def over(items: Column, make: Callable[[Column], Column]) -> Column:
    """What `make` returns (arrays) for each item, as one array."""
    return F.flatten(F.transform(items, make))
