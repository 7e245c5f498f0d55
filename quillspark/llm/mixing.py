"""Operator 13: mixing sources to target weights by Pareto order sampling.

A source's target is its share of the mix by weight, at most `EPOCHS` times its own
words; what a capped source leaves is shared by the others, by weight. Within a source
a document's expected copies are proportional to its inclusion weight, at most `EPOCHS`;
the whole part of them is certain. The rest is an inclusion probability p. With a draw u
a document ranks by (u / (1 - u)) / (p / (1 - p)), its random odds over its inclusion odds,
and one more copy goes to documents in that order until the words that the source still
lacks are found: a sample of fixed size, counted in words.

No source is sorted whole. Ranks are cut into at most `CUTS` intervals of about `FEW`
documents; sums by interval tell in which one the sample ends, which is cut once more in
the same way. Only the documents of the last interval meet, some `FEW` a source (a source
of `FEW` * `CUTS`^2 documents, 2^34, has no more): there each takes a copy that still fits,
in rank order, and at last one more, alone or in exchange for another, if that brings the source nearer its target.

The text is read once; what follows works on a written table of a few numbers a document.

Defined results: a null text has no words; a document without words takes none; a null
source is a source of its own, the last; the draw hangs on the doc_id alone, so reruns agree,
rows that share an id share their draw, and equal rows may differ in what they take at the
end of the sample only; an empty table gives an empty result; a table without words takes
none; further columns of the input are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS, SHARE, EPOCHS = (5.0, 2.0, 1.0), 1.5, 2.0
FEW, CUTS, SALTS = 1024, 4096, 64
#: Twice as long a document has 2^-DAMPING of the inclusion weight, so that a budget of words covers more documents.
DAMPING = 0.25
SEED = "mix"
WORDS = r"[^\x20\x09-\x0D]+"


def size_class(size: Column) -> Column:
    """The binary digits of a size, 0 for none."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) for each id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """src, source_size, target and n of each source of `sizes` (src, source, size).

    One row a source meets in the windows, no documents."""
    by = sizes.groupBy("src", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(epochs))
    # sources reach their cap in the order of cap / weight; the level is what a weight of one gets once the last capped one is known
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    upto, every = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    by = by.withColumn("full", F.sum("most").over(upto)).withColumn("w_full", F.sum("w").over(upto))
    by = by.withColumn("all", F.sum("source_size").over(every) * F.lit(share)).withColumn("w_all", F.sum("w").over(every))
    capped = F.col("most") * (F.col("w_all") - F.col("w_full") + F.col("w")) <= (F.col("all") - F.col("full") + F.col("most")) * F.col("w")
    by = by.withColumn("capped", capped)
    used = F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(every), F.lit(0.0))
    open_ = F.sum(F.when(~F.col("capped"), F.col("w"))).over(every)
    return by.select("src", "source_size", "n", F.when(F.col("capped"), F.col("most")).otherwise((F.col("all") - used) / open_ * F.col("w")).alias("target"))


def expected_copies(classes: DataFrame, epochs: float = EPOCHS, damping: float = DAMPING) -> DataFrame:
    """src, class, copies: for each source and size class (with their words and the source's target) the expected copies of a document."""
    weight = F.pow(F.lit(2.0), F.col("class") * F.lit(-damping))
    by_src = Window.partitionBy("src")
    upto = by_src.orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    df = classes.where("words > 0").withColumn("w", weight).withColumn("ww", F.col("w") * F.col("words"))
    df = df.withColumn("full", F.sum("words").over(upto) * F.lit(epochs)).withColumn("rest", F.sum("ww").over(by_src.orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("full") - F.col("words") * F.lit(epochs)
    df = df.withColumn("capped", F.col("w") * (F.col("target") - before) >= F.lit(epochs) * F.col("rest"))
    used = F.coalesce(F.sum(F.when(F.col("capped"), F.col("words"))).over(by_src), F.lit(0)) * F.lit(epochs)
    open_ = F.sum(F.when(~F.col("capped"), F.col("ww"))).over(by_src)
    return df.select("src", "class", F.when(F.col("capped"), F.lit(epochs)).otherwise(F.greatest(F.lit(0.0), (F.col("target") - used) / open_ * F.col("w"))).alias("copies"))


def _beside(rows: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with what `sources` says of theirs; where Spark does not broadcast that, rows of one source are spread over `SALTS` copies of it."""
    copies = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(copies, ["src", "salt"], how).drop("salt")


def _cuts(n: Column) -> Column:
    return F.least(F.lit(CUTS), F.greatest(F.lit(1), F.ceil(n / F.lit(FEW)))).cast("long")


def _end(sums: DataFrame, at: str) -> DataFrame:
    """Of each source the interval `at` in which the words it lacks are found (the last one if they never are), what is still lacking there, and the interval's documents."""
    upto = Window.partitionBy("src").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("so_far", F.sum("words").over(upto)).withColumn("last", F.max(at).over(Window.partitionBy("src")))
    met = (F.col("so_far") >= F.col("lacking")) | (F.col(at) == F.col("last"))
    return sums.where(met).groupBy("src").agg(F.min(F.struct(at, (F.col("lacking") - F.col("so_far") + F.col("words")).alias("lacking"), "n")).alias("x")).select("src", F.col(f"x.{at}").alias(f"end_{at}"), "x.lacking", "x.n")


def _filled(group: pa.Table) -> pa.Table:
    """Documents of one source in rank order: those that fit what is lacking take one more copy; see above for the last."""
    group = group.sort_by([("z", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
    sizes, lacking = group.column("size").to_numpy(), group.column("lacking")[0].as_py()
    more = np.zeros(len(sizes), bool)
    for i, size in enumerate(sizes.tolist()):
        if size <= lacking:
            more[i], lacking = True, lacking - size
    # one more document, alone or in exchange for one that was taken
    out, (taken, at) = np.flatnonzero(~more), np.unique(sizes[more], return_index=True)
    taken, at = np.concatenate(([0], taken)), np.concatenate(([-1], np.flatnonzero(more)[at]))
    if len(out):
        near = np.searchsorted(taken, sizes[out] - lacking)
        tried = [(abs(lacking - sizes[i] + taken[k]), i, at[k]) for i, n in zip(out, near, strict=True) for k in {max(n - 1, 0), min(n, len(taken) - 1)}]
        error, i, back = min(tried)
        if error < lacking:
            more[i] = True
            if back >= 0:
                more[back] = False
    return group.select(["doc_id", "src", "size", "whole"]).append_column("more", pa.array(more))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, damping: float = DAMPING, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each row of `docs` (doc_id, source, text)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    base = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _key(F.col("source")).alias("src"), size.alias("size")))
    goals = materialize(targets(base.select("src", "source", "size"), weights, share, epochs))
    base = base.withColumn("class", size_class(F.col("size")))
    copies = expected_copies(base.groupBy("src", "class").agg(F.sum("size").alias("words")).join(goals, "src"), epochs, damping)

    p, u = F.col("copies") - F.col("whole"), draw(F.col("doc_id"), seed)
    ranked = base.join(copies, ["src", "class"], "left").withColumn("copies", F.coalesce("copies", F.lit(0.0))).withColumn("whole", F.floor("copies"))
    ranked = materialize(ranked.select("doc_id", "src", "size", "whole", F.when((p > 0) & (F.col("size") > 0), u * (1 - p) / (u * (1 - p) + (1 - u) * p)).alias("z")))

    certain = ranked.groupBy("src").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"), F.count("z").alias("n"))
    lacking = certain.join(goals.drop("n"), "src").select("src", (F.col("target") - F.col("certain")).alias("lacking"), _cuts(F.col("n")).alias("cuts1"))
    first = F.floor(F.col("z") * F.col("cuts1"))
    some = _beside(ranked.where("z is not null"), lacking).withColumn("b1", first)
    end1 = _end(some.groupBy("src", "b1", "lacking").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "b1")
    end1 = end1.withColumn("cuts2", _cuts(F.col("n"))).drop("n").join(lacking.select("src", "cuts1"), "src")
    within = F.least(F.floor((F.col("z") * F.col("cuts1") - F.col("b1")) * F.col("cuts2")), F.col("cuts2") - 1)
    inside = _beside(ranked.where("z is not null"), end1).withColumn("b1", first).where("b1 = end_b1").withColumn("b2", within)
    end2 = _end(inside.groupBy("src", "b2", "lacking").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "b2").drop("n")
    ends = materialize(end1.drop("lacking").join(end2, "src"))

    placed = _beside(ranked, ends, "left").withColumn("b1", first).withColumn("b2", within)
    last = (F.col("b1") == F.col("end_b1")) & (F.col("b2") == F.col("end_b2"))
    inner = F.coalesce(last, F.lit(False))
    early = (F.col("b1") < F.col("end_b1")) | ((F.col("b1") == F.col("end_b1")) & (F.col("b2") < F.col("end_b2")))
    done = placed.where(~inner).select("doc_id", "src", "size", "whole", F.coalesce(early, F.lit(False)).alias("more"))
    met = placed.where(inner).select("doc_id", "src", "size", "whole", "z", "lacking").groupBy("src").applyInArrow(_filled, "doc_id long, src string, size long, whole long, more boolean")
    taken = F.col("size") * (F.col("whole") + F.col("more").cast("long"))
    source = F.when(F.col("src") != "", F.substr("src", F.lit(2)))
    return _beside(done.unionByName(met).withColumn("taken", taken), goals).select("doc_id", source.alias("source"), "size", "source_size", "target", "taken")
