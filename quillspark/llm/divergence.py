"""Operator 11: an audit of how the sources of a language diverge in their terms.

A term's share in a group (a source within a language) is a whole number out of `SCALE`,
smoothed; two shares p and q differ by (p - q)^2 / (p + q), rounded down. Two groups differ by
the sum over all terms that the language keeps, whether they occur in the groups or not.

Heavy-light split: a term that at least `HEAVY` of a language's groups hold is a row of a
dense numpy tile, in which all pairs of groups are summed at once. A rare term is a short
posting list. Were it absent everywhere, each pair would differ by a constant; what a count
in one group changes against groups without the term hangs on the count alone and is summed
from a table of counts; a correction for each pair of postings adds what both counts change
together. All are whole numbers (at most 2 * SCALE a pair in all), and both parts are added exactly.

Tasks count terms with their documents before anything is shuffled. Counts meet by language,
source and term, then, a number for each source, by language and term. Kept terms are
dealt into blocks of about `POSTINGS` postings (or as many as a language has pairs of groups,
up to `MOST_POSTINGS`); each block meets the totals of its language's groups and
gives a row for each pair of groups and the `TOP` terms of each group. The result has a row
for each pair, so the table of groups is as its square root.

Defined results: a null text, language or source counts as empty; an empty table gives an
empty result; a language that keeps no term gives pairs of value 0; repeated rows count each,
as documents of their own; further columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE, LEAST_DOCS, TOP, HEAVY = 1_000_000_000, 10, 10, 0.5
POSTINGS, MOST_POSTINGS = 1 << 16, 1 << 22
#: Different terms that a task holds before it hands their counts on, and numbers in a tile.
HELD, TILE = 500_000, 1 << 20
#: Every byte that is no letter of the alphabet and not beyond ASCII separates terms.
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
COUNTS = "lang string, source string, term binary, n long, docs long"


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_LETTERS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and documents of each term by language and source, and an empty term for each group."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            words = [b"", *n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words), pa.string()), pa.array([source] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found = terms(text)
            size -= len(n)
            n.update(found)
            docs.update(set(found))
            size += len(n)
            if size >= HELD:
                yield from out()
                held, size = {}, 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: how often and in how many documents a term stands in a group; an empty term stands for the group itself."""
    words = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return words.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), digit by digit so that no product exceeds 64 bits."""
    over = np.maximum(totals + 2 * kept, 1)
    whole, rest = np.divmod(counts + 2, over)
    step = 1000
    for _ in range(3):
        more, rest = np.divmod(rest * step, over)
        whole = whole * step + more
    return whole + 1


assert SCALE == 1000**3


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _dense(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """Sums over the terms of a tile (a row for each term, a column for each group) for all pairs of groups."""
    p, out = shares(counts, totals, kept), np.zeros((len(totals), len(totals)), np.int64)
    for g in range(len(totals) - 1):
        out[g, g + 1 :] = divergence(p[:, g, None], p[:, g + 1 :]).sum(axis=0)
    return out + out.T


def _sparse(term: np.ndarray, group: np.ndarray, count: np.ndarray, n_terms: int, totals: np.ndarray, kept: int) -> np.ndarray:
    """The same sums for `n_terms` rare terms from their postings (sorted by term)."""
    n = len(totals)
    absent = shares(np.zeros(n, np.int64), totals, kept)
    base = divergence(absent[:, None], absent[None, :])
    out = base * n_terms
    # one count against groups without the term: by group and count
    cells, times = np.unique(np.stack((group, count)), axis=1, return_counts=True)
    for at in range(0, cells.shape[1], max(1, TILE // n)):
        g, c = cells[:, at : at + max(1, TILE // n)]
        alone = (divergence(shares(c, totals[g], kept)[:, None], absent[None, :]) - base[g]) * times[at : at + len(g), None]
        np.add.at(out, g, alone)
        np.add.at(out.T, g, alone)
    # pairs of postings of one term
    p = shares(count, totals[group], kept)
    first, sizes = np.unique(term, return_index=True, return_counts=True)[1:]
    for k in np.unique(sizes):
        i, j = np.triu_indices(k, 1)
        some = first[sizes == k]
        for at in range(0, len(some) if k > 1 else 0, max(1, TILE // len(i) if len(i) else 1)):
            rows = some[at : at + max(1, TILE // len(i))]
            x, y = rows[:, None] + i, rows[:, None] + j
            a, b = group[x], group[y]
            both = divergence(p[x], p[y]) - divergence(p[x], absent[b]) - divergence(absent[a], p[y]) + base[a, b]
            np.add.at(out, (a, b), both)
            np.add.at(out, (b, a), both)
    return out


def pair_sums(term: np.ndarray, group: np.ndarray, count: np.ndarray, n_terms: int, totals: np.ndarray, kept: int, heavy: float = HEAVY) -> np.ndarray:
    """For all pairs of groups the summed divergence over `n_terms` terms with these postings (sorted by term)."""
    n = len(totals)
    sizes = np.bincount(term, minlength=n_terms)
    dense = sizes >= max(2, heavy * n)
    out, many = np.zeros((n, n), np.int64), np.flatnonzero(dense)
    step = max(1, TILE // n)
    for at in range(0, len(many), step):
        row = np.full(n_terms, -1)
        row[many[at : at + step]] = np.arange(len(many[at : at + step]))
        some = row[term] >= 0
        tile = np.zeros((len(many[at : at + step]), n), np.int64)
        tile[row[term[some]], group[some]] = count[some]
        out += _dense(tile, totals, kept)
    rare = ~dense[term]
    out += _sparse(term[rare], group[rare], count[rare], n_terms - len(many), totals, kept)
    np.fill_diagonal(out, 0)
    return out


PARTS = "lang string, source string, part string, item string, value long"


def _block(top: int, heavy: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("source")
        lang, kept = right.column("lang")[0].as_py(), right.column("kept")[0].as_py()
        sources, totals = right.column("source").to_pylist(), right.column("total").to_numpy()
        # postings of the block, by term
        words = left.column("term").to_pylist()
        lists = left.column("postings").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        flat = lists.flatten() if len(words) else pa.array([], pa.struct([("source", pa.string()), ("n", pa.int64())]))
        number = {s: i for i, s in enumerate(sources)}
        group = np.fromiter(map(number.__getitem__, flat.field(0).to_pylist()), np.int64, len(flat))
        count, term = flat.field(1).to_numpy(), np.repeat(np.arange(len(words)), sizes)
        sums = pair_sums(term, group, count, len(words), totals, kept, heavy)
        a, b = np.triu_indices(len(sources), 1)
        rows = [[sources[i] for i in a], ["pair"] * len(a), [sources[i] for i in b], sums[a, b].tolist()]
        # the block's terms that lead in each group
        whole = np.bincount(term, count, len(words)).astype(np.int64) if count.sum() < 1 << 53 else np.array([int(c.sum()) for c in np.split(count, np.cumsum(sizes)[:-1])])
        p, q = shares(count, totals[group], kept), shares(whole, totals.sum(), kept)[term]
        value, place = divergence(p, q), np.empty(len(words), np.int64)
        place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        at = np.flatnonzero(p > q)
        at = at[np.lexsort((place[term[at]], -value[at], group[at]))]
        begins = np.searchsorted(group[at], np.arange(len(sources)))
        at = at[np.arange(len(at)) - begins[group[at]] < top]
        for column, more in zip(rows, ([sources[i] for i in group[at]], ["term"] * len(at), [words[i].decode() for i in term[at]], value[at].tolist()), strict=True):
            column += more
        return pa.table([pa.array([lang] * len(rows[0]), pa.string()), *(pa.array(r, pa.string()) for r in rows[:3]), pa.array(rows[3], pa.int64())], names=["lang", "source", "part", "item", "value"])

    return run


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, heavy: float = HEAVY, postings: int = POSTINGS) -> DataFrame:
    """lang, source, part, item, value, rank of `docs` (lang, source, text): each other source of the language with how far it diverges, and the leading terms."""
    counts = materialize(term_counts(docs))
    by_term = counts.where(F.octet_length("term") > 0).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("postings"))
    kept = materialize(by_term.where(F.col("docs") >= least_docs).select("lang", "term", "postings"))
    totals = kept.select("lang", F.inline("postings")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where(F.octet_length("term") == 0).select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    groups = materialize(groups.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left").fillna(0, ["kept"]))

    sizes = kept.agg(F.coalesce(F.sum(F.size("postings")), F.lit(0)).alias("n")).first().n
    most = groups.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first().n
    blocks = -(-sizes // min(max(postings, most * most), MOST_POSTINGS)) or 1
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    copies = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    parts = dealt.groupBy("lang", "block").cogroup(copies.groupBy("lang", "block")).applyInArrow(_block(top, heavy), PARTS)
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    one, other = F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))
    both = summed.select("lang", "part", "value", F.inline(F.when(F.col("part") == "pair", F.array(one, other)).otherwise(F.array(one))))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
