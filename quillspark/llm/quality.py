"""Operator 5: document quality by co-training two views.

The text view sees what a text is made of (shares of characters, repetition of
words), the metadata view what is known about the page besides its text
(language, source, stated length). Each is a logistic regression over features that
are centred, scaled and bounded. Both begin with labelled rows. In each of `ROUNDS`
rounds each view labels all documents that have no label, and those it is confident
about, by calibrated probability, teach the other: a pass over the table of features
gives each class's likelihood, gradient and curvature, a few thousand numbers a task
that are added up on the way to the driver, for each of `STEPS` Newton steps. Whatever
their number, a class's pseudo-labels weigh `TRUST` times what its labelled rows do, and
the ridge grows with the weight of all rows. A step that lowers the penalised likelihood
is halved and tried again; a view that is less likely on held-out labelled rows after a
round is left as it was, and the rounds end when none gains. Calibration uses the same
held-out rows, every fifth of each class, and a regression over the two calibrated
views gives the score.

The documented bound is on labelled rows: at most `MAX_LABELLED` of them, those
with the least hash of their doc_id, one row for each doc_id, reach the driver as
some ninety numbers each. The unlabelled pool has no bound and is never sampled.
Features are computed once and written, a tenth of the input; scoring is one pass.

Defined results: a null text counts as empty; null metadata is a value of its
own; of several labels for a document the least counts, and of several rows for
a labelled document the one with the least features; where a class has a single label,
calibration uses the rows of training; where the labels hold only one class (or none)
every score is 0.5 and every document is kept; repeated rows give repeated results; an
empty table gives an empty result; further columns of the input are ignored, or kept by
`score`, where those of its own names give way.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_LABELLED = 20_000
ROUNDS, STEPS, CONFIDENT, TRUST = 3, 4, 0.97, 1.0
HELD_OUT = 5  # every fifth labelled row of a class calibrates
RIDGE = 1e-2  # for a weight of one
#: A feature lies within so many standard deviations of the labelled rows' mean.
FAR = 5.0
#: Sums that one task adds up.
FAN_IN = 16

_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]


def text_view(text: str) -> np.ndarray:
    """Shares of character classes and of repeated words, none of which depends on the length alone."""
    data = text.encode("utf-8")
    n = len(data) or 1
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    distinct = len(set(words)) / len(words) if words else 0.0
    pairs = len(set(zip(words, words[1:], strict=False))) / (len(words) - 1) if len(words) > 1 else 0.0
    length = sum(map(len, words)) / len(words) if words else 0.0
    shares = [count[97:123].sum(), count[65:91].sum(), count[48:58].sum(), count[128:].sum(), count[32], *count[_PUNCTUATION]]
    return np.array([distinct, distinct**2, pairs, pairs**2, length / 10, *(math.sqrt(x / n) for x in shares)])


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Language, source and stated length of a page."""
    out = np.zeros(43)
    out[zlib.crc32(repr(lang).encode()) % 8] = 1
    out[8 + zlib.crc32(repr(source).encode()) % 32] = 1
    size = math.log1p(max(0, n_chars)) if n_chars is not None else 0.0
    out[40:] = size / 10, (size / 10) ** 2, n_chars is None
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def likelihood(x: np.ndarray, y: np.ndarray | float, w: np.ndarray) -> float:
    """The log-likelihood of rows that end in a one."""
    m = x @ w
    return float(np.sum(y * m - np.logaddexp(0, m)))


def penalty(w: np.ndarray, ridge: float) -> np.ndarray:
    """The ridge of each weight; the intercept has next to none."""
    return np.append(np.full(len(w) - 1, ridge), 1e-6)


def _step(best: float | None, w: np.ndarray, step: np.ndarray, value: float, g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The best penalised likelihood, its weights and the step to try next, once w + step was evaluated:
    on from there if it is better, else half the step."""
    tried, r = w + step, penalty(w, ridge)
    value -= float(r @ tried**2) / 2
    if best is not None and value < best:
        return best, w, step / 2
    return value, tried, np.linalg.solve(h + np.diag(r), g - r * tried)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights (the last is the intercept) of a regression with a ridge in proportion to the rows."""
    x = _with_one(x)
    best, w, step = None, np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(steps):
        best, w, step = _step(best, w, step, likelihood(x, y, w + step), *_slopes(x, y, w + step), RIDGE * len(x))
        if np.abs(step).max() < 1e-9:
            break
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    """Weights of each view, their calibration (slope, intercept) and the regression over both."""

    shape: np.ndarray  # mean and 1 / deviation of each feature
    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    both: np.ndarray

    def scores(self, views: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, meta = _split(shaped(views, self.shape))
        a = margin(margin(text, self.text)[:, None], self.text_scale)
        b = margin(margin(meta, self.meta)[:, None], self.meta_scale)
        return sigmoid(a), sigmoid(b), sigmoid(margin(np.clip(np.column_stack((a, b)), -20, 20), self.both))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.column_stack((x, np.ones(len(x))))


def _slopes(x: np.ndarray, y: np.ndarray | float, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log-likelihood of rows that end in a one."""
    p = sigmoid(x @ w)
    return x.T @ (y - p), (x * (p * (1 - p))[:, None]).T @ x


def _split(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return v[:, :TEXT_WIDTH], v[:, TEXT_WIDTH:]


def shaped(views: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Features centred, scaled and bounded; those that are constant among the labelled rows vanish."""
    return np.clip((views - shape[0]) * shape[1], -FAR, FAR)


#: A view that teaches: its weights, and slope and intercept of its calibration.
Teacher = tuple[np.ndarray, np.ndarray]


def _sure(view: np.ndarray, teacher: Teacher) -> np.ndarray:
    return sigmoid(margin(margin(view, teacher[0])[:, None], teacher[1]))


def _taught(batches: Iterator[pa.RecordBatch], shape: np.ndarray, teachers: list[Teacher], learners: list[np.ndarray]) -> bytes | None:
    """For each learning view and each class: the rows that the other view is confident about, their likelihood, gradient and curvature."""
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        views = _split(shaped(_features(batch.column(0)), shape))
        sure = [_sure(v, t) for v, t in zip(views, teachers, strict=True)]
        found = []
        for me, other in ((0, 1), (1, 0)):
            x = _with_one(views[me])
            for y, some in ((0.0, sure[other] <= 1 - CONFIDENT), (1.0, sure[other] >= CONFIDENT)):
                g, h = _slopes(x[some], y, learners[me])
                found += [[some.sum(), likelihood(x[some], y, learners[me])], g, h.ravel()]
        found = np.concatenate(found)
        total = found if total is None else total + found
    return None if total is None else total.astype("<f8").tobytes()


def _pool_sums(pool: DataFrame, shape: np.ndarray, teachers: list[Teacher], learners: list[np.ndarray]) -> list[tuple] | None:
    """(n, likelihood, gradient, curvature) of the pseudo-labelled rows of `pool` (v), by view and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _taught(batches, shape, teachers, learners)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([sums], pa.binary())], names=["sums"])

    def added(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x.as_py(), "<f8") for x in table.column("sums")]
        return pa.table({"g": table.column("g").slice(0, 1), "sums": pa.array([np.sum(rows, axis=0).tobytes()], pa.binary())})

    parts = pool.rdd.getNumPartitions()
    sums = pool.mapInArrow(run, "sums binary").withColumn("g", F.spark_partition_id())
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        sums = sums.select("sums", F.floor(F.col("g") / FAN_IN).cast("int").alias("g")).groupBy("g").applyInArrow(added, "g int, sums binary")
    rows = [np.frombuffer(r.sums, "<f8") for r in sums.select("sums").collect()]
    if not rows:
        return None
    total, out, at = np.sum(rows, axis=0), [], 0
    for w in learners:
        d = len(w)
        for _ in range(2):
            out.append((total[at], total[at + 1], total[at + 2 : at + 2 + d], total[at + 2 + d : at + 2 + d + d * d].reshape(d, d)))
            at += 2 + d + d * d
    return out


def _folds(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows held out, every fifth of each class, and rows to train on; the same ones where a class has a single row."""
    each = [np.flatnonzero(label == c) for c in (0, 1)]
    if min(map(len, each)) < 2:
        return np.arange(len(label)), np.arange(len(label))
    held = np.sort(np.concatenate([e[::HELD_OUT] for e in each]))
    return held, np.delete(np.arange(len(label)), held)


def _rounds(shape: np.ndarray, mine: list, held: list, y: np.ndarray, y_held: np.ndarray, pool_sums, rounds: int) -> list[np.ndarray]:
    """Weights of both views after co-training. `pool_sums(shape, teachers, learners)` gives the sums over the pool; rows end in a one."""
    each = [float((y == c).sum()) for c in (0, 1)]
    weights = [logistic(x[:, :-1], y) for x in mine]
    for _ in range(rounds):
        teachers = [(w, logistic((h @ w)[:, None], y_held)) for w, h in zip(weights, held, strict=True)]
        best, steps, values = list(weights), [np.zeros(len(w)) for w in weights], [None, None]
        ridge = RIDGE * (1 + TRUST) * len(y)
        for _ in range(STEPS):  # both views climb in the same passes
            tried = [w + step for w, step in zip(best, steps, strict=True)]
            sums = pool_sums(shape, teachers, tried)
            if sums is None:
                return weights
            for me in (0, 1):
                value, (g, h) = likelihood(mine[me], y, tried[me]), _slopes(mine[me], y, tried[me])
                for c in (0, 1):
                    n, more, more_g, more_h = sums[2 * me + c]
                    if n:
                        scale = TRUST * each[c] / n
                        value, g, h = value + scale * more, g + scale * more_g, h + scale * more_h
                values[me], best[me], steps[me] = _step(values[me], best[me], steps[me], value, g, h, ridge)
        gains = [likelihood(h, y_held, new) > likelihood(h, y_held, old) for h, new, old in zip(held, best, weights, strict=True)]
        weights = [new if ok else old for new, old, ok in zip(best, weights, gains, strict=True)]
        if not any(gains):
            break
    return weights


def fit(text: np.ndarray, meta: np.ndarray, label: np.ndarray, pool: DataFrame | None = None, rounds: int = ROUNDS) -> Model | None:
    """Co-trains on labelled rows and the features `v` of `pool`; None without both classes."""
    if len(np.unique(label)) < 2:
        return None
    held, train = _folds(label)
    rows = np.column_stack((text, meta))
    deviation = rows[train].std(axis=0)
    shape = np.stack((rows[train].mean(axis=0), np.where(deviation > 1e-9, 1 / np.maximum(deviation, 1e-9), 0.0)))
    views = [_with_one(v) for v in _split(shaped(rows, shape))]
    y, y_held = label[train].astype(float), label[held].astype(float)
    mine, out = [v[train] for v in views], [v[held] for v in views]
    weights = _rounds(shape, mine, out, y, y_held, lambda *how: _pool_sums(pool, *how), rounds if pool is not None else 0)
    margins = [v @ w for v, w in zip(out, weights, strict=True)]
    scales = [logistic(m[:, None], y_held) for m in margins]
    calibrated = np.column_stack([np.clip(margin(m[:, None], s), -20, 20) for m, s in zip(margins, scales, strict=True)])
    return Model(shape, *weights, *scales, logistic(calibrated, y_held))


TEXT_WIDTH = len(text_view(""))


def _features(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), -1).astype(float)


def _views(batch: pa.RecordBatch) -> np.ndarray:
    metas = zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)
    return np.array([np.concatenate((text_view(x.as_py() or ""), meta_view(*m))) for x, m in zip(batch.column("text"), metas, strict=True)]).astype("<f4")


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, y (the label, or null) and v (both views as floats) of each row of `docs`, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([v.tobytes() for v in _views(batch)], pa.binary())], names=["doc_id", "v"])

    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    found = docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, "doc_id long, v binary")
    return materialize(found.join(known, "doc_id", "left"))


def train(rows: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """Fits on a bounded sample of the labelled rows and on all unlabelled ones of `features`."""
    known, draw = rows.where("y in (0, 1)"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    n = known.select("doc_id").distinct().count()
    # a little more than the bound goes through the sort, so that no task sends the driver its own largest part
    known = known.where(draw < int((1 << 30) * min(1.0, 1.1 * max_labelled / max(n, 1))))
    some = known.groupBy("doc_id").agg(F.min(F.struct("v", "y")).alias("x"))
    found = some.orderBy(draw, "doc_id").limit(max_labelled).select("x.*").collect()
    if not found:
        return None
    text, meta = _split(np.frombuffer(b"".join(r.v for r in found), "<f4").reshape(len(found), -1).astype(float))
    return fit(text, meta, np.array([r.y for r in found]), rows.where("y is null").select("v"))


def _scored(model: Model | None, views: np.ndarray, threshold: float) -> list[pa.Array]:
    three = [np.full(len(views), 0.5)] * 3 if model is None else model.scores(views.astype(float))
    return [*map(pa.array, three), pa.array(three[2] >= threshold)]


KINDS = "text_score double, meta_score double, score double, kept boolean"
KIND_NAMES = [k.split()[0] for k in KINDS.split(", ")]


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """`docs` with text_score, meta_score, score and kept. It has doc_id, text, lang, source and n_chars."""
    docs = docs.drop(*KIND_NAMES)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", " + KINDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *_scored(model, _views(batch), threshold)], names=[*batch.schema.names, *KIND_NAMES])

    return docs.mapInArrow(run, schema)


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The scores of every document."""
    rows = features(docs, labels)
    model = train(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *_scored(model, _features(batch.column(1)), threshold)], names=["doc_id", *KIND_NAMES])

    return rows.select("doc_id", "v").mapInArrow(run, "doc_id long, " + KINDS)
