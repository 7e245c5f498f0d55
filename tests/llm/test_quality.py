"""Co-training: against a plain version in numpy, and that it never harms."""

import random

import numpy as np
import pytest
from quillspark.llm import quality

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n, seed, noise=0.1, bad=0.3):
    """(rows, labels): both views tell the class, the page's source for some pages only, and both are wrong now and then."""
    draw = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        y = int(draw.random() >= bad)
        words = draw.choices([f"word{k}" for k in range(500)], k=60) if (y if draw.random() >= noise else not y) else draw.choices(["BUY", "now", "$$$", "1234"], k=60)
        source = draw.choice(["web", "forum"]) if draw.random() < 0.4 else ("books" if (y if draw.random() >= noise else not y) else "spam")
        rows.append((i, " ".join(words), draw.choice(["en", None]), source, len(words)))
        truth[i] = y
    return rows, truth


def auc(score, truth, ids):
    good, bad = ([score[i] for i in ids if truth[i] == c] for c in (1, 0))
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]))


def plain_rounds(mine, held, y, y_held, pool, rounds):
    """Co-training over whole arrays: gradient ascent by Newton's method with halved steps, view by view."""
    prob = lambda x, w: 1 / (1 + np.exp(-(x @ w)))
    loss = lambda x, t, c, w, ridge: sum(c * (t * np.log(prob(x, w)) + (1 - t) * np.log(1 - prob(x, w)))) - 0.5 * (ridge * sum(w[:-1] ** 2) + 1e-6 * w[-1] ** 2)

    def climbed(x, t, c, ridge, w, steps):
        r = np.append(np.full(len(w) - 1, ridge), 1e-6)
        best, step = None, np.zeros(len(w))
        for _ in range(steps):
            value = loss(x, t, c, w + step, ridge)
            if best is not None and value < best:
                step = step / 2
                continue
            w, best, p = w + step, value, prob(x, w + step)
            step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + np.diag(r), x.T @ (c * (t - p)) - r * w)
        return w

    one = lambda x, t: climbed(x, t, np.ones(len(t)), quality.RIDGE * len(t), np.zeros(x.shape[1]), 60)
    weights = [one(x, y) for x in mine]
    for _ in range(rounds):
        sure = []
        for me in (0, 1):
            scale = one(quality._with_one((held[me] @ weights[me])[:, None]), y_held)
            sure.append(prob(quality._with_one((pool[me] @ weights[me])[:, None]), scale))
        new = []
        for me in (0, 1):
            x, t, c = mine[me], y, np.ones(len(y))
            for label, some in ((0.0, sure[1 - me] <= 1 - quality.CONFIDENT), (1.0, sure[1 - me] >= quality.CONFIDENT)):
                if some.any():
                    x, t = np.concatenate((x, pool[me][some])), np.concatenate((t, np.full(some.sum(), label)))
                    c = np.concatenate((c, np.full(some.sum(), quality.TRUST * (y == label).sum() / some.sum())))
            new.append(climbed(x, t, c, quality.RIDGE * (1 + quality.TRUST) * len(y), weights[me], quality.STEPS))
        plain = lambda x, w: loss(x, y_held, np.ones(len(y_held)), w, 0.0) + 0.5e-6 * w[-1] ** 2
        better = [plain(held[me], new[me]) > plain(held[me], weights[me]) for me in (0, 1)]
        weights = [n if ok else w for n, w, ok in zip(new, weights, better, strict=True)]
        if not any(better):
            break
    return weights


def test_rounds_against_plain(spark):
    rows, truth = corpus(1500, 3)
    docs = spark.createDataFrame(rows, KINDS).repartition(5)
    labels = spark.createDataFrame([(i, truth[i]) for i in range(120)], "doc_id long, quality int")
    table = quality.features(docs, labels)
    known = table.where("y is not null").orderBy("doc_id").collect()
    v = np.frombuffer(b"".join(r.v for r in known), "<f4").reshape(len(known), -1).astype(float)
    y = np.array([r.y for r in known])
    pool = table.where("y is null").select("v")
    got = quality.fit(*quality._split(v), y, pool, rounds=2)
    held, train = quality._folds(y)
    views = [quality._with_one(x) for x in quality._split(quality.shaped(v, got.shape))]
    far = [quality._with_one(x) for x in quality._split(quality.shaped(quality._features(pool.toArrow().column("v").combine_chunks()), got.shape))]
    want = plain_rounds([x[train] for x in views], [x[held] for x in views], y[train].astype(float), y[held].astype(float), far, 2)
    alone = quality.fit(*quality._split(v), y, None)
    assert np.allclose(got.text, want[0], atol=1e-5) and np.allclose(got.meta, want[1], atol=1e-5)
    assert not (np.allclose(got.text, alone.text) and np.allclose(got.meta, alone.meta))  # the pool taught something


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_pool_does_not_harm(spark, seed):
    rows, truth = corpus(1200, seed, noise=0.05)
    docs = spark.createDataFrame(rows, KINDS).repartition(4)
    labels = spark.createDataFrame([(i, truth[i]) for i in range(60)], "doc_id long, quality int")
    table = quality.features(docs, labels)
    known, every = table.where("y is not null").orderBy("doc_id").collect(), table.collect()
    array = lambda found: np.frombuffer(b"".join(r.v for r in found), "<f4").reshape(len(found), -1).astype(float)
    y, rest = np.array([r.y for r in known]), [i for i in truth if i >= 60]
    by = {}
    for rounds in (0, 3, 10):
        model = quality.fit(*quality._split(array(known)), y, table.where("y is null").select("v"), rounds=rounds)
        by[rounds] = auc(dict(zip((r.doc_id for r in every), model.scores(array(every))[2], strict=True)), truth, rest)
        assert max(np.abs(model.text).max(), np.abs(model.meta).max()) < 20
    assert by[3] >= by[0] - 0.005 and by[10] >= by[0] - 0.005 and by[3] > 0.9


def test_few_labels_of_a_class(spark):
    """Every class with two labels is held out in part; with one, training rows calibrate; with none, all are kept."""
    rows, truth = corpus(300, 5, noise=0.0)
    docs = spark.createDataFrame(rows, KINDS)
    good, bad = ([i for i, y in truth.items() if y == c] for c in (1, 0))
    for n_bad in (6, 2, 1):
        labels = spark.createDataFrame([(i, 1) for i in good[:76]] + [(i, 0) for i in bad[:n_bad]], "doc_id long, quality int")
        found = quality.quality_report(docs, labels).collect()
        assert auc({r.doc_id: r.score for r in found}, truth, list(truth)) > 0.95
    some = quality._folds(np.array([1] * 76 + [0] * 6))
    assert [np.sum(f >= 76) for f in some] == [2, 4]
    assert quality.fit(np.ones((3, quality.TEXT_WIDTH)), np.ones((3, 43)), np.array([1, 1, 1])) is None


def test_ties_long_texts_and_clashing_names(spark):
    rows, truth = corpus(80, 7, noise=0.0)
    more = [(900, "word1 " * 200_000, "en", "books", None), (901, None, None, None, None), (902, "", "en", "spam", -5), *[rows[0]] * 3]
    docs = spark.createDataFrame([(*r, True, 7.0) for r in [*rows, *more]], KINDS + ", kept boolean, score double")
    labels = spark.createDataFrame([*truth.items(), (0, 1 - truth[0]), (None, 1), (5, None), (77777, 1)], "doc_id long, quality int")
    found = quality.score(docs, quality.train(quality.features(docs, labels)))
    assert found.columns.count("kept") == 1 and found.columns.count("score") == 1
    got = found.collect()
    assert len(got) == 86 and len({(r.score, r.kept) for r in got if r.doc_id == 0}) == 1
    assert all(0 <= r.score <= 1 for r in got)
    # a table without a labelled document
    assert {(r.score, r.kept) for r in quality.quality_report(docs.where("doc_id > 899"), labels).collect()} == {(0.5, True)}
