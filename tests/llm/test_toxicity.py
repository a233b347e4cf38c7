import random

import numpy as np

from stratagrid.llm import text as tx
from stratagrid.llm import toxicity as op

from . import helpers as h


def labelled(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = rng.choice([0, 0, 0, 1, 2])
        words = h.prose(rng, rng.randint(20, 80)).split()
        for _ in range(3 * g):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "vileness", "rotten", "Scum!"]))
        rows.append((i, " ".join(words), g))
    return rows


def test_held_out_severity(spark):
    train, rest = labelled(1, 500), labelled(2, 200)
    model = op.fit(h.table(spark, [r[:2] for r in train]), spark.createDataFrame([(r[0], r[2]) for r in train], "doc_id bigint, grade int"))
    assert np.all(np.diff(model.cuts) > 0)
    got = {r.doc_id: r for r in op.score(h.table(spark, [r[:2] for r in rest]), model).collect()}
    toxic = [got[i].toxic for i, _, g in rest if g]
    clean = [got[i].toxic for i, _, g in rest if not g]
    assert np.mean(toxic) > 0.95 and np.mean(clean) < 0.02
    mean = [np.mean([got[i].severity for i, _, g in rest if g == k]) for k in range(3)]
    assert mean[0] < 0.2 < mean[1] < mean[2]
    for r in got.values():
        assert r.above[0] >= r.above[1] and abs(sum(r.above) - r.severity) < 1e-9 and 0 <= r.grade <= 2


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "vile " * 10), (3, "vile " * 10), (None, "x")]
    labels = spark.createDataFrame([(3, 1), (3, 2), (None, 1), (9, 1), (1, None)], "doc_id bigint, grade int")
    model = op.fit(h.table(spark, rows), labels)
    assert len(op.score(h.table(spark, rows), model).collect()) == 5
    empty = op.fit(h.table(spark, []), labels.limit(0))
    got = op.score(h.table(spark, rows), empty, carry=["doc_id", "toxic"][:1]).collect()
    assert len(got) == 5 and not any(r.toxic for r in got)
    assert op.score(h.table(spark, []), empty).collect() == []


def test_the_sample_is_bounded_and_stable(spark):
    rows = labelled(3, 300)
    docs, labels = h.table(spark, [r[:2] for r in rows]), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, grade int")
    a, b = (op.fit(d, labels, max_labelled=100) for d in (docs, docs.repartition(3)))
    assert np.count_nonzero(a.weights) and np.allclose(a.weights, b.weights, atol=1e-4)


def loss(theta, x, grades, l2, n_grades=3):
    """Penalised negative log likelihood of cuts theta[-2:] and weights, row by row."""
    w, cuts = theta[: x.shape[1]], [-np.inf, *np.sort(theta[x.shape[1] :]), np.inf]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    total = l2 / 2 * (w @ w)
    for row, g in zip(x, grades, strict=True):
        total -= np.log(max(sig(cuts[g + 1] - row @ w) - sig(cuts[g] - row @ w), 1e-300))
    return total


def test_the_fit_is_a_minimum_of_the_plain_likelihood():
    rng = np.random.default_rng(3)
    x = (rng.random((400, 6)) < 0.4) * rng.uniform(1, 2, (400, 6))
    grades = np.digitize(x @ np.array([2.0, -1.5, 1.0, 0.0, 0.5, -0.5]) + rng.logistic(size=400), [0.5, 2.5])
    row, at = np.nonzero(x)
    model = op.fit_cells(grades, at.astype(np.int64), x[row, at], np.bincount(row, minlength=400), deviations=0.0, steps=3000, rate=0.02)
    theta = np.concatenate([model.weights[:6].astype(float), model.cuts])
    best = loss(theta, x, grades, 0.1)
    slope = [(loss(theta + e, x, grades, 0.1) - loss(theta - e, x, grades, 0.1)) / 2e-4 for e in np.eye(8) * 1e-4]
    assert np.abs(slope).max() < 0.05, slope
    for _ in range(50):  # no better place near by
        assert loss(theta + rng.normal(scale=0.05, size=8), x, grades, 0.1) >= best - 1e-6


def plain_features(text):
    """Counts of hashed words and beginnings, by the row."""
    low = bytes(32 if op.MARKS[b] else b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    out = {}
    for w in h.blank_words(low.decode()):
        for part, stem in [(w, False), *((w[:n], True) for n in op.STEMS if len(w) > n)]:
            k = tx.word_hashes(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]))
            k = tx.mix(k ^ tx.U64(0x5354454D)) if stem else k
            k = int(k[0]) >> (64 - op.BITS)
            out[k] = out.get(k, 0) + 1
    return out


def test_scores_equal_a_plain_version(spark):
    rng = np.random.default_rng(4)
    model = op.Model(rng.normal(scale=0.1, size=1 << op.BITS).astype(np.float32), np.array([1.0, 2.5]))
    rows = h.corpus(14) + [(950, "vile, VILE! vileness " * 30_000)]
    got = sorted((str(r.doc_id), r.severity) for r in op.score(h.table(spark, rows), model).collect())
    want = []
    for i, t in rows:
        z = sum(float(model.weights[k]) * float(np.float32(1 + np.log(n))) for k, n in plain_features(t).items())
        want.append((str(i), sum(1 / (1 + np.exp(c - z)) for c in model.cuts)))
    assert [i for i, _ in got] == [i for i, _ in sorted(want)]
    assert np.allclose([s for _, s in got], [s for _, s in sorted(want)], atol=1e-6)


def test_the_bound_of_features_does_not_depend_on_order(spark):
    rows = labelled(6, 200) + [(7, "word" + " vile" * 100_000, 2)] * 3
    docs, labels = h.table(spark, [r[:2] for r in rows]), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, grade int")
    a, b, all_ = (op.fit(d, labels, max_features=n) for d, n in ((docs, 20_000), (docs.repartition(5), 20_000), (docs, 10**9)))
    assert np.array_equal(a.weights, b.weights) and not np.array_equal(a.weights, all_.weights)
