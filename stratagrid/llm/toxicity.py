"""Severity of toxic language by cumulative-link (proportional odds) regression on sparse text features.

P(grade <= k) = logistic(cut[k] - w . x): all thresholds share the weights w, and the cuts ascend. Features are hashed
words and hashed beginnings of words (of 4 to 7 bytes), weighted 1 + log(count). The score is the expected grade, sum over k of
P(grade > k). Weights have a fixed size (2 ** BITS floats), so they go to the executors as they are.

Fitting uses at most `max_labelled` labels, those with the least hash of their key, one text for each, and of these texts,
in the same order, so many that they have at most `max_features` features in all; a text has at most 2 ** BITS. Both
bounds hold before anything comes to the driver. Scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared, text as tx

BITS = 18
STEMS = (4, 5, 6, 7)
MAX_LABELLED, MAX_FEATURES = 4000, 8_000_000
GRADES = 3
#: Bytes that are no part of a word here, besides white space: ASCII punctuation.
MARKS = np.zeros(256, bool)
MARKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of some rows in turn, and how many each row has."""
    low = tx.lower_ascii(buf)
    low = np.where(MARKS[low], np.uint8(32), low)
    starts, ends, ptr = tx.words(low, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(ptr))
    keys, rows = [tx.word_hashes(low, starts, ends)], [row]
    for n in STEMS:
        longer = np.flatnonzero(ends - starts > n)
        keys.append(tx.mix(tx.word_hashes(low, starts[longer], starts[longer] + n) ^ tx.U64(0x5354454D)))
        rows.append(row[longer])
    key = np.concatenate(keys) >> tx.U64(64 - BITS)
    key |= np.concatenate(rows).astype(tx.U64) << tx.U64(BITS)
    key, count = np.unique(key, return_counts=True)
    rows = (key >> tx.U64(BITS)).astype(np.int64)
    return (key & tx.U64((1 << BITS) - 1)).astype(np.int64), (1 + np.log(count)).astype(np.float32), np.bincount(rows, minlength=len(off) - 1)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, buf, off in tx.slices(b.column("text")):
            at, value, n = features(buf, off)
            offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (at.astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in ("place", "grade")), pa.array(n.astype(np.int64)), *lists], ["place", "grade", "n", "at", "value"])


class Model:
    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def above(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """P(grade > k) by row and k."""
        at, value, n = features(buf, off)
        score = np.zeros(len(n))
        np.add.at(score, np.repeat(np.arange(len(n)), n), value * self.weights[at])
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -60, 60)))


def fit_cells(grades: np.ndarray, at: np.ndarray, value: np.ndarray, counts: np.ndarray, n_grades: int = GRADES, min_texts: int = 5, deviations: float = 4.0, l2: float = 0.1, steps: int = 300, rate: float = 0.05) -> Model:
    """Penalised maximum likelihood by Adam, over all rows at each step. Rows: grade, number of cells; cells in turn.

    Features have a weight if min_texts rows or more have them and the share of graded rows (over 0) that have them differs
    from that of the rest by more than so many standard deviations: rare words of a few texts tell nothing.
    """
    n, row = len(grades), np.repeat(np.arange(len(grades)), counts)
    bad = grades > 0
    n1, n0 = max(bad.sum(), 1), max((~bad).sum(), 1)
    with_it, with_bad = np.bincount(at, minlength=1 << BITS), np.bincount(at, bad[row], minlength=1 << BITS)
    share = with_it / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    telling = (np.abs(with_bad / n1 - (with_it - with_bad) / n0) > deviations * spread) & (with_it >= min_texts)
    at, value, row = at[telling[at]], value[telling[at]], row[telling[at]]
    used, at = np.unique(at, return_inverse=True)
    value = value.astype(np.float64)
    w = np.zeros(len(used))
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / max(n, 1), 0.5 / max(n, 1), 1 - 0.5 / max(n, 1))
    free = np.log(share / (1 - share))  # the first cut, then logs of the distances between cuts
    free[1:] = np.log(np.maximum(np.diff(free), 1e-2)) if n_grades > 2 else free[1:]
    theta = np.concatenate([w, free])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for t in range(1, steps + 1):
        w, free = theta[: len(used)], theta[len(used) :]
        gaps = np.exp(free[1:])
        cuts = free[0] + np.append(0, np.cumsum(gaps))
        score = np.bincount(row, value * w[at], n)
        p = logistic(np.concatenate([cuts, [60.0]])[grades] - score)  # P(<= grade)
        q = np.where(grades > 0, logistic(np.concatenate([[-60.0], cuts])[grades] - score), 0.0)  # P(< grade)
        p = np.where(grades == n_grades - 1, 1.0, p)
        mass = np.maximum(p - q, 1e-12)
        dp, dq = p * (1 - p) / mass, q * (1 - q) / mass
        dscore = dp - dq  # of the negative log likelihood
        dcut = np.zeros(n_grades - 1)
        np.add.at(dcut, np.minimum(grades, n_grades - 2), np.where(grades < n_grades - 1, -dp, 0))
        np.add.at(dcut, np.maximum(grades - 1, 0), np.where(grades > 0, dq, 0))
        tail = np.cumsum(dcut[::-1])[::-1]
        grad = np.concatenate([np.bincount(at, value * dscore[row], len(used)) + l2 * w, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    full = np.zeros(1 << BITS, np.float32)
    full[used] = theta[: len(used)]
    return Model(full, theta[len(used)] + np.append(0, np.cumsum(np.exp(theta[len(used) + 1 :]))))


def grade(toxic: Column, quality: Column) -> Column:
    """0 for harmless texts, 1 for toxic ones, 2 for toxic ones that are worthless besides; null without a label."""
    return F.when(toxic == 0, 0).when(toxic == 1, F.when(quality == 0, 2).otherwise(1))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "grade", max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> Model:
    """labels: key and grade, 0 .. GRADES - 1. The `max_labelled` labels with the least hash of their key are used.

    Null keys, grades and texts are left out; of repeated labels the highest counts, of a key's texts the least. Without
    rows, all is harmless. The fit does not depend on the order of rows.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    each = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("grade")).where("key IS NOT NULL AND grade IS NOT NULL").groupBy("key").agg(F.max("grade").alias("grade"))
    chosen = each.withColumn("place", F.xxhash64("key")).orderBy("place", "key").limit(max_labelled)
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "key")  # max_labelled rows
    sample = found.groupBy("key", "place", "grade").agg(F.min("text").alias("text")).select("place", "grade", "text")
    cells = shared.materialise(sample.mapInArrow(_cells, "place bigint, grade int, n bigint, at array<int>, value array<float>"), "cells", 8)
    # at most max_labelled rows
    within = cells.select("place", F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)).alias("sum")).where(F.col("sum") <= max_features)
    got = cells.join(F.broadcast(within), "place").orderBy("place").select("grade", "n", "at", "value").toArrow()
    grades, n = (np.array(got.column(c).to_pylist(), np.int64) for c in ("grade", "n"))
    at, value = (pc.list_flatten(got.column(c)).to_numpy() for c in ("at", "value"))
    if not len(grades):
        return Model(np.zeros(1 << BITS, np.float32), np.full(GRADES - 1, 9.0))
    return fit_cells(grades, at.astype(np.int64), value, n)


def _score(weights: bytes, cuts: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(np.frombuffer(weights, np.float32), np.array(cuts))
        for b in batches:
            for i, j, buf, off in tx.slices(b.column("text")):
                above = model.above(buf, off)
                k = above.shape[1]
                offsets = pa.array(np.arange(j - i + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([b.column("carry").slice(i, j - i), pa.ListArray.from_arrays(offsets, pa.array(above.ravel())), pa.array(above.sum(axis=1))], ["carry", "above", "severity"])

    return tx.trimmed(run)


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None, limit: float = 0.35) -> DataFrame:
    """The columns in carry (default doc_id), above (P(grade > k) by k), severity (the expected grade), grade (the most
    likely one) and toxic (P(grade > 0) over limit), a row for each of docs. Null and empty texts have no features and
    the severity of an average text; they are not toxic where most labelled ones are not."""
    shared.prepare(docs.sparkSession)
    rows = docs.select(F.struct(*(carry or ["doc_id"])).alias("carry"), F.col(text).alias("text"))
    kind = rows.schema["carry"].dataType.simpleString()
    out = rows.mapInArrow(_score(model.weights.tobytes(), [float(c) for c in model.cuts]), f"carry {kind}, above array<double>, severity double")
    bounds = F.concat(F.array(F.lit(1.0)), "above", F.array(F.lit(0.0)))
    mass = F.transform(F.sequence(F.lit(1), F.size("above") + 1), lambda k: F.element_at(bounds, k) - F.element_at(bounds, k + 1))
    return out.select("carry.*", "above", "severity", (F.array_position(mass, F.array_max(mass)) - 1).cast("int").alias("grade"), (F.element_at("above", 1) > limit).alias("toxic"))
