"""Toxicity by cumulative-link ordinal regression.

One weight vector over sparse text features is shared by all thresholds:
``P(grade > k) = sigmoid(w.x - b_k)`` with ``b_0 < b_1 < ...``.  The expected severity
is the sum of these probabilities.  The model is fitted in numpy on the hashed words of a
bounded sample of labelled rows; every document is then scored inside ``mapInArrow`` by hashing its words
and adding their weights: no shuffle, memory bounded by one chunk of text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, chunks, pick

BITS = 18                   # 2**BITS hashed features
SAMPLE = 20_000             # most labelled rows the fit uses
MIN_DOCS = 5                # a feature of fewer sampled documents is left out
PUNCTUATION = b".,;:!?\"'()[]{}|#$%&*<>"
_STRIP = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text number) pairs: the distinct hashed lower-case words of each text."""
    w = Words([t.translate(_STRIP) for t in texts], lower=True)
    feature = (w.hashes >> np.uint64(64 - BITS)).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(w.bounds))
    pairs = np.unique((row << BITS) | feature)
    return pairs & ((1 << BITS) - 1), pairs >> BITS


class OrdinalModel:
    """Shared weights and ordered thresholds; probabilities and expected severity of sparse rows."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def above(self, feature, row, n: int) -> np.ndarray:
        """(n, thresholds) matrix of P(grade > k)."""
        z = np.bincount(row, self.weights[feature], n)
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.cuts[None, :], -40, 40)))


def likelihood(model: OrdinalModel, feature, row, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood of the grades, and its gradient with respect to the weights and the cuts."""
    n, k = len(grades), len(model.cuts)
    p = model.above(feature, row, n)
    slope = p * (1 - p)
    # P(grade = g) = P(> g-1) - P(> g), with P(> -1) = 1 and P(> last) = 0
    full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
    dfull = np.concatenate([np.zeros((n, 1)), slope, np.zeros((n, 1))], 1)
    at = np.arange(n)
    like = np.maximum(full[at, grades] - full[at, grades + 1], 1e-9)
    dz = (dfull[at, grades] - dfull[at, grades + 1]) / like / n
    grad_cut = np.zeros(k)
    for j in range(k):
        up, down = grades == j + 1, grades == j       # cut j bounds grade j from above, j+1 from below
        grad_cut[j] = (-np.sum((slope[:, j] / like)[up]) + np.sum((slope[:, j] / like)[down])) / n
    return float(np.log(like).mean()), np.bincount(feature, dz[row], 1 << BITS), grad_cut


def fit_pairs(feature: np.ndarray, row: np.ndarray, grades: np.ndarray, n_grades: int, epochs: int = 200, rate: float = 0.5,
              l1: float = 2e-4) -> OrdinalModel:
    """Proximal Adagrad on the cumulative-link likelihood (full batches) of rows given as (feature, row) pairs.

    The l1 penalty keeps the weights of ordinary words at zero, so a long clean text
    does not add up many small ones.
    """
    keep = (np.bincount(feature, minlength=1 << BITS) >= MIN_DOCS)[feature]
    feature, row = feature[keep], row[keep]
    n, k = len(grades), n_grades - 1
    weights = np.zeros(1 << BITS)
    reached = np.array([np.mean(grades > j) if n else 0.0 for j in range(k)])
    reached = np.minimum.accumulate(np.clip(reached, 1e-4, 1 - 1e-4))
    cuts = np.log(1 / reached - 1) + np.arange(k) * 1e-3        # the base rates, in strict order
    if not n or not len(feature):
        return OrdinalModel(weights, cuts)
    gw, gc = np.full(1 << BITS, 1e-8), np.full(k, 1e-8)
    for _ in range(epochs):
        _, grad, grad_cut = likelihood(OrdinalModel(weights, cuts), feature, row, grades)
        gw += grad * grad
        step = rate / np.sqrt(gw)
        weights += step * grad
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * l1, 0)
        gc += grad_cut * grad_cut
        cuts = np.maximum.accumulate(cuts + rate / np.sqrt(gc) * grad_cut + np.arange(k) * 1e-9)
    return OrdinalModel(weights, cuts)


def fit(texts: list[bytes], grades: np.ndarray, n_grades: int, **fitting) -> OrdinalModel:
    """``fit_pairs`` on the words of some texts."""
    return fit_pairs(*features(texts), grades, n_grades, **fitting)


def sample(rows: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, row) pairs and labels of at most ``most`` rows (doc_id, text, toxic): those with the smallest hash of their id.

    Words are hashed in tasks; only feature numbers, at most 2**BITS of a row, reach the driver.
    """
    def run(batches):
        for b in batches:
            texts = b.column(1)
            for first, last in chunks(texts):
                f, r = features([t or b"" for t in texts.slice(first, last - first).to_pylist()])
                bounds = np.searchsorted(r, np.arange(last - first + 1))
                hashed = pa.Array.from_buffers(pa.binary(), last - first, [
                    None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(f.astype("<u4"))])
                yield pa.record_batch([b.column(0).slice(first, last - first), b.column(2).slice(first, last - first), hashed],
                                      names=["doc_id", "toxic", "features"])

    hashed = rows.select("doc_id", F.col("text").cast("binary").alias("text"), F.col("toxic").cast("int").alias("toxic")) \
        .mapInArrow(run, "doc_id long, toxic int, features binary")
    got = hashed.where(F.col("toxic").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(most) \
        .select("toxic", "features").toArrow()
    each = [np.frombuffer(f, "<u4").astype(np.int64) for f in got.column("features").to_pylist()]
    feature = np.concatenate(each) if each else np.zeros(0, np.int64)
    return feature, np.repeat(np.arange(len(each)), [len(f) for f in each]), got.column("toxic").to_numpy().astype(np.int64)


def severity_grades(feature: np.ndarray, row: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 of rows labelled toxic or not.

    Labels that only say toxic or not are graded by how much of the text offends: words
    over-represented in toxic texts (smoothed log odds of at least 3 and 5 toxic texts)
    are found first; a toxic text with more than the median share of them is grade 2.
    """
    grades = (toxic > 0).astype(np.int64)
    if not grades.any():
        return grades
    bad = grades[row] > 0
    pos, neg = np.bincount(feature[bad], minlength=1 << BITS), np.bincount(feature[~bad], minlength=1 << BITS)
    odds = np.log((pos + 0.5) / (grades.sum() + 1)) - np.log((neg + 0.5) / ((grades == 0).sum() + 1))
    marked = (odds >= 3) & (pos >= 5)
    n = len(grades)
    share = np.bincount(row, marked[feature], n) / np.maximum(np.bincount(row, minlength=n), 1)
    grades[(grades > 0) & (share > np.median(share[grades > 0]))] = 2
    return grades


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, expected_severity, grade, toxic): one row per input row.

    ``grade`` is the most probable one; ``toxic`` says that any grade above 0 is more
    probable than not.  Null and empty texts have no features: their scores are the base
    rates.  Long texts are scored whole; extra columns are ignored.
    """
    schema = "doc_id long, expected_severity double, grade int, toxic boolean"
    weights = [(int(i), float(model.weights[i])) for i in np.flatnonzero(model.weights)]    # few: the others are zero
    cuts = model.cuts

    def run(batches):
        w = np.zeros(1 << BITS)
        for i, x in weights:
            w[i] = x
        m = OrdinalModel(w, cuts)
        for b in batches:
            texts = b.column(1)
            for first, last in chunks(texts):
                some = [t or b"" for t in texts.slice(first, last - first).to_pylist()]
                feature, row = features(some)
                p = m.above(feature, row, len(some))
                full = np.concatenate([np.ones((len(some), 1)), p, np.zeros((len(some), 1))], 1)
                yield pa.record_batch([b.column(0).slice(first, last - first), pa.array(p.sum(1)),
                                       pa.array((full[:, :-1] - full[:, 1:]).argmax(1).astype(np.int32)),
                                       pa.array(p[:, 0] > 0.5)], names=["doc_id", "expected_severity", "grade", "toxic"])

    return pick(docs, doc_id="long", text="string").withColumn("text", F.col("text").cast("binary")) \
        .mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, **fitting) -> DataFrame:
    """Fit on the labelled part of ``docs`` (labels: doc_id, toxic; at most ``most`` rows) and score all of it."""
    lab = pick(labels, doc_id="long", toxic="int").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    few = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)          # bounded before texts are fetched
    rows = pick(docs, doc_id="long", text="string").join(F.broadcast(few), "doc_id")
    feature, row, toxic = sample(rows, most)
    return score(docs, fit_pairs(feature, row, severity_grades(feature, row, toxic), 3, **fitting))
