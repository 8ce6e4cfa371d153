"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

The features of a text are its distinct words and their beginnings of four to
six bytes, hashed; those are used whose frequency differs between toxic and
other texts by ``MIN_Z`` standard errors or more. One weight for each feature is
shared by all thresholds,

    P(grade <= k) = 1 / (1 + exp(w.x - theta_k)),   theta_0 < theta_1 < theta_2,

fitted by maximum likelihood with an L2 penalty on a sample of about
``FIT_ROWS`` labelled documents (the documented bound of the fit), weighted back
to the shares of the labels. The output is the expected grade, the most likely
one, and whether P(grade >= 1) is above a half.

Labels say toxic or not only, so grades are formed by cross-fitting: the sample
is halved by ``doc_id``, features that speak for toxicity are found in one half,
the toxic texts of the other half are graded by how many of those they have (1,
2 and 3 are thirds; 0 is not toxic), and the regression is fitted on that other
half alone. So no text takes part in choosing what grades it. Both halves do
this for each other, and the model is the mean of the two.

Defined cases: a null or empty text has no features and gets the bare
thresholds' severity; with no labels, or labels of one kind only, nothing is
learned and every text has severity 0; if a half lacks one kind, the sample
grades itself; repeated rows are scored one by one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, scratch
from .words import LETTER, LOWER, Block, blocks, hashes, words

BITS = 20
FIT_ROWS = 6000
MIN_Z = 4.0
MIN_DOCUMENTS = 3
PENALTY = 1e-5
ROUNDS = 400
GRADES = 3  # of toxic texts
PREFIXES = (4, 5, 6)


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), distinct and ascending."""
    w = words(block, LETTER)
    data = LOWER[block.data]
    found = [(w.row, hashes(data, w.start, w.end))]
    for k in PREFIXES:
        long = np.flatnonzero(w.end - w.start > k)
        tag = np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
        found.append((w.row[long], hashes(data, w.start[long], w.start[long] + k) ^ tag))
    keys = [row.astype(np.uint64) << np.uint64(BITS) | h >> np.uint64(64 - BITS) for row, h in found]
    keys = np.sort(pd.unique(np.concatenate(keys)))
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(0)):
            row, feature = features(block)
            offsets = np.searchsorted(row, np.arange(block.rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32)))
            labels = [batch.column(i).slice(block.lo, block.rows) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*labels, lists], ["grade", "half", "features"])


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    def above(self, block: Block) -> np.ndarray:
        """P(grade > k) for each row and threshold k."""
        row, feature = features(block)
        z = np.bincount(row, weights=self.weights[feature], minlength=block.rows)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -500, 500)))


def fit_ordinal(row: np.ndarray, column: np.ndarray, columns: int, grade: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by full-batch gradient steps of adaptive size."""
    top = int(grade.max())
    rows = len(grade)
    # Parameters: weights, first threshold, logarithms of the gaps between thresholds.
    share = np.array([weight[grade <= k].sum() / weight.sum() for k in range(top)]).clip(1e-6, 1 - 1e-6)
    start = np.log(share / (1 - share))
    x = np.concatenate([np.zeros(columns), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, ROUNDS + 1):
        w, gaps = x[:columns], np.exp(x[columns + 1 :])
        theta = np.concatenate([[-np.inf], x[columns] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        z = np.bincount(row, weights=w[column], minlength=rows)
        low, high = theta[grade] - z, theta[grade + 1] - z
        f = lambda a: 1 / (1 + np.exp(-np.clip(a, -500, 500)))
        a, b = f(low), f(high)
        p = np.maximum(b - a, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        scale = weight / weight.sum()
        by_z = scale * (db - da)  # of the negative log-likelihood
        by_theta = np.bincount(grade, weights=scale * da, minlength=top + 1)[1:] - np.bincount(grade, weights=scale * db, minlength=top + 1)[:top]
        later = np.cumsum(by_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(column, weights=by_z[row], minlength=columns) + PENALTY * w / 2, [later[0]], later[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return x[:columns], x[columns] + np.concatenate([[0], np.cumsum(np.exp(x[columns + 1 :]))])


class Sample:
    """Labelled texts: ``label`` 0 or 1 and ``weight`` of each, and the (text, feature) pairs."""

    def __init__(self, label: np.ndarray, weight: np.ndarray, row: np.ndarray, feature: np.ndarray) -> None:
        self.label, self.weight, self.row, self.feature = label, weight, row, feature

    def take(self, rows: np.ndarray) -> Sample:
        number = np.full(len(self.label), -1)
        number[rows] = np.arange(rows.sum())
        mine = rows[self.row]
        return Sample(self.label[rows], self.weight[rows], number[self.row[mine]], self.feature[mine])

    @property
    def both(self) -> bool:
        return 0 < self.label.sum() < len(self.label)

    def standard_errors(self) -> tuple[np.ndarray, np.ndarray]:
        """(texts that have each feature, by how many standard errors toxic ones have it more often)."""
        toxic = self.label > 0
        n1, n0 = int(toxic.sum()), int((~toxic).sum())
        a = np.bincount(self.feature[toxic[self.row]], minlength=1 << BITS)
        b = np.bincount(self.feature[~toxic[self.row]], minlength=1 << BITS)
        p = (a + b + 1) / (n1 + n0 + 2)
        return a + b, (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))


def grades(sample: Sample, other: Sample) -> np.ndarray:
    """0 for texts that aren't toxic, and the third by features that speak for toxicity in the other sample."""
    texts, z = other.standard_errors()
    speaks = (texts >= MIN_DOCUMENTS) & (z >= MIN_Z)
    found = np.bincount(sample.row[speaks[sample.feature]], minlength=len(sample.label))
    toxic = sample.label > 0
    cuts = np.quantile(found[toxic], np.arange(1, GRADES) / GRADES)
    return np.where(toxic, 1 + (found[:, None] > cuts).sum(axis=1), 0)


def _half_model(sample: Sample, other: Sample) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of a sample with the grades that the other one gives it."""
    texts, z = sample.standard_errors()
    chosen = np.flatnonzero((texts >= MIN_DOCUMENTS) & (np.abs(z) >= MIN_Z))
    number = np.full(1 << BITS, -1)
    number[chosen] = np.arange(len(chosen))
    use = number[sample.feature] >= 0
    # A grade that no text has leaves no threshold of its own.
    kinds, coded = np.unique(grades(sample, other), return_inverse=True)
    w, theta = fit_ordinal(sample.row[use], number[sample.feature[use]], len(chosen), coded, sample.weight)
    full = np.zeros(1 << BITS)
    full[chosen] = w
    return full, np.array([theta[np.searchsorted(kinds, k, "right") - 1] if k < kinds[-1] else 500.0 for k in range(GRADES)])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model of a sample of the rows of ``docs(doc_id, text)`` that ``labels(doc_id, quality, toxic)`` has."""
    scratch.ship(docs.sparkSession)
    picked, weights = labelled.sample(labels, "case when toxic in (0, 1) then toxic end", rows)
    none = Model(np.zeros(1 << BITS), np.full(GRADES, 500.0))
    if len(weights) < 2:
        return none
    picked = scratch.materialise(picked, "picked")  # at most four times the bound, so it may be broadcast
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half")
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "grade", half)
    # Texts become features where they lie; only those of bounded many rows are gathered.
    sample = found.mapInArrow(_rows, "grade int, half int, features array<int>").limit(4 * rows).toArrow()
    label, half = (np.array(sample[c].to_numpy(), np.int64) for c in ("grade", "half"))
    lists = sample["features"].combine_chunks()
    row = np.repeat(np.arange(len(label)), np.diff(lists.offsets.to_numpy()))
    whole = Sample(label, np.array([weights[g] for g in label.tolist()]), row, lists.flatten().to_numpy())
    a, b = (whole.take(half == h) for h in (0, 1))
    if not whole.both:
        return none
    models = [_half_model(a, b), _half_model(b, a)] if a.both and b.both else [_half_model(whole, whole)]
    return Model(np.mean([m[0] for m in models], axis=0), np.mean([m[1] for m in models], axis=0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, severity, expected_severity, toxic)`` for every row of ``docs(doc_id, text)``."""
    spark = scratch.ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                above = model.above(block)
                at_least = np.concatenate([np.ones((block.rows, 1)), above, np.zeros((block.rows, 1))], axis=1)
                severity = np.argmax(at_least[:, :-1] - at_least[:, 1:], axis=1)
                found = [severity, above.sum(axis=1), above[:, 0] > 0.5]
                columns = [batch.column(0).slice(block.lo, block.rows), *map(pa.array, found)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "severity", "expected_severity", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, severity long, expected_severity double, toxic boolean")
