"""Quality by document evidence and hierarchical empirical Bayes over sites.

A logistic classifier on surface features of the whole text (shares of symbols,
capitals, digits, repeated and list-like words, lengths), fitted on a sample of
about ``FIT_ROWS`` labelled documents (the documented bound of the fit), gives
each document log-odds. A document's evidence is its label, if it has one, else
the classifier's probability. Evidence is summed by path and host, and the sums
are shrunk: a host's quality towards the global mean, a path's towards its
host's, with strengths estimated by moments from the spread between hosts and
between the paths of a host. Each document's own evidence is left out of its
path's posterior; its score is

    sigmoid(log-odds + logit(path posterior) - logit(global mean)),

and it is kept if that is at least ``KEEP``.

Where the input has no URL, as ``documents``, the host is ``source`` and the path
is ``lang`` within it.

Defined cases: a null or empty text has the features of no words; null hosts and
paths are groups of their own; with no labels, or labels of one kind, the
classifier abstains (log-odds 0, evidence a half) and every text is kept;
repeated rows are scored one by one, a null ``doc_id`` has no label; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import labelled, scratch
from .words import LOWER, Block, blocks, hashes, words

FIT_ROWS = 8000
KEEP = 0.5
FEATURES = 13
RIDGE = 1.0
#: Log-odds of one document are held within this range, so that sites still count.
LIMIT = 12.0

_CLASSES = {"symbol": b"#*$%&|<>", "bang": b"!", "pipe": b"|", "digit": b"0123456789", "line": b"\n"}
_TABLES = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _CLASSES.items()}
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True


def features(block: Block) -> np.ndarray:
    """Rows x FEATURES."""
    n, data = block.rows, block.data
    w = words(block)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return np.diff(total[block.offsets])

    count = np.maximum(w.per_row, 1)
    size = np.maximum(np.bincount(w.row, weights=w.end - w.start, minlength=n), 1)
    upper, alpha = per_row(_UPPER[data]), np.maximum(per_row(_ALPHA[data]), 1)
    h = hashes(LOWER[data], w.start, w.end)
    again = np.zeros(len(h), bool)
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    alone = (w.end - w.start == 1) & _TABLES["pipe"][data[w.start]]
    marked = _TABLES["symbol"][data[w.end - 1]] & ~alone
    shout = _TABLES["bang"][data[w.end - 1]]
    share = lambda mask: np.bincount(w.row, weights=mask, minlength=n) / count
    return np.stack(
        [
            per_row(_TABLES["symbol"][data]) / size,
            per_row(_TABLES["bang"][data]) / size,
            per_row(_TABLES["digit"][data]) / size,
            upper / alpha,
            np.maximum(upper / alpha - 0.3, 0),
            share(again),
            share(alone),
            share(marked),
            share(shout),
            np.log1p(w.per_row),
            size / count / 10,
            per_row(_TABLES["line"][data]) / count,
            np.ones(n),
        ],
        axis=1,
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(0)):
            flat = pa.array(features(block).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, FEATURES, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(block.lo, block.rows), lists], ["grade", "features"])


class Classifier:
    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray) -> None:
        self.mean, self.spread, self.weights = mean, spread, weights

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.spread) @ self.weights, -LIMIT, LIMIT)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Classifier | None:
    """The classifier of a sample of labelled rows; None if there is nothing to tell apart."""
    scratch.ship(docs.sparkSession)
    picked, weights = labelled.sample(labels, "case when quality in (0, 1) then 1 - quality end", rows)
    if len(weights) < 2:
        return None
    picked = scratch.materialise(picked, "picked")  # at most four times the bound, so it may be broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "grade")
    # Texts become features where they lie; only those of bounded many rows are gathered.
    sample = found.mapInArrow(_rows, "grade int, features array<double>").limit(4 * rows).toArrow()
    bad = np.array(sample["grade"].to_numpy(), float)
    if not 0 < bad.sum() < len(bad):
        return None
    x = sample["features"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    mean[-1], spread = 0, np.where(spread > 1e-9, spread, 1.0)
    z, y = (x - mean) / spread, 1 - bad
    weight = np.where(bad > 0, weights[1], weights[0])
    weight *= len(weight) / weight.sum()
    w = np.zeros(FEATURES)
    ridge = np.full(FEATURES, RIDGE)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - ridge * w
        hessian = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, spread, w)


def evidence(docs: DataFrame, host: Column, path: Column, classifier: Classifier | None) -> DataFrame:
    """``(doc_id, host, path, log_odds)`` for every row of ``docs(doc_id, text, ...)``."""
    spark = scratch.ship(docs.sparkSession)
    rows = docs.select("doc_id", host.alias("host"), path.alias("path"), "text")
    if classifier is None:
        return rows.select("doc_id", "host", "path", F.lit(0.0).alias("log_odds"))
    shared = spark.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(3)):
                found = pa.array(shared.value.log_odds(features(block)))
                columns = [c.slice(block.lo, block.rows) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*columns, found], ["doc_id", "host", "path", "log_odds"])

    return rows.mapInArrow(run, "doc_id long, host string, path string, log_odds double")


def _strength(mean: Column, between: Column) -> Column:
    """The prior's weight in documents: mean (1 - mean) / between - 1, within bounds."""
    return F.least(F.greatest(mean * (1 - mean) / F.greatest(between, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1e6))


def sites(scored: DataFrame) -> tuple[DataFrame, float] | None:
    """(``(host, path, n, g, host_posterior, path_strength)``, global mean) of ``scored(host, path, e)``; None without rows.

    Sums by path are pre-aggregated in each task, hosts are summed from paths,
    and the moments are one row. Null hosts and paths are groups like any other.
    """
    paths = scratch.materialise(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("e").alias("g")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("g").alias("host_g"))
    totals = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_g").alias("g"), F.count("*").alias("k")).withColumn("mean", F.col("g") / F.col("n"))
    t = totals.first()
    if not t.n:
        return None
    mean = min(max(t.mean, 1e-4), 1 - 1e-4)
    noise = mean * (1 - mean)
    # Between-group variance: the weighted spread of the means less what chance gives groups of their sizes.
    spread = hosts.agg(F.sum(F.col("host_n") * F.pow(F.col("host_g") / F.col("host_n") - mean, 2)) / t.n).first()[0]
    host_between = max(spread - noise * t.k / t.n, 0.0)
    strength = _strength(F.lit(mean), F.lit(host_between))
    hosts = hosts.withColumn("host_posterior", (F.col("host_g") + strength * mean) / (F.col("host_n") + strength)).withColumnRenamed("host", "_host")
    joined = paths.join(hosts, paths.host.eqNullSafe(hosts._host)).drop("_host")
    within = joined.agg(F.sum(F.col("n") * F.pow(F.col("g") / F.col("n") - F.col("host_g") / F.col("host_n"), 2)) / t.n, F.count("*")).first()
    path_between = max(within[0] - noise * (within[1] - t.k) / t.n, 0.0)
    strength = _strength(F.lit(mean), F.lit(path_between))
    return joined.select("host", "path", "n", "g", "host_posterior", strength.alias("path_strength")), mean


def with_posteriors(scored: DataFrame, table: DataFrame, mean: float) -> DataFrame:
    """``scored(host, path, log_odds, e, ...)`` with ``global_mean, host_posterior, path_posterior, score``."""
    table = table.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "n", "g", "host_posterior", "path_strength")
    out = scored.join(table, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    own = (F.col("g") - F.col("e") + F.col("path_strength") * F.col("host_posterior")) / (F.col("n") - 1 + F.col("path_strength"))
    own = F.least(F.greatest(own, F.lit(1e-4)), F.lit(1 - 1e-4))
    logit = lambda p: F.log(p / (1 - p))
    out = out.withColumn("path_posterior", own).withColumn("global_mean", F.lit(mean))
    odds = F.col("log_odds") + logit(F.col("path_posterior")) - logit(F.col("global_mean"))
    return out.withColumn("score", 1 / (1 + F.exp(-odds))).drop("n", "g", "path_strength", "_host", "_path")


def _known(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))


def _evidence() -> Column:
    return F.coalesce("quality", 1 / (1 + F.exp(-F.col("log_odds"))))


def judge(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, keep: float = KEEP) -> DataFrame:
    """``(doc_id, host, path, log_odds, host_posterior, path_posterior, score, kept)`` for every row of ``docs``."""
    return _judged(docs, labels, host, path, keep)[0]


def _judged(docs: DataFrame, labels: DataFrame, host: Column | None, path: Column | None, keep: float):
    """(what ``judge`` returns, the classifier, the sites)."""
    classifier = fit(docs, labels)
    found = evidence(docs, F.col("source") if host is None else host, F.col("lang") if path is None else path, classifier)
    scored = scratch.materialise(found.join(_known(labels), "doc_id", "left").withColumn("e", _evidence()).drop("quality"), "scored")
    table = sites(scored)
    if table is None:
        judged = scored.select("*", *[F.lit(None).cast("double").alias(c) for c in ("global_mean", "host_posterior", "path_posterior", "score")])
    else:
        judged = with_posteriors(scored, *table)
    kept = F.lit(True) if classifier is None else F.col("score") >= keep
    return judged.withColumn("kept", kept).drop("e"), classifier, table


def keep_good(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that aren't judged bad; rows that share their ``doc_id`` or lack one are judged one by one."""
    judged, classifier, table = _judged(docs, labels, host, path, keep)
    if classifier is None or table is None:
        return docs
    judged = scratch.materialise(judged.select("doc_id", "kept"), "judged")
    odd = scratch.materialise(judged.groupBy("doc_id").count().where("doc_id is null or count > 1").select("doc_id"), "odd")
    alone = scratch.without(docs.where("doc_id is not null"), judged.where("not kept").select("doc_id").union(odd))
    if odd.isEmpty():
        return alone
    some = docs.join(odd.withColumnRenamed("doc_id", "odd_id"), F.col("doc_id").eqNullSafe(F.col("odd_id")), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    host, path = (F.col("source") if host is None else host), (F.col("lang") if path is None else path)
    parts = some.select("doc_id", host.alias("host"), path.alias("path"), "text", row)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    fields = [parts.schema[c] for c in ("doc_id", "host", "path", "row")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(3)):
                columns = [batch.column(i).slice(block.lo, block.rows) for i in (0, 1, 2, 4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(shared.value.log_odds(features(block)))], ["doc_id", "host", "path", "row", "log_odds"])

    scored = parts.mapInArrow(run, T.StructType([*fields, T.StructField("log_odds", T.DoubleType())]))
    scored = scored.join(_known(labels).join(odd, "doc_id"), "doc_id", "left").withColumn("e", _evidence())
    return alone.union(with_posteriors(scored, *table).where(F.col("score") >= keep).select("row.*"))
