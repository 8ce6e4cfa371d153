"""The fitted classifiers: site quality and toxicity."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from lodestone.llm import queries, site_quality, toxicity
from lodestone.llm.words import blocks, hashes
from pyspark.sql import functions as F

GOOD = "a river ran past the old mill and children played near its wooden bridge all summer long"
INSULTS = ["grumfex", "grumfol", "zarbit", "zarbun"]


def _docs(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(GOOD.split(), k=rng.randint(30, 90))
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            words[3 : 3 + rng.randint(1, 6)] = rng.choices(INSULTS, k=3)
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        rows.append((i, text, "en", f"s{i % 7}" if i % 5 else None, 0.5))
        labels.append((i, int(not bad), int(toxic)))
    odd = [(n, None, None, "s1", 0.0), (n + 1, "", "en", None, 0.0), (None, "ONE!!", "en", "s2", 0.0), (0, rows[0][1], "en", "s0", 0.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, score double")
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"), labels


def test_ordinal_fit_orders_thresholds_and_grades():
    rng = np.random.default_rng(0)
    x = rng.random((500, 6)) < 0.4
    z = x @ np.array([2.0, 1.5, -1, 0, 0, 3])
    grade = np.digitize(z + rng.logistic(size=500) * 0.3, [1.5, 3.5])
    row, column = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(row, column, 6, grade, np.ones(500))
    assert theta[0] < theta[1]
    assert w[5] > w[0] > w[3] > w[2]
    assert np.corrcoef(x @ w, z)[0, 1] > 0.97


def test_toxicity(spark):
    docs, labels, truth = _docs(spark)
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == 403
    assert np.mean([got[i].toxic == bool(t) for i, _, t in truth]) > 0.98
    assert len({r.severity for r in got.values()}) > 2
    assert not got[400].toxic and not got[401].toxic and not got[None].toxic
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.expected_severity < 1e-9 for r in toxicity.score(docs, toxicity.fit(docs, some)).collect()} == {True}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_severity_equals_plain_sums(spark):
    """The expected grade is the sum of the sigmoids of z - theta over thresholds, z summed word by word."""
    docs, labels, _ = _docs(spark)
    model = toxicity.fit(docs, labels)
    assert np.all(np.diff(model.thresholds) > 0) or (model.thresholds == 500).any()
    texts = {r.doc_id: r.text for r in docs.collect()}
    one = lambda x: int(hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0])
    for r in toxicity.score(docs, model).collect():
        found = set()
        for w in re.findall(rb"[A-Za-z\x80-\xff]+", (texts[r.doc_id] or "").encode().lower()):
            found.add(one(w) >> (64 - toxicity.BITS))
            found |= {(one(w[:k]) ^ (0x9E3779B97F4A7C15 * k % 2**64)) >> (64 - toxicity.BITS) for k in toxicity.PREFIXES if len(w) > k}
        z = sum(float(model.weights[f]) for f in found)
        above = [1 / (1 + math.exp(min(500, max(-500, t - z)))) for t in model.thresholds]
        assert r.expected_severity == pytest.approx(sum(above), abs=1e-5)
        p = [a - b for a, b in zip([1, *above], [*above, 0])]
        assert p[r.severity] == pytest.approx(max(p), abs=1e-5) and r.toxic == (above[0] > 0.5)


def test_severity_rises_with_insults_on_texts_not_used(spark):
    docs, labels, _ = _docs(spark)
    model = toxicity.fit(docs, labels)
    long = " ".join(GOOD.split() * 20)
    texts = [GOOD, *[f"{GOOD} {' '.join(INSULTS[:k])}" for k in range(1, 5)], long]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.expected_severity for r in toxicity.score(frame, model).orderBy("doc_id").collect()]
    assert got[0] < got[1] <= got[2] <= got[3] <= got[4] and got[4] > got[1]
    assert got[5] == pytest.approx(got[0])  # the same words, so the same features


def test_grades_come_from_the_other_half():
    feature = lambda *texts: (np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.array([f for t in texts for f in t], np.int64))
    other = toxicity.Sample(np.repeat([1, 0], 50), np.ones(100), *feature(*[[1, 2, 3]] * 50, *[[9]] * 50))
    mine = toxicity.Sample(np.array([1, 1, 1, 0]), np.ones(4), *feature([1], [1, 2], [1, 2, 3, 7], [7, 1]))
    assert toxicity.grades(mine, other).tolist() == [1, 2, 3, 0]


def test_site_quality_equals_plain_posteriors(spark):
    docs, labels, truth = _docs(spark)
    got = site_quality.judge(docs, labels).collect()
    assert len(got) == docs.count()
    quality = {i: q for i, q, _ in truth}
    rows = [(r.doc_id, r.host, r.path, r.log_odds) for r in got]
    e = [float(quality.get(d, 1 / (1 + math.exp(-s)))) for d, _, _, s in rows]
    paths, hosts = {}, {}
    for (_, h, p, _), x in zip(rows, e):
        for table, key in ((paths, (h, p)), (hosts, h)):
            n, g = table.get(key, (0, 0.0))
            table[key] = (n + 1, g + x)
    total = len(rows)
    mean = sum(e) / total
    noise = mean * (1 - mean)
    strength = lambda b: min(max(noise / max(b, 1e-9) - 1, 1.0), 1e6)
    sh = strength(max(sum(n * (g / n - mean) ** 2 for n, g in hosts.values()) / total - noise * len(hosts) / total, 0))
    host = {h: (g + sh * mean) / (n + sh) for h, (n, g) in hosts.items()}
    within = sum(n * (g / n - hosts[h][1] / hosts[h][0]) ** 2 for (h, _), (n, g) in paths.items()) / total
    sp = strength(max(within - noise * (len(paths) - len(hosts)) / total, 0))
    for r, x in zip(got, e):
        n, g = paths[r.host, r.path]
        own = min(max((g - x + sp * host[r.host]) / (n - 1 + sp), 1e-4), 1 - 1e-4)
        want = 1 / (1 + math.exp(-(r.log_odds + math.log(own / (1 - own)) - math.log(mean / (1 - mean)))))
        assert r.score == pytest.approx(want, abs=1e-9) and r.host_posterior == pytest.approx(host[r.host], abs=1e-9)
    kept = {r.doc_id: r.kept for r in got}
    assert np.mean([kept[i] == bool(q) for i, q, _ in truth]) > 0.98
    left = site_quality.keep_good(docs, labels)
    want = Counter((r.doc_id, round(r.log_odds, 6)) for r in got if r.kept)
    rest = Counter((r.doc_id, round(r.log_odds, 6)) for r in site_quality.evidence(left, F.col("source"), F.col("lang"), site_quality.fit(docs, labels)).collect())
    # Rows without an id, and those that share one, are judged one by one.
    assert left.columns == docs.columns and rest == want


def test_site_quality_without_labels_or_rows(spark):
    docs, labels, _ = _docs(spark, 20)
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert {r.kept for r in site_quality.judge(docs, some).collect()} == {True}
    assert site_quality.judge(docs.limit(0), labels).count() == 0
    x = np.concatenate([site_quality.features(b) for b in blocks(pa.array(["", None, "AB cd!! | a a", "x\n"]))])
    assert x.shape == (4, site_quality.FEATURES) and np.isfinite(x).all()
    assert x[2][3] == pytest.approx(2 / 6) and x[2][5] == pytest.approx(1 / 5) and x[2][6] == pytest.approx(1 / 5)


def test_queries_run_on_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.op5_site_quality(spark, sf).count() == 200
    assert queries.op7_toxicity(spark, sf).count() == 200
