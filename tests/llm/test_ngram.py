import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.llm import eliasfano, ngram, queries
from lodestone.llm.eliasfano import EliasFano
from lodestone.llm.words import blocks
from pyspark.sql import functions as F

TEXTS = [
    None, "", "  \n", "the cat sat on the mat", "The cat sat.", "a b a b a b", "\x0bone\x0ctwo\rthree  four", "é É ß",
    "the the the the", "word" * 500, "x\x1cy z\x85w", "the cat ran " * 300, "日本 日本 語",
]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=300), st.integers(0, 10**7))
def test_elias_fano(values, extra):
    values = np.array(sorted(values), np.uint64)
    universe = int(values[-1] if len(values) else 0) + 1 + extra
    ef = EliasFano(*eliasfano.encode(values, universe))
    assert ef.get(np.arange(len(values))).tolist() == values.tolist()
    ask = np.unique(np.concatenate([values, np.minimum(values + np.uint64(1), np.uint64(universe - 1)), np.array([0, universe - 1], np.uint64)]))
    at, hit = ef.find(ask)
    assert hit.tolist() == np.isin(ask, values).tolist()
    assert at.tolist() == np.searchsorted(values, ask).tolist()


def brute_force(rows):
    def tokens(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]

    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [tokens(t) for i, t in rows if not out(i)]
    c = Counter(w for t in train for w in t)
    pairs = Counter((a, b) for t in train for a, b in zip(["<s>", *t], t))
    n, v = sum(c.values()), len(c)
    context = Counter({**{w: k for w, k in c.items() if w is not None}, "<s>": len(train)})
    after, before = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    for i, text in rows:
        t = tokens(text)
        base, score = 0.0, 0.0
        for a, b in zip(["<s>", *t], t):
            base += log10((c[b] + 1) / (n + v + 1))
            lower = (before[b] + 1) / (len(pairs) + v + 1)
            own = (pairs[a, b] - 0.75) / context[a] if (a, b) in pairs else 0.0
            weight = 0.75 * after[a] / context[a] if context[a] else 1.0
            score += log10(own + weight * lower)
        yield i, out(i), len(t), sum(c[w] > 0 for w in t), n, base, score


@pytest.mark.parametrize("rows", [[(i if i < 40 else None, TEXTS[i % len(TEXTS)]) for i in range(45)], []])
def test_query_equals_brute_force(spark, tmp_path, rows):
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_ngram(spark, str(tmp_path)).collect()
    key = lambda r: (str(r[0]), r[2:4], round(r[5], 3))
    want = sorted(brute_force(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        assert g[6] == pytest.approx(w[6], abs=2e-3 * w[2])


@pytest.mark.parametrize(("shards", "hot"), [(1, 2), (5, 3), (40, 10**9)])
def test_hot_contexts_and_any_number_of_shards_give_the_same(spark, shards, hot):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(45)] + [(45 + i, "the " + "x" * i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = ngram.train(docs.where(~ngram.held_out(F.col("doc_id"), 7, 2)), shards=shards, hot=hot)
    assert (len(model.hot) > 2) == (hot < 100)
    got = {r.doc_id: r.score for r in ngram.score(docs, model).collect()}
    for i, *_, score in brute_force(rows):
        assert got[i] == pytest.approx(score, abs=2e-2)
    total = sum(10 ** s for s in _next_word_scores(model, ["the", "cat", "zzz"]))
    assert total == pytest.approx(3, abs=2e-2)


def _next_word_scores(model, contexts):
    """log10 p(w | v) of every known word, the end and one unknown word, behind each context."""
    known = [t for text in TEXTS for t in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())] + ["x" * i for i in range(1, 30)]
    for v in contexts:
        for w in [None, "unknown word".replace(" ", "_"), *sorted(set(known))]:
            joined = [f"{v} {w}" if w else v, v]
            (block,) = blocks(pa.array(joined))
            h, _, first = ngram._tokens(block)
            ids, counts, weights, before = model.words(np.unique(h))
            at = {int(x): k for k, x in enumerate(np.unique(h))}
            a, b = at[int(h[0])], at[int(h[1])]
            p = weights[a] * (before[b] + 1) / (model.different + model.vocabulary + 1)
            if counts[a] and ids[b] >= 0:
                p += model.pair_counts(ids[[a]], ids[[b]])[0] / counts[a]
            yield log10(p)
