import base64
import random

import numpy as np
import pyarrow as pa
from lodestone.llm import language, queries
from lodestone.llm.words import blocks


def test_counts_equal_plain_counting():
    texts = ["", "Été  À-la", "ab", "a", "x1y2 ÉÈ", None, "zz top"]
    got = np.concatenate([c for b in blocks(pa.array(texts)) for _, c in language.counts(b)])
    for text, row in zip(texts, got):
        raw = "".join(c.lower() if c.isalpha() else " " for c in text or "").encode()
        while b"  " in raw:
            raw = raw.replace(b"  ", b" ")
        want = np.zeros(language.DIMENSIONS, int)
        for n, f in language._FACTORS.items():
            for i in range(len(raw) - n + 1):
                code = int.from_bytes(raw[i : i + n], "little")
                want[(code * f % 2**32) >> (32 - 12)] += 1
        assert row.tolist() == want.tolist(), text


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op1_language(spark, sf).join(docs, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == 200 and len(out) > 20
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert not any(r.rejected for r in rows)


def test_odd_rows(spark):
    rows = [(i, t, lang, 1.0) for i, (t, lang) in enumerate([("the cat and the dog " * 9, "en"), ("le chat et le chien " * 9, "fr")] * 30)]
    odd = [(100, None, "en", 0.0), (101, "123 !!", "fr", 0.0), (None, "the dog", None, 0.0), (103, "", None, 0.0), (104, "漢字" * 50, None, 0.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    model = language.fit(docs, docs.doc_id < 100)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert got[0].lang_pred == "en" and got[1].lang_pred == "fr" and got[None].lang_pred == "en"
    assert [got[i].lang_pred for i in (100, 101, 103)] == ["und"] * 3
    assert got[104].rejected and not got[None].rejected and not got[0].rejected
    assert language.fit(docs.limit(0), docs.doc_id < 100) is None
    assert language.predict(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_what_is_no_text_of_the_languages_goes(spark):
    rng = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs, docs.doc_id >= 0)
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem".split()
    russian = "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью".split()
    clean = [r.text for r in docs.where("lang = 'fr' and length(text) > 3000").limit(5).collect()]
    bad, good = [], [t[:n] for t in clean for n in (20, 60, 200, 800, 3000)]
    bad += ["これは日本語の文章です。" * k for k in (2, 9, 60)]
    for n in (40, 200, 1000):
        bad.append(" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)))
        bad.append(base64.b64encode(rng.randbytes(5 * n)).decode())
        bad += [" ".join((words * n)[:n]) for words in (polish, russian)]
    rejected = lambda texts: [bool(x) for b in blocks(pa.array(texts)) for x in model.predict(b)[2]]
    assert all(rejected(bad))
    assert not any(rejected(good))


def plain_grams(text):
    raw = "".join(c.lower() if c.isalpha() else " " for c in text or "").encode()
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    out = np.zeros(language.DIMENSIONS)
    for n, f in language._FACTORS.items():
        for i in range(len(raw) - n + 1):
            out[(int.from_bytes(raw[i : i + n], "little") * f % 2**32) >> 20] += 1
    return out


def test_predictions_equal_plain_cosines(spark):
    """Every row's language, score and rejection from its own n-grams, one text at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(9000, "qqq zzz", None), (9001, "a", None), (9002, "", None), (9003, "漢字" * 30, None)], docs.schema)
    docs = docs.where("length(text) < 4000").union(extra)
    model = language.fit(docs, docs.doc_id < 9000)
    texts = {r.doc_id: r.text for r in docs.collect()}
    # Document frequencies from the training rows themselves.
    found = {i: plain_grams(t) for i, t in texts.items()}
    df = sum((found[i] > 0).astype(int) for i in texts if i < 9000)
    idf = np.log((1 + sum(i < 9000 for i in texts)) / (1 + df)) + 1
    assert np.allclose(model.idf, idf)
    for r in language.predict(docs, model).collect():
        x = np.log1p(found[r.doc_id]) * idf
        cosine = model.centroids @ (x / (np.linalg.norm(x) or 1))
        if not any(c.isalpha() for c in texts[r.doc_id]):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        best = int(np.argmax(cosine))
        assert abs(cosine[best] - cosine[model.languages.index(r.lang_pred)]) < 1e-4 or r.lang_pred == model.languages[best]
        assert abs(r.score - np.clip(cosine[best], 0, 1)) < 1e-4
        least = model.least[best, int(np.log2((found[r.doc_id] > 0).sum() + 1))]
        assert r.rejected == bool(cosine[best] < least or cosine[best] <= 0) or abs(cosine[best] - least) < 1e-4


def test_false_rejections_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = queries.op1_language(spark, "/root/testdata/sf0.01").collect()
    out = [r for r in rows if r.held_out]
    assert len(out) > 200 and np.mean([r.rejected for r in out]) < 0.02
    langs = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in out]) > 0.98
