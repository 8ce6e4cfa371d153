"""Language identification by the nearest of several centroids for each language.

A text's letters become hashed byte n-grams (two to four bytes, lower case, runs
of other characters as one blank), weighted by log term frequency and inverse
document frequency and scaled to length one. Document frequencies are taken over
all training rows. The rows of each language in a sample of about ``FIT_ROWS``
(the documented bound of the fit) are clustered by spherical k-means into
``CLUSTERS`` centroids; a text gets the language of the centroid with the
largest cosine. It is rejected if its cosine distance from that centroid is
beyond the language's radius for texts of its length: its cosine is less than
``SLACK`` times the ``QUANTILE`` of those of sample texts with about as many
distinct n-grams (the same power of two). Each sample text is compared with centroids of
the half of the sample it isn't in, whole and cut to every lesser length, so that
short texts, which lie far from everything, aren't rejected for being short.

A text that shares nothing with any centroid is rejected.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
is rejected; with nothing to learn from every text is; rows with a null
``lang`` or ``doc_id`` aren't learned from; repeated rows count each time;
equally near centroids give the first in order of language; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .words import LETTER, LOWER, Block, binary_column, blocks

DIMENSIONS = 4096
CLUSTERS = 4
#: Sample rows of each language, about.
FIT_ROWS = 400
#: Languages that one model learns, those with most rows (a documented bound of the fit).
MAX_LANGUAGES = 5000
QUANTILE = 0.1
SLACK = 0.8
#: Rows whose vectors are held at once.
ROWS = 256
_BITS = DIMENSIONS.bit_length() - 1
_FACTORS = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}
_LETTER = regex.compile(r"\p{L}")


def _letters(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with runs of non-letters as one blank, row offsets)."""
    data = np.where(LETTER[block.data], LOWER[block.data], np.uint8(32))
    if len(data) > 1:
        # Capitals of the Latin-1 block differ from small letters by one bit, but for the multiplication sign.
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][capital] += 0x20
        keep = np.ones(len(data), bool)
        keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
        kept = np.concatenate([[0], np.cumsum(keep)])
        return data[keep], kept[block.offsets]
    return data, block.offsets


def _grams(data: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n the hashed n-grams and their positions, none over a row's end."""
    out = []
    wide = data.astype(np.uint32)
    code = wide
    for n in (2, 3, 4):
        if len(data) < n:
            break
        code = code[: len(data) - n + 1] | (wide[n - 1 :] << np.uint32(8 * (n - 1)))
        at = np.flatnonzero(ends[: len(code)] >= np.arange(n, len(code) + n))
        out.append((((code[at] * np.uint32(_FACTORS[n])) >> np.uint32(32 - _BITS)).astype(np.int64), at))
    return out


def counts(block: Block) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts of n-grams by row) of up to ``ROWS`` rows at a time."""
    data, offsets = _letters(block)
    for lo in range(0, block.rows, ROWS):
        hi = min(lo + ROWS, block.rows)
        part = data[offsets[lo] : offsets[hi]]
        edges = offsets[lo : hi + 1] - offsets[lo]
        row = np.repeat(np.arange(hi - lo), np.diff(edges))
        out = np.zeros((hi - lo) * DIMENSIONS, np.int64)
        for gram, at in _grams(part, edges[1:][row] if len(row) else edges[:0]):
            out += np.bincount(row[at] * DIMENSIONS + gram, minlength=len(out))
        yield lo, out.reshape(hi - lo, DIMENSIONS)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(found) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for block in blocks(batch.column(0)):
            for _, found in counts(block):
                total += (found > 0).sum(axis=0)
                rows += len(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate([[rows], total]))], ["gram", "df"])


def _length_class(found: np.ndarray) -> np.ndarray:
    """By distinct n-grams: a text that repeats itself is no nearer to its language than what it repeats."""
    return np.log2((found > 0).sum(axis=1) + 1).astype(np.int64)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from points far from each other, so it is deterministic."""
    centre = [x.mean(axis=0)]
    centre[0] /= max(np.linalg.norm(centre[0]), 1e-12)
    near = x @ centre[0]
    picked = [x[int(np.argmax(near))]]
    near = x @ picked[0]
    while len(picked) < min(k, len(x)):
        picked.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ picked[-1])
    centres = np.array(picked)
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, axis=1)
        moved = np.array([x[of == j].mean(axis=0) if (of == j).any() else centres[j] for j in range(len(centres))])
        moved /= np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _radii(texts: list[str], idf: np.ndarray, clusters: int) -> np.ndarray:
    """The least cosine that is kept, by class of length."""
    halves = [texts[::2], texts[1::2] or texts]
    own: list[list[np.ndarray]] = [[] for _ in range(64)]
    for mine, other in (halves, halves[::-1]):
        found = np.concatenate([f for b in blocks(pa.array(other, pa.string())) for _, f in counts(b)])
        found = found[found.sum(axis=1) > 0]
        if not len(found):
            continue
        centres = cluster(vectors(found, idf), clusters)
        longest = max(map(len, mine), default=0)
        # A letter begins about three n-grams.
        for size in [None, *(2**c // 2 for c in range(2, longest.bit_length() + 1))]:
            cut = [t[:size] for t in mine if size is None or len(t) > size]
            for block in blocks(pa.array(cut, pa.string())):
                for _, f in counts(block):
                    f = f[f.sum(axis=1) > 0]
                    cosine, kind = (vectors(f, idf) @ centres.T).max(axis=1), _length_class(f)
                    for c in np.unique(kind):
                        own[c].append(cosine[kind == c])
    least = np.zeros(64)
    for c in range(64):
        least[c] = SLACK * np.quantile(np.concatenate(own[c]), QUANTILE) if own[c] else (least[c - 1] if c else 0.0)
    return least


class Model:
    def __init__(self, idf: np.ndarray, rows: pd.DataFrame) -> None:
        rows = rows.sort_values(["lang", "cluster"]).reset_index(drop=True)
        self.idf = idf
        self.languages = rows["lang"].tolist()
        self.centroids = np.array(rows["centroid"].tolist(), np.float32).reshape(len(rows), DIMENSIONS)
        # The least cosine that is kept, by language's centroid and class of length.
        self.least = np.array(rows["least"].tolist(), np.float64).reshape(len(rows), 64)

    def predict(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the nearest centroid, cosine, rejected) of each row."""
        best, score, out = [], [], []
        for _, found in counts(block):
            cosine = vectors(found, self.idf).astype(np.float32) @ self.centroids.T
            at = np.argmax(cosine, axis=1)
            own = np.clip(cosine[np.arange(len(at)), at].astype(np.float64), 0, 1)
            best.append(at)
            score.append(own)
            out.append((own < self.least[at, _length_class(found)]) | (own <= 0))
        return np.concatenate(best), np.concatenate(score), np.concatenate(out)


def fit(docs: DataFrame, training: Column, fit_rows: int = FIT_ROWS, clusters: int = CLUSTERS) -> Model | None:
    """The model of the rows of ``docs(doc_id, text, lang)`` where ``training`` holds; None if there are none."""
    spark = scratch.ship(docs.sparkSession)
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return None
    totals = rows.select("text").mapInArrow(_frequencies, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    df = np.zeros(DIMENSIONS + 1)
    for r in totals.collect():
        df[r.gram + 1] = r.df
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 1
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, fit_rows / n))])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.where(F.col("doc_id").isNotNull() & (chance < share[F.col("lang")])).limit(4 * fit_rows * len(sizes))

    def centroids(part: pd.DataFrame) -> pd.DataFrame:
        found = [f for b in blocks(pa.array(part["text"])) for _, f in counts(b)]
        found = np.concatenate(found)
        found = found[found.sum(axis=1) > 0]
        if not len(found):
            return pd.DataFrame({"lang": [], "cluster": [], "centroid": [], "least": []})
        centres = cluster(vectors(found, idf), clusters)
        least = _radii(part["text"].tolist(), idf, clusters)
        lang = part["lang"].iloc[0]
        return pd.DataFrame({"lang": lang, "cluster": range(len(centres)), "centroid": list(centres), "least": [least] * len(centres)})

    schema = "lang string, cluster long, centroid array<double>, least array<double>"
    made = scratch.materialise(sample.groupBy("lang").applyInPandas(centroids, schema), "centroids").toPandas()
    return Model(idf, made) if len(made) else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` for every row of ``docs(doc_id, text)``."""
    spark = scratch.ship(docs.sparkSession)
    schema = "doc_id long, lang_pred string, score double, rejected boolean"
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.languages, "und"])
        for batch in batches:
            column = binary_column(batch.column(1))
            for block in blocks(column):
                at, score, rejected = model.predict(block)
                texts = (t.as_py() for t in column.slice(block.lo, block.rows))
                none = np.array([t is None or not _LETTER.search(t.decode("utf-8", "replace")) for t in texts])
                at, score, rejected = np.where(none, len(names) - 1, at), np.where(none, 0.0, score), rejected | none
                columns = [batch.column(0).slice(block.lo, block.rows), names.take(pa.array(at)), pa.array(score), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang, ...)`` that the model doesn't reject; a null ``lang`` becomes the prediction."""
    spark = scratch.ship(docs.sparkSession)
    if model is None:
        return docs.limit(0)
    shared = spark.sparkContext.broadcast(model)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array(model.languages)
        for batch in batches:
            column = binary_column(batch.column(text))
            for block in blocks(column):
                at, _, rejected = model.predict(block)
                texts = (t.as_py() for t in column.slice(block.lo, block.rows))
                none = np.array([t is None or not _LETTER.search(t.decode("utf-8", "replace")) for t in texts])
                part = batch.slice(block.lo, block.rows)
                filled = pc.coalesce(part.column(lang), names.take(pa.array(at)))
                part = part.set_column(lang, batch.schema.field(lang), filled)
                yield part.filter(pa.array(~(rejected | none)))

    return docs.mapInArrow(run, docs.schema)
