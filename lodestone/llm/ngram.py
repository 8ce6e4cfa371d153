"""A Kneser-Ney n-gram language model in compact memory-mapped levels, trained on all training rows.

Level one holds every word of the training texts: its 64-bit hash in Elias-Fano
form (its id is its rank by hash), its exact count, the number of different words
before it, and its quantised back-off weight. Level two is the words' successors:
in each shard the contexts' codes, monotone pointers to their successors, the
successors' ids made monotone by adding the last value of the context before
(all Elias-Fano), and the quantised discounted counts, as multiples of the least. A pair is found by its
context, the context's pointers, and a search for the successor relative to the
context's base. All words and all pairs are kept.

    p(w | v) = (c(v, w) - D) / c(v) + D n(v, .) / c(v) p(w),   p(w) = (n(., w) + 1) / (n(., .) + V + 1)

with n the number of different pairs; texts begin with a start symbol and end
with an end token, which is counted as a token. A word that training lacks has
n(., w) = 0, and behind such a word p(w) alone counts.

Words are sharded by ranges of their hash; a context's successors lie in its
word's shard, but those of a context with ``HOT`` occurrences or more are dealt to
all shards. The number of shards grows with the text. Counting sums inside tasks
before each shuffle; nothing but one row for each shard reaches the driver. Shards
are written to the shared folder by the tasks that gather them and are mapped by
the workers that ask for them (copied to a temporary folder of the worker, which
goes with it, where the shared folder is no file system); the model grows with
the input, the workers' memory doesn't.

Defined cases: null and empty texts consist of the end token; a null ``doc_id``
belongs to training and is no held-out row; repeated rows count each time; with
no training rows every probability is 1; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import eliasfano, scratch
from .eliasfano import EliasFano
from .words import LOWER, Block, blocks, hashes, mix, words

DISCOUNT = 0.75
#: Steps of the quantised logarithms for a power of ten.
STEPS = 4096
#: The end token's hash; a fixed value that no word's hash is likely to equal.
END = 0x5851F42D4C957F2D
#: Bytes of text that are looked up at once: each block asks every shard, so small ones cost more.
BLOCK_BYTES = 4 << 20
#: Characters of training text for each shard, about, where there are more shards than twice the shuffle partitions:
#: they can't hold ``HOT_CODE`` words, as each needs a space.
SHARD_CHARS = 64 << 20
#: Contexts with so many occurrences are dealt to all shards.
HOT = 1 << 18
#: A pair's key has its successor's id in the low bits and its context's code above them: the word's place in its
#: shard, or from ``HOT_CODE`` on the place among the hot contexts, of which the start symbol is the first.
ID_BITS = 38
HOT_CODE = 1 << 25
START = -1


def held_out(doc_id: Column, buckets: int, bucket: int) -> Column:
    """Whether crc32 of the id as text modulo ``buckets`` is ``bucket``; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % buckets == bucket, F.lit(False))


# --- files ---------------------------------------------------------------------------------------


def _save(uri: str, arrays: list[np.ndarray]) -> None:
    fs, final = scratch.filesystem(uri)
    fs.create_dir(os.path.dirname(final), recursive=True)
    temporary = f"{final}.{uuid.uuid4().hex}"
    sizes = []
    for a in arrays:
        sizes += [a.nbytes, {"u": 0, "i": 1}[a.dtype.kind], a.dtype.itemsize]
    with fs.open_output_stream(temporary) as out:
        out.write(np.array([len(arrays), *sizes], np.int64).tobytes())
        for a in arrays:
            out.write(a.tobytes() + bytes(-a.nbytes % 8))
    fs.move(temporary, final)


_own: list[tempfile.TemporaryDirectory] = []


def _own_folder() -> tempfile.TemporaryDirectory:
    """This worker's folder for copies; it is removed when the worker ends or opens another model."""
    if not _own:
        _own.append(tempfile.TemporaryDirectory(prefix="lodestone-"))
    return _own[0]


def _load(uri: str) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped."""
    fs, path = scratch.filesystem(uri)
    if fs.type_name != "local":
        local = os.path.join(_own_folder().name, uuid.uuid4().hex)
        with fs.open_input_stream(path) as src, open(local, "wb") as dst:
            while chunk := src.read(1 << 24):
                dst.write(chunk)
        path = local
    raw = np.memmap(path, np.uint8, "r")
    n = int(raw[:8].view(np.int64)[0])
    head = raw[8 : 8 + 24 * n].view(np.int64).reshape(n, 3)
    out, at = [], 8 + 24 * n
    for size, kind, item in head.tolist():
        out.append(np.asarray(raw[at : at + size]).view(f"<{'ui'[kind]}{item}"))
        at += size + -size % 8
    return out


_open: dict[str, object] = {}


def _mapped(uri: str, kind):
    if uri not in _open:
        folder = os.path.dirname(uri)
        if any(os.path.dirname(u) != folder for u in _open):  # another model's
            _open.clear()
            _own.clear()
        _open[uri] = kind(_load(uri))
    return _open[uri]


class WordShard:
    """Words with hashes in one range, and their counts."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.words, self.counts = EliasFano(*arrays[0:4]), arrays[4]


class PairShard:
    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.contexts, self.pointers, self.successors = (EliasFano(*arrays[i : i + 4]) for i in (0, 4, 8))
        self.values = arrays[12]

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The quantised value of each pair of context code and id, or -1; pairs sorted by ``left``."""
        out = np.full(len(left), -1, np.int64)
        if not self.contexts.n or not len(left):
            return out
        new = np.concatenate([[True], left[1:] != left[:-1]])
        at, known = self.contexts.find(left[new].astype(np.uint64))
        begin, end, base = (np.zeros(len(at), np.int64) for _ in range(3))
        k = np.flatnonzero(known)
        begin[k] = self.pointers.get(at[k]).astype(np.int64)
        end[k] = self.pointers.get(at[k] + 1).astype(np.int64)
        inner = k[begin[k] > 0]
        base[inner] = self.successors.get(begin[inner] - 1).astype(np.int64) + 1
        last = np.zeros(len(at), np.int64)
        last[k] = self.successors.get(end[k] - 1).astype(np.int64)
        of = np.cumsum(new) - 1
        x = base[of] + right
        ask = np.flatnonzero(known[of] & (x <= last[of]))
        where, hit = self.successors.find(x[ask].astype(np.uint64))
        hit &= (where >= begin[of[ask]]) & (where < end[of[ask]])
        out[ask[hit]] = self.values[where[hit]]
        return out


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _low_end(shard: int, shards: int) -> int:
    """The least hash of a shard."""
    return -(-(shard << 32) // shards) << 32


class Model:
    """What the driver knows of the levels: plain numbers and file names, a few for each shard."""

    def __init__(self, folder: str, shards: int, meta: list, texts: int) -> None:
        self.folder, self.shards, self.texts = folder, shards, texts
        by = {r.shard: r for r in meta}
        count = [by[s].words if s in by else 0 for s in range(shards)]
        if max(count, default=0) >= HOT_CODE:
            raise ValueError("a shard has too many words: train with more shards")
        self.present = np.array([s in by for s in range(shards)])
        self.base = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        self.tokens = sum(r.tokens for r in meta)
        self.vocabulary = int(self.base[-1])
        #: Ids of the hot contexts, ascending; the start symbol is one of them. At most tokens / HOT.
        self.hot = np.array([START, *sorted(int(self.base[r.shard]) + i for r in meta for i in r.hot)], np.int64)
        self.pairs: set[int] = set()
        self.weights: set[int] = set()
        self.start_weight = 1.0
        self.different = 0  # pairs

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(id or -1, count, back-off weight, different words before) for ascending hashes."""
        ids, counts, weight, before = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64), np.ones(len(h)), np.zeros(len(h), np.int64)
        cuts = np.searchsorted(_shard_of(h, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero((np.diff(cuts) > 0) & self.present).tolist():
            a, b = cuts[s], cuts[s + 1]
            level = _mapped(f"{self.folder}/words-{s:06d}.level", WordShard)
            at, hit = level.words.find(h[a:b] - np.uint64(_low_end(s, self.shards)))
            k = np.flatnonzero(hit)
            ids[a + k] = self.base[s] + at[k]
            counts[a + k] = level.counts[at[k]]
            if s in self.weights:
                table, different = _mapped(f"{self.folder}/weights-{s:06d}.level", list)
                weight[a + k] = 10.0 ** (table[at[k]] / -STEPS)
                before[a + k] = different[at[k]]
        return ids, counts, weight, before

    def keys(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, key) of pairs of ids; ``left`` may be the start symbol."""
        home = np.searchsorted(self.base, left, "right") - 1
        code = left - self.base[np.maximum(home, 0)]
        at = np.minimum(np.searchsorted(self.hot, left), len(self.hot) - 1)
        hot = np.flatnonzero(self.hot[at] == left)
        code[hot] = HOT_CODE + at[hot]
        home[hot] = _shard_of(mix(right[hot].astype(np.uint64) ^ mix(at[hot].astype(np.uint64))), self.shards)
        return home, (code.astype(np.uint64) << np.uint64(ID_BITS)) | right.astype(np.uint64)

    def context(self, shard: int, code: np.ndarray) -> np.ndarray:
        """The ids of a shard's context codes."""
        hot = code >= HOT_CODE
        return np.where(hot, self.hot[np.where(hot, code - HOT_CODE, 0)], self.base[shard] + code)

    def pair_counts(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The discounted counts of pairs of ids, 0 for those that training lacks."""
        out = np.zeros(len(left))
        shard, key = self.keys(left, right)
        by = np.lexsort((key, shard))
        cuts = np.searchsorted(shard[by], np.arange(self.shards + 1))
        for s in self.pairs:
            mine = by[cuts[s] : cuts[s + 1]]
            if len(mine):
                level = _mapped(f"{self.folder}/pairs-{s:06d}.level", PairShard)
                q = level.find(*_parts(key[mine]))
                out[mine] = np.where(q >= 0, (1 - DISCOUNT) * 10.0 ** (q / STEPS), 0.0)
        return out


def _parts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context code, successor's id) of pair keys."""
    return (key >> np.uint64(ID_BITS)).astype(np.int64), (key & np.uint64((1 << ID_BITS) - 1)).astype(np.int64)


# --- tokens --------------------------------------------------------------------------------------


def _tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, its row, first token of each row): the words of each row, then the end token."""
    w = words(block)
    h = hashes(LOWER[block.data], w.start, w.end)
    first = np.cumsum(w.per_row + 1) - (w.per_row + 1)
    out = np.full(len(h) + block.rows, END, np.uint64)
    row = np.repeat(np.arange(block.rows), w.per_row + 1)
    out[np.arange(len(h)) + w.row] = h
    return out, row, first


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ascending distinct values)."""
    codes, values = pd.factorize(x)
    by = np.argsort(values)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    return rank[codes], values[by]


def _pairs(codes: np.ndarray, first: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each token's pair, codes of the different pairs' contexts, of their successors); the start has code ``distinct``."""
    left = np.empty(len(codes), np.int64)
    left[1:] = codes[:-1]
    left[first] = distinct
    pair, found = pd.factorize(left * (distinct + 1) + codes)
    return pair, found // (distinct + 1), found % (distinct + 1)


# --- training ------------------------------------------------------------------------------------

COUNTED = "shard int, k long, c long"


def _batch(shard: np.ndarray, key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(shard.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(count.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["shard", "k", "c"])


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), BLOCK_BYTES):
                codes, values = pd.factorize(_tokens(block)[0])
                yield _batch(_shard_of(values, shards), values, np.bincount(codes, minlength=len(values)))

    return run


def _count_pairs(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), BLOCK_BYTES):
                h, _, first = _tokens(block)
                codes, distinct = _distinct(h)
                pair, left, right = _pairs(codes, first, len(distinct))
                ids = np.append(model.words(distinct)[0], START)
                yield _batch(*model.keys(ids[left], ids[right]), np.bincount(pair, minlength=len(left)))

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, ascending keys, their summed counts) of the shards of one partition."""
    found = [[batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for batch in batches]
    if not found:
        return
    shard, k, c = (np.concatenate(x) for x in zip(*found))
    found.clear()
    for s in np.unique(shard).tolist():
        mine = np.flatnonzero(shard == s)
        key = k[mine].view(np.uint64)
        by = np.argsort(key)
        key, count = key[by], c[mine][by]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        yield s, key[new], np.add.reduceat(count, new)


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _write_words(folder: str, shards: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, h, c in _gathered(batches):
            low, high = _low_end(shard, shards), _low_end(shard + 1, shards)
            _save(f"{folder}/words-{shard:06d}.level", [*eliasfano.encode(h - np.uint64(low), high - low), _narrow(c)])
            row = {"shard": shard, "words": len(h), "tokens": int(c.sum()), "hot": np.flatnonzero((c >= hot) & (h != np.uint64(END))).tolist()}
            yield pa.RecordBatch.from_pylist([row], WORDS_MADE)

    return run


WORDS_MADE = pa.schema([("shard", pa.int32()), ("words", pa.int64()), ("tokens", pa.int64()), ("hot", pa.list_(pa.int64()))])


def _write_pairs(model: Model):
    """Writes the shards of pairs, and gives for each word of a shard ``(shard of the word, id, successors, words before)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, k, c in _gathered(batches):
            left, right = _parts(k)
            begin = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
            pointers = np.concatenate([begin, [len(left)]])
            # Each context's successors start after the last value of the context before.
            step = np.concatenate([[0], right[pointers[1:-1] - 1] + 1])
            values = right + np.repeat(np.cumsum(step), np.diff(pointers))
            quantised = np.rint(np.log10((c - DISCOUNT) / (1 - DISCOUNT)) * STEPS).astype(np.uint16)
            parts = [
                *eliasfano.encode(left[begin], 2 * HOT_CODE),
                *eliasfano.encode(pointers, len(left) + 1),
                *eliasfano.encode(values, int(values[-1]) + 1),
            ]
            _save(f"{model.folder}/pairs-{shard:06d}.level", [*parts, quantised])
            contexts, words = model.context(shard, left[begin]), np.unique(right, return_counts=True)
            ids = np.concatenate([contexts, words[0]])
            after = np.concatenate([np.diff(pointers), np.zeros(len(words[0]), np.int64)])
            before = np.concatenate([np.zeros(len(contexts), np.int64), words[1]])
            home = (np.searchsorted(model.base, ids, "right") - 1).astype(np.int32)
            columns = [pa.array(x) for x in (home, ids, after, before, np.full(len(ids), shard, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "id", "after", "before", "of"])

    return run


def _write_weights(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        pairs, of, start = 0, set(), 0
        for batch in batches:
            shard, ids, after, before, made = (batch.column(i).to_numpy() for i in range(5))
            pairs += int(after.sum())
            of.update(np.unique(made).tolist())
            for s in np.unique(shard).tolist():
                mine = np.flatnonzero(shard == s)
                if s < 0:
                    start += int(after[mine].sum())
                    continue
                if s not in tables:
                    n = int(model.base[s + 1] - model.base[s])
                    tables[s] = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for table, x in zip(tables[s], (after, before)):
                    np.add.at(table, ids[mine] - model.base[s], x[mine])
        for s, (after, before) in tables.items():
            counts = _mapped(f"{model.folder}/words-{s:06d}.level", WordShard).counts
            weight = np.where(after > 0, after * DISCOUNT / counts, 1.0)
            table = np.minimum(np.rint(-np.log10(weight) * STEPS), 65535).astype(np.uint16)
            _save(f"{model.folder}/weights-{s:06d}.level", [table, _narrow(before)])
        row = {"shards": sorted(tables), "of": sorted(of), "pairs": pairs, "start": start}
        yield pa.RecordBatch.from_pylist([row], WEIGHTS_MADE)

    return run


WEIGHTS_MADE = pa.schema([("shards", pa.list_(pa.int32())), ("of", pa.list_(pa.int32())), ("pairs", pa.int64()), ("start", pa.int64())])


def train(texts: DataFrame, shards: int | None = None, hot: int = HOT) -> Model:
    """The model of all rows of ``texts(text)``."""
    spark = scratch.ship(texts.sparkSession)
    folder = scratch.new_path(spark, "ngrams")
    texts = texts.select("text")
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    shards = shards or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size.chars // SHARD_CHARS))
    parts = max(1, shards // 2)

    counts = texts.mapInArrow(_count_words(shards), COUNTED).repartition(parts, "shard")
    made = counts.mapInArrow(_write_words(folder, shards, hot), "shard int, words long, tokens long, hot array<long>")
    model = Model(folder, shards, scratch.materialise(made, "meta").collect(), size.n)

    pairs = texts.mapInArrow(_count_pairs(model), COUNTED).repartition(parts, "shard")
    seen = pairs.mapInArrow(_write_pairs(model), "shard int, id long, after long, before long, of int").repartition(parts, "shard")
    made = seen.mapInArrow(_write_weights(model), "shards array<int>, of array<int>, pairs long, start long")
    for r in scratch.materialise(made, "meta").collect():
        model.weights.update(r.shards)
        model.pairs.update(r.of)
        model.different += r.pairs
        model.start_weight = r.start * DISCOUNT / size.n if r.start else model.start_weight
    return model


# --- scoring -------------------------------------------------------------------------------------


def score_block(model: Model, block: Block) -> list[np.ndarray]:
    """[tokens, known tokens, base score, score] of each row."""
    h, row, first = _tokens(block)
    codes, distinct = _distinct(h)
    ids, counts, weights, before = model.words(distinct)
    single = np.log10((counts + 1.0) / (model.tokens + model.vocabulary + 1.0))
    lower = (before + 1.0) / (model.different + model.vocabulary + 1.0)
    pair, left, right = _pairs(codes, first, len(distinct))
    ids, total, weights = np.append(ids, START), np.append(counts, model.texts), np.append(weights, model.start_weight)
    p = weights[left] * lower[right]
    at = np.flatnonzero((total[left] > 0) & (ids[right] >= 0))
    if len(at) and model.pairs:
        p[at] += model.pair_counts(ids[left[at]], ids[right[at]]) / total[left[at]]
    n = block.rows
    tokens = np.bincount(row, minlength=n)
    known = np.bincount(row, weights=(counts > 0)[codes], minlength=n).astype(np.int64)
    return [tokens, known, np.bincount(row, weights=single[codes], minlength=n), np.bincount(row, weights=np.log10(p)[pair], minlength=n)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs(doc_id, text)``."""
    scratch.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), BLOCK_BYTES):
                found = [pa.array(x) for x in score_block(model, block)]
                trained = pa.array(np.full(block.rows, model.tokens, np.int64))
                columns = [batch.column(0).slice(block.lo, block.rows), *found[:2], trained, *found[2:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
