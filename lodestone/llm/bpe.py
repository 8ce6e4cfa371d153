"""Exact BPE encoding and decoding with a transducer lexicon for frequent words.

The vocabulary file is a ``tokenizers`` JSON file with word ends and no decoder
(NFC, white space to blanks, lower case; then words by a pattern). The frequent
words of the corpus, counted over all rows, are merged once and compiled into a
minimal acyclic transducer with their ids (``lexicon``), which each Python
worker memory-maps. A text is cut at white space; a piece that a worker hasn't
met lately is normalised, cut by the pattern, and its words are looked up in
the transducer; words that it lacks are merged exactly by rank.

Defined cases: a null or empty text has no ids and decodes to an empty text;
other rows, repeated ones included, are encoded one by one; columns other than
those named are kept as they are; an empty table gives an empty result; words of
any length are merged whole (long ones with a heap).
"""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .lexicon import Lexicon, compile_words
from .pieces import PieceMemo
from .words import Block, blocks, release

#: Words of the lexicon, at most.
LEXICON_WORDS = 100_000
#: Texts are encoded in blocks of about so many bytes.
BLOCK_BYTES = 1 << 20
#: Ids of one block that is decoded at once, plus those of one row.
DECODE_IDS = 1 << 20


def _byte_letters() -> dict[int, str]:
    """The printable character for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class Vocabulary:
    """What a vocabulary file says, and exact merging by it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not splits[0]["invert"] or spec["decoder"]:
            raise ValueError(f"{path} isn't a word-end BPE vocabulary of the supported kind")
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"].replace(r"[^\s", r"[^\s\x85"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        vocab = model["vocab"]
        end = model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.final = [vocab[letters[b] + end] for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token

    def words(self, piece: str) -> list[str]:
        """The normalised words of a piece of text."""
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        piece = piece.lower()
        return [piece] if piece.isalpha() else self.pattern.findall(piece)

    def cut(self, piece: str) -> list[str | int]:
        """The piece's words, and the ids of the special tokens in it."""
        if "<|" not in piece:
            return self.words(piece)
        out: list[str | int] = []
        at = 0
        for m in self.special_pattern.finditer(piece):
            out += [*self.words(piece[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.words(piece[at:])

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.inner[b] for b in word[:-1]]
        ids.append(self.final[word[-1]])
        if len(ids) > 96:
            return self._merge_long(ids)
        merges = self.merges
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                found = merges.get((ids[i], ids[i + 1]))
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [ids[i] for i in range(n) if alive[i]]


class Encoder:
    """Encodes the pieces of blocks of texts; keeps those met lately."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.memo = PieceMemo(self.learn)

    def learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as little-endian uint32 bytes: from the lexicon, else merged."""
        v = self.vocabulary
        cut = [v.cut(p) for p in pieces]
        words = list({w for c in cut for w in c if type(w) is str})
        raw = [w.encode() for w in words]
        ids: dict[str | int, bytes] = {i: np.uint32(i).tobytes() for i in v.special.values()}
        ranks = self.lexicon.rank(raw) if self.lexicon else np.full(len(raw), -1)
        for word, b, rank in zip(words, raw, ranks.tolist()):
            ids[word] = self.lexicon.output(rank).tobytes() if rank >= 0 else np.array(v.merge(b), np.uint32).tobytes()
        return [ids[c[0]] if len(c) == 1 else b"".join([ids[w] for w in c]) for c in cut]

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows end to end, ids of each row)."""
        return self.memo.encode(block)


_encoders: dict[tuple, Encoder] = {}


def _encoder(vocabulary: str, lexicon: str | None) -> Encoder:
    key = (vocabulary, lexicon)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(vocabulary), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
    return _encoders[key]


def encode(docs: DataFrame, vocabulary: str, lexicon: str | None = None, column: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, the ids of ``column``; the column itself is dropped."""
    scratch.ship(docs.sparkSession)
    others = [c for c in docs.columns if c != column]
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, lexicon)
        for batch in batches:
            for block in blocks(batch.column(len(others)), BLOCK_BYTES):
                ids, size = encoder.encode(block)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int32)))
                part = batch.slice(block.lo, block.rows)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], lists], [*others, out])

    return docs.select(*[F.col(f"`{c}`") for c in [*others, column]]).mapInArrow(run, schema)


_tokens: dict[str, pa.Array] = {}


def _token_array(vocabulary: str) -> pa.Array:
    """This worker's array of the vocabulary's tokens; the merges aren't kept."""
    if vocabulary not in _tokens:
        _tokens.clear()
        _tokens[vocabulary] = pa.array(Vocabulary(vocabulary).tokens, pa.string())
    return _tokens[vocabulary]


def _runs(block: np.ndarray) -> Iterator[tuple[int, int]]:
    """The (first, end) of each run of equal values."""
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


def decode(encoded: DataFrame, vocabulary: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``, its ids' tokens joined by blanks; the ids are dropped."""
    scratch.ship(encoded.sparkSession)
    others = [c for c in encoded.columns if c != column]
    schema = T.StructType([encoded.schema[c] for c in others] + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _token_array(vocabulary)
        blank = pa.scalar(" ", pa.large_string())
        for whole in batches:
            size = pc.fill_null(pc.list_value_length(whole.column(len(others))), 0).to_numpy(zero_copy_only=False)
            block = np.cumsum(size, dtype=np.int64) // DECODE_IDS
            for at, end in _runs(block):
                lists = whole.column(len(others)).slice(at, end - at)
                flat = tokens.take(lists.flatten()).cast(pa.large_string())
                offsets = np.concatenate([[0], np.cumsum(size[at:end], dtype=np.int64)])
                joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), flat), blank).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*whole.slice(at, end - at).columns[: len(others)], joined], [*others, out])
            release()

    return encoded.select(*[F.col(f"`{c}`") for c in [*others, column]]).mapInArrow(run, schema)


def frequent_words(docs: DataFrame, limit: int = LEXICON_WORDS, column: str = "text") -> list[str]:
    """The words of letters that occur most over all rows: all above the least count that leaves at most ``limit``."""
    word = F.explode(F.split(F.lower(F.col(column)), r"\P{L}+"))
    counts = docs.select(word.alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    counts = scratch.materialise(counts, "words")
    total, least = 0, None
    # One row for each count that occurs: about the square root of the number of running words.
    for n, words in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        total += words
        if total > limit:
            break
        least = n
    found = [] if least is None else [r[0] for r in counts.where(F.col("n") >= least).select("word").collect()]
    scratch.discard(counts)
    return found


def ship_lexicon(docs: DataFrame, vocabulary: str, limit: int = LEXICON_WORDS) -> str:
    """Count, compile and send the lexicon to all executors; returns the file's name among Spark's files."""
    v = Vocabulary(vocabulary)
    entries = {}
    for found in frequent_words(docs, limit):
        for word in v.words(found):
            raw = word.encode()
            entries[raw] = entries.get(raw) or v.merge(raw)
    name = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-lexicon-"), name)
    with open(path, "wb") as f:
        f.write(compile_words(entries))
    docs.sparkSession.sparkContext.addFile(path)
    return name
