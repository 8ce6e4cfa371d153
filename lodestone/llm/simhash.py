"""SimHash near-duplicates by tiled exact comparison.

Texts become 64-bit fingerprints over word shingles. Equal fingerprints are
merged first. Two distinct fingerprints within ``radius`` bits agree on all of
at least one choice of ``blocks - radius`` blocks of bits, so they meet in the
bucket of that choice; within a bucket fingerprints lie in tiles of bounded
size, and pairs of tiles are compared exactly with numpy exclusive-or and bit
counts, unless their population counts differ by more than the radius, in which
case the pair is skipped. A comparison returns a spanning forest of the links
it finds and never the pairs themselves, so groups of any size give at most as
many rows as they have members for each tile pair.

Defined cases: null and empty texts (and texts without a word) have fingerprint
zero and are linked like any other; repeated rows and ties share a component;
a null ``doc_id`` gets its component but never names one; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .components import components
from .words import binary_column

SEED = 42
#: Fingerprints of one tile.
TILE = 2048
#: Buckets up to this size are compared by sliding over the sorted rows.
SMALL = 32
#: Rows of the table of large buckets that may be broadcast; beyond it is joined by a shuffle.
MAX_BROADCAST = 200_000


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = (end - size)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(start, end[shingle - 1 :].tolist())], np.uint64)
    votes = np.zeros(64, np.int64)
    full = len(h) // 255 * 255
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    if full:
        votes += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    votes += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_column(batch.column(1))
            found = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``: each row's fingerprint as a signed long."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of each choice of ``blocks - radius`` of the fingerprint's blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    signed = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in signed]


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (y := self.up.get(root, root)) != root:
            root = y
        while (y := self.up.get(x, x)) != root:
            self.up[x], x = root, y
        return root

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist()):
            a, b = self.find(a), self.find(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def edges(self) -> pa.RecordBatch:
        pairs = [(x, self.find(x)) for x in list(self.up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])


def compare_tiles(left: np.ndarray, right: np.ndarray, radius: int, forest: _Forest, width: int = 256) -> int:
    """Link what lies within the radius; returns how many sub-tile pairs were compared."""
    same = left is right
    count = lambda x: np.bitwise_count(x)
    left = left[np.argsort(count(left), kind="stable")]
    right = left if same else right[np.argsort(count(right), kind="stable")]
    done, lpop, rpop = 0, count(left).astype(int), count(right).astype(int)
    for i in range(0, len(left), width):
        a, low, high = left[i : i + width], lpop[i], lpop[min(i + width, len(left)) - 1]
        for j in range(i if same else 0, len(right), width):
            if rpop[j] - high > radius or low - rpop[min(j + width, len(right)) - 1] > radius:
                continue
            done += 1
            b = right[j : j + width]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            if same and i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                forest.link(a[x].view(np.int64), b[y].view(np.int64))
    return done


def _small_tiles(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            size = np.diff(column.offsets.to_numpy())
            values = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() :].view(np.uint64)
            start = np.concatenate([[0], np.cumsum(size)])
            forest = _Forest()
            bucket = np.repeat(np.arange(len(size)), size)
            few = np.flatnonzero((size <= SMALL)[bucket])
            v, k = values[few], bucket[few]
            for d in range(1, SMALL):
                hit = (k[d:] == k[:-d]) & (np.bitwise_count(v[d:] ^ v[:-d]) <= radius)
                at = np.flatnonzero(hit)
                if len(at):
                    forest.link(v[at].view(np.int64), v[at + d].view(np.int64))
            for i in np.flatnonzero(size > SMALL):
                tile = values[start[i] : start[i + 1]]
                compare_tiles(tile, tile, radius, forest)
            yield forest.edges()

    return run


def _tile_pairs(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forest = _Forest()
            for a, b in zip(batch.column(0), batch.column(1)):
                left = a.values.to_numpy(zero_copy_only=False).view(np.uint64)
                right = b.values.to_numpy(zero_copy_only=False).view(np.uint64)
                compare_tiles(left, left if np.array_equal(left, right) else right, radius, forest)
            yield forest.edges()

    return run


def links(distinct: DataFrame, radius: int, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """A spanning forest ``(u, v)`` of the links between distinct fingerprints ``(fp)``."""
    blocks = blocks or radius + 1
    spark = distinct.sparkSession
    keys = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks(radius, blocks))]
    placed = distinct.select("fp", F.inline(F.array(*keys)))
    counts = placed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    large = scratch.materialise(counts.where(F.col("n") > tile).select("t", "key"), "large")
    n_large = large.count()
    if not n_large:
        # The bucket lists hold at most `tile` fingerprints each.
        lists = placed.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        return lists.select("fps").mapInArrow(_small_tiles(radius), "u long, v long").distinct()

    hint = F.broadcast if n_large <= MAX_BROADCAST else (lambda x: x)
    rest = placed.join(hint(large), ["t", "key"], "left_anti")
    lists = rest.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    few = lists.select("fps").mapInArrow(_small_tiles(radius), "u long, v long")

    # A large bucket is cut into tiles by population count, and those into parts by hash.
    crowd = placed.join(hint(large), ["t", "key"]).withColumn("pop", F.expr("bit_count(fp)"))
    parts = crowd.groupBy("t", "key", "pop").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts"))
    parts = scratch.materialise(parts, "parts")
    hint = F.broadcast if parts.count() <= MAX_BROADCAST else (lambda x: x)
    tiles = (
        crowd.join(hint(parts), ["t", "key", "pop"])
        .withColumn("part", F.expr("pmod(xxhash64(fp), parts)").cast("int"))
        .groupBy("t", "key", "pop", "part")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = scratch.materialise(tiles, "tiles")
    a = tiles.select("t", "key", *[F.col(c).alias(f"{c}_a") for c in ("pop", "part", "fps")])
    b = tiles.select("t", "key", *[F.col(c).alias(f"{c}_b") for c in ("pop", "part", "fps")])
    near = (F.col("pop_b") - F.col("pop_a")).between(0, radius) & ((F.col("pop_a") < F.col("pop_b")) | (F.col("part_a") <= F.col("part_b")))
    pairs = a.join(b, ["t", "key"]).where(near).select("fps_a", "fps_b")
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    many = pairs.repartition(n).mapInArrow(_tile_pairs(radius), "u long, v long")
    return few.union(many).distinct()


def named(prints: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(fp, component, component_id)`` of each distinct fingerprint, by the links ``(u, v)`` between them."""
    nodes = scratch.materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    groups = components(linked(nodes.select("fp")))
    joined = nodes.join(groups, nodes.fp == groups.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return scratch.materialise(joined.join(least, "component").select("fp", "component", "component_id"), "named")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the least ``doc_id`` reachable over links of at most
    ``radius`` differing bits.
    """
    scratch.ship(docs.sparkSession)
    prints = scratch.materialise(fingerprints(docs, shingle), "fingerprints")
    found = named(prints, lambda distinct: links(distinct, radius, blocks, tile))
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component of ``docs(doc_id, text, ...)``: the one whose ``doc_id`` names it.

    Rows that share their ``doc_id`` or lack one are told apart by their
    fingerprints; of equal ones, and in a component without any ``doc_id``, the least by id, text and other columns stays.
    """
    scratch.ship(docs.sparkSession)
    prints = scratch.materialise(fingerprints(docs, shingle), "fingerprints")
    return one_of_each(docs, prints, named(prints, lambda distinct: links(distinct, radius)), partial(fingerprint, shingle=shingle))


def one_of_each(docs: DataFrame, prints: DataFrame, named: DataFrame, fingerprint: Callable[[bytes], int]) -> DataFrame:
    """The rows of ``docs`` that ``representatives`` keeps, given each row's print and each print's component."""
    odd = scratch.materialise(prints.groupBy("doc_id").count().where("doc_id is null or count > 1").select("doc_id"), "odd")
    drop = prints.join(named, "fp").where("doc_id <> component_id").select("doc_id")
    alone = scratch.without(docs.where("doc_id is not null"), drop.union(odd))
    if odd.isEmpty():
        return alone
    some = docs.join(odd.withColumnRenamed("doc_id", "odd_id"), F.col("doc_id").eqNullSafe(F.col("odd_id")), "left_semi")
    text, columns = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or b"") for t in binary_column(batch.column(text))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*columns, "lodestone_fp"])

    printed = some.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lodestone_fp", T.LongType())]))
    names = named.select(F.col("fp").alias("lodestone_fp"), F.col("component").alias("lodestone_c"), F.col("component_id").alias("lodestone_id"))
    ours = printed.join(names, "lodestone_fp").where("lodestone_id is null or doc_id = lodestone_id")
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    # Of several rows the least one by id, text and all other columns stays, whatever the order of the rows.
    one = ours.groupBy("lodestone_c").agg(F.min_by(row, F.struct("doc_id", "text", F.to_json(row))).alias("lodestone_row"))
    return alone.union(one.select("lodestone_row.*"))
