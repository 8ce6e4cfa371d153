"""Near-duplicates by wide SimHash fingerprints in tiles, with an exact check of the links.

Two texts are linked if the sets of their shingles (runs of ``SHINGLE`` words)
have a Jaccard similarity of ``SIMILARITY`` or more. Equal sets are merged
first. A set gets a fingerprint of ``64 * LANES`` bits, each set if it is set in
over half of its shingles' hashes, and ``KEYS`` keys, its least shingle in as many
orders. Sets that share a key lie in one bucket; buckets are cut into tiles and
compared exactly with numpy exclusive-or and bit counts, and pairs of tiles whose
population counts differ by more than ``RADIUS`` are skipped. A pair of tiles
gives a spanning forest of the pairs within the radius, those that differ in the
fewest bits first, so no group's pairs are listed. The forests' pairs are then
checked by the sets themselves, each set with the nearest set before it. What is
within the radius and isn't in one component by then is checked in a second pass
over the tiles, which has the sets at hand and gives a forest of the links again.

A pair of similarity 0.8 shares none of the keys with a probability of 0.2 to
the power of ``KEYS`` (1e-7), and differs in 39 bits on average, in more than
``RADIUS`` with a probability below 1e-7 (5e-5 for texts of eight words, where
bits are decided by four hashes). No other link is lost.

Defined cases: texts without a word have the empty set and are linked to each
other; a text shorter than a shingle has its words as the only one; a null
``doc_id`` gets its component but never names one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, simhash
from .components import components
from .words import LOWER, Block, blocks, hashes, mix, release, words

SHINGLE = 5
#: Numerator and denominator of the least similarity.
SIMILARITY = (4, 5)
LANES = 4
KEYS = 10
RADIUS = 72
#: Sets of one tile.
TILE = 512
#: Lists of sets, and pairs of sets, in one Arrow batch.
BATCH = 16
PAIR_BATCH = 200
#: Rows of a table that a join may broadcast, at most; beyond it the join is a shuffle.
MAX_BROADCAST = 1_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: The bits of each byte value.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
SKETCH = "doc_id long, fp long, " + ", ".join(f"l{i} long" for i in range(LANES)) + ", keys array<long>"
_LANES = [f"l{i}" for i in range(LANES)]


def _chain(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    x = h[at]
    for j in range(1, k):
        x = mix(x * _FACTOR + h[at + j])
    return x


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, set offsets of the rows), ascending in each row."""
    w = words(block)
    h = hashes(LOWER[block.data], w.start, w.end)
    at = np.flatnonzero(w.row[SHINGLE - 1 :] == w.row[: max(len(h) - SHINGLE + 1, 0)])
    found, row = [_chain(h, at, SHINGLE)], [w.row[at]]
    first = np.cumsum(w.per_row) - w.per_row
    for k in range(1, SHINGLE):
        few = np.flatnonzero(w.per_row == k)
        found.append(_chain(h, first[few], k))
        row.append(few)
    found, row = np.concatenate(found), np.concatenate(row)
    by = np.lexsort((found, row))
    found, row = found[by], row[by]
    if len(found):
        new = np.concatenate([[True], (found[1:] != found[:-1]) | (row[1:] != row[:-1])])
        found, row = found[new], row[new]
    return found, np.searchsorted(row, np.arange(block.rows + 1))


def _prints(found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each set: equal sets have equal ones; the empty set's is 0."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found ^ _FACTOR), dtype=np.uint64)])
    n = np.diff(offsets).astype(np.uint64)
    return np.where(n > 0, mix(total[offsets[1:]] - total[offsets[:-1]] + n), np.uint64(0)).view(np.int64)


def fingerprints(found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x LANES: bit i is set if over half of the set's hashes have it; 0 for the empty set."""
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), LANES), np.uint64)
    for lane in range(LANES):
        raw = mix(found + np.uint64(lane * int(_FACTOR) % 2**64)).view(np.uint8).reshape(-1, 8)
        bits = []
        for byte in range(8):
            votes = np.bincount(row * 256 + raw[:, byte], minlength=len(n) * 256).reshape(-1, 256).astype(np.float64) @ _BITS
            bits.append(votes * 2 > n[:, None])
        out[:, lane] = np.packbits(np.concatenate(bits, axis=1), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def keys(found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x KEYS: the least shingle of each set in each order; 0 for the empty set."""
    out = np.zeros((len(offsets) - 1, KEYS), np.uint64)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        for k in range(KEYS):
            out[some, k] = np.minimum.reduceat(mix(found ^ mix(np.array([k + 1], np.uint64))), offsets[some])
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1)):
            found, offsets = shingles(block)
            lanes = fingerprints(found, offsets).view(np.int64)
            flat = pa.array(keys(found, offsets).view(np.int64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, KEYS, dtype=np.int32)), flat)
            ids = batch.column(0).slice(block.lo, block.rows)
            columns = [ids, pa.array(_prints(found, offsets)), *(pa.array(lanes[:, i]) for i in range(LANES)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", *_LANES, "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(0)):
            found, offsets = shingles(block)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_prints(found, offsets)), lists], ["fp", "grams"])


# --- tiles ---------------------------------------------------------------------------------------


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The differing bits of each fingerprint of ``left`` (rows x LANES) and each of ``right``."""
    out = np.zeros((len(left), len(right)), np.uint16)
    for lane in range(left.shape[1]):
        out += np.bitwise_count(left[:, lane][:, None] ^ right[:, lane][None, :])
    return out


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the radius, as (place in ``left``, place in ``right``, bits).

    It is a minimum one by the differing bits. ``right`` is None for the pairs within ``left``.
    """
    d = distances(left, left if right is None else right)
    if right is None:
        np.fill_diagonal(d, radius + 1)
    n, m = d.shape
    # The right side's components are numbered after the left side's, or are the same.
    label = np.arange(n if right is None else n + m)
    mine, theirs = np.arange(n), np.arange(m) + (0 if right is None else n)
    found = [np.zeros(0, np.int64)] * 2
    while True:
        here, there = label[mine], label[theirs]
        d[here[:, None] == there[None, :]] = radius + 1
        x, y = np.arange(n), d.argmin(axis=1)
        if right is not None:
            x, y = np.concatenate([x, d.argmin(axis=0)]), np.concatenate([y, np.arange(m)])
        bits = d[x, y].astype(np.int64)
        near = np.flatnonzero(bits <= radius)
        if not len(near):
            break
        # Each component's nearest pair; ties go by place, so that no circle of equal ones arises.
        x, y, bits = x[near], y[near], bits[near]
        place = bits * (n * m) + (np.minimum(x, y) * m + np.maximum(x, y) if right is None else x * m + y)
        by = np.argsort(place, kind="stable")
        ends = np.concatenate([label[mine[x[by]]], label[theirs[y[by]]]])
        first = np.unique(ends, return_index=True)[1] % len(by)
        take = by[np.unique(first)]
        for i in take.tolist():
            a, b = label[mine[x[i]]], label[theirs[y[i]]]
            if a != b:
                label[label == max(a, b)] = min(a, b)
                found[0], found[1] = np.append(found[0], x[i]), np.append(found[1], y[i])
    both = distances_of(left[found[0]], (left if right is None else right)[found[1]])
    return found[0], found[1], both


def distances_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)


class Tile:
    """Members of a bucket: ``fps``, ``lanes``, and for the later passes ``group``, the bucket's ``t`` and ``key``, and ``grams``, their sets."""

    def __init__(self, members: pa.StructArray) -> None:
        names = [f.name for f in members.type]
        column = {n: members.field(i) for i, n in enumerate(names)}
        plain = lambda n: column[n].to_numpy(zero_copy_only=False) if n in column else None
        self.fps, self.group, self.t, self.key = (plain(n) for n in ("fp", "group", "t", "key"))
        self.lanes = np.stack([plain(n).view(np.uint64) for n in _LANES], axis=1)
        self.grams = [g.values.to_numpy(zero_copy_only=False) for g in column["grams"]] if "grams" in column else None


def _tiles(column: pa.ListArray) -> Iterator[Tile]:
    off = column.offsets.to_numpy()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield Tile(column.values.slice(a, b - a))


def _run(work, schema: pa.Schema):
    """``work(left, right)`` on each row's tiles gives output columns; ``right`` is None for the pairs within ``left``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            if batch.num_columns == 1:
                found = [work(left, None) for left in _tiles(batch.column(0))]
            else:
                for left, right in zip(_tiles(batch.column(0)), _tiles(batch.column(1))):
                    found.append(work(left, None if np.array_equal(left.fps, right.fps) else right))
            columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], schema=schema)
            release()

    return run


def over_tiles(placed: DataFrame, fields: list[str], work, names: list[str], radius: int, tile: int) -> DataFrame:
    """``work`` on all buckets of ``placed(t, key, n, fp, l0 ..., fields)``, n being their size, in tiles of bounded size."""
    spark = placed.sparkSession
    schema, ddl = pa.schema([(n, pa.int64()) for n in names]), ", ".join(f"{n} long" for n in names)
    member = F.struct("fp", *_LANES, *fields).alias("member")
    lists = placed.where(F.col("n") <= tile).groupBy("t", "key").agg(F.collect_list(member).alias("members"))
    few = lists.select("members").mapInArrow(_run(work, schema), ddl)
    crowd = placed.where(F.col("n") > tile)
    # A large bucket is cut into tiles by population count, and those into parts by hash.
    pop = sum((F.bit_count(c) for c in _LANES[1:]), F.bit_count(_LANES[0]))
    crowd = crowd.withColumn("pop", F.floor(pop / 8).cast("int"))
    parts = scratch.materialise(crowd.groupBy("t", "key", "pop").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts")), "parts")
    count = parts.count()
    if not count:
        return few
    hint = F.broadcast if count <= MAX_BROADCAST else (lambda x: x)
    part = F.expr("pmod(xxhash64(fp), parts)").cast("int").alias("part")
    tiles = crowd.join(hint(parts), ["t", "key", "pop"]).select("t", "key", "pop", part, member)
    tiles = scratch.materialise(tiles.groupBy("t", "key", "pop", "part").agg(F.collect_list("member").alias("members")), "tiles")
    a, b = (tiles.select("t", "key", *[F.col(c).alias(f"{c}_{x}") for c in ("pop", "part", "members")]) for x in "ab")
    after = (F.col("pop_a") < F.col("pop_b")) | ((F.col("pop_a") == F.col("pop_b")) & (F.col("part_a") <= F.col("part_b")))
    # The least difference between counts of two steps of eight.
    near = (F.col("pop_b") - F.col("pop_a")) * 8 - 7 <= radius
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    many = a.join(b, ["t", "key"]).where(after & near).select("members_a", "members_b").repartition(n)
    return few.union(many.mapInArrow(_run(work, schema), ddl))


def _forest_work(radius: int):
    def work(left: Tile, right: Tile | None) -> list[np.ndarray]:
        x, y, bits = forest(left.lanes, None if right is None else right.lanes, radius)
        u, v = left.fps[x], (right or left).fps[y]
        return [np.minimum(u, v), np.maximum(u, v), bits]

    return work


def _open_work(radius: int):
    """The members that are within the radius of one of another group."""

    def work(left: Tile, right: Tile | None) -> list[np.ndarray]:
        other = right or left
        near = (distances(left.lanes, other.lanes) <= radius) & (left.group[:, None] != other.group[None, :])
        out = [np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))]
        return [np.concatenate([getattr(tile, name)[at] for tile, at in zip((left, other), out)]) for name in ("t", "key", "fps")]

    return work


def _exact_work(radius: int):
    """A forest of the links between groups, by the sets themselves."""

    def work(left: Tile, right: Tile | None) -> list[np.ndarray]:
        other, (top, low) = right or left, SIMILARITY
        near = (distances(left.lanes, other.lanes) <= radius) & (left.group[:, None] != other.group[None, :])
        sizes = np.array([len(g) for g in other.grams], np.int64)
        codes, member = np.unique(np.concatenate(other.grams), return_inverse=True)[1], np.repeat(np.arange(len(sizes)), sizes)
        values = np.unique(np.concatenate(other.grams))
        by = np.argsort(codes, kind="stable")
        holders, start = member[by], np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(values)))])
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = up[x]
            return x

        found: list[list[int]] = [[], []]
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            gram = left.grams[i]
            at = np.minimum(np.searchsorted(values, gram), len(values) - 1)
            at = at[values[at] == gram]
            n = start[at + 1] - start[at]
            places = np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(holders[places], minlength=len(sizes))
            for j in np.flatnonzero(near[i] & (shared * low >= top * (len(gram) + sizes - shared))).tolist():
                a, b = find(int(left.group[i])), find(int(other.group[j]))
                if a != b:
                    up[max(a, b)] = min(a, b)
                    found[0].append(int(left.fps[i]))
                    found[1].append(int(other.fps[j]))
        return [np.array(f, np.int64) for f in found]

    return work


def buckets(sets: DataFrame) -> DataFrame:
    """``(t, key, n, fp, l0 ..., other columns)``: the members of all buckets of two or more; ``sets(fp, l0 ..., keys)``."""
    others = [c for c in sets.columns if c != "keys"]
    placed = sets.select(*others, F.posexplode("keys").alias("t", "key"))
    counts = scratch.materialise(placed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    hint = F.broadcast if counts.count() <= MAX_BROADCAST else (lambda x: x)
    return placed.withColumn("t", F.col("t").cast("long")).join(hint(counts), ["t", "key"])


def candidates(sets: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Spanning forests ``(u, v, bits)`` of the pairs within the radius of the distinct ``sets(fp, l0 ..., keys)``."""
    return over_tiles(buckets(sets), [], _forest_work(radius), ["u", "v", "bits"], radius, tile)


# --- exact check ---------------------------------------------------------------------------------


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, as ascending or at least distinct values, are linked."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    top, low = SIMILARITY
    return both * low >= top * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for i in (2, 3):
            lists = batch.column(i)
            values, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sides.append([values[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())])
        hit = pa.array([similar(a, b) for a, b in zip(*sides)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(hit)


def _grams(docs: DataFrame, fps: DataFrame, sketches: DataFrame) -> DataFrame:
    """``(fp, grams)``: the sets of the distinct ``fps(fp)``; only texts that have one of them are read into sets."""
    needed = scratch.materialise(fps.distinct(), "needed")
    few = F.broadcast(needed) if needed.count() <= MAX_BROADCAST else needed
    ids = scratch.materialise(sketches.join(few, "fp", "left_semi").where("doc_id is not null").select("doc_id").distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids
    texts = docs.join(ids, "doc_id", "left_semi").select("text").union(docs.where("doc_id is null").select("text"))
    sets = texts.mapInArrow(_sets, "fp long, grams array<long>").join(few, "fp", "left_semi")
    return scratch.materialise(sets.groupBy("fp").agg(F.first("grams").alias("grams")), "sets")


def _linked(docs: DataFrame, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of the pairs ``(u, v)`` of sets that are similar enough."""
    pairs = scratch.materialise(pairs, "pairs")
    sets = _grams(docs, pairs.select(F.col("u").alias("fp")).union(pairs.select("v")), sketches)
    left = sets.select(F.col("fp").alias("u"), F.col("grams").alias("a"))
    right = sets.select(F.col("fp").alias("v"), F.col("grams").alias("b"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
    with scratch.small_batches(docs.sparkSession, PAIR_BATCH):
        out = scratch.materialise(both.mapInArrow(_verify, "u long, v long"), "links")
    scratch.discard(sets)
    scratch.discard(pairs)
    return out


def links(docs: DataFrame, sketches: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``(u, v)`` between the distinct sets of ``docs(doc_id, text)`` that give the components."""
    sets = sketches.groupBy("fp").agg(*[F.first(c).alias(c) for c in (*_LANES, "keys")])
    sets = scratch.materialise(sets, "distinct")
    # Each set's nearest one of those before it: as many pairs as sets at most.
    nearest = candidates(sets, radius, tile).groupBy("v").agg(F.min(F.struct("bits", "u")).alias("near"))
    first = _linked(docs, nearest.select(F.col("near.u").alias("u"), "v"), sketches)
    groups = scratch.materialise(components(first), "groups")
    apart = buckets(sets.join(groups, sets.fp == groups.node, "left").select(*sets.columns, F.coalesce("component", "fp").alias("group")))
    mixed = apart.groupBy("t", "key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("t", "key")
    apart = scratch.materialise(apart.join(mixed, ["t", "key"], "left_semi"), "apart")
    still = over_tiles(apart, ["group", "t", "key"], _open_work(radius), ["t", "key", "fp"], radius, tile).distinct()
    still = scratch.materialise(still, "open")
    grams = _grams(docs, still.select("fp"), sketches)
    size = scratch.materialise(still.groupBy("t", "key").agg(F.count("*").alias("n")), "sizes")
    left = apart.drop("n").join(still, ["t", "key", "fp"]).join(size, ["t", "key"]).join(grams, "fp")
    with scratch.small_batches(docs.sparkSession, BATCH):
        second = over_tiles(scratch.materialise(left, "left"), ["group", "grams"], _exact_work(radius), ["u", "v"], radius, tile)
        return first.union(scratch.materialise(second, "second"))


def _distinct(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """``docs`` without rows whose set a row of a lesser ``doc_id`` has; each set stays."""
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    firsts = scratch.materialise(firsts.where("first_id is not null"), "firsts")
    later = prints.join(firsts, "fp").where("doc_id <> first_id").select("doc_id")
    later = later.join(firsts, later.doc_id == firsts.first_id, "left_anti")
    return scratch.without(docs.select("doc_id", "text"), later)


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, fp)`` of each row and ``(fp, component, component_id)`` of each distinct set."""
    scratch.ship(docs.sparkSession)
    sketches = scratch.materialise(docs.select("doc_id", "text").mapInArrow(_sketches, SKETCH), "sketches")
    prints = sketches.select("doc_id", "fp")
    return prints, simhash.named(prints, lambda _: links(_distinct(docs, prints), sketches))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, component_id)`` for every row of ``docs(doc_id, text)``: the least ``doc_id`` reachable over links."""
    prints, named = _named(docs)
    return prints.join(named, "fp").select("doc_id", "component_id")


def fingerprint(text: bytes) -> int:
    (block,) = blocks(pa.array([text], pa.large_binary()))
    return int(_prints(*shingles(block)).view(np.uint64)[0])


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs(doc_id, text, ...)``, by the rules of ``simhash.representatives``."""
    prints, named = _named(docs)
    return simhash.one_of_each(docs, prints, named, fingerprint)
