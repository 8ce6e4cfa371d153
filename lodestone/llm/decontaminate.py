"""Benchmark decontamination by template windows.

Words (cut at white space, stripped of marks at both ends, lower case) are
canonicalised: numbers, quantities (a number with letters), units and names (a
capitalised word inside a sentence) become typed placeholders. All windows of
``WINDOW`` canonical words of the benchmark are hashed into a table, an item
shorter than that as one window of its own length; the windows of every whole
text are joined with it by their hashes. A bitmap of the benchmark's hashes, of
at most ``2 ** MAX_BITS`` bits whatever the benchmark's size, goes to all workers
first, so that hardly any window without a partner is shuffled; it never decides
a result. A document and an item that share windows are then compared where the
windows lie: the fillers of the placeholders must map one to one, so the same
number or name of the item always stands for the same one of the document.
Windows whose fillers break the mapping of the majority are dropped. The pair is
reported if the windows left cover ``COVERAGE`` of the item's words or more:
``exact`` if all fillers are equal, ``reparameterised`` otherwise.

A window of placeholders alone says nothing and is left out. Windows of one copy
lie on a diagonal; each copy has a mapping of its own, and the best one counts.

Defined cases: null and empty texts, and items without a word, match nothing;
repeated rows are judged one by one; a null ``doc_id`` is reported as null;
items with equal texts are all reported; an empty table of documents or of
items gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .words import LOWER, Block, binary_column, blocks, hash_of, hashes, mix, words

WINDOW = 5
COVERAGE = 0.8
#: Bits of the bitmap of window hashes, as a power of two: 8 MB at most.
MAX_BITS = 26
#: Rows that the last anti-join may broadcast, at most; beyond it the join is a shuffle.
MAX_BROADCAST = 1_000_000
# The units that stand for a placeholder of their own.
UNITS = (
    "mm cm m km in ft yd mi mile miles inch inches foot feet metre metres meter meters mg g kg lb lbs oz gram grams ton tons "
    "ml l litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros pound pounds percent degrees kph mph w kw v"
)
NAME, NUMBER, QUANTITY, UNIT = (np.uint64(hash_of(f"\0{x}")) for x in ("name", "number", "quantity", "unit"))
_UNITS = np.array(sorted(hash_of(u) for u in UNITS.split()), np.uint64)

_CORE = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CORE[_a:_b] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = _CORE & ~_DIGIT
_UPPER, _SMALL = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _SMALL[97:123] = True
_SMALL[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:|"]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15


class Canon:
    """Canonical words of a block: template hash, own hash, whether it is a placeholder, and row."""

    def __init__(self, block: Block) -> None:
        w = words(block)
        data = block.data
        n = len(data)
        at = np.flatnonzero(_CORE[data])
        first = np.searchsorted(at, w.start)
        last = np.searchsorted(at, w.end) - 1
        has = last >= first
        self.starts_at = w.start[has]  # in the block's bytes
        start, end, row, raw_end = at[first[has]], at[last[has]] + 1, w.row[has], w.end[has]
        sums = lambda table: np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        digits, letters, lines = sums(_DIGIT), sums(_LETTER), np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])
        digit, letter = digits[end] > digits[start], letters[end] > letters[start]
        self.own = hashes(LOWER[data], start, end)
        number, quantity = digit & ~letter, digit & letter
        unit = np.isin(self.own, _UNITS)
        follows = np.zeros(len(start), bool)
        if len(start) > 1:
            same = row[1:] == row[:-1]
            stopped = _STOP[data[raw_end[:-1] - 1]] | (lines[start[1:]] > lines[raw_end[:-1]])
            follows[1:] = same & ~stopped
        # Capital first letter and a small second one: ASCII, or the capitals that UTF-8 writes as C3 80 to C3 9E.
        second = data[np.minimum(start + 1, n - 1)] if n else data
        third = data[np.minimum(start + 2, n - 1)] if n else data
        lead = data[start]
        title = (_UPPER[lead] & (end > start + 1) & _SMALL[second]) | ((lead == 0xC3) & (second < 0x9F) & (end > start + 2) & _SMALL[third])
        name = title & follows & ~digit
        self.template = self.own.copy()
        for mask, code in ((unit, UNIT), (name, NAME), (number, NUMBER), (quantity, QUANTITY)):
            self.template[mask] = code
        self.slot = unit | name | number | quantity
        self.row, self.rows = row, block.rows

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of each window of ``length`` words within one row; not all may be placeholders."""
        n = len(self.template) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        slots = np.concatenate([[0], np.cumsum(self.slot)])
        literal = slots[length:] - slots[:-length] < length
        inside = np.flatnonzero((self.row[:n] == self.row[length - 1 :]) & literal)
        total, factor = np.zeros(len(inside), np.uint64), 1
        for i in range(length):
            total += self.template[inside + i] * np.uint64(factor)
            factor = factor * _MULTIPLIER % 2**64
        return mix(total ^ np.uint64(length)), inside


# --- windows ---------------------------------------------------------------------------------------

_ITEM = "h long, item_no long, item_id long, first int, size int, mask int, own array<long>"
_HIT = "row long, doc_id long, print long, h long, word int, own array<long>"


def _fillers(own: np.ndarray, first: np.ndarray, length: int) -> pa.ListArray:
    """The words' own hashes of windows, ``WINDOW`` numbers for each, 0 beyond their length."""
    out = np.zeros((len(first), WINDOW), np.uint64)
    for k in range(length):
        out[:, k] = own[first + k]
    offsets = np.arange(0, out.size + 1, WINDOW, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.reshape(-1).view(np.int64)))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in _ITEM.split(", ")]
    for batch in batches:
        column = binary_column(batch.column(2))
        for i in range(batch.num_rows):
            for block in blocks(column.slice(i, 1)):
                c = Canon(block)
                size = len(c.template)
                length = min(WINDOW, size)
                if not length:
                    continue
                h, first = c.windows(length)
                mask = sum((c.slot[first + k].astype(np.int32) << k for k in range(length)), np.zeros(len(h), np.int32))
                n = len(h)
                same = [pa.array([batch.column(k)[i].as_py()] * n, pa.int64()) for k in (0, 1)]
                rest = [pa.array(first.astype(np.int32)), pa.array(np.full(n, size, np.int32)), pa.array(mask.astype(np.int32)), _fillers(c.own, first, length)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *same, *rest], names)


class Filter:
    """A bitmap of the leading bits of hashes, and the lengths of windows."""

    def __init__(self, bits: int, words: np.ndarray, lengths: list[int]) -> None:
        self.bits, self.words, self.lengths = bits, words, lengths

    def maybe(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _filter(windows: DataFrame) -> Filter:
    """Sixteen bits or more for each window up to the largest size; the bits are put together by an aggregate of 64-bit words."""
    r = windows.agg(F.approx_count_distinct("h").alias("n"), F.collect_set(F.least("size", F.lit(WINDOW))).alias("lengths")).first()
    bits = min(MAX_BITS, max(12, (16 * max(r.n, 1)).bit_length()))
    at = F.shiftrightunsigned("h", 64 - bits)
    rows = windows.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["w"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Filter(bits, words, sorted(r.lengths))


def _hits(shared):
    """The windows of texts that may be the benchmark's. Rows are numbered by task and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter, names = shared.value, [x.split(" ")[0] for x in _HIT.split(", ")]
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for block in blocks(batch.column(2)):
                c = Canon(block)
                starts = np.searchsorted(c.row, np.arange(block.rows))
                for length in filter.lengths:
                    h, first = c.windows(length)
                    maybe = np.flatnonzero(filter.maybe(h))
                    if not len(maybe):
                        continue
                    h, first = h[maybe], first[maybe]
                    of = c.row[first]
                    ids = [batch.column(k).take(pa.array(block.lo + of)) for k in (0, 1)]
                    word = (first - starts[of]).astype(np.int32)
                    columns = [pa.array(row + block.lo + of), *ids, pa.array(h.view(np.int64)), pa.array(word), _fillers(c.own, first, length)]
                    yield pa.RecordBatch.from_arrays(columns, names)
            row += batch.num_rows

    return run


# --- pairs -----------------------------------------------------------------------------------------


def _consistent(item_slots: list[tuple], doc_slots: list[tuple]) -> list[bool]:
    """Which windows agree with the one-to-one mapping of fillers that most of the windows support."""
    votes: Counter = Counter()
    for left, right in zip(item_slots, doc_slots):
        votes.update(set(zip(left, right)))
    forth: dict = {}
    back: dict = {}
    for (a, b), _ in sorted(votes.items(), key=lambda x: (-x[1], x[0])):
        if a not in forth and b not in back:
            forth[a], back[b] = b, a
    return [all(forth.get(a) == b for a, b in zip(left, right)) for left, right in zip(item_slots, doc_slots)]


def verdict(size: int, first: np.ndarray, word: np.ndarray, mask: np.ndarray, theirs: np.ndarray, ours: np.ndarray, coverage: float = COVERAGE) -> tuple[int, int, str] | None:
    """(words covered, placeholders covered, verdict) of an item and a text that share windows; None if they cover too little.

    ``first`` and ``word`` are the windows' places in item and text, ``theirs`` and ``ours`` their words' hashes there.
    """
    length = min(WINDOW, size)
    reach = np.zeros(size + 1, np.int64)
    np.add.at(reach, first, 1)
    np.add.at(reach, first + length, -1)
    if (np.cumsum(reach)[:size] > 0).sum() < coverage * size:
        return None
    slot = np.zeros(size, bool)
    for k in range(length):
        slot[first[(mask >> k) & 1 == 1] + k] = True
    copies = defaultdict(list)
    for n, k in enumerate(((word - first) // size).tolist()):
        copies[k].append(n)
    best = (0, 0, False)
    for k in copies:
        rows = copies[k] + copies.get(k + 1, [])
        marked = [[i for i in range(length) if mask[n] >> i & 1] for n in rows]
        left = [tuple(theirs[n, at].tolist()) for n, at in zip(rows, marked)]
        right = [tuple(ours[n, at].tolist()) for n, at in zip(rows, marked)]
        covered, equal = np.zeros(size, bool), True
        for n, good, x, y in zip(rows, _consistent(left, right), left, right):
            if good:
                covered[first[n] : first[n] + length] = True
                equal = equal and x == y
        best = max(best, (int(covered.sum()), int((covered & slot).sum()), equal))
    return (best[0], best[1], "exact" if best[2] else "reparameterised") if best[0] >= coverage * size else None


_PAIR = "doc_id long, print long, item_id long, n_item_words long, n_covered long, n_slots long, verdict string"
_JOINED = ("row", "item_no", "first", "word", "size", "mask", "doc_id", "print", "item_id")


def _judge(coverage: float):
    """Verdicts of rows sorted by (row, item); a pair may lie in several batches."""

    def pair(at: slice, x: dict[str, np.ndarray], theirs: np.ndarray, ours: np.ndarray):
        order = np.lexsort((x["first"][at], x["word"][at]))
        pick = lambda v: v[at][order]
        return verdict(int(x["size"][at.start]), *(pick(x[n]).astype(np.int64) for n in ("first", "word", "mask")), pick(theirs), pick(ours), coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _PAIR.split(", ")]
        waiting: list[pa.RecordBatch] = []

        def judged(table: pa.Table, last: bool):
            """(the verdicts of the whole pairs, the rows of the last one unless it's whole)."""
            x = {n: table[n].to_numpy() for n in ("row", "item_no", "first", "word", "size", "mask")}
            theirs, ours = (table[n].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WINDOW) for n in ("theirs", "ours"))
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(x["row"]) != 0) | (np.diff(x["item_no"]) != 0), [True]]))
            found = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b == len(table) and not last:
                    break
                v = pair(slice(a, b), x, theirs, ours)
                if v:
                    found.append((*(table[n][a].as_py() for n in ("doc_id", "print", "item_id", "size")), *v))
            out = pa.RecordBatch.from_pydict({n: pa.array([f[i] for f in found], pa.string() if n == "verdict" else pa.int64()) for i, n in enumerate(names)})
            return out, table.slice(int(cuts[-2])).to_batches() if not last else []

        for batch in batches:
            if batch.num_rows:
                out, waiting = judged(pa.Table.from_batches([*waiting, batch]), False)
                yield out
        if waiting:
            yield judged(pa.Table.from_batches(waiting), True)[0]

    return run


def _pairs(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """``find``'s rows with ``print``, a hash of the text."""
    spark = scratch.ship(docs.sparkSession)
    items = benchmark.where(F.col("text").isNotNull()).select(F.monotonically_increasing_id().alias("item_no"), F.col("item_id").cast("long").alias("item_id"), "text")
    windows = scratch.materialise(scratch.materialise(items, "items").mapInArrow(_item_windows, _ITEM), "windows")
    shared = spark.sparkContext.broadcast(_filter(windows))
    rows = docs.select("doc_id", F.xxhash64("text").alias("print"), "text")
    # Written once, so that the numbers of rows are the same for all that reads them.
    hits = scratch.materialise(rows.mapInArrow(_hits(shared), _HIT), "hits")
    joined = hits.withColumnRenamed("own", "ours").join(windows.withColumnRenamed("own", "theirs"), "h").select(*_JOINED, "theirs", "ours")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = joined.repartition(parts, "row", "item_no").sortWithinPartitions("row", "item_no")
    return scratch.materialise(ordered.mapInArrow(_judge(coverage), _PAIR), "pairs")


def find(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``(doc_id, item_id, n_item_words, n_covered, n_slots, verdict)`` for each contaminated pair."""
    return _pairs(docs, benchmark, coverage).drop("print")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` that hold no item; rows that share their ``doc_id`` are told apart by their texts."""
    bad = scratch.materialise(_pairs(docs, benchmark, coverage).select(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).distinct(), "bad")
    bad = F.broadcast(bad) if bad.count() <= MAX_BROADCAST else bad
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_print"))
    return docs.join(bad, same, "left_anti")
