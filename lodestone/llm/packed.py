"""Token ids in fixed-width bit-packed shard files, with block offsets for random access.

A shard holds consecutive documents in ascending ``doc_id`` order:

* 8 bytes of magic;
* blocks of ``BLOCK`` ids, each id in ``width`` bits (the least number that holds
  every id of the vocabulary), little end first, each block padded to 8 bytes;
* the table of block offsets (uint64, one more than blocks), the documents' ids
  (int64, null as the least value) and their first positions (uint64, one more
  than documents);
* the footer: width, ids per block, blocks, documents, ids (uint64 each), magic.

A shard is written by one task, under a name of its own, and then moved to its
final name, so a task that runs again replaces its file whole. Readers take
any range of positions: the block offsets name the bytes, and numpy unpacks them
by one shift and mask for all ids at once.

Defined cases: a null text is an empty one and gives the end id alone; a null
``doc_id`` sorts first and is read back as null; rows with the same ``doc_id``
follow each other; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .words import blocks

MAGIC = b"LDSTPAK1"
BLOCK = 1 << 16
#: Bytes of text that are encoded at once.
BLOCK_BYTES = 1 << 20
NULL_ID = -(1 << 63)


def width_for(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    raw = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    return raw + bytes(-len(raw) % 8)


def unpack(raw: bytes, width: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from position ``first`` of a packed block."""
    bit = (np.arange(first, first + count, dtype=np.int64)) * width
    padded = np.frombuffer(bytes(raw) + bytes(8), np.uint8)
    lanes = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(padded) - 7,), (1,))
    shift = (bit & 7).astype(np.uint64)
    return ((lanes[bit >> 3] >> shift) & np.uint64((1 << width) - 1)).astype(np.uint32)


class ShardWriter:
    def __init__(self, uri: str, width: int) -> None:
        fs, self.final = scratch.filesystem(uri)
        fs.create_dir(os.path.dirname(self.final), recursive=True)
        self.fs, self.width = fs, width
        self.temporary = f"{self.final}.{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.at, self.offsets, self.docs, self.starts = 8, [8], [], [0]
        self.open: list[np.ndarray] = []
        self.waiting = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents with ``sizes`` ids each, whose ids lie end to end."""
        self.docs += [NULL_ID if d is None else d for d in doc_ids]
        self.starts += (self.starts[-1] + np.cumsum(sizes)).tolist()
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            self._flush(self.waiting // BLOCK * BLOCK)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.open) if self.open else np.zeros(0, np.uint32)
        for i in range(0, count, BLOCK):
            raw = pack(ids[i : min(i + BLOCK, count)], self.width)
            self.out.write(raw)
            self.at += len(raw)
            self.offsets.append(self.at)
        self.open, self.waiting = [ids[count:]], self.waiting - count

    def close(self) -> None:
        self._flush(self.waiting)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array(self.docs, "<i8").tobytes())
        self.out.write(np.array(self.starts, "<u8").tobytes())
        counts = [self.width, BLOCK, len(self.offsets) - 1, len(self.docs), self.starts[-1]]
        self.out.write(np.array(counts, "<u8").tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.final)


class Shard:
    """Read side: whole documents, or any range of positions."""

    def __init__(self, uri: str) -> None:
        fs, path = scratch.filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(48, size - 48)
        if tail[-8:] != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.width, self.block, n, docs, self.ids = np.frombuffer(tail[:40], "<u8").astype(int).tolist()
        at = size - 48 - 8 * (n + 1 + docs + docs + 1)
        table = self.file.read_at(size - 48 - at, at)
        self.offsets = np.frombuffer(table, "<u8", n + 1).astype(np.int64)
        self.docs = np.frombuffer(table, "<i8", docs, 8 * (n + 1))
        self.starts = np.frombuffer(table, "<u8", docs + 1, 8 * (n + 1 + docs)).astype(np.int64)

    def read(self, first: int, count: int) -> np.ndarray:
        """The ids at positions ``first`` to ``first + count``."""
        parts, end = [], first + count
        while first < end:
            b = first // self.block
            here = min(end, (b + 1) * self.block) - first
            raw = self.file.read_at(int(self.offsets[b + 1] - self.offsets[b]), int(self.offsets[b]))
            parts.append(unpack(raw, self.width, first - b * self.block, here))
            first += here
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def documents(self, run: int = 1 << 22) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, last + 1, ids) of runs of whole documents with about ``run`` ids."""
        a = 0
        while a < len(self.docs):
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + run, "right")) - 1)
            yield a, b, self.read(int(self.starts[a]), int(self.starts[b] - self.starts[a]))
            a = b


def write(docs: DataFrame, encoder, vocabulary_size: int, end_id: int, folder: str, column: str = "text") -> DataFrame:
    """Write ``docs(doc_id, column)`` to shards in ``folder`` and return the manifest.

    ``encoder()`` gives, in each task, an object whose ``encode(block)`` returns
    the ids of the block's rows end to end and their number in each row. The
    manifest has a row for each shard: ``(shard, uri, n_docs, n_ids, start)``,
    ``start`` being the ids of all shards before it. Documents are dealt by ranges
    of ``doc_id``, so no task has more than its share of rows and the shards are
    in order.
    """
    spark = scratch.ship(docs.sparkSession)
    width = width_for(vocabulary_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        uri, writer, coder = f"{folder}/shard-{shard:06d}.ids", None, encoder()
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for block in blocks(batch.column(1), BLOCK_BYTES):
                writer = writer or ShardWriter(uri, width)
                ids, sizes = coder.encode(block)
                ends = np.cumsum(sizes)
                writer.add(doc_ids[block.lo : block.lo + block.rows], np.insert(ids, ends, np.uint32(end_id)), sizes + 1)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "uri": uri, "n_docs": len(writer.docs), "n_ids": writer.starts[-1]}])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ordered = docs.select("doc_id", column).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", column)
    manifest = ordered.mapInArrow(run, "shard long, uri string, n_docs long, n_ids long")
    # A row for each shard; the running sum of a few rows needs no distribution.
    rows, start = [], 0
    for r in sorted(scratch.materialise(manifest, "manifest").collect(), key=lambda r: r.shard):
        rows.append((r.shard, r.uri, r.n_docs, r.n_ids, start))
        start += r.n_ids
    return spark.createDataFrame(rows, "shard long, uri string, n_docs long, n_ids long, start long")


def read(manifest: DataFrame, spark: SparkSession, per_document, schema: str) -> DataFrame:
    """Read all shards back; ``per_document(doc_ids, starts, ids, local)`` makes one Arrow batch of a run of documents.

    ``starts`` are global positions, ``local`` the documents' first positions in ``ids`` (one more than documents).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["uri"])
                for a, b, ids in shard.documents():
                    doc_ids = [None if d == NULL_ID else d for d in shard.docs[a:b].tolist()]
                    yield per_document(doc_ids, row["start"] + shard.starts[a:b], ids, shard.starts[a : b + 1] - shard.starts[a])

    count = max(1, manifest.count())
    return manifest.select("shard", "uri", "start").repartition(count, F.col("shard")).mapInArrow(run, schema)
