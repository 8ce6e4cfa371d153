"""Writers of binary and text files, and their readers: groups, densities, records, clusters, machines, sequences, indexes.

Files are written by the tasks that hold their rows, one file for each row of
``(name, content)``, to a folder that driver and executors share.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _filesystem(uri: str):
    from pyarrow import fs

    parts = urlparse(uri)
    return (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


def write_files(contents: DataFrame, folder: str) -> int:
    """One file of ``folder`` for each row of ``contents(name, content)``; returns their number."""
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _filesystem(folder)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                with fs.open_output_stream(f"{path}/{name}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    return contents.select("name", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _packed(rows: DataFrame, part: Column, pack) -> DataFrame:
    """``(name, content)``: the rows of each part, a bounded share of the table, through ``pack(frame)``."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [f"part-{frame['_part'].iloc[0]:05d}"], "content": [pack(frame)]})

    return rows.withColumn("_part", part).groupBy("_part").applyInPandas(run, "name string, content binary")


def packed_batches(rows: DataFrame, pack) -> DataFrame:
    """``(name, content)``: ``pack(frame, number)`` of each batch of rows as a frame, so no file is larger than a batch; the number has task and batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            if len(batch):
                yield pack(batch, f"{task:05d}{k:05d}")

    return rows.mapInPandas(run, "name string, content binary")


def write_binary_baskets(baskets: DataFrame, folder: str, n_items: int, size: int = 100_000) -> int:
    """``baskets(tid, item)``, or with ``customer``, in the binary form of ``files.read_binary_baskets``; files of ``size`` baskets at most.

    A task holds one file at a time, and a basket isn't cut.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    from .files import pack_lists

    keys = ["customer", "tid"] if "customer" in baskets.columns else ["tid"]
    grouped = baskets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("item").cast("long"))).alias("items"))
    grouped = grouped.sortWithinPartitions(*keys).select(*[F.col(k).cast("long").alias(k) for k in keys], "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n, done = TaskContext.get().partitionId(), [], 0, 0

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            items = rows["items"].combine_chunks()
            lead = np.column_stack([rows[k].to_numpy() for k in keys])
            content = pack_lists(lead, np.diff(items.offsets.to_numpy()), items.flatten().to_numpy(zero_copy_only=False), n_items)
            return pa.RecordBatch.from_pydict({"name": [f"part-{part:05d}-{done:05d}"], "content": pa.array([content], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                if n and n + piece.num_rows > size:
                    yield packed()
                    held, n, done = [], 0, done + 1
                held.append(piece)
                n += piece.num_rows
        if n:
            yield packed()

    return write_files(grouped.mapInArrow(run, "name string, content binary"), folder)


def write_binary_points(points: DataFrame, folder: str, files: int = 8) -> int:
    """``points(id, x)`` as number of points, dimensions and float32 values."""

    def pack(frame: pd.DataFrame) -> bytes:
        x = np.array(frame.sort_values("id")["x"].tolist(), "<f4")
        return struct.pack("<2i", *x.shape) + x.tobytes()

    return write_files(_packed(points, F.pmod(F.xxhash64("id"), F.lit(files)), pack), folder)


def write_particles(points: DataFrame, folder: str, files: int = 8) -> int:
    """``points(id, x, mass)`` as float32 quadruples."""

    def pack(frame: pd.DataFrame) -> bytes:
        frame = frame.sort_values("id")
        return np.column_stack([np.array(frame["x"].tolist(), float), frame["mass"]]).astype("<f4").tobytes()

    return write_files(_packed(points, F.pmod(F.xxhash64("id"), F.lit(files)), pack), folder)


# --- densities, group tags and groups --------------------------------------------------------------


def pack_densities(values: Sequence[float]) -> bytes:
    """Number of particles (32-bit), then a float32 density for each in order."""
    return struct.pack("<i", len(values)) + np.asarray(values, "<f4").tobytes()


def pack_tags(tags: Sequence[int], groups: int) -> bytes:
    """Number of particles, number of groups, then each particle's group, -1 for none; 32-bit integers."""
    return struct.pack("<2i", len(tags), groups) + np.asarray(tags, "<i4").tobytes()


def _binary(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    """``(file, ...)`` rows that ``decode(content)`` gives as a frame, one file for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["file"], batch["content"]):
                frame = decode(bytes(content))
                frame.insert(0, "file", name)
                yield frame

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInPandas(run, f"file string, {schema}")


def read_densities(spark: SparkSession, path: str) -> DataFrame:
    """``(file, id, density)``, particles numbered from 0 in each file."""

    def decode(content: bytes) -> pd.DataFrame:
        (n,) = struct.unpack("<i", content[:4])
        return pd.DataFrame({"id": np.arange(n), "density": np.frombuffer(content, "<f4", n, 4).astype(float)})

    return _binary(spark, path, decode, "id long, density double")


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """``(file, id, tag)``."""

    def decode(content: bytes) -> pd.DataFrame:
        n, _ = struct.unpack("<2i", content[:8])
        return pd.DataFrame({"id": np.arange(n), "tag": np.frombuffer(content, "<i4", n, 8).astype("int64")})

    return _binary(spark, path, decode, "id long, tag long")


def format_groups(groups: pd.DataFrame, borders: pd.DataFrame, particles: int, loose: int) -> str:
    """Groups ``(id, n, densest, x, density)`` and borders ``(a, b, density)`` as text; ``###`` starts the borders."""
    out = [str(len(groups)), f"# Number of Particles: {particles}", f"# Number of Groups: {len(groups)}", f"# Number of Particles not in a Group: {loose}"]
    for g in groups.itertuples():
        out.append(f"{g.id:4d} {g.n:6d} {g.densest:8d} " + " ".join(f"{v:9.7f}" for v in g.x) + f" {g.density:8.2f}")
    out.append("### Begin list of boundaries. Group, Group, Average Density.")
    out += [f"{b.a:5d} {b.b:5d} {b.density:6.2f}" for b in borders.itertuples()]
    return "\n".join(out) + "\n"


def parse_groups(text: str) -> tuple[list[tuple], list[tuple]]:
    """The rows of groups and of borders."""
    groups, borders, now = [], [], None
    for k, line in enumerate(text.splitlines()):
        if line.startswith("###"):
            now = borders
        elif k and line.strip() and not line.startswith("#"):
            words = line.split()
            if now is borders:
                borders.append((int(words[0]), int(words[1]), float(words[2])))
            else:
                groups.append((int(words[0]), int(words[1]), int(words[2]), [float(v) for v in words[3:6]], float(words[6])))
    return groups, borders


# --- records ---------------------------------------------------------------------------------------


def pack_records(records: Sequence[bytes]) -> bytes:
    """Sequential unformatted records: the length in bytes before and after each (32-bit)."""
    return b"".join(struct.pack("<i", len(r)) + r + struct.pack("<i", len(r)) for r in records)


def unpack_records(content: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(content):
        (n,) = struct.unpack_from("<i", content, at)
        if struct.unpack_from("<i", content, at + 4 + n)[0] != n:
            raise ValueError(f"the record at byte {at} doesn't end with its length")
        out.append(content[at + 4 : at + 4 + n])
        at += n + 8
    return out


def read_records(spark: SparkSession, path: str, kind: str = "<f4") -> DataFrame:
    """``(file, record, values)`` of files of sequential records of numbers."""

    def decode(content: bytes) -> pd.DataFrame:
        found = [np.frombuffer(r, kind).astype(float) for r in unpack_records(content)]
        return pd.DataFrame({"record": range(len(found)), "values": found})

    return _binary(spark, path, decode, "record long, values array<double>")


def read_fixed_records(spark: SparkSession, path: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """Files of fixed binary records: ``fields`` are (name, numpy type) in order."""
    kind = np.dtype(list(fields))
    names = {"i": "long", "u": "long", "f": "double", "S": "string"}

    def decode(content: bytes) -> pd.DataFrame:
        rows = np.frombuffer(content, kind)
        columns = {n: np.char.decode(rows[n], "utf-8") if kind[n].kind == "S" else rows[n].astype(float if kind[n].kind == "f" else "int64") for n in kind.names}
        return pd.DataFrame({"record": range(len(rows)), **columns})

    return _binary(spark, path, decode, "record long, " + ", ".join(f"{n} {names[kind[n].kind]}" for n in kind.names))


def record_index(spark: SparkSession, path: str, separator: bytes = b"\n") -> DataFrame:
    """``(file, record, start, size)``: where each record of text files lies, in bytes; empty records don't count."""

    def decode(content: bytes) -> pd.DataFrame:
        data = np.frombuffer(content, np.uint8)
        ends = np.append(np.flatnonzero(data == separator[0]), len(data)) if len(separator) == 1 else np.zeros(0, int)
        start = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        size = ends - start
        return pd.DataFrame({"record": np.arange(int((size > 0).sum())), "start": start[size > 0], "size": size[size > 0]})

    return _binary(spark, path, decode, "record long, start long, size long")


def read_source(spark: SparkSession, source: dict) -> DataFrame:
    """``(value)`` lines of a source: ``{"file": path}``, ``{"buffer": [lines]}`` or ``{"segment": path, "start": a, "end": b}``.

    A segment has the lines that begin in its bytes, so that segments end to end have each line once.
    """
    if "file" in source:
        return spark.read.text(source["file"])
    if "buffer" in source:
        return spark.createDataFrame([(line,) for line in source["buffer"]], "value string")
    if "segment" in source:
        start, end = source["start"], source["end"]

        def decode(content: bytes) -> pd.DataFrame:
            first = 0 if start == 0 else content.find(b"\n", start - 1) + 1 or len(content)
            last = content.find(b"\n", end - 1) + 1 or len(content)
            return pd.DataFrame({"value": content[first:last].decode().splitlines()}, dtype="object")

        return _binary(spark, source["segment"], decode, "value string").select("value")
    raise ValueError(f"no known kind of source in {sorted(source)}")


# --- clusters and machines -------------------------------------------------------------------------


def write_clusters(cfs: DataFrame, path: str) -> None:
    """``cfs(n, center, radius, diameter)`` as a line of numbers for each cluster."""
    numbers = F.concat(F.array(F.col("n").cast("double")), "center", F.array("radius", "diameter"))
    cfs.select(F.array_join(F.transform(numbers, lambda v: v.cast("string")), " ").alias("value")).write.mode("overwrite").text(path)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """``(n, center, radius, diameter)``."""
    v = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))
    rows = spark.read.text(path).select(v.alias("v"))
    return rows.select(F.col("v")[0].cast("long").alias("n"), F.expr("slice(v, 2, size(v) - 3)").alias("center"), F.expr("v[size(v) - 2]").alias("radius"), F.expr("v[size(v) - 1]").alias("diameter"))


def save_machine(model: dict) -> str:
    """A support vector machine as text: a header of names and values, then a line for each support vector.

    ``model`` has ``kind, kernel, parameters`` (a dict), ``labels, rho`` (one for each pair of classes), ``sizes`` (support
    vectors of each class), ``coef`` (classes - 1 numbers for each vector) and ``vectors``.
    """
    head = [f"svm_type {model['kind']}", f"kernel_type {model['kernel']}", *(f"{k} {v!r}" for k, v in model["parameters"].items())]
    head += [f"nr_class {max(2, len(model['labels']))}", f"total_sv {len(model['vectors'])}", "rho " + " ".join(repr(float(r)) for r in model["rho"])]
    if model["labels"]:
        head += ["label " + " ".join(f"{v:g}" for v in model["labels"]), "nr_sv " + " ".join(map(str, model["sizes"]))]
    lines = [" ".join([*(repr(float(c)) for c in coef), *(f"{i + 1}:{float(v)!r}" for i, v in enumerate(x) if v)]) for coef, x in zip(model["coef"], model["vectors"])]
    return "\n".join([*head, "SV", *lines]) + "\n"


def load_machine(text: str) -> dict:
    """The inverse; absent components are 0."""
    head, _, body = text.partition("\nSV\n")
    model: dict = {"parameters": {}, "labels": [], "sizes": [], "rho": []}
    for line in head.splitlines():
        name, *values = line.split()
        if name in ("svm_type", "kernel_type"):
            model["kind" if name == "svm_type" else "kernel"] = values[0]
        elif name in ("label", "rho"):
            model["labels" if name == "label" else "rho"] = [float(v) for v in values]
        elif name == "nr_sv":
            model["sizes"] = [int(v) for v in values]
        elif name not in ("nr_class", "total_sv"):
            model["parameters"][name] = float(values[0])
    rows = [line.split() for line in body.splitlines() if line.strip()]
    model["coef"] = np.array([[float(w) for w in r if ":" not in w] for r in rows])
    dims = max((int(w.split(":")[0]) for r in rows for w in r if ":" in w), default=0)
    model["vectors"] = np.zeros((len(rows), dims))
    for k, r in enumerate(rows):
        for w in r:
            if ":" in w:
                i, v = w.split(":")
                model["vectors"][k, int(i) - 1] = float(v)
    return model


# --- sequences -------------------------------------------------------------------------------------


def format_sequences(rows: Sequence[tuple[str, str]], kind: str, width: int = 50) -> str:
    """(id, sequence) rows as text in one of the formats that ``files.parse_sequences`` reads."""
    cut = lambda s, w=width: [s[i : i + w] for i in range(0, len(s), w)] or [""]
    longest = max((len(i) for i, _ in rows), default=0) + 2
    size = max((len(s) for _, s in rows), default=0)
    blocks = lambda: "\n\n".join("\n".join(f"{i.ljust(longest)}{s[a : a + width]}" for i, s in rows) for a in range(0, max(size, 1), width))
    if kind == "fasta":
        return "".join(f">{i}\n" + "\n".join(cut(s)) + "\n" for i, s in rows)
    if kind == "pir":
        return "".join(f">P1;{i}\n\n" + "\n".join(cut(s)) + "*\n" for i, s in rows)
    if kind == "genbank":
        return "".join(f"LOCUS       {i} {len(s)} bp\nORIGIN\n" + "".join(f"{a + 1:9d} {s[a : a + width].lower()}\n" for a in range(0, len(s), width)) + "//\n" for i, s in rows)
    if kind == "embl":
        return "".join(f"ID   {i}\nSQ   Sequence {len(s)} BP;\n" + "".join(f"     {p.lower()}\n" for p in cut(s)) + "//\n" for i, s in rows)
    if kind == "ig":
        return "".join(f"; {i}\n{i}\n" + "\n".join(cut(s)) + "1\n" for i, s in rows)
    if kind == "stockholm":
        return "# STOCKHOLM 1.0\n\n" + "".join(f"{i.ljust(longest)}{s}\n" for i, s in rows) + "//\n"
    if kind == "clustal":
        return f"CLUSTAL W (1.8) multiple sequence alignment\n\n{blocks()}\n"
    if kind == "msf":
        return f" MSF: {size}  Type: N  Check: 0  ..\n\n" + "".join(f" Name: {i}  Len: {len(s)}\n" for i, s in rows) + f"\n//\n\n{blocks()}\n"
    if kind == "selex":
        return blocks() + "\n"
    if kind == "nexus":
        return f"#NEXUS\nbegin data;\nmatrix\n{blocks()}\n;\nend;\n"
    if kind == "phylip":
        first, *rest = ["\n".join((f"{i.ljust(longest)}" if a == 0 else "") + s[a : a + width] for i, s in rows) for a in range(0, max(size, 1), width)]
        return f" {len(rows)} {size}\n" + "\n\n".join([first, *rest]) + "\n"
    raise ValueError(f"no writer for {kind}")


def read_single_sequence(spark: SparkSession, path: str, symbols: str) -> DataFrame:
    """``(file, seq, codes)``: all after the first header line is one sequence, later headers too.

    Capitals are coded by their place in ``symbols``, small letters count as X, ``*`` and ``-`` end the sequence.
    """
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    body = F.regexp_replace(F.expr(r"substring(value, instr(value, '\n') + 1)"), r"[\s]", "")
    seq = F.regexp_replace(F.regexp_replace(body, r"[*\-].*$", ""), "[a-z]", "X")
    rows = rows.select("file", seq.alias("seq"))
    codes = F.transform(F.filter(F.split("seq", ""), lambda c: c != ""), lambda c: F.instr(F.lit(symbols), c) - 1)
    return rows.withColumn("codes", codes)


def sequence_index(spark: SparkSession, path: str) -> DataFrame:
    """``(file, id, start, size, residues)`` of FASTA files: where each record's letters begin, in bytes, and how many there are."""

    def decode(content: bytes) -> pd.DataFrame:
        out, at = [], content.find(b">") if not content.startswith(b">") else 0
        while 0 <= at < len(content):
            line = content.find(b"\n", at)
            line = len(content) if line < 0 else line
            after = content.find(b"\n>", line)
            end = len(content) if after < 0 else after + 1
            body = content[line + 1 : end]
            words = content[at + 1 : line].split()
            out.append((words[0].decode() if words else "", line + 1, len(body), len(b"".join(body.split()))))
            at = end if after >= 0 else -1
        return pd.DataFrame(out, columns=["id", "start", "size", "residues"])

    return _binary(spark, path, decode, "id string, start long, size long, residues long")


def fetch_sequences(spark: SparkSession, path: str, index: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """``(id, seq)`` of an index's rows, from their places in the files; ``first`` to ``last`` are residues from 1."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    part = F.expr("substring(content, cast(start + 1 as int), cast(size as int))").cast("string")
    seq = F.regexp_replace(part, r"\s", "")
    if first is not None:
        seq = F.substring(seq, first, (last or 1 << 30) - first + 1)
    return index.join(files, "file").select("id", seq.alias("seq"))
