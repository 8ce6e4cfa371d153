"""Baskets, points, attribute lists and sequences in their file formats.

Text formats are read by Spark's readers. Binary files are read whole, one file
for each task (``binaryFile``), and decoded by numpy; large data belongs in many
such files, or in Parquet.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.table import numbered
from lodestone.plans.levels import level


def read_baskets(spark: SparkSession, path: str, first_item: int = 1) -> DataFrame:
    """``(tid, item)`` of a text file with a basket of item numbers on each line; items are counted from ``first_item``.

    Ids are unique and rise in file order; they aren't consecutive.
    """
    lines = spark.read.text(path).withColumn("tid", F.monotonically_increasing_id())
    items = F.explode(F.array_distinct(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")))
    return lines.select("tid", (items.alias("item"))).withColumn("item", F.col("item").cast("int") - first_item)


def write_baskets(baskets: DataFrame, path: str, first_item: int = 1) -> None:
    items = F.transform(F.array_sort(F.collect_list("item")), lambda i: (i + first_item).cast("string"))
    baskets.groupBy("tid").agg(F.array_join(items, " ").alias("value")).select("value").write.mode("overwrite").text(path)


def pack_baskets(baskets: list[tuple[int, list[int]]], n_items: int, customers: list[int] | None = None) -> bytes:
    """The binary form: baskets, items and mean size; then for each basket (its customer,) its id, size and items; 32-bit integers."""
    mean = round(sum(len(i) for _, i in baskets) / max(1, len(baskets)))
    out = [struct.pack("<3i", len(baskets), n_items, mean)] if customers is None else []
    for k, (tid, items) in enumerate(baskets):
        head = () if customers is None else (customers[k],)
        out.append(struct.pack(f"<{len(head) + 2 + len(items)}i", *head, tid, len(items), *items))
    return b"".join(out)


def pack_lists(lead: np.ndarray, sizes: np.ndarray, items: np.ndarray, n_items: int) -> bytes:
    """The form of ``pack_baskets`` from columns: (customer and) id of each basket, sizes, and all items in one array."""
    if max(np.abs(lead).max(initial=0), np.abs(items).max(initial=0)) >= 1 << 31:
        raise OverflowError("ids and items have 32 bits in binary baskets")
    width = lead.shape[1]
    ends = np.cumsum(sizes + width + 1)
    starts = ends - (sizes + width + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, "<i4")
    for k in range(width):
        out[starts + k] = lead[:, k]
    out[starts + width] = sizes
    out[np.arange(len(items)) + np.repeat(starts + width + 1 - (np.cumsum(sizes) - sizes), sizes)] = items
    head = struct.pack("<3i", len(sizes), n_items, round(len(items) / max(1, len(sizes)))) if width == 1 else b""
    return head + out.tobytes()


def unpack_lists(content: bytes, width: int, header: bool, size: int = 50_000) -> Iterator[np.ndarray]:
    """Rows of (customer and) id and item of a binary basket file, ``size`` baskets at a time."""
    x, at = np.frombuffer(content, "<i4"), 3 if header else 0
    while at < len(x):
        starts = []
        while at < len(x) and len(starts) < size:
            starts.append(at)
            at += width + 1 + int(x[at + width])
        first = np.array(starts)
        sizes = x[first + width].astype("int64")
        places = np.arange(sizes.sum()) + np.repeat(first + width + 1 - (np.cumsum(sizes) - sizes), sizes)
        yield np.column_stack([np.repeat(x[first + k], sizes) for k in range(width)] + [x[places]])


def read_binary_baskets(spark: SparkSession, path: str, customers: bool = False, header: bool = True) -> DataFrame:
    """``(tid, item)``, or ``(customer, tid, item)``, of binary basket files."""
    names = ["customer", "tid", "item"] if customers else ["tid", "item"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for rows in unpack_lists(content, len(names) - 1, header and not customers):
                    yield pd.DataFrame(rows, columns=names).astype("int64")

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"{n} long" for n in names))


def numbered_baskets(baskets: DataFrame) -> DataFrame:
    """The baskets with ids from 0 in order of their own, for forms whose ids have 32 bits."""
    baskets = level(baskets)
    ids = numbered(baskets.select("tid").distinct(), [F.col("tid")], "_id")
    return baskets.join(ids, "tid").withColumn("tid", F.col("_id")).drop("_id")


def read_points(spark: SparkSession, path: str, skip_first: bool = True) -> DataFrame:
    """``(id, x)`` of lines of numbers; the first token is the id (or the points are numbered)."""
    words = F.split(F.trim("value"), r"[\s,]+")
    rows = spark.read.text(path).where("trim(value) <> ''").withColumn("_id", F.monotonically_increasing_id())
    values = F.slice(words, 2, F.size(words) - 1) if skip_first else words
    return rows.select((words[0] if skip_first else F.col("_id").cast("string")).alias("id"), F.transform(values, lambda v: v.cast("double")).alias("x"))


def read_labelled_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(y, x)``: a label and numbers on each line."""
    words = F.transform(F.split(F.trim("value"), r"[\s,]+"), lambda v: v.cast("double"))
    return spark.read.text(path).where("trim(value) <> ''").select(words.alias("w")).select(F.col("w")[0].alias("y"), F.slice("w", 2, F.size("w") - 1).alias("x"))


def read_binary_points(spark: SparkSession, path: str, big_endian: bool = False) -> DataFrame:
    """``(id, x)`` of files with number of points, dimensions (32-bit) and float32 values; ids count within a file."""
    kind = ">" if big_endian else "<"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                n, d = struct.unpack(f"{kind}2i", content[:8])
                x = np.frombuffer(content, f"{kind}f4", n * d, 8).reshape(n, d).astype(float)
                yield pd.DataFrame({"id": np.arange(n), "x": list(x)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id long, x array<double>")


def read_particles(spark: SparkSession, path: str) -> DataFrame:
    """``(id, x, mass)`` of files of float32 quadruples: three coordinates and a mass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                v = np.frombuffer(content, "<f4").reshape(-1, 4).astype(float)
                yield pd.DataFrame({"id": np.arange(len(v)), "x": list(v[:, :3]), "mass": v[:, 3]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id long, x array<double>, mass double")


def read_attribute_lists(spark: SparkSession, base: str, n: int) -> DataFrame:
    """``(attr, rid, val, class)`` of files ``base.att.i`` with a value and a class for each record on a line."""
    out = None
    for i in range(n):
        rows = spark.read.text(f"{base}.att.{i}", wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("rid", "line"))
        words = F.split(F.trim("line"), r"\s+")
        part = rows.select(F.lit(i).alias("attr"), "rid", words[0].cast("double").alias("val"), words[1].cast("int").alias("class"))
        out = part if out is None else out.union(part)
    return out


def read_snps(spark: SparkSession, path: str, sites: int = 48) -> DataFrame:
    """``(rid, label, site, value)`` of lines of a label and bases; A, T, G, C are 0 to 3, and lines with another symbol are dropped."""
    rows = spark.read.text(path).withColumn("rid", F.monotonically_increasing_id()).where(F.col("value").rlike(f"^.[ATGC]{{{sites}}}"))
    codes = F.split(F.translate(F.substring("value", 2, sites), "ATGC", "0123"), "")
    return rows.select("rid", F.substring("value", 1, 1).alias("label"), F.posexplode(codes).alias("site", "value")).where("value <> ''").withColumn("value", F.col("value").cast("int"))


# --- sequences -----------------------------------------------------------------------------------


def parse_sequences(text: str) -> list[tuple[str, str, str]]:
    """(id, description, sequence) of a text in FASTA, PIR, GenBank, EMBL, IG, Stockholm, Clustal, MSF, PHYLIP, A2M, SELEX, NEXUS or raw form."""
    lines = text.splitlines()
    first = next((line for line in lines if line.strip()), "")
    order: list[str] = []
    seqs: dict[str, list[str]] = {}
    notes: dict[str, str] = {}

    def add(name: str, part: str, note: str = "") -> None:
        if name not in seqs:
            seqs[name] = []
            notes[name] = notes.get(name) or note
            order.append(name)
        seqs[name].append("".join(part.split()))

    if first.startswith("# STOCKHOLM") or first.startswith("#="):
        for line in lines:
            if line.strip() and not line.startswith(("#", "//")):
                name, _, part = line.partition(" ")
                add(name, part)
            elif line.startswith("#=GS"):
                words = line.split(None, 3)
                if len(words) == 4 and words[2] == "DE":
                    notes[words[1]] = words[3]
    elif first.startswith("CLUSTAL"):
        for line in lines[lines.index(first) + 1 :]:
            if line.strip() and not line[0].isspace():
                words = line.split()
                add(words[0], words[1])
    elif "MSF:" in text.split("//")[0] and "//" in text:
        for line in text.split("//", 1)[1].splitlines():
            words = line.split(None, 1)
            if len(words) == 2 and not words[0].isdigit():
                add(words[0], words[1])
    elif first.upper().startswith("#NEXUS"):
        inside = False
        for line in lines:
            word = line.strip()
            if word.upper().startswith("MATRIX"):
                inside = True
            elif word.startswith(";") or word.upper().startswith("END;"):
                inside = False
            elif inside and word:
                words = word.rstrip(";").split(None, 1)
                if len(words) == 2:
                    add(words[0].strip("'"), words[1])
                inside = not word.endswith(";")
    elif first.startswith("LOCUS") or first.startswith("ID   "):
        name, note, inside = "", "", False
        for line in lines:
            if line.startswith(("LOCUS", "ID   ")):
                name, note = line.split()[1].rstrip(";"), ""
            elif line.startswith(("DEFINITION", "DE   ")):
                note = (note + " " + line.split(None, 1)[1]).strip()
            elif line.startswith(("ORIGIN", "SQ   ")):
                inside = True
                add(name, "", note)
            elif line.startswith("//"):
                inside = False
            elif inside:
                add(name, "".join(c for c in line if c.isalpha()))
    elif first.startswith(";"):
        name = None
        for line in lines:
            if line.startswith(";"):
                name = None
            elif line.strip() and name is None:
                name = line.strip().split()[0]
                add(name, "")
            elif name:
                add(name, line.rstrip("12"))
    elif first.startswith(">"):
        name, pir = None, False
        for k, line in enumerate(lines):
            if line.startswith(">"):
                pir = len(line) > 3 and line[3] == ";"
                name, _, note = (line[4:] if pir else line[1:]).strip().partition(" ")
                add(name, "", note)
                skip = k + 1 if pir else -1
            elif name and k == skip:
                notes[name] = line.strip()
            elif name:
                add(name, line.rstrip("*") if pir else line)
    elif first.split() and all(w.isdigit() for w in first.split()[:2]) and len(first.split()) >= 2:
        n = int(first.split()[0])
        body = [line for line in lines[lines.index(first) + 1 :] if line.strip()]
        for k, line in enumerate(body):
            if k < n:
                name, part = (line.split(None, 1) + [""])[:2] if len(line.split()) > 1 else (line[:10].strip(), line[10:])
                add(name, part)
            else:
                add(order[k % n], line)
    elif all(len(line.split()) == 2 for line in lines if line.strip() and not line.startswith(("#", "%"))) and first:
        for line in lines:
            if line.strip() and not line.startswith(("#", "%")):
                add(*line.split())
    else:
        add("raw", text)
    return [(n, notes[n], "".join(seqs[n])) for n in order]


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """``(file, id, description, seq)`` of sequence files, the format told from the content; one file for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text in zip(batch["file"], batch["value"]):
                yield pd.DataFrame([(name, *r) for r in parse_sequences(text)], columns=["file", "id", "description", "seq"])

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.mapInPandas(run, "file string, id string, description string, seq string")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(id, description, seq)`` of large FASTA files: records are split by Spark's reader, so one file is read by many tasks."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("v")).where("trim(v) <> ''")
    head = F.substring_index("v", "\n", 1)
    body = F.regexp_replace(F.expr("substring(v, length(substring_index(v, '\n', 1)) + 1)"), r"\s", "")
    return rows.select(F.substring_index(F.trim(head), " ", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("description"), body.alias("seq"))


def write_fasta(seqs: DataFrame, path: str, width: int = 60) -> None:
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    head = F.concat_ws(" ", "id", F.when(F.coalesce("description", F.lit("")) != "", F.col("description"))) if "description" in seqs.columns else F.col("id").cast("string")
    seqs.select(F.concat(F.lit(">"), head, F.lit("\n"), lines).alias("value")).write.mode("overwrite").text(path)


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """``(newick)``: one row for each tree that ends with a semicolon."""
    rows = spark.read.option("lineSep", ";").text(path).select(F.trim(F.regexp_replace("value", r"[\n\r]", "")).alias("v")).where("v <> ''")
    return rows.select(F.concat("v", F.lit(";")).alias("newick"))


def read_matrix(text: str) -> dict[tuple[str, str], float]:
    """A substitution matrix: a line of symbols, then rows that begin with their symbol; ``#`` starts a remark."""
    lines = [line for line in (raw.split("#")[0] for raw in text.splitlines()) if line.strip()]
    symbols = lines[0].split()
    return {(w[0], s): float(v) for w in (line.split() for line in lines[1:]) for s, v in zip(symbols, w[1:])}
