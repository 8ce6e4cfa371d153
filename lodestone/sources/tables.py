"""Delimited text tables with unknown values and weights, attribute domains and schemas."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.table import WEIGHT, auto_types


def read_table(spark: SparkSession, path: str, sep: str = ",", unknown: str = "?", header: bool = True, names: Sequence[str] | None = None, weight: bool = False, infer: bool = True) -> DataFrame:
    """A table of text fields; blanks around fields are dropped and ``unknown`` becomes NULL.

    Columns are named by the header, by ``names``, or 1 to n. With ``weight``
    the last column is the tuple's weight. With ``infer`` each column gets the
    narrowest of integer, float and text that all of its known values have.
    """
    options = {"sep": sep, "header": header, "nullValue": unknown, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    df = spark.read.options(**{k: str(v) for k, v in options.items()}).csv(path)
    if names or not header:
        df = df.toDF(*(names or [str(i + 1) for i in range(len(df.columns))]))
    if weight:
        last = df.columns[-1]
        df = df.withColumn(last, F.col(last).cast("double")).withColumnRenamed(last, WEIGHT)
    if infer:
        columns = [c for c in df.columns if c != WEIGHT]
        kinds = auto_types(df, columns)
        df = df.withColumns({c: F.col(c).cast(t) for c, t in kinds.items() if t != "string"})
    return df


def write_table(df: DataFrame, path: str, sep: str = ",", unknown: str = "?", header: bool = True, aligned: bool = False) -> None:
    """The inverse; ``aligned`` pads every column to its widest value (one aggregate)."""
    out = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(unknown)).alias(c) for c in df.columns])
    if aligned:
        widths = out.agg(*[F.max(F.length(F.col(f"`{c}`"))).alias(c) for c in out.columns]).first().asDict()
        out = out.select(*[F.rpad(F.col(f"`{c}`"), max(widths[c] or 0, len(c)), " ").alias(c.ljust(widths[c] or 0)) for c in out.columns])
    out.write.mode("overwrite").options(sep=sep, header=str(header), ignoreTrailingWhiteSpace="false", ignoreLeadingWhiteSpace="false", emptyValue="").csv(path)


def parse_domains(text: str) -> T.StructType:
    """A schema from ``dom(name) = ZZ | IR | { values };`` definitions; values are kept in the field's metadata."""
    fields = []
    text = re.sub(r"/\*.*?\*/|//[^\n]*", " ", text, flags=re.S)
    for name, kind in re.findall(r"""dom\s*\(\s*("[^"]*"|[^)]*?)\s*\)\s*=\s*(.*?)\s*;""", text, flags=re.S):
        name = name.strip('"')
        if kind.startswith("{"):
            values = [v.strip().strip('"') for v in kind.strip("{} \n\t").split(",") if v.strip()]
            fields.append(T.StructField(name, T.StringType(), True, {"values": values}))
        else:
            fields.append(T.StructField(name, T.LongType() if kind.split()[0].startswith("ZZ") else T.DoubleType()))
    return T.StructType(fields)


def print_domains(df: DataFrame, ranges: bool = False) -> str:
    """The definitions of a table's columns: values of text columns, types (and ranges) of numbers."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            values = [r[0] for r in df.select(f.name).where(F.col(f"`{f.name}`").isNotNull()).distinct().orderBy(f.name).collect()]
            out.append(f"dom({f.name}) = {{ {', '.join(values)} }};")
        else:
            kind = "ZZ" if isinstance(f.dataType, (T.LongType, T.IntegerType)) else "IR"
            if ranges:
                low, high = df.agg(F.min(f.name), F.max(f.name)).first()
                kind += f" [{low}, {high}]"
            out.append(f"dom({f.name}) = {kind};")
    return "\n".join(out)


def apply_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns cast to a schema; values outside a listed domain become unknown."""
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`").try_cast(f.dataType.simpleString())
        values = f.metadata.get("values") if f.metadata else None
        out.append((F.when(c.isin(values), c) if values else c).alias(f.name))
    return df.select(*out)


def save_schema(df: DataFrame) -> str:
    return df.schema.json()


def load_schema(text: str) -> T.StructType:
    import json

    return T.StructType.fromJson(json.loads(text))


# Type names of catalog files.
CATALOG_TYPES = {"int": "int", "long": "bigint", "float": "float", "double": "double", "string": "string", "date": "timestamp"}


def parse_catalog(text: str) -> tuple[T.StructType, dict[str, str]]:
    """(schema, reader options) of lines ``name type`` and ``separator x``, ``comment x``; ``#`` starts a remark."""
    fields, options = [], {}
    for line in text.splitlines():
        words = line.split("#")[0].split()
        if len(words) < 2:
            continue
        if words[0].lower() in ("separator", "comment"):
            options["sep" if words[0].lower() == "separator" else "comment"] = words[1].strip("'\"").replace("\\t", "\t")
        elif words[1].lower() in CATALOG_TYPES:
            fields.append(T.StructField(words[0], T._parse_datatype_string(CATALOG_TYPES[words[1].lower()])))
        else:
            raise ValueError(f"unknown type in {line!r}")
    return T.StructType(fields), options


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a graphical model: a header of node names, unknown values empty or ``?``."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin("", "?"), F.trim(F.col(f"`{c}`"))).alias(c.strip()) for c in df.columns])
