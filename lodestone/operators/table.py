"""The relational table toolkit: joins with unknown values, weights, splitting, balancing.

Tables are DataFrames; an unknown value is NULL; a tuple's weight is the column
``_w`` where there is one and 1 otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.levels import level

WEIGHT = "_w"
#: A joined table of up to this many rows is sent to all tasks of the other one.
MAX_BROADCAST = 200_000


def weighted(df: DataFrame) -> DataFrame:
    return df if WEIGHT in df.columns else df.withColumn(WEIGHT, F.lit(1.0))


def _data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != WEIGHT]


def all_of(conditions: Sequence[Column]) -> Column:
    return fold(lambda a, b: a & b, conditions, F.lit(True))


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Inner join on column pairs, unknown equal to unknown; left columns, then the right ones that aren't joined.

    The weight is the product of the weights. Output names must differ. A few keys with many rows on both sides make far
    more rows than the tables have: a small right table goes to all tasks, and the left one is dealt evenly, whatever its keys.
    """
    carries = WEIGHT in left.columns or WEIGHT in right.columns
    keys = [r for _, r in on]
    extra = [c for c in _data_columns(right) if c not in keys]
    clash = set(extra) & set(_data_columns(left))
    if clash:
        raise ValueError(f"both tables have a column {sorted(clash)}")
    if right.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        left, right = left.repartition(4 * left.sparkSession.sparkContext.defaultParallelism), F.broadcast(right)
    a, b = weighted(left).alias("a"), weighted(right).alias("b")
    matched = a.join(b, all_of([F.col(f"a.{x}").eqNullSafe(F.col(f"b.{y}")) for x, y in on]), "inner") if on else a.crossJoin(b)
    out = [F.col(f"a.{c}").alias(c) for c in _data_columns(left)] + [F.col(f"b.{c}").alias(c) for c in extra]
    if carries:
        out.append((F.col(f"a.{WEIGHT}") * F.col(f"b.{WEIGHT}")).alias(WEIGHT))
    return matched.select(*out)


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on all common columns; without any, every pair of tuples."""
    return join(left, right, [(c, c) for c in _data_columns(left) if c in _data_columns(right)])


def union_project(columns: Sequence[str], *tables: DataFrame) -> DataFrame:
    """All tuples of all tables, with these columns, by name; a missing column is an error."""
    return fold(lambda a, b: a.unionByName(b), [t.select(*columns) for t in tables])


def reduce(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Equal tuples become one, with the sum of their weights."""
    return weighted(df).groupBy(*(columns or _data_columns(df))).agg(F.sum(WEIGHT).alias(WEIGHT))


def total_weight(df: DataFrame) -> DataFrame:
    return weighted(df).agg(F.sum(WEIGHT).alias(WEIGHT))


def coverage_full(df: DataFrame, domains: dict[str, DataFrame] | None = None) -> DataFrame:
    """One-point coverages: unknown symbolic values are replaced by every value of the column, with full weight.

    ``domains`` gives a one-column table of values per symbolic column, by
    default the values that occur. Columns not named keep their unknowns.
    """
    df = reduce(df)
    if domains is None:
        domains = {c: df.select(c).where(F.col(c).isNotNull()).distinct() for c, t in df.dtypes if t == "string"}
    for c, values in domains.items():
        known = df.where(F.col(c).isNotNull())
        filled = df.where(F.col(c).isNull()).drop(c).crossJoin(values.select(F.col(values.columns[0]).alias(c)))
        df = known.unionByName(filled.select(*df.columns))
    return reduce(df)


def compatible(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Whether two tuples agree where both are known."""
    return all_of([(a == b) | a.isNull() | b.isNull() for a, b in zip(left, right)])


def at_most_as_specific(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Whether the left tuple equals the right one where the left is known."""
    return all_of([a.isNull() | a.eqNullSafe(b) for a, b in zip(left, right)])


def coverage_condensed(df: DataFrame, checkpoint=lambda d: d) -> DataFrame:
    """The closure of the tuples under intersection, each with the weights of the tuples it is compatible with and no more specific than.

    A tuple of the closure takes known values from either parent. ``checkpoint``
    is applied after every round.
    """
    columns = _data_columns(df)
    base = checkpoint(reduce(df))
    closure, size = base.select(*columns), -1
    while True:
        count = closure.count()
        if count == size:
            break
        size = count
        a, b = closure.alias("a"), closure.alias("b")
        pairs = a.join(b, compatible([F.col(f"a.{c}") for c in columns], [F.col(f"b.{c}") for c in columns]))
        met = pairs.select(*[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in columns])
        closure = checkpoint(closure.union(met).distinct())
    a, b = closure.alias("a"), base.alias("b")
    covers = at_most_as_specific([F.col(f"b.{c}") for c in columns], [F.col(f"a.{c}") for c in columns])
    return a.join(b, covers).groupBy(*[F.col(f"a.{c}").alias(c) for c in columns]).agg(F.sum(f"b.{WEIGHT}").alias(WEIGHT))


def normalised_weights(df: DataFrame) -> DataFrame:
    """Weights divided by their sum (one global aggregate, joined back as one row)."""
    df = weighted(df)
    total = df.agg(F.sum(WEIGHT).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(WEIGHT, F.col(WEIGHT) / F.col("_total")).drop("_total")


def possibility(df: DataFrame, queries: DataFrame) -> DataFrame:
    """Each query tuple with the greatest weight among the tuples that it is compatible with, else 0."""
    columns = _data_columns(df)
    a, b = queries.alias("a"), reduce(df).alias("b")
    match = compatible([F.col(f"a.{c}") for c in columns], [F.col(f"b.{c}") for c in columns])
    joined = a.join(b, match, "left")
    return joined.groupBy(*[F.col(f"a.{c}").alias(c) for c in queries.columns]).agg(F.coalesce(F.max(f"b.{WEIGHT}"), F.lit(0.0)).alias("degree"))


def possibility_expanded(df: DataFrame, queries: DataFrame, domains: dict[str, DataFrame]) -> DataFrame:
    """Least, mean and greatest degree over all ways to fill a query's unknowns from the domains."""
    keyed = queries.withColumn("_query", F.monotonically_increasing_id())
    filled = keyed
    for c, values in domains.items():
        v = values.select(F.col(values.columns[0]).alias("_value"))
        known = filled.where(F.col(c).isNotNull())
        rest = filled.where(F.col(c).isNull()).crossJoin(v).withColumn(c, F.col("_value")).drop("_value")
        filled = known.unionByName(rest.select(*filled.columns))
    degrees = possibility(df, filled).groupBy("_query").agg(*[f("degree").alias(n) for n, f in (("least", F.min), ("mean", F.avg), ("greatest", F.max))])
    return keyed.join(degrees, "_query").drop("_query")


def crosstab(df: DataFrame, x: str, y: str, values: Sequence, percent: bool = False) -> DataFrame:
    """Confusion matrix: a row for each ``y`` value with the weights of each ``x`` value, errors and total; and a row of column totals.

    ``values`` are the ``x`` values; errors are the weights where x and y differ.
    """
    df = weighted(df).withColumns({x: F.col(x).cast("string"), y: F.col(y).cast("string")})
    cells = [F.sum(F.when(F.col(x) == str(v), F.col(WEIGHT)).otherwise(0.0)).alias(f"x_{v}") for v in values]
    errors = F.sum(F.when(~F.col(x).eqNullSafe(F.col(y)), F.col(WEIGHT)).otherwise(0.0)).alias("errors")
    out = df.rollup(y).agg(*cells, errors, F.sum(WEIGHT).alias("total"), F.grouping(y).alias("_margin"))
    out = out.withColumn(y, F.when(F.col("_margin") == 1, F.lit("total")).otherwise(F.coalesce(y, F.lit("?")))).drop("_margin")
    if percent:
        whole = F.max("total").over(Window.partitionBy())
        out = out.select(y, *[(100 * F.col(c) / whole).alias(c) for c in out.columns if c != y])
    return out


def balance(df: DataFrame, column: str, mode: str | float = "shift", frequencies: dict | None = None) -> DataFrame:
    """Weights that give every class the same sum, or sums as ``frequencies`` ask.

    ``shift`` keeps the total weight, ``boost`` raises all classes to the
    largest, ``lower`` lowers them to the smallest; a number is the total
    itself. Duplicates are collapsed first; an unknown class gets weight 0.
    """
    df = reduce(df)
    known = F.col(column).isNotNull()
    sums = df.where(known).groupBy(column).agg(F.sum(WEIGHT).alias("_sum"))
    classes = sums.agg(F.count("*").alias("_n"), F.max("_sum").alias("_max"), F.min("_sum").alias("_min"))
    whole = df.agg(F.sum(WEIGHT).alias("_all"))
    total = {"shift": F.col("_all"), "boost": F.col("_n") * F.col("_max"), "lower": F.col("_n") * F.col("_min")}
    total = total[mode] if isinstance(mode, str) else F.lit(float(mode))
    share = 1 / F.col("_n")
    if frequencies:
        asked = sum(frequencies.values())
        share = fold(lambda rest, kv: F.when(F.col(column) == kv[0], F.lit(kv[1] / asked)).otherwise(rest), frequencies.items(), F.lit(0.0))
    factors = sums.crossJoin(F.broadcast(classes)).crossJoin(F.broadcast(whole))
    # A row for each class and one for unknown, so the join needs no check of its size beyond Spark's own.
    factors = factors.select(F.col(column).alias("_class"), (total * share / F.nullif(F.col("_sum"), F.lit(0.0))).alias("_factor"))
    out = df.join(factors, df[column] == F.col("_class"), "left")
    return out.withColumn(WEIGHT, F.coalesce(F.col(WEIGHT) * F.col("_factor"), F.lit(0.0))).select(*df.columns)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "_row") -> DataFrame:
    """Exact row numbers from 0 over a total order without gathering rows: a range sort, counts by partition, and offsets.

    The sorted rows are kept before they are counted: the bounds of a range sort are sampled, and partitions are
    merged by size, so a second run of the sort may deal the rows otherwise.
    """
    ordered = level(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_part", F.spark_partition_id())
    ordered = ordered.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_count"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)))  # a row for each partition
    joined = ordered.join(F.broadcast(offsets.select("_part", "_before")), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def folds(df: DataFrame, t: int, order: Sequence[str], stratify: str | None = None, seed: int | None = None) -> DataFrame:
    """``fold`` 0 to t-1: every t-th row in order of class and ``order``, or of class and a seeded shuffle."""
    keys = [F.xxhash64(F.lit(seed), *order)] if seed is not None else []
    keys = ([F.col(stratify).asc_nulls_first()] if stratify else []) + keys + [F.col(c) for c in order]
    return numbered(df, keys).withColumn("fold", (F.col("_row") % t).cast("int")).drop("_row")


def systematic_sample(df: DataFrame, n: int, order: Sequence[str], stratify: str | None = None) -> DataFrame:
    """``n`` rows: every k-th in order, k the rows divided by n."""
    rows = df.count()
    if n > rows:
        raise ValueError("the sample is larger than the table")
    k = rows // n
    keys = ([F.col(stratify).asc_nulls_first()] if stratify else []) + [F.col(c) for c in order]
    return numbered(df, keys).where((F.col("_row") % k == 0) & (F.col("_row") < n * k)).drop("_row")


def split_by_value(df: DataFrame, column: str, path: str) -> None:
    """One folder for each value."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def sort(df: DataFrame, *columns: str) -> DataFrame:
    """By all (or these) columns, unknown lowest."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in columns or df.columns])


def shuffle(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    """A seeded order that doesn't depend on the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key))


def cut(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(tuples that satisfy the predicate, the rest, unknown included)."""
    return df.where(predicate), df.where(~F.coalesce(predicate, F.lit(False)))


def unknown_count(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return fold(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns or _data_columns(df)])


def insert_unknowns(df: DataFrame, percent: float, key: Sequence[str], columns: Sequence[str], seed: int) -> DataFrame:
    """About ``percent`` of the fields of these columns become unknown; which ones depends on key, column and seed alone."""
    chance = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.lit(c), *key), F.lit(1_000_000)) < round(percent * 10_000)
    return df.withColumns({c: F.when(~chance(c), F.col(c)) for c in columns})


def fill_unknown(df: DataFrame, where: Column, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.coalesce(where, F.lit(False)), F.col(c)) for c in columns})


def convert(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns cast to types; what doesn't convert becomes unknown."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in kinds.items()})


def auto_types(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """``bigint``, ``double`` or ``string``: the narrowest type that all known values of a text column have (one pass)."""
    checks = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(f"{c}|{t}") for c in columns for t in ("bigint", "double")]
    bad = df.agg(*checks).first().asDict()
    return {c: next((t for t in ("bigint", "double") if not bad[f"{c}|{t}"]), "string") for c in columns}


def domains(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, kind, least, greatest, n_values)`` of each column, in one pass."""
    kinds = dict(df.dtypes)
    numeric = lambda c: kinds[c] not in ("string", "boolean")
    aggregates = []
    for c in columns:
        aggregates += [F.min(c).cast("string").alias(f"{c}|l"), F.max(c).cast("string").alias(f"{c}|g"), F.countDistinct(c).alias(f"{c}|n")]
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit("numeric" if numeric(c) else "symbolic").alias("kind"), F.col(f"{c}|l").alias("least"),
                 F.col(f"{c}|g").alias("greatest"), F.col(f"{c}|n").alias("n_values"))
        for c in columns
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def normalise(df: DataFrame, column: str, expected: float = 0.0, spread: float = 1.0, by_range: bool = False) -> DataFrame:
    """A linear map to this mean and standard deviation (weighted), or to this least value and range."""
    df = weighted(df)
    v, w = F.col(column).cast("double"), F.when(F.col(column).isNotNull(), F.col(WEIGHT))
    if by_range:
        stats = df.agg(F.min(v).alias("_off"), (F.max(v) - F.min(v)).alias("_scale"))
    else:
        mean, square = F.sum(v * w) / F.sum(w), F.sum(v * v * w) / F.sum(w)
        stats = df.agg(mean.alias("_off"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("_scale"))
    factor = F.when(F.col("_scale") > 0, spread / F.col("_scale")).otherwise(F.lit(1.0))
    out = df.crossJoin(F.broadcast(stats)).withColumn(column, (v - F.col("_off")) * factor + expected)
    return out.drop("_off", "_scale", WEIGHT)


def one_hot(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """A 0/1 column for each value; all are unknown where the value is."""
    return df.select(*[c for c in df.columns if c != column], *[(F.col(column) == v).cast("int").alias(f"{column}_{v}") for v in values])


def moments(df: DataFrame, columns: Sequence[str], maximum_likelihood: bool = False) -> DataFrame:
    """``(a, b, n, covariance, correlation)`` of each pair of columns over the rows where both are known, weighted; one pass.

    Unbiased sums divide by the weight less one, maximum likelihood by the weight.
    """
    df = weighted(df)
    sums = []
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    for i, (a, b) in enumerate(pairs):
        w = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(WEIGHT))
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        parts = {"n": w, "x": w * x, "y": w * y, "xx": w * x * x, "yy": w * y * y, "xy": w * x * y}
        sums += [F.sum(v).alias(f"{k}{i}") for k, v in parts.items()]
    rows = []
    for i, (a, b) in enumerate(pairs):
        n, x, y, xx, yy, xy = (F.col(f"{k}{i}") for k in ("n", "x", "y", "xx", "yy", "xy"))
        cov, vx, vy = xy - x * y / n, xx - x * x / n, yy - y * y / n
        divisor = n if maximum_likelihood else n - 1
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), n.alias("n"), (cov / divisor).alias("covariance"), (cov / F.sqrt(vx * vy)).alias("correlation")))
    return df.agg(*sums).select(F.inline(F.array(*rows)))


# --- columns, tuples and runs ----------------------------------------------------------------------


def exchange_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """Columns ``a`` and ``b`` in each other's place."""
    return df.select(*[b if c == a else a if c == b else c for c in df.columns])


def move_column(df: DataFrame, name: str, place: int) -> DataFrame:
    rest = [c for c in df.columns if c != name]
    return df.select(*rest[:place], name, *rest[place:])


def columns_where(df: DataFrame, keep) -> DataFrame:
    """The columns whose field (name, type, nullability, metadata) ``keep`` accepts."""
    return df.select(*[f"`{f.name}`" for f in df.schema.fields if keep(f)])


def cut_columns(df: DataFrame, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """(columns from place ``first`` to before ``last``, the others)."""
    return df.select(*df.columns[first:last]), df.select(*df.columns[:first], *df.columns[last:])


def exchange_tuples(df: DataFrame, order: Sequence[str], first: int, second: int, count: int) -> DataFrame:
    """``df`` with ``_row``: the ranges of ``count`` rows from ``first`` and from ``second`` in each other's place."""
    row = F.col("_row")
    moved = F.when(row.between(first, first + count - 1), row + (second - first)).when(row.between(second, second + count - 1), row - (second - first)).otherwise(row)
    return numbered(df, [F.col(c) for c in order]).withColumn("_row", moved)


def remove_tuples(df: DataFrame, order: Sequence[str], first: int, count: int) -> DataFrame:
    """``df`` without a range of rows."""
    return numbered(df, [F.col(c) for c in order]).where(~F.col("_row").between(first, first + count - 1)).drop("_row")


def apply(df: DataFrame, change, schema=None) -> DataFrame:
    """Every tuple through ``change(frame)``, which gets and gives frames of rows."""

    def run(batches):
        for batch in batches:
            yield change(batch)

    return df.mapInPandas(run, schema or df.schema)


def project_vectors(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """A vector of doubles for each group of columns; text that is no number counts as its domain's place is unknown: null."""
    return df.select("*", *[F.array(*[F.col(c).try_cast("double") for c in cs]).alias(name) for name, cs in groups.items()])


def search(df: DataFrame, column: str, value) -> DataFrame:
    """``(first, n)``: the first row of a value in the column's order, null if it's absent, and how many rows have it."""
    below = F.count_if(F.col(column) < value)
    n = F.count_if(F.col(column) == value)
    return df.agg(F.when(n > 0, below).alias("first"), n.alias("n"))


def merge_runs(runs: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """Sorted runs as one table with exact row numbers ``_row``; the runs' own order isn't needed."""
    merged = runs[0]
    for r in runs[1:]:
        merged = merged.unionByName(r)
    return numbered(merged, [F.col(c) for c in order])


def ranks(df: DataFrame, column: str, key: str) -> DataFrame:
    """``(key, rank, index)``: each row's rank by the column (ties by key), and the key of the row whose rank is this row's place by key."""
    by_value = numbered(df.select(F.col(key).alias("_k"), F.col(column).alias("_v")), [F.col("_v"), F.col("_k")], "rank")
    by_key = numbered(df.select(F.col(key).alias("_k")), [F.col("_k")], "_place")
    at = by_value.select(F.col("rank").alias("_place"), F.col("_k").alias("index"))
    return by_value.select("_k", "rank").join(by_key, "_k").join(at, "_place").select(F.col("_k").alias(key), "rank", "index")


def median(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The middle value, or the mean of the two middle ones."""
    return df.groupBy(*by).agg(F.percentile(column, F.lit(0.5)).alias("median"))
