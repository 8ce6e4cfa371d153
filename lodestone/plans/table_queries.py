"""Registered queries of the table toolkit."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import table as T

from .data import table

#: Columns are compared after rounding to this many places where sums of floats may be added in another order.
PLACES = 6


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, PLACES) for c in columns})


def _customers(spark, d):
    key = F.nullif(F.col("c_nationkey"), F.lit(3))
    return table(spark, d, "customer").select("c_custkey", key.alias("k"), (F.col("c_custkey") % 7 + 1).cast("double").alias("_w"))


def _suppliers(spark, d):
    key = F.nullif(F.col("s_nationkey"), F.lit(3))
    return table(spark, d, "supplier").select("s_suppkey", key.alias("k2"), (F.col("s_suppkey") % 5 + 1).cast("double").alias("_w"))


_C = "(SELECT c_custkey, nullif(c_nationkey, 3) AS k, (c_custkey % 7 + 1)::DOUBLE AS w FROM customer)"
_S = "(SELECT s_suppkey, nullif(s_nationkey, 3) AS k2, (s_suppkey % 5 + 1)::DOUBLE AS w FROM supplier)"


def tbl_join_nullsafe(spark, d):
    return T.join(_customers(spark, d).drop("_w"), _suppliers(spark, d).drop("_w"), [("k", "k2")]).withColumn("k", F.coalesce("k", F.lit(-1)))


def tbl_join_weighted(spark, d):
    return T.join(_customers(spark, d), _suppliers(spark, d), [("k", "k2")]).withColumn("k", F.coalesce("k", F.lit(-1)))


def tbl_join_natural(spark, d):
    nation = table(spark, d, "nation").select("n_name", F.col("n_regionkey").alias("regionkey"))
    return T.natural_join(nation, table(spark, d, "region").select(F.col("r_regionkey").alias("regionkey"), "r_name"))


def tbl_join_natural_cross(spark, d):
    return T.natural_join(table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name"))


def tbl_union_project(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), "s_acctbal")
    return T.union_project(["name", "nation"], c, s)


def tbl_reduce(spark, d):
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("_w"))
    return T.reduce(lines)


def tbl_weight_sum(spark, d):
    return T.total_weight(table(spark, d, "lineitem").select(F.col("l_quantity").alias("_w")))


def _partial(spark, d):
    a = F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment"))
    b = F.when(F.col("c_custkey") % 7 != 0, (F.col("c_nationkey") % 3).cast("string"))
    return table(spark, d, "customer").select(a.alias("a"), b.alias("b"))


_P = (
    "(SELECT CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS a, "
    "CASE WHEN c_custkey % 7 <> 0 THEN (c_nationkey % 3)::VARCHAR END AS b FROM customer)"
)


def tbl_opc_full(spark, d):
    return T.coverage_full(_partial(spark, d))


def tbl_opc_cond(spark, d):
    return T.coverage_condensed(_partial(spark, d))


def tbl_opc_norm(spark, d):
    return _rounded(T.normalised_weights(T.coverage_full(_partial(spark, d))), "_w")


def tbl_poss(spark, d):
    queries = _partial(spark, d).distinct()
    return T.possibility(_partial(spark, d), queries)


def tbl_poss_expanded(spark, d):
    p = _partial(spark, d)
    domains = {c: p.select(c).where(F.col(c).isNotNull()).distinct() for c in ("a", "b")}
    return _rounded(T.possibility_expanded(p, p.distinct(), domains), "least", "mean", "greatest")


def _segments(spark, d):
    guess = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise(F.lit("BUILDING"))
    return table(spark, d, "customer").select("c_mktsegment", guess.alias("guess"))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def tbl_xmat(spark, d):
    return T.crosstab(_segments(spark, d), "guess", "c_mktsegment", _SEGMENTS)


def tbl_xmat_percent(spark, d):
    return _rounded(T.crosstab(_segments(spark, d), "guess", "c_mktsegment", _SEGMENTS, percent=True), *[f"x_{v}" for v in _SEGMENTS], "errors", "total")


def _classed(spark, d):
    segment = F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_nationkey", segment.alias("segment"))


_B = "(SELECT c_nationkey, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS segment FROM customer)"


def _balance(mode, **more):
    def query(spark, d):
        return _rounded(T.balance(_classed(spark, d), "segment", mode, **more), "_w")

    return query


def _balance_sql(total, share="1.0 / n"):
    return f"""WITH r AS (SELECT c_nationkey, segment, count(*)::DOUBLE AS w FROM {_B} GROUP BY ALL),
s AS (SELECT segment, sum(w) AS s FROM r WHERE segment IS NOT NULL GROUP BY segment),
t AS (SELECT count(*) AS n, max(s) AS mx, min(s) AS mn, (SELECT sum(w) FROM r) AS al FROM s)
SELECT c_nationkey, segment, round(coalesce(w * (SELECT {total} FROM t) * (SELECT {share} FROM t) / s, 0), 6) AS _w
FROM r LEFT JOIN s USING (segment)"""


def tbl_split_stratified(spark, d):
    return T.folds(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), 3, ["c_custkey"], stratify="c_mktsegment")


def tbl_sample_systematic(spark, d):
    return T.systematic_sample(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), 100, ["o_orderdate", "o_orderkey"])


def tbl_sort_topk(spark, d):
    keyed = table(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("k"))
    return T.sort(keyed, "k", "c_custkey").limit(25).withColumn("k", F.coalesce("k", F.lit(-1)))


def tbl_normalize_z(spark, d):
    return _rounded(T.normalise(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v")), "v"), "v")


def tbl_normalize_range(spark, d):
    return _rounded(T.normalise(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v")), "v", 0.0, 1.0, by_range=True), "v")


def tbl_onehot(spark, d):
    return T.one_hot(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", _SEGMENTS)


def tbl_domains(spark, d):
    return T.domains(table(spark, d, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("int")), ["c_custkey", "c_nationkey", "c_mktsegment"])


def tbl_uvcount(spark, d):
    p = _partial(spark, d)
    return p.select(T.unknown_count(p).alias("unknown")).groupBy("unknown").agg(F.count("*").alias("n"))


def tbl_filter_cut(spark, d):
    kept, rest = T.cut(_classed(spark, d), F.col("segment") == "BUILDING")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(kept, "kept").union(count(rest, "rest"))


def tbl_convert(spark, d):
    text = table(spark, d, "customer").select("c_custkey", F.substring("c_name", 10, 9).alias("tail"), F.col("c_acctbal").cast("string").alias("balance"))
    return T.convert(text, {"tail": "bigint", "balance": "double"})


def tbl_fill_unknown(spark, d):
    return T.fill_unknown(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") % 4 == 0, ["c_mktsegment"])


def tbl_compat_pairs(spark, d):
    p = T.reduce(_partial(spark, d))
    a, b = p.alias("a"), p.alias("b")
    both = a.join(b, T.compatible([F.col("a.a"), F.col("a.b")], [F.col("b.a"), F.col("b.b")]))
    return both.agg(F.count("*").alias("pairs"), F.sum(F.col("a._w") * F.col("b._w")).alias("weight"))


def stat_cov_corr(spark, d):
    lines = table(spark, d, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("price"), "l_discount")
    return T.moments(lines, lines.columns).select("a", "b", "n", F.round("covariance", 6).alias("covariance"), F.round("correlation", 6).alias("correlation"))


def stat_cov_weighted(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") != 2, F.col("l_discount")).alias("x"), F.col("l_tax").alias("y"), F.col("l_quantity").alias("_w")
    )
    out = T.moments(lines, ["x", "y"], maximum_likelihood=True)
    return out.select("a", "b", "n", F.round("covariance", 8).alias("covariance"), F.round("correlation", 6).alias("correlation"))


def stat_zscore_pop(spark, d):
    v = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("v"))
    return _rounded(T.normalise(v, "v", 0.0, 1.0), "v")


def _poss_sql(degree="SELECT a, b, coalesce(degree, 0) AS degree"):
    return f"""WITH p AS (SELECT a, b, count(*)::DOUBLE AS w FROM {_P} GROUP BY ALL), q AS (SELECT DISTINCT a, b FROM {_P}),
m AS (SELECT q.a, q.b, max(w) AS degree FROM q LEFT JOIN p ON (q.a = p.a OR q.a IS NULL OR p.a IS NULL) AND (q.b = p.b OR q.b IS NULL OR p.b IS NULL) GROUP BY ALL)
{degree} FROM m"""


_OPC = f"""WITH p AS {_P}, da AS (SELECT DISTINCT a FROM p WHERE a IS NOT NULL), db AS (SELECT DISTINCT b FROM p WHERE b IS NOT NULL),
f AS (SELECT coalesce(p.a, da.a) AS a, p.b FROM p LEFT JOIN da ON p.a IS NULL),
g AS (SELECT f.a, coalesce(f.b, db.b) AS b FROM f LEFT JOIN db ON f.b IS NULL),
o AS (SELECT a, b, count(*)::DOUBLE AS _w FROM g GROUP BY ALL)"""

_XMAT = ", ".join(f"sum(CASE WHEN guess = '{v}' THEN 1.0 ELSE 0 END)::DOUBLE AS \"x_{v}\"" for v in _SEGMENTS)
_X = f"""SELECT coalesce(c_mktsegment, 'total') AS c_mktsegment, {_XMAT},
sum(CASE WHEN guess <> c_mktsegment THEN 1.0 ELSE 0 END)::DOUBLE AS errors, count(*)::DOUBLE AS total
FROM (SELECT c_mktsegment, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'BUILDING' END AS guess FROM customer) GROUP BY ROLLUP (c_mktsegment)"""
_XP = ", ".join(f'round(100 * "{c}" / (SELECT max(total) FROM x), 6) AS "{c}"' for c in [*(f"x_{v}" for v in _SEGMENTS), "errors", "total"])


def _moment_sql(columns, w, divisor, places):
    out = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            ok = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {w} END"
            s = lambda e: f"sum({ok} * {e})"  # noqa: B023, E731
            n = f"sum({ok})"
            cov, vx, vy = (f"({s(x + ' * ' + y)} - {s(x)} * {s(y)} / {n})" for x, y in ((a, b), (a, a), (b, b)))
            out.append(f"SELECT '{a}' AS a, '{b}' AS b, {n}::DOUBLE AS n, round({cov} / ({n} {divisor}), {places}) AS covariance, round({cov} / sqrt({vx} * {vy}), 6) AS correlation FROM t")
    return " UNION ALL ".join(out)


QUERIES = {
    "tbl_join_nullsafe": tbl_join_nullsafe,
    "tbl_join_weighted": tbl_join_weighted,
    "tbl_join_natural": tbl_join_natural,
    "tbl_join_natural_cross": tbl_join_natural_cross,
    "tbl_union_project": tbl_union_project,
    "tbl_reduce": tbl_reduce,
    "tbl_weight_sum": tbl_weight_sum,
    "tbl_opc_full": tbl_opc_full,
    "tbl_opc_cond": tbl_opc_cond,
    "tbl_opc_norm": tbl_opc_norm,
    "tbl_poss": tbl_poss,
    "tbl_poss_expanded": tbl_poss_expanded,
    "tbl_xmat": tbl_xmat,
    "tbl_xmat_percent": tbl_xmat_percent,
    "tbl_balance_shift": _balance("shift"),
    "tbl_balance_boost": _balance("boost"),
    "tbl_balance_lower": _balance("lower"),
    "tbl_balance_target": _balance(1000.0, frequencies={s: i + 1 for i, s in enumerate(_SEGMENTS)}),
    "tbl_split_stratified": tbl_split_stratified,
    "tbl_sample_systematic": tbl_sample_systematic,
    "tbl_sort_topk": tbl_sort_topk,
    "tbl_normalize_z": tbl_normalize_z,
    "tbl_normalize_range": tbl_normalize_range,
    "tbl_onehot": tbl_onehot,
    "tbl_domains": tbl_domains,
    "tbl_uvcount": tbl_uvcount,
    "tbl_filter_cut": tbl_filter_cut,
    "tbl_convert": tbl_convert,
    "tbl_fill_unknown": tbl_fill_unknown,
    "tbl_compat_pairs": tbl_compat_pairs,
    "stat_cov_corr": stat_cov_corr,
    "stat_cov_weighted": stat_cov_weighted,
    "stat_zscore_pop": stat_zscore_pop,
}

_Z = "SELECT {k}, round(({v} - (SELECT avg({v}) FROM {t})) / (SELECT stddev_pop({v}) FROM {t}), 6) AS v FROM {t}"

ORACLES = {
    "tbl_join_nullsafe": f"SELECT c_custkey, coalesce(k, -1) AS k, s_suppkey FROM {_C} JOIN {_S} ON k IS NOT DISTINCT FROM k2",
    "tbl_join_weighted": f"SELECT c_custkey, coalesce(k, -1) AS k, s_suppkey, c.w * s.w AS _w FROM {_C} c JOIN {_S} s ON k IS NOT DISTINCT FROM k2",
    "tbl_join_natural": "SELECT n_name, n_regionkey AS regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "tbl_join_natural_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "tbl_union_project": "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier",
    "tbl_reduce": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS _w FROM lineitem GROUP BY ALL",
    "tbl_weight_sum": "SELECT sum(l_quantity) AS _w FROM lineitem",
    "tbl_opc_full": f"{_OPC} SELECT * FROM o",
    "tbl_opc_cond": f"""WITH p AS (SELECT a, b, count(*)::DOUBLE AS w FROM {_P} GROUP BY ALL),
c AS (SELECT a, b FROM p UNION SELECT coalesce(x.a, y.a), coalesce(x.b, y.b) FROM p x, p y
WHERE (x.a = y.a OR x.a IS NULL OR y.a IS NULL) AND (x.b = y.b OR x.b IS NULL OR y.b IS NULL))
SELECT c.a, c.b, sum(w) AS _w FROM c JOIN p ON (p.a IS NULL OR p.a = c.a) AND (p.b IS NULL OR p.b = c.b) GROUP BY ALL""",
    "tbl_opc_norm": f"{_OPC} SELECT a, b, round(_w / (SELECT sum(_w) FROM o), 6) AS _w FROM o",
    "tbl_poss": _poss_sql(),
    "tbl_poss_expanded": f"""WITH p AS (SELECT a, b, count(*)::DOUBLE AS w FROM {_P} GROUP BY ALL), q AS (SELECT DISTINCT a, b FROM {_P}),
da AS (SELECT DISTINCT a FROM q WHERE a IS NOT NULL), db AS (SELECT DISTINCT b FROM q WHERE b IS NOT NULL),
f AS (SELECT q.a, q.b, coalesce(q.a, da.a) AS fa, coalesce(q.b, db.b) AS fb FROM q LEFT JOIN da ON q.a IS NULL LEFT JOIN db ON q.b IS NULL),
m AS (SELECT f.a, f.b, fa, fb, coalesce(max(w), 0) AS degree FROM f LEFT JOIN p ON (fa = p.a OR p.a IS NULL) AND (fb = p.b OR p.b IS NULL) GROUP BY ALL)
SELECT a, b, round(min(degree), 6) AS least, round(avg(degree), 6) AS mean, round(max(degree), 6) AS greatest FROM m GROUP BY a, b""",
    "tbl_xmat": _X,
    "tbl_xmat_percent": f"WITH x AS ({_X}) SELECT c_mktsegment, {_XP} FROM x",
    "tbl_balance_shift": _balance_sql("al"),
    "tbl_balance_boost": _balance_sql("n * mx"),
    "tbl_balance_lower": _balance_sql("n * mn"),
    "tbl_balance_target": _balance_sql("1000.0", "CASE segment " + " ".join(f"WHEN '{s}' THEN {i + 1} / 15.0" for i, s in enumerate(_SEGMENTS)) + " END"),
    "tbl_split_stratified": "SELECT c_custkey, c_mktsegment, ((row_number() OVER (ORDER BY c_mktsegment NULLS FIRST, c_custkey) - 1) % 3)::INT AS fold FROM customer",
    "tbl_sample_systematic": """SELECT o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r,
(SELECT count(*) // 100 FROM orders) AS k FROM orders) WHERE r % k = 0 AND r < 100 * k""",
    "tbl_sort_topk": "SELECT c_custkey, coalesce(k, -1) AS k FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k NULLS FIRST, c_custkey LIMIT 25)",
    "tbl_normalize_z": _Z.format(k="c_custkey", v="c_acctbal", t="customer"),
    "tbl_normalize_range": """SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer))
/ (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 6) AS v FROM customer""",
    "tbl_onehot": "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS \"c_mktsegment_{s}\"" for s in _SEGMENTS) + " FROM customer",
    "tbl_domains": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS kind, min({c})::VARCHAR AS least, max({c})::VARCHAR AS greatest, count(DISTINCT {c}) AS n_values FROM customer"
        for c, k in (("c_custkey", "numeric"), ("c_nationkey", "numeric"), ("c_mktsegment", "symbolic"))
    ),
    "tbl_uvcount": f"SELECT (a IS NULL)::INT + (b IS NULL)::INT AS unknown, count(*) AS n FROM {_P} GROUP BY 1",
    "tbl_filter_cut": f"""SELECT 'kept' AS part, count(*) AS n FROM {_B} WHERE segment = 'BUILDING'
UNION ALL SELECT 'rest', count(*) FROM {_B} WHERE coalesce(segment, '') <> 'BUILDING'""",
    "tbl_convert": "SELECT c_custkey, try_cast(substr(c_name, 10, 9) AS BIGINT) AS tail, c_acctbal AS balance FROM customer",
    "tbl_fill_unknown": "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer",
    "tbl_compat_pairs": f"""WITH p AS (SELECT a, b, count(*)::DOUBLE AS w FROM {_P} GROUP BY ALL)
SELECT count(*) AS pairs, sum(x.w * y.w) AS weight FROM p x, p y WHERE (x.a = y.a OR x.a IS NULL OR y.a IS NULL) AND (x.b = y.b OR x.b IS NULL OR y.b IS NULL)""",
    "stat_cov_corr": "WITH t AS (SELECT l_quantity, l_extendedprice / 1000 AS price, l_discount FROM lineitem) "
    + _moment_sql(["l_quantity", "price", "l_discount"], "1.0::DOUBLE", "- 1", 6),
    "stat_cov_weighted": "WITH t AS (SELECT CASE WHEN l_linenumber <> 2 THEN l_discount END AS x, l_tax AS y, l_quantity AS w FROM lineitem) "
    + _moment_sql(["x", "y"], "w", "", 8),
    "stat_zscore_pop": _Z.format(k="s_suppkey", v="s_acctbal", t="supplier"),
}
