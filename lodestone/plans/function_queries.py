"""Registered queries of functions and of table, alignment and cluster operators that have no place among the others."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import bitmaps as B
from lodestone.functions import draws as D
from lodestone.functions import matrix as M
from lodestone.functions import scaling, special
from lodestone.functions import sequences as S
from lodestone.functions import strings as X
from lodestone.functions import vectors as V
from lodestone.operators import align as A
from lodestone.operators import classify as K
from lodestone.operators import cluster as C
from lodestone.operators import patterns as P
from lodestone.operators import table as T

from .data import points, table

# --- tables ----------------------------------------------------------------------------------------


def _customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment")


def tbl_columns(spark, d):
    """Exchanged, moved, chosen by type and cut columns; places name what lies there."""
    df = T.move_column(T.exchange_columns(_customers(spark, d), "c_custkey", "c_acctbal"), "c_mktsegment", 0)
    text = T.columns_where(df, lambda f: f.dataType.simpleString() == "string").columns
    inside, outside = T.cut_columns(df, 1, 3)
    renamed = df.toDF(*[f"p{i}" for i in range(len(df.columns))])
    return renamed.withColumn("text", F.lit(",".join(text))).withColumn("cut", F.lit(",".join([*inside.columns, "|", *outside.columns])))


def tbl_exchange_tuples(spark, d):
    """Rows 3 to 7 and 20 to 24 in each other's place, and rows 50 to 59 removed."""
    rows = T.exchange_tuples(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 3, 20, 5)
    return T.remove_tuples(rows.withColumnRenamed("_row", "place"), ["place"], 50, 10)


def tbl_partition(spark, d):
    yes, no = T.cut(_customers(spark, d), F.nullif(F.col("c_nationkey"), F.lit(3)) > 10)
    return yes.agg(F.count("*").alias("yes")).crossJoin(no.agg(F.count("*").alias("no")))


def tbl_insert_unknowns(spark, d):
    """Ten percent of two columns become unknown, in bounds, and the others none; the same seed gives the same ones."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    out = T.insert_unknowns(lines, 10.0, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"], seed=3)
    again = T.insert_unknowns(lines, 10.0, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"], seed=3)
    share = lambda c: F.avg(F.col(c).isNull().cast("double"))
    same = out.exceptAll(again).agg((F.count("*") == 0).alias("same"))
    return out.agg(*[(F.abs(share(c) - 0.1) < 0.02).alias(c) for c in ("l_quantity", "l_tax")], (share("l_partkey") == 0).alias("l_partkey")).crossJoin(same)


def tbl_vectors(spark, d):
    """Two vectors of a record, numbers from text where it is one, and a linear map of one of them."""
    df = T.project_vectors(_customers(spark, d).withColumn("text", F.substring("c_mktsegment", 1, 1)), {"v": ["c_custkey", "c_acctbal"], "w": ["c_nationkey", "text"]})
    moved = V.affine(F.col("v"), [2.0, -1.0], [1.0, 0.5])
    return df.select("c_custkey", F.round(moved[0], 2).alias("a"), F.round(moved[1], 2).alias("b"), F.col("w")[0].alias("c"), F.col("w")[1].isNull().alias("unknown"))


def tbl_search(spark, d):
    df = _customers(spark, d)
    found = [T.search(df, "c_nationkey", v).withColumn("value", F.lit(v)) for v in (0, 7, 24, 99)]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.withColumn("first", F.coalesce("first", F.lit(-1)))


def tbl_merge_runs(spark, d):
    """Customers and suppliers by balance and name as one numbered run, every hundredth row."""
    c = table(spark, d, "customer").select(F.round("c_acctbal", 2).alias("balance"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.round("s_acctbal", 2).alias("balance"), F.col("s_name").alias("name"))
    return T.merge_runs([c.orderBy("balance"), s.orderBy("balance")], ["balance", "name"]).where("_row % 100 = 0").withColumnRenamed("_row", "place")


def tbl_ranks(spark, d):
    return T.ranks(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


def tbl_median(spark, d):
    return T.median(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]).withColumn("median", F.round("median", 6))


def tbl_apply(spark, d):
    """A change of every tuple by a Python function over batches."""

    def change(frame):
        return frame.assign(c_acctbal=(frame["c_acctbal"] * 2).round(2), c_mktsegment=frame["c_mktsegment"].str.lower())

    return T.apply(_customers(spark, d), change)


def tbl_shuffle(spark, d):
    """A seeded order: the same rows, another order, and the same one for the same seed."""
    keys = table(spark, d, "customer").select("c_custkey")
    a, b, c = (np.array([r[0] for r in T.shuffle(keys, ["c_custkey"], s).collect()]) for s in (1, 1, 2))
    return spark.createDataFrame([(int(len(a)), int(a.sum()), bool((a == b).all()), bool((a == c).all()), bool((np.diff(a) > 0).all()))], "n long, total long, same long_seed boolean, other boolean, sorted boolean".replace("same long_seed", "same"))


def tbl_hash(spark, d):
    """Equal tuples have equal hashes, different ones different."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return rows.agg(F.countDistinct("l_returnflag", "l_linestatus", "l_quantity").alias("tuples"), F.countDistinct(F.xxhash64("l_returnflag", "l_linestatus", "l_quantity")).alias("hashes"))


def tbl_sets(spark, d):
    """Unions, intersections and inclusion of the sets of segments of neighbouring nations."""
    sets = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("s"))
    sets = sets.withColumn("s", F.filter("s", lambda v, i: (i + F.col("k")) % 3 != 0))
    a, b = sets.select("k", F.col("s").alias("a")), sets.select((F.col("k") - 1).alias("k"), F.col("s").alias("b"))
    both = a.join(b, "k")
    union, common = F.array_sort(F.array_union("a", "b")), F.array_sort(F.array_intersect("a", "b"))
    return both.select("k", F.array_join(union, ",").alias("either"), F.array_join(common, ",").alias("both"), (F.size(F.array_except("a", "b")) == 0).alias("inside"))


def scaling_registry(spark, d):
    """Scaled to mean 0 and deviation 1, to a widened range, and back."""
    q = F.col("l_quantity")
    lines = table(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", q.alias("z"), F.col("l_tax").alias("t"), q.alias("back"), q.alias("ranged"))
    one = scaling.Scaling(["z", "t"]).register(lines)
    copy = scaling.Scaling(["back"]).register(lines)
    two = scaling.Scaling(["ranged"]).register(lines).expand(2.0).to_range(-1.0, 1.0)
    out = two.apply(copy.undo(copy.apply(one.apply(lines))))
    return out.withColumns({c: F.round(c, 6) for c in ("z", "t", "back", "ranged")})


# --- bitmaps, subsets ------------------------------------------------------------------------------


def _items(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tid"), (F.col("l_partkey") % 20).cast("int").alias("item")).distinct()


_ITEMS = "(SELECT DISTINCT l_orderkey AS tid, (l_partkey % 20)::INT AS item FROM lineitem)"


def bitmap_likeness(spark, d):
    rows = _items(spark, d)
    n = rows.agg(F.max("tid")).first()[0] + 1
    found = B.likeness(B.bitmaps(rows), n)
    return found.withColumns({c: F.round(c, 9) for c in ("cosine", "correlation")})


def bitmap_counts_after(spark, d):
    maps = B.bitmaps(_items(spark, d))
    some = B.either(maps.withColumn("group", F.col("item") % 4), "group")
    found = B.counts_after(maps, 1000, "item").withColumnRenamed("item", "key").withColumn("kind", F.lit("item"))
    return found.union(B.counts_after(some, 1000, "group").withColumn("kind", F.lit("union")))


def item_subsets(spark, d):
    """All subsets of three items of the baskets with six items or fewer, counted."""
    sets = _items(spark, d).groupBy("tid").agg(F.array_sort(F.collect_list(F.lpad(F.col("item").cast("string"), 2, "0"))).alias("items")).where(F.size("items") <= 6)
    three = sets.select(F.explode(special.subsets(F.col("items"), 3)).alias("s"))
    return three.groupBy(F.array_join("s", ",").alias("items")).agg(F.count("*").alias("n"))


def next_subsets(spark, d):
    places, out = [0, 1, 2], []
    while places is not None:
        out.append(tuple(places))
        places = special.next_subset(places, 6)
    return spark.createDataFrame(out, "a long, b long, c long")


def pair_graph_order(spark, d):
    """The items of the frequent-pair graph by support, with the number of their neighbours."""
    rows = _items(spark, d)
    pairs = P.frequent_pairs(rows, 10)
    ends = pairs.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("neighbours"))
    found = P.item_counts(rows).join(ends, "item")
    return T.numbered(found, [F.col("support"), F.col("item")], "place")


def pair_cliques(spark, d):
    """Maximal cliques of a graph of brands: brands are joined if they share many baskets."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tid"), (F.col("l_partkey") % 7).cast("string").alias("item")).distinct()
    least = rows.select("tid").distinct().count() // 6
    found = P.cliques(P.frequent_pairs(rows, least))
    return found.select(F.array_join(F.array_sort(found.columns[0]), ",").alias("members"))


# --- numbers ---------------------------------------------------------------------------------------


def fn_special(spark, d):
    rows = [
        ("chi2 0.05 of 2", special.chi_square_quantile(0.95, 2)), ("normal 0.975", special.normal_quantile(0.975)), ("zeta 2", special.zeta(2.0)), ("zeta 4", special.zeta(4.0)),
        ("choose 50 6", float(special.choose(50, 6))), ("incomplete gamma 1 2", special.regularised_gamma(1.0, 2.0)), ("incomplete gamma 3 1", special.regularised_gamma(3.0, 1.0)),
        ("beta 3 4", special.beta(3.0, 4.0)), ("gamma rates mean", float(np.mean(special.gamma_rates(0.7, 8)))), ("root", special.brent_root(lambda x: x * x * x - 2, 0.0, 2.0)),
        ("minimum", special.golden_minimum(lambda x: (x - 1.25) ** 2, 0.0, 3.0)), ("chebyshev", special.chebyshev_value(special.chebyshev(math.exp, 0.0, 2.0, 20), 0.0, 2.0, 1.3)),
        *((f"laguerre {k}", float((special.laguerre(5)[0] ** k * special.laguerre(5)[1]).sum())) for k in (0, 3, 9)),
    ]
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in rows], "name string, value double")


def fn_gamma_columns(spark, d):
    keys = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") / 2 + 1).alias("x"))
    return keys.select("n_nationkey", F.round(special.log_gamma("x"), 6).alias("lgamma"), F.round(special.gamma("x") / special.gamma(F.col("x") - 0.5), 6).alias("ratio"))


def fn_vectors(spark, d):
    p = points(spark, d, 64)
    three = F.slice("x", 1, 3), F.slice("x", 4, 3)
    crossed = V.cross(*three)
    return p.select(
        "id", F.round(V.dot(F.col("x"), F.col("x")), 6).alias("square"), F.round(V.manhattan(*three), 6).alias("manhattan"), F.round(V.square_distance(*three), 6).alias("distance"),
        F.round(crossed[2], 6).alias("cross"), F.round(V.log_sum_exp(F.col("x")), 6).alias("lse"), (F.array_position("x", F.array_max("x")) - 1).cast("int").alias("argmax"),
    )


def fn_densities(spark, d):
    x = F.col("l_extendedprice") / 10000
    rows = table(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", x.alias("x"))
    c = F.col("x")
    return rows.select("l_orderkey", *[F.round(f, 9).alias(n) for n, f in (("density", V.evd_density(c, 2.0, 0.8)), ("cdf", V.evd_cdf(c, 2.0, 0.8)), ("p", V.evd_p(c, 2.0, 0.8)), ("normal", V.normal_density(c, 3.0, 2.0)))])


def fn_line_fit(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_linenumber") * 1.0).alias("w"))
    one = special.line_fit(rows, "l_quantity", "l_extendedprice").withColumn("kind", F.lit("plain"))
    return one.union(special.line_fit(rows, "l_quantity", "l_extendedprice", "w").withColumn("kind", F.lit("weighted"))).select("kind", *[F.round(c, 4).alias(c) for c in ("slope", "intercept", "correlation")])


def fn_regression(spark, d):
    b = M.regression(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice")
    return spark.createDataFrame([(i, round(float(v), 3)) for i, v in enumerate(b)], "i int, value double")


def fn_draws(spark, d):
    """Means and deviations of draws within four standard errors of what their distributions say, and shares of choices."""
    n = 40000
    rows, key = spark.range(n), F.col("id")
    cases = {
        "uniform": (D.uniform(key, 1), 0.5, 1 / math.sqrt(12)), "exponential": (D.exponential(key, 2, 3.0), 3.0, 3.0), "normal": (D.normal(key, 3, 5.0, 2.0), 5.0, 2.0),
        "lognormal": (F.log(D.lognormal(key, 4, 1.0, 0.5)), 1.0, 0.5), "gamma": (D.gamma(key, 5, 3, 2.0), 6.0, math.sqrt(12.0)), "beta": (D.beta(key, 6, 2, 3), 0.4, 0.2),
        "hyperexponential": (D.hyperexponential(key, 7, 0.3, 1.0, 5.0), 3.8, math.sqrt(2 * (0.3 + 0.7 * 25) - 3.8**2)), "choose": ((D.choose(key, 8, [1, 2, 5]) == 2).cast("double"), 0.625, math.sqrt(0.625 * 0.375)),
    }
    checks = [F.struct(F.lit(n_).alias("name"), (F.abs(F.avg(c) - m) < 4 * s / math.sqrt(n)).alias("mean"), (F.abs(F.stddev_samp(c) / s - 1) < 0.06).alias("deviation")) for n_, (c, m, s) in cases.items()]
    return rows.agg(F.array(*checks).alias("c")).select(F.inline("c"))


def fn_kernels(spark, d):
    """Kernels between the labels' mean vectors (their first eight dimensions)."""
    means = points(spark, d, 8).groupBy("label").agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(8)]).orderBy("label").collect()
    x = np.array([[r[f"m{i}"] for i in range(8)] for r in means])
    rows = []
    for kind in ("linear", "poly", "rbf", "sigmoid"):
        g = K.kernel(kind, x, x, gamma=0.5, coef=1.0, degree=2)
        rows += [(kind, int(means[i].label), int(means[j].label), round(float(g[i, j]), 6)) for i in range(len(x)) for j in range(i, len(x))]
    return spark.createDataFrame(rows, "kind string, a long, b long, value double")


def svm_normalised(spark, d):
    long = points(spark, d, 64).select(F.col("id").alias("rid"), F.posexplode("x").alias("feature", "x"))
    out = K.normalise_long(long).groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum(F.abs("x")), 4).alias("size"), F.round(F.max("x"), 6).alias("most"))
    return out


# --- matrices --------------------------------------------------------------------------------------


def _matrix(spark, d):
    m = table(spark, d, "customer").groupBy((F.col("c_nationkey") % 6).cast("long").alias("i"), (F.col("c_custkey") % 5).alias("j"))
    return m.agg(F.round(F.sum("c_acctbal") / 1000, 3).alias("v"))


def mat_products(spark, d):
    """M M', its diagonal, M + 2 M, and M times a vector."""
    m = _matrix(spark, d)
    gram = M.multiply(m, M.transpose(m))
    vector = spark.createDataFrame([(j, float(j + 1)) for j in range(5)], "j long, x double")
    parts = [
        gram.select(F.lit("gram").alias("kind"), "i", "j", "v"), M.diagonal(gram).select(F.lit("diagonal"), "i", F.col("i"), "v"),
        M.add(m, m, 2.0).select(F.lit("sum"), "i", "j", "v"), M.times_vector(m, vector).select(F.lit("vector"), "i", F.lit(0).cast("long"), "v"),
        M.swap_rows(M.scale(m, -1.0), 0, 3).select(F.lit("swapped"), "i", "j", "v"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("v", F.round("v", 4))


def mat_solutions(spark, d):
    """Determinant, inverse, solution, factors and eigenvalues of a small matrix of sums of products, checked against it."""
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 10).alias("c"))
    names = ["a", "b", "c"]
    r = rows.agg(*[F.avg(F.col(x) * F.col(y)).alias(x + y) for x in names for y in names]).first()
    m = np.array([[r[x + y] for y in names] for x in names])
    order, low, up = M.lu(m)
    cholesky, (values, vectors) = M.cholesky(m), M.symmetric_eigen(m)
    found = [
        ("determinant", M.determinant(m)), ("inverse", float(np.abs(M.invert(m) @ m - np.eye(3)).max())), ("solution", float(np.abs(m @ M.solve(m, np.ones(3)) - 1).max())),
        ("lu", float(np.abs(low @ up - m[order]).max())), ("cholesky", float(np.abs(cholesky @ cholesky.T - m).max())), ("trace", float(values.sum())),
        ("eigen", float(np.abs(vectors @ np.diag(values) @ vectors.T - m).max())),
    ]
    return spark.createDataFrame([(n, round(v, 8) + 0.0) for n, v in found], "name string, value double")


# --- text ------------------------------------------------------------------------------------------


def txt_posix(spark, d):
    found = X.matches(F.col("text"), "[[:upper:]][[:lower:]]{2,}[[:blank:]][[:digit:]]+")
    return table(spark, d, "documents").select("doc_id", F.size(found).alias("n"), F.coalesce(F.element_at(F.concat(found, F.array(F.lit(""))), 1), F.lit("")).alias("first"))


def txt_edits(spark, d):
    t = F.concat(F.col("c_name"), F.lit(" \t "))
    return table(spark, d, "customer").select(
        "c_custkey", X.chop(t).alias("chopped"), X.insert(F.col("c_name"), 3, "--").alias("inserted"), X.delete(F.col("c_name"), 2, 4).alias("deleted"),
        F.array_join(X.tokens(F.col("c_name"), "#0"), "|").alias("tokens"), X.is_blank(F.substring(t, -3, 3)).alias("blank"),
    )


def txt_dates(spark, d):
    """Dates written in three forms and decoded by registered decoders; text that is no date is unknown."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("t"))
    out = o.select("o_orderkey", F.date_format("t", "yyyy-MM-dd").alias("a"), F.date_format("t", "MM/dd/yyyy").alias("b"), F.when(F.col("o_orderkey") % 7 == 0, "never").otherwise(F.date_format("t", "yyyy-MM-dd HH:mm:ss")).alias("c"))
    a, b, c = X.Composite.decode("date", F.col("a")), X.Composite.decode("us-date", F.col("b")), X.Composite.decode("timestamp", F.col("c"))
    return out.select("o_orderkey", a.alias("a"), b.alias("b"), F.coalesce(c, F.lit(-1)).alias("c"))


# --- sequences -------------------------------------------------------------------------------------


def _windows(spark, d, whole=False):
    """``(id, seq)``: letters of texts as aligned rows of 40 symbols over ACGT and gaps (``e`` is a gap), from texts with enough."""
    seq = F.upper(F.translate(F.regexp_replace("text", "[^acgte]", ""), "e", "-"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring(seq, 1, 40).alias("seq"), F.length(seq).alias("n"))
    return rows.where("n >= 40" if whole else "n >= 40 and id % 8 = 0").select("id", "seq")


_WINDOWS = """(SELECT doc_id AS id, substr(upper(translate(regexp_replace(text, '[^acgte]', '', 'g'), 'e', '-')), 1, 40) AS seq FROM documents
WHERE length(regexp_replace(text, '[^acgte]', '', 'g')) >= 40 AND doc_id % 8 = 0)"""


def seq_subset(spark, d):
    return A.subset(_windows(spark, d), F.col("id") % 16 == 0, [0, 3, 4, 39])


def seq_identity_filter(spark, d):
    return A.identity_filter(_windows(spark, d, whole=True), 0.5).select("id")


def seq_concatenate(spark, d):
    w = _windows(spark, d)
    return A.concatenate(w, w.select("id", F.reverse("seq").alias("seq")))


def seq_entropy(spark, d):
    return A.column_entropy(_windows(spark, d)).withColumn("entropy", F.round("entropy", 6))


def seq_covariance(spark, d):
    pairs = spark.createDataFrame([(i, 39 - i) for i in range(20)], "i int, j int")
    return A.covariance_index(_windows(spark, d), pairs).withColumn("covariance", F.round("covariance", 6))


def seq_structure_pairs(spark, d):
    """Nested stems of as many pairs as the key's rest, and an unbalanced one."""
    n = (F.col("n_nationkey") % 7 + 1).cast("int")
    stem = F.concat(F.repeat(F.lit("<"), n), F.lit("..."), F.repeat(F.lit(">"), n), F.lit("."), F.lit("<>"))
    ss = F.when(F.col("n_nationkey") == 3, F.lit("<<>")).otherwise(stem)
    return A.structure_pairs(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), ss.alias("ss")))


def seq_types(spark, d):
    kinds = F.array(F.regexp_replace("seq", "-", ""), F.translate("seq", "T-", "U"), F.concat(F.lit("MEFQ"), F.regexp_replace("seq", "-", "")), F.lit("12?"))
    return _windows(spark, d).select("id", F.posexplode(F.transform(kinds, S.sequence_type)).alias("k", "type"))


def seq_digits(spark, d):
    digits = S.digitise(F.col("seq"))
    cleaned = S.to_iupac(F.translate("seq", "G", "Z"))
    return _windows(spark, d).select(
        "id", F.aggregate(digits, F.lit(0), lambda s, v: s + v).alias("digits"), S.gcg_checksum(F.col("seq")).cast("int").alias("checksum"), cleaned.alias("cleaned"), S.dealign(F.col("seq")).alias("plain"),
    )


def seq_degenerate(spark, d):
    codes = F.explode(F.array(*[F.lit(c) for c in "ACGTMRWSYKVHDBN"]))
    one = spark.range(1).select(codes.alias("a")).withColumn("b", F.explode(F.array(*[F.lit(c) for c in "ACGT"])))
    return one.select("a", "b", F.round(S.degenerate_score(F.col("a"), F.col("b")), 6).alias("score"))


def _hits(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("pair"), (F.col("l_partkey") % 97).alias("start"), F.round("l_extendedprice", 2).alias("score"))


def seq_top_distinct(spark, d):
    return A.top_distinct(_hits(spark, d), 7)


def seq_score_histogram(spark, d):
    return A.score_histogram(_hits(spark, d).withColumn("score", F.col("score") / 500))


def seq_significant(spark, d):
    """Hits with an expected number of at most a thousandth by the fit of their class."""
    fits = spark.createDataFrame([(g, 10.0 + g, 0.1 + g / 100) for g in range(20)], "gc long, mu double, lam double")
    hits = _hits(spark, d).select((F.col("start") % 25).alias("gc"), (F.col("score") / 500).alias("score"))
    return A.significant(hits, fits, 1e-3).groupBy("gc").agg(F.count("*").alias("n"), F.round(F.sum("e"), 9).alias("e"))


def seq_extreme_fit(spark, d):
    """Extreme-value draws fitted by maximum likelihood: location and scale are found within a few percent."""
    u = D.uniform(F.col("id"), 9)
    scores = [r[0] for r in spark.range(4000).select(30 - F.log(-F.log(u)) / 0.25).collect()]
    mu, lam = A.fit_extreme_values(scores)
    return spark.createDataFrame([(abs(mu - 30) < 0.4, abs(lam - 0.25) < 0.02)], "mu boolean, lam boolean")


# --- clusters --------------------------------------------------------------------------------------


def _cells(spark, d):
    """Features of the points of each label and half, in three dimensions."""
    p = points(spark, d, 3).withColumn("id2", F.col("label") * 2 + F.col("id") % 2)
    return C.features(p.select(F.col("id2").alias("id"), "x"), "id", 3)


def cf_overlaps(spark, d):
    return C.overlapping(_cells(spark, d), 3)


def cf_overlap_groups(spark, d):
    from lodestone.operators import graph as G

    cells = _cells(spark, d)
    edges = C.overlapping(cells, 3).select(F.col("id").alias("src"), F.col("other").alias("dst"))
    return G.components(edges, cells.select("id"))


def hop_density_cut(spark, d):
    p = points(spark, d, 3)
    groups, densities = p.select("id", F.col("label").alias("root")), p.select("id", F.col("x")[0].alias("density"))
    return C.density_cut(groups, densities, 0.0).groupBy(F.coalesce("root", F.lit(-1)).alias("root")).agg(F.count("*").alias("n"))


def kd_tree(spark, d):
    return C.kd_leaves(points(spark, d, 3), 4, 3)


def point_kernel(spark, d):
    grid = spark.createDataFrame([(i, [0.1 * i, -0.1 * i, 0.05]) for i in range(5)], "id long, x array<double>")
    return C.point_density(points(spark, d, 3), grid, 0.3, 3).withColumn("density", F.round("density", 6))


def cluster_summaries(spark, d):
    p = points(spark, d, 64).withColumnRenamed("label", "cluster")
    out = C.cluster_summary(p, 64)
    return out.select("cluster", "n", F.round(F.col("center")[5], 6).alias("c5"), F.round("radius", 6).alias("radius"))


def birch_threshold(spark, d):
    """The next threshold lies on the line through the logarithms of what was seen: points as the cube of the threshold."""
    history = [(100 * 2**k, 0.01 * 4 ** (k / 3)) for k in range(4)]
    found = C.next_threshold(history, 100 * 2**6)
    return spark.createDataFrame([(round(found, 9), C.next_threshold([], 5) > 0, C.next_threshold([(10, 0.5)], 20) == 1.0)], "next double, first boolean, doubled boolean")


QUERIES = {f.__name__: f for f in (
    tbl_columns, tbl_exchange_tuples, tbl_partition, tbl_insert_unknowns, tbl_vectors, tbl_search, tbl_merge_runs, tbl_ranks, tbl_median, tbl_apply,
    tbl_shuffle, tbl_hash, tbl_sets, scaling_registry, bitmap_likeness, bitmap_counts_after, item_subsets, next_subsets, pair_graph_order, pair_cliques,
    fn_special, fn_gamma_columns, fn_vectors, fn_densities, fn_line_fit, fn_regression, fn_draws, fn_kernels, svm_normalised, mat_products, mat_solutions,
    txt_posix, txt_edits, txt_dates, seq_subset, seq_identity_filter, seq_concatenate, seq_entropy, seq_covariance, seq_structure_pairs, seq_types,
    seq_digits, seq_degenerate, seq_top_distinct, seq_score_histogram, seq_significant, seq_extreme_fit, cf_overlaps, cf_overlap_groups,
    hop_density_cut, kd_tree, point_kernel, cluster_summaries, birch_threshold,
)}

_CUSTOMERS = "(SELECT c_custkey, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer)"
_P64 = "p AS MATERIALIZED (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS v, unnest(range(64))::INT AS dim FROM embeddings)"
_MATRIX = "m AS MATERIALIZED (SELECT (c_nationkey % 6)::BIGINT AS i, c_custkey % 5 AS j, round(sum(c_acctbal) / 1000, 3) AS v FROM customer GROUP BY 1, 2)"
_SYMBOLS = f"w AS MATERIALIZED {_WINDOWS}, c AS MATERIALIZED (SELECT id, k::INT AS pos, substr(seq, (k + 1)::INT, 1) AS sym FROM w, range(40) r(k))"
_BASES = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in S.STANDS_FOR.items() if k in "ACGTMRWSYKVHDBN") + ") s(code, bases)"
_CELLS = """p AS MATERIALIZED (SELECT label * 2 + vec_id % 2 AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings),
f AS MATERIALIZED (SELECT id, avg(a) AS a, avg(b) AS b, avg(c) AS c, CASE WHEN count(*) <= 1 THEN 0 ELSE sqrt(greatest(avg(a * a + b * b + c * c) - avg(a) ** 2 - avg(b) ** 2 - avg(c) ** 2, 0)) END AS r FROM p GROUP BY id),
o AS MATERIALIZED (SELECT x.id AS id, y.id AS other FROM f x JOIN f y ON x.id < y.id AND sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2) <= x.r + y.r)"""


def _kd_sql() -> str:
    out = ["l0 AS (SELECT vec_id AS id, 1::BIGINT AS leaf, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS x1, embedding[3]::DOUBLE AS x2 FROM embeddings)"]
    for k in range(4):
        out.append(f"l{k + 1} AS (SELECT id, leaf * 2 + (x{k % 3} > quantile_disc(x{k % 3}, 0.5) OVER (PARTITION BY leaf))::BIGINT AS leaf, x0, x1, x2 FROM l{k})")
    return f"WITH {', '.join(out)} SELECT id, leaf FROM l4"


def _kernel_sql() -> str:
    dot, square = "sum(x.m * y.m)", "sum((x.m - y.m) ** 2)"
    forms = {"linear": dot, "poly": f"(0.5 * {dot} + 1) ** 2", "rbf": f"exp(-0.5 * {square})", "sigmoid": f"(exp(2 * (0.5 * {dot} + 1)) - 1) / (exp(2 * (0.5 * {dot} + 1)) + 1)"}
    parts = [f"SELECT '{k}' AS kind, x.label::BIGINT AS a, y.label::BIGINT AS b, round({e}, 6) AS value FROM m x JOIN m y ON x.dim = y.dim AND x.label <= y.label GROUP BY 2, 3" for k, e in forms.items()]
    return f"WITH {_P64}, m AS (SELECT label, dim, avg(v) AS m FROM p WHERE dim < 8 GROUP BY 1, 2) " + " UNION ALL ".join(parts)


ORACLES = {
    "tbl_columns": f"SELECT c_mktsegment AS p0, c_acctbal AS p1, c_nationkey AS p2, c_custkey AS p3, 'c_mktsegment' AS text, 'c_acctbal,c_nationkey,|,c_mktsegment,c_custkey' AS cut FROM {_CUSTOMERS}",
    "tbl_exchange_tuples": """WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer)
SELECT c_custkey, CASE WHEN r BETWEEN 3 AND 7 THEN r + 17 WHEN r BETWEEN 20 AND 24 THEN r - 17 ELSE r END AS place FROM n WHERE r NOT BETWEEN 50 AND 59""",
    "tbl_partition": "SELECT count(*) FILTER (nullif(c_nationkey, 3) > 10) AS yes, count(*) FILTER (coalesce(nullif(c_nationkey, 3) <= 10, true)) AS no FROM customer",
    "tbl_insert_unknowns": "SELECT true AS l_quantity, true AS l_tax, true AS l_partkey, true AS same",
    "tbl_vectors": f"SELECT c_custkey, 2.0 * c_custkey + 1 AS a, round(0.5 - c_acctbal, 2) AS b, c_nationkey::DOUBLE AS c, true AS unknown FROM {_CUSTOMERS}",
    "tbl_search": "SELECT CASE WHEN count(*) FILTER (c_nationkey = v) > 0 THEN count(*) FILTER (c_nationkey < v) ELSE -1 END AS first, count(*) FILTER (c_nationkey = v) AS n, v::INT AS value FROM customer, (VALUES (0), (7), (24), (99)) t(v) GROUP BY v",
    "tbl_merge_runs": """WITH u AS (SELECT round(c_acctbal, 2) AS balance, c_name AS name FROM customer UNION ALL SELECT round(s_acctbal, 2), s_name FROM supplier),
n AS (SELECT *, row_number() OVER (ORDER BY balance, name) - 1 AS place FROM u) SELECT * FROM n WHERE place % 100 = 0""",
    "tbl_ranks": """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS rank, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer)
SELECT a.c_custkey, a.rank, b.c_custkey AS index FROM r a JOIN r b ON b.rank = a.place""",
    "tbl_median": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS median FROM lineitem GROUP BY 1",
    "tbl_apply": f"SELECT c_custkey, c_nationkey, round(c_acctbal * 2, 2) AS c_acctbal, lower(c_mktsegment) AS c_mktsegment FROM {_CUSTOMERS}",
    "tbl_shuffle": "SELECT count(*) AS n, sum(c_custkey)::BIGINT AS total, true AS same, false AS other, false AS sorted FROM customer",
    "tbl_hash": "SELECT count(DISTINCT (l_returnflag, l_linestatus, l_quantity)) AS tuples, count(DISTINCT (l_returnflag, l_linestatus, l_quantity)) AS hashes FROM lineitem",
    "tbl_sets": """WITH s AS (SELECT c_nationkey AS k, list_sort(list_distinct(list(c_mktsegment))) AS s FROM customer GROUP BY 1),
t AS (SELECT k, list_filter(s, lambda v, i: (i - 1 + k) % 3 <> 0) AS s FROM s), j AS (SELECT a.k, a.s AS a, b.s AS b FROM t a JOIN t b ON b.k - 1 = a.k)
SELECT k, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either, array_to_string(list_sort(list_intersect(a, b)), ',') AS both,
len(list_filter(a, lambda v: NOT list_contains(b, v))) = 0 AS inside FROM j""",
    "scaling_registry": """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_linenumber = 1)
SELECT l_orderkey, round((l_quantity - mq) / sq, 6) AS z, round((l_tax - mt) / st, 6) AS t, round(l_quantity, 6) AS back, round((l_quantity - (lo + hi) / 2) / (hi - lo), 6) AS ranged FROM lineitem, s WHERE l_linenumber = 1""",
    "bitmap_likeness": f"""WITH i AS MATERIALIZED {_ITEMS}, n AS (SELECT max(tid) + 1 AS t FROM i), s AS (SELECT item, count(*)::DOUBLE AS n FROM i GROUP BY 1),
q AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM i x JOIN i y ON x.tid = y.tid AND x.item < y.item GROUP BY 1, 2)
SELECT a, b, q.n, q.n = least(u.n, v.n) AS contained, round(q.n / sqrt(u.n * v.n), 9) AS cosine, round((t * q.n - u.n * v.n) / sqrt(u.n * (t - u.n) * v.n * (t - v.n)), 9) AS correlation
FROM q JOIN s u ON u.item = a JOIN s v ON v.item = b, n""",
    "bitmap_counts_after": f"""SELECT item AS key, count(*) FILTER (tid > 1000) AS n, 'item' AS kind FROM {_ITEMS} GROUP BY 1
UNION ALL SELECT g, count(DISTINCT tid) FILTER (tid > 1000), 'union' FROM (SELECT item % 4 AS g, tid FROM {_ITEMS}) GROUP BY 1""",
    "item_subsets": f"""WITH i AS MATERIALIZED {_ITEMS}, k AS (SELECT tid FROM i GROUP BY tid HAVING count(*) <= 6), j AS (SELECT tid, lpad(item::VARCHAR, 2, '0') AS item FROM i JOIN k USING (tid))
SELECT a.item || ',' || b.item || ',' || c.item AS items, count(*) AS n FROM j a JOIN j b ON a.tid = b.tid AND a.item < b.item JOIN j c ON c.tid = b.tid AND b.item < c.item GROUP BY 1""",
    "next_subsets": "SELECT a.x AS a, b.x AS b, c.x AS c FROM range(6) a(x) JOIN range(6) b(x) ON a.x < b.x JOIN range(6) c(x) ON b.x < c.x",
    "pair_graph_order": f"""WITH i AS MATERIALIZED {_ITEMS}, q AS (SELECT x.item AS a, y.item AS b FROM i x JOIN i y ON x.tid = y.tid AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 10),
e AS (SELECT item, count(*) AS neighbours FROM (SELECT a AS item FROM q UNION ALL SELECT b FROM q) GROUP BY 1), s AS (SELECT item, count(*) AS support FROM i GROUP BY 1)
SELECT item, support, neighbours, row_number() OVER (ORDER BY support, item) - 1 AS place FROM s JOIN e USING (item)""",
    "pair_cliques": """WITH i AS MATERIALIZED (SELECT DISTINCT l_orderkey AS tid, (l_partkey % 7) AS item FROM lineitem), n AS (SELECT count(DISTINCT tid) // 6 AS n FROM i),
q AS MATERIALIZED (SELECT x.item AS a, y.item AS b FROM i x JOIN i y ON x.tid = y.tid AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= (SELECT n FROM n)),
m AS (SELECT s AS mask FROM range(1, 128) r(s)), b AS (SELECT mask, k FROM m, range(7) t(k) WHERE (mask >> k::INT) & 1 = 1),
bad AS (SELECT DISTINCT x.mask FROM b x JOIN b y ON x.mask = y.mask AND x.k < y.k LEFT JOIN q ON a = x.k AND q.b = y.k WHERE q.a IS NULL),
g AS (SELECT mask FROM m WHERE bit_count(mask) >= 2 AND mask NOT IN (SELECT mask FROM bad)),
x AS (SELECT mask FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.mask <> g.mask AND (h.mask & g.mask) = g.mask))
SELECT string_agg(k::VARCHAR, ',' ORDER BY k) AS members FROM b JOIN x USING (mask) GROUP BY mask""",
    "fn_special": """SELECT name, round(value, 6) AS value FROM (VALUES ('chi2 0.05 of 2', -2 * ln(0.05)), ('normal 0.975', 1.959963984540054), ('zeta 2', pi() ** 2 / 6), ('zeta 4', pi() ** 4 / 90),
('choose 50 6', 15890700.0), ('incomplete gamma 1 2', 1 - exp(-2)), ('incomplete gamma 3 1', 1 - exp(-1) * 2.5), ('beta 3 4', 1 / 60), ('gamma rates mean', 1.0), ('root', 2 ** (1 / 3)),
('minimum', 1.25), ('chebyshev', exp(1.3)), ('laguerre 0', 1.0), ('laguerre 3', 6.0), ('laguerre 9', 362880.0)) t(name, value)""",
    "fn_gamma_columns": "SELECT n_nationkey, round(lgamma(n_nationkey / 2 + 1), 6) AS lgamma, round(gamma(n_nationkey / 2 + 1) / gamma(n_nationkey / 2 + 0.5), 6) AS ratio FROM nation",
    "fn_vectors": """WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)
SELECT id, round(list_sum(list_transform(x, lambda v: v * v)), 6) AS square, round(abs(x[1] - x[4]) + abs(x[2] - x[5]) + abs(x[3] - x[6]), 6) AS manhattan,
round((x[1] - x[4]) ** 2 + (x[2] - x[5]) ** 2 + (x[3] - x[6]) ** 2, 6) AS distance, round(x[1] * x[5] - x[2] * x[4], 6) AS cross,
round(ln(list_sum(list_transform(x, lambda v: exp(v)))), 6) AS lse, (list_position(x, list_max(x)) - 1)::INT AS argmax FROM e""",
    "fn_densities": """SELECT l_orderkey, round(0.8 * exp(-0.8 * (x - 2) - exp(-0.8 * (x - 2))), 9) AS density, round(exp(-exp(-0.8 * (x - 2))), 9) AS cdf,
round(1 - exp(-exp(-0.8 * (x - 2))), 9) AS p, round(exp(-((x - 3) ** 2) / 4) / sqrt(4 * pi()), 9) AS normal FROM (SELECT l_orderkey, l_extendedprice / 10000 AS x FROM lineitem WHERE l_linenumber = 1)""",
    "fn_line_fit": """SELECT 'plain' AS kind, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_extendedprice, l_quantity), 4) AS correlation FROM lineitem
UNION ALL SELECT 'weighted', round(regr_slope(y, x), 4), round(regr_intercept(y, x), 4), round(corr(y, x), 4) FROM (SELECT l_extendedprice AS y, l_quantity AS x, unnest(range(l_linenumber)) FROM lineitem)""",
    "fn_regression": """WITH s AS (SELECT avg(l_quantity) AS m1, avg(l_tax) AS m2, avg(l_extendedprice) AS my, covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_tax) AS b, covar_pop(l_tax, l_tax) AS c,
covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_tax, l_extendedprice) AS q FROM lineitem), t AS (SELECT *, (c * p - b * q) / (a * c - b * b) AS b1, (a * q - b * p) / (a * c - b * b) AS b2 FROM s)
SELECT i::INT AS i, round(CASE i WHEN 0 THEN my - b1 * m1 - b2 * m2 WHEN 1 THEN b1 ELSE b2 END, 3) AS value FROM t, range(3) r(i)""",
    "fn_draws": "SELECT name, true AS mean, true AS deviation FROM (VALUES ('uniform'), ('exponential'), ('normal'), ('lognormal'), ('gamma'), ('beta'), ('hyperexponential'), ('choose')) t(name)",
    "fn_kernels": _kernel_sql(),
    "svm_normalised": f"""WITH {_P64}, r AS (SELECT id, dim, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS v FROM p WINDOW w AS (PARTITION BY id)),
f AS (SELECT dim, atan((v - avg(v) OVER w) / stddev_samp(v) OVER w) AS v FROM r WINDOW w AS (PARTITION BY dim))
SELECT dim AS feature, count(*) AS n, round(sum(abs(v)), 4) AS size, round(max(v), 6) AS most FROM f GROUP BY 1""",
    "mat_products": f"""WITH {_MATRIX}, g AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.j = b.j GROUP BY 1, 2), u AS (SELECT 'gram' AS kind, i, j, v FROM g UNION ALL SELECT 'diagonal', i, i, v FROM g WHERE i = j
UNION ALL SELECT 'sum', i, j, 3 * v FROM m UNION ALL SELECT 'vector', i, 0, sum(v * (j + 1)) FROM m GROUP BY i UNION ALL SELECT 'swapped', CASE i WHEN 0 THEN 3 WHEN 3 THEN 0 ELSE i END, j, -v FROM m)
SELECT kind, i, j, round(v, 4) AS v FROM u""",
    "mat_solutions": """WITH r AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 10 AS c FROM lineitem), s AS (SELECT avg(a * a) AS aa, avg(a * b) AS ab, avg(a * c) AS ac, avg(b * b) AS bb, avg(b * c) AS bc, avg(c * c) AS cc FROM r)
SELECT 'determinant' AS name, round(aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac), 8) AS value FROM s UNION ALL SELECT 'trace', round(aa + bb + cc, 8) FROM s
UNION ALL SELECT name, 0.0 FROM (VALUES ('inverse'), ('solution'), ('lu'), ('cholesky'), ('eigen')) t(name)""",
    "txt_posix": """WITH f AS (SELECT doc_id, regexp_extract_all(text, '[[:upper:]][[:lower:]]{2,}[[:blank:]][[:digit:]]+') AS f FROM documents) SELECT doc_id, len(f)::INT AS n, coalesce(f[1], '') AS first FROM f""",
    "txt_edits": """SELECT c_custkey, c_name AS chopped, substr(c_name, 1, 3) || '--' || substr(c_name, 4) AS inserted, substr(c_name, 1, 2) || substr(c_name, 7) AS deleted,
array_to_string(list_filter(regexp_split_to_array(c_name, '[#0]+'), lambda t: t <> ''), '|') AS tokens, true AS blank FROM customer""",
    "txt_dates": """SELECT o_orderkey, epoch(date_trunc('day', o_orderdate))::BIGINT AS a, epoch(date_trunc('day', o_orderdate))::BIGINT AS b,
CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE epoch(date_trunc('second', o_orderdate))::BIGINT END AS c FROM orders""",
    "seq_subset": f"SELECT id, substr(seq, 1, 1) || substr(seq, 4, 1) || substr(seq, 5, 1) || substr(seq, 40, 1) AS seq FROM {_WINDOWS} WHERE id % 16 = 0",
    "seq_identity_filter": f"""WITH RECURSIVE {_SYMBOLS.replace(' AND doc_id % 8 = 0', '')}, l AS (SELECT id, count(*) AS n FROM c WHERE sym <> '-' GROUP BY id),
q AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM c x JOIN c y ON x.pos = y.pos AND x.id < y.id JOIN l p ON p.id = x.id JOIN l s ON s.id = y.id
GROUP BY x.id, y.id HAVING count(*) FILTER (x.sym = y.sym AND x.sym <> '-') / least(any_value(p.n), any_value(s.n)) > 0.5),
n AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS k, coalesce((SELECT list(a) FROM q WHERE b = w.id), []) AS near FROM w),
r(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.k, CASE WHEN len(list_intersect(n.near, kept)) > 0 THEN kept ELSE list_append(kept, n.id) END FROM r JOIN n ON n.k = r.k + 1)
SELECT unnest(kept) AS id FROM r WHERE k = (SELECT max(k) FROM r)""",
    "seq_concatenate": f"SELECT id, seq || reverse(seq) AS seq FROM {_WINDOWS}",
    "seq_entropy": f"""WITH {_SYMBOLS}, n AS (SELECT pos, sym, count(*) AS n FROM c WHERE sym <> '-' GROUP BY 1, 2), t AS (SELECT pos, n / sum(n) OVER (PARTITION BY pos) AS f FROM n)
SELECT pos, round(-sum(f * log2(f)), 6) AS entropy FROM t GROUP BY pos""",
    "seq_covariance": f"""WITH {_SYMBOLS}, b AS (SELECT x.pos AS i, y.pos AS j, x.sym AS x, y.sym AS y, count(*) AS n FROM c x JOIN c y ON x.id = y.id AND y.pos = 39 - x.pos AND x.pos < 20 AND x.sym <> '-' AND y.sym <> '-' GROUP BY ALL),
t AS (SELECT i, j, n / sum(n) OVER w * log2(n * sum(n) OVER w / (sum(n) OVER (PARTITION BY i, x) * sum(n) OVER (PARTITION BY i, y))) AS t FROM b WINDOW w AS (PARTITION BY i))
SELECT i, j, round(sum(t), 6) AS covariance FROM t GROUP BY 1, 2""",
    "seq_structure_pairs": """WITH n AS (SELECT n_nationkey::BIGINT AS id, n_nationkey % 7 + 1 AS n FROM nation WHERE n_nationkey <> 3) SELECT id, k AS i, 2 * n + 2 - k AS j FROM n, range(7) r(k) WHERE k < n
UNION ALL SELECT id, 2 * n + 4, 2 * n + 5 FROM n""",
    "seq_types": f"""WITH w AS {_WINDOWS}, t AS (SELECT id, replace(seq, '-', '') AS s FROM w) SELECT id, 0 AS k, CASE WHEN s = '' THEN 'other' ELSE 'dna' END AS type FROM t UNION ALL SELECT id, 1, CASE WHEN s = '' THEN 'other' WHEN s LIKE '%T%' THEN 'rna' ELSE 'dna' END FROM t
UNION ALL SELECT id, 2, 'protein' FROM t UNION ALL SELECT id, 3, 'other' FROM t""",
    "seq_digits": f"""WITH {_SYMBOLS}, n AS (SELECT id, sum(instr('{S.CODES}', sym) - 1)::INT AS digits, (sum((pos % 57 + 1) * ascii(sym)) % 10000)::INT AS checksum FROM c GROUP BY id)
SELECT id, digits, checksum, replace(seq, 'G', 'N') AS cleaned, replace(seq, '-', '') AS plain FROM n JOIN w USING (id)""",
    "seq_degenerate": f"SELECT code AS a, base AS b, round(CASE WHEN contains(bases, base) THEN (1 - (length(bases) - 1)) / length(bases) ELSE -1 END, 6) AS score FROM {_BASES}, (VALUES ('A'), ('C'), ('G'), ('T')) t(base)",
    "seq_top_distinct": """WITH b AS (SELECT l_suppkey % 5 AS pair, l_partkey % 97 AS start, max(round(l_extendedprice, 2)) AS score FROM lineitem GROUP BY 1, 2)
SELECT pair, start, score, row_number() OVER (PARTITION BY pair ORDER BY score DESC, start)::INT AS rank FROM b QUALIFY rank <= 7""",
    "seq_score_histogram": "SELECT floor(round(l_extendedprice, 2) / 500)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1",
    "seq_significant": """WITH h AS (SELECT l_partkey % 97 % 25 AS gc, round(l_extendedprice, 2) / 500 AS score FROM lineitem), e AS (SELECT gc, exp(-(0.1 + gc / 100) * (score - 10 - gc)) AS e FROM h WHERE gc < 20)
SELECT gc, count(*) AS n, round(sum(e), 9) AS e FROM e WHERE e <= 1e-3 GROUP BY gc""",
    "seq_extreme_fit": "SELECT true AS mu, true AS lam",
    "cf_overlaps": f"WITH {_CELLS} SELECT id, other FROM o",
    "cf_overlap_groups": f"""WITH RECURSIVE {_CELLS}, e AS MATERIALIZED (SELECT id AS s, other AS t FROM o UNION SELECT other, id FROM o), r(node, other) AS (SELECT id, id FROM f UNION SELECT r.node, e.t FROM r JOIN e ON r.other = e.s)
SELECT node, min(other) AS component FROM r GROUP BY node""",
    "hop_density_cut": "SELECT CASE WHEN embedding[1] >= 0 THEN label ELSE -1 END AS root, count(*) AS n FROM embeddings GROUP BY 1",
    "kd_tree": _kd_sql(),
    "point_kernel": """WITH g AS (SELECT i AS id, 0.1 * i AS a, -0.1 * i AS b, 0.05 AS c FROM range(5) r(i))
SELECT id, round(avg(exp(-((embedding[1]::DOUBLE - a) ** 2 + (embedding[2]::DOUBLE - b) ** 2 + (embedding[3]::DOUBLE - c) ** 2) / 0.18)) / (0.18 * pi()) ** 1.5, 6) AS density FROM embeddings, g GROUP BY id""",
    "cluster_summaries": f"""WITH {_P64}, m AS (SELECT label, dim, avg(v) AS m, sum(v * v) AS q, count(*) AS n FROM p GROUP BY 1, 2)
SELECT label AS cluster, max(n) AS n, round(max(m) FILTER (dim = 5), 6) AS c5, round(sqrt(sum(q) / max(n) - sum(m * m)), 6) AS radius FROM m GROUP BY 1""",
    "birch_threshold": "SELECT round(0.01 * 4.0 ** (6 / 3), 9) AS next, true AS first, true AS doubled",
}
