"""Registered queries of classification and feature ranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import classify as K
from lodestone.operators import machines as S
from lodestone.operators import table as T

from .data import points, table

NUMERIC = ("l_quantity", "l_discount", "l_tax")


def _lines(spark, d):
    rid = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select(rid.alias("rid"), F.col("l_returnflag").alias("class"), "l_linestatus", *NUMERIC, (F.col("l_orderkey") % 8).alias("ship"))


def tree_root_gini(spark, d):
    rows = _lines(spark, d).withColumn("node", F.lit(1))
    out = [K.best_splits(rows, [a], ["A", "N", "R"]) for a in NUMERIC]
    out = out[0].union(out[1]).union(out[2])
    return out.select("attr", "cut", F.round("gini", 9).alias("gini"))


def tree_level_split(spark, d):
    rows = _lines(spark, d).withColumn("node", F.when(F.col("l_quantity") <= 25, F.lit(2)).otherwise(F.lit(3)))
    return K.best_splits(rows, ["l_tax"], ["A", "N", "R"]).select("node", "cut", F.round("gini", 9).alias("gini"))


def tree_grow(spark, d):
    rows = points(spark, d, 3).select("id", F.col("label").alias("class"), *[F.col("x")[i].alias(f"x{i}") for i in range(3)])
    nodes, _ = K.grow_tree(rows, ["x0", "x1", "x2"], max_depth=3)
    return spark.createDataFrame([(n["node"], n["depth"], n["attr"] or "", sum(n["counts"].values())) for n in nodes], "node long, depth int, attr string, n long")


def nb_model_counts(spark, d):
    return K.symbol_counts(_lines(spark, d), ["l_linestatus", "ship"])


def nb_model_gauss(spark, d):
    return K.gaussians(_lines(spark, d), NUMERIC).withColumns({c: F.round(c, 8) for c in ("mean", "variance")})


def _classified(spark, d):
    rows = _lines(spark, d)
    return K.classify(rows, K.naive_bayes(rows, ["l_linestatus", "ship"], ["l_quantity", "l_tax"]))


def nb_classify(spark, d):
    return _classified(spark, d).groupBy("class", "predicted").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def bayes_error_rate(spark, d):
    return K.error_rate(_classified(spark, d)).withColumn("percent", F.round("percent", 6))


def full_bayes(spark, d):
    rows = points(spark, d, 3).select("id", F.col("label").alias("class"), *[F.col("x")[i].alias(f"x{i}") for i in range(3)])
    names = ["x0", "x1", "x2"]
    judged = K.classify_full(rows, K.full_bayes(rows, names), names)
    return judged.groupBy("class", "predicted").agg(F.count("*").alias("n"))


def nb_generate(spark, d):
    """Rows drawn from a naive Bayes model: shares of classes and symbols, and means of numbers, are those of the model within bounds."""
    rows = _lines(spark, d)
    drawn = K.generate(spark, K.naive_bayes(rows, ["l_linestatus"], ["l_quantity"]), 20000, seed=3)
    sums = lambda df: df.groupBy("class").agg(F.count("*").alias("n"), F.avg((F.col("l_linestatus") == "F").cast("double")).alias("f"), F.avg("l_quantity").alias("q"))
    want, found, total = sums(rows), sums(drawn), rows.count()
    both = want.join(found.select("class", F.col("n").alias("gn"), F.col("f").alias("gf"), F.col("q").alias("gq")), "class")
    return both.select("class", (F.abs(F.col("gn") / 20000 - F.col("n") / total) < 0.02).alias("share"), (F.abs(F.col("gf") - F.col("f")) < 0.03).alias("symbols"), (F.abs(F.col("gq") - F.col("q")) < 1.0).alias("means"))


def nb_cross_validation(spark, d):
    rows = T.folds(_lines(spark, d), 3, ["rid"], stratify="class")
    return K.cross_validate(rows, 3, ["l_linestatus"], ["l_quantity"])


def svm_feature_score(spark, d):
    e = table(spark, d, "embeddings")
    long = e.select(F.col("vec_id").alias("rid"), F.col("label").cast("double").alias("y"), F.posexplode("embedding").alias("feature", "x"))
    scored = K.feature_scores(long.withColumn("x", F.col("x").cast("double")))
    return scored.select("feature", F.round(F.col("score") * 1000, 6).alias("score"))


def svm_rfe(spark, d):
    """Features of every label against the next one: each pair of labels is one training problem."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sides = F.array(F.struct(F.col("label").alias("group"), F.lit(1.0).alias("y")), F.struct(((F.col("label") + 9) % 10).alias("group"), F.lit(-1.0).alias("y")))
    cases = table(spark, d, "embeddings").select(x.alias("x"), F.inline(sides))
    return K.rank_features(cases.select(F.col("group").cast("long").alias("group"), "y", "x"), step=4)


def _means(spark, d):
    """(vectors, labels): the mean embedding of each label and quarter of the rows, forty cases from the whole table."""
    p = points(spark, d, 64).withColumn("part", F.col("id") % 4)
    rows = p.groupBy("label", "part").agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(64)]).orderBy("label", "part").collect()
    return np.array([[r[f"m{i}"] for i in range(64)] for r in rows]), np.array([float(r.label) for r in rows])


def svm_machines(spark, d):
    """Machines of all kinds on the mean vectors: the conditions of optimality hold, and what nu bounds is bounded."""
    x, label = _means(spark, d)
    gram, y, rows = S.kernel("linear", x, x), np.where(label >= 5, 1.0, -1.0), []
    for kind, target in (("c_svc", y), ("one_class", y), ("epsilon_svr", label)):
        coef, rho = S.train(kind, gram, target, c=2.0, nu=0.4, eps=1e-6)
        rows.append((kind, S.optimality_gap(kind, gram, target, coef, rho, c=2.0) < 1e-3))
    for kind, target in (("nu_svc", y), ("nu_svr", label)):
        coef, rho = S.train(kind, gram, target, c=2.0, nu=0.4, eps=1e-6)
        used = (np.abs(coef) > 1e-9).mean()
        most = np.abs(coef).max()
        bound = (np.abs(coef) > most - 1e-9).mean() if kind == "nu_svc" else (np.abs(coef) > 2.0 - 1e-9).mean()
        rows.append((kind, bool(used >= 0.4 - 1e-9 and (kind == "nu_svc" or bound <= 0.4 + 1e-9))))
    return spark.createDataFrame([(k, bool(ok)) for k, ok in rows], "kind string, ok boolean")


def svm_saved(spark, d):
    """Machines written as text and read again give the same values, for two classes, ten, one, and numbers."""
    x, label = _means(spark, d)
    rows = []
    for kind, target in (("c_svc", label), ("nu_svc", np.where(label >= 5, 1.0, -1.0)), ("one_class", label), ("epsilon_svr", label), ("nu_svr", label)):
        machine = S.fit(kind, x, target, "rbf", nu=0.3, gamma=0.5)
        again = S.Machine.load(machine.save(), 64)
        rows.append((kind, bool(np.allclose(machine.values(x), again.values(x), atol=1e-9) and (machine.predict(x) == again.predict(x)).all()), len(machine.labels)))
    return spark.createDataFrame(rows, "kind string, same boolean, classes int")


def svm_cross_validation(spark, d):
    """Four folds of the mean vectors, one quarter each: ten cases are judged by a machine of the others, and a wrong label of two is four squares."""
    x, label = _means(spark, d)
    cases = spark.createDataFrame([(i % 4, 1.0 if v >= 5 else -1.0, [float(c) for c in r]) for i, (v, r) in enumerate(zip(label, x))], "fold int, y double, x array<double>")
    judged = S.cross_validate(cases, 4, "c_svc", c=10.0)
    return judged.select("fold", "n", (F.abs(F.col("squares") - 4 * (F.col("n") - F.col("right"))) < 1e-9).alias("good"))


def svm_rfe_nu(spark, d):
    """Ranks by nu-SVC: each group's are the numbers from 1 to the features."""
    x, label = _means(spark, d)
    cases = [(g, 1.0 if label[i] == g else -1.0, [float(v) for v in x[i]]) for g in range(3) for i in range(len(x))]
    ranked = S.rank_features(spark.createDataFrame(cases, "group long, y double, x array<double>"), nu=0.1, step=4)
    return ranked.groupBy("group").agg(F.count("*").alias("n"), F.countDistinct("feature").alias("features"), F.min("rank").alias("first"), F.max("rank").alias("last"))


def cart_root(spark, d):
    rows = _lines(spark, d).withColumn("node", F.lit(1)).join(table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rid"), "l_extendedprice").groupBy("rid").agg(F.max("l_extendedprice").alias("price")), "rid")
    return K.regression_splits(rows, ["l_discount", "l_quantity", "l_tax"], "price").select("node", "attr", "cut", F.round(F.col("error") / 1e6, 4).alias("error"))


QUERIES = {f.__name__: f for f in (
    tree_root_gini, tree_level_split, tree_grow, nb_model_counts, nb_model_gauss, nb_classify, bayes_error_rate, full_bayes, nb_generate,
    nb_cross_validation, svm_feature_score, svm_rfe, svm_machines, svm_saved, svm_cross_validation, svm_rfe_nu, cart_root,
)}

_L = "l AS MATERIALIZED (SELECT row_number() OVER () AS rid, l_returnflag AS class, l_linestatus, l_quantity, l_discount, l_tax, l_orderkey % 8 AS ship FROM lineitem)"


def _gini(select, nodes, attributes):
    long = " UNION ALL ".join(f"SELECT {nodes} AS node, '{a}' AS attr, {a} AS val, class FROM l" for a in attributes)
    side = lambda p: " + ".join(f"({p.format(c)}) * ({p.format(c)})" for c in "anr")
    return f"""WITH {_L}, u AS ({long}),
v AS (SELECT node, attr, val, count(*) FILTER (class = 'A') AS a, count(*) FILTER (class = 'N') AS n, count(*) FILTER (class = 'R') AS r FROM u GROUP BY ALL),
s AS (SELECT node, attr, val, sum(a) OVER w AS ba, sum(n) OVER w AS bn, sum(r) OVER w AS br, sum(a) OVER z AS ta, sum(n) OVER z AS tn, sum(r) OVER z AS tr FROM v
WINDOW w AS (PARTITION BY node, attr ORDER BY val), z AS (PARTITION BY node, attr)),
g AS (SELECT node, attr, val, 1 - ((({side("(t{0} - b{0})::DOUBLE")}) / (ta + tn + tr - ba - bn - br)) + (({side("b{0}::DOUBLE")}) / (ba + bn + br))) / (ta + tn + tr) AS gini
FROM s WHERE ta + tn + tr > ba + bn + br)
SELECT {select} FROM g QUALIFY row_number() OVER (PARTITION BY node, attr ORDER BY round(gini, 12), val) = 1"""


_NB = f"""WITH {_L}, k AS (SELECT class, count(*) AS n FROM l GROUP BY class), t AS (SELECT count(*) AS t FROM l),
s AS (SELECT class, l_linestatus AS v, count(*) AS m FROM l GROUP BY ALL), h AS (SELECT class, ship AS v, count(*) AS m FROM l GROUP BY ALL),
q AS (SELECT class, avg(l_quantity) AS m1, var_samp(l_quantity) AS v1, avg(l_tax) AS m2, var_samp(l_tax) AS v2 FROM l GROUP BY class),
p AS (SELECT rid, l.class AS class, k.class AS c, ln(k.n / t) + ln(coalesce(s.m / k.n, 1e-300)) + ln(coalesce(h.m / k.n, 1e-300))
- 0.5 * (ln(2 * pi() * v1) + pow(l_quantity - m1, 2) / v1) - 0.5 * (ln(2 * pi() * v2) + pow(l_tax - m2, 2) / v2) AS lp
FROM l CROSS JOIN k CROSS JOIN t JOIN q ON q.class = k.class LEFT JOIN s ON s.class = k.class AND s.v = l_linestatus LEFT JOIN h ON h.class = k.class AND h.v = ship),
x AS (SELECT rid, class, c AS predicted, 1 / sum(exp(lp - mx)) OVER (PARTITION BY rid) AS confidence, lp FROM (SELECT *, max(lp) OVER (PARTITION BY rid) AS mx FROM p)
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY lp DESC, c) = 1)"""

def _full_bayes_sql() -> str:
    """The quadratic form by the adjugate of each class's covariance matrix."""
    cov = {(i, j): f"c{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)}
    minor = lambda i, j: "({} * {} - {} * {})".format(*(cov[a, b] for a, b in zip(
        ((i + 1) % 3, (i + 2) % 3, (i + 1) % 3, (i + 2) % 3), ((j + 1) % 3, (j + 2) % 3, (j + 2) % 3, (j + 1) % 3))))
    det = " + ".join(f"{cov[0, j]} * {minor(0, j)}" for j in range(3))
    quadratic = " + ".join(f"(x{i} - m{i}) * (x{j} - m{j}) * {minor(i, j)}" for i in range(3) for j in range(3))
    sums = ", ".join([f"avg(x{i}) AS m{i}" for i in range(3)] + [f"covar_samp(x{i}, x{j}) AS c{i}{j}" for i in range(3) for j in range(i, 3)])
    return f"""WITH r AS MATERIALIZED (SELECT vec_id AS id, label AS class, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS x1, embedding[3]::DOUBLE AS x2 FROM embeddings),
k AS (SELECT class AS c, count(*) AS n, {sums} FROM r GROUP BY class), t AS (SELECT *, {det} AS det FROM k),
s AS (SELECT id, class, c, ln(n) - 0.5 * ln(det) - 0.5 * ({quadratic}) / det AS s FROM r, t), p AS (SELECT class, c AS predicted FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, c) = 1)
SELECT class, predicted, count(*) AS n FROM p GROUP BY 1, 2"""


ORACLES = {
    "tree_root_gini": _gini("attr, val AS cut, round(gini, 9) AS gini", "1", NUMERIC),
    "tree_level_split": _gini("node, val AS cut, round(gini, 9) AS gini", "CASE WHEN l_quantity <= 25 THEN 2 ELSE 3 END", ("l_tax",)),
    "nb_model_counts": f"WITH {_L} SELECT 'l_linestatus' AS attr, l_linestatus AS val, class, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT 'ship', ship::VARCHAR, class, count(*) FROM l GROUP BY ALL",
    "nb_model_gauss": f"WITH {_L} " + " UNION ALL ".join(f"SELECT '{a}' AS attr, class, count({a}) AS n, round(avg({a}), 8) AS mean, round(var_samp({a}), 8) AS variance FROM l GROUP BY class" for a in NUMERIC),
    "nb_classify": f"{_NB} SELECT class, predicted, count(*) AS n, round(avg(confidence), 6) AS confidence FROM x GROUP BY ALL",
    "bayes_error_rate": f"{_NB} SELECT count(*) FILTER (class <> predicted) AS errors, round(100 * count(*) FILTER (class <> predicted) / count(*), 6) AS percent FROM x",
    "svm_feature_score": """WITH e AS (SELECT vec_id, label::DOUBLE AS y, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS feature FROM embeddings),
m AS (SELECT *, x - avg(x) OVER (PARTITION BY feature) AS dx, y - avg(y) OVER (PARTITION BY feature) AS dy FROM e)
SELECT feature::INT AS feature, round(1000 * sum(dx * dy) / (sum(dx * dx) * sum(dy * dy)), 6) AS score FROM m GROUP BY feature""",
    "full_bayes": _full_bayes_sql(),
    "svm_machines": "SELECT kind, true AS ok FROM (VALUES ('c_svc'), ('one_class'), ('epsilon_svr'), ('nu_svc'), ('nu_svr')) t(kind)",
    "svm_saved": "SELECT kind, true AS same, classes FROM (VALUES ('c_svc', 10), ('nu_svc', 2), ('one_class', 0), ('epsilon_svr', 0), ('nu_svr', 0)) t(kind, classes)",
    "svm_cross_validation": "SELECT fold::INT AS fold, 10 AS n, true AS good FROM range(4) r(fold)",
    "svm_rfe_nu": 'SELECT g AS "group", 64 AS n, 64 AS features, 1 AS first, 64 AS last FROM range(3) r(g)',
    "cart_root": """WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS rid, max(l_extendedprice) AS price FROM lineitem GROUP BY 1), r AS (SELECT l_quantity, l_discount, l_tax, price FROM lineitem JOIN p ON rid = l_orderkey * 10 + l_linenumber),
u AS (SELECT 'l_discount' AS attr, l_discount AS val, price FROM r UNION ALL SELECT 'l_quantity', l_quantity, price FROM r UNION ALL SELECT 'l_tax', l_tax, price FROM r),
v AS (SELECT attr, val, count(*)::DOUBLE AS n, sum(price) AS s, sum(price * price) AS q FROM u GROUP BY 1, 2),
w AS (SELECT attr, val, sum(n) OVER a AS n, sum(s) OVER a AS s, sum(q) OVER a AS q, sum(n) OVER b AS tn, sum(s) OVER b AS ts, sum(q) OVER b AS tq FROM v WINDOW a AS (PARTITION BY attr ORDER BY val), b AS (PARTITION BY attr)),
e AS (SELECT attr, val, round((q - s * s / n + (tq - q) - (ts - s) ** 2 / (tn - n)) / tn, 6) AS error FROM w WHERE tn > n)
SELECT 1 AS node, attr, val AS cut, round(error / 1e6, 4) AS error FROM e ORDER BY e.error, attr, val LIMIT 1""",
    "nb_generate": "SELECT DISTINCT l_returnflag AS class, true AS share, true AS symbols, true AS means FROM lineitem",
}
