"""Registered queries of graphs and graphical models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import graph_models as J

from .data import table


def _sparse(spark, d):
    """Each customer is linked to one with a smaller or equal key, by nation."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("src"), (F.col("c_custkey") - F.col("c_custkey") % (2 + F.col("c_nationkey"))).alias("dst"))


def _dag(spark, d):
    """Nations that point to nations with larger keys in other regions: a small directed acyclic graph."""
    n = table(spark, d, "nation")
    a = n.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("ra"))
    b = n.select(F.col("n_nationkey").alias("dst"), F.col("n_regionkey").alias("rb"))
    return a.join(b, (F.col("src") < F.col("dst")) & ((F.col("src") * 7 + F.col("dst") * 3) % 4 == 0) & (F.col("ra") != F.col("rb"))).select("src", "dst")


def _cases(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.col("l_linenumber") % 3).cast("string").alias("line"),
        F.when(F.col("l_quantity") > 25, "hi").otherwise("lo").alias("qty"), F.when(F.col("l_extendedprice") > 30000, "hi").otherwise("lo").alias("price"),
    )


def g_components(spark, d):
    return G.components(_sparse(spark, d))


def g_ancestors(spark, d):
    return G.ancestors(_dag(spark, d), spark.createDataFrame([(20,)], "node int"))


def g_reachable(spark, d):
    return G.closure(_dag(spark, d), spark.createDataFrame([(3,)], "node int"))


def g_markov_blanket(spark, d):
    return G.markov_blanket(_dag(spark, d))


def g_moralize(spark, d):
    return G.moralise(_dag(spark, d))


def g_topological(spark, d):
    return G.topological_levels(_dag(spark, d))


def cpt_ml(spark, d):
    return G.cpt(_cases(spark, d), "flag", ["status", "qty"]).withColumn("p", F.round("p", 9))


def mutual_information(spark, d):
    return G.mutual_information(_cases(spark, d), ["flag", "status", "qty", "price"]).withColumn("mi", F.round("mi", 9))


def chow_liu_tree(spark, d):
    mi = {(r.a, r.b): round(r.mi, 12) for r in G.mutual_information(_cases(spark, d), ["flag", "status", "line", "qty", "price"]).collect()}
    return spark.createDataFrame(G.spanning_tree(mi), "a string, b string")


FAMILIES = (("flag", ()), ("flag", ("status",)), ("price", ("qty",)), ("price", ("flag", "qty")))


def bic_family(spark, d):
    cases = _cases(spark, d)
    r = cases.agg(F.count("*").alias("_n"), *[F.countDistinct(c).alias(c) for c in cases.columns]).first()
    found = G.family_scores(cases, FAMILIES, r["_n"], {c: r[c] for c in cases.columns})
    return spark.createDataFrame([(c, ",".join(p), round(s, 4)) for (c, p), s in found.items()], "child string, parents string, score double")


def structure_learning(spark, d):
    edges, _ = G.learn_structure(_cases(spark, d), ["flag", "status", "line", "qty", "price"])
    return spark.createDataFrame(edges or [("", "")], "src string, dst string")


def _factors(spark, d):
    cases = _cases(spark, d)
    a = G.cpt(cases, "status", []).select("status", "p")
    b = G.cpt(cases, "flag", ["status"]).select("status", "flag", "p")
    c = G.cpt(cases, "qty", ["flag"]).select("flag", "qty", "p")
    return a, b, c


def factor_product(spark, d):
    a, b, _ = _factors(spark, d)
    return G.multiply(a, b).withColumn("p", F.round("p", 9))


def factor_marginal(spark, d):
    a, b, c = _factors(spark, d)
    return G.marginal(G.multiply(G.multiply(a, b), c), ["qty"]).withColumn("p", F.round("p", 9))


def naive_inference(spark, d):
    return G.infer(_factors(spark, d), ["status"], {"qty": "hi"}).withColumn("p", F.round("p", 9))


def _net(spark, d):
    cases, net = _cases(spark, d), G.BayesNet()
    for c in ("status", "flag", "qty"):
        net.add_node(c, sorted(r[0] for r in cases.select(c).distinct().collect()))
    net.add_arc("status", "flag")
    net.add_arc("flag", "qty")
    return net.fit(cases)


def elimination_inference(spark, d):
    net = _net(spark, d)
    return spark.createDataFrame([(v, round(float(p), 9)) for v, p in zip(net.values["status"], net.query(["status"], {"qty": "hi"}))], "status string, p double")


def belief_propagation(spark, d):
    net = _net(spark, d)
    return spark.createDataFrame([(v, round(float(p), 9)) for v, p in zip(net.values["status"], net.propagate("status", {"qty": "hi"}))], "status string, p double")


def _close(spark, net, found):
    """Whether sampled shares lie within five percent of the exact posterior."""
    exact = dict(zip(net.values["status"], net.query(["status"], {"qty": "hi"})))
    return spark.createDataFrame([(v, bool(abs(found.get(v, 0.0) - float(p)) < 0.05)) for v, p in exact.items()], "status string, close boolean")


def likelihood_weighting(spark, d):
    net = _net(spark, d)
    return _close(spark, net, {r.status: r.p for r in net.likelihood_weighting(spark, "status", {"qty": "hi"}, n=20000).collect()})


def gibbs_sampling(spark, d):
    net = _net(spark, d)
    return _close(spark, net, dict(zip(net.values["status"], net.gibbs(spark, "status", {"qty": "hi"}, chains=4, steps=1500).tolist())))


def bnet_samples(spark, d):
    """Shares of the sampled pairs of values within three percent of the network's own."""
    net = _net(spark, d)
    rows = net.sample(spark, 20000).groupBy("status", "flag").agg((F.count("*") / 20000).alias("p")).collect()
    exact = net.query(["status", "flag"], {})
    found = {(r.status, r.flag): r.p for r in rows}
    return spark.createDataFrame([(s, f, bool(abs(found.get((s, f), 0.0) - float(exact[i, j])) < 0.03)) for i, s in enumerate(net.values["status"]) for j, f in enumerate(net.values["flag"])], "status string, flag string, close boolean")


# --- junction trees and other models ---------------------------------------------------------------


def _wide(spark, d):
    """A network with a loop: status to flag and price, both to qty."""
    cases, net = _cases(spark, d), G.BayesNet()
    for c in ("status", "flag", "price", "qty"):
        net.add_node(c, sorted(r[0] for r in cases.select(c).distinct().collect()))
    for a, b in (("status", "flag"), ("status", "price"), ("flag", "qty"), ("price", "qty")):
        net.add_arc(a, b)
    return net.fit(cases)


def jtree_cliques(spark, d):
    tree = J.junction_tree(_wide(spark, d))
    return spark.createDataFrame([(",".join(c),) for c in tree.cliques], "members string")


def jtree_inference(spark, d):
    net = _wide(spark, d)
    tree = J.junction_tree(net).calibrate({"qty": net.values["qty"].index("hi")})
    return spark.createDataFrame([(n, v, round(float(p), 9)) for n in ("status", "flag", "price") for v, p in zip(net.values[n], tree.marginal(n))], "variable string, value string, p double")


def jtree_evidence(spark, d):
    """ln P(evidence) and the most probable values of the rest."""
    net = _wide(spark, d)
    evidence = {"qty": net.values["qty"].index("lo")}
    ll = J.junction_tree(net).calibrate(evidence).log_likelihood()
    best = J.junction_tree(net).most_probable(evidence)
    return spark.createDataFrame([(*(net.values[n][best[n]] for n in ("status", "flag", "price", "qty")), round(ll, 8))], "status string, flag string, price string, qty string, log_likelihood double")


def factor_graph(spark, d):
    """Sums and maxima by messages on the chain status, flag, qty."""
    net = _net(spark, d)
    graph = J.FactorGraph(net._factors({}), {v: len(x) for v, x in net.values.items()})
    rows = []
    for kind, most in (("sum", False), ("max", True)):
        found = graph.run({"qty": net.values["qty"].index("hi")}, maximise=most)
        rows += [(kind, v, round(float(p), 9)) for v, p in zip(net.values["status"], found["status"])]
    return spark.createDataFrame(rows, "kind string, status string, p double")


def markov_net(spark, d):
    """Pairwise shares around a loop of three variables as potentials."""
    cases, net = _cases(spark, d), J.MarkovNet()
    for c in ("status", "price", "qty"):
        net.add_node(c, sorted(r[0] for r in cases.select(c).distinct().collect()))
    for pair in (("status", "price"), ("price", "qty"), ("qty", "status")):
        net.add_clique(pair)
    net.fit(cases)
    return spark.createDataFrame([(v, round(float(p), 9)) for v, p in zip(net.values["status"], net.query("status", {"qty": "hi"}))], "status string, p double")


def component_inference(spark, d):
    """Two unconnected families: each is summed by itself."""
    cases = _cases(spark, d)
    values = {c: sorted(r[0] for r in cases.select(c).distinct().collect()) for c in ("status", "flag", "price", "qty")}
    factors = []
    for a, b in (("status", "flag"), ("price", "qty")):
        counts = {(r[a], r[b]): r["n"] for r in cases.groupBy(a, b).agg(F.count("*").alias("n")).collect()}
        factors.append(([a, b], np.array([[float(counts.get((x, y), 0)) for y in values[b]] for x in values[a]])))
    found = J.by_components(factors, {c: len(v) for c, v in values.items()}, {"qty": values["qty"].index("hi")})
    return spark.createDataFrame([(c, v, round(float(p), 9)) for c in ("status", "flag", "price") for v, p in zip(values[c], found[c])], "variable string, value string, p double")


def decision_policy(spark, d):
    """Hold or send by the flag, with a worth that depends on the unseen status: the best choice for each flag and its worth."""
    net = _net(spark, d)
    sizes = {"status": len(net.values["status"]), "flag": len(net.values["flag"]), "choice": 2}
    worth = np.array([[3.0 if s == "F" else 0.0, 1.0 if s == "F" else 2.0] for s in net.values["status"]])
    model = J.DecisionNet([f for f in net._factors({}) if "qty" not in f[0]], sizes, {"choice": ["flag"]}, [(["status", "choice"], worth)]).improve()
    eu = round(model.expected_utility(), 8)
    return spark.createDataFrame([(f, ("hold", "send")[int(model.policy["choice"][i].argmax())], eu) for i, f in enumerate(net.values["flag"])], "flag string, choice string, utility double")


_INITIAL, _TRANSITION, _EMISSION = [0.6, 0.4], [[0.7, 0.3], [0.2, 0.8]], [[0.5, 0.3, 0.2], [0.1, 0.4, 0.5]]


def _series(spark, d):
    """``(series, t, obs)``: the lines of each order in order of their numbers; an observation by quantity."""
    obs = F.when(F.col("l_quantity") <= 17, 0).when(F.col("l_quantity") <= 34, 1).otherwise(2)
    # Dealt by order once, for the lines, their numbers and the series.
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    t = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    return lines.select(F.col("l_orderkey").alias("series"), t.cast("long").alias("t"), obs.cast("long").alias("obs"))


def series_filter(spark, d):
    return G.filter_series(_series(spark, d), _INITIAL, _TRANSITION, _EMISSION).where("state = 0").select("series", "t", F.round("p", 9).alias("p"))


def series_smooth(spark, d):
    return J.SeriesModel(_INITIAL, _TRANSITION, _EMISSION).smooth_series(_series(spark, d)).where("state = 0").select("series", "t", F.round("p", 9).alias("p"))


def series_decode(spark, d):
    """The log-probability of the most probable states of each series, from the states."""
    model = J.SeriesModel(_INITIAL, _TRANSITION, _EMISSION)
    rows = model.decode_series(_series(spark, d))
    w = Window.partitionBy("series").orderBy("t")
    pick = lambda table, *at: F.element_at(F.flatten(F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in table])), (at[0] * len(table[0]) + at[1] + 1).cast("int"))
    before = F.lag("state").over(w)
    first = F.element_at(F.array(*[F.lit(v) for v in _INITIAL]), F.col("state") + 1)
    term = F.log(F.when(before.isNull(), first).otherwise(pick(_TRANSITION, F.coalesce(before, F.lit(0)), F.col("state")))) + F.log(pick(_EMISSION, F.col("state"), F.col("obs")))
    return rows.withColumn("term", term).groupBy("series").agg(F.round(F.sum("term"), 8).alias("log_p"))


def series_learning(spark, d):
    """Five rounds of expectation maximisation never lower the likelihood, and the tables stay distributions."""
    model, seen = J.SeriesModel(_INITIAL, _TRANSITION, _EMISSION).learn(_series(spark, d), 5)
    rising = all(b >= a - 1e-6 for a, b in zip(seen, seen[1:]))
    sums = bool(np.allclose(model.transition.sum(axis=1), 1) and np.allclose(model.emission.sum(axis=1), 1) and np.isclose(model.initial.sum(), 1))
    return spark.createDataFrame([(rising, sums, len(seen))], "rising boolean, sums boolean, rounds int")


def dirichlet_learning(spark, d):
    return J.dirichlet_table(_cases(spark, d), "flag", ["status", "qty"], 2.0).withColumn("p", F.round("p", 9))


def em_complete_cases(spark, d):
    """With nothing unknown, expectation maximisation gives the maximum-likelihood tables, from any start."""
    cases, net = _cases(spark, d), _net(spark, d)
    for name in net.values:
        net.tables[name] = np.full_like(net.tables[name], 1 / net.tables[name].shape[-1])
    net.expectation_maximisation(cases.select("status", "flag", "qty"), rounds=2)
    return spark.createDataFrame([(f, q, round(float(net.tables["qty"][i, j]), 9)) for i, f in enumerate(net.values["flag"]) for j, q in enumerate(net.values["qty"])], "flag string, qty string, p double")


def score_kinds(spark, d):
    """The families' scores by likelihood alone and with a penalty for each free number."""
    cases = _cases(spark, d)
    r = cases.agg(F.count("*").alias("_n"), *[F.countDistinct(c).alias(c) for c in cases.columns]).first()
    rows = []
    for kind in ("AIC", "none"):
        found = G.family_scores(cases, FAMILIES, r["_n"], {c: r[c] for c in cases.columns}, kind)
        rows += [(kind, c, ",".join(p), round(s, 4)) for (c, p), s in found.items()]
    return spark.createDataFrame(rows, "kind string, child string, parents string, score double")


def structure_exhaustive(spark, d):
    edges, score = J.best_structure(_cases(spark, d), ["flag", "qty", "status"])
    return spark.createDataFrame([(round(score, 3), len(edges))], "score double, edges int")


def gaussian_node(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"))
    b, var = J.linear_gaussian(rows, "y", ["x"])
    return spark.createDataFrame([(round(float(b[0]), 3), round(float(b[1]), 5), round(var / 1e6, 5))], "constant double, slope double, variance double")


def d_connected(spark, d):
    """What is connected to nation 3 given nation 20, along active paths of the graph of nations."""
    edges = [(r.src, r.dst) for r in _dag(spark, d).collect()]
    found = G.d_connected(edges, 3, set())
    return spark.createDataFrame([(int(n),) for n in sorted(found)], "node int")


QUERIES = {f.__name__: f for f in (
    g_components, g_ancestors, g_reachable, g_markov_blanket, g_moralize, g_topological, cpt_ml, mutual_information, chow_liu_tree, bic_family,
    structure_learning, factor_product, factor_marginal, naive_inference, elimination_inference, belief_propagation, likelihood_weighting,
    gibbs_sampling, bnet_samples, jtree_cliques, jtree_inference, jtree_evidence, factor_graph, markov_net, component_inference, decision_policy,
    series_filter, series_smooth, series_decode, series_learning, dirichlet_learning, em_complete_cases, score_kinds, structure_exhaustive,
    gaussian_node, d_connected,
)}

_DAG = """g AS MATERIALIZED (SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey
AND (a.n_nationkey * 7 + b.n_nationkey * 3) % 4 = 0 AND a.n_regionkey <> b.n_regionkey)"""
_CASES = """k AS MATERIALIZED (SELECT l_returnflag AS flag, l_linestatus AS status, (l_linenumber % 3)::VARCHAR AS line,
CASE WHEN l_quantity > 25 THEN 'hi' ELSE 'lo' END AS qty, CASE WHEN l_extendedprice > 30000 THEN 'hi' ELSE 'lo' END AS price FROM lineitem)"""
_FACTORS = f"""{_CASES}, fa AS (SELECT status, count(*)::DOUBLE / (SELECT count(*) FROM k) AS p FROM k GROUP BY status),
fb AS (SELECT status, flag, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY status) AS p FROM k GROUP BY status, flag),
fc AS (SELECT flag, qty, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY flag) AS p FROM k GROUP BY flag, qty)"""
_POST = f"""WITH {_FACTORS}, j AS (SELECT status, sum(fa.p * fb.p * fc.p) AS p FROM fa JOIN fb USING (status) JOIN fc USING (flag) WHERE qty = 'hi' GROUP BY status)
SELECT status, round(p / (SELECT sum(p) FROM j), 9) AS p FROM j"""
_MI = """n AS (SELECT count(*)::DOUBLE AS n FROM k), {parts}"""


def _mi_sql(columns):
    out = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            out.append(f"""SELECT '{a}' AS a, '{b}' AS b, round(sum(c / n * ln(c * n / (cx * cy))), 9) AS mi FROM (SELECT {a}, {b}, count(*)::DOUBLE AS c,
sum(count(*)) OVER (PARTITION BY {a}) AS cx, sum(count(*)) OVER (PARTITION BY {b}) AS cy, sum(count(*)) OVER () AS n FROM k GROUP BY {a}, {b})""")
    return " UNION ALL ".join(out)


def _bic_sql():
    out = []
    for child, parents in FAMILIES:
        by = ", ".join((child, *parents))
        over = f"PARTITION BY {', '.join(parents)}" if parents else ""
        free = " * ".join([f"((SELECT count(DISTINCT {child}) FROM k) - 1)", *[f"(SELECT count(DISTINCT {p}) FROM k)" for p in parents]])
        out.append(f"""SELECT '{child}' AS child, '{",".join(parents)}' AS parents, round(sum(c * ln(c / m)) - 0.5 * ln((SELECT count(*) FROM k)) * {free}, 4) AS score
FROM (SELECT count(*)::DOUBLE AS c, sum(count(*)) OVER ({over}) AS m FROM k GROUP BY {by})""")
    return " UNION ALL ".join(out)


_WIDE = f"""{_CASES}, fa AS (SELECT status, count(*)::DOUBLE / (SELECT count(*) FROM k) AS p FROM k GROUP BY status),
fb AS (SELECT status, flag, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY status) AS p FROM k GROUP BY status, flag),
fc AS (SELECT status, price, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY status) AS p FROM k GROUP BY status, price),
fd AS (SELECT flag, price, qty, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY flag, price) AS p FROM k GROUP BY flag, price, qty),
j AS MATERIALIZED (SELECT status, flag, price, qty, fa.p * fb.p * fc.p * fd.p AS p FROM fa JOIN fb USING (status) JOIN fc USING (status) JOIN fd USING (flag, price))"""
_MARGINS = " UNION ALL ".join(f"SELECT '{v}' AS variable, {v} AS value, round(sum(p) / (SELECT sum(p) FROM {{t}}), 9) AS p FROM {{t}} GROUP BY {v}" for v in ("status", "flag", "price"))
_OBS = """o AS MATERIALIZED (SELECT l_orderkey AS series, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS t, CASE WHEN min(l_quantity) <= 17 THEN 0 WHEN min(l_quantity) <= 34 THEN 1 ELSE 2 END AS obs
FROM lineitem GROUP BY l_orderkey, l_linenumber), e AS MATERIALIZED (SELECT series, t, CASE obs WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END::DOUBLE AS e0, CASE obs WHEN 0 THEN 0.1 WHEN 1 THEN 0.4 ELSE 0.5 END::DOUBLE AS e1 FROM o)"""
_FORWARD = """f(series, t, f0, f1) AS (SELECT series, t, 0.6::DOUBLE * e0 / (0.6 * e0 + 0.4 * e1), 0.4::DOUBLE * e1 / (0.6 * e0 + 0.4 * e1) FROM e WHERE t = 0
UNION ALL SELECT f.series, e.t, (0.7 * f0 + 0.2 * f1) * e0 / ((0.7 * f0 + 0.2 * f1) * e0 + (0.3 * f0 + 0.8 * f1) * e1), (0.3 * f0 + 0.8 * f1) * e1 / ((0.7 * f0 + 0.2 * f1) * e0 + (0.3 * f0 + 0.8 * f1) * e1)
FROM f JOIN e ON e.series = f.series AND e.t = f.t + 1)"""


def _kruskal(columns):
    """An edge is in the maximum spanning tree unless heavier edges connect its ends."""
    return f"""WITH RECURSIVE {_CASES}, w AS MATERIALIZED (SELECT a, b, mi FROM ({_mi_sql(columns).replace("round(sum(c / n * ln(c * n / (cx * cy))), 9)", "sum(c / n * ln(c * n / (cx * cy)))")})),
u AS MATERIALIZED (SELECT a, b, mi FROM w UNION ALL SELECT b, a, mi FROM w), r(a, b, mi, here) AS (SELECT a, b, mi, a FROM w UNION SELECT r.a, r.b, r.mi, u.b FROM r JOIN u ON u.a = r.here AND u.mi > r.mi + 1e-12)
SELECT a, b FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.a = w.a AND r.b = w.b AND r.here = w.b)"""


def _best_three():
    names = ("flag", "qty", "status")
    out = []
    for c in names:
        rest = [x for x in names if x != c]
        for k in range(4):
            parents = [x for i, x in enumerate(rest) if k >> i & 1]
            over = f"PARTITION BY {', '.join(parents)}" if parents else ""
            free = " * ".join([f"((SELECT count(DISTINCT {c}) FROM k) - 1)", *[f"(SELECT count(DISTINCT {p}) FROM k)" for p in parents]])
            has = [f"{p in parents} AS {p}" for p in names]
            out.append(f"""SELECT '{c}' AS child, {', '.join(has)}, sum(c * ln(c / m)) - 0.5 * ln((SELECT count(*) FROM k)) * {free} AS s
FROM (SELECT count(*)::DOUBLE AS c, sum(count(*)) OVER ({over}) AS m FROM k GROUP BY {', '.join((c, *parents))})""")
    return f"""WITH {_CASES}, s AS MATERIALIZED ({' UNION ALL '.join(out)}) SELECT round(max(a.s + b.s + c.s), 3) AS score, arg_max(a.qty::INT + a.status::INT + b.flag::INT + b.status::INT + c.flag::INT + c.qty::INT, a.s + b.s + c.s - 1e-6 * (a.qty::INT + a.status::INT + b.flag::INT + b.status::INT + c.flag::INT + c.qty::INT)) AS edges FROM s a, s b, s c
WHERE a.child = 'flag' AND b.child = 'qty' AND c.child = 'status' AND NOT (a.qty AND b.flag) AND NOT (a.status AND c.flag) AND NOT (b.status AND c.qty)
AND NOT (a.qty AND b.status AND c.flag) AND NOT (a.status AND c.qty AND b.flag)"""


ORACLES = {
    "g_components": """WITH RECURSIVE e AS MATERIALIZED (SELECT c_custkey AS s, c_custkey - c_custkey % (2 + c_nationkey) AS t FROM customer),
u AS MATERIALIZED (SELECT s, t FROM e UNION SELECT t, s FROM e),
r(node, other) AS (SELECT DISTINCT s, s FROM u UNION SELECT r.node, u.t FROM r JOIN u ON r.other = u.s)
SELECT node, min(other) AS component FROM r GROUP BY node""",
    "g_ancestors": f"WITH RECURSIVE {_DAG}, r(node) AS (SELECT src FROM g WHERE dst = 20 UNION SELECT g.src FROM r JOIN g ON g.dst = r.node) SELECT node FROM r",
    "g_reachable": f"WITH RECURSIVE {_DAG}, r(node) AS (SELECT 3 UNION SELECT g.dst FROM r JOIN g ON g.src = r.node) SELECT node FROM r",
    "g_markov_blanket": f"""WITH {_DAG} SELECT DISTINCT * FROM (SELECT dst AS node, src AS member FROM g UNION ALL SELECT src, dst FROM g
UNION ALL SELECT a.src, b.src FROM g a JOIN g b ON a.dst = b.dst AND a.src <> b.src)""",
    "g_moralize": f"WITH {_DAG} SELECT src AS a, dst AS b FROM g UNION SELECT x.src, y.src FROM g x JOIN g y ON x.dst = y.dst AND x.src < y.src",
    "g_topological": f"""WITH RECURSIVE {_DAG}, v AS (SELECT src AS node FROM g UNION SELECT dst FROM g),
r(node, level) AS (SELECT node, 0 FROM v UNION SELECT g.dst, level + 1 FROM r JOIN g ON g.src = r.node) SELECT node, max(level)::INT AS level FROM r GROUP BY node""",
    "cpt_ml": f"""WITH {_CASES}, f AS (SELECT * FROM (SELECT DISTINCT flag FROM k), (SELECT DISTINCT status FROM k), (SELECT DISTINCT qty FROM k)),
c AS (SELECT flag, status, qty, count(*)::DOUBLE AS n FROM k GROUP BY ALL), t AS (SELECT flag, status, qty, coalesce(n, 0) AS n FROM f LEFT JOIN c USING (flag, status, qty))
SELECT flag, status, qty, n, round(CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 1.0 / count(*) OVER w END, 9) AS p FROM t WINDOW w AS (PARTITION BY status, qty)""",
    "mutual_information": f"WITH {_CASES} {_mi_sql(['flag', 'status', 'qty', 'price'])}",
    "bic_family": f"WITH {_CASES} {_bic_sql()}",
    "factor_product": f"WITH {_FACTORS} SELECT status, flag, round(fa.p * fb.p, 9) AS p FROM fa JOIN fb USING (status)",
    "factor_marginal": f"WITH {_FACTORS} SELECT qty, round(sum(fa.p * fb.p * fc.p), 9) AS p FROM fa JOIN fb USING (status) JOIN fc USING (flag) GROUP BY qty",
    "naive_inference": _POST,
    "elimination_inference": _POST,
    "belief_propagation": _POST,
    "chow_liu_tree": _kruskal(["flag", "status", "line", "qty", "price"]),
    "likelihood_weighting": "SELECT DISTINCT l_linestatus AS status, true AS close FROM lineitem",
    "gibbs_sampling": "SELECT DISTINCT l_linestatus AS status, true AS close FROM lineitem",
    "bnet_samples": "SELECT s AS status, f AS flag, true AS close FROM (SELECT DISTINCT l_linestatus AS s FROM lineitem), (SELECT DISTINCT l_returnflag AS f FROM lineitem)",
    "jtree_cliques": "SELECT * FROM (VALUES ('flag,price,qty'), ('flag,price,status')) t(members)",
    "jtree_inference": f"WITH {_WIDE}, h AS (SELECT * FROM j WHERE qty = 'hi') {_MARGINS.format(t='h')}",
    "jtree_evidence": f"WITH {_WIDE} SELECT status, flag, price, qty, round(ln((SELECT sum(p) FROM j WHERE qty = 'lo')), 8) AS log_likelihood FROM j WHERE qty = 'lo' ORDER BY p DESC LIMIT 1",
    "factor_graph": f"""WITH {_FACTORS}, j AS (SELECT status, fa.p * fb.p * fc.p AS p FROM fa JOIN fb USING (status) JOIN fc USING (flag) WHERE qty = 'hi'),
s AS (SELECT status, sum(p) AS s, max(p) AS m FROM j GROUP BY status) SELECT 'sum' AS kind, status, round(s / (SELECT sum(s) FROM s), 9) AS p FROM s UNION ALL SELECT 'max', status, round(m / (SELECT sum(m) FROM s), 9) FROM s""",
    "markov_net": f"""WITH {_CASES}, n AS (SELECT count(*)::DOUBLE AS n FROM k), a AS (SELECT status, price, count(*) AS c FROM k GROUP BY ALL), b AS (SELECT price, qty, count(*) AS c FROM k GROUP BY ALL), c AS (SELECT qty, status, count(*) AS c FROM k GROUP BY ALL),
j AS (SELECT status, sum(a.c / n * b.c / n * c.c / n) AS p FROM a JOIN b USING (price) JOIN c USING (qty, status), n WHERE qty = 'hi' GROUP BY status) SELECT status, round(p / (SELECT sum(p) FROM j), 9) AS p FROM j""",
    "component_inference": f"""WITH {_CASES}, u AS (SELECT 'status' AS variable, status AS value, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 'flag', flag, count(*) FROM k GROUP BY ALL
UNION ALL SELECT 'price', v, coalesce(sum(CASE WHEN price = v AND qty = 'hi' THEN 1 ELSE 0 END), 0) FROM k, (SELECT DISTINCT price AS v FROM k) GROUP BY v)
SELECT variable, value, round(n / sum(n) OVER (PARTITION BY variable), 9) AS p FROM u""",
    "decision_policy": f"""WITH {_CASES}, n AS (SELECT count(*)::DOUBLE AS n FROM k), w AS (SELECT flag, sum(CASE WHEN status = 'F' THEN 3.0 ELSE 0 END) AS hold, sum(CASE WHEN status = 'F' THEN 1.0 ELSE 2.0 END) AS send FROM k GROUP BY flag)
SELECT flag, CASE WHEN hold >= send THEN 'hold' ELSE 'send' END AS choice, round((SELECT sum(greatest(hold, send)) FROM w) / n, 8) AS utility FROM w, n""",
    "series_filter": f"WITH RECURSIVE {_OBS}, {_FORWARD} SELECT series, t, round(f0, 9) AS p FROM f",
    "series_smooth": f"""WITH RECURSIVE {_OBS}, {_FORWARD}, g(series, t, g0, g1) AS (SELECT series, max(t), 1.0::DOUBLE, 1.0::DOUBLE FROM e GROUP BY series UNION ALL
SELECT g.series, e.t - 1, (0.7 * e0 * g0 + 0.3 * e1 * g1), (0.2 * e0 * g0 + 0.8 * e1 * g1) FROM g JOIN e ON e.series = g.series AND e.t = g.t WHERE g.t > 0)
SELECT f.series, f.t, round(f0 * g0 / (f0 * g0 + f1 * g1), 9) AS p FROM f JOIN g ON f.series = g.series AND f.t = g.t""",
    "series_decode": f"""WITH RECURSIVE {_OBS}, v(series, t, v0, v1) AS (SELECT series, t, ln(0.6 * e0), ln(0.4 * e1) FROM e WHERE t = 0 UNION ALL
SELECT v.series, e.t, greatest(v0 + ln(0.7), v1 + ln(0.2)) + ln(e0), greatest(v0 + ln(0.3), v1 + ln(0.8)) + ln(e1) FROM v JOIN e ON e.series = v.series AND e.t = v.t + 1)
SELECT series, round(greatest(arg_max(v0, t), arg_max(v1, t)), 8) AS log_p FROM v GROUP BY series""",
    "series_learning": "SELECT true AS rising, true AS sums, 5 AS rounds",
    "dirichlet_learning": f"""WITH {_CASES}, f AS (SELECT * FROM (SELECT DISTINCT flag FROM k), (SELECT DISTINCT status FROM k), (SELECT DISTINCT qty FROM k)), c AS (SELECT flag, status, qty, count(*)::DOUBLE AS n FROM k GROUP BY ALL),
t AS (SELECT flag, status, qty, coalesce(n, 0) AS n FROM f LEFT JOIN c USING (flag, status, qty)) SELECT flag, status, qty, n, round((n + 2) / (sum(n) OVER w + 2 * count(*) OVER w), 9) AS p FROM t WINDOW w AS (PARTITION BY status, qty)""",
    "em_complete_cases": f"WITH {_CASES} SELECT flag, qty, round(count(*) / sum(count(*)) OVER (PARTITION BY flag), 9) AS p FROM k GROUP BY flag, qty",
    "score_kinds": f"""WITH {_CASES} {" UNION ALL ".join("SELECT '" + kind + "' AS kind, * FROM (" + _bic_sql().replace("0.5 * ln((SELECT count(*) FROM k))", weight) + ")" for kind, weight in (("AIC", "1.0"), ("none", "0.0")))}""",
    "structure_exhaustive": _best_three(),
    "gaussian_node": """WITH r AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS b0, regr_slope(l_extendedprice, l_quantity) AS b1 FROM lineitem)
SELECT round(any_value(b0), 3) AS constant, round(any_value(b1), 5) AS slope, round(avg((l_extendedprice - b0 - b1 * l_quantity) ** 2) / 1e6, 5) AS variance FROM lineitem, r""",
    "d_connected": f"""WITH RECURSIVE {_DAG}, r(node, way) AS (SELECT 3, 'up' UNION SELECT CASE WHEN r.way = 'up' AND g.dst = r.node THEN g.src ELSE g.dst END, CASE WHEN r.way = 'up' AND g.dst = r.node THEN 'up' ELSE 'down' END
FROM r JOIN g ON (r.way = 'up' AND g.dst = r.node) OR g.src = r.node) SELECT DISTINCT node::INT AS node FROM r WHERE node <> 3""",
}
