"""Invariants and brute-force checks of operators that SQL doesn't express."""

import itertools
import math
import random

import numpy as np
import pytest
from lodestone.functions import sequences as S
from lodestone.functions import special
from lodestone.operators import align, classify, cluster, graph, patterns, phylogeny, table
from pyspark.sql import functions as F


def _baskets(seed, n=60, items=8):
    rng = random.Random(seed)
    return [sorted(rng.sample(range(items), rng.randint(1, 6))) for _ in range(n)]


def _frame(spark, baskets):
    return spark.createDataFrame([(t, i) for t, b in enumerate(baskets) for i in b], "tid long, item int")


def _support(baskets, items):
    return sum(set(items) <= set(b) for b in baskets)


@pytest.mark.parametrize("seed", [1, 2])
def test_mining_equals_enumeration(spark, seed):
    baskets = _baskets(seed)
    frame = _frame(spark, baskets)
    least = patterns.minimum_count(len(baskets), 0.1)
    want = {s: n for k in range(2, 9) for s in itertools.combinations(range(8), k) if (n := _support(baskets, s)) >= least}
    as_dict = lambda df: {tuple(r["items"]): r.support for r in df.collect()}
    assert as_dict(patterns.apriori(frame, 0.1)) == want
    assert as_dict(patterns.eclat(frame, 0.1)) == want
    assert as_dict(patterns.eclat(frame, 0.1, differences=True)) == want
    assert as_dict(patterns.weak_itemsets(frame, 0.1, 0.0)) == want
    assert as_dict(patterns.approximate_itemsets(frame, 0.1, 0.0, 0.0, max_size=8)) == want
    top = {s for s in want if not any(set(s) < set(t) for t in want)}
    assert set(as_dict(patterns.maximal(patterns.apriori(frame, 0.1)))) == top


def test_cliques_equal_enumeration(spark):
    rng = random.Random(3)
    edges = {e for e in itertools.combinations(range(9), 2) if rng.random() < 0.6}
    pairs = spark.createDataFrame([(list(e), 1) for e in edges], "items array<int>, support long")
    full = [s for k in range(3, 10) for s in itertools.combinations(range(9), k) if all(e in edges for e in itertools.combinations(s, 2))]
    want = {s for s in full if not any(set(s) < set(t) for t in full)}
    assert {tuple(r["items"]) for r in patterns.cliques(pairs).collect()} == want


def test_utility_equals_enumeration(spark):
    rng = random.Random(5)
    rows = {(t, i): rng.randint(1, 9) for t in range(25) for i in rng.sample(range(6), 3)}
    frame = spark.createDataFrame([(t, i, float(u)) for (t, i), u in rows.items()], "tid long, item int, utility double")
    least = 0.12 * sum(rows.values())
    want = {}
    for k in range(1, 7):
        for s in itertools.combinations(range(6), k):
            u = sum(sum(rows[t, i] for i in s) for t in range(25) if all((t, i) in rows for i in s))
            if u >= least:
                want[s] = u
    assert {tuple(r["items"]): r.utility for r in patterns.high_utility(frame, 0.12).collect()} == want


def test_join_and_unknowns(spark):
    a = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (1, 2, 2), (None, 9, 9)], "A int, B int, C int")
    b = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (1, 2, 2), (None, 7, 7)], "A int, D int, E int")
    assert table.natural_join(a, b).count() == 6
    with pytest.raises(ValueError):
        table.join(a, b.withColumnRenamed("D", "B"), [("A", "A")])
    kept, rest = table.cut(a, F.col("A") == 1)
    assert (kept.count(), rest.count()) == (2, 2)
    assert table.auto_types(a.withColumn("s", F.lit("1.5")).withColumn("t", F.lit("x")), ["s", "t"]) == {"s": "double", "t": "string"}
    assert sorted(r._row for r in table.numbered(a, [F.col("B")]).collect()) == [0, 1, 2, 3]


def test_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (4, 4), (0, 5))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    centres, assigned = cluster.kmeans(points, x[[0, 60, 120]].tolist())
    labels = {r.id: r.cluster for r in assigned.collect()}
    assert all(labels[i] == i // 60 for i in range(180))
    found, assigned = cluster.birch(points, 2, 3, limit=30)
    assert len({(i // 60, r) for i, r in ((r.id, r.cluster) for r in assigned.collect())}) == 3
    cfs = cluster.summarise(points, 2, limit=20).collect()
    assert sum(r.n for r in cfs) == 180 and np.allclose(np.sum([r.sx for r in cfs], axis=0), x.sum(axis=0))
    near = cluster.nearest_neighbours(points, 5, 2).collect()
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    for i in range(180):
        assert sorted(r.other for r in near if r.id == i) == sorted(np.lexsort((np.arange(180), d[i]))[:5].tolist())
    fuzzy = cluster.fuzzy_cmeans(points, x[[0, 60, 120]].tolist())
    assert np.allclose(sorted(map(tuple, fuzzy)), sorted(map(tuple, centres)), atol=0.3)


def test_chain_of_pointers(spark):
    pointers = spark.createDataFrame([(i, max(i - 1, 0)) for i in range(50)], "id long, next long")
    assert {r.root for r in cluster.follow(pointers).collect()} == {0}


def test_tree_is_pure_and_svm_separates(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    rows = spark.createDataFrame([(i, int(c), float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(y, x))], "rid long, class int, a double, b double")
    nodes, leaves = classify.grow_tree(rows, ["a", "b"])
    assert all(sum(n > 0 for n in node["counts"].values()) == 1 for node in nodes if node["attr"] is None)
    assert leaves.groupBy("node").agg(F.countDistinct("class").alias("k")).where("k > 1").count() == 0
    signs = np.where(y > 0, 1.0, -1.0)
    coef, bias = classify.train_svc(x @ x.T, signs, c=100)
    assert (np.sign(classify.predict_svc(coef, bias, x @ x.T)) == signs).mean() > 0.97
    noise = np.column_stack([rng.normal(size=80), x, rng.normal(size=80)])
    assert set(classify.eliminate_features(noise, signs)[-2:]) == {1, 2}


def test_bayes_net(spark):
    net = graph.BayesNet()
    for v in "abc":
        net.add_node(v, ["0", "1"])
    net.add_arc("a", "b")
    net.add_arc("b", "c")
    net.set_table("a", [0.3, 0.7])
    net.set_table("b", [[0.9, 0.1], [0.2, 0.8]])
    net.set_table("c", [[0.6, 0.4], [0.1, 0.9]])
    joint = {s: net.tables["a"][s[0]] * net.tables["b"][s[0], s[1]] * net.tables["c"][s[1], s[2]] for s in itertools.product((0, 1), repeat=3)}
    p = np.array([sum(v for s, v in joint.items() if s[0] == x and s[2] == 1) for x in (0, 1)])
    p /= p.sum()
    assert np.allclose(net.query(["a"], {"c": "1"}), p)
    assert np.allclose(net.propagate("a", {"c": "1"}), p)
    assert net.log_likelihood({"c": "1"}) == pytest.approx(math.log(sum(v for s, v in joint.items() if s[2] == 1)))
    best = max((s for s in joint if s[2] == 1), key=joint.get)
    assert net.most_probable({"c": "1"}) == {"a": str(best[0]), "b": str(best[1])}
    lw = {r.a: r.p for r in net.likelihood_weighting(spark, "a", {"c": "1"}, n=20000).collect()}
    assert lw["1"] == pytest.approx(p[1], abs=0.02)
    assert net.gibbs(spark, "a", {"c": "1"}, chains=4, steps=1500)[1] == pytest.approx(p[1], abs=0.04)
    cases = net.sample(spark, 4000, seed=1)
    edges, _ = graph.learn_structure(cases, ["a", "b", "c"])
    assert {frozenset(e) for e in edges} == {frozenset("ab"), frozenset("bc")}
    hidden = cases.withColumn("b", F.when(F.col("rid") % 3 != 0, F.col("b"))).drop("rid")
    learned = net.fit(cases).expectation_maximisation(hidden, rounds=5)
    assert learned.tables["b"][0, 0] == pytest.approx(0.9, abs=0.05)
    assert graph.d_connected([("a", "b"), ("c", "b")], "a", set()) == {"b"}
    assert graph.d_connected([("a", "b"), ("c", "b")], "a", {"b"}) == {"c"}


def _plain_local(a, b, match=5, mismatch=-4, opening=-12, extend=-4):
    best = 0
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            v = max(0, h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch))
            v = max([v, *(h[i - k, j] + opening + (k - 1) * extend for k in range(1, i + 1)), *(h[i, j - k] + opening + (k - 1) * extend for k in range(1, j + 1))])
            h[i, j] = v
            best = max(best, v)
    return best


def test_alignment_scores():
    rng = random.Random(9)
    for _ in range(25):
        a, b = ("".join(rng.choices("ACGT", k=rng.randint(1, 25))) for _ in range(2))
        found = align.local_alignments(a, b, k=3)
        assert (found[0][0] if found else 0) == _plain_local(a, b)
        assert len({(f[1], f[3]) for f in found}) == len(found)
        d = np.zeros((len(a) + 1, len(b) + 1))
        d[0], d[:, 0] = np.arange(len(b) + 1) * -4, np.arange(len(a) + 1) * -4
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = max(d[i - 1, j - 1] + (5 if a[i - 1] == b[j - 1] else -4), d[i - 1, j] - 4, d[i, j - 1] - 4)
        assert align.global_score(a, b) == d[-1, -1]
    assert align.local_alignments("", "A") == [] and align.global_score("", "AC") == -8


def test_extreme_value_fit():
    rng = np.random.default_rng(4)
    mu, lam = align.fit_extreme_values(10 - np.log(-np.log(rng.random(20000))) / 0.7)
    assert mu == pytest.approx(10, abs=0.05) and lam == pytest.approx(0.7, abs=0.02)


def test_trees(spark):
    text = "((a:1,b:2):0.5,(c:1,'d x':3):0.25,e:2);"
    tree = phylogeny.parse_newick(text)
    again = phylogeny.parse_newick(phylogeny.write_newick(tree).replace("d x", "'d x'"))
    assert phylogeny.splits(again) == phylogeny.splits(tree) == {("c", "d x"), ("c", "d x", "e")}
    names = sorted(tree.leaves())
    d = np.zeros((5, 5))
    for (a, b), v in phylogeny.path_distances(tree).items():
        d[names.index(a), names.index(b)] = d[names.index(b), names.index(a)] = v
    joined = phylogeny.neighbour_joining(names, d)
    assert phylogeny.splits(joined) == phylogeny.splits(tree)
    for pair, v in phylogeny.path_distances(joined).items():
        assert v == pytest.approx(phylogeny.path_distances(tree)[pair])
    column = {"a": "A", "b": "A", "c": "G", "d x": "G", "e": "A"}
    total = 0.0
    for r, u, v in itertools.product(range(4), repeat=3):
        p = lambda t, x, y: phylogeny.transition(t)[x, y]
        total += 0.25 * p(0.5, r, u) * p(1, u, 0) * p(2, u, 0) * p(0.25, r, v) * p(1, v, 2) * p(3, v, 2) * p(2, r, 0)
    assert phylogeny.site_likelihoods(tree, column) == pytest.approx(total)
    assert np.allclose(phylogeny.exponential(phylogeny.hky_rate_matrix([0.25] * 4, 1.0), 0.3), phylogeny.transition(0.3))
    trees = spark.createDataFrame([("((a,b),(c,d),e);",), ("((a,b),(c,e),d);",), ("((a,b),(c,d),e);",)], "newick string")
    assert phylogeny.splits(phylogeny.consensus(trees)) == phylogeny.splits(phylogeny.parse_newick("((a,b),(c,d),e);"))


def test_special_functions(spark):
    assert special.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert special.chi_square_quantile(0.95, 3) == pytest.approx(7.814727903, abs=1e-6)
    assert special.zeta(2) == pytest.approx(math.pi**2 / 6, abs=1e-9)
    assert special.regularised_gamma(2.5, 1.3) + 0 == pytest.approx(0.2349, abs=5e-2)
    assert special.gamma_rates(0.5, 4).mean() == pytest.approx(1)
    got = spark.createDataFrame([(0.5,), (None,)], "x double").select(special.erf(F.col("x")).alias("e")).collect()
    assert got[0].e == pytest.approx(math.erf(0.5)) and got[1].e is None


def test_sequence_functions(spark):
    row = spark.createDataFrame([("ATGGCN", "A-CGT", "AACG-")], "s string, a string, b string").select(
        S.reverse_complement(F.col("s")), S.translate(F.col("s")), S.identity(F.col("a"), F.col("b")), S.to_rna(F.col("s")), S.dealign(F.col("a"))
    )
    assert tuple(row.first()) == ("NGCCAT", "MX", pytest.approx(3 / 4), "AUGGCN", "ACGT")


def test_matrices(spark):
    from lodestone.functions import matrix as M

    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(4, 4)), rng.normal(size=(4, 4))
    x, y = M.from_dense(spark, a), M.from_dense(spark, b)
    assert np.allclose(M.to_dense(M.multiply(x, y), 4, 4), a @ b)
    assert np.allclose(M.to_dense(M.add(x, M.transpose(y), -2.0), 4, 4), a - 2 * b.T)
    assert np.allclose(M.to_dense(M.swap_rows(x, 0, 2), 4, 4), a[[2, 1, 0, 3]])
    order, low, up = M.lu(a)
    assert np.allclose(low @ up, a[order]) and np.allclose(M.solve(a, a @ b), b) and np.allclose(M.invert(a) @ a, np.eye(4))
    rows = spark.createDataFrame([(float(i), float(i * i), 2.0 + 3 * i - 0.5 * i * i) for i in range(9)], "p double, q double, t double")
    assert np.allclose(M.regression(rows, ["p", "q"], "t"), [2, 3, -0.5])


def test_histogram_and_significance(spark):
    hits = spark.createDataFrame([(50, 10.5), (50, 3.2), (40, 10.7)], "gc int, score double")
    assert {r.bin: r.n for r in align.score_histogram(hits).collect()} == {10: 2, 3: 1}
    fits = spark.createDataFrame([(50, 2.0, 0.7), (40, 30.0, 0.7)], "gc int, mu double, lam double")
    assert [r.score for r in align.significant(hits, fits, 0.1).collect()] == [10.5]


def test_more_trees(spark):
    text = "((a:1,b:1):1,(c:0.5,d:0.5):1.5);"
    tree = phylogeny.parse_newick(text)
    names = ["a", "b", "c", "d"]
    d = np.zeros((4, 4))
    for (x, y), v in phylogeny.path_distances(tree).items():
        d[names.index(x), names.index(y)] = d[names.index(y), names.index(x)] = v
    for mode in ("mean", "min", "max"):
        again = phylogeny.hierarchy(names, d, mode)
        assert phylogeny.same_topology(again, tree)
        assert {k: round(v, 9) for k, v in phylogeny.path_distances(again).items()} == phylogeny.path_distances(tree)
    counts = 1000 * phylogeny.transition(0.3) / 4
    assert phylogeny.likelihood_distance(counts) == pytest.approx(0.3, abs=1e-4)
    assert phylogeny.gamma_distance(0.2, 1e6) == pytest.approx(phylogeny.jukes_cantor(0.2), abs=1e-5)
    five = phylogeny.parse_newick("((a,b),(c,d),e);")
    assert phylogeny.satisfies(five, phylogeny.parse_newick("((a,b),c,d);")) and not phylogeny.satisfies(five, phylogeny.parse_newick("((a,c),b,d);"))
    moved = phylogeny.neighbour_interchanges(five)
    assert len({frozenset(phylogeny.splits(t)) for t in moved} - {frozenset(phylogeny.splits(five))}) >= 3
    seqs = {r.id: r.seq for r in phylogeny.simulate(spark, "(a:0.1,b:0.1,c:3);", 3000, 1).collect()}
    assert {len(s) for s in seqs.values()} == {3000}
    p = np.mean([x != y for x, y in zip(seqs["a"], seqs["b"])])
    assert phylogeny.jukes_cantor(p) == pytest.approx(0.2, abs=0.04)
    aligned = spark.createDataFrame([("a", "AAC"), ("b", "AAG"), ("c", "ACT")], "id string, seq string")
    rates = {r.pos: r for r in phylogeny.site_rates(aligned, "(a:0.3,b:0.3,c:0.3);").collect()}
    assert rates[0].ml_rate < rates[1].ml_rate <= rates[2].ml_rate and rates[0].eb_rate < rates[2].eb_rate
    weights = {r.id: r.weight for r in align.cluster_weights(aligned, 0.6).collect()}
    assert weights == {"a": 0.75, "b": 0.75, "c": 1.5}


def test_saved_net():
    net = graph.BayesNet()
    net.add_node("a", ["x", "y"])
    net.set_table("a", [0.25, 0.75])
    assert graph.BayesNet.load(net.save()).query(["a"], {}).tolist() == [0.25, 0.75]
