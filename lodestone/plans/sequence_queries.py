"""Registered queries of sequence analysis and phylogeny.

The sequences are made from ``documents``: letters of a text mapped to four
bases, or aligned rows of the same length.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import sequences as S
from lodestone.operators import align as A
from lodestone.operators import align_blocks as B
from lodestone.operators import covariance as R
from lodestone.operators import phylogeny as Y
from lodestone.operators import tree_search as X

from .data import table

WIDTH = 60


def _seqs(spark, d):
    """``(id, seq)``: the letters a, c, g and t of each text, in capitals."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.upper(F.regexp_replace("text", "[^acgt]", "")).alias("seq"))


_SEQS = "s AS MATERIALIZED (SELECT doc_id AS id, upper(regexp_replace(text, '[^acgt]', '', 'g')) AS seq FROM documents)"


def _aligned(spark, d):
    """``(id, seq)``: a short aligned row over ACGT and gaps for each nation, from arithmetic on its key."""
    keys = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    sym = lambda j: F.element_at(F.array(*[F.lit(c) for c in "ACGT-"]), ((j * j + j * F.col("id") % 7 + F.col("id") * j % 3) % 5 + 1).cast("int"))
    return keys.select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), sym), "").alias("seq"))


_ALIGNED = f"""c AS MATERIALIZED (SELECT n_nationkey AS id, j::INT AS pos, substr('ACGT-', ((j * j + j * n_nationkey % 7 + n_nationkey * j % 3) % 5 + 1)::INT, 1) AS sym
FROM nation, range({WIDTH}) r(j))"""


def seq_revcomp(spark, d):
    return _seqs(spark, d).select("id", F.md5(S.reverse_complement(F.col("seq"))).alias("md5"))


def seq_translate(spark, d):
    return _seqs(spark, d).select("id", F.md5(S.translate(F.col("seq"))).alias("md5"))


def seq_gc_share(spark, d):
    return _seqs(spark, d).select("id", F.round(S.gc_share(F.col("seq")), 9).alias("gc"))


def seq_gc_windows(spark, d):
    return A.gc_histogram(_seqs(spark, d), 100)


def seq_stats(spark, d):
    return A.statistics(_seqs(spark, d)).withColumn("mean", F.round("mean", 6))


def seq_chunks(spark, d):
    return A.chunks(_seqs(spark, d), 100, 20)


def seq_pattern(spark, d):
    hits = F.size(F.expr(f"regexp_extract_all(seq, '{S.degenerate_pattern('GANTC')}', 0)"))
    return _seqs(spark, d).select("id", hits.alias("hits"))


def seq_identity_pairs(spark, d):
    return A.identity_pairs(_aligned(spark, d)).withColumn("identity", F.round("identity", 9))


def seq_consensus(spark, d):
    return A.consensus(_aligned(spark, d))


def seq_pb_weights(spark, d):
    return A.position_weights(_aligned(spark, d)).withColumn("weight", F.round("weight", 9))


def seq_ungapped_columns(spark, d):
    return A.drop_gap_columns(_aligned(spark, d), reference=1)


def seq_bootstrap(spark, d):
    """Three alignments of drawn columns: how many columns each has, and how many of them are columns of the original."""
    rows = _aligned(spark, d)

    def whole(c, *by):
        return c.groupBy(*by, "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "sym"))), lambda x: x["sym"]), "").alias("column"))

    drawn = A.bootstrap_columns(rows, 3, seed=5)
    drawn = whole(drawn.select("rep", "id", F.posexplode(F.split("seq", "")).alias("pos", "sym")).where("sym <> ''"), "rep")
    known = whole(A.columns(rows)).select("column").distinct().withColumn("known", F.lit(1))
    return drawn.join(known, "column", "left").groupBy("rep").agg(F.count("*").alias("columns"), F.count("known").alias("known"))


def _pairs(spark, d):
    s = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("seq"))
    a, b = s.select(F.col("id").alias("a_id"), F.col("seq").alias("a")), s.select(F.col("id").alias("b_id"), F.col("seq").alias("b"))
    return a.join(b, F.col("a_id") < F.col("b_id"))


def seq_local_alignment(spark, d):
    return A.align_pairs(_pairs(spark, d), k=2)


def seq_global_alignment(spark, d):
    return A.global_pairs(_pairs(spark, d))


def seq_blocked_alignment(spark, d):
    """Alignments in blocks of five cells: their scores, and whether what they render is worth as much and lies where they say."""
    found = B.align_long(_pairs(spark, d), 5)
    names = table(spark, d, "nation")
    found = found.join(names.select(F.col("n_nationkey").alias("a_id"), F.col("n_name").alias("a")), "a_id").join(names.select(F.col("n_nationkey").alias("b_id"), F.col("n_name").alias("b")), "b_id")

    def check(batches):
        for batch in batches:
            worth = [B.alignment_score(x, y) == v for x, y, v in zip(batch["aligned_a"], batch["aligned_b"], batch["score"])]
            lies = [x.replace("-", "") == r[s:e] and y.replace("-", "") == q[t:u] for x, y, r, q, s, e, t, u in zip(*(batch[c] for c in ("aligned_a", "aligned_b", "a", "b", "start_a", "end_a", "start_b", "end_b")))]
            yield batch.assign(ok=[p and q for p, q in zip(worth, lies)])[["a_id", "b_id", "score", "ok"]]

    return found.mapInPandas(check, "a_id long, b_id long, score double, ok boolean")


def seq_overlap_removal(spark, d):
    hits = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("seq_id"), (F.col("l_partkey") % 997).alias("start"), (F.col("l_partkey") % 997 + F.col("l_quantity")).cast("long").alias("end"),
        F.col("l_extendedprice").alias("score"),
    )
    return A.remove_overlaps(hits)


def seq_shuffle(spark, d):
    """Shuffled sequences have the symbols of their own, and for long ones another order.

    Where fewer than eight symbols differ from the most common one there are few orders (of a single symbol: one), and
    a shuffle may well give the same again.
    """
    rows = _seqs(spark, d)
    made = A.shuffled(rows, seed=1).withColumnRenamed("seq", "made")
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    both = rows.join(made, "id")
    others = F.least(*[F.length(F.replace("seq", F.lit(c))) for c in "ACGT"])
    moved = (F.col("seq") != F.col("made")) | (F.length("seq") < 40) | (others < 8)
    return both.select("id", (letters(F.col("seq")) == letters(F.col("made"))).alias("same"), moved.alias("moved"))


def phy_pdist(spark, d):
    return A.pairwise_differences(_aligned(spark, d)).withColumn("p", F.round("p", 9))


def phy_charfreq(spark, d):
    return A.symbol_frequencies(_seqs(spark, d)).withColumn("freq", F.round("freq", 9))


def phy_dedup(spark, d):
    return A.drop_identical(_seqs(spark, d)).select("id")


def phy_bootstrap_splits(spark, d):
    """Splits of five bootstrap trees: every tree has its leaves less three, and none counts more often than there are trees."""
    counts = Y.split_counts(Y.bootstrap_trees(_aligned(spark, d), 5, seed=2))
    return counts.agg(F.sum("n").alias("total"), (F.max("n") <= 5).alias("bounded"))


def phy_site_likelihood(spark, d):
    names = [str(r.id) for r in _aligned(spark, d).select("id").orderBy("id").collect()]
    tree = f"({','.join(f'{n}:0.1' for n in names)});"
    return Y.log_likelihoods(_aligned(spark, d), tree).withColumn("log_likelihood", F.round("log_likelihood", 6))


# --- distances, trees, rates -----------------------------------------------------------------------

_TREE = "((a:0.1,b:0.2):0.15,(c:0.1,d:0.3):0.2,(e:0.25,f:0.1):0.1);"
_OTHER = "((a:0.1,c:0.2):0.15,(b:0.1,d:0.3):0.2,(e:0.25,f:0.1):0.1);"


def phy_distances(spark, d):
    """Distances of all pairs of aligned rows: for equal rates by formula and by likelihood, and for gamma-distributed rates."""
    pairs = A.pairwise_differences(_aligned(spark, d)).collect()
    rows = []
    for r in pairs:
        n = 10000
        counts = np.full((4, 4), r.p * n / 12)
        np.fill_diagonal(counts, (1 - r.p) * n / 4)
        rows.append((r.a, r.b, *(round(v, k) + 0.0 for v, k in ((Y.jukes_cantor(r.p), 5), (Y.likelihood_distance(counts), 3), (Y.gamma_distance(r.p, 0.7), 5)))))
    return spark.createDataFrame(rows, "a long, b long, formula double, likelihood double, gamma double")


def phy_joining(spark, d):
    """Joining finds the tree from its own path lengths, and keeps the splits of a constraint it wouldn't find."""
    true = Y.parse_newick(_TREE)
    names = sorted(true.leaves())
    paths = Y.path_distances(true)
    m = np.array([[0.0 if a == b else paths[min(a, b), max(a, b)] for b in names] for a in names])
    joined, linked = Y.neighbour_joining(names, m), Y.hierarchy(names, m, "mean")
    back = Y.path_distances(joined)
    constraint = Y.parse_newick("((a,c),(b,d),(e,f));")
    bound = X.constrained_joining(names, m, constraint)
    rows = [
        ("same topology", Y.same_topology(true, joined)), ("same lengths", all(abs(back[k] - v) < 1e-9 for k, v in paths.items())), ("constraint kept", Y.satisfies(bound, constraint)),
        ("constraint not met before", not Y.satisfies(joined, constraint)), ("all leaves linked", sorted(linked.leaves()) == names), ("single", sorted(Y.hierarchy(names, m, "min").leaves()) == names),
    ]
    return spark.createDataFrame([(n, bool(v)) for n, v in rows], "name string, holds boolean")


def phy_tree_tools(spark, d):
    """Paths, splits and neighbours of a tree of six leaves."""
    tree, other = Y.parse_newick(_TREE), Y.parse_newick(_OTHER)
    rows = [(f"path {a}-{b}", round(v, 6)) for (a, b), v in sorted(Y.path_distances(tree).items())]
    rows += [("splits", float(len(Y.splits(tree)))), ("neighbours", float(len(Y.neighbour_interchanges(tree)))), ("shared splits", float(len(Y.splits(tree) & Y.splits(other)))),
             ("compatible", float(sum(Y.compatible(a, b) for a in Y.splits(tree) for b in Y.splits(other)))), ("round trip", float(Y.same_topology(tree, Y.parse_newick(Y.write_newick(tree)))))]
    return spark.createDataFrame(rows, "name string, value double")


def _star(spark, d):
    names = [str(r.id) for r in _aligned(spark, d).select("id").orderBy("id").collect()]
    return f"({','.join(f'{n}:0.1' for n in names)});"


def phy_site_rates(spark, d):
    return Y.site_rates(_aligned(spark, d), _star(spark, d)).select("pos", "ml_rate", F.round("eb_rate", 5).alias("eb_rate"))


def phy_simulation(spark, d):
    """Differences of simulated leaves within four standard errors of what the paths between them say."""
    n = 4000
    rows = {r.id: r.seq for r in Y.simulate(spark, _TREE, n, seed=4).collect()}
    out = []
    for (a, b), t in sorted(Y.path_distances(Y.parse_newick(_TREE)).items()):
        want = 0.75 * (1 - math.exp(-4 * t / 3))
        found = sum(x != y for x, y in zip(rows[a], rows[b])) / n
        out.append((a, b, bool(abs(found - want) < 4 * math.sqrt(want * (1 - want) / n))))
    return spark.createDataFrame(out, "a string, b string, close boolean")


def phy_search(spark, d):
    """From a wrong tree, exchanges of neighbours with optimised lengths reach the tree that the data came from, and its lengths."""
    data = Y.simulate(spark, _TREE, 3000, seed=5)
    start = spark.createDataFrame([(_OTHER,)], "newick string")
    r = X.restarts(data, start).first()
    found, true = Y.parse_newick(r.newick), Y.parse_newick(_TREE)
    paths, want = Y.path_distances(found), Y.path_distances(true)
    better = r.log_likelihood >= X.log_likelihood(true, X.patterns(data)) - 1e-3
    return spark.createDataFrame([(Y.same_topology(found, true), bool(max(abs(paths[k] - v) for k, v in want.items()) < 0.08), bool(better))], "topology boolean, lengths boolean, likelihood boolean")


def phy_co_occurrence(spark, d):
    """Expected pairs of states along the branch to one of two leaves, from the aligned rows of nations 1 and 2."""
    two = _aligned(spark, d).where("id in (1, 2)").withColumn("id", F.concat(F.lit("n"), "id"))
    found = X.co_occurrence(Y.parse_newick("(n1:0.2,n2:0.3);"), "n1", X.patterns(two), (0.5, 1.5))
    return spark.createDataFrame([(r, "ACGT"[i], "ACGT"[j], round(float(found[r, i, j]), 6)) for r in range(2) for i in range(4) for j in range(4)], "rate int, parent string, child string, n double")


def phy_models(spark, d):
    """Transition probabilities: equal rates by formula, the two-rate model with equal frequencies and one rate is the same, rows sum to one, and the chain is reversible."""
    rows = []
    hky = Y.hky_rate_matrix([0.25] * 4, 1.0)
    skew = Y.hky_rate_matrix([0.1, 0.2, 0.3, 0.4], 3.0)
    for t in (0.05, 0.5, 2.0):
        p, q, s = Y.transition(t), Y.exponential(hky, t), Y.exponential(skew, t)
        flow = np.diag([0.1, 0.2, 0.3, 0.4]) @ s
        rows.append((t, round(float(p[0, 0]), 8), round(float(p[0, 1]), 8), bool(np.allclose(p, q)), bool(np.allclose(s.sum(axis=1), 1)), bool(np.allclose(flow, flow.T))))
    return spark.createDataFrame(rows, "t double, same_state double, other_state double, equal boolean, sums boolean, reversible boolean")


# --- structured RNA --------------------------------------------------------------------------------

_STEM, _STEM_PAIRS = "GGCAAUGCC", "<<<...>>>"


def _rna(spark, d):
    return _seqs(spark, d).select("id", F.translate("seq", "T", "U").alias("seq"))


def rna_ungapped(spark, d):
    """The best window of each sequence under a model of a stem that may neither lose nor gain a base."""
    model = R.Model(_STEM, _STEM_PAIRS, R.simple_scores(gap=-1e6, insert=-1e6))
    found = R.best_scores(_rna(spark, d), model, len(_STEM))
    return found.select("id", F.when(F.col("score") > -1e5, F.col("score")).otherwise(F.lit(-999.0)).alias("score"))


def rna_search(spark, d):
    """Hits of the stem with bases lost or gained, found in chunks, without overlaps."""
    return R.search(_rna(spark, d), R.Model(_STEM, _STEM_PAIRS, R.simple_scores()), 12.0, 14)


def rna_alignment(spark, d):
    """The query aligned to itself, to itself without a base, and to a stem with other pairs."""
    model = R.Model(_STEM, _STEM_PAIRS, R.simple_scores())
    rows = []
    for s in ("GGCAAUGCC", "GGCAUGCC", "GCCAAUGGC", "GGCAAAUGCC"):
        score, aligned, structure = model.align(s)
        rows.append((s, score, aligned.replace("-", "").upper() == s and len(aligned) == len(structure), structure.replace(".", ""), aligned.count("-"), sum(c.islower() for c in aligned)))
    return spark.createDataFrame(rows, "target string, score double, whole boolean, pairs string, lost int, gained int")


def rna_counts(spark, d):
    """Substitutions of single and paired columns between aligned rows that agree in a third or more of their symbols."""
    ss = "<" * 10 + "." * 20 + ">" * 10 + "." * 20
    return R.substitution_counts(_aligned(spark, d), ss, 0.34)


def rna_log_odds(spark, d):
    """Scores from the counts are symmetric where the counts are, and their expectation under the joint shares is positive."""
    s = R.log_odds(rna_counts(spark, d))
    p = s.single
    return spark.createDataFrame([(bool(np.allclose(p, p.T)), bool(np.allclose(s.pair, s.pair.transpose(2, 3, 0, 1))), bool(np.isfinite(p).all()))], "single boolean, pair boolean, finite boolean")


def rna_calibration(spark, d):
    """Extreme value distributions of random sequences by GC share: locations are finite, scales positive, for each share."""
    model = R.Model(_STEM, _STEM_PAIRS, R.simple_scores())
    fits = R.calibrate(spark, model, 12, samples=40, length=120)
    return fits.select("gc", (F.col("lam") > 0).alias("scale"), F.col("mu").between(0, 30).alias("location"))


QUERIES = {f.__name__: f for f in (
    seq_revcomp, seq_translate, seq_gc_share, seq_gc_windows, seq_stats, seq_chunks, seq_pattern, seq_identity_pairs, seq_consensus, seq_pb_weights,
    seq_ungapped_columns, seq_bootstrap, seq_local_alignment, seq_global_alignment, seq_overlap_removal, seq_shuffle, phy_pdist, phy_charfreq,
    phy_dedup, phy_bootstrap_splits, phy_site_likelihood, phy_distances, phy_joining, phy_tree_tools, phy_site_rates, phy_simulation, phy_search,
    phy_co_occurrence, phy_models, seq_blocked_alignment, rna_ungapped, rna_search, rna_alignment, rna_counts, rna_log_odds, rna_calibration,
)}

_CODE = ", ".join(f"('{k}', '{v}')" for k, v in S.GENETIC_CODE.items())
_E = "exp(-4 * 0.1 / 3)"

ORACLES = {
    "seq_revcomp": f"WITH {_SEQS} SELECT id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS md5 FROM s",
    "seq_translate": f"""WITH {_SEQS}, g(codon, aa) AS (VALUES {_CODE}), k AS (SELECT id, i, substr(seq, (3 * i + 1)::INT, 3) AS codon FROM (SELECT id, seq, unnest(range(length(seq) // 3)) AS i FROM s))
SELECT s.id, md5(coalesce(p, '')) AS md5 FROM s LEFT JOIN (SELECT id, string_agg(aa, '' ORDER BY i) AS p FROM k JOIN g USING (codon) GROUP BY id) USING (id)""",
    "seq_gc_share": f"WITH {_SEQS} SELECT id, round(CASE WHEN length(seq) > 0 THEN length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) ELSE 0 END, 9) AS gc FROM s",
    "seq_gc_windows": f"""WITH {_SEQS}, w AS (SELECT seq, unnest(range(length(seq) // 100)) AS i FROM s)
SELECT length(regexp_replace(substr(seq, (100 * i + 1)::INT, 100), '[^GC]', '', 'g'))::INT AS gc, count(*) AS n FROM w GROUP BY 1""",
    "seq_stats": f"WITH {_SEQS} SELECT count(*) AS n, sum(length(seq))::BIGINT AS residues, min(length(seq))::INT AS shortest, max(length(seq))::INT AS longest, round(avg(length(seq)), 6) AS mean FROM s",
    "seq_chunks": f"""WITH {_SEQS}, w AS (SELECT id, seq, unnest(range(0, greatest(length(seq) - 21, 0) + 1, 80)) AS start FROM s)
SELECT id, start::INT AS start, substr(seq, (start + 1)::INT, 100) AS chunk FROM w""",
    "seq_pattern": f"WITH {_SEQS} SELECT id, len(regexp_extract_all(seq, 'GA[ACGT]TC'))::INT AS hits FROM s",
    "seq_identity_pairs": f"""WITH {_ALIGNED}, l AS (SELECT id, count(*) AS n FROM c WHERE sym <> '-' GROUP BY id)
SELECT x.id AS a, y.id AS b, round(count(*) FILTER (x.sym = y.sym AND x.sym <> '-') / least(any_value(p.n), any_value(q.n)), 9) AS identity
FROM c x JOIN c y ON x.pos = y.pos AND x.id < y.id JOIN l p ON p.id = x.id JOIN l q ON q.id = y.id GROUP BY x.id, y.id""",
    "seq_consensus": f"""WITH {_ALIGNED}, n AS (SELECT pos, sym, count(*) AS n FROM c GROUP BY ALL)
SELECT pos, arg_min(sym, (-n, sym)) FILTER (sym <> '-') AS sym FROM n GROUP BY pos HAVING coalesce(sum(n) FILTER (sym = '-'), 0) / sum(n) <= 0.5""",
    "seq_pb_weights": f"""WITH {_ALIGNED}, u AS (SELECT * FROM c WHERE sym <> '-'), n AS (SELECT pos, sym, count(*) AS n FROM u GROUP BY ALL), k AS (SELECT pos, count(*) AS k FROM n GROUP BY pos),
w AS (SELECT id, sum(1 / (k * n)) / count(*) AS w FROM u JOIN n USING (pos, sym) JOIN k USING (pos) GROUP BY id)
SELECT id, round(w * (SELECT count(*) FROM w) / (SELECT sum(w) FROM w), 9) AS weight FROM w""",
    "seq_ungapped_columns": f"""WITH {_ALIGNED} SELECT id, string_agg(sym, '' ORDER BY pos) AS seq FROM c WHERE pos NOT IN (SELECT pos FROM c WHERE id = 1 AND sym = '-') GROUP BY id""",
    "phy_pdist": f"""WITH {_ALIGNED} SELECT x.id AS a, y.id AS b, round(avg(CASE WHEN x.sym <> y.sym THEN 1.0 ELSE 0 END), 9) AS p
FROM c x JOIN c y ON x.pos = y.pos AND x.id < y.id AND x.sym <> '-' AND y.sym <> '-' GROUP BY x.id, y.id""",
    "phy_charfreq": f"""WITH {_SEQS}, u AS (SELECT unnest(string_split(seq, '')) AS sym FROM s) SELECT sym, count(*) AS n, round(count(*) / (SELECT count(*) FROM u WHERE sym <> ''), 9) AS freq FROM u WHERE sym <> '' GROUP BY sym""",
    "phy_dedup": f"WITH {_SEQS} SELECT min(id) AS id FROM s GROUP BY seq",
    "phy_site_likelihood": f"""WITH {_ALIGNED}, st(x) AS (VALUES ('A'), ('C'), ('G'), ('T')),
l AS (SELECT pos, x, exp(sum(ln(CASE WHEN sym = '-' THEN 1 WHEN sym = x THEN 0.25 + 0.75 * {_E} ELSE (1 - {_E}) / 4 END))) AS l FROM c CROSS JOIN st GROUP BY pos, x)
SELECT pos, round(ln(avg(l)), 6) AS log_likelihood FROM l GROUP BY pos""",
    "seq_global_alignment": """WITH RECURSIVE s AS MATERIALIZED (SELECT x.n_nationkey AS a_id, y.n_nationkey AS b_id, x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey),
r(a_id, b_id, i, h) AS (SELECT a_id, b_id, 0, list_transform(range(length(b) + 1), lambda j: (-4 * j)::DOUBLE) FROM s UNION ALL
SELECT q.a_id, q.b_id, i + 1, list_transform(range(len(t)), lambda j: list_max(list_transform(t[1:j + 1], lambda v, k: v - 4 * (j + 1 - k)))) FROM (
SELECT r.a_id, r.b_id, i, list_concat([(-4 * (i + 1))::DOUBLE], list_transform(range(1, len(h)), lambda j: greatest(h[j] + CASE WHEN substr(a, i + 1, 1) = substr(b, j::INT, 1) THEN 5 ELSE -4 END, h[j + 1] - 4)::DOUBLE)) AS t
FROM r JOIN s ON s.a_id = r.a_id AND s.b_id = r.b_id WHERE i < length(a)) q)
SELECT r.a_id, r.b_id, h[len(h)] AS score FROM r JOIN s ON s.a_id = r.a_id AND s.b_id = r.b_id WHERE i = length(a)""",
    "phy_distances": f"""WITH {_ALIGNED}, p AS (SELECT x.id AS a, y.id AS b, avg(CASE WHEN x.sym <> y.sym THEN 1.0 ELSE 0 END) AS p FROM c x JOIN c y ON x.pos = y.pos AND x.id < y.id AND x.sym <> '-' AND y.sym <> '-' GROUP BY x.id, y.id)
SELECT a, b, CASE WHEN p >= 0.75 * 0.999 THEN 5.0 ELSE round(-0.75 * ln(1 - p / 0.75), 5) + 0.0 END AS formula, CASE WHEN p >= 0.75 * 0.999 THEN 5.0 ELSE round(-0.75 * ln(1 - p / 0.75), 3) + 0.0 END AS likelihood,
CASE WHEN p >= 0.75 * 0.999 THEN 5.0 ELSE round(0.75 * 0.7 * ((1 - p / 0.75) ** (-1 / 0.7) - 1), 5) + 0.0 END AS gamma FROM p""",
    "phy_joining": "SELECT name, true AS holds FROM (VALUES ('same topology'), ('same lengths'), ('constraint kept'), ('constraint not met before'), ('all leaves linked'), ('single')) t(name)",
    "phy_tree_tools": """WITH l(n, g, len, up) AS (VALUES ('a', 1, 0.1, 0.15), ('b', 1, 0.2, 0.15), ('c', 2, 0.1, 0.2), ('d', 2, 0.3, 0.2), ('e', 3, 0.25, 0.1), ('f', 3, 0.1, 0.1))
SELECT 'path ' || x.n || '-' || y.n AS name, round(x.len + y.len + CASE WHEN x.g = y.g THEN 0 ELSE x.up + y.up END, 6)::DOUBLE AS value FROM l x JOIN l y ON x.n < y.n
UNION ALL SELECT * FROM (VALUES ('splits', 3.0), ('neighbours', 6.0), ('shared splits', 1.0), ('compatible', 5.0), ('round trip', 1.0)) t(name, value)""",
    "phy_site_rates": f"""WITH {_ALIGNED}, st(x) AS (VALUES ('A'), ('C'), ('G'), ('T')), g(rate) AS (VALUES (0.05), (0.1), (0.2), (0.4), (0.7), (1.0), (1.5), (2.5), (4.0), (8.0)), e AS (SELECT rate::DOUBLE AS rate, exp(-4 * 0.1 * rate / 3) AS e FROM g),
l AS (SELECT pos, rate, x, exp(sum(ln(CASE WHEN sym = '-' THEN 1 WHEN sym = x THEN 0.25 + 0.75 * e ELSE (1 - e) / 4 END))) AS l FROM c CROSS JOIN st CROSS JOIN e GROUP BY ALL), s AS (SELECT pos, rate, avg(l) AS l FROM l GROUP BY 1, 2)
SELECT pos, min(rate) FILTER (l >= m * (1 - 1e-12)) AS ml_rate, round(sum(rate * l) / sum(l), 5) AS eb_rate FROM (SELECT *, max(l) OVER (PARTITION BY pos) AS m FROM s) GROUP BY pos""",
    "phy_simulation": "SELECT x.n AS a, y.n AS b, true AS close FROM (VALUES ('a'), ('b'), ('c'), ('d'), ('e'), ('f')) x(n) JOIN (VALUES ('a'), ('b'), ('c'), ('d'), ('e'), ('f')) y(n) ON x.n < y.n",
    "phy_search": "SELECT true AS topology, true AS lengths, true AS likelihood",
    "phy_co_occurrence": f"""WITH {_ALIGNED}, st(x, i) AS (VALUES ('A', 0), ('C', 1), ('G', 2), ('T', 3)), g(rate, f) AS (VALUES (0, 0.5), (1, 1.5)),
t AS (SELECT rate, exp(-4 * 0.2 * f / 3) AS e1, exp(-4 * 0.3 * f / 3) AS e2 FROM g), q AS (SELECT a.pos, a.sym AS s1, b.sym AS s2 FROM c a JOIN c b ON a.pos = b.pos AND a.id = 1 AND b.id = 2),
w AS (SELECT pos, rate, p.x AS parent, k.x AS child, (CASE WHEN p.x = k.x THEN 0.25 + 0.75 * e1 ELSE (1 - e1) / 4 END) * (CASE WHEN s1 = '-' OR s1 = k.x THEN 1 ELSE 0 END) * (CASE WHEN s2 = '-' THEN 1 WHEN s2 = p.x THEN 0.25 + 0.75 * e2 ELSE (1 - e2) / 4 END) AS w
FROM q, t, st p, st k), n AS (SELECT *, w / sum(w) OVER (PARTITION BY pos) AS n FROM w) SELECT rate, parent, child, round(sum(n), 6) AS n FROM n GROUP BY 1, 2, 3""",
    "phy_models": "SELECT t::DOUBLE AS t, round(0.25 + 0.75 * exp(-4 * t / 3), 8) AS same_state, round(0.25 - 0.25 * exp(-4 * t / 3), 8) AS other_state, true AS equal, true AS sums, true AS reversible FROM (VALUES (0.05), (0.5), (2.0)) v(t)",
    "seq_blocked_alignment": """WITH RECURSIVE s AS MATERIALIZED (SELECT x.n_nationkey AS a_id, y.n_nationkey AS b_id, x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey),
r(a_id, b_id, i, h, f, best) AS (SELECT a_id, b_id, 0, list_transform(range(length(b) + 1), lambda j: 0::DOUBLE), list_transform(range(length(b) + 1), lambda j: -1e9::DOUBLE), 0::DOUBLE FROM s UNION ALL
SELECT a_id, b_id, i + 1, h2, f2, greatest(best, list_max(h2)) FROM (SELECT *, list_transform(range(len(g)), lambda j: greatest(g[j + 1], coalesce(list_max(list_transform(g[1:j], lambda v, k: v - 12 - 4 * (j - k))), 0))) AS h2 FROM (
SELECT *, list_concat([0::DOUBLE], list_transform(range(1, len(h)), lambda j: greatest(0, h[j] + CASE WHEN substr(a, i + 1, 1) = substr(b, j::INT, 1) THEN 5 ELSE -4 END, f2[j + 1])::DOUBLE)) AS g FROM (
SELECT r.*, a, b, list_transform(range(len(h)), lambda j: greatest(h[j + 1] - 12, f[j + 1] - 4)) AS f2 FROM r JOIN s ON s.a_id = r.a_id AND s.b_id = r.b_id WHERE i < length(a)))))
SELECT r.a_id, r.b_id, best AS score, true AS ok FROM r JOIN s ON s.a_id = r.a_id AND s.b_id = r.b_id WHERE i = length(a)""",
    "rna_ungapped": f"""WITH {_SEQS}, w AS (SELECT id, i, replace(substr(seq, (i + 1)::INT, 9), 'T', 'U') AS w FROM (SELECT id, seq, unnest(range(length(seq) - 8)) AS i FROM s WHERE length(seq) >= 9)),
p AS (SELECT id, i, w, k, substr(w, k + 1, 1) || substr(w, 9 - k, 1) AS xy, substr('GGC', k + 1, 1) || substr('GCC', 3 - k, 1) AS ab FROM w, (VALUES (0), (1), (2)) t(k)),
q AS (SELECT id, i, sum(CASE WHEN xy IN ('AU', 'UA', 'CG', 'GC', 'GU', 'UG') THEN 3.0 ELSE -3.0 END + CASE WHEN xy = ab AND xy IN ('AU', 'UA', 'CG', 'GC', 'GU', 'UG') THEN 1 ELSE 0 END) AS s FROM p GROUP BY 1, 2),
u AS (SELECT w.id, s + CASE WHEN substr(w, 4, 1) = 'A' THEN 2 ELSE -1 END + CASE WHEN substr(w, 5, 1) = 'A' THEN 2 ELSE -1 END + CASE WHEN substr(w, 6, 1) = 'U' THEN 2 ELSE -1 END AS s FROM w JOIN q ON q.id = w.id AND q.i = w.i)
SELECT s.id, coalesce(max(u.s), -999)::DOUBLE AS score FROM s LEFT JOIN u USING (id) GROUP BY s.id""",
    "rna_alignment": """SELECT target, score, true AS whole, '<<<>>>' AS pairs, lost, gained
FROM (VALUES ('GGCAAUGCC', 18.0::DOUBLE, 0, 0), ('GGCAUGCC', 13.0, 1, 0), ('GCCAAUGGC', 17.0, 0, 0), ('GGCAAAUGCC', 16.0, 0, 1)) t(target, score, lost, gained)""",
    "rna_counts": f"""WITH {_ALIGNED}, l AS (SELECT id, count(*) AS n FROM c WHERE sym <> '-' GROUP BY id),
q AS (SELECT x.id AS a, y.id AS b FROM c x JOIN c y ON x.pos = y.pos AND x.id < y.id JOIN l p ON p.id = x.id JOIN l s ON s.id = y.id GROUP BY x.id, y.id HAVING count(*) FILTER (x.sym = y.sym AND x.sym <> '-') / least(any_value(p.n), any_value(s.n)) >= 0.34),
m AS (SELECT x.id, x.pos, CASE WHEN x.pos < 10 THEN 'pair' ELSE 'single' END AS kind, x.sym || coalesce(y.sym, '') AS s FROM c x LEFT JOIN c y ON y.id = x.id AND y.pos = 39 - x.pos AND x.pos < 10 WHERE x.pos < 30 OR x.pos >= 40),
n AS (SELECT * FROM m WHERE s NOT LIKE '%-%'), t AS (SELECT x.kind, x.s AS x, y.s AS y FROM q JOIN n x ON x.id = a JOIN n y ON y.id = b AND y.pos = x.pos)
SELECT kind, x, y, count(*)::DOUBLE AS n FROM (SELECT * FROM t UNION ALL SELECT kind, y, x FROM t) GROUP BY 1, 2, 3""",
    "rna_log_odds": "SELECT true AS single, true AS pair, true AS finite",
    "rna_calibration": "SELECT gc::BIGINT AS gc, true AS scale, true AS location FROM (VALUES (30), (50), (70)) t(gc)",
    "seq_bootstrap": f"SELECT rep, {WIDTH} AS columns, {WIDTH} AS known FROM range(3) r(rep)",
    "seq_shuffle": "SELECT doc_id AS id, true AS same, true AS moved FROM documents",
    "phy_bootstrap_splits": "SELECT 5 * (count(*) - 3) AS total, true AS bounded FROM nation",
    "seq_overlap_removal": """WITH RECURSIVE h AS MATERIALIZED (SELECT l_suppkey AS seq_id, l_partkey % 997 AS s, (l_partkey % 997 + l_quantity)::BIGINT AS e, l_extendedprice AS v,
row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_partkey % 997 DESC, l_quantity DESC) AS k FROM lineitem),
r(seq_id, k, kept) AS (SELECT DISTINCT seq_id, 0::BIGINT, []::STRUCT(s BIGINT, e BIGINT, v DOUBLE)[] FROM h UNION ALL
SELECT r.seq_id, h.k, CASE WHEN len(list_filter(kept, lambda x: x.s <= h.e AND x.e >= h.s)) > 0 THEN kept ELSE list_append(kept, {'s': h.s, 'e': h.e, 'v': h.v}) END FROM r JOIN h ON h.seq_id = r.seq_id AND h.k = r.k + 1),
l AS (SELECT seq_id, unnest(kept) AS x FROM r WHERE (seq_id, k) IN (SELECT seq_id, max(k) FROM h GROUP BY seq_id)) SELECT seq_id, x.s AS start, x.e AS "end", x.v AS score FROM l""",
}
