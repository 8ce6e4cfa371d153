"""Registered queries of clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import cluster as C

from .data import points, points_sql

D = 3
CENTRES = ((0.1, 0.1, 0.1), (-0.1, 0.0, 0.1), (0.0, -0.1, -0.1), (0.1, -0.1, 0.0))
K, HOPS = 12, 8


def _points(spark, d):
    return points(spark, d, D).select("id", "x")


def _r(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def km_assign(spark, d):
    return _r(C.assign(_points(spark, d), CENTRES).select("id", "cluster", "d2"), "d2")


def km_one_iteration(spark, d):
    moved = C.means(C.assign(_points(spark, d), CENTRES), D, len(CENTRES))
    return spark.createDataFrame([(c, n, *[round(v, 6) for v in m]) for c, (n, m) in sorted(moved.items())], "cluster int, n long, x0 double, x1 double, x2 double")


def kmeans_full(spark, d):
    _, assigned = C.kmeans(_points(spark, d), CENTRES)
    return assigned.select("id", "cluster")


def kmeans_zscored(spark, d):
    z = C.zscore(_points(spark, d), D)
    return _r(z.select("id", *[F.col("x")[i].alias(f"x{i}") for i in range(D)]), "x0", "x1", "x2")


def fuzzy_membership(spark, d):
    u = C.memberships(_points(spark, d), CENTRES, 2.0)
    return u.select("id", *[F.round(F.col("u")[i], 6).alias(f"u{i}") for i in range(len(CENTRES))])


def fuzzy_centres(spark, d):
    found = C.fuzzy_cmeans(_points(spark, d), CENTRES, max_loops=10)
    return spark.createDataFrame([(i, *c) for i, c in enumerate(found)], "cluster int, x0 double, x1 double, x2 double")


def xie_beni_variant(spark, d):
    return _r(C.fuzzy_validity(_points(spark, d), CENTRES, 2.0).drop("n"), "compactness", "separation", "penalty", "xie_beni_variant")


def _features(spark, d):
    return C.features(points(spark, d, D), "label", D)


def cf_summary(spark, d):
    f = _features(spark, d)
    out = f.select("label", "n", *[F.col("sx")[i].alias(f"s{i}") for i in range(D)], "sxx", V.cf_radius2(F.col("n"), F.col("sx"), F.col("sxx")).alias("r2"), V.cf_diameter2(F.col("n"), F.col("sx"), F.col("sxx")).alias("d2"))
    return _r(out, "s0", "s1", "s2", "sxx", "r2", "d2")


def cf_distances(spark, d):
    f = _features(spark, d)
    a, b = f.alias("l"), f.alias("r")
    side = lambda s: (F.col(f"{s}.n"), F.col(f"{s}.sx"), F.col(f"{s}.sxx"))
    kinds = ("D0", "D1", "D2", "D3", "D4")
    pairs = a.join(b, F.col("l.label") < F.col("r.label"))
    return pairs.select(F.col("l.label").alias("a"), F.col("r.label").alias("b"), *[F.round(V.cf_distance(k, side("l"), side("r")), 6).alias(k.lower()) for k in kinds])


def cf_quality(spark, d):
    return _r(C.quality(_features(spark, d)), "average_diameter", "average_radius")


def cf_merge(spark, d):
    f = _features(spark, d).withColumn("half", F.col("label") % 2)
    out = C.merge_features(f, "half", D)
    return _r(out.select("half", "n", F.col("sx")[0].alias("s0"), "sxx"), "s0", "sxx")


def birch_labels(spark, d):
    _, assigned = C.birch(_points(spark, d), D, 5, limit=100)
    return assigned.select("id", "cluster")


def cf_density(spark, d):
    return _r(C.kernel_density(_features(spark, d), _points(spark, d), 0.05, D), "density")


def hop_neighbours(spark, d):
    return _r(C.nearest_neighbours(_points(spark, d), K, D), "d2")


def hop_radius_join(spark, d):
    p = _points(spark, d)
    return C.within(p, p, D, 0.05).groupBy("id").agg(F.count("*").alias("n"))


def hop_knn_density(spark, d):
    return C.spline_density(C.nearest_neighbours(_points(spark, d), K, D)).withColumn("density", F.round("density", 4))


def _hop(spark, d):
    near = C.nearest_neighbours(_points(spark, d), K, D)
    dense = C.level(C.spline_density(near).withColumn("density", F.round("density", 4)))
    return near, dense, C.hop(near, dense, HOPS)


def hop_densest_neighbor(spark, d):
    return _hop(spark, d)[2]


def hop_groups(spark, d):
    return C.follow(_hop(spark, d)[2])


def hop_group_sizes(spark, d):
    _, dense, pointers = _hop(spark, d)
    return C.group_sizes(C.follow(pointers), dense)


def hop_boundaries(spark, d):
    near, dense, pointers = _hop(spark, d)
    return C.boundaries(near, C.follow(pointers), dense, 5).withColumn("saddle", F.round("saddle", 6))


def hop_regroup(spark, d):
    near, dense, pointers = _hop(spark, d)
    groups = C.follow(pointers)
    return C.regroup(C.group_sizes(groups, dense), C.boundaries(near, groups, dense, 5), 0.0, 0.0)


def box_counting(spark, d):
    return C.box_counts(_points(spark, d), D, (0.05, 0.1, 0.2))


QUERIES = {f.__name__: f for f in (
    km_assign, km_one_iteration, kmeans_full, kmeans_zscored, fuzzy_membership, fuzzy_centres, xie_beni_variant, cf_summary, cf_distances,
    cf_quality, cf_merge, birch_labels, cf_density, hop_neighbours, hop_radius_join, hop_knn_density, hop_densest_neighbor, hop_groups,
    hop_group_sizes, hop_boundaries, hop_regroup, box_counting,
)}

_PTS = f"p AS MATERIALIZED (SELECT id, x[1] AS x0, x[2] AS x1, x[3] AS x2, label FROM {points_sql(D)})"
_C = ", ".join(f"({i}, {c[0]}::DOUBLE, {c[1]}::DOUBLE, {c[2]}::DOUBLE)" for i, c in enumerate(CENTRES))
_CEN = f"c(cluster, c0, c1, c2) AS (VALUES {_C})"
_D2 = "((x0 - c0) * (x0 - c0) + (x1 - c1) * (x1 - c1) + (x2 - c2) * (x2 - c2))"
_DIST = f"{_PTS}, {_CEN}, d AS (SELECT id, x0, x1, x2, cluster, {_D2} AS d2 FROM p CROSS JOIN c)"
_ASSIGN = f"{_DIST}, a AS (SELECT id, any_value(x0) AS x0, any_value(x1) AS x1, any_value(x2) AS x2, arg_min(cluster, d2 + cluster * 1e-18) AS cluster, min(d2) AS d2 FROM d GROUP BY id)"
_U = f"{_DIST}, w AS (SELECT id, cluster, d2, 1 / (d2 + 1e-5) AS w FROM d), u AS (SELECT id, cluster, d2, w / (sum(w) OVER (PARTITION BY id) + 1e-5) AS u FROM w)"
_CF = f"""{_PTS}, f AS (SELECT label, count(*) AS n, sum(x0) AS s0, sum(x1) AS s1, sum(x2) AS s2, sum(x0 * x0 + x1 * x1 + x2 * x2) AS sxx FROM p GROUP BY label),
g AS (SELECT *, s0 * s0 + s1 * s1 + s2 * s2 AS ss FROM f)"""
_XY = "((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2))"
_NEAR = f"""{_PTS}, e AS MATERIALIZED (SELECT a.id, b.id AS other, {_XY} AS d2 FROM p a CROSS JOIN p b),
nn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS rank FROM e QUALIFY rank <= {K})"""
_DENS = f"""{_NEAR}, h AS (SELECT id, max(d2) AS h2 FROM nn GROUP BY id),
s AS (SELECT id, other, CASE WHEN 4 * d2 / h2 < 1 THEN 1 - 0.75 * (2 - sqrt(4 * d2 / h2)) * 4 * d2 / h2 ELSE 0.25 * pow(greatest(2 - sqrt(4 * d2 / h2), 0), 3) END
* pow(4 / h2, 1.5) / pi() / 2 AS v FROM nn JOIN h USING (id)),
dens AS MATERIALIZED (SELECT id, round(sum(v), 4) AS density FROM (SELECT id, v FROM s UNION ALL SELECT other, v FROM s) GROUP BY id)"""
_HOP = f"""{_DENS}, nx AS MATERIALIZED (SELECT nn.id, other AS nxt FROM nn JOIN dens ON other = dens.id WHERE rank <= {HOPS}
QUALIFY row_number() OVER (PARTITION BY nn.id ORDER BY density DESC, other) = 1),
w(id, root, step) AS (SELECT id, nxt, 1 FROM nx UNION ALL SELECT w.id, nx.nxt, step + 1 FROM w JOIN nx ON w.root = nx.id WHERE nx.nxt <> w.root),
gr AS MATERIALIZED (SELECT id, arg_max(root, step) AS root FROM w GROUP BY id)"""

ORACLES = {
    "km_assign": f"WITH {_ASSIGN} SELECT id, cluster, round(d2, 6) AS d2 FROM a",
    "km_one_iteration": f"WITH {_ASSIGN} SELECT cluster, count(*) AS n, round(avg(x0), 6) AS x0, round(avg(x1), 6) AS x1, round(avg(x2), 6) AS x2 FROM a GROUP BY cluster",
    "kmeans_zscored": f"WITH {_PTS} SELECT id, " + ", ".join(f"round((x{i} - (SELECT avg(x{i}) FROM p)) / (SELECT stddev_pop(x{i}) FROM p), 6) AS x{i}" for i in range(D)) + " FROM p",
    "fuzzy_membership": f"WITH {_U} SELECT id, " + ", ".join(f"round(max(u) FILTER (cluster = {i}), 6) AS u{i}" for i in range(len(CENTRES))) + " FROM u GROUP BY id",
    "xie_beni_variant": f"""WITH {_U}, v AS (SELECT sum(d2 * u * u) AS compactness, count(DISTINCT id) AS n FROM u),
a AS (SELECT id, arg_min(cluster, d2) AS cluster FROM d GROUP BY id), z AS (SELECT c.cluster, count(a.id) AS m FROM c LEFT JOIN a USING (cluster) GROUP BY c.cluster),
pen AS (SELECT sum(1 / (1 + m)) / {len(CENTRES)} AS penalty FROM z),
gap AS (SELECT a.cluster, min(sqrt(pow(a.c0 - b.c0, 2) + pow(a.c1 - b.c1, 2) + pow(a.c2 - b.c2, 2))) AS g FROM c a JOIN c b ON a.cluster < b.cluster GROUP BY a.cluster),
sep AS (SELECT pow(sum(g) / ({len(CENTRES)} - 1), 2) AS separation FROM gap)
SELECT round(compactness, 6) AS compactness, round(separation, 6) AS separation, round(penalty, 6) AS penalty, round(compactness / (n * separation), 6) AS xie_beni_variant FROM v, pen, sep""",
    "cf_summary": f"""WITH {_CF} SELECT label, n, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2, round(sxx, 6) AS sxx,
round(CASE WHEN n > 1 THEN sxx / n - ss / n / n ELSE 0 END, 6) AS r2, round(CASE WHEN n > 1 THEN 2 * (n * sxx - ss) / (n * (n - 1)) ELSE 0 END, 6) AS d2 FROM g""",
    "cf_distances": f"""WITH {_CF} SELECT a.label AS a, b.label AS b,
round(pow(a.s0 / a.n - b.s0 / b.n, 2) + pow(a.s1 / a.n - b.s1 / b.n, 2) + pow(a.s2 / a.n - b.s2 / b.n, 2), 6) AS d0,
round(abs(a.s0 / a.n - b.s0 / b.n) + abs(a.s1 / a.n - b.s1 / b.n) + abs(a.s2 / a.n - b.s2 / b.n), 6) AS d1,
round((b.n * a.sxx + a.n * b.sxx - 2 * (a.s0 * b.s0 + a.s1 * b.s1 + a.s2 * b.s2)) / (a.n * b.n), 6) AS d2,
round(2 * ((a.n + b.n) * (a.sxx + b.sxx) - pow(a.s0 + b.s0, 2) - pow(a.s1 + b.s1, 2) - pow(a.s2 + b.s2, 2)) / ((a.n + b.n) * (a.n + b.n - 1)), 6) AS d3,
round(a.ss / a.n + b.ss / b.n - (pow(a.s0 + b.s0, 2) + pow(a.s1 + b.s1, 2) + pow(a.s2 + b.s2, 2)) / (a.n + b.n), 6) AS d4 FROM g a JOIN g b ON a.label < b.label""",
    "cf_quality": f"WITH {_CF} SELECT round(sqrt(sum(2 * (n * sxx - ss)) / sum(n * (n - 1))), 6) AS average_diameter, round(sqrt(sum(sxx - ss / n) / sum(n)), 6) AS average_radius FROM g",
    "cf_merge": f"WITH {_PTS} SELECT label % 2 AS half, count(*) AS n, round(sum(x0), 6) AS s0, round(sum(x0 * x0 + x1 * x1 + x2 * x2), 6) AS sxx FROM p GROUP BY 1",
    "cf_density": f"""WITH {_CF}, v AS (SELECT *, greatest(sxx / n - ss / n / n, 0) / 3 + 0.05 * 0.05 AS v FROM g)
SELECT id, round(sum(n * exp(-(pow(x0 - s0 / n, 2) + pow(x1 - s1 / n, 2) + pow(x2 - s2 / n, 2)) / (2 * v)) / pow(2 * pi() * v, 1.5)) / (SELECT sum(n) FROM f), 6) AS density
FROM p CROSS JOIN v GROUP BY id""",
    "hop_neighbours": f"WITH {_NEAR} SELECT id, other, round(d2, 6) AS d2, rank::INT AS rank FROM nn",
    "hop_radius_join": f"WITH {_PTS} SELECT a.id, count(*) AS n FROM p a JOIN p b ON {_XY} <= 0.05::DOUBLE * 0.05::DOUBLE GROUP BY a.id",
    "hop_knn_density": f"WITH {_DENS} SELECT * FROM dens",
    "hop_densest_neighbor": f"WITH RECURSIVE {_HOP} SELECT id, nxt AS next FROM nx",
    "hop_groups": f"WITH RECURSIVE {_HOP} SELECT id, root FROM gr",
    "hop_group_sizes": f"""WITH RECURSIVE {_HOP}, z AS (SELECT root, count(*) AS size, max(density) AS peak FROM gr JOIN dens USING (id) GROUP BY root)
SELECT *, (row_number() OVER (ORDER BY size DESC, root))::INT AS rank FROM z""",
    "hop_boundaries": f"""WITH RECURSIVE {_HOP}, m AS (SELECT * FROM gr JOIN dens USING (id))
SELECT least(x.root, y.root) AS a, greatest(x.root, y.root) AS b, round(max((x.density + y.density) / 2), 6) AS saddle
FROM nn JOIN m x ON nn.id = x.id JOIN m y ON nn.other = y.id WHERE rank <= 5 AND x.root <> y.root GROUP BY ALL""",
    "box_counting": f"WITH {_PTS} SELECT size, count(DISTINCT (floor(x0 / size), floor(x1 / size), floor(x2 / size))) AS boxes FROM p, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) s(size) GROUP BY size",
}
