"""Frequent patterns: level-wise, vertical and difference-set mining, maximal sets, cliques, sequences, noise-tolerant and utility sets.

Baskets are ``(tid, item)`` rows, distinct. Itemsets are ascending arrays of
items. The minimum count is ``max(2, floor(share x baskets + 0.5))``.

Mining starts with ``condensed`` baskets ``(tid, item, w)``: equal ones are one
with their number as weight, so the work grows with the different baskets.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.table import numbered
from lodestone.plans.levels import level

#: Candidate tables up to this many rows may be broadcast to the basket side.
MAX_BROADCAST = 200_000


def minimum_count(n_baskets: int, share: float) -> int:
    return max(2, math.floor(share * n_baskets + 0.5))


def condensed(baskets: DataFrame) -> DataFrame:
    """``(tid, item, w)``: of equal baskets the one with the least id, and their number; written once."""
    if "w" in baskets.columns:
        return baskets
    whole = baskets.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("item"))).alias("_items"))
    one = whole.groupBy("_items", F.isnull("tid").alias("_none")).agg(F.min("tid").alias("tid"), F.count("*").alias("w"))
    return level(one.select("tid", F.inline("_items"), "w"))


def basket_total(rows: DataFrame) -> int:
    """The number of baskets of condensed rows."""
    return rows.select("tid", "w").distinct().agg(F.sum("w")).first()[0] or 0


def _number(rows: DataFrame, name: str) -> Column:
    """Rows counted by their weights where they have any."""
    return (F.sum("w") if "w" in rows.columns else F.count("*")).alias(name)


def item_counts(baskets: DataFrame) -> DataFrame:
    """``(item, support)``."""
    return baskets.groupBy("item").agg(_number(baskets, "support"))


def prune_items(baskets: DataFrame, least: float) -> DataFrame:
    """The rows of items with at least this support."""
    kept = item_counts(baskets).where(F.col("support") >= least)
    return baskets.join(kept.select("item"), "item", "left_semi")


def frequent_pairs(baskets: DataFrame, least: int) -> DataFrame:
    """``(items, support)`` of pairs: infrequent items are dropped before the self-join on the basket."""
    rows = prune_items(baskets, least)
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.tid") == F.col("b.tid")) & (F.col("a.item") < F.col("b.item")))
    support = F.sum("a.w") if "w" in rows.columns else F.count("*")
    counts = pairs.groupBy(F.array("a.item", "b.item").alias("items")).agg(support.alias("support"))
    return counts.where(F.col("support") >= least)


def held_singles(rows: DataFrame) -> DataFrame:
    """``(tid, w, items)``: the sets of one item that condensed baskets hold."""
    return rows.select("tid", "w", F.array("item").alias("items"))


def grown(held: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """``(tid, w, items)``: the sets of size k that baskets hold, from those of size k-1: two with a common prefix make a larger one.

    ``held`` must have all subsets of ``sets(items)`` that leave out one of the last two items.
    """
    parts = held.select("tid", "w", F.slice("items", 1, k - 2).alias("prefix"), F.element_at("items", -1).alias("last"))
    a, b = parts.alias("a"), parts.alias("b")
    same = (F.col("a.tid") == F.col("b.tid")) & (F.col("a.prefix") == F.col("b.prefix")) & (F.col("a.last") < F.col("b.last"))
    larger = a.join(b, same).select("a.tid", "a.w", F.concat("a.prefix", F.array("a.last", "b.last")).alias("items"))
    return level(larger.join(sets.select("items"), "items", "left_semi").select("tid", "w", "items"))


def _joined_prefixes(sets: DataFrame, k: int) -> DataFrame:
    """``(items)`` of size k from two sets of size k-1 with a common prefix."""
    prefix, last = F.slice("items", 1, k - 2), F.element_at("items", -1)
    a = sets.select(prefix.alias("prefix"), last.alias("x"))
    b = sets.select(prefix.alias("other"), last.alias("y"))
    same = F.col("x") < F.col("y")
    return a.join(b, same if k == 2 else (F.col("prefix") == F.col("other")) & same).select(F.concat("prefix", F.array("x", "y")).alias("items"))


def candidates(large: DataFrame, k: int) -> DataFrame:
    """``(items)`` of size k from the large sets of size k-1: prefix self-join, then every (k-1)-subset must be large."""
    sets = large.select("items")
    joined = _joined_prefixes(sets, k)
    if k == 3:
        subsets = joined.select("items", F.explode(F.array(F.array(F.element_at("items", 2), F.element_at("items", 3)))).alias("subset"))
        need = 1
    else:
        drop = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.filter("items", lambda _, j: j != i - 1))
        subsets, need = joined.select("items", F.explode(drop).alias("subset")), k
    found = subsets.join(sets.withColumnRenamed("items", "subset"), "subset", "left_semi")
    return found.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") == need).select("items")


def contained(cands: DataFrame, baskets: DataFrame, k: int) -> DataFrame:
    """``(items, tid)``: candidates of size k that a basket contains, by an equi-join on items and a count."""
    exploded = cands.select("items", F.explode("items").alias("item"))
    exploded = F.broadcast(exploded) if exploded.count() <= MAX_BROADCAST else exploded
    hits = baskets.join(exploded, "item").groupBy("items", "tid").agg(F.count("*").alias("n"))
    return hits.where(F.col("n") == k).select("items", "tid")


def apriori(baskets: DataFrame, share: float, n_baskets: int | None = None, max_size: int | None = None, singles: bool = False) -> DataFrame:
    """``(items, support)`` of all frequent sets of two or more items (and of single ones if asked)."""
    baskets = condensed(baskets)
    least = minimum_count(basket_total(baskets) if n_baskets is None else n_baskets, share)
    rows = level(prune_items(baskets, least))
    large = level(frequent_pairs(rows, least))
    out, k, held = large, 2, None
    while large.count() > 1 and (max_size is None or k < max_size):
        k += 1
        cands = level(candidates(large, k))
        if cands.isEmpty():
            break
        # The large sets that each basket holds; two with a common prefix make the basket's next candidates.
        held = grown(held_singles(rows), large, 2) if held is None else held.join(large.select("items"), "items", "left_semi")
        held = grown(held, cands, k)
        counts = held.groupBy("items").agg(_number(held, "support"))
        large = level(counts.where(F.col("support") >= least))
        out = out.union(large)
    if singles:
        out = item_counts(rows).select(F.array("item").alias("items"), "support").union(out)
    return out


def eclat(baskets: DataFrame, share: float, n_baskets: int | None = None, max_size: int | None = None, differences: bool = False) -> DataFrame:
    """The same sets from basket lists: joins of ``(items, tid)`` rows, or of difference sets.

    With ``differences`` a set keeps the baskets that its prefix has and it
    lacks: d(PXY) = d(PY) - d(PX), support(PXY) = support(PX) - |d(PXY)|.
    """
    baskets = condensed(baskets)
    least = minimum_count(basket_total(baskets) if n_baskets is None else n_baskets, share)
    rows = level(prune_items(baskets, least))
    # Sets get numbers, so that the long lists hold two numbers a row instead of arrays of items.
    below = _numbered_sets(item_counts(rows).select(F.array("item").alias("items"), "support"))
    lists = rows.join(below.select(F.col("items")[0].alias("item"), "sid"), "item").select("sid", "tid", "w")
    large, k = _numbered_sets(frequent_pairs(rows, least)), 2
    out = large
    while large.count() > 1 and (max_size is None or k < max_size):
        cands = _numbered_sets(candidates(large, k + 1))
        if cands.isEmpty():
            break
        # Only the sets that some candidate is made of need lists.
        needed = _halves(cands, k + 1, large)
        used = needed.select(F.col("px").alias("sid")).union(needed.select(F.col("py").alias("sid"))).distinct()
        halves = _halves(large.join(used, "sid", "left_semi"), k, below)
        lists = level(_combine(lists, halves, differences, first=k == 2))
        k += 1
        found = _combine(lists, needed, differences, first=False).groupBy("sid").agg(F.sum("w").alias("c"))
        joined = needed.join(found, "sid", "left").select("items", "px", F.coalesce("c", F.lit(0)).alias("c"))
        if differences:
            joined = joined.join(large.select(F.col("sid").alias("px"), "support"), "px").select("items", (F.col("support") - F.col("c")).alias("support"))
        else:
            joined = joined.select("items", F.col("c").alias("support"))
        below, large = large, _numbered_sets(joined.where(F.col("support") >= least))
        out = out.union(large)
    return out.select("items", "support")


def _numbered_sets(sets: DataFrame) -> DataFrame:
    return level(level(sets).withColumn("sid", F.monotonically_increasing_id()))


def _halves(sets: DataFrame, k: int, below: DataFrame) -> DataFrame:
    """``sets`` of size k with the numbers of the two sets that differ in their last item: without the last, without the last but one."""
    px = F.slice("items", 1, k - 1)
    py = F.concat(F.slice("items", 1, k - 2), F.array(F.element_at("items", -1)))
    named = sets.withColumns({"_x": px, "_y": py})
    named = named.join(below.select(F.col("items").alias("_x"), F.col("sid").alias("px")), "_x")
    return named.join(below.select(F.col("items").alias("_y"), F.col("sid").alias("py")), "_y").drop("_x", "_y")


def _combine(lists: DataFrame, halves: DataFrame, differences: bool, first: bool) -> DataFrame:
    """The lists of sets from those of their halves: intersections, or differences (of basket lists at first, then of difference sets)."""
    one, other = ("px", "py") if first or not differences else ("py", "px")
    own = halves.select(F.col("sid").alias("_set"), F.col(one).alias("sid"), F.col(other).alias("_o")).join(lists, "sid").select("_set", F.col("_o").alias("sid"), "tid", "w")
    kind = "left_anti" if differences else "left_semi"
    return own.join(lists.select("sid", "tid"), ["sid", "tid"], kind).select(F.col("_set").alias("sid"), "tid", "w")


def maximal(frequent: DataFrame) -> DataFrame:
    """The frequent sets that no frequent superset (of one more item) contains."""
    drop = F.transform(F.sequence(F.lit(1), F.size("items")), lambda i: F.filter("items", lambda _, j: j != i - 1))
    covered = frequent.select(F.explode(drop).alias("items")).distinct()
    return frequent.join(covered, "items", "left_anti")


def cliques(pairs: DataFrame, max_size: int | None = None) -> DataFrame:
    """Maximal cliques ``(items)`` of three or more items in the graph of frequent pairs, by extension with common neighbours."""
    edges = pairs.select(F.element_at("items", 1).alias("a"), F.element_at("items", 2).alias("b"))
    edges = level(edges)
    current, out, k = level(pairs.select("items")), None, 2
    while max_size is None or k < max_size:
        k += 1
        grown = current.join(edges, F.element_at("items", -1) == F.col("a")).select("items", F.col("b").alias("new"))
        wanted = grown.select("items", "new", F.explode("items").alias("a")).join(edges.withColumnRenamed("b", "new"), ["a", "new"], "left_semi")
        full = wanted.groupBy("items", "new").agg(F.count("*").alias("n")).where(F.col("n") == k - 1)
        nxt = level(full.select(F.concat("items", F.array("new")).alias("items")))
        if k > 3:
            keep = maximal_against(current, nxt)
            out = keep if out is None else out.union(keep)
        if nxt.isEmpty():
            return out if out is not None else nxt
        current = nxt
    return current if out is None else out.union(current)


def maximal_against(sets: DataFrame, larger: DataFrame) -> DataFrame:
    drop = F.transform(F.sequence(F.lit(1), F.size("items")), lambda i: F.filter("items", lambda _, j: j != i - 1))
    return sets.join(larger.select(F.explode(drop).alias("items")).distinct(), "items", "left_anti")


def vertical(baskets: DataFrame, least: int) -> DataFrame:
    """``(item, support, tids)``: ascending basket lists of the frequent items."""
    lists = prune_items(baskets, least).groupBy("item").agg(F.sort_array(F.collect_list("tid")).alias("tids"))
    return lists.select("item", F.size("tids").cast("long").alias("support"), "tids")


def vertical_parts(baskets: DataFrame, least: int, size: int = 100_000) -> DataFrame:
    """``(item, part, tids)`` of items with ``least`` baskets or more: lists of about ``size`` ids, so that no item is one row."""
    counts = item_counts(baskets).where(F.col("support") >= least)
    parts = F.ceil(F.col("support") / F.lit(size)).cast("int")
    dealt = baskets.join(counts.select("item", parts.alias("_parts")), "item")
    part = F.expr("cast(pmod(xxhash64(tid), _parts) as int)")
    return dealt.groupBy("item", part.alias("part")).agg(F.array_sort(F.collect_list("tid")).alias("tids"))


def basket_statistics(baskets: DataFrame) -> DataFrame:
    """Number of baskets and items, sizes and ids, in one row."""
    sizes = baskets.groupBy("tid").agg(F.count("*").alias("n"))
    numbers = sizes.agg(
        F.count("*").alias("baskets"), F.avg("n").alias("mean_size"), F.stddev_pop("n").alias("sd_size"), F.max("n").alias("max_size"),
        F.min("tid").alias("min_tid"), F.max("tid").alias("max_tid"),
    )
    return numbers.crossJoin(baskets.agg(F.countDistinct("item").alias("items")))


def two_sequences(events: DataFrame) -> DataFrame:
    """``(first_item, second_item, support)`` of ``events(customer, item, ts)``: customers whose first i is before their last j."""
    spans = events.groupBy("customer", "item").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    a, b = spans.alias("a"), spans.alias("b")
    hits = a.join(b, (F.col("a.customer") == F.col("b.customer")) & (F.col("a.first") < F.col("b.last")))
    return hits.groupBy(F.col("a.item").alias("first_item"), F.col("b.item").alias("second_item")).agg(F.count("*").alias("support"))


def overlap_histogram(cands: DataFrame, baskets: DataFrame) -> DataFrame:
    """``(items, overlap, n)``: baskets with exactly 1, 2, ... of a candidate's items.

    The supports of all subsets of the candidates give them, by inclusion and
    exclusion; no candidate is matched with a basket that holds but a part of it.
    """
    rows, cands = condensed(baskets), level(cands)
    family = level(cands.select(F.explode(_subsets(cands)).alias("items")).distinct())
    held = held_singles(rows).join(family, "items", "left_semi")
    supports = level(held.groupBy("items").agg(_number(held, "support")))
    for k in range(2, (cands.agg(F.max(F.size("items"))).first()[0] or 0) + 1):
        held = grown(held, family.where(F.size("items") == k), k)
        supports = supports.union(held.groupBy("items").agg(_number(held, "support")))
    return _histogram(cands, supports)


def _subsets(sets: DataFrame) -> Column:
    """All subsets of ``items`` but the empty one."""
    none = F.array().cast(dict(sets.dtypes)["items"])
    every = F.aggregate("items", F.array(none), lambda found, x: F.concat(found, F.transform(found, lambda s: F.concat(s, F.array(x)))))
    return F.slice(every, 2, F.pow(F.lit(2), F.size("items")).cast("int"))


def _histogram(cands: DataFrame, supports: DataFrame) -> DataFrame:
    """The histogram of ``overlap_histogram`` from the supports of all subsets: n(j) = sum over m >= j of (-1)^(m-j) C(m, j) S(m), S(m) those of size m."""
    each = cands.select("items", F.explode(_subsets(cands)).alias("_s")).join(supports.select(F.col("items").alias("_s"), "support"), "_s")
    sums = each.groupBy("items", F.size("_s").cast("long").alias("_m")).agg(F.sum("support").alias("_t"))
    deep = sums.agg(F.max("_m")).first()[0] or 0
    terms = [(m, j, (-1) ** (m - j) * math.comb(m, j)) for m in range(1, deep + 1) for j in range(1, m + 1)]
    signs = cands.sparkSession.createDataFrame(terms, "_m long, overlap long, _f long")
    found = sums.join(F.broadcast(signs), "_m").groupBy("items", "overlap").agg(F.sum(F.col("_t") * F.col("_f")).alias("n"))
    return found.where("n > 0")


def _by_overlap(histogram: DataFrame, n_baskets: int) -> DataFrame:
    """``(items, h)``: counts by overlap 0..k as an array."""
    found = histogram.groupBy("items").agg(F.map_from_entries(F.collect_list(F.struct("overlap", "n"))).alias("m"), F.sum("n").alias("some"))
    some = F.transform(F.sequence(F.lit(1), F.size("items")), lambda j: F.coalesce(F.element_at("m", j.cast("long")), F.lit(0)))
    return found.select("items", F.concat(F.array(F.lit(n_baskets) - F.col("some")), some).alias("h"))


def strong_support(histogram: DataFrame, eps: float, n_baskets: int) -> DataFrame:
    """``(items, support)``: baskets with at least ceil((1 - eps) k) of the items."""
    rows = _by_overlap(histogram, n_baskets)
    least = F.ceil((1 - eps) * F.size("items"))
    total = F.aggregate(F.filter("h", lambda _, j: j >= least), F.lit(0).cast("long"), lambda s, n: s + n)
    return rows.select("items", total.alias("support"))


def weak_support(histogram: DataFrame, eps: float, n_baskets: int) -> DataFrame:
    """``(items, support)``: the most baskets, taken in order of overlap, whose density of items stays at 1 - eps or above."""
    rows = _by_overlap(histogram, n_baskets)
    k = F.size("items")
    floor = F.lit(1 - eps)

    def step(s: Column, j: Column) -> Column:
        n = F.element_at("h", j + 1).cast("double")
        own = j / k
        room = F.floor((s["density"] - floor) * s["baskets"] / (floor - own) + 0.5)
        taken = F.when(own >= floor, n).otherwise(F.least(n, room))
        baskets, ones = s["baskets"] + taken, s["ones"] + j * taken
        density = F.when(baskets > 0, ones / (baskets * k)).otherwise(s["density"])
        stop = s["density"] < floor
        return F.struct(
            F.when(stop, s["baskets"]).otherwise(baskets).alias("baskets"),
            F.when(stop, s["ones"]).otherwise(ones).alias("ones"),
            F.when(stop, s["density"]).otherwise(density).alias("density"),
        )

    start = F.struct(F.lit(0.0).alias("baskets"), F.lit(0.0).alias("ones"), F.lit(1.0).alias("density"))
    total = F.aggregate(F.reverse(F.sequence(F.lit(0), k)), start, step)["baskets"]
    return rows.select("items", total.cast("long").alias("support"))


def weak_itemsets(baskets: DataFrame, share: float, eps: float, h_confidence: float = 0.0, strong_only: bool = False, max_size: int | None = None) -> DataFrame:
    """``(items, support)``: recursively weak error-tolerant sets of two or more items.

    All subsets must qualify too. The h-confidence is the support over (1 - eps)
    times the largest support of a single item. ``strong_only`` filters the
    result by strong support.
    """
    baskets = condensed(baskets)
    n = basket_total(baskets)
    least = minimum_count(n, share)
    rows = level(prune_items(baskets, (1 - eps) * least))
    single = level(item_counts(rows))
    held, supports = held_singles(rows), single.select(F.array("item").alias("items"), "support")
    large = level(single.where(F.col("support") >= (1 - eps) * least).select(F.array("item").alias("items")))
    out, k = None, 1
    while max_size is None or k < max_size:
        k += 1
        if k == 2:
            a, b = large.select(F.col("items")[0].alias("x")), large.select(F.col("items")[0].alias("y"))
            cands = level(a.join(b, F.col("x") < F.col("y")).select(F.array("x", "y").alias("items")))
        else:
            cands = level(candidates(large, k))
        if cands.isEmpty():
            break
        held = grown(held, cands, k)
        supports = level(supports.union(held.groupBy("items").agg(_number(held, "support"))))
        histogram = level(_histogram(cands, supports))
        found = weak_support(histogram, eps, n).where(F.col("support") >= least)
        if h_confidence > 0:
            tops = found.select("items", F.explode("items").alias("item")).join(single.withColumnRenamed("support", "s"), "item")
            found = found.join(tops.groupBy("items").agg(F.max("s").alias("top")), "items")
            found = found.where(F.col("support") / ((1 - eps) * F.col("top")) >= h_confidence).drop("top")
        found = level(found)
        if found.isEmpty():
            break
        large = found.select("items")
        if strong_only:
            found = found.join(strong_support(histogram, eps, n).where(F.col("support") >= least).select("items"), "items", "left_semi")
        out = found if out is None else out.union(found)
    return out if out is not None else weak_support(overlap_histogram(large.limit(0), rows), eps, n)


def afi_pruning_support(size: int, n_baskets: int, least: int, eps_column: float, eps_row: float) -> int:
    """The least support below which no noise-tolerant set of this size can grow."""
    if size == 0:
        return least
    factor = n_baskets - n_baskets * size * eps_column / (math.floor(size * eps_row) + 1)
    return math.ceil(least / n_baskets * max(factor, 0.0))


def approximate_itemsets(baskets: DataFrame, share: float, eps_column: float, eps_row: float, max_size: int | None = None) -> DataFrame:
    """``(items, support, exact)``: approximate frequent itemsets with bounded noise per row and column.

    Level k extends level k-1. Where floor((k-1) eps_row) = floor(k eps_row), no
    further miss is allowed and the support set of a candidate is the
    intersection of its subsets' (1-extension), else their union (0-extension):
    the baskets that hold t = k - floor(k eps_row) of its items or more. Their
    number follows from S(m), the summed supports of its subsets of size m:
    sum over m of S(m) x sum over j = t..m of (-1)^(m-j) C(m, j); so no list of
    baskets is kept. A subset of size m lies in k - m of the subsets of size
    k-1, which gives S(m) from theirs. A set is reported if it has ``least`` supporting baskets and each of its
    items misses at most floor(eps_column x support) of them; sets that only pass
    the pruning support seed the next level.
    """
    baskets = condensed(baskets)
    n = basket_total(baskets)
    least = minimum_count(n, share)
    floor_at = lambda k: afi_pruning_support(k, n, least, eps_column, eps_row)
    rows = prune_items(baskets, floor_at(1))
    # Items become numbers in their order, so that the many sets are short.
    names = level(numbered(item_counts(rows), [F.col("item")], "code").select("item", F.col("code").cast("int").alias("code"), "support"))
    rows = level(rows.join(names.select("item", "code"), "item").select("tid", F.col("code").alias("item"), "w"))
    held = held_singles(rows)
    vectors, depth = names.select(F.array("code").alias("items"), F.col("support").alias("s1")), 1
    out = None
    for k in itertools.count(2):
        if max_size is not None and k > max_size:
            break
        t = k - math.floor(k * eps_row)
        # Baskets that hold t items or more, and those of them with a given item, by inclusion and exclusion.
        of_all = {m: sum((-1) ** (m - j) * math.comb(m, j) for j in range(t, m + 1)) for m in range(1, k + 1)}
        of_item = {m: sum((-1) ** (m - j) * math.comb(m - 1, j - 1) for j in range(t, m + 1)) for m in range(1, k + 1)}
        total = lambda f, ms: sum((F.col(f"s{m}") * f[m] for m in ms), F.lit(0).cast("long"))
        drop = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.filter("items", lambda _, j: j != i - 1))
        subsets = _joined_prefixes(vectors, k).select("items", F.explode(drop).alias("subset"))
        met = subsets.join(vectors.withColumnRenamed("items", "subset"), "subset").withColumn("_q", total(of_item, range(1, depth + 1)))
        sums = [F.expr(f"sum(s{m}) div {k - m}").alias(f"s{m}") for m in range(1, depth + 1)]
        cands = level(met.groupBy("items").agg(*sums, F.max("_q").alias("_q"), F.count("*").alias("_n")).where(F.col("_n") == k).drop("_n"))
        if cands.isEmpty():
            break
        exact = F.lit(0).cast("long")
        if depth == k - 1:
            held = grown(held, cands, k)
            if not held.isEmpty():
                own = held.groupBy("items").agg(_number(held, f"s{k}"))
                cands, depth = cands.join(own, "items", "left").fillna(0, [f"s{k}"]), k
                exact = F.col(f"s{k}")
        ms = range(1, depth + 1)
        scored = cands.withColumns({"support": total(of_all, ms), "_c": total(of_item, ms) - F.col("_q"), "exact": exact})
        scored = level(scored.where(F.col("support") >= max(1, floor_at(k))))
        ok = (F.col("_c") > 0) & (F.col("support") - F.col("_c") <= F.floor(F.lit(eps_column) * F.col("support"))) & (F.col("support") >= least)
        found = scored.where(ok).select("items", "support", "exact")
        out = found if out is None else out.union(found)
        vectors = scored.select("items", *[f"s{m}" for m in ms])
    if out is None:
        return names.limit(0).select(F.array("item").alias("items"), "support", F.col("support").alias("exact"))
    named = out.select("support", "exact", F.col("items").alias("_set"), F.explode("items").alias("code")).join(names.select("code", "item"), "code")
    named = named.groupBy("_set", "support", "exact").agg(F.array_sort(F.collect_list(F.struct("code", "item"))).alias("_i"))
    return named.select(F.col("_i.item").alias("items"), "support", "exact")


def weighted_item_utility(rows: DataFrame) -> DataFrame:
    """``(item, twu)`` of ``rows(tid, item, utility)``: the utility of all baskets that contain an item."""
    totals = rows.groupBy("tid").agg(F.sum("utility").alias("tu"))
    return rows.join(totals, "tid").groupBy("item").agg(F.sum("tu").alias("twu"))


def high_utility(rows: DataFrame, share: float, max_size: int | None = None) -> DataFrame:
    """``(items, utility)`` of the itemsets with at least ``share`` of the total utility: level-wise on basket utility, then exact."""
    # Utilities add up: baskets of the same items are one, with the summed utility of each item.
    whole = rows.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("item", "utility"))).alias("_r"))
    each = whole.select("tid", F.col("_r.item").alias("_items"), F.isnull("tid").alias("_none"), F.posexplode("_r").alias("_at", "_x"))
    sums = each.groupBy("_items", "_none", "_at").agg(F.min("tid").alias("tid"), F.sum("_x.utility").alias("utility"))
    rows = level(sums.select("tid", F.element_at("_items", F.col("_at") + 1).alias("item"), "utility"))
    totals = level(rows.groupBy("tid").agg(F.sum("utility").alias("tu")))
    least = share * totals.agg(F.sum("tu")).first()[0]
    kept = weighted_item_utility(rows).where(F.col("twu") >= least).select("item")
    rows = level(rows.join(kept, "item", "left_semi"))
    large = level(kept.select(F.array("item").alias("items")))
    out = rows.groupBy(F.array("item").alias("items")).agg(F.sum("utility").alias("utility"))
    out, k = level(out.where(F.col("utility") >= least)), 1
    while max_size is None or k < max_size:
        k += 1
        if k == 2:
            a, b = rows.alias("a"), rows.alias("b")
            hits = a.join(b, (F.col("a.tid") == F.col("b.tid")) & (F.col("a.item") < F.col("b.item")))
            hits = hits.select(F.array("a.item", "b.item").alias("items"), F.col("a.tid").alias("tid"), (F.col("a.utility") + F.col("b.utility")).alias("u"), F.col("b.utility").alias("lu"))
        else:
            cands = level(candidates(large, k))
            if cands.isEmpty():
                break
            parts = held.join(large, "items", "left_semi")
            parts = parts.select("tid", "u", F.slice("items", 1, k - 2).alias("prefix"), F.element_at("items", -1).alias("last"), "lu")
            a, b = parts.alias("a"), parts.alias("b")
            same = (F.col("a.tid") == F.col("b.tid")) & (F.col("a.prefix") == F.col("b.prefix")) & (F.col("a.last") < F.col("b.last"))
            hits = a.join(b, same).select(F.concat("a.prefix", F.array("a.last", "b.last")).alias("items"), "a.tid", (F.col("a.u") + F.col("b.lu")).alias("u"), "b.lu")
            hits = hits.join(cands, "items", "left_semi")
        held = level(hits)
        found = level(held.join(totals, "tid").groupBy("items").agg(F.sum("tu").alias("twu"), F.sum("u").alias("utility")).where(F.col("twu") >= least))
        out = out.union(found.where(F.col("utility") >= least).select("items", "utility"))
        large = found.select("items")
        if found.isEmpty():
            break
    return out


def levels_report(frequent: DataFrame) -> DataFrame:
    """``(size, n, mean_support)`` by size of set."""
    return frequent.groupBy(F.size("items").alias("size")).agg(F.count("*").alias("n"), F.avg("support").alias("mean_support"))
