"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Each text gets counts, and from them one share for each rule. A text is rejected
if any rule's share is above the stratum's cutoff; the stratum is the language.
The cutoff is chosen from labelled rows: going down a fixed list from lax to
strict, a cutoff is accepted while the exact binomial test rejects that all rules
together drop more than ``alpha`` of the good texts, and the walk ends at the
first one that fails (a fixed-sequence test, so neither the list nor the rules
cost anything). The level of each walk is ``delta`` divided by the number of
walks, one for each stratum with labels and one for all of them together
(Bonferroni). So with probability ``1 - delta`` no stratum with a cutoff of its own
loses more than ``alpha`` of its good texts. A stratum with so few good labels
that even no loss among them would show nothing takes the cutoff of all strata
together, for whose good texts as a whole the bound holds. With no cutoff every
text that passes the base checks is kept.

Defined cases: a null text has no words; null ``lang`` is a stratum of its own;
a null ``doc_id`` matches no label; repeated rows are judged one by one; of
several labels of a document the least counts; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RULES = ("symbol_share", "bang_share", "dup_line_share", "repeat_share")
#: From lax to strict.
CUTOFFS = (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)
ALPHA = 0.02
DELTA = 0.05
#: Strata up to this many are joined by broadcast.
MAX_BROADCAST = 10_000


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, stratum)``, the counts and the shares of each row."""
    empty_long = F.expr("cast(array() as array<bigint>)")
    text = F.coalesce("text", F.lit(""))
    # The mark keeps a null language apart from an empty one.
    out = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("stratum"), text.alias("text"))
    out = out.withColumn("trimmed", F.btrim("text", F.lit(SPACE)))
    words = F.when(F.col("trimmed") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("trimmed", SPACES, -1))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select("doc_id", "stratum", words.alias("words"), lines.alias("lines"))
    n = F.size("words")
    hashes = F.when(
        n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    ).otherwise(empty_long)
    out = out.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array_join("words", "").alias("joined"),
        hashes.alias("h"),
    )
    placed = F.expr("sort_array(transform(h, (x, i) -> struct(x, i)))")
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    out = out.select(
        "doc_id", "stratum", "n_words", "n_lines", "n_dup_lines",
        F.length("joined").cast("long").alias("word_chars"),
        (F.length("joined") - F.length(F.regexp_replace("joined", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length("joined") - F.length(F.replace("joined", F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        F.when(repeats, placed).otherwise(F.expr("cast(array() as array<struct<x:bigint,i:int>>)")).alias("placed"),
    )
    pairs = "zip_with(placed, slice(placed, 2, size(placed)), (a, b) -> case when a.x = b.x then array(a.i, b.i) end)"
    out = out.withColumn("at", F.expr(f"sort_array(array_distinct(flatten(filter({pairs}, p -> p is not null))))"))
    gaps = f"zip_with(at, slice(at, 2, size(at)), (a, b) -> least(coalesce(b - a, {WINDOW}), {WINDOW}))"
    covered = F.expr(f"case when size(at) = 0 then 0L else aggregate({gaps}, 0L, (s, g) -> s + g) end")
    out = out.withColumn("n_repeat_words", covered).drop("placed", "at")
    return out.withColumns(
        {
            "symbol_share": _share(F.col("n_symbols"), F.col("word_chars")),
            "bang_share": _share(F.col("n_bangs"), F.col("word_chars")),
            "dup_line_share": _share(F.col("n_dup_lines"), F.col("n_lines")),
            "repeat_share": _share(F.col("n_repeat_words"), F.col("n_words")),
        }
    )


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(Binomial(n, p) <= k) as an expression, summed in log space."""
    first = n * F.log1p(F.lit(-p))
    odds = F.log(F.lit(p / (1 - p)))

    def step(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i) / (i + 1)) + odds
        top = F.greatest(state["total"], term)
        total = top + F.log(F.exp(state["total"] - top) + F.exp(term - top))
        return F.struct(term.alias("term"), total.alias("total"))

    start = F.struct(first.alias("term"), first.alias("total"))
    return F.when(k == 0, first).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), k - 1), start, step)["total"])


def thresholds(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``(stratum, n, steps, few, cut)`` of each stratum with good labels, and of all together, whose stratum is null.

    ``cut`` is the strictest accepted cutoff, null if none is; ``few`` says that no cutoff could have been.
    """
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = feats.join(quality, "doc_id").where("quality = 1")
    hits = [F.count_if(_over(F.lit(c))).alias(f"k{i}") for i, c in enumerate(CUTOFFS)]
    counted = scratch.materialise(good.groupBy("stratum").agg(F.count("*").alias("n"), *hits), "holdout")
    names = ["n", *(f"k{i}" for i in range(len(CUTOFFS)))]
    whole = counted.agg(*[F.sum(c).alias(c) for c in names]).where("n is not null")
    walks = counted.agg((F.count("*") + 1).alias("walks"))  # one row
    level = F.log(F.lit(delta) / F.col("walks"))
    cells = [F.struct(F.lit(i).alias("step"), F.col(f"k{i}").alias("k")) for i in range(len(CUTOFFS))]
    tested = counted.union(whole.select(F.lit(None).cast("string").alias("stratum"), *names)).crossJoin(F.broadcast(walks))
    few = F.col("n") * F.log1p(F.lit(-alpha)) > level
    tested = tested.select("stratum", "n", few.alias("few"), level.alias("level"), F.inline(F.array(*cells)))
    passed = (F.col("k") < alpha * F.col("n")) & (log_binomial_cdf(F.col("k"), F.col("n"), alpha) <= F.col("level"))
    first = tested.groupBy("stratum", "n", "few").agg(F.coalesce(F.min(F.when(~passed, F.col("step"))), F.lit(len(CUTOFFS))).alias("steps"))
    cut = F.when(F.col("steps") > 0, F.element_at(F.array(*[F.lit(c) for c in CUTOFFS]), F.greatest("steps", F.lit(1))))
    return first.withColumn("cut", cut)


def _over(cutoff: Column) -> Column:
    """Whether any rule's share is above the cutoff."""
    over = F.lit(False)
    for r in RULES:
        over = over | (F.col(r) > cutoff)
    return over


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, shares, ``base_failed`` and ``kept`` for every row of ``docs(doc_id, text, lang)``."""
    feats = scratch.materialise(features(docs), "quality")
    cuts = scratch.materialise(thresholds(feats, labels, alpha, delta), "cutoffs")
    own = cuts.where("stratum is not null").select("stratum", "few", F.col("cut").alias("own"))
    own = F.broadcast(own) if own.count() <= MAX_BROADCAST else own
    whole = cuts.where("stratum is null").agg(F.max("cut").alias("whole"))  # one row
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = feats.join(own, "stratum", "left").crossJoin(F.broadcast(whole)).withColumn("base_failed", base)
    cut = F.when(F.coalesce("few", F.lit(True)), F.col("whole")).otherwise(F.col("own"))
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(_over(cut), F.lit(False))).drop("few", "own", "whole")


def oracle() -> str:
    """The same result in DuckDB's SQL."""
    grid = ", ".join(f"({i}, {c})" for i, c in enumerate(CUTOFFS))
    over = lambda cut: " OR ".join(f"{r} > {cut}" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(8, coalesce(nx - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM dup) GROUP BY rid),
c AS (SELECT d.rid, d.doc_id, d.stratum, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(array_to_string(ws, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  length(regexp_replace(array_to_string(ws, ''), '[^!]+', '', 'g'))::BIGINT AS n_bangs,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid)),
f AS (SELECT *, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share,
  CASE WHEN word_chars > 0 THEN n_bangs / word_chars ELSE 0 END AS bang_share,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
  CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share FROM c),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
good AS (SELECT f.* FROM f JOIN q USING (doc_id) WHERE q.quality = 1),
grid(step, cutoff) AS (VALUES {grid}),
k AS (SELECT stratum, step, count(*) AS n, count(*) FILTER ({over("cutoff")}) AS k FROM good CROSS JOIN grid GROUP BY ALL),
cells AS (SELECT stratum, false AS whole, step, n, k FROM k UNION ALL SELECT NULL, true, step, sum(n)::BIGINT, sum(k)::BIGINT FROM k GROUP BY step),
level AS (SELECT {DELTA} / (count(DISTINCT stratum) + 1) AS level FROM good),
tests AS (SELECT *, n * ln(1 - {ALPHA}) > ln(level) AS few, CASE WHEN k < {ALPHA} * n THEN list_sum(list_transform(range(0, k + 1),
  lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) ELSE 1 END <= level AS passed FROM cells, level),
steps AS (SELECT stratum, whole, few, coalesce(min(CASE WHEN NOT passed THEN step END), {len(CUTOFFS)}) AS steps FROM tests GROUP BY ALL),
cuts AS (SELECT stratum, whole, few, (SELECT cutoff FROM grid WHERE step = steps - 1) AS cut FROM steps),
g AS (SELECT f.*, CASE WHEN coalesce(few, true) THEN (SELECT max(cut) FROM cuts WHERE whole) ELSE cut END AS cutoff FROM f LEFT JOIN (SELECT * FROM cuts WHERE NOT whole) c ON c.stratum = f.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND NOT coalesce({over("cutoff")}, false) AS kept
FROM g"""
