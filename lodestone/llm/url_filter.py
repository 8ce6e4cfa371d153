"""URL verdicts: rules first, then naive Bayes over segmented host and path words.

A rule names a host and the beginning of a path; it fits the host and all of its
subdomains, and the longest rule that fits decides. Where none does, the names
in the host (runs of letters) are split into words by a unigram Viterbi search,
and a multinomial naive Bayes model scores the words of host and path.

Word probabilities come from the visible text of all pages. A name's splits can
only use words that occur in it, so the counts are joined with the substrings of
the distinct names, and each name gets the counts that it needs, whatever the
number of words. A word of the pages is left out if shorter words explain it:
if it isn't ``COMPOUND`` times as probable as the best of its own splits. An
unknown word of n letters has probability 10 / (N 10^n).

The model learns from all pages that rules decide, from the words that are left
when what the deciding rule tests is taken away, with one count for each word as
its prior. ``SEEDS`` are a prior too: they share ``SEED_SHARE`` of the blocked
words' mass, and the class is normalised with it. Words that the model doesn't
know say nothing, and both classes have the same prior, since the pages that
rules decide aren't drawn from the others. A URL without a rule is blocked if the probability of that is
``Model.block`` or more: the least of a hundred steps that has a precision of
``PRECISION`` on pages that rules decide, where each half of the hosts is judged
by the model of the other half. If no step has, the model blocks nothing.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is allowed; null page text gives no words; rules of equal length
that both fit are taken in order; with nothing decided by rules every URL has the
probability 0 and is allowed; repeated rows are judged one by one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

COMPOUND = 100.0
SEED_SHARE = 0.05
PRECISION = 0.95
STEPS = 100
# Words that mark unwanted sites.
SEEDS = (
    "spam farm cheap pills pill casino poker betting bet xxx porn sex adult viagra cialis pharma loan loans payday crack warez "
    "keygen torrent replica escort malware phishing clickbait lottery jackpot"
)
_PARTS = r"(\p{L}+|\p{Nd}+)"


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): what lies between ``://`` and the first of ``/?#``, A-Z lower-cased, and from there to ``?`` or ``#``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub(r"[A-Z]+", lambda m: m[0].lower(), host), path


class Rules:
    """``[(verdict, rule)]`` with rules like ``example.com/en/``."""

    def __init__(self, rules: Sequence[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def decide(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule that fits."""
        best: tuple[str | None, str | None] = (None, None)
        at = 0
        while host and at >= 0:
            for start, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = rule, verdict
            at = host.find(".", at) + 1 or -1
        return best


def ruled(pages: DataFrame, rules: Rules) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url)``; the rule and its verdict may be null."""
    spark = scratch.ship(pages.sparkSession)
    shared = spark.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value
        for batch in batches:
            urls = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [u + rules.decide(*u) for u in urls]
            columns = [pa.array([f[i] for f in found], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


# --- segmentation --------------------------------------------------------------------------------


def word_counts(pages: DataFrame) -> DataFrame:
    """``(word, n)`` of all words in the visible text of all pages."""
    visible = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&\w+;", " ")
    word = F.explode(F.split(F.lower(visible), r"\P{L}+"))
    return pages.select(word.alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def lexicon(counts: dict[str, int], total: int) -> dict[str, float]:
    """-log10 of the probabilities of the words that shorter ones don't explain."""
    cost: dict[str, float] = {}
    longest = 0
    for w in sorted(counts, key=len):
        own = math.log10(total / counts[w])
        best = [0.0] + [math.inf] * len(w)
        for end in range(1, len(w) + 1):
            best[end] = min((best[start] + cost.get(w[start:end], math.inf) for start in range(max(0, end - longest), end)), default=math.inf)
        if best[-1] - own > math.log10(COMPOUND):
            cost[w] = own
            longest = len(w)
    return cost


def segment(name: str, cost: dict[str, float], total: int) -> list[str]:
    """The most probable words of a name; of equal ones that whose last word is longest."""
    unknown = max(math.log10(max(total, 1)) - 1, 0.0)
    longest = max(map(len, cost), default=0)
    best, back, opened = [0.0], [0], 0
    for end in range(1, len(name) + 1):
        found = None
        for start in range(max(0, end - longest), end):
            c = cost.get(name[start:end])
            if c is not None and (found is None or best[start] + c < found[0]):
                found = best[start] + c, start
        # The best start of an unknown word of any length.
        if best[end - 1] - (end - 1) < best[opened] - opened:
            opened = end - 1
        c = best[opened] + unknown + end - opened
        if found is None or c < found[0]:
            found = c, opened
        best.append(found[0])
        back.append(found[1])
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``(name, words)`` for the distinct ``names(name)``, with the unigram ``counts(word, n)``."""
    spark = scratch.ship(names.sparkSession)
    totals = counts.agg(F.sum("n").alias("n"), F.max(F.length("word")).alias("longest")).first()
    total, longest = totals.n or 0, totals.longest or 0
    names = scratch.materialise(names.distinct(), "names")
    parts = F.expr(
        f"flatten(transform(sequence(1, length(name)), i -> transform(sequence(1, least({max(longest, 1)}, length(name) - i + 1)),"
        " k -> substring(name, i, k))))"
    )
    within = names.select("name", F.explode(F.array_distinct(parts)).alias("word"))
    found = within.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            known = [{x["word"]: x["n"] for x in words or ()} for words in batch.column(1).to_pylist()]
            words = [segment(n, lexicon(k, total), total) for n, k in zip(names, known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    out = names.join(found, "name", "left").select("name", "words").mapInArrow(run, "name string, words array<string>")
    return scratch.materialise(out, "words")


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``(host, labels)``: the words of each label of the distinct hosts, ``#`` for digits."""
    labels = hosts.where("host <> ''").distinct().select("host", F.posexplode(F.split("host", r"\.")).alias("label", "text"))
    parts = labels.select("host", "label", F.posexplode_outer(F.regexp_extract_all("text", F.lit(_PARTS), F.lit(1))).alias("place", "part"))
    parts = parts.withColumn("name", F.when(~F.col("part").rlike(r"^\p{Nd}"), F.lower("part")))
    names = segmented(parts.where("name is not null").select("name"), counts)
    words = F.when(F.col("part").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.coalesce("words", F.array(F.lit("#"))))
    found = parts.join(names, "name", "left").select("host", "label", F.coalesce("place", F.lit(0)).alias("place"), words.alias("words"))
    found = found.groupBy("host", "label").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("parts"))
    found = found.select("host", "label", F.flatten(F.transform("parts", lambda p: p["words"])).alias("words"))
    found = found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("label", "words"))).alias("labels"))
    return scratch.materialise(found.select("host", F.transform("labels", lambda x: x["words"]).alias("labels")), "hosts")


def _tokens(labels: Column, path: Column) -> Column:
    """The words of host labels and path, told apart."""
    of_host = F.transform(F.flatten(F.coalesce(labels, F.expr("cast(array() as array<array<string>>)"))), lambda w: F.concat(F.lit("h:"), w))
    of_path = F.transform(
        F.regexp_extract_all(F.lower(path), F.lit(_PARTS), F.lit(1)), lambda w: F.when(w.rlike(r"^\p{Nd}"), "p:#").otherwise(F.concat(F.lit("p:"), w))
    )
    return F.concat(of_host, of_path)


# --- naive Bayes ---------------------------------------------------------------------------------


class Model:
    """Rules, word counts, and ``odds(token, odds)``, each token's log-odds of being blocked; None if rules decide nothing."""

    def __init__(self, rules: Rules, words: DataFrame, odds: DataFrame | None, block: float | None, held_out: dict) -> None:
        self.rules, self.words, self.odds, self.block, self.held_out = rules, words, odds, block, held_out


def _log_odds(blocked: Column, allowed: Column, seed: Column, totals) -> Column:
    """ln P(token | blocked) - ln P(token | allowed), both normalised over the vocabulary and one unknown token."""
    seeds = SEED_SHARE * totals.blocked
    b = (blocked + 1 + F.when(seed, F.lit(seeds / len(SEEDS.split()))).otherwise(0.0)) / (totals.blocked + totals.tokens + 1 + seeds)
    return F.log(b) - F.log((allowed + 1) / (totals.allowed + totals.tokens + 1))


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-500.0)), F.lit(500.0))))


def _threshold(bins: list, precision: float) -> tuple[float | None, dict]:
    """The least step whose precision is enough, and what was measured; bins have ``step, blocked, allowed``."""
    blocked, allowed = [0] * (STEPS + 1), [0] * (STEPS + 1)
    for r in bins:
        blocked[r.step] += r.blocked
        allowed[r.step] += r.allowed
    of, right, wrong, best = sum(blocked), 0, 0, None
    measured = {"blocked": of, "allowed": sum(allowed), "precision": None, "recall": 0.0}
    for step in range(STEPS, 0, -1):
        right, wrong = right + blocked[step], wrong + allowed[step]
        if blocked[step] + allowed[step] and right >= precision * (right + wrong):
            best = step / STEPS
            measured |= {"precision": right / (right + wrong), "recall": right / of}
    return best, measured


def fit(pages: DataFrame, rules: Sequence[tuple[str, str]], precision: float = PRECISION) -> Model:
    """The model of ``pages(page_id, url, html)`` and ``rules``."""
    known = Rules(rules)
    words = scratch.materialise(word_counts(pages), "counts")
    decided = ruled(pages, known).where("rule is not null").groupBy("host", "path", "rule", "verdict").agg(F.count("*").alias("n"))
    decided = scratch.materialise(decided, "decided")
    labels = host_words(decided.select("host"), words)
    tested = F.expr("substring_index(rule, '/', 1)")
    rest = F.expr("substring(path, length(rule) - length(substring_index(rule, '/', 1)) + 1)")
    left = F.expr("slice(labels, 1, greatest(size(labels) - size(split(substring_index(rule, '/', 1), '[.]')), 0))")
    urls = decided.join(labels, "host", "left").select("host", "path", "n", "verdict", tested.alias("tested"), _tokens(left, rest).alias("tokens"))
    urls = scratch.materialise(urls.withColumn("half", F.pmod(F.xxhash64("host"), F.lit(2))).drop("tested"), "training")
    of = lambda verdict, half=None: F.sum(
        F.when((F.col("verdict") == verdict) & (F.lit(True) if half is None else F.col("half") == half), F.col("n")).otherwise(0)
    )
    halves = [of(v, h).alias(f"{v}{h}") for v in ("block", "allow") for h in (0, 1)]
    counts = urls.select(F.explode("tokens").alias("token"), "verdict", "half", "n").groupBy("token").agg(*halves)
    seeds = decided.sparkSession.createDataFrame([(f"h:{w}",) for w in SEEDS.split()], "token string").withColumn("seed", F.lit(True))
    counts = counts.join(seeds, "token", "full").na.fill(0).na.fill(False)
    counts = scratch.materialise(counts, "tokens")

    def totals(half: int | None):
        take = [0, 1] if half is None else [half]
        total = lambda v: sum((F.sum(f"{v}{h}") for h in take[1:]), F.sum(f"{v}{take[0]}"))
        return counts.agg(total("block").alias("blocked"), total("allow").alias("allowed"), F.count("*").alias("tokens")).first()

    sizes = urls.agg(*[of(v, h).alias(f"{v}{h}") for v in ("block", "allow") for h in (0, 1)]).first()
    if not (sizes.block0 or sizes.block1 or sizes.allow0 or sizes.allow1):
        return Model(known, words, None, None, {})
    everything = totals(None)
    odds = counts.select("token", _log_odds(F.col("block0") + F.col("block1"), F.col("allow0") + F.col("allow1"), F.col("seed"), everything).alias("odds"))
    odds = scratch.materialise(odds, "odds")
    # Each half is judged by the counts of the other one.
    ours = counts.select("token", *[_log_odds(F.col(f"block{1 - h}"), F.col(f"allow{1 - h}"), F.col("seed"), totals(1 - h)).alias(f"odds{h}") for h in (0, 1)])
    rows = urls.select("host", "path", "half", F.explode("tokens").alias("token")).join(ours, "token")
    rows = rows.groupBy("host", "path").agg(F.sum(F.when(F.col("half") == 0, F.col("odds0")).otherwise(F.col("odds1"))).alias("odds"))
    judged = urls.select("host", "path", "half", "verdict", "n").join(rows, ["host", "path"], "left")
    step = F.floor(_probability(F.coalesce("odds", F.lit(0.0))) * STEPS).cast("int")
    bins = judged.groupBy(step.alias("step")).agg(of("block").alias("blocked"), of("allow").alias("allowed"))
    block, measured = _threshold(bins.collect(), precision)
    return Model(known, words, odds, block, measured)


def judge(pages: DataFrame, model: Model) -> DataFrame:
    """``(page_id, host, path, rule, verdict, block_probability, host_words)`` for every row of ``pages(page_id, url)``."""
    judged = scratch.materialise(ruled(pages, model.rules), "ruled")
    urls = judged.where("host <> '' or path <> ''").select("host", "path").distinct()
    labels = host_words(urls.select("host"), model.words)
    urls = scratch.materialise(urls.join(labels, "host", "left"), "urls")
    urls = urls.withColumn("host_words", F.array_join(F.flatten("labels"), " "))
    if model.odds is None:
        scored = urls.select("host", "path", "host_words", F.lit(0.0).alias("block_probability"))
    else:
        rows = urls.select("host", "path", F.explode(_tokens(F.col("labels"), F.col("path"))).alias("token"))
        sums = rows.join(model.odds, "token").groupBy("host", "path").agg(F.sum("odds").alias("odds"))
        sums = sums.select("host", "path", _probability(F.col("odds")).alias("block_probability"))
        scored = urls.join(sums, ["host", "path"], "left").select("host", "path", "host_words", F.coalesce("block_probability", F.lit(0.5)).alias("block_probability"))
    out = judged.join(scored, ["host", "path"], "left")
    p = F.coalesce("block_probability", F.lit(0.0))
    by_model = F.when(p >= model.block, "block").otherwise("allow") if model.block is not None else F.lit("allow")
    verdict = F.coalesce("verdict", by_model).alias("verdict")
    return out.select("page_id", "host", "path", "rule", verdict, p.alias("block_probability"), F.coalesce("host_words", F.lit("")).alias("host_words"))
