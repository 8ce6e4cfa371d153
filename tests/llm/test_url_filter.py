import math
import re
from collections import Counter
from functools import cache
from itertools import product
from types import SimpleNamespace

import pytest
import regex
from lodestone.llm import queries, url_filter


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, None),
        ("no scheme/en/", "", "", None, None),
        ("http://", "", "", None, None),
        ("http://A.COM/en/x?y#z", "a.com", "/en/x", "com/en/", "block"),
        ("https://com/en/", "com", "/en/", "com/en/", "block"),
        ("https://telecom/en/", "telecom", "/en/", None, None),
        ("x://www.example.com/en/71", "www.example.com", "/en/71", "example.com/en/7", "allow"),
        ("x://notexample.com/en/71", "notexample.com", "/en/71", "com/en/", "block"),
        ("x://a.example.net/de/8", "a.example.net", "/de/8", "example.net/de/8", "block"),
        ("x://a.net/de/8", "a.net", "/de/8", "net/de/", "allow"),
        ("x://a.net?/de/8", "a.net", "", None, None),
        ("x://É.org/es/#", "É.org", "/es/", "org/es/", "block"),
        ("x://h.org#a://b.com/en/", "h.org", "", None, None),
    ],
)
def test_rules(url, host, path, rule, verdict):
    assert url_filter.split_url(url) == (host, path)
    assert url_filter.Rules(queries.URL_RULES).decide(host, path) == (rule, verdict)


def all_splits(name):
    for cuts in product([0, 1], repeat=len(name) - 1):
        words, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                words.append(name[start:i])
                start = i
        yield [*words, name[start:]]


def split_cost(words, cost, total):
    return sum(cost.get(w, math.log10(total) - 1 + len(w)) for w in words)


def test_viterbi_is_the_best_split():
    counts = {"the": 50, "cat": 9, "he": 20, "t": 2, "sat": 5, "catsa": 1}
    cost = {w: math.log10(87 / n) for w, n in counts.items()}
    for name in ("thecat", "hecatsat", "xyzthe", "thecatsat", "qq", "t", "qthezz"):
        best = min(split_cost(x, cost, 87) for x in all_splits(name))
        assert split_cost(url_filter.segment(name, cost, 87), cost, 87) == pytest.approx(best)
    assert url_filter.segment("thecat", cost, 87) == ["the", "cat"] and url_filter.segment("", cost, 87) == []
    assert url_filter.segment("xyz", {}, 0) == ["xyz"]


def test_words_that_shorter_ones_explain_are_left_out():
    counts = {"th": 3000, "in": 2000, "thin": 900, "thinth": 100, "together": 300, "to": 2500, "get": 100, "her": 200}
    assert set(url_filter.lexicon(counts, 100_000)) == {"th", "in", "to", "get", "her", "together"}


def plain_verdicts(rows, precision=url_filter.PRECISION):
    """Every URL's (verdict, probability) from the pages' text and the rules, one at a time."""
    words = Counter()
    for _, _, html in rows:
        visible = re.sub(r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&\w+;", " ", html or "")
        words.update(regex.findall(r"\p{L}+", visible.lower()))
    total = sum(words.values())

    def lexicon(name):
        known = {}
        for w in sorted({name[i:j] for i in range(len(name)) for j in range(i + 1, len(name) + 1)}, key=len):
            if w in words:
                own = math.log10(total / words[w])
                splits = [sum(known.get(x, math.inf) for x in s) for s in all_splits(w) if len(s) > 1]
                if min(splits, default=math.inf) - own > math.log10(url_filter.COMPOUND):
                    known[w] = own
        return known

    @cache
    def split(name):
        cost = lexicon(name)
        return min(all_splits(name), key=lambda s: split_cost(s, cost, total)), cost

    def tokens(host, path):
        out = []
        for part in regex.findall(r"\p{L}+|\p{Nd}+", host):
            out += ["h:#"] if part[0].isdigit() else [f"h:{w}" for w in split(part.lower())[0]]
        return out + ["p:#" if p[0].isdigit() else f"p:{p}" for p in regex.findall(r"\p{L}+|\p{Nd}+", path.lower())]

    rules, counts, seeds = url_filter.Rules(queries.URL_RULES), Counter(), [f"h:{w}" for w in url_filter.SEEDS.split()]
    for _, url, _ in rows:
        host, path = url_filter.split_url(url)
        rule, verdict = rules.decide(host, path)
        if rule:
            tested, _, start = rule.partition("/")
            rest = ".".join(host.split(".")[: host.count(".") - tested.count(".")])
            counts.update((t, verdict) for t in tokens(rest, path[len(start) + 1 :]))
    vocabulary = {t for t, _ in counts} | set(seeds)
    b, a = (sum(n for (_, v), n in counts.items() if v == verdict) for verdict in ("block", "allow"))
    mass = url_filter.SEED_SHARE * b

    def odds(t):
        if t not in vocabulary:
            return 0.0
        p = (counts[t, "block"] + 1 + (mass / len(seeds) if t in seeds else 0)) / (b + len(vocabulary) + 1 + mass)
        return math.log(p) - math.log((counts[t, "allow"] + 1) / (a + len(vocabulary) + 1))

    return tokens, lambda host, path: 1 / (1 + math.exp(-sum(map(odds, tokens(host, path)))))


def test_query(spark, tmp_path):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    odd = [(None, None, None), (10007, "", ""), (10008, "http://cheappills.example.xyz/fr/1", "<p>x"), (10009, "http://12.É.com/é/É2#", None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows + odd + odd[-1:]], "page_id long, url string, html string, host string")
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op9_url_filter(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 5
    rules = url_filter.Rules(queries.URL_RULES)
    tokens, probability = plain_verdicts(rows + odd + odd[-1:])
    of = {r.page_id: r for r in got}
    model = url_filter.fit(frame, queries.URL_RULES)
    for page_id, url, _ in rows + odd:
        r = of[page_id]
        host, path = url_filter.split_url(url)
        rule, verdict = rules.decide(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        want = probability(host, path) if host or path else 0.0
        assert r.block_probability == pytest.approx(want, abs=1e-9), url
        by_model = "block" if model.block is not None and want >= model.block else "allow"
        assert r.verdict == (verdict or by_model)
    assert of[10008].host_words.split()[:2] == ["cheap", "pills"] or of[10008].host_words.split()[0] == "cheappills"
    frame.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.op9_url_filter(spark, f"{tmp_path}/none").count() == 0


def test_threshold_is_the_least_step_that_is_precise_enough():
    row = lambda step, blocked, allowed: SimpleNamespace(step=step, blocked=blocked, allowed=allowed)
    bins = [row(99, 0, 0), row(97, 30, 1), row(90, 20, 1), row(80, 10, 9), row(70, 0, 50), row(0, 9, 9)]
    assert url_filter._threshold(bins, 0.95) == (0.9, {"blocked": 69, "allowed": 70, "precision": 50 / 52, "recall": 50 / 69})
    assert url_filter._threshold([row(90, 1, 9)], 0.95)[0] is None


def test_long_names_and_hot_hosts(spark):
    html = "<p>ab ab ab cd cd river"
    urls = [f"http://{'ab' * 1500}.com/x", *["http://abcd.example.com/en/1"] * 300, "http://abcd.example.org/es/1", "http://river.example.net/de/1"]
    pages = spark.createDataFrame([(i, u, html) for i, u in enumerate(urls)], "page_id long, url string, html string")
    model = url_filter.fit(pages, queries.URL_RULES)
    got = {r.page_id: r for r in url_filter.judge(pages, model).collect()}
    assert len(got) == len(urls) and got[0].host_words.split()[:-1] == ["ab"] * 1500
    assert got[5].verdict == got[301].verdict == "block" and got[302].verdict == "allow"
    assert url_filter.judge(pages, url_filter.fit(pages.limit(0), queries.URL_RULES)).where("rule is null and verdict = 'block'").count() == 0
