import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from lodestone.llm import queries, simhash
from lodestone.llm.components import components


def plain_fingerprint(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius):
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = sorted((find(i), find(j)))
            up[b] = a
    return [find(i) for i in range(len(prints))]


def _texts(rng):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyzwé"]
    out = [None, "", " \n", "One", "one TWO", "é É", "a\x0bb\x0cc d\x85e", "x " * 700]
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(120, 400))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "edit"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("tile", [4, simhash.TILE])
def test_query_operator_equals_brute_force(spark, tile):
    texts = _texts(random.Random(7)) * 2
    ids = [*range(500, 500 - len(texts) + 1, -1), None]
    prints = [plain_fingerprint(t, 3) for t in texts]
    of = plain_components(prints, 2)
    want = []
    for i, p, c in zip(ids, prints, of):
        members = [x for x, d in zip(ids, of) if d == c and x is not None]
        want.append((i, p, min(members, default=None)))
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, fp int")
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs, tile=tile).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [3, 4, 5])
def test_links_lose_nothing(spark, blocks):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    prints = {int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(40)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fp long")
    edges = components(simhash.links(nodes, 2, blocks, tile=16)).collect()
    root = {r.node % 2**64: r.component for r in edges}
    of = plain_components(prints, 2)
    for i, j in combinations(range(len(prints)), 2):
        same = root.get(prints[i], ("alone", i)) == root.get(prints[j], ("alone", j))
        assert same == (of[i] == of[j])


def test_distant_tiles_are_skipped():
    left, right = np.full(300, 1, np.uint64), np.full(300, 2**40 - 1, np.uint64)
    assert simhash.compare_tiles(left, right, 2, simhash._Forest()) == 0


def test_representatives(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3
    rows = [(5, text), (3, text), (3, text), (None, text), (None, "other words here entirely"), (None, "other words here entirely"),
            (9, "a third text of some length"), (9, "a fourth and rather different one"), (11, None), (12, "")]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, lodestone string, component_id double")
    got = simhash.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, (r.text or "")[:7]) for r in got.collect()), key=str) == sorted(
        [(3, text[:7]), (None, "other w"), (9, "a third"), (9, "a fourt"), (11, "")], key=str
    )
    assert simhash.representatives(docs.limit(0)).count() == 0


def test_component_chain(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1003), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000, 1003: 1000}


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = [plain_fingerprint(r.text, 3) for r in docs]
    of = plain_components(prints, 2)
    least = {}
    for r, c in zip(docs, of):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = sorted((r.doc_id, f"{p:016x}", least[c]) for r, p, c in zip(docs, prints, of))
    assert sorted(map(tuple, queries.op6_simhash(spark, sf).collect())) == want
