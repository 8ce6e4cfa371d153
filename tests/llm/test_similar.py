import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from lodestone.llm import similar


def shingle_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def least_of_group(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) * 5 >= 4 * len(x | y):
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {i: find(i) for i in sets}


def some_texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    out = [None, "", " \n", "one two", "One two", "one two three four five", "x " * 700]
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(8, 300))
        base += passage * (rng.random() < 0.5)
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def test_groups_equal_brute_force(spark):
    rows = list(enumerate(some_texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()}
    want = least_of_group(rows)
    assert got == want and 20 < len(set(want.values())) < len(rows) - 20


def test_stage_drops_every_near_copy(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(some_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(least_of_group([r[:2] for r in rows]).values())


@pytest.mark.parametrize(("n", "m"), [(2, None), (40, None), (300, None), (1, 1), (30, 50), (200, 3)])
def test_forest_is_a_minimum_one(n, m):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**63, (6, similar.LANES), dtype=np.uint64)

    def some(k):
        flips = rng.integers(0, 2**63, (k, similar.LANES), dtype=np.uint64)
        for _ in range(3):
            flips &= rng.integers(0, 2**63, (k, similar.LANES), dtype=np.uint64)
        return centres[rng.integers(0, 6, k)] ^ flips

    left, right = some(n), None if m is None else some(m)
    x, y, bits = similar.forest(left, right, similar.RADIUS)
    other = left if right is None else right
    d = similar.distances(left, other).astype(int)
    assert (d[x, y] == bits).all() and (bits <= similar.RADIUS).all()
    shift = 0 if right is None else n
    up = list(range(n + (m or 0)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    want = []
    for w, i, j in sorted((d[i, j], i, j) for i in range(n) for j in range(len(other)) if right is not None or i < j):
        a, b = find(i), find(j + shift)
        if w <= similar.RADIUS and a != b:
            up[b] = a
            want.append(int(w))
    assert sorted(bits.tolist()) == want


def test_large_buckets_and_any_tile_give_the_same(spark):
    rng = random.Random(8)
    base = [rng.choice("abcdefghij") * 3 + str(rng.randrange(40)) for _ in range(120)]
    rows = []
    for i in range(150):  # one group of near copies, all with a common passage, and others that share that passage only
        copy = list(base) if i < 110 else [str(rng.random()) for _ in base[:90]] + base[90:]
        copy[rng.randrange(90)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    similar.scratch.ship(spark)
    sketches = similar.scratch.materialise(docs.mapInArrow(similar._sketches, similar.SKETCH), "sketches")
    want = least_of_group(rows)
    for tile in (7, 40, 4096):
        found = similar.candidates(sketches, tile=tile).collect()
        assert len({r.u for r in found} | {r.v for r in found}) >= 110
        if tile == 4096:
            assert len(found) <= similar.KEYS * 150
        prints = sketches.select("doc_id", "fp")
        named = similar.simhash.named(prints, lambda _: similar.links(docs, sketches, tile=tile))  # noqa: B023
        assert {r.doc_id: r.component_id for r in prints.join(named, "fp").collect()} == want


def test_fingerprints_and_keys_equal_plain_ones():
    texts = ["a b c d e f g h", "", "one", "x y z x y z x y z x y"]
    (block,) = similar.blocks(similar.pa.array(texts))
    found, offsets = similar.shingles(block)
    lanes, keys = similar.fingerprints(found, offsets), similar.keys(found, offsets)
    for i in range(len(texts)):
        mine = found[offsets[i] : offsets[i + 1]]
        for lane in range(similar.LANES):
            h = [int(x) for x in similar.mix(mine + np.uint64(lane * int(similar._FACTOR) % 2**64))]
            assert int(lanes[i, lane]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        for k in range(similar.KEYS):
            assert int(keys[i, k]) == min((int(x) for x in similar.mix(mine ^ similar.mix(np.array([k + 1], np.uint64)))), default=0)
