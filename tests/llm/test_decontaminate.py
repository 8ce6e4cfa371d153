import random
import re

from lodestone.llm import decontaminate, queries

WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def _prose(rng, n):
    return " ".join(rng.choices([w.replace("w", "") + "x" for w in WORDS], k=n))


ITEM = "Anna has 12 apples and Peter has 7 apples. How many kg more does Anna carry after 12 days than Peter in spring"


def _find(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.item_id, r.verdict) for r in decontaminate.find(d, b).collect()), key=str)


def test_templates_and_slots(spark):
    rng = random.Random(2)
    other = "so Bob" + ITEM[4:].replace("Peter", "Mary").replace("12", "31").replace(" 7 ", " 9 ").replace("Anna", "Bob")
    item = "so " + ITEM
    torn = item.replace("12 apples", "31 apples").replace("12 days", "44 days")
    docs = [
        (0, _prose(rng, 40) + " " + item + " " + _prose(rng, 40), 1),
        (1, "Well, " + other, 1),
        (2, item.upper() + ".", 1),
        (3, _prose(rng, 300), 1),
        (4, item[:60], 1),
        (5, None, 1),
        (6, "", 1),
        (7, "tiny item?", 1),
        (None, item, 1),
        (0, item.replace(" ", "  \n", 4), 1),
        (8, item + " " + _prose(rng, 5) + " " + item, 1),
        (9, "tiny big item", 1),
    ]
    items = [(5, item), (6, None), (7, ""), (8, "Tiny item"), (9, item), (None, "** !!")]
    got = _find(spark, docs, items)
    assert [g for g in got if g[0] in (3, 4, 5, 6, 9)] == []
    assert (7, 8, "exact") in got
    for doc in (0, None, 8):
        assert (doc, 5, "exact") in got and (doc, 9, "exact") in got
    assert (1, 5, "reparameterised") in got
    assert _find(spark, [], items) == [] and _find(spark, docs, []) == []
    # 12 stands for both 31 and 44: the windows of one of them are dropped.
    frame = spark.createDataFrame([(1, torn)], "doc_id long, text string")
    rows = decontaminate.find(frame, spark.createDataFrame([(1, item)], "item_id long, text string"), 0.1).collect()
    assert rows[0].n_covered < rows[0].n_item_words and rows[0].verdict == "reparameterised"


UNITS = set(decontaminate.UNITS.split())


def plain_words(text):
    """[(template, own)] of each word, word by word."""
    out, stopped = [], True
    for line in (text or "").split("\n"):
        stopped = True
        for raw in re.findall(r"[^\x20\x09-\x0D]+", line):
            core = re.sub(r"^[^0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff]+$", "", raw)
            if core:
                low = core.lower()
                digit, letter = any(c.isdigit() for c in core), any(not c.isdigit() and (c.isalpha() or ord(c) > 127) for c in core)
                name = not stopped and not digit and core[0].isupper() and len(core) > 1 and core[1].islower()
                kind = "<quantity>" if digit and letter else "<number>" if digit else "<name>" if name else "<unit>" if low in UNITS else low
                out.append((kind, low))
            stopped = raw[-1] in ".!?:|" if core else stopped
    return out


def plain_pairs(docs, items, coverage=0.8):
    found = []
    for doc_id, text in docs:
        d = plain_words(text)
        for item_id, wanted in items:
            w = plain_words(wanted)
            n = min(5, len(w))
            hits = [
                (i, j) for j in range(len(w) - n + 1) for i in range(len(d) - n + 1)
                if n and [k for k, _ in d[i : i + n]] == [k for k, _ in w[j : j + n]] and not all(k[0] == "<" for k, _ in w[j : j + n])
            ]
            if not hits or len({p for _, j in hits for p in range(j, j + n)}) < coverage * len(w):
                continue
            best = (0, 0, False)
            for copy in {(i - j) // len(w) for i, j in hits}:
                mine = [(i, j) for i, j in hits if (i - j) // len(w) in (copy, copy + 1)]
                fill = [[(w[j + k][1], d[i + k][1]) for k in range(n) if w[j + k][0][0] == "<"] for i, j in mine]
                votes = {}
                for f in fill:
                    for pair in set(f):
                        votes[pair] = votes.get(pair, 0) + 1
                key = lambda x: int(decontaminate.hash_of(x))
                forth, back = {}, {}
                for a, b in sorted(votes, key=lambda p: (-votes[p], key(p[0]), key(p[1]))):
                    if a not in forth and b not in back:
                        forth[a], back[b] = b, a
                covered, equal = set(), True
                for (_, j), f in zip(mine, fill):
                    if all(forth.get(a) == b for a, b in f):
                        covered |= set(range(j, j + n))
                        equal = equal and all(a == b for a, b in f)
                slots = sum(w[p][0][0] == "<" for p in covered if any(j <= p < j + n for _, j in hits))
                best = max(best, (len(covered), slots, equal))
            if best[0] >= coverage * len(w):
                found.append((doc_id, item_id, len(w), best[0], best[1], "exact" if best[2] else "reparameterised"))
    return sorted(found, key=str)


def test_all_verdicts_equal_brute_force(spark):
    rng = random.Random(11)
    names, items, docs = ["Anna", "Bob", "Carla", "Peter", "Maria", "Tom"], [], []
    for i in range(12):
        words = []
        for _ in range(rng.randint(3, 40)):
            words.append(rng.choice([rng.choice(names), str(rng.randint(1, 30)), f"{rng.randint(1, 9)}kg", rng.choice(["kg", "days", "metres"]), *["".join(rng.choices("abcde", k=4))] * 6]))
        items.append((i, "so " + " ".join(words)))
    for i in range(60):
        text = items[rng.randrange(12)][1]
        for _ in range(rng.randint(0, 6)):
            old, new = rng.choice([*names, "7", "12", "kg"]), rng.choice([*names, "99", "8", "days"])
            text = re.sub(rf"\b{old}\b", new, text, count=rng.randint(0, 3))
        words = text.split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "zzzz"
        docs.append((i, f"{_prose(rng, 5)} {' '.join(words)} {_prose(rng, 4)}" + (" " + text if i % 9 == 0 else "")))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.find(d, b).collect()), key=str)
    want = plain_pairs(docs, items)
    assert got == want and {v for *_, v in want} == {"exact", "reparameterised"}
    kept = {r.doc_id for r in decontaminate.clean(d, b).collect()}
    assert kept == {i for i, _ in docs} - {w[0] for w in want}


def test_rows_that_share_an_id_are_told_apart(spark):
    item = "the old mill by the river ran for many years"
    rows = [(1, item, "x"), (1, "something else altogether here", "y"), (None, item, "x"), (None, None, "y"), (2, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    left = decontaminate.clean(docs, spark.createDataFrame([(1, item), (1, item)], "item_id long, text string"))
    assert left.columns == docs.columns and sorted((r.word, str(r.doc_id)) for r in left.collect()) == [("y", "1"), ("y", "2"), ("y", "None")]


def test_query_equals_brute_force_on_exact_passages(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    norm = lambda t: [x for w in re.findall(r"[^\x20\x09-\x0D]+", t.lower()) if (x := re.sub(r"^[^0-9a-z\x80-\U0010ffff]+|[^0-9a-z\x80-\U0010ffff]+$", "", w))]
    places = {}
    for i, t in items.items():
        w = norm(t)
        for k in range(len(w) - 4):
            places.setdefault(tuple(w[k : k + 5]), set()).add((i, k))
    want = set()
    for d, t in docs.items():
        w, cover = norm(t), {}
        for k in range(len(w) - 4):
            for i, p in places.get(tuple(w[k : k + 5]), ()):
                cover.setdefault(i, set()).update(range(p, p + 5))
        want |= {(d, i) for i, c in cover.items() if len(c) >= 0.8 * len(norm(items[i]))}
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontaminate(spark, sf).collect()}
    assert want and got == want
