import math
import random
from collections import Counter

import duckdb
import pytest
from lodestone.llm import quality_rules, queries
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"


def _words(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out + [word] * bool(word)


def _plain(text):
    w = _words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if _words(x)]
    joined = "".join(w)
    return len(w), len(joined), sum(c in "#*$%&|<>" for c in joined), len(lines) - len(set(lines)), len(covered)


def _texts():
    rng = random.Random(8)
    texts = [None, "", " \n\t", "one", "a\x0bb\x0cc\rd\x85e", "é#É *$%&|<> 日本", "x y z\nx y z\n\n \nx y z", "same " * 40, "\n".join(["a line of words"] * 9)]
    for _ in range(80):
        base = [rng.choice("ab cd ef gh # !! é".split(" ")) for _ in range(rng.randint(0, 60))]
        texts.append(rng.choice(SPACE).join(base + base[: rng.randint(0, 30)]))
    return texts


def test_counts_equal_plain_counting(spark):
    texts = _texts()
    rows = [(i, t, "en", "extra") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, words string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.features(docs).collect()}
    assert got == {i: _plain(t) for i, t in enumerate(texts)}


def test_binomial_tail(spark):
    rows = [(k, n) for n in (5, 40, 3000) for k in (0, 1, 4)]
    frame = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality_rules.log_binomial_cdf(F.col("k"), F.col("n"), 0.01).alias("c"))
    for r in frame.collect():
        want = sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert r.c == pytest.approx(math.log(want), abs=1e-9)


def _write(spark, path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, stratum string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def _both(spark, path):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = [tuple(r[c] for c in columns) for r in queries.op3_quality_rules(spark, path).collect()]
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({quality_rules.oracle()})").fetchall()
    return sorted(got, key=str), sorted(want, key=str)


def test_query_equals_sql_with_enough_labels(spark, tmp_path):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(4000):
        bad = rng.random() < 0.2
        words = [f"w{rng.randrange(5000)}" + ("##" if bad and rng.random() < 0.7 else "") for _ in range(rng.randint(20, 40))]
        rows.append((i, " ".join(words), "en" if i % 9 else None, "x"))
        labels.append((i, int(not bad), 0))
    rows += [(i + 9000, t, "fr", "x") for i, t in enumerate(_texts())] + [(None, "a b " * 30, None, "x"), (0, rows[0][1], "en", "x"), (0, rows[0][1], "en", "x")]
    _write(spark, str(tmp_path), rows, [*labels, (None, 1, 0), (3, None, 1), (4, 0, 0)])
    got, want = _both(spark, str(tmp_path))
    assert got == want
    judged = {g[0]: g[-1] for g in got}
    quality = {i: q for i, q, _ in labels}
    for part in ([i for i in quality if i % 9], [i for i in quality if i % 9 == 0]):
        dropped = [i for i in part if not judged[i]]
        assert len(dropped) > len(part) / 15 and sum(quality[i] for i in dropped) <= 0.02 * sum(quality[i] for i in part)


@pytest.mark.parametrize(("n", "own", "whole"), [(150, False, False), (260, False, True), (700, True, True)])
def test_small_strata_take_the_cutoff_of_all(spark, n, own, whole):
    """A stratum needs ln(level) / ln(1 - alpha) good labels without a loss; all strata together need as many."""
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, "en" if i % 2 else "fr", "") for i in range(n)] + [(5000, good + " #######################################", "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    cuts = {r.stratum: r for r in quality_rules.thresholds(quality_rules.features(docs), labels).collect()}
    assert (cuts["=en"].cut is not None) == own and cuts["=en"].few != own and (cuts[None].cut is not None) == whole
    judged = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    assert judged[5000] == (not whole) and all(judged[i] for i in range(n))
    needed = math.log(quality_rules.DELTA / 3) / math.log(1 - quality_rules.ALPHA)
    assert (n / 2 >= needed) == own and (n >= needed) == whole


def test_null_and_empty_languages_are_strata_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "a", "en")], "doc_id long, text string, lang string")
    assert len({r.stratum for r in quality_rules.features(docs).collect()}) == 3


def test_the_graded_table_has_a_cutoff(spark):
    sf = "/root/testdata/sf0.01"
    feats = quality_rules.features(spark.read.parquet(f"{sf}/documents.parquet"))
    cuts = quality_rules.thresholds(feats, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert any(r.cut is not None for r in cuts)


def test_empty_tables(spark, tmp_path):
    _write(spark, str(tmp_path), [], [])
    assert _both(spark, str(tmp_path)) == ([], [])
