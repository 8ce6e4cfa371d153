import corpus_pipeline
import public_tokenizers
from lodestone.llm import decontaminate, language, ngram, site_quality
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_similar import least_of_group

SF = "/root/testdata/sf0.001"


def test_stages_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    now, ids = docs, {*texts}
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = corpus_pipeline.scratch.materialise(stage(spark, now, SF), name)
        assert after.columns == docs.columns
        if name == "language":
            training = ~ngram.held_out(F.col("doc_id"), 4, 2)
            gone = {r.doc_id for r in language.predict(now, language.fit(now, training)).collect() if r.rejected}
        elif name == "quality":
            gone = {r.doc_id for r in site_quality.judge(now, labels).collect() if not r.kept}
            good = {r.doc_id for r in labels.where("quality = 1").collect()}
            assert gone and not gone & good
        elif name == "near_duplicates":
            gone = {i for i, least in least_of_group([(r.doc_id, r.text) for r in now.collect()]).items() if i != least}
        else:
            gone = {r.doc_id for r in decontaminate.find(now, items).collect()}
        ids -= gone
        assert {r.doc_id for r in after.collect()} == ids
        now = after
    out = corpus_pipeline.run(spark, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id for r in out} == ids and len(out) == len(ids)
    for r in out:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_stages_on_odd_and_empty_tables(spark):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "the cat " * 30, None, "s", 1), (None, "the cat sat " * 30, "en", "s", 2),
            (3, "the dog ran off " * 30, "en", "s", 2), (3, "the dog ran off " * 30, "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("ids", F.lit(1))
    for now in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            now = corpus_pipeline.scratch.materialise(stage(spark, now, SF), "odd")
            assert now.columns == docs.columns
        corpus_pipeline.encode(spark, now, SF).collect()
