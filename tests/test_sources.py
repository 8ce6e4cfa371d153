import numpy as np
import pytest
from lodestone.operators import cluster
from lodestone.sources import files, tables
from lodestone.streaming import incremental

SAMPLES = {
    "fasta": ">a first one\nACGT\nAC\n>b\nGGT\n",
    "pir": ">P1;a\nfirst one\nACGTAC*\n>P1;b\n\nGGT*\n",
    "stockholm": "# STOCKHOLM 1.0\n#=GS a DE first one\na ACGTAC\nb GGT---\n//\n",
    "clustal": "CLUSTAL W (1.8)\n\na ACG\nb GGT\n  *\n\na TAC\nb ---\n",
    "msf": "x MSF: 6 Type: N\n Name: a\n//\na ACG\nb GGT\n\na TAC\nb ---\n",
    "genbank": "LOCUS a 6\nDEFINITION first one\nORIGIN\n 1 acgt ac\n//\nLOCUS b 3\nORIGIN\n 1 ggt\n//\n",
    "embl": "ID   a; x\nDE   first one\nSQ   Sequence\n     acgtac 6\n//\nID   b; x\nSQ   S\n     ggt 3\n//\n",
    "ig": "; remark\na\nACGTAC1\n; remark\nb\nGGT1\n",
    "phylip": "2 6\na ACG\nb GGT\nTAC\n---\n",
    "nexus": "#NEXUS\nbegin data;\nmatrix\na ACG\nb GGT\n\na TAC\nb ---\n;\nend;\n",
    "selex": "a ACG\nb GGT\n\na TAC\nb ---\n",
}


@pytest.mark.parametrize("kind", sorted(SAMPLES))
def test_sequence_formats(spark, tmp_path, kind):
    (tmp_path / "x").write_text(SAMPLES[kind])
    got = {r.id: (r.description, r.seq.upper().replace("-", "")) for r in files.read_sequences(spark, str(tmp_path / "x")).collect()}
    assert {k: v[1] for k, v in got.items()} == {"a": "ACGTAC", "b": "GGT"}
    if kind in ("fasta", "pir", "stockholm", "genbank", "embl"):
        assert got["a"][0] == "first one"


def test_fasta_round_trip(spark, tmp_path):
    rows = [("a", "one two", "ACGT" * 40), ("b", "", "G")]
    files.write_fasta(spark.createDataFrame(rows, "id string, description string, seq string"), f"{tmp_path}/f")
    assert sorted(map(tuple, files.read_fasta(spark, f"{tmp_path}/f").collect())) == rows


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("sex, age, drug, w\nmale, 20, A, 2\nfemale, ?, B, 1.5\n")
    df = tables.read_table(spark, str(tmp_path / "t.csv"), weight=True)
    assert dict(df.dtypes) == {"sex": "string", "age": "bigint", "drug": "string", "_w": "double"}
    assert [tuple(r) for r in df.collect()] == [("male", 20, "A", 2.0), ("female", None, "B", 1.5)]
    tables.write_table(df.drop("_w"), f"{tmp_path}/out", aligned=True)
    assert [tuple(r) for r in tables.read_table(spark, f"{tmp_path}/out").orderBy("drug").collect()] == [("male", 20, "A"), ("female", None, "B")]
    schema = tables.parse_domains(tables.print_domains(df) + "\ndom(extra) = IR;")
    assert schema["sex"].metadata["values"] == ["female", "male"] and schema["extra"].dataType.simpleString() == "double"
    fixed = tables.apply_schema(df.withColumn("extra", df.age), schema)
    assert fixed.count() == 2 and tables.load_schema(tables.save_schema(df)) == df.schema
    catalog, options = tables.parse_catalog("separator ';'\nx double\nwhen date # note\n")
    assert options == {"sep": ";"} and catalog["when"].dataType.simpleString() == "timestamp"


def test_baskets(spark, tmp_path):
    (tmp_path / "b.txt").write_text("1 2 5\n2\n\n5 1 1\n")
    got = files.read_baskets(spark, str(tmp_path / "b.txt")).groupBy("tid").count().collect()
    assert sorted(r["count"] for r in got) == [1, 2, 3]
    (tmp_path / "b.bin").write_bytes(files.pack_baskets([(7, [1, 2]), (9, [3])], 4))
    assert sorted(map(tuple, files.read_binary_baskets(spark, str(tmp_path / "b.bin")).collect())) == [(7, 1), (7, 2), (9, 3)]
    (tmp_path / "c.bin").write_bytes(files.pack_baskets([(7, [1, 2]), (9, [3])], 4, customers=[1, 2]))
    assert sorted(map(tuple, files.read_binary_baskets(spark, str(tmp_path / "c.bin"), customers=True).collect())) == [(1, 7, 1), (1, 7, 2), (2, 9, 3)]


def test_points(spark, tmp_path):
    (tmp_path / "p.txt").write_text("7 1 2.5\n8 3 4\n")
    assert [tuple(r) for r in files.read_points(spark, str(tmp_path / "p.txt")).collect()] == [("7", [1.0, 2.5]), ("8", [3.0, 4.0])]
    assert files.read_labelled_vectors(spark, str(tmp_path / "p.txt")).first().y == 7
    (tmp_path / "p.bin").write_bytes(np.array([2, 2], "<i4").tobytes() + np.array([1, 2, 3, 4], "<f4").tobytes())
    assert [r.x for r in files.read_binary_points(spark, str(tmp_path / "p.bin")).collect()] == [[1.0, 2.0], [3.0, 4.0]]
    (tmp_path / "q.bin").write_bytes(np.arange(8, dtype="<f4").tobytes())
    assert [r.mass for r in files.read_particles(spark, str(tmp_path / "q.bin")).collect()] == [3.0, 7.0]
    for i in range(2):
        (tmp_path / f"r.att.{i}").write_text("5 0\n6 1\n")
    assert files.read_attribute_lists(spark, f"{tmp_path}/r", 2).count() == 4
    (tmp_path / "s.txt").write_text("1ATG\n0ANG\n0CCC\n")
    assert [r.value for r in files.read_snps(spark, str(tmp_path / "s.txt"), 3).orderBy("rid", "site").collect()] == [0, 1, 2, 3, 3, 3]
    (tmp_path / "t.nwk").write_text("(a,b);\n(a,\nc);\n")
    assert [r.newick for r in files.read_trees(spark, str(tmp_path / "t.nwk")).collect()] == ["(a,b);", "(a,c);"]
    assert files.read_matrix("# m\n A C\nA 1 -1\nC -1 2\n")["C", "C"] == 2


def test_stream_equals_batch(spark, tmp_path):
    source = f"{tmp_path}/in"
    df = spark.createDataFrame([(t, i) for t in range(20) for i in range(t % 4)], "tid long, item int")
    df.repartition(3).write.parquet(source)
    query = incremental.supports(spark.readStream.schema(df.schema).parquet(source), f"{tmp_path}/sums", f"{tmp_path}/cp")
    query.processAllAvailable()
    query.stop()
    got = {r.item: r.support for r in incremental.running_supports(spark, f"{tmp_path}/sums").collect()}
    assert got == {r.item: r["count"] for r in df.groupBy("item").count().collect()}
    points = spark.createDataFrame([(i % 2, [float(i), 1.0]) for i in range(10)], "g int, x array<double>")
    points.write.parquet(f"{tmp_path}/pin")
    query = incremental.features(spark.readStream.schema(points.schema).parquet(f"{tmp_path}/pin"), f"{tmp_path}/cf", f"{tmp_path}/cp2", "g", 2)
    query.processAllAvailable()
    query.stop()
    got = {r.g: (r.n, r.sx) for r in incremental.running_features(spark, f"{tmp_path}/cf", "g", 2).collect()}
    assert got == {r.g: (r.n, r.sx) for r in cluster.features(points, "g", 2).collect()}
