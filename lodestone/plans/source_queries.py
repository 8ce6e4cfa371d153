"""Registered queries of file sources and sinks: each writes a provided table in a format and reads it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lodestone.operators import cluster as C
from lodestone.operators import patterns as P
from lodestone.operators import phylogeny as Y
from lodestone.operators import table as T
from lodestone.sources import files, outputs, tables

from .data import points, table
from .levels import scratch_path

KINDS = ("fasta", "pir", "genbank", "embl", "ig", "stockholm", "clustal", "msf", "selex", "nexus", "phylip")


def _customers(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey"), F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment")


_CUSTOMERS = "(SELECT c_custkey, nullif(c_nationkey, 3)::BIGINT AS c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer)"


def src_table_roundtrip(spark, d):
    path = scratch_path(spark, "table")
    tables.write_table(_customers(spark, d), path, aligned=True)
    return tables.read_table(spark, path).withColumn("c_nationkey", F.coalesce("c_nationkey", F.lit(-1).cast("long")))


def src_table_weights(spark, d):
    path = scratch_path(spark, "weights")
    tables.write_table(_customers(spark, d).select("c_mktsegment", "c_nationkey", (F.col("c_custkey") % 5 + 1).alias("w")), path, sep=";", unknown="*")
    return T.reduce(tables.read_table(spark, path, sep=";", unknown="*", weight=True)).withColumn("c_nationkey", F.coalesce("c_nationkey", F.lit(-1).cast("long")))


def src_schema_saved(spark, d):
    df = _customers(spark, d)
    loaded = tables.load_schema(tables.save_schema(df))
    listed = tables.parse_domains(tables.print_domains(df.select("c_mktsegment", "c_acctbal")))
    kept = tables.apply_schema(df.select("c_mktsegment", F.col("c_acctbal").cast("string").alias("c_acctbal")), listed)
    sums = kept.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    return sums.withColumn("columns", F.lit(",".join(f.name for f in loaded.fields)))


def src_catalog_scan(spark, d):
    schema, options = tables.parse_catalog("separator '|'\nc_custkey long\nc_nationkey int\nc_acctbal double # balance\nc_mktsegment string\n")
    path = scratch_path(spark, "catalog")
    _customers(spark, d).write.options(sep="|", header="false").csv(path)
    return spark.read.schema(schema).options(**options).csv(path).where("c_nationkey is not null").withColumn("c_nationkey", F.col("c_nationkey").cast("long"))


def src_fixed_records(spark, d):
    """Fixed binary records: an integer, a double and eight letters for each customer."""
    import numpy as np
    import pandas as pd

    fields = [("key", "<i8"), ("balance", "<f8"), ("segment", "S10")]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.zeros(len(frame), np.dtype(fields))
        rows["key"], rows["balance"], rows["segment"] = frame["c_custkey"], frame["c_acctbal"], [s.encode() for s in frame["c_mktsegment"]]
        return pd.DataFrame({"name": [f"{frame['part'].iloc[0]}.rec"], "content": [rows.tobytes()]})

    path = scratch_path(spark, "records")
    rows = _customers(spark, d).withColumn("part", F.col("c_custkey") % 4)
    outputs.write_files(rows.groupBy("part").applyInPandas(pack, "name string, content binary"), path)
    return outputs.read_fixed_records(spark, path, fields).select("key", "balance", "segment")


def src_record_index(spark, d):
    """Lines of a text file for each nation: where each record lies, read by place."""
    path = scratch_path(spark, "lines")
    lines = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("c_name")), "\n").alias("text"))
    outputs.write_files(lines.select(F.col("c_nationkey").cast("string").alias("name"), F.encode("text", "utf-8").alias("content")), path)
    index = outputs.record_index(spark, path)
    return index.select(F.col("file").cast("long").alias("nation"), "record", "start", "size")


def src_segments(spark, d):
    """One file of nation names cut in three byte ranges, and a buffer: every line once."""
    path = scratch_path(spark, "segments")
    whole = table(spark, d, "nation").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("text"))
    outputs.write_files(whole.select(F.lit("all").alias("name"), F.encode("text", "utf-8").alias("content")), path)
    size = outputs.record_index(spark, path).agg(F.max(F.col("start") + F.col("size"))).first()[0]
    cuts = [0, size // 3, size // 2, size]
    found = [outputs.read_source(spark, {"segment": path, "start": a, "end": b}).withColumn("source", F.lit("segment")) for a, b in zip(cuts, cuts[1:])]
    found.append(outputs.read_source(spark, {"buffer": ["one", "two"]}).withColumn("source", F.lit("buffer")))
    found.append(outputs.read_source(spark, {"file": path}).withColumn("source", F.lit("file")))
    return reduce(lambda a, b: a.union(b), found)


# --- baskets ---------------------------------------------------------------------------------------


def _items(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tid"), (F.col("l_partkey") % 100).cast("int").alias("item")).distinct()


_ITEMS = "(SELECT DISTINCT l_orderkey AS tid, l_partkey % 100 AS item FROM lineitem)"


def src_binary_baskets(spark, d):
    path = scratch_path(spark, "baskets")
    outputs.write_binary_baskets(_items(spark, d), path, 100)
    return files.read_binary_baskets(spark, path)


def src_customer_baskets(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("tid"), F.col("o_custkey").alias("customer"))
    path = scratch_path(spark, "baskets")
    outputs.write_binary_baskets(_items(spark, d).join(orders, "tid"), path, 100)
    return files.read_binary_baskets(spark, path, customers=True)


def src_basket_conversion(spark, d):
    """Text baskets to binary ones and back: the ids are new, so baskets are compared by their items."""
    text, binary, back = (scratch_path(spark, n) for n in ("text", "binary", "back"))
    files.write_baskets(_items(spark, d), text)
    outputs.write_binary_baskets(files.numbered_baskets(files.read_baskets(spark, text)), binary, 100)
    files.write_baskets(files.read_binary_baskets(spark, binary), back)
    rows = files.read_baskets(spark, back)
    sets = rows.groupBy("tid").agg(F.array_join(F.array_sort(F.collect_list(F.lpad(F.col("item").cast("string"), 2, "0"))), ",").alias("items"))
    return sets.groupBy("items").agg(F.count("*").alias("n"))


def src_text_baskets(spark, d):
    path = scratch_path(spark, "text")
    files.write_baskets(_items(spark, d), path)
    return files.read_baskets(spark, path).groupBy("item").agg(F.count("*").alias("n"))


def src_basket_offsets(spark, d):
    """Four even shares of the baskets in order of their ids: first, last and number."""
    tids = table(spark, d, "orders").select(F.col("o_orderkey").alias("tid"))
    rows = T.numbered(tids, [F.col("tid")])
    n = tids.count()
    share = F.least(F.floor(F.col("_row") / max(1, -(-n // 4))), F.lit(3)).cast("long").alias("part")
    return rows.groupBy(share).agg(F.min("tid").alias("first"), F.max("tid").alias("last"), F.count("*").alias("n"))


def src_presplit_baskets(spark, d):
    """Baskets dealt to three numbered files by their ids and read back with the file's number."""
    base = scratch_path(spark, "ranks")
    for rank in range(3):
        files.write_baskets(_items(spark, d).where(F.col("tid") % 3 == rank), f"{base}/file_{rank}")
    found = [files.read_baskets(spark, f"{base}/file_{rank}").withColumn("rank", F.lit(rank)) for rank in range(3)]
    return reduce(lambda a, b: a.union(b), found).groupBy("rank", "item").agg(F.count("*").alias("n"))


def src_tid_lists(spark, d):
    """Tid lists written by item, and three items read back: only their folders are opened."""
    path = scratch_path(spark, "lists")
    _items(spark, d).withColumn("bucket", F.col("item") % 10).repartition("bucket").write.partitionBy("bucket").parquet(path)
    rows = spark.read.parquet(path).where(F.col("bucket").isin(3, 7) & F.col("item").isin(3, 7, 13))
    return rows.groupBy("item").agg(F.count("*").alias("n"), F.min("tid").alias("first"), F.max("tid").alias("last"))


# --- points, particles, machines -------------------------------------------------------------------


def _float(v):
    return F.round(v.cast("double"), 5)


def src_binary_points(spark, d):
    path = scratch_path(spark, "points")
    outputs.write_binary_points(points(spark, d, 64), path)
    rows = files.read_binary_points(spark, path).select(F.posexplode("x").alias("dim", "v"))
    return rows.groupBy("dim").agg(F.count("*").alias("n"), F.round(F.sum("v"), 3).alias("total"))


def src_text_points(spark, d):
    path = scratch_path(spark, "points")
    x = F.transform("x", lambda v: F.round(v, 4).cast("string"))
    points(spark, d, 8).select(F.concat_ws(" ", F.col("id").cast("string"), F.array_join(x, " ")).alias("value")).write.text(path)
    return files.read_points(spark, path).select(F.col("id").cast("long").alias("id"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


def src_labelled_vectors(spark, d):
    path = scratch_path(spark, "vectors")
    x = F.transform("x", lambda v: F.round(v, 4).cast("string"))
    points(spark, d, 64).select(F.concat_ws(" ", F.col("label").cast("string"), F.array_join(x, " ")).alias("value")).write.text(path)
    rows = files.read_labelled_vectors(spark, path).select("y", F.posexplode("x").alias("dim", "v"))
    return rows.groupBy("y", "dim").agg(F.count("*").alias("n"), F.round(F.sum("v"), 3).alias("total"))


def src_particles(spark, d):
    path = scratch_path(spark, "particles")
    outputs.write_particles(points(spark, d, 3).select("id", "x", (F.col("label") + 1).cast("double").alias("mass")), path)
    rows = files.read_particles(spark, path)
    return rows.groupBy("mass").agg(F.count("*").alias("n"), *[F.round(F.sum(F.col("x")[i]), 3).alias(f"s{i}") for i in range(3)])


def src_hop_outputs(spark, d):
    """Densities and group tags in their binary files and back, joined by particle."""
    rows = points(spark, d, 3).select("id", F.col("x")[0].alias("density"), "label")
    lists = rows.agg(F.array_sort(F.collect_list(F.struct("id", "density", "label"))).alias("p"))

    def pack(batches):
        import pandas as pd

        for batch in batches:
            for p in batch["p"]:
                density, tags = outputs.pack_densities([x["density"] for x in p]), outputs.pack_tags([x["label"] for x in p], 10)
                yield pd.DataFrame({"name": ["a.den", "a.hop"], "content": [density, tags]})

    path = scratch_path(spark, "hop")
    outputs.write_files(lists.mapInPandas(pack, "name string, content binary"), path)
    density, tags = outputs.read_densities(spark, f"{path}/a.den"), outputs.read_tags(spark, f"{path}/a.hop")
    return density.join(tags, "id").groupBy("tag").agg(F.count("*").alias("n"), F.round(F.sum("density"), 3).alias("density"))


def src_sequential_records(spark, d):
    """Three coordinate records for each block of particles, with their lengths around them."""
    import numpy as np
    import pandas as pd

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.array(frame.sort_values("id")["x"].tolist(), "<f4")
        return pd.DataFrame({"name": [f"{frame['block'].iloc[0]}"], "content": [outputs.pack_records([x[:, i].tobytes() for i in range(3)])]})

    path = scratch_path(spark, "sequential")
    outputs.write_files(points(spark, d, 3).withColumn("block", F.col("id") % 8).groupBy("block").applyInPandas(pack, "name string, content binary"), path)
    rows = outputs.read_records(spark, path).select(F.col("file").cast("long").alias("block"), "record", F.explode("values").alias("v"))
    return rows.groupBy("block", "record").agg(F.count("*").alias("n"), F.round(F.sum("v"), 3).alias("total"))


def src_cluster_outputs(spark, d):
    """Clusters of the embeddings' labels as lines of numbers and back."""
    from lodestone.functions import vectors as V

    rows = C.features(points(spark, d, 64), "label", 64)
    n = F.col("n").cast("double")
    out = rows.select("n", V.scale(F.col("sx"), 1 / n).alias("center"), F.sqrt(V.cf_radius2(n, F.col("sx"), F.col("sxx"))).alias("radius"), F.sqrt(V.cf_diameter2(n, F.col("sx"), F.col("sxx"))).alias("diameter"))
    path = scratch_path(spark, "clusters")
    outputs.write_clusters(out, path)
    back = outputs.read_clusters(spark, path)
    return back.select("n", F.round(F.col("center")[0], 5).alias("c0"), F.round(F.col("center")[63], 5).alias("c63"), F.round("radius", 5).alias("radius"), F.round("diameter", 5).alias("diameter"))


def src_attribute_lists(spark, d):
    """A list file for each attribute of the customers, in order of their keys."""
    import pandas as pd

    base = scratch_path(spark, "attributes")
    rows = table(spark, d, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("a"), F.col("c_nationkey").cast("double").alias("b"), F.length("c_mktsegment").alias("class"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("c_custkey")
        texts = ["".join(f"{v!r} {k}\n" for v, k in zip(frame[c].astype(float).tolist(), frame["class"])) for c in ("a", "b")]
        return pd.DataFrame({"name": ["x.att.0", "x.att.1"], "content": [t.encode() for t in texts]})

    outputs.write_files(rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(pack, "name string, content binary"), base)
    lists = files.read_attribute_lists(spark, f"{base}/x", 2)
    return lists.groupBy("attr", "class").agg(F.count("*").alias("n"), F.round(F.sum("val"), 2).alias("total"), F.max("rid").cast("long").alias("last"))


# --- sequences, trees, cases -----------------------------------------------------------------------


def _letters(spark, d):
    """``(id, seq)``: the first 120 of the letters a, c, g and t of each text with as many, in capitals."""
    seq = F.upper(F.regexp_replace("text", "[^acgt]", ""))
    return table(spark, d, "documents").select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("id"), F.substring(seq, 1, 120).alias("seq"), F.length(seq).alias("n")).where("n >= 120").select("id", "seq")


_LETTERS = "(SELECT 's' || doc_id AS id, substr(upper(regexp_replace(text, '[^acgt]', '', 'g')), 1, 120) AS seq FROM documents WHERE length(regexp_replace(text, '[^acgt]', '', 'g')) >= 120)"


def src_sequence_formats(spark, d):
    """Windows of all texts in every sequence format: written, told apart by their content, read back."""
    import pandas as pd

    def pack(frame: pd.DataFrame, number: str) -> pd.DataFrame:
        rows = sorted(zip(frame["id"], frame["seq"]))
        return pd.DataFrame({"name": [f"{k}-{number}" for k in KINDS], "content": [outputs.format_sequences(rows, k).encode() for k in KINDS]})

    path = scratch_path(spark, "sequences")
    outputs.write_files(outputs.packed_batches(_letters(spark, d), pack), path)
    kind = F.regexp_extract("file", r"([a-z]+)-\d+$", 1).alias("kind")
    return files.read_sequences(spark, path).select(kind, "id", F.md5(F.upper("seq")).alias("md5"))


def src_fasta(spark, d):
    path = scratch_path(spark, "fasta")
    files.write_fasta(_letters(spark, d), path)
    return files.read_fasta(spark, path).select("id", "seq")


def src_sequence_index(spark, d):
    """FASTA files, the places of their records, and residues 11 to 30 of every tenth one by its place."""
    import pandas as pd

    def pack(frame: pd.DataFrame, number: str) -> pd.DataFrame:
        return pd.DataFrame({"name": [number], "content": [outputs.format_sequences(sorted(zip(frame["id"], frame["seq"])), "fasta", 60).encode()]})

    path = scratch_path(spark, "indexed")
    outputs.write_files(outputs.packed_batches(_letters(spark, d), pack), path)
    index = outputs.sequence_index(spark, path)
    found = outputs.fetch_sequences(spark, path, index.where(F.col("id").endswith("0")), 11, 30)
    return index.join(found, "id").select("id", "residues", "seq")


def src_single_sequence(spark, d):
    """All after the first header line is one sequence, later headers too."""
    path = scratch_path(spark, "single")
    text = F.concat(F.lit(">first\n"), F.array_join(F.array_sort(F.collect_list("r_name")), "\n>next"), F.lit("*rest"))
    rows = table(spark, d, "region").groupBy(F.lit("one").alias("name")).agg(F.encode(text, "utf-8").alias("content"))
    outputs.write_files(rows, path)
    found = outputs.read_single_sequence(spark, path, "ARNDCQEGHILKMFPSTWYVBZX*")
    return found.select("file", "seq", F.size("codes").alias("n"), F.aggregate("codes", F.lit(0), lambda s, c: s + c).alias("total"))


def src_trees(spark, d):
    """Regions and their nations as a Newick tree of two levels, written, read and walked."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat("n_name", F.lit(":"), F.col("n_nationkey").cast("string")))), ",").alias("kids"))
    n = n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    inner = F.concat(F.lit("("), "kids", F.lit(")'"), "r_name", F.lit("':"), F.col("n_regionkey").cast("string"))
    path = scratch_path(spark, "trees")
    n.agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list(F.regexp_replace(inner, " ", "_"))), ","), F.lit(")root;")).alias("value")).write.text(path)
    tree = Y.parse_newick(files.read_trees(spark, path).first()["newick"])
    rows = Y.tree_rows(Y.parse_newick(Y.write_newick(tree)))
    names = {r[0]: r[2] for r in rows}
    return spark.createDataFrame([(r[2], names.get(r[1], ""), float(r[3])) for r in rows], "name string, parent string, length double")


def src_evidence(spark, d):
    """Cases of a graphical model as CSV with unknown values, and back."""
    path = scratch_path(spark, "evidence")
    cases = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") == 1, "?").otherwise(F.col("l_linestatus")).alias("l_linestatus"))
    cases.write.option("header", True).csv(path)
    return tables.read_evidence(spark, path).groupBy("l_returnflag", F.coalesce("l_linestatus", F.lit("unknown")).alias("l_linestatus")).agg(F.count("*").alias("n"))


def src_snps(spark, d):
    """A label and 48 bases for each text with as many of the letters a, c, g and t."""
    path = scratch_path(spark, "snps")
    _letters(spark, d).select(F.concat(F.when(F.col("id").endswith("1"), "1").otherwise("0"), F.substring("seq", 1, 48)).alias("value")).write.text(path)
    return files.read_snps(spark, path).groupBy("label", "site", "value").agg(F.count("*").alias("n"))


def src_split_by_value(spark, d):
    path = scratch_path(spark, "split")
    T.split_by_value(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", path)
    one = spark.read.parquet(f"{path}/c_mktsegment=BUILDING").withColumn("c_mktsegment", F.lit("BUILDING"))
    rest = spark.read.parquet(path).where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_mktsegment")
    return one.union(rest).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


def src_vertical_parts(spark, d):
    """Supports from tid lists in parts: no item's list is one row."""
    return P.vertical_parts(_items(spark, d), 1, 1000).groupBy("item").agg(F.sum(F.size("tids")).alias("n"), F.min(F.array_min("tids")).alias("first"), F.max(F.array_max("tids")).alias("last"))


QUERIES = {f.__name__: f for f in (
    src_table_roundtrip, src_table_weights, src_schema_saved, src_catalog_scan, src_fixed_records, src_record_index, src_segments, src_binary_baskets,
    src_customer_baskets, src_basket_conversion, src_text_baskets, src_basket_offsets, src_presplit_baskets, src_tid_lists, src_binary_points,
    src_text_points, src_labelled_vectors, src_particles, src_hop_outputs, src_sequential_records, src_cluster_outputs, src_attribute_lists,
    src_sequence_formats, src_fasta, src_sequence_index, src_single_sequence, src_trees, src_evidence, src_snps, src_split_by_value, src_vertical_parts,
)}

_F4 = "(SELECT vec_id AS id, label, unnest(embedding[1:{n}])::FLOAT::DOUBLE AS v, unnest(range({n}))::INT AS dim FROM embeddings)"

ORACLES = {
    "src_table_roundtrip": f"SELECT c_custkey, coalesce(c_nationkey, -1) AS c_nationkey, c_acctbal, c_mktsegment FROM {_CUSTOMERS}",
    "src_table_weights": f"""SELECT c_mktsegment, coalesce(c_nationkey, -1) AS c_nationkey, sum(c_custkey % 5 + 1)::DOUBLE AS _w FROM {_CUSTOMERS} GROUP BY 1, 2""",
    "src_schema_saved": f"SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, 'c_custkey,c_nationkey,c_acctbal,c_mktsegment' AS columns FROM {_CUSTOMERS} GROUP BY 1",
    "src_catalog_scan": f"SELECT * FROM {_CUSTOMERS} WHERE c_nationkey IS NOT NULL",
    "src_fixed_records": f"SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM {_CUSTOMERS}",
    "src_record_index": """SELECT c_nationkey::BIGINT AS nation, row_number() OVER w - 1 AS record, (coalesce(sum(length(c_name) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start,
length(c_name)::BIGINT AS size FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_name)""",
    "src_segments": "SELECT n_name AS value, 'segment' AS source FROM nation UNION ALL SELECT n_name, 'file' FROM nation UNION ALL VALUES ('one', 'buffer'), ('two', 'buffer')",
    "src_binary_baskets": f"SELECT tid, item FROM {_ITEMS}",
    "src_customer_baskets": f"SELECT o_custkey AS customer, tid, item FROM {_ITEMS} JOIN orders ON o_orderkey = tid",
    "src_basket_conversion": f"SELECT items, count(*) AS n FROM (SELECT tid, string_agg(lpad(item::VARCHAR, 2, '0'), ',' ORDER BY item) AS items FROM {_ITEMS} GROUP BY tid) GROUP BY items",
    "src_text_baskets": f"SELECT item::INT AS item, count(*) AS n FROM {_ITEMS} GROUP BY item",
    "src_basket_offsets": """SELECT part, min(tid) AS first, max(tid) AS last, count(*) AS n FROM (SELECT o_orderkey AS tid,
least((row_number() OVER (ORDER BY o_orderkey) - 1) // (((SELECT count(*) FROM orders) + 3) // 4), 3)::BIGINT AS part FROM orders) GROUP BY part""",
    "src_presplit_baskets": f"SELECT (tid % 3)::INT AS rank, item::INT AS item, count(*) AS n FROM {_ITEMS} GROUP BY 1, 2",
    "src_tid_lists": f"SELECT item::INT AS item, count(*) AS n, min(tid) AS first, max(tid) AS last FROM {_ITEMS} WHERE item IN (3, 7, 13) GROUP BY 1",
    "src_binary_points": f"SELECT dim, count(*) AS n, round(sum(v), 3) AS total FROM {_F4.format(n=64)} GROUP BY dim",
    "src_text_points": f"SELECT id, round(sum(round(v, 4)), 4) AS total FROM {_F4.format(n=8)} GROUP BY id",
    "src_labelled_vectors": f"SELECT label::DOUBLE AS y, dim, count(*) AS n, round(sum(round(v, 4)), 3) AS total FROM {_F4.format(n=64)} GROUP BY label, dim",
    "src_particles": f"""SELECT (label + 1)::DOUBLE AS mass, count(*) // 3 AS n, {', '.join(f"round(sum(v) FILTER (dim = {i}), 3) AS s{i}" for i in range(3))} FROM {_F4.format(n=3)} GROUP BY label""",
    "src_hop_outputs": f"SELECT label::BIGINT AS tag, count(*) AS n, round(sum(v), 3) AS density FROM {_F4.format(n=1)} GROUP BY label",
    "src_sequential_records": f"SELECT (id % 8)::BIGINT AS block, dim::BIGINT AS record, count(*) AS n, round(sum(v), 3) AS total FROM {_F4.format(n=3)} GROUP BY 1, 2",
    "src_cluster_outputs": f"""WITH v AS MATERIALIZED {_F4.format(n=64)}, m AS (SELECT label, dim, avg(v) AS m, sum(v) AS s, sum(v * v) AS q, count(*) AS n FROM v GROUP BY ALL)
SELECT max(n) AS n, round(max(m) FILTER (dim = 0), 5) AS c0, round(max(m) FILTER (dim = 63), 5) AS c63, round(sqrt(sum(q) / max(n) - sum(m * m)), 5) AS radius,
round(sqrt(2 * (max(n) * sum(q) - sum(s * s)) / (max(n) * (max(n) - 1))), 5) AS diameter FROM m GROUP BY label""",
    "src_attribute_lists": """WITH r AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS rid, round(c_acctbal, 2) AS a, c_nationkey::DOUBLE AS b, length(c_mktsegment)::INT AS class FROM customer),
u AS (SELECT 0 AS attr, rid, a AS val, class FROM r UNION ALL SELECT 1, rid, b, class FROM r)
SELECT attr::INT AS attr, class, count(*) AS n, round(sum(val), 2) AS total, max(rid) AS last FROM u GROUP BY 1, 2""",
    "src_sequence_formats": f"SELECT kind, id, md5(seq) AS md5 FROM {_LETTERS} CROSS JOIN (VALUES {', '.join(f'({k!r})' for k in KINDS)}) k(kind)",
    "src_fasta": f"SELECT id, seq FROM {_LETTERS}",
    "src_sequence_index": f"SELECT id, length(seq)::BIGINT AS residues, substr(seq, 11, 20) AS seq FROM {_LETTERS} WHERE id LIKE '%0'",
    "src_single_sequence": """WITH t AS (SELECT 'one' AS file, replace(string_agg(r_name, '>next' ORDER BY r_name), ' ', '') AS raw FROM region),
u AS (SELECT file, regexp_replace(raw, '[a-z]', 'X', 'g') AS seq FROM t), c AS (SELECT unnest(string_split(seq, '')) AS c FROM u)
SELECT file, seq, length(seq)::INT AS n, (SELECT sum(instr('ARNDCQEGHILKMFPSTWYVBZX*', c) - 1) FROM c)::INT AS total FROM u""",
    "src_trees": """SELECT replace(n_name, ' ', '_') AS name, replace(r_name, ' ', '_') AS parent, n_nationkey::DOUBLE AS length FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT replace(r_name, ' ', '_'), 'root', r_regionkey::DOUBLE FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL VALUES ('root', '', 0.0)""",
    "src_evidence": "SELECT l_returnflag, CASE WHEN l_linenumber = 1 THEN 'unknown' ELSE l_linestatus END AS l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "src_snps": f"""SELECT CASE WHEN id LIKE '%1' THEN '1' ELSE '0' END AS label, site::INT AS site, (instr('ATGC', substr(seq, (site + 1)::INT, 1)) - 1)::INT AS value, count(*) AS n
FROM {_LETTERS}, range(48) r(site) GROUP BY 1, 2, 3""",
    "src_split_by_value": "SELECT c_mktsegment, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1",
    "src_vertical_parts": f"SELECT item::INT AS item, count(*) AS n, min(tid) AS first, max(tid) AS last FROM {_ITEMS} GROUP BY 1",
}
