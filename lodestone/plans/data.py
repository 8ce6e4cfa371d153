"""Reading the provided tables, and adapters from them to the operators' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(tid, item)``: the distinct brand/type items of each order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("item"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("tid"), "item").distinct()


def brand_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(tid, item)`` with brands as items."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("item"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("tid"), "item").distinct()


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(tid, item, utility)``: quantity times retail price of each brand/type item in an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.concat_ws("/", "p_brand", "p_type").alias("item"))
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("l_orderkey").alias("tid"), "item").agg(F.sum(F.col("l_quantity") * F.col("p_retailprice")).alias("utility"))


def points(spark: SparkSession, sf_dir: str, dims: int = 4) -> DataFrame:
    """``(id, x, label)``: the first dimensions of the embeddings, in double precision."""
    x = F.transform(F.slice("embedding", 1, dims), lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), x.alias("x"), "label")


BASKETS = "(SELECT DISTINCT l_orderkey AS tid, p_brand || '/' || p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
BRANDS = "(SELECT DISTINCT l_orderkey AS tid, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
QUANTITIES = (
    "(SELECT l_orderkey AS tid, p_brand || '/' || p_type AS item, sum(l_quantity * p_retailprice) AS utility "
    "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
)


def points_sql(dims: int = 4) -> str:
    return f"(SELECT vec_id AS id, list_transform(embedding[1:{dims}], lambda v: v::DOUBLE) AS x, label FROM embeddings)"
