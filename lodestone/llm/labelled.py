"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(labels: DataFrame, grade: str, rows: int) -> tuple[DataFrame, dict[int, float]]:
    """``(doc_id, grade)`` of about ``rows`` documents, as many of each grade, and each grade's weight.

    Of several labels of a document the greatest grade counts. A grade with fewer documents gives all that it has; the weight is
    documents for each sampled one. Which ones are taken depends on ``doc_id`` alone.
    """
    grades = labels.select("doc_id", F.expr(grade).cast("int").alias("grade")).where("doc_id is not null and grade is not null")
    grades = grades.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    sizes = {r.grade: r.n for r in grades.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return grades.limit(0), {}
    each = rows / len(sizes)
    share = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, each / n))])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    return grades.where(chance < share[F.col("grade")]).limit(4 * rows), {g: max(1.0, n / each) for g, n in sizes.items()}
