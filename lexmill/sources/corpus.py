"""Documents from the tables of a corpus directory: (doc, title, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL_SPLIT = 4 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt out to all cores where the scan is so small (SMALL_SPLIT bytes a core) that its files
    may be one task's; larger scans have splits enough and aren't shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return rows.repartition(cores) if int(str(size)) <= cores * SMALL_SPLIT else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of a document is its first line."""
    return from_documents(spread(table(spark, sf_dir, "documents")))


def from_documents(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc_id").cast("string").alias("doc"), F.substring_index("text", "\n", 1).alias("title"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages with their titles; tags are blanks."""
    rows = spread(table(spark, sf_dir, "pages"))
    html = F.coalesce("html", F.lit(""))
    return rows.select(
        F.col("page_id").cast("string").alias("doc"), F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_replace(html, "<[^>]*>", " ").alias("text")
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
