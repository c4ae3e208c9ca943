"""Pages of an XML encyclopedia dump, plain or bz2, and the filters that choose articles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PAGE = "title string, ns string, revision struct<text: string, sha1: string>"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """title, ns, sha1, text of every page of a dump."""
    rows = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").option("valueTag", "_text").schema(_PAGE).load(path)
    return rows.select("title", F.trim("ns").alias("ns"), F.col("revision.sha1").alias("sha1"), F.col("revision.text").alias("text"))


def is_article(ns: Column, text: Column) -> Column:
    """Main namespace, with text, no redirect; tested before the text is cleaned."""
    return (ns == "0") & text.isNotNull() & (text != "") & (F.lower(F.substring(text, 1, 9)) != "#redirect")


def articles(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """doc, title, text: the articles of a dump, cleaned. Equal sha1 are one article; skip leaves out
    the first pages in order of the file."""
    rows = pages(spark, path)
    if skip:
        first = rows.withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").offset(skip)
        rows = first.drop("_at")
    return clean_articles(rows.filter(is_article(F.col("ns"), F.col("text"))).dropDuplicates(["sha1"]).select(F.col("sha1").alias("doc"), "title", "text"))


def clean_articles(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", unwiki(F.col("text")))


def unwiki(text: Column) -> Column:
    from ..functions.clean import unwiki as plain

    @F.pandas_udf("string")
    def cleaned(col: pd.Series) -> pd.Series:
        return col.map(lambda t: plain(t) if t is not None else None)

    return cleaned(text)


def unescaped(text: Column) -> Column:
    """Character references decoded, twice, as some are written twice."""
    from ..functions.clean import unescape

    @F.pandas_udf("string")
    def plain(col: pd.Series) -> pd.Series:
        return col.map(lambda t: unescape(unescape(t)) if t is not None else None)

    return plain(text)
