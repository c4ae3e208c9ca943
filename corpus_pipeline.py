"""The corpus pipeline: quality rules, language ID, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and reads again as the next stage's docs. All but the last return the columns of
documents. A stage works on all rows that the one before it kept:

1. quality rules: rows that the rules reject go;
2. language ID: rows without a determined language, or below the calibrated threshold, go;
3. near-dedup: of each group of linked documents the one with the smallest doc_id stays;
4. decontamination: rows whose text holds a benchmark item go;
5. packing: one row a piece, with its place in a sequence.

Rows with null or empty text are rejected by the first stage (too few words); an empty table goes
through as empty tables; rows that repeat a doc_id and its text are kept or dropped together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import decontaminate, langid, near_dedup, packing, quality_rules
from lexmill.llm.common import materialise, read_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.filter(langid.accepted(langid.fit(docs)))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.distinct(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("language ID", keep_identified),
    ("near-dedup", keep_distinct),
    ("benchmark decontamination", keep_uncontaminated),
    ("best-fit packing", pack),
]

#: No SQL expresses these stages; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
