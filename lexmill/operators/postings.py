"""The inverted index: postings, document and corpus statistics.

Body positions are ordinals from 0 among all words, title positions are -1 - ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved, small


def token_rows(analysed: DataFrame) -> DataFrame:
    """doc, pos, term: a row for every indexed word of title and body."""
    return analysed.select("doc", F.explode("posts").alias("p")).select("doc", F.explode("p.positions").alias("pos"), F.col("p.term").alias("term"))


def in_order(positions: Column) -> Column:
    """Title positions by their place in the title, then body positions."""
    up = F.array_sort(positions)
    return F.concat(F.reverse(F.filter(up, lambda p: p < 0)), F.filter(up, lambda p: p >= 0))


def postings(analysed: DataFrame) -> DataFrame:
    """term, doc, positions, tf. Terms are grouped within each row already: nothing is shuffled."""
    rows = analysed.select("doc", F.explode("posts").alias("p"))
    return rows.select("p.term", "doc", "p.positions", F.size("p.positions").alias("tf"))


def merge_postings(*parts: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Postings of several batches as one: positions of a term and document are united. docs: doc, a row
    for each time that a batch holds a document; then only documents with several are brought together."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if docs is not None:
        again = saved(docs.groupBy("doc").count().filter("count > 1").select("doc"))
        if again.isEmpty():
            return rows.select("term", "doc", "positions", "tf")
        again = small(again)
        alone = rows.join(again, "doc", "left_anti").select("term", "doc", "positions", "tf")
        return alone.unionByName(merge_postings(rows.join(again, "doc", "left_semi")))
    merged = rows.groupBy("term", "doc").agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("p"))
    return merged.select("term", "doc", in_order(F.col("p")).alias("positions"), F.size("p").alias("tf"))


def batched(posts: DataFrame, batch: Column, *held: str) -> DataFrame:
    """batch, term, parts (doc and the columns held, or else positions): the postings of a term in a batch of documents as one record. A batch holds a
    bounded number of documents, and so does a record, however frequent its term is."""
    part = F.struct("doc", *(held or ("positions",)))
    return posts.groupBy(batch.alias("batch"), "term").agg(F.array_sort(F.collect_list(part)).alias("parts"))


def articles(analysed: DataFrame) -> DataFrame:
    """The documents with their size (all body words) and greatest term frequency; documents without
    an indexed word are left out."""
    return analysed.filter("maxf > 0").drop("posts", "surface")


def corpus_stats(arts: DataFrame) -> DataFrame:
    """One row: n, and avg_len, the average size rounded down."""
    return arts.agg(F.count("*").alias("n"), F.floor(F.sum("size") / F.count("*")).cast("long").alias("avg_len"))


def vocabulary(posts: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """The keys: terms of the postings, and of a dictionary without postings."""
    keys = posts.select("term")
    return (keys if extra is None else keys.unionByName(extra.select("term"))).distinct()


def dictionary(analysed: DataFrame) -> DataFrame:
    """Lower-cased surface words of four letters or more, for spelling correction; no postings."""
    return analysed.select(F.explode("surface").alias("term")).distinct()


def document_frequency(posts: DataFrame, n: DataFrame) -> DataFrame:
    """term, df, cf, idf: documents and occurrences of each term, and its weight."""
    by_term = posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return by_term.crossJoin(F.broadcast(n.select("n"))).select("term", "df", "cf", idf(F.col("n"), F.col("df")).alias("idf"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.4), F.ln((n - df + 0.5) / (df + 0.5)))
