"""Ranked search over many queries at once.

Words are corrected against the keys (exact, then one edit, then two; up to ten keys replace a
word), each word's alternatives form a set, a document must match every set, and matches are scored
by a BM25-style weight over all matched keys plus two boosts for the title."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stopwords import STOPWORDS
from ..sources.scratch import saved, small
from . import analysis, postings
from .fuzzy import Keys, fuzzy_lookup, tiers

K1, B = 1.6, 0.75
MOST_CORRECTIONS = 10


class NotEnoughEntropy(ValueError):
    """A query has no word that can be looked up."""


@dataclass
class Index:
    """Tables of an index."""

    articles: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    stats: DataFrame
    analyser: str = "ascii"
    _keys: Keys | None = None

    @classmethod
    def build(cls, docs: DataFrame, analyser: str = "ascii", dictionary: bool = True) -> Index:
        return cls.of(saved(analysis.ANALYSERS[analyser](docs)), analyser, dictionary)

    @classmethod
    def of(cls, analysed: DataFrame, analyser: str = "ascii", dictionary: bool = True) -> Index:
        """An index over analysed documents, a written table: all of its tables are read from there."""
        arts, posts = postings.articles(analysed), postings.postings(analysed)
        keys = saved(postings.vocabulary(posts, postings.dictionary(analysed) if dictionary else None))
        return cls(arts, posts, keys, postings.corpus_stats(arts), analyser)

    @property
    def keys(self) -> Keys:
        """The vocabulary with its neighbourhoods, which are made once for the index."""
        if self._keys is None or self._keys.vocabulary is not self.vocabulary:
            self._keys = Keys(self.vocabulary)
        return self._keys


def query_words(queries: DataFrame, analyser: str = "ascii") -> DataFrame:
    """query_id, word: the distinct lower-cased words of each query."""
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(analysis.words(F.col("text"), analyser)).alias("w"))
    return rows.select("query_id", F.lower("w").alias("word")).distinct()


def correct(words: DataFrame, vocabulary: DataFrame | Keys) -> DataFrame:
    """word, alternatives, corrected: what each distinct word is searched as. corrected is true where
    keys replace it, false where none could, null where the word is known or not looked up."""
    words = words.select("word").distinct()
    found = tiers(words.filter(analysis.is_good(F.col("word"))), vocabulary, 2)
    found = found.groupBy("word").agg(F.min("k").alias("k"), F.count("*").alias("n"), F.array_sort(F.collect_list("term")).alias("terms"))
    both = words.join(found, "word", "left")
    use = (F.col("k") > 0) & (F.col("n") <= MOST_CORRECTIONS)
    known = ~analysis.is_good(F.col("word")) | F.coalesce(F.col("k") == 0, F.lit(False))
    return both.select(
        "word",
        F.when(use, F.col("terms")).otherwise(F.array("word")).alias("alternatives"),
        F.when(known, F.lit(None).cast("boolean")).otherwise(F.coalesce(use, F.lit(False))).alias("corrected"),
    )


def query_sets(words: DataFrame, corrected: DataFrame, analyser: str = "ascii") -> DataFrame:
    """query_id, word set (sorted array of terms): distinct, without empty sets."""
    named = words.join(corrected.select("word", "alternatives"), "word")
    good = F.filter("alternatives", lambda t: analysis.is_good(t) & ~t.isin(*STOPWORDS))
    terms = F.array_sort(F.array_distinct(stemmed(good) if analyser == "english" else good))
    return named.select("query_id", terms.alias("terms")).filter(F.size("terms") > 0).distinct()


def stemmed(terms: Column) -> Column:
    from ..functions.stem import stem

    @F.pandas_udf("array<string>")
    def stems(col: pd.Series) -> pd.Series:
        return col.map(lambda ws: [stem(w) for w in ws])

    return stems(terms)


def matched_keys(sets: DataFrame, vocabulary: DataFrame | Keys) -> DataFrame:
    """query_id, terms (the set), key: a term's keys are itself, or else all within one edit."""
    terms = sets.select("query_id", "terms", F.explode("terms").alias("word"))
    return terms.join(tiers(terms, vocabulary, 1).select("word", F.col("term").alias("key")), "word").select("query_id", "terms", "key").distinct()


@dataclass
class Ranking:
    """The steps of a ranked search, as tables."""

    words: DataFrame
    corrected: DataFrame
    sets: DataFrame
    keys: DataFrame
    df: DataFrame  # query_id, key, df: the keys with postings
    hits: DataFrame  # query_id, key, doc, tf, positions: in the documents that match the rarest set
    matched: DataFrame  # query_id, doc: documents that match every set
    articles: DataFrame  # the matched documents
    scores: DataFrame  # query_id, doc, score, rank


def search(queries: DataFrame, index: Index, top: int | None = None, skip: int = 0) -> Ranking:
    """Rank the documents for every query; top and skip choose a page of results. A document must hold
    a key of each set, so it is one of those of the set with the fewest postings: only in these are
    other keys looked up, and the postings of frequent keys are read but neither multiplied by the
    queries nor moved."""
    words = saved(query_words(queries, index.analyser))
    corrected = saved(correct(words, index.keys))
    sets = saved(query_sets(words, corrected, index.analyser))
    keys = saved(matched_keys(sets, index.keys))
    posts = index.postings.select(F.col("term").alias("key"), "doc", "tf", "positions")
    asked = saved(keys.select("query_id", "key").distinct())
    names = small(saved(asked.select("key").distinct()))
    counted = names.join(posts.select("key"), "key").groupBy("key").agg(F.count("*").alias("df"))
    df = saved(asked.join(counted, "key"))
    rarest = small(saved(rarest_sets(sets, keys, df)))
    near = saved(rarest.join(posts.select("key", "doc"), "key").select("query_id", "doc").distinct())
    docs = small(saved(near.select("doc").distinct()))
    rows = posts.join(names, "key", "left_semi").join(docs, "doc", "left_semi")
    hits = saved(rows.join(small(asked), "key").join(small(near), ["query_id", "doc"], "left_semi"))
    matched = saved(matching(sets, keys, hits))
    arts = saved(index.articles.join(small(saved(matched.select("doc").distinct())), "doc", "left_semi"))
    scores = rank(words, corrected, df, hits, matched, arts, index.stats, top, skip)
    return Ranking(words, corrected, sets, keys, df, hits, matched, arts, scores)


def rarest_sets(sets: DataFrame, keys: DataFrame, df: DataFrame) -> DataFrame:
    """query_id, key: the keys of each query's set with the fewest postings. A query with a set that has
    none matches nothing and is left out."""
    sizes = keys.join(df, ["query_id", "key"]).groupBy("query_id", "terms").agg(F.sum("df").alias("n"))
    every = sets.join(sizes, ["query_id", "terms"], "left").groupBy("query_id")
    least = every.agg(F.min_by("terms", F.struct("n", "terms")).alias("terms"), F.count("*").alias("all"), F.count("n").alias("held"))
    return keys.join(least.filter("all = held").select("query_id", "terms"), ["query_id", "terms"]).select("query_id", "key").distinct()


def matching(sets: DataFrame, keys: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, doc: any key of each set, all sets."""
    need = sets.groupBy("query_id").agg(F.count("*").alias("n_sets"))
    held = keys.join(hits.select("query_id", "key", "doc"), ["query_id", "key"]).groupBy("query_id", "doc").agg(F.count_distinct("terms").alias("n"))
    return held.join(need, "query_id").filter("n = n_sets").select("query_id", "doc")


def text_scores(df: DataFrame, hits: DataFrame, matched: DataFrame, arts: DataFrame, stats: DataFrame) -> DataFrame:
    """query_id, doc, text_score, n_keys."""
    n_keys = df.groupBy("query_id").agg(F.count("*").alias("n_keys"))
    one = F.broadcast(stats)  # a single row
    rows = hits.join(matched, ["query_id", "doc"]).join(df, ["query_id", "key"]).join(arts.select("doc", "size").filter("size > 0"), "doc").crossJoin(one)
    tf = F.col("tf") / F.col("size")
    m = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.col("avg_len")))
    score = rows.groupBy("query_id", "doc").agg(F.sum(postings.idf(F.col("n"), F.col("df")) * m).alias("text_score"))
    return score.join(n_keys, "query_id")


def title_boosts(words: DataFrame, corrected: DataFrame, df: DataFrame, matched: DataFrame, arts: DataFrame) -> DataFrame:
    """query_id, doc, boost_words, boost_keys: ten times the share of query words among title words
    and ten times the share of matched keys among title terms."""
    q = words.join(corrected, "word").groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("alternatives"))).alias("q"))
    keys = df.groupBy("query_id").agg(F.collect_set("key").alias("keys"))
    titled = arts.select("doc", F.transform("title_words", F.lower).alias("t"), F.transform("title_terms", lambda x: x["term"]).alias("tt"))
    rows = matched.join(titled, "doc").join(q, "query_id").join(keys, "query_id")
    both = F.size(F.array_intersect("q", "t"))
    return rows.select(
        "query_id",
        "doc",
        (10 * both / (F.size("q") + F.size("t") - both)).alias("boost_words"),
        (10 * F.size(F.array_intersect("keys", "tt")) / F.size("keys")).alias("boost_keys"),
    )


def rank(words, corrected, df, hits, matched, arts: DataFrame, stats: DataFrame, top: int | None = None, skip: int = 0) -> DataFrame:
    text = text_scores(df, hits, matched, arts, stats)
    boosts = title_boosts(words, corrected, df, matched, arts)
    score = F.round(F.col("text_score") + F.col("boost_words") + F.col("boost_keys"), 6)
    rows = text.join(boosts, ["query_id", "doc"]).select("query_id", "doc", score.alias("score"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")))
    if top is not None:
        rows = rows.filter((F.col("rank") > skip) & (F.col("rank") <= skip + top))
    return rows


def search_one(text: str, index: Index, top: int = 10, skip: int = 0) -> DataFrame:
    """A page of results of one query; NotEnoughEntropy if it has no word to look up."""
    spark = index.articles.sparkSession
    found = search(spark.createDataFrame([(0, text)], "query_id long, text string"), index, top, skip)
    if found.sets.isEmpty():
        raise NotEnoughEntropy(text)
    return found.scores


__all__ = ["Index", "NotEnoughEntropy", "Ranking", "correct", "fuzzy_lookup", "search", "search_one"]
