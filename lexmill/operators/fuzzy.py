"""Typo-tolerant lookup of words among keys.

A word finds the keys within k edits (optimal string alignment over bytes); for words of two bytes
or more, also those within k - 1 edits of the word with its middle swapped. Candidates come from an
equi-join of deletion neighbourhoods, which is complete: each edit is at most one deletion on either
side. So no pair is looked at that has no common remainder. Up to MOST_WORDS words are sent to the
tasks, and keys stream past them once; beyond that, and for keys of more than LONGEST bytes, the
neighbourhoods are tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved
from .distance import as_bytes, deletions, osa, swapped_middle
from .remainders import Remainders

MOST_WORDS, LONGEST = 10_000, 64


def probes(words: DataFrame, k: int) -> DataFrame:
    """word, probe, budget: what has to be searched for each word, as byte strings."""
    w = as_bytes(F.col("word"))
    own = F.struct(w.alias("probe"), F.lit(k).alias("budget"))
    if k == 0:
        return words.select("word", own.alias("p")).select("word", "p.*")
    swapped = F.struct(swapped_middle(w).alias("probe"), F.lit(k - 1).alias("budget"))
    every = F.when(F.length(w) >= 2, F.array(own, swapped)).otherwise(F.array(own))
    return words.select("word", F.explode(every).alias("p")).select("word", "p.*")


def neighbourhood(vocabulary: DataFrame, k: int) -> DataFrame:
    """term, key, rest: what is left of each key after up to k deletions. Written once, it serves any
    number of lookups."""
    # Keys are spread first, over a stated number of partitions, as each is multiplied.
    n = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = vocabulary.select("term").filter("term is not null").repartition(n, "term").distinct()
    return keys.select("term", as_bytes(F.col("term")).alias("key")).select("term", "key", F.explode(deletions(F.col("key"), k)).alias("rest"))


def _joined(words: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """Candidates by a join; terms: a neighbourhood."""
    sides = probes(words, k).select("word", "probe", "budget", F.explode(deletions(F.col("probe"), k)).alias("rest"))
    alike = F.abs(F.length("probe") - F.length("key")) <= F.col("budget")
    return sides.join(terms, "rest").filter(alike).select("word", "probe", "budget", "term", "key").distinct()


def _streamed(words: DataFrame, vocabulary: DataFrame, k: int) -> DataFrame:
    """(word, term) among keys of up to LONGEST bytes; words: few."""
    sides = [(r.word, r.probe, r.budget) for r in probes(words, k).collect()]
    near = Remainders([p.encode("latin-1") for _, p, _ in sides], [b for *_, b in sides], k)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = pa.array([s[0] for s in sides], pa.string())
        for batch in it:
            terms = batch.column(0).cast(pa.large_string())
            ends = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1] if len(terms) else np.zeros(1, np.int64)
            data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)
            for key, side in near.find(data, ends[:-1], np.diff(ends), LONGEST):
                yield pa.RecordBatch.from_arrays([named.take(pa.array(side)), terms.take(pa.array(key)).cast(pa.string())], ["word", "term"])

    return vocabulary.select("term").filter("term is not null").mapInArrow(run, "word string, term string").distinct()


def fuzzy_lookup(words: DataFrame, vocabulary: DataFrame, k: int, near: Callable[[], DataFrame] | None = None) -> DataFrame:
    """(word, term): the keys that each word finds with up to k corrections.

    words: column word; vocabulary: column term; near: gives neighbourhood(vocabulary, k), if it may be
    at hand. Nulls find nothing; equal rows count once."""
    words = words.select("word").filter("word is not null").distinct()
    first = words.limit(MOST_WORDS + 1).collect()
    few = len(first) <= MOST_WORDS
    if few:
        words = words.sparkSession.createDataFrame(first, "word string")
    if k == 0:
        keys = vocabulary.select("term")
        return (F.broadcast(words) if few else words).join(keys, F.col("word") == F.col("term")).select("word", "term").distinct()
    if not few or k > 2:
        return _verified(_joined(words, near() if near else neighbourhood(vocabulary, k), k))
    if not first:
        return words.select("word", F.col("word").alias("term"))
    found = _streamed(words, vocabulary, k)
    if any(len(r.word.encode()) > LONGEST - k for r in first):
        long = lambda rows, c, n: rows.filter(F.octet_length(c) > n)
        rest = _joined(long(words, "word", LONGEST - k), neighbourhood(long(vocabulary, "term", LONGEST), k), k)
        found = found.unionByName(_verified(rest))
    return found


def _verified(found: DataFrame) -> DataFrame:
    """(word, term) of the candidates within their budgets."""
    # The plain distance, which is compiled code, is never below: what it admits needs no fold. Where
    # it is d above the budget, d edits must be swaps (a swap is two plain edits), which leaves
    # budget - d edits for letters that one side lacks.
    plain = F.levenshtein("probe", "key")
    letters = [F.split(F.col(c), "") for c in ("probe", "key")]
    strange = F.greatest(F.size(F.array_except(*letters)), F.size(F.array_except(*reversed(letters))))
    swapped = F.when(strange <= 2 * F.col("budget") - plain, osa(F.col("probe"), F.col("key")) <= F.col("budget"))
    return found.filter(F.when(plain <= F.col("budget"), True).otherwise(F.coalesce(swapped, F.lit(False)))).select("word", "term").distinct()


class Keys:
    """A vocabulary with its neighbourhoods, each made when first needed."""

    def __init__(self, vocabulary: DataFrame):
        self.vocabulary = vocabulary
        self._near: dict[int, DataFrame] = {}

    def near(self, k: int) -> DataFrame | None:
        if k and k not in self._near:
            self._near[k] = saved(neighbourhood(self.vocabulary, k))
        return self._near.get(k)


def tiers(words: DataFrame, vocabulary: DataFrame | Keys, most: int) -> DataFrame:
    """(word, term, k): the keys of the first k of 0..most that finds any. Only words that a tier
    leaves over go on to the next, and a tier without words costs nothing."""
    keys = vocabulary if isinstance(vocabulary, Keys) else Keys(vocabulary)
    left = saved(words.select("word").filter("word is not null").distinct())
    out = None
    for k in range(most + 1):
        found = saved(fuzzy_lookup(left, keys.vocabulary, k, lambda k=k: keys.near(k)).withColumn("k", F.lit(k)))
        out = found if out is None else out.unionByName(found)
        if k < most:
            left = saved(left.join(found.select("word").distinct(), "word", "left_anti"))
            if left.isEmpty():
                break
    return out


def word_query(
    words: DataFrame, vocabulary: DataFrame, postings: DataFrame | None, k: int = 0, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """word, term, exact_total and, unless postings is None (keys only), doc, positions and tf: keys
    in byte order; limit and offset, if given, choose among a word's keys. A key without postings
    has nulls there."""
    from pyspark.sql import Window

    found = fuzzy_lookup(words, vocabulary, k)
    by_word = Window.partitionBy("word")
    found = found.withColumn("exact_total", F.count("*").over(by_word))
    if limit is not None or offset:
        rank = F.row_number().over(by_word.orderBy(F.encode("term", "UTF-8")))
        found = found.withColumn("_rank", rank).filter(F.col("_rank") > offset)
        if limit is not None:
            found = found.filter(F.col("_rank") <= offset + limit)
        found = found.drop("_rank")
    return found if postings is None else found.join(postings, "term", "left")
