"""Edit distance over UTF-8 bytes, inside the JVM.

osa() is the optimal string alignment distance (insert, delete, substitute, swap neighbours; no
part is edited twice), as a fold over the rows of the usual table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FAR = 1 << 20


def as_bytes(word: Column) -> Column:
    """The word's UTF-8 bytes as one character each, so that string functions count bytes."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def from_bytes(word: Column) -> Column:
    return F.decode(F.encode(word, "ISO-8859-1"), "UTF-8")


def osa(a: Column, b: Column) -> Column:
    """Distance of two byte strings (as_bytes)."""
    n, m = F.length(a), F.length(b)

    def row(acc: Column, i: Column) -> Column:
        prev, before = acc["prev"], acc["before"]
        mine, last = F.substring(a, i, F.lit(1)), F.substring(a, i - 1, F.lit(1))

        def cell(done: Column, j: Column) -> Column:
            theirs = F.substring(b, j, F.lit(1))
            swapped = (i > 1) & (j > 1) & (mine == F.substring(b, j - 1, F.lit(1))) & (last == theirs)
            return F.concat(
                done,
                F.array(
                    F.least(
                        prev[j] + 1,
                        done[j - 1] + 1,
                        prev[j - 1] + F.when(mine == theirs, 0).otherwise(1),
                        F.when(swapped, before[j - 2] + 1).otherwise(_FAR),
                    )
                ),
            )

        return F.struct(F.aggregate(F.sequence(F.lit(1), m), F.array(i), cell).alias("prev"), prev.alias("before"))

    edge = F.sequence(F.lit(0), m)
    table = F.aggregate(F.sequence(F.lit(1), n), F.struct(edge.alias("prev"), edge.alias("before")), row, lambda acc: acc["prev"][m])
    return F.when(n == 0, m).when(m == 0, n).otherwise(table)


def deletions(word: Column, most: int) -> Column:
    """The word and what is left of it after up to `most` deletions, each once."""

    def shorter(w: Column) -> Column:
        cut = F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
            lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))),
        )
        return F.when(F.length(w) > 0, cut).otherwise(F.array(w))

    every = F.array(word)
    layer = every
    for _ in range(most):
        layer = F.array_distinct(F.flatten(F.transform(layer, shorter)))
        every = F.array_union(every, layer)
    return every


def swapped_middle(word: Column) -> Column:
    """The word with the two bytes at its middle swapped (for two bytes or more)."""
    m = F.floor(F.length(word) / 2).cast("int")
    return F.concat(
        F.substring(word, F.lit(1), m - 1), F.substring(word, m + 1, F.lit(1)), F.substring(word, m, F.lit(1)), F.substring(word, m + 2, F.length(word))
    )
