import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators.distance import as_bytes, deletions, osa
from lexmill.operators.fuzzy import fuzzy_lookup, tiers, word_query


def osa_brute(a: bytes, b: bytes) -> int:
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i, j] = i + j
                continue
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def found_brute(w: str, t: str, k: int) -> bool:
    a, b = w.encode(), t.encode()
    if k == 0:
        return a == b
    if osa_brute(a, b) <= k:
        return True
    m = len(a) // 2
    return len(a) >= 2 and osa_brute(a[: m - 1] + a[m : m + 1] + a[m - 1 : m] + a[m + 1 :], b) <= k - 1


PAIRS = [
    ("kitten", "sitting", 3), ("teh", "the", 1), ("search", "saerch", 1), ("seach", "search", 1),
    ("café", "cafe", 2), ("naïve", "naive", 2), ("ca", "abc", 3), ("cbc", "bacc", 3), ("", "ab", 2), ("ab", "", 2), ("", "", 0),
]


def test_osa(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(400)]
    rows = [(a, b, n) for a, b, n in PAIRS] + [(a, b, osa_brute(a.encode(), b.encode())) for a, b in zip(words, reversed(words))]
    df = spark.createDataFrame(rows, "a string, b string, n int")
    got = df.select("a", "b", "n", osa(as_bytes(F.col("a")), as_bytes(F.col("b"))).alias("d")).collect()
    assert [r for r in got if r.n != r.d] == []


def test_deletions(spark):
    row = spark.createDataFrame([("abca", "")], "w string, e string").select(deletions(F.col("w"), 2).alias("x"), deletions(F.col("e"), 2).alias("y")).first()
    brute = {"abca"[:i] + "abca"[i + 1 :] for i in range(4)}
    brute |= {x[:i] + x[i + 1 :] for x in brute for i in range(3)} | {"abca"}
    assert sorted(row.x) == sorted(brute) and row.y == [""]


@pytest.mark.parametrize("k", [0, 1, 2])
def test_lookup_equals_brute_force(spark, k):
    rng = random.Random(k)
    make = lambda n, top: sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, top))) for _ in range(n)})
    words, keys = make(60, 6) + ["cbc", "ca", "a"], make(200, 6) + ["bacc", "abc", "b"]
    w = spark.createDataFrame([(x,) for x in words + words[:3]] + [(None,)], "word string")
    t = spark.createDataFrame([(x,) for x in keys + keys[:3]] + [(None,)], "term string")
    got = {(r.word, r.term) for r in fuzzy_lookup(w, t, k).collect()}
    assert got == {(a, b) for a in set(words) for b in set(keys) if found_brute(a, b, k)}


def test_tiers_stop_at_the_first_that_finds(spark):
    w = spark.createDataFrame([("abc",), ("abx",), ("azz",), ("qqqqq",)], "word string")
    t = spark.createDataFrame([("abc",), ("abd",)], "term string")
    got = {(r.word, r.term, r.k) for r in tiers(w, t, 2).collect()}
    assert got == {("abc", "abc", 0), ("abx", "abc", 1), ("abx", "abd", 1), ("azz", "abc", 2), ("azz", "abd", 2)}


def test_word_query(spark):
    w = spark.createDataFrame([("abc",)], "word string")
    t = spark.createDataFrame([("abc",), ("abd",), ("abe",), ("zzz",)], "term string")
    p = spark.createDataFrame([("abc", "d1", [0, 3], 2)], "term string, doc string, positions array<int>, tf int")
    page = word_query(w, t, None, 1, limit=1, offset=1).collect()
    assert [(r.term, r.exact_total) for r in page] == [("abd", 3)]
    full = {(r.term, r.doc, tuple(r.positions or ())) for r in word_query(w, t, p, 1).collect()}
    assert full == {("abc", "d1", (0, 3)), ("abd", None, ()), ("abe", None, ())}
