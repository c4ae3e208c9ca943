import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.operators import analysis, postings, search, snippets
from lexmill.operators.search import Index, NotEnoughEntropy

DOCS = [
    ("d1", "red apple pie", "the red apple fell far from the apple tree"),
    ("d2", "green pear", "a pear is green and an apple is red"),
    ("d3", "notes", "nothing here about fruit at all really"),
    ("d4", "apple", ""),
    ("d5", "banana", "banana banana apples bananas"),
]


@pytest.fixture(scope="module")
def index(spark):
    return Index.build(spark.createDataFrame(DOCS, "doc string, title string, text string"))


@pytest.mark.parametrize("n, df, want", [(4, 1, 0.847298), (4, 2, 0.4), (10, 1, 1.845827), (10, 5, 0.4), (1000, 10, 4.546835)])
def test_idf(spark, n, df, want):
    assert spark.range(1).select(F.round(postings.idf(F.lit(n), F.lit(df)), 6)).first()[0] == want


def test_postings(index):
    got = {(r.term, r.doc): (r.positions, r.tf) for r in index.postings.collect()}
    assert got["apple", "d1"] == ([-2, 2, 7], 3) and got["apple", "d4"] == ([-1], 1)
    assert ("the", "d1") not in got
    sizes = {r.doc: (r.size, r.maxf) for r in index.articles.collect()}
    assert sizes["d1"] == (9, 3) and sizes["d4"] == (0, 1) and sizes["d5"] == (4, 3)
    assert index.stats.first() == (5, (9 + 9 + 7 + 0 + 4) // 5)


def brute(query, docs=DOCS):
    """Ranked search of words that all are keys."""
    import re

    words = sorted({w.lower() for w in re.findall("[A-Za-z0-9]+", query)})
    good = lambda w: len(w) > 2 and w not in analysis.STOPWORDS
    split = lambda t: [w.lower() for w in re.findall("[A-Za-z0-9]+", t)]
    tf = {d: Counter(w for w in split(t) + split(x) if good(w)) for d, t, x in docs}
    avg = sum(len(split(x)) for _, _, x in docs) // len(docs)
    keys = [w for w in words if good(w)]
    df = {k: sum(k in c for c in tf.values()) for k in keys}
    out = []
    for d, t, x in docs:
        size = len(split(x))
        if not size or not all(k in tf[d] for k in keys):
            continue
        s = 0.0
        for k in keys:
            f = tf[d][k] / size
            s += max(0.4, math.log((len(docs) - df[k] + 0.5) / (df[k] + 0.5))) * f * 2.6 / (f + 1.6 * (0.25 + 0.75 * size / avg))
        both = len(set(words) & set(split(t)))
        s += 10 * both / (len(words) + len(split(t)) - both)
        s += 10 * len(set(keys) & {w for w in split(t) if good(w)}) / len(keys)
        out.append((d, round(s, 6)))
    return sorted(out, key=lambda r: (-r[1], r[0]))


@pytest.mark.parametrize("query", ["apple", "red apple", "green", "nothing fruit"])
def test_ranking_equals_brute_force(index, query):
    got = [(r.doc, r.score) for r in search.search_one(query, index).orderBy("rank").collect()]
    assert [d for d, _ in got] == [d for d, _ in brute(query)]
    assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got, brute(query)))


def test_correction(spark, index):
    words = spark.createDataFrame([(w,) for w in ("appel", "grene", "apple", "zzzzzzz", "xy", "123")], "word string")
    got = {r.word: (r.alternatives, r.corrected) for r in search.correct(words, index.vocabulary).collect()}
    assert got["appel"] == (["apple"], True) and got["apple"] == (["apple"], None)
    assert got["zzzzzzz"] == (["zzzzzzz"], False) and got["xy"] == (["xy"], None) and got["123"] == (["123"], None)


def test_too_many_corrections_are_not_used(spark):
    keys = spark.createDataFrame([(f"ab{c}d",) for c in "efghijklmnop"], "term string")
    words = spark.createDataFrame([("abzd",)], "word string")
    assert search.correct(words, keys).first().corrected is False
    assert search.correct(words, keys.limit(10)).first().corrected is True


def test_misspelt_query_and_pages(index):
    rows = search.search_one("appel", index, top=1, skip=1).collect()
    assert [r.rank for r in rows] == [2]
    with pytest.raises(NotEnoughEntropy):
        search.search_one("of 12", index)


@pytest.mark.parametrize("hits, want", [([5], [(-5, 21)]), ([5, 31], [(-5, 47)]), ([5, 32], [(-5, 21), (22, 48)]), ([], [])])
def test_islands(spark, hits, want):
    rows = spark.createDataFrame([(1, "d", p) for p in [*hits, -3]], "query_id int, doc string, pos int")
    got = snippets.islands(rows).orderBy("part").collect()
    assert [(r.start, r.end) for r in got] == want


def test_snippets(spark):
    text = " ".join(f"w{i}" for i in range(60)) + "."
    docs = spark.createDataFrame([("d", "Big title", text)], "doc string, title string, text string")
    arts = postings.articles(analysis.analyse_english(docs))
    hits = spark.createDataFrame([(1, "d", 3), (1, "d", 50), (1, "d", -2)], "query_id int, doc string, pos int")
    r = snippets.snippets(hits, arts).first()
    assert r.display_title == "Big {title}" and len(r.parts) == 2
    assert r.parts[0].startswith("w0 w1 w2 {w3} w4") and r.parts[1].endswith("w59.")


def test_english_ranking_equals_brute_force(spark):
    """Stems, positions and scores of the full analyser, counted by hand from its words."""
    from lexmill.functions import normalise, tokens

    texts = ["The runner's dogs aren't running home. They ran; dogs run!", "A dog runs home (quickly).", "Cats & dogs don't mix: cats hide.", "Running shoes, running tracks..."]
    docs = [(f"d{k}", t.split(".")[0], t) for k, t in enumerate(texts)]
    index = Index.build(spark.createDataFrame(docs, "doc string, title string, text string"), "english")
    want = {}
    for d, title, text in docs:
        for sign, t in ((-1, title), (1, text)):
            for i, term in normalise.normalise(tokens.words(t)):
                want.setdefault((term, d), []).append(i if sign > 0 else -1 - i)
    assert {(r.term, r.doc): r.positions for r in index.postings.collect()} == want
    size = {d: len(tokens.words(t)) for d, _, t in docs}
    avg, n = sum(size.values()) // len(docs), len(docs)
    for query in ("running dogs", "home", "cats"):
        asked = [w.lower() for w in tokens.words(query)]
        keys = sorted(set(normalise.normalise_drop(asked)))
        scores = {}
        for d, title, _ in docs:
            if all((k, d) in want for k in keys):
                s = 0.0
                for k in keys:
                    df, f = sum((k, e) in want for e in size), len(want[k, d]) / size[d]
                    s += max(0.4, math.log((n - df + 0.5) / (df + 0.5))) * f * 2.6 / (f + 1.6 * (0.25 + 0.75 * size[d] / avg))
                head = [w.lower() for w in tokens.words(title)]
                both = len(set(asked) & set(head))
                scores[d] = s + 10 * both / (len(set(asked)) + len(head) - both) + 10 * len(set(keys) & set(normalise.normalise_drop(tokens.words(title)))) / len(keys)
        got = [(r.doc, r.score) for r in search.search_one(query, index).orderBy("rank").collect()]
        assert [d for d, _ in got] == [d for d, _ in sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))]
        assert all(abs(s - scores[d]) < 2e-6 for d, s in got)


def test_english(spark):
    docs = spark.createDataFrame([("a", "Running shoes", "He runs. They ran quickly & well."), ("b", "", None)], "doc string, title string, text string")
    index = Index.build(docs, "english")
    assert {r.term for r in index.postings.collect()} == {"run", "shoe", "ran", "quick", "well"}
    assert [r.doc for r in search.search_one("running", index).collect()] == ["a"]
