"""Rows and sizes that the small tables don't have."""

import duckdb

import __spark_entry__ as entry

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, path, *texts):
    rows = [(k, t, "en", "src0", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(f"{path}/documents.parquet")


def equals_sql(spark, path, name, tables=("documents",)):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    want = db.sql(entry.oracle_sql()[name])
    key = lambda r: tuple(map(str, r))
    got = entry.queries()[name](spark, str(path)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key)


def test_wiki_markup_of_texts_without_letters(spark, tmp_path):
    documents(spark, tmp_path, "Ñ.", "", None, "12 34", "x", "a x b", "plain words")
    equals_sql(spark, tmp_path, "wiki_markup")


def test_lookup_by_numbers_equals_the_folds(spark):
    """All pairs of short strings of few letters, where swaps and edits meet, and long keys."""
    import itertools

    from pyspark.sql import functions as F

    from lexmill.operators import fuzzy
    from lexmill.operators.distance import as_bytes, osa

    short = ["".join(p) for n in range(1, 5) for p in itertools.product("abé", repeat=n)]
    long = ["x" * 62 + "ab", "x" * 62 + "ba", "x" * 63, "y" + "x" * 65]
    words = spark.createDataFrame([(w,) for w in [*short[::3], *long]], "word string")
    keys = spark.createDataFrame([(t,) for t in [*short, *long]], "term string")
    for k in (1, 2):
        near = osa(F.col("probe"), as_bytes(F.col("term"))) <= F.col("budget")
        every = fuzzy.probes(words.filter(F.length("word") < 9), k).crossJoin(keys.filter(F.length("term") < 9)).filter(near)
        want = {(r.word, r.term) for r in every.select("word", "term").collect()}
        got = {(r.word, r.term) for r in fuzzy.fuzzy_lookup(words, keys, k).collect()}
        assert {p for p in got if len(p[0]) < 9} == want
        assert {p for p in got if len(p[0]) > 9} >= {(long[0], long[1]), (long[1], long[0]), (long[0], long[0])}
        assert ((long[0], long[2]) in got) == (k == 2)
        assert ((long[2], long[3]) in got) is False and ((long[0], long[3]) in got) is False


def test_frequent_keys_are_not_multiplied_by_queries(spark):
    """Only documents of a query's rarest set are looked into."""
    from lexmill.operators.search import Index, search

    docs = [(f"d{k}", "", "common words" + " rare" * (k == 7)) for k in range(60)]
    index = Index.build(spark.createDataFrame(docs, "doc string, title string, text string"))
    found = search(spark.createDataFrame([(0, "common rare"), (1, "words common rare")], "query_id long, text string"), index)
    assert found.hits.count() == 5 and {r.doc for r in found.scores.collect()} == {"d7"}
    assert {(r.query_id, r.key): r.df for r in found.df.collect()} == {(0, "common"): 60, (0, "rare"): 1, (1, "words"): 60, (1, "common"): 60, (1, "rare"): 1}


def test_a_task_holds_a_slice_of_its_batch():
    import pyarrow as pa

    from lexmill.operators import analysis

    texts = ["a" * n for n in (analysis.SLICE * 2, 10, 20)] + ["b" * 1000] * 5000 + [None, ""]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    got = list(analysis.slices(iter([batch])))
    assert [t for b in got for t in b.column(0).to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(0).to_pylist()) <= analysis.SLICE for b in got)


def test_only_asked_columns_are_made(spark):
    from lexmill.operators.analysis import analyse_ascii

    docs = spark.createDataFrame([("a", "t", "red Apple red")], "doc string, title string, text string")
    assert analyse_ascii(docs, ("doc", "size", "maxf")).collect() == [("a", 3, 2)]


def test_merging_moves_only_documents_of_several_batches(spark):
    from lexmill.operators import postings

    kind = "term string, doc string, positions array<int>, tf int"
    a = spark.createDataFrame([("x", "1", [-1, 4], 2), ("y", "2", [0], 1)], kind)
    b = spark.createDataFrame([("x", "3", [7], 1), ("y", "2", [0, 5], 2)], kind)
    once = spark.createDataFrame([("1",), ("2",), ("3",)], "doc string")
    assert "Exchange" not in postings.merge_postings(a, b.filter("doc = '3'"), docs=once)._jdf.queryExecution().executedPlan().toString()
    twice = once.unionByName(once.filter("doc = '2'"))
    got = {(r.term, r.doc): (r.positions, r.tf) for r in postings.merge_postings(a, b, docs=twice).collect()}
    assert got == {("x", "1"): ([-1, 4], 2), ("x", "3"): ([7], 1), ("y", "2"): ([0, 5], 2)}


def test_only_feeds_with_older_versions_are_joined(spark, tmp_path):
    from lexmill.operators.analysis import analyse_ascii
    from lexmill.sources import store as S

    docs = lambda *rows: spark.createDataFrame(list(rows), "doc string, title string, text string")
    store = S.create_store(spark, f"file://{tmp_path}/s")
    for rows in ([("a", "", "old words"), ("b", "", "stays")], [("a", "", "older words")], [("a", "", "new words"), ("c", "", "third")]):
        store.feed(analyse_ascii(docs(*rows)))
    assert sorted(store._again()) == [0, 1]
    assert {(r.term, r.doc) for r in store.postings().collect()} == {("stays", "b"), ("new", "a"), ("words", "a"), ("third", "c")}
