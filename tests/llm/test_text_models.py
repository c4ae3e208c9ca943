import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import langid as L
from lexmill.llm import quality_model as Q

from .conftest import prose

FR = "le la les des une avec pour dans être très où père été garçon forêt lumière".split()
EN = "the and with for under being very where father summer boy forest light house".split()


def speech(words, rng, n):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "e"]) for _ in range(n))


@pytest.fixture(scope="module")
def language_model():
    rng = random.Random(2)
    texts = [(speech(FR, rng, rng.randint(5, 80)), "fr") for _ in range(300)] + [(speech(EN, rng, rng.randint(5, 80)), "en") for _ in range(300)]
    return L.train([t for t, _ in texts], [x for _, x in texts])


def test_language_held_out_accuracy(language_model):
    rng = random.Random(9)
    texts = [(speech(w, rng, rng.randint(3, 40)), x) for w, x in ((FR, "fr"), (EN, "en")) for _ in range(200)]
    got, score, rejected = L.judge(language_model, [t for t, _ in texts])
    assert np.mean([a == x for a, (_, x) in zip(got, texts)]) > 0.97
    assert ((score > 0) & (score <= 1)).all() and rejected.mean() < 0.05


def test_logits_are_the_mean_over_subwords(language_model):
    """Scoring in batches equals the embedding average of each text alone, whatever its neighbours."""
    texts = ["le père", "", "x", "the " * 400_000, None, "forêt light"]
    whole = language_model.raw_scores(texts)
    for t, z in zip(texts, whole):
        at, c = L._features(t or "")
        alone = c @ language_model.logits[at] + language_model.bias
        assert np.allclose(z, alone, atol=1e-3)


def test_language_over_odd_documents(odd, none):
    model = L.fit(odd)
    rows = L.predict(odd, model).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    for i in (100, 101, 102, 109):
        assert by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected
    assert {r.lang_pred for r in rows} <= {"en", "de", "und"} and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert L.fit(none) is None and L.predict(none, None).isEmpty()
    assert {r.lang_pred for r in L.predict(odd, None).collect()} == {"und"}
    kept = odd.filter(L.accepted(model))
    assert kept.columns == odd.columns and kept.filter("doc_id in (100, 101, 102, 109)").isEmpty()


def test_language_learns_from_no_held_out_row(spark):
    rows = [(i, speech(FR if i % 2 else EN, random.Random(i), 20), "fr" if i % 2 else "en") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = F.when(L.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))
    model = L.fit(df.withColumn("lang", wrong))
    assert model.langs == ["en", "fr"]


def junk(rng, n):
    return " ".join(rng.choice(EN).upper() + rng.choice(["!!", "###", " |"]) for _ in range(n))


def test_quality_held_out_accuracy(spark):
    rng = random.Random(5)
    rows = [(i, speech(EN, rng, rng.randint(10, 90)) if i % 4 else junk(rng, rng.randint(5, 90)), int(i % 4 > 0)) for i in range(800)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in Q.score(docs, Q.fit(docs, marks)).collect()}
    held = [(out[i].predicted, q) for i, _, q in rows if out[i].held_out]
    assert len(held) > 150 and np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    flipped = marks.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in Q.score(docs, Q.fit(docs, flipped)).collect()}
    assert again == {i: r.score for i, r in out.items()}  # labels of held-out rows say nothing


def test_quality_over_odd_documents(spark, odd, none):
    marks = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] + [(None, 1, 0), (5, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    rows = Q.score(odd, Q.fit(odd, marks)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert Q.score(none, Q.fit(none, marks)).isEmpty()
    assert {r.score for r in Q.score(odd, Q.fit(odd, marks.limit(0))).collect()} == {0.5}
    assert Q.fit(odd, marks.filter("quality = 1")) == 1.0


def test_dual_coordinate_descent_solves_the_hinge_problem():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6)).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * x[:, 1] + 0.1 * rng.normal(size=80) > 0, 1.0, -1.0)
    at = [np.arange(6)] * 80
    w, b = Q.dual_coordinate_descent(at, list(x), y, 1.0, 300, 0)

    def loss(v, c):
        return 0.5 * (v @ v + c * c) + np.maximum(0, 1 - y * (x @ v + c)).sum()

    best = loss(w[:6], b)
    for _ in range(300):
        assert best <= loss(w[:6] + rng.normal(0, 0.05, 6), b + rng.normal(0, 0.05)) + 1e-2


def test_indicators_are_distinct():
    slot = np.zeros(1 << Q.BITS, np.int32)
    at = Q.indicators(prose(1, 500) * 3, slot)
    assert len(at) == len(set(at.tolist())) and len(Q.indicators("", slot)) == len(Q.indicators(None, slot)) == 0


def test_packed_indicators():
    rng = np.random.default_rng(4)
    for n in (0, 1, 8191, 8192, 100_000):
        at = np.sort(rng.permutation(1 << Q.BITS)[:n]).astype(np.int32)
        packed = Q._packed(at)
        assert np.array_equal(Q._unpacked(packed), at) and len(packed) <= (1 << Q.BITS) // 8


def test_quality_equals_brute_force(spark):
    """Scores of the whole texts, by plain sums over each text's own buckets; what lies beyond any
    number of characters of a training text counts."""
    rng = random.Random(6)
    tail = lambda k: " ".join(["zq!"] * 40 if k % 2 else ["fine"] * 40)
    rows = [(i, speech(EN, rng, 4000 if i < 60 else 30) + " " + tail(i), i % 2 ^ 1) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, marks)
    out = {r.doc_id: r for r in Q.score(docs, model).collect()}
    assert np.mean([out[i].predicted == q for i, _, q in rows if out[i].held_out]) > 0.97
    slot = np.zeros(1 << Q.BITS, np.int32)
    for i, t, _ in rows[::37]:
        at = sorted(set(Q.indicators(t, slot).tolist()))
        total = sum(float(model.weight[k]) for k in at) / math.sqrt(sum(float(model.ratio[k]) ** 2 for k in at) + model.damp)
        assert out[i].score == pytest.approx(1 / (1 + math.exp(-(model.slope * (model.bias + total) + model.shift))), rel=1e-4)


def test_language_equals_brute_force(spark, language_model):
    rows = [(i, speech((FR, EN)[i % 2], random.Random(i), 1 + i * 7 % 90)) for i in range(60)]
    out = {r.doc_id: r for r in L.predict(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), language_model).collect()}
    for i, t in rows:
        at, share = L._features(t)
        z = (share.astype(np.float64) @ language_model.logits[at].astype(np.float64) + language_model.bias) / language_model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert out[i].lang_pred == language_model.langs[int(p.argmax())] and out[i].score == pytest.approx(p.max(), abs=2e-3)
