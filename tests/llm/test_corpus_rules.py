import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import decontaminate as D
from lexmill.llm import packing as P
from lexmill.llm import quality_rules as R

from .conftest import odd_documents, prose

PT = pytest.importorskip("public_tokenizers")
PATH = PT.path("byte_bpe_50k.json")


# --- quality rules ---


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force():
    texts = [r[1] for r in odd_documents()] + ["a b c d e f g h " * 5, "x\nx\n\n \nx\ny", "é ü ß | < >", "one two three four five six seven eight nine " * 2 + "tail"]
    got = R.statistics(texts)
    assert [tuple(r) for r in got[list(R.COUNTS)].itertuples(index=False)] == [counts(t) for t in texts]
    assert np.isfinite(got[list(R.FEATURES)].to_numpy()).all()


def test_rules_over_odd_documents(odd, none):
    rows = R.quality_rules(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert not by[100].kept and not by[101].kept and not by[107].kept and by[3].kept and by[105].kept
    kept = R.accepted(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert R.quality_rules(none).isEmpty() and R.accepted(none).isEmpty()


def floored(cov):
    floor = np.array(list(R.FEATURES.values()))
    v, u = np.linalg.eigh(cov / np.outer(floor, floor))
    v = np.maximum(v, 1)
    return (u / v) @ u.T / np.outer(floor, floor), np.log(v).sum()


def squared(x, mean, inv):
    return np.einsum("ij,jk,ik->i", x - mean, inv, x - mean)


def mcd_brute(x, starts=60):
    """(centre, scatter, log determinant): many random starts in numpy, exact subsets, each to its end."""
    rng, best = np.random.default_rng(0), None
    h = int(np.ceil(R.CONCENTRATION * len(x)))
    for k in range(starts):
        near, last = rng.permutation(len(x))[:8], None
        while True:
            mean, cov = x[near].mean(0), np.cov(x[near].T, bias=True)
            inv, det = floored(cov)
            if last is not None and det >= last - 1e-9 or len(near) == h and last is None and k < 0:
                break
            last = det if len(near) == h else None
            d = squared(x, mean, inv)
            near = np.argsort(d, kind="stable")[:h]
        if best is None or det < best[2]:
            best = mean, cov * max(1.0, np.median(d) / R.CHI_MEDIAN), det
    return best


def test_distances_equal_brute_force_and_outliers_go(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        words = prose(i, int(rng.integers(30, 300))).split()
        if i % 10 == 0:
            words = [w.upper() + "!!###" for w in words]
        rows.append((i, " ".join(words), "en", "big" if i % 3 else f"small{i % 4}" if i % 50 else f"tiny{i}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    out = {r.doc_id: r for r in R.quality_rules(docs).collect()}
    rows = [r for r in rows if not out[r[0]].base_failed]
    assert all(out[r[0]].kept == bool(r[0] % 10) for r in rows)
    x = R.statistics([t for _, t, _, _ in rows])[list(R.FEATURES)].to_numpy()
    source = np.array([r[3] for r in rows])
    whole = mcd_brute(x)
    # The steps over the table find a determinant as small as many starts of an exact search do.
    stats = R.materialise(R.with_statistics(docs), "stats")
    fine = stats.filter(~R.base_failed(F.col("n_words"), F.col("n_repeat_words")))
    grouped = fine.select(F.explode(F.array(*R.group_names())).alias("grp"), *R.FEATURES)
    counts = R.materialise(grouped.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") >= R.LEAST), "counts")
    found = {r.grp: r for r in R.estimate(grouped, counts).collect()}
    assert set(found) == {"*", "=en", "=en\t=big", *(f"=en\t=small{k}" for k in range(4))}
    assert found["*"].logdet <= whole[2] + 0.05 and found["*"].logdet == pytest.approx(found["=en"].logdet, abs=1e-6)
    for name in ("big", "small1", "small2"):
        mine = mcd_brute(x[source == name])
        assert found[f"=en\t={name}"].logdet <= mine[2] + 0.1
        n = (source == name).sum()
        w, v = n / (n + R.PRIOR), len(x) / (len(x) + R.PRIOR)
        assert v * whole[0] + (1 - v) * whole[0] == pytest.approx(whole[0])
        mean, cov = w * mine[0] + (1 - w) * whole[0], w * mine[1] + (1 - w) * whole[1]
        want = squared(x[source == name], mean, floored(cov)[0])
        got = np.array([out[r[0]].distance for r in rows if r[3] == name])
        assert np.median(abs(got - want) / (want + 1)) < 0.15
    tiny = [r[0] for r in rows if r[3].startswith("tiny")]
    assert tiny and all(out[i].distance is not None for i in tiny)


def test_estimates_depend_neither_on_partitions_nor_on_joins(spark, monkeypatch):
    from lexmill.llm import common

    monkeypatch.setattr(R, "MOST_STEPS", 1)
    monkeypatch.setattr(R, "STARTS", 2)
    rows = [(i, prose(i, 40 + i % 90) + " #" * (i % 7), "en", f"s{i % 3}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {r.doc_id: r.distance for r in R.quality_rules(docs.repartition(1)).collect()}
    monkeypatch.setattr(R, "BROADCAST_ROWS", 5)  # estimates are joined, hot groups salted
    monkeypatch.setattr(common, "HOT_ROWS", 60)
    monkeypatch.setattr(common, "SALTS", 3)
    got = {r.doc_id: r.distance for r in R.quality_rules(docs.repartition(7)).collect()}
    assert want.keys() == got.keys() and all(want[i] == pytest.approx(got[i], rel=1e-6, abs=1e-9) for i in want)


# --- decontamination ---

ITEMS = [(1, prose(500, 40)), (2, prose(501, 20)), (3, "lone"), (4, None), (5, ""), (2, prose(501, 20)), (None, prose(502, 30))]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, similarity int")


def best_brute(items, text, i):
    """Greatest similarity of an item and any window of its length, over plain word pairs."""
    bare = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", t or "").lower().split()
    pairs = lambda w: Counter(zip(w, w[1:])) if len(w) > 1 else Counter([tuple(w)])
    texts = [bare(t) for t in items]
    texts = [t for t in texts if t]
    df = Counter(p for t in texts for p in set(pairs(t)))
    weight = lambda p: np.log1p(len(items) / df[p]) if df[p] else np.log1p(len(items))
    want, words = bare(items[i]), bare(text)
    n = min(len(want), len(words))
    best = 0.0
    for k in range(len(words) - n + 1 if want else 0):
        a, b = pairs(words[k : k + n]), pairs(want)
        best = max(best, sum(weight(p) * c for p, c in (a & b).items()) / sum(weight(p) * c for p, c in (a | b).items()))
    return best


def test_windows_equal_brute_force():
    rng = np.random.default_rng(8)
    items = [prose(600 + k, 15 + 3 * k) for k in range(6)]
    texts = []
    for k in range(140):
        words = items[k % 6].split()
        for j in range(len(words)):
            if rng.random() < 0.04 * (k % 7):
                words[j] = f"new{rng.integers(9999)}"
        texts.append(prose(k, 40) + " " + " ".join(words).title() + ", " + prose(k + 100, int(rng.integers(0, 50))))
    texts += [prose(k, 200) for k in range(30)] + [items[0][: len(items[0]) // 2]]
    table = D.Items.build(list(enumerate(items)), len(items))
    got = {(t, i): s for t, i, s, *_ in D.find(table, texts)}
    near = 0
    for t, text in enumerate(texts):
        for i in range(len(items)):
            want = best_brute(items, text, i)
            if abs(want - D.SIMILARITY) > 1e-6:
                assert ((t, i) in got) == (want > D.SIMILARITY)
            if (t, i) in got:
                assert abs(got[t, i] - want) < 1e-6
                near += D.SIMILARITY <= want < 0.62
    assert near >= 10


def test_lookup_holds_all_within_the_radius():
    rng = np.random.default_rng(1)
    items = D.Items.build([(k, prose(k, 30)) for k in range(50)], 50)
    prints = [items.prints, rng.integers(0, 1 << 16, (3000, 4)).astype(np.uint16)]
    for k in range(300):
        p = np.unpackbits(items.prints[k % 50].view(np.uint8))
        p[rng.permutation(64)[: int(rng.integers(0, 20))]] ^= 1
        prints.append(np.packbits(p)[None].view(np.uint16))
    prints = np.concatenate(prints)
    w, i = items.candidates(prints)
    far = np.unpackbits((prints[:, None, :] ^ items.prints[None]).view(np.uint8), axis=2).sum(axis=2)
    assert set(zip(w, i)) == set(zip(*np.nonzero(far <= D.RADIUS))) and len(w) == len(set(zip(w, i)))
    # The buckets select: of random prints, hardly any meets an item.
    hits = sum(len(D.spread(start, (prints[50:3050, k, None] ^ D._NEAR).astype(np.int64).ravel())[0]) for k, (start, _) in enumerate(items.buckets))
    assert hits < 0.03 * 3000 * 50


def test_matches_over_odd_documents(spark, odd, none, benchmark):
    planted = spark.createDataFrame([(900, prose(1, 30) + "\n" + ITEMS[0][1].upper() + "! " + prose(2, 30)), (901, ITEMS[1][1]), (902, "lone"), (903, " ".join(ITEMS[6][1].split()[:25]))], "doc_id long, text string")
    docs = odd.unionByName(planted, allowMissingColumns=True)
    got = Counter((r.doc_id, r.item_id) for r in D.matches(docs, benchmark).collect())
    assert got == Counter({(900, 1): 1, (901, 2): 2, (902, 3): 1, (903, None): 1})
    left = D.clean(docs, benchmark)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert D.matches(none, benchmark).isEmpty() and D.matches(odd, benchmark.limit(0)).isEmpty() and D.clean(odd, benchmark.limit(0)).count() == odd.count()


def test_items_in_blocks(spark, odd, benchmark):
    """Several blocks give what one gives, rows and kept documents alike."""
    planted = spark.createDataFrame([(900 + k, prose(1, 30) + " " + t + " " + prose(2, 30)) for k, (_, t) in enumerate(ITEMS) if t], "doc_id long, text string")
    docs = odd.unionByName(planted, allowMissingColumns=True)
    key = lambda df: sorted(str(r) for r in df.collect())
    assert key(D.matches(docs, benchmark, 2)) == key(D.matches(docs, benchmark))
    one, many = D.clean(docs, benchmark), D.clean(docs, benchmark, 2)
    assert many.columns == docs.columns and key(many.select("doc_id", "text")) == key(one.select("doc_id", "text"))
    screen = D.Screen.of(D.item_blocks(benchmark, 2))
    texts = [r.text for r in docs.collect()]
    found = {r[0] for r in D.find(next(D.item_blocks(benchmark, 100)), texts)}
    assert found and set(np.flatnonzero(screen.suspect(texts))) >= found


def test_long_texts_of_item_words():
    """A text of items only, longer than a cluster's windows."""
    items = [(k, prose(800 + k, 12)) for k in range(3)]
    table = D.Items.build(items, 3)
    text = " ".join(items[k % 3][1] for k in range(4000))
    assert {(i, round(s, 6)) for _, i, s, *_ in D.find(table, [text])} == {(0, 1.0), (1, 1.0), (2, 1.0)}


def test_blocks_weigh_as_one(spark):
    """Items that are mostly a template, many blocks: the same rows and similarities as one block."""
    template = prose(700, 35)
    items = [(i, (template + " " if i % 3 == 0 else "") + prose(710 + i, 6 if i % 3 == 0 else 30)) for i in range(60)]
    texts = [template, prose(1, 40) + " " + template + " " + prose(2, 40)] + [prose(3, 20) + " " + items[i][1] + " " + prose(4, 20) for i in range(0, 60, 7)]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def found(block):
        tables = list(D.item_blocks(bench, block))
        return len(tables), sorted((r[0], b.ids[r[1]], round(r[2], 9), *r[3:]) for b in tables for r in D.find(b, texts))

    (one, want), (many, got) = found(60), found(4)
    assert one == 1 and many == 15 and got == want and want
    sims = {(t, i): s for t, i, s, *_ in want}
    assert all(abs(s - best_brute([t for _, t in items], texts[t], i)) < 1e-6 for (t, i), s in sims.items())


# --- packing ---


def test_ids_equal_the_tokenizers_own():
    from tokenizers import Tokenizer

    own, mine = Tokenizer.from_file(PATH), P.Encoder(PATH)
    assert mine.fast is not None
    texts = ["", " ", "a  b", " lead", "a\n b", "a \n b", "x<|endoftext|>y", "don't I'LL 12 é  ß\n", "\t\tx", "日本語 text", "a\r\n\r\nb  "] + [t or "" for _, t, _, _ in odd_documents()]
    for t in texts:
        assert np.frombuffer(mine(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids


def test_fullest_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        room = int(rng.integers(1, 40))
        have = Counter(int(x) for x in rng.integers(1, 25, int(rng.integers(0, 9))))
        sums = {0}
        for x in have.elements():
            sums |= {s + x for s in sums}
        got = P.fullest(dict(have), room)
        assert sum(got) == max(s for s in sums if s <= room) and not Counter(got) - have


def test_plan_packs_every_piece_and_fills_bins():
    rng = np.random.default_rng(4)
    counts = Counter(int(x) for x in rng.integers(1, 1024, 5000))
    bins = P.plan(dict(counts))
    used = Counter()
    for lengths, times in bins:
        assert sum(lengths) <= 1024
        for x in lengths:
            used[x] += times
    assert used == counts
    assert sum(t for _, t in bins) <= 1.01 * sum(x * n for x, n in counts.items()) / 1024 + 1


@pytest.mark.parametrize("salt_rows", [P.SALT_ROWS, 7])
def test_packing_odd_documents(odd, none, monkeypatch, salt_rows):
    monkeypatch.setattr(P, "SALT_ROWS", salt_rows)
    rows = P.pack(odd, PATH).collect()
    mine = P.Encoder(PATH)
    want = Counter()
    for i, text, _, _ in odd_documents():
        ids = np.append(np.frombuffer(mine(text or ""), "<u4"), np.uint32(2)).astype("<u4")
        for k, (s, n) in enumerate(P.cut(len(ids), 1024)):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024
    assert P.pack(none, PATH).isEmpty()


# --- the pipeline ---


def test_pipeline(spark, tmp_path):
    """Against the operators' brute-force counterparts, on documents of every kind."""
    import corpus_pipeline as C

    from .test_near_dedup import brute

    german = lambda t: " ".join(w + "ung" for w in t.split())
    rows = [(i, prose(i, 120) if i % 2 else german(prose(i, 120)), "en" if i % 2 else "de", "s") for i in range(260)]
    rows += [(300 + i, rows[i][1] + f" extra{i}", rows[i][2], "s") for i in range(10)]  # near copies
    rows += [(400 + i, prose(i + 50, 60) + " " + ITEMS[0][1] + " " + prose(i + 90, 60), "en", "s") for i in range(5)]
    rows += [(500 + i, " ".join(w.upper() + "###" for w in prose(i, 80).split()), "en", "s") for i in range(8)]
    rows += [(600, None, "en", "s"), (601, "", "en", "s"), (602, "short text", "en", "s"), (603, "12 34 " * 40, "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS[:2], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, kept = docs, []
    for name, stage in C.STAGES:
        out = C.materialise(stage(spark, at, str(tmp_path)), "stage")
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns
            kept.append({r.doc_id for r in out.select("doc_id").collect()})
            at = out
    assert not kept[0] & ({500 + i for i in range(8)} | {600, 601, 602, 603}) and set(range(260)) <= kept[0]
    assert kept[1] >= set(range(260))
    text = {r[0]: r[1] for r in rows}
    roots = brute([(i, text[i]) for i in sorted(kept[1])])[0]
    assert kept[2] == {i for i, r in roots.items() if i == r} and not kept[2] & {300 + i for i in range(10)}
    assert kept[2] - kept[3] == {400 + i for i in range(5)}
    final = {r.doc_id for r in C.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert final == kept[3]


def test_pipeline_over_odd_documents(odd, none, spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns; and an empty table."""
    import corpus_pipeline as C

    for name, docs in (("odd", odd.filter("doc_id is null or doc_id <> 106")), ("none", none)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        at = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, f in C.STAGES:
            out = C.materialise(f(spark, at, f"{tmp_path}/{name}"), "odd")
            if stage != C.STAGES[-1][0]:
                assert out.columns == docs.columns
                assert Counter(r.doc_id for r in out.select("doc_id").collect()) <= Counter(r.doc_id for r in at.select("doc_id").collect())
                at = out
        ids = {r.doc_id for r in out.collect()}
        assert (name == "none") == (not ids)
        if name == "odd":
            assert 3 in ids and 105 in ids and not ids & {100, 101, 102, 103, 104, 107, 108, 109}


def test_sampled_rows_are_the_same_at_every_run(spark):
    from lexmill.llm.common import bounded_sample

    df = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("lab"))
    once = {r.doc_id for r in bounded_sample(df, "lab", 100).collect()}
    again = {r.doc_id for r in bounded_sample(df.repartition(7), "lab", 100).collect()}
    assert once == again and 200 < len(once) < 400
