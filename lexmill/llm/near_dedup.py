"""MinHash near-duplicates by an LSH forest.

A document's set is its distinct 5-word shingles (its whole word sequence, where it has fewer).
Documents of equal sets are joined by a digest first; one representative of each set goes on.

The forest: each of its trees sorts the MinHash signatures by its own order of the signature's
values. Documents with the longest common prefixes are neighbours in it. The depth to which prefixes
must agree adapts to the region: it starts shallow (LEVELS), and a region of up to REGION documents
gives all its pairs. A fuller region is split by more values of the same order; its documents also
enter trees that start at that depth, so that a pair at the threshold is missed about as rarely as
before (about one in a million). In regions that are still too full at the last depth, documents are
sorted by what their order goes on with: each is paired with its neighbours, with one more on the
side of the longer common prefix, and with the region's first.

Candidates whose signatures agree too little (five standard errors below the threshold) go. The rest
are verified on full sets, in two rounds: for each document its likeliest and its smallest partner,
then those pairs whose ends aren't connected yet. So a group of n copies costs about n comparisons.
Links are put together by alternating large-star and small-star steps.

Full regions of the last depth whose documents aren't connected by then are searched in full: those
that share documents make a crowd, and all pairs of a crowd are compared by exact set sizes, in
square blocks of two buckets each. That is quadratic in the size of such a crowd, and in nothing else.

Joins on a region, a region's first, a set that many copies share, or a component's root are salted
where one key holds many rows.

Defined results: documents without words (or with null text) have an empty set and are alone; rows
that repeat a doc_id are one document, with the links of all its texts, kept or dropped together; a null doc_id is alone, with null
component_id, and kept; an empty table gives no rows; extra columns are ignored, or kept by distinct().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, Words, batches, discard, hot_keys, materialise, mix, shingle_hashes, spread_join, text_chunks

SHINGLE = 5
THRESHOLD = 70  # per cent
HASHES = 128
#: (depth, trees): shallow prefixes first; a level's trees are those of the level before and more.
#: Pairs at the threshold are missed with a chance of (1 - 0.7 ** depth) ** trees.
LEVELS = ((2, 20), (4, 48), (7, 160))
REGION = 32
SURELY_LESS = 0.5  # share of equal signature values below which a pair can't reach the threshold
FURTHER = 16  # values after the last depth by which full regions are sorted, one byte of each
HOT_STAR = 100_000  # a root with more nodes has its joins checked for hot keys
BUCKET_DOCS = 2000  # documents and shingles of a crowd's bucket, about; two buckets make a block
BUCKET_SHINGLES = 2_000_000

_XOR = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)).astype(np.uint32)
_MUL = (mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_set(word_hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's words."""
    n = len(word_hashes)
    return np.unique(shingle_hashes(word_hashes, min(n, SHINGLE)) if n else word_hashes)


def sets_of(texts: list[str | None]) -> Iterator[np.ndarray]:
    for _, _, part in text_chunks(texts):
        w = Words(part)
        h = w.hashes()
        for a, b in zip(w.first[:-1], w.first[1:]):
            yield shingle_set(h[a:b])


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each of HASHES hash functions, as 32-bit values."""
    x = (shingles >> np.uint64(20)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for first in range(0, len(x), 1024):
        block = x[first : first + 1024, None] ^ _XOR
        block *= _MUL
        np.minimum(out, block.min(axis=0), out=out)
    return out


SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"


def sketches(docs: DataFrame) -> DataFrame:
    """Set size, set digest and signature of every document (null where the set is empty)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            n, keys, sigs = [], [], []
            for s in sets_of(pdf["text"].tolist()):
                n.append(len(s))
                keys.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8") if len(s) else (None, None))
                sigs.append(signature(s).astype("<u4").tobytes() if len(s) else None)
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].astype("Int64"),
                    "n_shingles": n,
                    "set_a": pd.array([k[0] for k in keys], "Int64"),
                    "set_b": pd.array([k[1] for k in keys], "Int64"),
                    "signature": pd.Series(sigs, dtype=object),
                }
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, SKETCH)


def orders() -> np.ndarray:
    """The signature values that each tree sorts by, first to last. Trees share no value of their
    prefixes while there are enough."""
    depth, count = LEVELS[-1]
    rng = np.random.default_rng(1000)
    rows: list[np.ndarray] = []
    while len(rows) < count:
        p = rng.permutation(HASHES)
        for i in range(0, HASHES - depth + 1, depth):
            rest = np.setdiff1d(np.arange(HASHES), p[i : i + depth])
            rows.append(np.concatenate([p[i : i + depth], rng.permutation(rest)[:FURTHER]]))
    return np.array(rows[:count])


def prefixes(sigs: DataFrame, level: int) -> DataFrame:
    """region (hash of tree and prefix), tree and doc_id. sigs: doc_id, signature and, after the first
    level, the trees in which the document's region was full (column full): of the trees of the level
    before, only these are extended. At the last level also what the order goes on with."""
    depth, count = LEVELS[level]
    chosen, last = orders()[:count], level + 1 == len(LEVELS)
    before = LEVELS[level - 1][1] if level else 0
    seed = mix(np.arange(count, dtype=np.uint64) + np.uint64(level << 20))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches(it):
            for first in range(0, len(whole), 2000):
                pdf = whole.iloc[first : first + 2000]
                m = np.frombuffer(b"".join(pdf["signature"]), "<u4").reshape(-1, HASHES).astype(np.uint64)
                key = np.broadcast_to(seed, (len(m), count)).copy()
                for k in range(depth):
                    key = mix(key ^ m[:, chosen[:, k]])
                use = np.ones((len(m), count), bool)
                if level:
                    use[:, :before] = False
                    use[np.repeat(np.arange(len(m)), [len(x) for x in pdf["full"]]), np.concatenate([*pdf["full"], []]).astype(np.int64)] = True
                row, tree = np.nonzero(use)
                out = pd.DataFrame({"region": key[row, tree].view(np.int64), "tree": tree.astype(np.int16), "doc_id": pdf["doc_id"].to_numpy(np.int64)[row]})
                if last:
                    small = (mix(m) & np.uint64(255)).astype(np.uint8)
                    rest = small[row[:, None], chosen[tree, depth : depth + FURTHER]]
                    out["rest"] = pd.Series([r.tobytes() for r in rest], dtype=object)
                yield out

    return sigs.mapInPandas(run, "region long, tree short, doc_id long" + ", rest binary" * last)


def regions(sigs: DataFrame, level: int) -> DataFrame:
    """region, tree, doc_id, n, hub: the regions that hold two documents or more, with their sizes and
    first documents. Counts are summed before the shuffle; the join adds one row a region."""
    rows = prefixes(sigs, level)
    sizes = materialise(rows.groupBy("region").agg(F.count("*").alias("n"), F.min("doc_id").alias("hub")).filter("n > 1"), "sizes")
    out = materialise(spread_join(rows, sizes, ["region"], hot_keys(sizes, ["region"], "n")), "regions")
    discard(sizes)
    return out


def candidate_pairs(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b), a > b, distinct: pairs of documents to compare; (region, doc_id, hub) of the regions that
    are too full at the last depth."""
    found, used, whole = [], [], sigs
    for level in range(len(LEVELS)):
        held = regions(sigs, level)
        used.append(held)
        small = held.filter(F.col("n") <= REGION).select("region", "doc_id")
        left, right = small.withColumnRenamed("doc_id", "a"), small.withColumnRenamed("doc_id", "b")
        found.append(left.join(right, "region").filter("a > b").select("a", "b"))
        full = held.filter(F.col("n") > REGION)
        found.append(full.filter("doc_id > hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
        if level + 1 < len(LEVELS):
            active = full.groupBy("doc_id").agg(F.collect_list("tree").alias("full"))
            sigs = materialise(whole.join(active, "doc_id"), "active")
            used.append(sigs)
        else:
            found.append(neighbours(full.select("region", "rest", "doc_id")))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs, full = materialise(pairs.distinct(), "pairs"), materialise(full.select("region", "doc_id", "hub"), "full")
    discard(*used)
    return pairs, full


def common_prefix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many leading values of each row of x and y agree."""
    return np.cumprod(x == y, axis=1).sum(axis=1)


def neighbours(rows: DataFrame) -> DataFrame:
    """Pairs of documents next to each other in a region's order (column `rest`, the values after the
    prefix), and of those two places apart on the side with the longer common prefix. Regions are cut
    where a range partition ends: every document is paired with its region's first as well."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches(it):
            joined = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            region, doc = joined["region"].to_numpy(), joined["doc_id"].to_numpy(np.int64)
            rest = np.frombuffer(b"".join(joined["rest"]), np.uint8).reshape(len(joined), -1)
            same = region[1:] == region[:-1]
            longest = np.where(same, common_prefix(rest[1:], rest[:-1]), -1)
            at = np.flatnonzero(same)
            x, y = [at + 1], [at]
            # i and i + 2, if the longer prefix of either leads towards the other.
            inner = np.concatenate(([-1], longest, [-1, -1]))
            i = np.flatnonzero(same[:-1] & same[1:])
            towards = (inner[i + 1] >= inner[i]) | (inner[i + 2] >= inner[i + 3])
            x.append(i[towards] + 2)
            y.append(i[towards])
            x, y = doc[np.concatenate(x)], doc[np.concatenate(y)]
            if len(x):
                yield pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y)})
            held = joined.iloc[-3:]

    order = ("region", "rest", "doc_id")
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_rows.mapInPandas(run, "a long, b long").filter("a <> b")


def hot_partners(pairs: DataFrame) -> DataFrame | None:
    """The documents b that very many pairs (materialised) name."""
    return hot_keys(pairs.groupBy("b").agg(F.count("*").alias("n")), ["b"], "n")


def likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b, share): pairs whose signatures agree in SURELY_LESS of the values or more. One byte of
    each value goes on; chance agreement of bytes is taken off."""

    @F.pandas_udf("binary")
    def low_bytes(col: pd.Series) -> pd.Series:
        m = np.frombuffer(b"".join(col), "<u4").reshape(-1, HASHES)
        small = (mix(m.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
        return pd.Series([r.tobytes() for r in small], dtype=object)

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        p = np.frombuffer(b"".join(x), np.uint8).reshape(-1, HASHES)
        q = np.frombuffer(b"".join(y), np.uint8).reshape(-1, HASHES)
        return pd.Series(((p == q).mean(axis=1) - 1 / 256) / (1 - 1 / 256))

    short = materialise(sigs.select("doc_id", low_bytes("signature").alias("sig")), "bytes")
    both = pairs.join(short.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a")
    both = spread_join(both, short.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), ["b"], hot_partners(pairs))
    return both.select("a", "b", share("sig_a", "sig_b").alias("share")).filter(F.col("share") >= SURELY_LESS)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full sets are alike enough. The text of a, of which a document has few pairs,
    travels to b's partition; a's set and b's are compared there, b's built once for a run."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    left = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = spread_join(left, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), ["b"], hot_partners(pairs))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mine = None, np.empty(0, np.uint64)
        for whole in batches(it):
            for first in range(0, len(whole), 200):
                pdf = whole.iloc[first : first + 200]
                ok = []
                for s, text in zip(sets_of(pdf["text_a"].tolist()), pdf["text_b"].array):
                    if text is not last and text != last:
                        last, mine = text, next(sets_of([text]))
                    both = len(s) + len(mine) - len(np.union1d(s, mine))
                    ok.append(100 * both >= THRESHOLD * (len(s) + len(mine) - both) and both > 0)
                if any(ok):
                    yield pdf.loc[ok, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long").distinct()


def connect(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a > b) can reach."""
    now, mark = materialise(edges.select("a", "b").distinct(), "edges"), None
    while True:
        by_end = now.groupBy("b").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
        state = tuple(by_end.agg(F.sum("n"), F.bit_xor("x"), F.max("n")).first())
        if state == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = state
        # Large star: a node's larger neighbours go to the smallest of its neighbourhood.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        hot = hot_keys(by_end.select(F.col("b").alias("a"), "n"), ["a"], "n") if (state[2] or 0) > HOT_STAR else None
        large = spread_join(both.filter("b > a"), least, ["a"], hot).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        large = materialise(large, "large-star")
        discard(now)
        # Small star: a node and its smaller neighbours go to the smallest of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        now = materialise(small, "small-star")
        discard(large)


def crowds(full: DataFrame, roots: DataFrame) -> DataFrame | None:
    """(doc_id, component, crowd) of the documents of full regions that hold several components; None
    if there are none. Regions that share a document are one crowd."""
    known = roots.select(F.col("node").alias("doc_id"), F.col("root").alias("component"))
    named = full.join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = named.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).filter("x < y")
    mixed = materialise(mixed.select("region", "n"), "mixed-regions")
    inside = spread_join(named, mixed.select("region"), ["region"], hot_keys(mixed, ["region"], "n"))
    held = materialise(inside.select("doc_id", "component", "hub").distinct(), "mixed")
    discard(mixed)
    if held.isEmpty():
        return None
    crowd = connect(held.filter("doc_id > hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    of = crowd.select(F.col("node").alias("doc_id"), F.col("root").alias("crowd"))
    docs = held.select("doc_id", "component").distinct()
    return materialise(docs.join(of, "doc_id", "left").withColumn("crowd", F.coalesce("crowd", "doc_id")), "crowds")


def crowd_links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b), a > b: components of a crowd that are linked by a pair of documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def build(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            sets = list(sets_of(pdf["text"].tolist()))
            out = pdf[["crowd", "doc_id", "component"]].copy()
            out["n"] = [len(s) for s in sets]
            out["shingles"] = pd.Series([s.tobytes() for s in sets], index=out.index, dtype=object)
            yield out

    rows = texts.join(members, "doc_id").select("crowd", "doc_id", "component", "text")
    rows = materialise(rows.mapInPandas(build, "crowd long, doc_id long, component long, n long, shingles binary"), "crowd-sets", TEXT_ROWS)
    buckets = F.ceil(F.greatest(F.count("*") / BUCKET_DOCS, F.sum("n") / BUCKET_SHINGLES)).cast("int")
    rows = rows.join(rows.groupBy("crowd").agg(buckets.alias("buckets")), "crowd")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    rows = rows.withColumns({"i": F.least("bucket", "other"), "j": F.greatest("bucket", "other")})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        first = (pdf["bucket"] == pdf["i"]).to_numpy()
        x, y = pdf[first], pdf[~first] if (pdf["i"] != pdf["j"]).iloc[0] else pdf
        found = [np.empty((0, 2), np.int64)]
        if len(y):
            theirs = [np.frombuffer(s, np.uint64) for s in y["shingles"]]
            m, root_y = y["n"].to_numpy(np.int64), y["component"].to_numpy(np.int64)
            for k in range(0, len(x), 500):
                part = x.iloc[k : k + 500]
                n, root = part["n"].to_numpy(np.int64), part["component"].to_numpy(np.int64)
                both = shared([np.frombuffer(s, np.uint64) for s in part["shingles"]], theirs)
                alike = (100 * both >= THRESHOLD * (n[:, None] + m - both)) & (root[:, None] != root_y)
                p, q = np.nonzero(alike)
                found.append(np.unique(np.sort(np.column_stack([root[p], root_y[q]]), axis=1), axis=0))
        out = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": out[:, 1], "b": out[:, 0]})

    return rows.select("crowd", "i", "j", "bucket", "component", "n", "shingles").groupBy("crowd", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def shared(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of xs has in common with each of ys. Shingles that many of ys hold
    are counted by products of 0/1 matrices, the others along their lists of holders."""
    flat = np.concatenate(ys)
    holder = np.repeat(np.arange(len(ys)), [len(y) for y in ys])
    vocabulary, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    mine = np.concatenate(xs)
    row = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    at = np.minimum(np.searchsorted(vocabulary, mine), len(vocabulary) - 1)
    ok = vocabulary[at] == mine
    row, at = row[ok], at[ok]
    out = np.zeros((len(xs), len(ys)), np.int64)
    needed = np.zeros(len(vocabulary), bool)
    needed[at] = True
    common = needed & (held * 16 > len(ys))
    place = np.cumsum(common) - 1
    in_x, in_y = common[at], common[column]
    px, rx, py, ry = place[at[in_x]], row[in_x], place[column[in_y]], holder[in_y]
    for k in range(0, int(common.sum()), 2048):
        mx, my = ((p >= k) & (p < k + 2048) for p in (px, py))
        left, right = np.zeros((len(xs), 2048), np.float32), np.zeros((len(ys), 2048), np.float32)
        left[rx[mx], px[mx] - k] = 1
        right[ry[my], py[my] - k] = 1
        out += (left @ right.T).astype(np.int64)
    # The others: entry by entry, a few million at once.
    by_column = holder[np.argsort(column, kind="stable")]
    start = np.cumsum(held) - held
    row, at = row[~in_x], at[~in_x]
    ends = np.cumsum(held[at])
    k = 0
    while k < len(at):
        done = ends[k - 1] if k else 0
        end = max(k + 1, int(np.searchsorted(ends, done + (1 << 21), "right")))
        size = held[at[k:end]]
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        cell = np.repeat(row[k:end], size) * len(ys) + by_column[np.repeat(start[at[k:end]], size) + inside]
        out += np.bincount(cell, minlength=out.size).reshape(out.shape)
        k = end
    return out


def links(sigs: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of the representatives that are linked with another."""
    proposed, full = candidate_pairs(sigs)
    pairs = materialise(likely(proposed, sigs), "likely")
    discard(proposed)
    # First round: each document's likeliest and smallest partner.
    per = pairs.groupBy("a").agg(F.max(F.struct("share", "b")).alias("best"), F.min("b").alias("least"))
    first = materialise(per.select("a", F.explode(F.array_distinct(F.array("best.b", "least"))).alias("b")), "first")
    roots = connect(materialise(verified(first, docs), "verified", TEXT_ROWS))
    # Second round: what isn't connected by then.
    rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti")
    named = rest.join(roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left")
    named = spread_join(named, roots.select(F.col("node").alias("b"), F.col("root").alias("root_b")), ["b"], hot_partners(pairs), "left")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    second = materialise(named.filter(apart).select("a", "b"), "second")
    if not second.isEmpty():
        roots = connect(_as_edges(roots).unionByName(materialise(verified(second, docs), "more", TEXT_ROWS)))
    discard(pairs, first)
    # Third round: full regions that hold several components.
    members = crowds(full, roots)
    if members is None:
        return roots
    more = materialise(crowd_links(members, docs), "crowd-links")
    return roots if more.isEmpty() else connect(_as_edges(roots).unionByName(more))


def _as_edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document."""
    known = materialise(sketches(docs), "sketches", TEXT_ROWS)
    filled = known.filter("set_a is not null and doc_id is not null")
    sets = materialise(filled.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "sets")
    mine = ["set_a", "set_b", "doc_id"]
    sigs = filled.select(*mine, "signature").join(sets.select("set_a", "set_b", F.col("rep").alias("doc_id")), mine, "left_semi")
    sigs = materialise(sigs.dropDuplicates(mine).select("doc_id", "signature"), "signatures")
    roots = links(sigs, docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull()))
    # Rows of one doc_id with different sets are one document: their representatives are linked.
    own = F.struct("set_a", "set_b")
    several = materialise(filled.groupBy("doc_id").agg(F.min(own).alias("x"), F.max(own).alias("y")).filter("x <> y").select("doc_id"), "several")
    if not several.isEmpty():
        ends = filled.select(*mine).join(several, "doc_id").join(sets, ["set_a", "set_b"]).filter("doc_id <> rep")
        same = ends.select(F.greatest("doc_id", "rep").alias("a"), F.least("doc_id", "rep").alias("b"))
        roots = connect(_as_edges(roots).unionByName(same))
    named = sets.join(roots, F.col("rep") == F.col("node"), "left")
    named = named.select("set_a", "set_b", F.coalesce("root", "rep").alias("component_id"))
    # A set that many copies share is a hot key; documents without a set need no join.
    out = spread_join(filled.select(*mine, "n_shingles"), named, ["set_a", "set_b"], hot_keys(sets, ["set_a", "set_b"], "n")).select("doc_id", "n_shingles", "component_id")
    alone = known.filter("set_a is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def distinct(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, of one document of each group (the smallest id)."""
    name = "_gone"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    gone = components(docs).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
