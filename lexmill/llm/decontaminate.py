"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, and exact
weighted-shingle similarity.

Words are lower-cased and freed of ASCII punctuation; shingles are word pairs (a lone word is its
own), weighted by the logarithm of their rarity among the items. Every window of a document that is
as long as an item (the whole document, where it is shorter) could match that item. A window's
shingles that occur in any item, and those that occur in none, bound its similarity from above;
windows below the threshold by that bound are left out, which loses nothing. The others get a 64-bit
SimHash. Fingerprints are cut into four blocks of 16 bits, each with buckets of the items: two within
the radius of 11 agree in some block but for two bits, so that looking up every block value within
two bits guarantees all items within the radius, and hardly any other. They are verified by exact
weighted Jaccard similarity. A pair at the threshold usually differs in more bits (17 on average at
similarity 0.5), so what the radius doesn't hold is found in an exact way: items of which the
windows hold enough weight, told by lists of each shingle's items, are verified alike, best bound
first, until no window can beat the best found. So the result is that of comparing all windows.

Items go to the tasks in blocks of a bounded count. Where there are several, one scan finds the
documents that could match any item at all (by a table of bits for the shingles of all items), and
only these meet the blocks. Weights are of all items, whatever the block: shingles that several items
hold are counted over the whole table and go with every block; any other shingle weighs the same
whether one item holds it or none.

Defined results: null and empty texts, and items without a word, match nothing; repeated items each
match; repeated documents each give their rows; of equally similar windows one is reported, the same at every run;
empty tables give no rows; null ids stay null; extra columns are ignored, or kept by clean().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BARE, TEXT_ROWS, Words, batches, materialise, shingle_hashes, small_side, text_chunks

SIMILARITY = 0.5
RADIUS = 11
BLOCKS = 4
ITEM_BLOCK = 20_000
_TABLE_BITS = 22
_SCREEN_BITS = 27  # of the table for the shingles of all items, where there are several blocks
_BITS = np.arange(64, dtype=np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    return shingle_hashes(words, 2) if len(words) > 1 else shingle_hashes(words, 1)


def signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    return ((h[:, None] >> _BITS) & np.uint64(1)).astype(np.float32) * 2 - 1


def pack_bits(totals: np.ndarray) -> np.ndarray:
    """Fingerprints, as four 16-bit values a row."""
    return np.packbits(totals > 0, axis=1).view(np.uint16)


_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
_NEAR = np.flatnonzero(_POPCOUNT <= RADIUS // BLOCKS).astype(np.uint16)  # what a block may differ by


def lists(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, place): the places of key k are place[start[k]:start[k + 1]]."""
    return np.concatenate(([0], np.cumsum(np.bincount(keys, minlength=size)))), np.argsort(keys, kind="stable")


def spread(start: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, at): for each key, in turn, its number in keys and the places of its list's entries."""
    n = start[keys + 1] - start[keys]
    which = np.repeat(np.arange(len(keys)), n)
    return which, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[keys], n)


@dataclass
class Items:
    ids: list
    n_words: np.ndarray
    bags: list[tuple[np.ndarray, np.ndarray]]  # each item's shingles and how often they occur
    totals: np.ndarray  # weight of each item's shingles
    known: np.ndarray  # all shingles of these items, and those that several of all items hold, sorted
    weights: np.ndarray
    rare: float  # weight of a shingle that is in no item
    prints: np.ndarray  # items x 4 blocks
    buckets: list[tuple[np.ndarray, np.ndarray]]  # of each block: the items of each value
    holders: tuple[np.ndarray, np.ndarray]  # the items that hold each known shingle
    filter: np.ndarray  # first bits of known shingles
    by_length: dict[int, np.ndarray]
    least: dict[int, float]  # per length, the least weight of an item

    @classmethod
    def build(cls, rows: list[tuple], n_items: int, counts: tuple[np.ndarray, np.ndarray] | None = None) -> Items:
        """rows: of all n_items items, or a block of them; then counts: from repeated(), of all."""
        words = Words([("" if t is None else t).encode("utf-8", "surrogatepass") for _, t in rows], table=BARE)
        h = words.hashes()
        per = [h[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        keep = [i for i, w in enumerate(per) if len(w)]
        ids, per = [rows[i][0] for i in keep], [per[i] for i in keep]
        own = [shingles(w) for w in per]
        bags = [np.unique(x, return_counts=True) for x in own]
        known, count = np.unique(np.concatenate([s for s, _ in bags]), return_counts=True) if bags else (np.empty(0, np.uint64), np.empty(0))
        if counts is not None:
            known = np.union1d(known.astype(np.uint64), counts[0])
            count = np.ones(len(known), np.int64)
            count[np.searchsorted(known, counts[0])] = counts[1]
        n = max(1, n_items)
        weights = np.log1p(n / np.maximum(count, 1)).astype(np.float64)
        weigh = lambda x: weights[np.searchsorted(known, x)]
        totals = np.array([weigh(x).sum() for x in own])
        prints = np.concatenate([pack_bits((signs(x) * weigh(x)[:, None]).sum(axis=0, keepdims=True)) for x in own]) if own else np.empty((0, BLOCKS), np.uint16)
        buckets = [lists(prints[:, k].astype(np.int64), 1 << 16) for k in range(BLOCKS)]
        flat = np.searchsorted(known, np.concatenate([x for x, _ in bags])) if bags else np.empty(0, np.int64)
        start, order = lists(flat, len(known))
        holders = start, np.repeat(np.arange(len(bags)), [len(x) for x, _ in bags])[order]
        flt = np.zeros(1 << _TABLE_BITS, bool)
        flt[(known >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        n_words = np.array([len(w) for w in per], np.int64)
        by_length = {int(x): np.flatnonzero(n_words == x) for x in np.unique(n_words)}
        least = {x: float(totals[at].min()) for x, at in by_length.items()}
        return cls(ids, n_words, bags, totals, known, weights, math.log1p(n), prints, buckets, holders, flt, by_length, least)

    def weigh(self, h: np.ndarray) -> np.ndarray:
        """Weight of each shingle that is in an item; 0 of others."""
        out = np.zeros(len(h))
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        if len(maybe) and len(self.known):
            x = h[maybe]
            at = np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)
            out[maybe] = np.where(self.known[at] == x, self.weights[at], 0.0)
        return out

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item), each pair once: all within the radius."""
        pairs = [np.empty(0, np.int64)]
        for k, (start, place) in enumerate(self.buckets):
            keys = (prints[:, k, None] ^ _NEAR).astype(np.int64)
            window, near = np.nonzero(start[keys + 1] > start[keys])
            which, at = spread(start, keys[window, near])
            w, i = window[which], place[at]
            ok = _POPCOUNT[prints[w] ^ self.prints[i]].sum(axis=1, dtype=np.int64) <= RADIUS
            pairs.append(w[ok] * len(self.prints) + i[ok])
        both = np.unique(np.concatenate(pairs))
        return both // max(1, len(self.prints)), both % max(1, len(self.prints))

    def held(self, shingles: np.ndarray) -> np.ndarray:
        """The items of which the shingles (with repeats) hold weight enough for the threshold."""
        x, n = np.unique(shingles, return_counts=True)
        at = np.minimum(np.searchsorted(self.known, x), max(0, len(self.known) - 1))
        ok = self.known[at] == x if len(self.known) else np.zeros(len(x), bool)
        at, n = at[ok], n[ok]
        which, place = spread(self.holders[0], at)
        weight = np.bincount(self.holders[1][place], weights=(self.weights[at] * n)[which], minlength=len(self.ids))
        return np.flatnonzero(weight >= SIMILARITY * self.totals - 1e-9)


def find(items: Items, texts: list[str | None]) -> list[tuple[int, int, float, int, int, int]]:
    """(text, item, similarity, distance, first word, words) of each text's best window per item."""
    out = []
    if not len(items.ids):
        return out
    lengths = sorted(items.by_length)
    for first, _, part in text_chunks(texts):
        words = Words(part, table=BARE)
        h = words.hashes()
        if not len(h):
            continue
        # Shingle j starts at word j; one that would leave its text counts for nothing.
        n_words = np.diff(words.first)
        sh = np.zeros(len(h), np.uint64)
        sh[: len(h) - 1] = shingle_hashes(h, 2)
        doc = words.doc
        last = words.first[doc + 1] - 1
        weight = items.weigh(sh)
        weight[last == np.arange(len(h))] = 0
        lone = np.flatnonzero(n_words == 1)
        at = words.first[lone]
        sh[at] = shingle_hashes(h[at], 1)
        weight[at] = items.weigh(sh[at])
        # Of a window with K known and U unknown weight, an item of weight T holds K at most, so that
        # the similarity is K / (U + T) at most: it reaches t only if K - t * U reaches t * T.
        gain = np.where(weight > 0, weight, -SIMILARITY * items.rare)
        gain[(last == np.arange(len(h))) & (n_words[doc] > 1)] = 0
        total = np.concatenate(([0.0], np.cumsum(gain)))
        found: list[np.ndarray] = []  # document, length, first shingle, end
        for length in lengths:
            floor = SIMILARITY * items.least[length] - 1e-9
            span = max(1, length - 1)  # shingles of a window
            n = len(h) - length + 1
            if n > 0:
                s = np.flatnonzero(total[span : span + n] - total[:n] >= floor)
                s = s[s + length - 1 <= last[s]]
                found.append(np.column_stack([doc[s], np.full(len(s), length), s, s + span]))
            short = np.flatnonzero((n_words < length) & (n_words > 0))
            if len(short):
                a, b = words.first[short], words.first[short + 1]
                ok = total[b] - total[a] >= floor
                found.append(np.column_stack([short[ok], np.full(int(ok.sum()), length), a[ok], np.maximum(a[ok] + 1, b[ok] - 1)]))
        w = np.concatenate(found).astype(np.int64) if found else np.empty((0, 4), np.int64)
        w = w[np.argsort(w[:, 0], kind="stable")]
        for windows in np.split(w, np.flatnonzero(np.diff(w[:, 0])) + 1) if len(w) else ():
            d, best = int(windows[0, 0]), {}
            for part in _clusters(windows[:, 1:]):
                for i, *r in _verify(items, sh, weight, part, int(words.first[d]), int(n_words[d])):
                    if i not in best or r[0] > best[i][0]:
                        best[i] = tuple(r)
            out += [(first + d, i, *best[i]) for i in sorted(best)]
    return out


_CLUSTER = 20_000


def _clusters(w: np.ndarray) -> Iterator[np.ndarray]:
    """(length, first shingle, end) of windows, in runs that overlap; long runs in parts."""
    w = w[np.lexsort((w[:, 0], w[:, 1]))]
    ends = np.maximum.accumulate(w[:, 2])
    cut = np.flatnonzero(w[1:, 1] > ends[:-1]) + 1
    for part in np.split(w, cut):
        yield from np.split(part, range(_CLUSTER, len(part), _CLUSTER))


def _verify(items: Items, sh: np.ndarray, weight: np.ndarray, w: np.ndarray, base: int, n_words: int) -> Iterator[tuple]:
    """(item, similarity, distance, first word, words): the best of the windows for each item."""
    # An item of which the windows together hold too little can't be like one of them.
    possible = items.held(sh[w[:, 1].min() : w[:, 2].max()])
    w = w[np.isin(w[:, 0], items.n_words[possible])]
    if not len(w):
        return
    lo, hi = w[:, 1].min(), w[:, 2].max()
    part = sh[lo:hi]
    own = np.where(weight[lo:hi] > 0, weight[lo:hi], items.rare)
    run = np.zeros((len(part) + 1, 64), np.float64)
    np.cumsum(signs(part) * own[:, None], axis=0, out=run[1:])
    whole = np.concatenate(([0.0], np.cumsum(own, dtype=np.float64)))
    prints = np.concatenate([pack_bits(run[b[:, 2] - lo] - run[b[:, 1] - lo]) for b in np.split(w, range(4096, len(w), 4096))])
    # Within the radius, by the buckets; an item meets windows of its own length only.
    at, item = items.candidates(prints)
    near: dict[int, list[int]] = {}
    for k, i in zip(at[w[at, 0] == items.n_words[item]].tolist(), item[w[at, 0] == items.n_words[item]].tolist()):
        near.setdefault(i, []).append(k)
    for i in possible.tolist():
        mine = np.flatnonzero(w[:, 0] == items.n_words[i])
        if not len(mine):
            continue
        # The item's own shingles in a window bound its similarity once more; windows within the
        # radius go first, the likeliest before the others, and what can't beat the best is left out.
        theirs, count = items.bags[i]
        place = np.minimum(np.searchsorted(theirs, part), len(theirs) - 1)
        place = np.where(theirs[place] == part, place, len(theirs))
        worth = items.weights[np.searchsorted(items.known, theirs)]
        held = np.concatenate(([0.0], np.cumsum(np.where(place < len(theirs), own, 0), dtype=np.float64)))
        x, y = w[mine, 1] - lo, w[mine, 2] - lo
        most = np.minimum(held[y] - held[x], items.totals[i])
        bound = most / (whole[y] - whole[x] + items.totals[i] - most) + 1e-9
        best: tuple[float, int] | None = None
        for chosen in (np.isin(mine, near.get(i, [])), np.ones(len(mine), bool)):
            for k in np.flatnonzero(chosen)[np.lexsort((mine[chosen], -bound[chosen]))]:
                if bound[k] < SIMILARITY or best and bound[k] <= best[0] + 2e-9:
                    break
                # Weighted Jaccard similarity of the bags of the window's shingles and the item's.
                both = float((worth * np.minimum(np.bincount(place[x[k] : y[k]], minlength=len(theirs) + 1)[:-1], count)).sum())
                s = both / float(whole[y[k]] - whole[x[k]] + items.totals[i] - both)
                if s >= SIMILARITY and (best is None or s > best[0]):
                    best = (s, int(mine[k]))
        if best:
            s, k = best
            distance = int(_POPCOUNT[prints[k] ^ items.prints[i]].sum(dtype=np.int64))
            yield i, s, distance, int(w[k, 1]) - base, min(int(w[k, 0]), n_words)


MATCHES = "doc_id long, item_id long, similarity double, distance int, first_word long, n_words long"


def repeated(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that more than one item holds, sorted, and how many items hold each."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            for _, _, part in text_chunks(pdf["text"].tolist()):
                words = Words(part, table=BARE)
                h = words.hashes()
                lists = [np.unique(shingles(h[a:b])) for a, b in zip(words.first[:-1], words.first[1:])]
                known, count = np.unique(np.concatenate(lists), return_counts=True)
                yield pd.DataFrame({"shingle": known.view(np.int64), "n": count.astype(np.int64)})

    counts = rows.select("text").mapInPandas(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter("n > 1")
    table = counts.toArrow()
    known = table["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], table["n"].to_numpy()[order]


def item_blocks(benchmark: DataFrame, block: int) -> Iterator[Items]:
    """The items in blocks of about `block`, by a hash of text and id."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    n = rows.count()
    blocks = max(1, -(-n // block))
    counts = repeated(rows) if blocks > 1 else None  # a single block holds them all
    for k in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield Items.build([(r["item_id"], r["text"]) for r in sorted(part.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))], n, counts)


@dataclass
class Screen:
    """Tells texts that can't match any item of any block: every shingle that an item may hold counts
    with the greatest weight there is."""

    bits: np.ndarray
    least: dict[int, float]
    rare: float

    @classmethod
    def of(cls, blocks: Iterator[Items]) -> Screen:
        mask = np.zeros(1 << _SCREEN_BITS, bool)
        out = cls(mask, {}, 0.0)
        for b in blocks:
            mask[(b.known >> np.uint64(64 - _SCREEN_BITS)).astype(np.int64)] = True
            out.least = {x: min(b.least.get(x, math.inf), out.least.get(x, math.inf)) for x in {*b.least, *out.least}}
            out.rare = b.rare
        out.bits = np.packbits(mask, bitorder="little")
        return out

    def suspect(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), bool)
        for first, _, part in text_chunks(texts):
            words = Words(part, table=BARE)
            h = words.hashes()
            for d, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                if b > a:
                    at = (shingles(h[a:b]) >> np.uint64(64 - _SCREEN_BITS)).astype(np.int64)
                    known = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
                    total = np.concatenate(([0.0], np.cumsum(np.where(known, self.rare, -SIMILARITY * self.rare))))
                    for length, weight in self.least.items():
                        span = min(max(1, length - 1), len(at))
                        if (total[span:] - total[: len(total) - span]).max() >= SIMILARITY * weight - 1e-9:
                            out[first + d] = True
                            break
        return out


def _suspects(benchmark: DataFrame, block: int):
    screen = Screen.of(item_blocks(benchmark, block))

    @F.pandas_udf("boolean")
    def suspect(texts: pd.Series) -> pd.Series:
        return pd.Series(screen.suspect(texts.tolist()))

    return suspect(F.col("text").cast("string"))


def matches(docs: DataFrame, benchmark: DataFrame, block: int = ITEM_BLOCK) -> DataFrame:
    """One row for each document and item that its text holds."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if benchmark.count() <= block:
        return rows.mapInPandas(_finder(next(item_blocks(benchmark, block))), MATCHES)
    rows = materialise(rows.filter(_suspects(benchmark, block)), "suspects", TEXT_ROWS)
    out = None
    for items in item_blocks(benchmark, block):
        part = materialise(rows.mapInPandas(_finder(items), MATCHES), "matches")
        out = part if out is None else out.unionByName(part)
    return out


def _finder(items: Items):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            got = find(items, pdf["text"].tolist())
            if got:
                ids = pdf["doc_id"].astype("Int64").array
                out = pd.DataFrame([r[1:] for r in got], columns=["item", "similarity", "distance", "first_word", "n_words"])
                out.insert(0, "doc_id", ids.take([r[0] for r in got]))
                out.insert(1, "item_id", pd.array([items.ids[i] for i in out.pop("item")], "Int64"))
                yield out

    return run


def clean(docs: DataFrame, benchmark: DataFrame, block: int = ITEM_BLOCK) -> DataFrame:
    """The rows of docs, with their own columns, whose text holds no item: a filter row by row. With
    several blocks, suspect texts meet them under a digest for an id."""
    if benchmark.count() <= block:
        return docs.filter(_free(next(item_blocks(benchmark, block)))(F.col("text").cast("string")))
    name = "_text"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    suspect, digest = _suspects(benchmark, block), F.sha2(F.col("text").cast("string"), 256)
    texts = docs.filter(suspect).select(digest.alias(name), F.col("text").cast("string").alias("text"))
    texts = materialise(texts.dropDuplicates([name]), "suspects", TEXT_ROWS)
    for items in item_blocks(benchmark, block):
        texts = materialise(texts.filter(_free(items)(F.col("text"))), "free", TEXT_ROWS)
    free = small_side(texts.select(name))
    return docs.filter(~suspect).unionByName(docs.filter(suspect).withColumn(name, digest).join(free, name, "left_semi").drop(name))


def _free(items: Items):
    @F.pandas_udf("boolean")
    def free(texts: pd.Series) -> pd.Series:
        keep = np.ones(len(texts), bool)
        keep[[r[0] for r in find(items, texts.tolist())]] = False
        return pd.Series(keep)

    return free
