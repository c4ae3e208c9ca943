"""Best-fit packing by minimum bin slack.

The bin-filling search works on the histogram of piece lengths, which has at most `budget` rows at
any corpus size: per bin, a bitset subset-sum dynamic programme over the lengths still available
finds the fullest combination that holds the longest of them; it is removed as often as the counts
allow, which is what a bin-by-bin loop would do. Pieces then find their place by their rank among
the pieces of equal length.

Defined results: a null or empty text is the end token alone; repeated rows are packed once each;
an empty table gives no rows; a null doc_id is kept as null; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, materialise

BUDGET = 1024
END_ID = 2
SALT_ROWS = 200_000

NO_RUNS = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, equal to the tokenizer file's own.

    Most texts go through tiktoken, whose merge loop is several times faster, with the ranks that
    the file's merges state and a pattern without look-ahead; that pattern splits alike unless two
    white-space characters meet. Such texts, texts with the file's special strings, and files whose
    merges aren't plain byte-level ranks go through tokenizers itself."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = _fast(spec)
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.whole = re.compile("|".join([r"\s\s", *special]))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or self.whole.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(text)).tobytes()


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _fast(spec: dict):
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
    if not plain or spec.get("normalizer") or model.get("dropout") or not pre.get("use_regex", True):
        return None
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [vocab["".join(p)] for p in pairs]
    letters = _byte_letters()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    words = {w: i for w, i in vocab.items() if w not in special}
    if ids != sorted(ids) or not all(c in letters for w in words for c in w):
        return None
    import tiktoken

    ranks = {bytes(letters[c] for c in w): i for w, i in words.items()}
    return tiktoken.Encoding("ranks", pat_str=NO_RUNS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, budget: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what is left over."""
    head = n % budget
    spans = [(0, head)] if head else []
    return spans + [(s, budget) for s in range(head, n, budget)]


def pieces(docs: DataFrame, tokenizer_path: str, budget: int = BUDGET, end_id: int = END_ID) -> DataFrame:
    end = np.asarray([end_id], "<u4").tobytes()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path)
        for pdf in batches(it):
            rows = []
            for doc, text in zip(pdf["doc_id"].array, pdf["text"].array):
                ids = encode("" if text is None else text) + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, budget)):
                    rows.append((doc, k, s, n, zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, PIECES)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats) of a fullest combination within room, by bitset subset sums; the
    longest lengths are preferred among equals."""
    groups: list[tuple[int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            take = min(k, left)
            groups.append((length, take))
            left -= take
            k *= 2
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for length, take in groups:
        now = (reach[-1] | (reach[-1] << (length * take))) & mask
        reach.append(now)
        if now >> room & 1:
            break
    at = reach[-1].bit_length() - 1
    chosen: list[int] = []
    for i in range(len(reach) - 1, 0, -1):
        if reach[i - 1] >> at & 1:
            continue
        length, take = groups[i - 1]
        chosen += [length] * take
        at -= length * take
    return chosen


def plan(counts: dict[int, int], budget: int = BUDGET) -> list[tuple[list[int], int]]:
    """(lengths, how many bins) until no piece is left."""
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        bin_ = [longest, *fullest(rest, budget - longest)]
        need = {x: bin_.count(x) for x in set(bin_)}
        times = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((sorted(bin_, reverse=True), times))
    return out


def placements(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: for runs of ranks, the first rank, the first bin, the bins and the offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    bin_ = 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((times, bin_, offset))
            offset += x
        bin_ += times
    out = {}
    for x, rows in runs.items():
        times, first_bin, offset = (np.asarray(c, np.int64) for c in zip(*rows))
        out[x] = (np.cumsum(times) - times, first_bin, offset)
    return out


def pack(docs: DataFrame, tokenizer_path: str, budget: int = BUDGET, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece."""
    cutup = materialise(pieces(docs, tokenizer_path, budget, end_id), "pieces")
    full = (
        cutup.filter(F.col("length") == budget)
        .withColumn("sequence_id", -1 - F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
    )
    # Ranks within a length, in two levels: one length may hold a third of all pieces.
    part = cutup.filter(F.col("length") < budget)
    per_length = {r["length"]: r["n"] for r in part.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = 1 + max(per_length.values(), default=0) // SALT_ROWS
    order = ["doc_id", "piece", "start", "ids_crc32"]
    salted = part.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    if salts > 1:
        sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
        before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
        base = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
        ranked = ranked.join(base, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    where = placements(plan(per_length, budget))

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            seq = np.zeros(len(pdf), np.int64)
            offset = np.zeros(len(pdf), np.int64)
            for x, at in pdf.groupby("length").indices.items():
                first, bins, off = where[x]
                rank = pdf["_rank"].to_numpy()[at]
                k = np.searchsorted(first, rank, side="right") - 1
                seq[at] = bins[k] + rank - first[k]
                offset[at] = off[k]
            out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.assign(sequence_id=seq, offset=offset)

    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInPandas(
        place, PIECES + ", sequence_id long, offset long"
    )
    return full.unionByName(placed)
