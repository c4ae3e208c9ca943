"""Helpers shared by the training-data operators: shared-folder tables, bounded samples and
vectorised word hashing over UTF-8 bytes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import spread

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of our own only where that is unset and all
    tasks run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
    return "file://" + _OWN_DIRS[app]


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 1000  # rows of an Arrow batch where each holds a text or two


def materialise(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and a lost
    executor costs nothing but its running tasks. batch_rows: rows of an Arrow batch meanwhile."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH_ROWS)
    if batch_rows:
        spark.conf.set(_BATCH_ROWS, min(batch_rows, int(before)) if int(before) > 0 else batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_ROWS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


HOT_ROWS = 200_000  # rows of one key that a task may get
HOT_KEYS = 1024
SALTS = 64


def hot_keys(counts: DataFrame, keys: list[str], n: str) -> DataFrame | None:
    """The keys that more than HOT_ROWS rows hold, and more than one in HOT_KEYS of all: so many at
    most, whatever the size. counts: one row a key, its rows in column n. None if there are none."""
    total = counts.agg(F.sum(n), F.max(n)).first()
    edge = max(HOT_ROWS, (total[0] or 0) // HOT_KEYS)
    return counts.filter(F.col(n) > edge).select(*keys) if (total[1] or 0) > edge else None


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with side, which has few rows a key. The rows of hot keys go to SALTS tasks each,
    to which side's rows of these keys are copied."""
    if hot is None:
        return rows.join(side, keys, how)
    mark = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    salted = rows.join(mark, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = side.join(mark, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")


BROADCAST_ROWS = 50_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has `most` rows or fewer; else joined as any table. For tables of
    numbers and short names that are written already, so that counting costs nothing."""
    return F.broadcast(df) if df.count() <= most else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one so small that it may be one task's is dealt out to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 = 2; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(df: DataFrame, label: str, per_label: int) -> DataFrame:
    """About per_label rows of each label, chosen by a hash of doc_id, so that the same rows come at
    every run. The counts are of all rows and stay in a table, one row a label; only the kept rows go
    on: as many as per_label times the labels there are."""
    counts = materialise(df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n")), "label-counts")
    u = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    marked = df.join(small_side(counts), F.col(label) == F.col("_label"))
    return marked.filter(u < F.lit(per_label) / F.col("_n")).drop("_label", "_n")


# --- words as hashes ---

CHUNK = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_powers: list[np.ndarray] = []
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Letters lower-cased, ASCII punctuation as white space.
BARE = _LOWER.copy()
BARE[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse. Those for longer texts than a chunk aren't kept."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made = []
    for r in (_R, _R_INV):
        t = np.ones(max(n, CHUNK + 2), np.uint64)
        t[1:] = r
        made.append(np.multiply.accumulate(t))
    if len(made[0]) == CHUNK + 2:
        _powers[:] = made
    return made[0], made[1]


def text_chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, end, encoded texts) for runs of texts of about limit bytes; a longer text goes alone."""
    first, total, part = 0, 0, []
    for i, t in enumerate(texts):
        b = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if part and total + len(b) > limit:
            yield first, i, part
            first, total, part = i, 0, []
        part.append(b)
        total += len(b) + 1
    if part:
        yield first, len(texts), part


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts, as spans into their joined bytes.

    data: the bytes, one newline after each text; start, end: each word's span; doc: the text that
    holds it; first[i]:first[i + 1]: the words of text i."""

    def __init__(self, texts: list[bytes], lower: bool = True, table: np.ndarray | None = None):
        """table: what each byte is read as, before words are told apart."""
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        raw = raw if table is None else table[raw]
        self.raw = raw
        self.data = _LOWER[raw] if lower and table is None else raw
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_end = np.cumsum(lens + 1)
        solid = ~_SPACE[raw]
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        if len(raw) and solid[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.concatenate(([0], np.searchsorted(self.start, self.text_end)))
        self.n = len(texts)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        power, inverse = _power_tables(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start])


_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words (none if there are fewer)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n] * _ODD[0]
    for k in range(1, size):
        h += words[k : k + n] * _ODD[k]
    return mix(h)


def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches that hold rows."""
    for pdf in it:
        if len(pdf):
            yield pdf
