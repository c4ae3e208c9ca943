"""Quality rules by robust multivariate outliers.

Every text is counted whole (words, symbols, repeated lines and passages); transformed shares of
these counts form a statistic vector. Per language and source a minimum-covariance-determinant
estimate of centre and scatter is found over all rows of the group. Several starts (all rows, and
hashed subsets of about SUBSET rows) are concentrated: a step takes the nearer three quarters of the
rows by the current estimate, and their mean and covariance. After FIRST_STEPS the start of least
determinant goes on until the determinant settles; the least one met is the estimate. Steps are
grouped aggregations with partial sums, so that no group is gathered in one task. The quantiles of
distance are read from histograms with bins of 0.4 per cent, so they are the same however rows are
partitioned, and a step's subset may hold as many rows more as share the last bin. A text is rejected
by its Mahalanobis distance.

An estimate of n rows is drawn to the next wider one's (source to language, language to all rows),
which counts as PRIOR rows; fewer than LEAST rows say nothing of their own. As most shares are zero in
clean text, plain determinants would be zero: covariances are regularised, in units of the scales
given with the features, so that no direction varies by less than that.

Defined results: a null text has no words, so base_failed is true and kept false; repeated rows
are judged alike; null languages and sources are groups of their own; an empty table gives no rows;
a null doc_id stays null; extra columns are ignored, or kept by accepted().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, TEXT_ROWS, Words, batches, discard, hot_keys, materialise, shingle_hashes, small_side, spread_join, text_chunks

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
CONCENTRATION = 0.75
STARTS = 5  # all rows, and four hashed subsets
SUBSET = 24  # three times as many rows as a start needs at least
FIRST_STEPS = 2
MOST_STEPS = 8  # of the chosen start, if it doesn't settle before
SETTLED = 0.01  # change of the logarithm of the determinant
LEAST = 16  # twice as many rows as dimensions and one
PRIOR = 50
BINS = 256.0  # bins of distance: BINS * log(1 + d)
#: Chi-square quantiles for len(FEATURES) degrees of freedom: 0.5 and 0.999999.
CHI_MEDIAN, CUTOFF = 6.346, 41.6

#: Statistic: scale floor, i.e. the standard deviation that any group is granted at least.
FEATURES = {
    "word_length": 0.10,  # log of mean word length
    "symbols": 0.05,  # the rest: square roots of shares
    "dup_lines": 0.10,
    "repeats": 0.10,
    "capitals": 0.06,
    "echoes": 0.06,  # words equal to the word before
    "unlettered": 0.08,  # words without a letter
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{f} double" for f in FEATURES)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)  # bytes of ASCII letters and of everything beyond ASCII
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_BLANK = " \t\n\x0b\x0c\r"


def repeated_words(words: np.ndarray, size: int = REPEAT_WINDOW) -> int:
    """Words in windows of `size` words that occur twice or more (hashes of one text's words)."""
    h = shingle_hashes(words, size)
    if len(h) < 2:
        return 0
    s = np.sort(h)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(h, again))
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def _per_text(mask: np.ndarray, ends: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(mask)))
    return np.diff(c[np.concatenate(([0], ends))])


def statistics(texts: list[str | None]) -> pd.DataFrame:
    parts = []
    for first, end, raw in text_chunks(texts):
        w = Words(raw, lower=False)
        h = w.hashes()
        bounds = w.first
        n_words = np.diff(bounds)
        lead = (w.raw & 0xC0) != 0x80  # first bytes of code points
        inside = np.zeros(len(w.raw) + 1, np.int8)
        inside[w.start] += 1
        inside[w.end] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        lettered = np.concatenate(([0], np.cumsum(_LETTER[w.raw])))
        bare = lettered[w.end] == lettered[w.start]
        echo = np.zeros(len(h), bool)
        echo[1:] = h[1:] == h[:-1]
        echo[bounds[:-1][(bounds[:-1] < len(h))]] = False
        word_first = bounds[1:]
        lines = [[x for x in (t or "").split("\n") if x.strip(_BLANK)] for t in texts[first:end]]
        dup = np.array([len(x) - len(set(x)) for x in lines], np.int64)
        n_lines = np.array([len(x) for x in lines], np.int64)
        repeat = np.array([repeated_words(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], np.int64)
        chars = _per_text(lead & inside, w.text_end)
        symbols = _per_text(_SYMBOL[w.raw], w.text_end)
        letters = _per_text(_LETTER[w.raw] & lead, w.text_end)
        upper = _per_text(_UPPER[w.raw], w.text_end)
        parts.append(
            pd.DataFrame(
                {
                    "n_words": n_words,
                    "word_chars": chars,
                    "n_symbols": symbols,
                    "n_dup_lines": dup,
                    "n_repeat_words": repeat,
                    # Shares are drawn towards the usual where a text is short.
                    "word_length": np.log((chars + 150.0) / (n_words + 30.0)),
                    "symbols": np.sqrt(symbols / (chars + 200.0)),
                    "dup_lines": np.sqrt(dup / (n_lines + 10.0)),
                    "repeats": np.sqrt(repeat / (n_words + 50.0)),
                    "capitals": np.sqrt((upper + 4.0) / (letters + 200.0)),
                    "echoes": np.sqrt(_per_text(echo, word_first) / (n_words + 30.0)),
                    "unlettered": np.sqrt(_per_text(bare, word_first) / (n_words + 30.0)),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts and the features of every document."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            out = statistics(pdf["text"].tolist())
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
            out.insert(1, "lang", pdf["lang"].array)
            out.insert(2, "source", pdf["source"].array)
            yield out

    return _inputs(docs).mapInPandas(run, "doc_id long, lang string, source string, " + STATS)


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("lang", "source", "text")))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def group_names() -> list[Column]:
    """The groups that a row belongs to, from the widest: all, its language, its language and source."""
    label = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(c)))
    return [F.lit("*"), label("lang"), F.concat_ws("\t", label("lang"), label("source"))]


_NAMES = list(FEATURES)
_P = len(_NAMES)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_MEANS, _COVS = [f"m_{i}" for i in range(_P)], [f"c_{i}_{j}" for i, j in _PAIRS]
_ESTIMATE = "grp string, start int, n long, logdet double, " + ", ".join(f"{c} double" for c in [*_MEANS, *_COVS, *(f"p_{i}_{j}" for i, j in _PAIRS)])


def distance() -> Column:
    """Squared Mahalanobis distance of a row's features, from columns m_i and p_i_j."""
    total = F.lit(0.0)
    for i, j in _PAIRS:
        both = (F.col(_NAMES[i]) - F.col(f"m_{i}")) * (F.col(_NAMES[j]) - F.col(f"m_{j}")) * F.col(f"p_{i}_{j}")
        total = total + (both if i == j else 2 * both)
    return total


def _regular(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """(inverse, logarithm of the determinant) of a covariance whose eigenvalues, in units of the
    scales, are at least one."""
    floor = np.array(list(FEATURES.values()))
    values, vectors = np.linalg.eigh(cov / np.outer(floor, floor))
    values = np.maximum(values, 1.0)
    return (vectors / values) @ vectors.T / np.outer(floor, floor), float(np.log(values).sum())


def _square(row: dict, names: list[str]) -> np.ndarray:
    out = np.zeros((_P, _P))
    for (i, j), c in zip(_PAIRS, names):
        out[i, j] = out[j, i] = row[c]
    return out


def _estimates(moments: DataFrame) -> DataFrame:
    """Estimates from a row of moments for each group and start. The determinant is the plain
    covariance's; the scatter is scaled so that the median distance is that of a normal law."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            rows = []
            for r in pdf.to_dict("records"):
                cov = _square(r, _COVS)
                scaled = cov * r["scale"]
                inv = _regular(scaled)[0]
                rows.append((r["grp"], r["start"], r["n"], _regular(cov)[1], *(r[c] for c in _MEANS), *(scaled[i, j] for i, j in _PAIRS), *(inv[i, j] for i, j in _PAIRS)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ESTIMATE.split(", ")])

    return moments.mapInPandas(run, _ESTIMATE)


def _moments(rows: DataFrame, scale: Column) -> DataFrame:
    covs = [F.covar_pop(_NAMES[i], _NAMES[j]).alias(c) for (i, j), c in zip(_PAIRS, _COVS)]
    return rows.groupBy("grp", "start").agg(F.first("n").alias("n"), scale.alias("scale"), *(F.avg(f).alias(c) for f, c in zip(_NAMES, _MEANS)), *covs)


def _best(estimates: DataFrame) -> DataFrame:
    """The estimate of least determinant of each group."""
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("logdet", "start"))
    return estimates.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def estimate(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The estimate of each group in counts (grp, n; materialised). rows: grp and the features."""
    many = counts.count() > BROADCAST_ROWS // STARTS
    hot = hot_keys(counts, ["grp"], "n") if many else None

    def beside(side: DataFrame) -> DataFrame:
        """The rows with what side has for their group."""
        return spread_join(rows, side, ["grp"], hot) if many else rows.join(F.broadcast(side), "grp")

    def step(now: DataFrame) -> DataFrame:
        near = beside(now.drop(*_COVS, "logdet")).withColumn("bin", F.floor(BINS * F.log1p(distance())).cast("int"))
        held = near.groupBy("grp", "start", "bin").agg(F.count("*").alias("k"), F.first("n").alias("n"))
        below = F.sum("k").over(Window.partitionBy("grp", "start").orderBy("bin"))
        cut = lambda share: F.min(F.when(F.col("below") >= F.ceil(share * F.col("n")), F.col("bin")))
        cuts = held.withColumn("below", below).groupBy("grp", "start").agg(cut(F.lit(CONCENTRATION)).alias("cut"), cut(F.lit(0.5)).alias("middle"))
        cuts = materialise(cuts, "cuts")
        inner = beside(now.drop(*_COVS, "logdet").join(cuts, ["grp", "start"])).filter(F.floor(BINS * F.log1p(distance())) <= F.col("cut"))
        middle = F.expm1((F.first("middle") + 1) / BINS)
        out = materialise(_estimates(_moments(inner, F.greatest(F.lit(1.0), middle / CHI_MEDIAN))), "estimate")
        discard(cuts)
        return out

    # A start's subset is told by a hash of the row's own features.
    u = F.pmod(F.xxhash64("start", *_NAMES), F.lit(1 << 40)) / float(1 << 40)
    picked = beside(counts).withColumn("start", F.explode(F.array(*(F.lit(k) for k in range(STARTS))))).filter((F.col("start") == 0) | (u < F.lit(SUBSET) / F.col("n")))
    now = materialise(_estimates(_moments(picked, F.lit(1.0))), "starts")
    for _ in range(FIRST_STEPS):
        now = step(now)
    best = now = materialise(_best(now), "chosen")
    for _ in range(MOST_STEPS):
        now = step(now)
        before = best.select("grp", F.col("logdet").alias("before"))
        better = now.join(before, "grp").filter(F.col("logdet") < F.col("before") - SETTLED)
        done = better.isEmpty()
        best = materialise(_best(best.withColumn("start", F.lit(1)).unionByName(now.withColumn("start", F.lit(0)))), "best")
        if done:
            break
    return best


def _drawn(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(centre, inverse scatter) of each row of nested estimates: columns n, m_i and c_i_j with the
    suffixes 0 (all rows) to 2; a missing one counts no rows."""
    for r in pdf.to_dict("records"):
        mean, cov = np.zeros(_P), np.zeros((_P, _P))
        for level in range(3):
            n = r[f"n{level}"]
            if n is None or n != n:
                continue
            w = n / (n + PRIOR) if level else 1.0
            mean = w * np.array([r[f"{c}{level}"] for c in _MEANS]) + (1 - w) * mean
            cov = w * _square(r, [f"{c}{level}" for c in _COVS]) + (1 - w) * cov
        yield mean, _regular(cov)[0]


_JUDGE = "_lang string, _source string, " + ", ".join(f"{c} double" for c in [*_MEANS, *(f"p_{i}_{j}" for i, j in _PAIRS)])


def fit(stats: DataFrame) -> DataFrame:
    """The estimate that judges each language and source; stats: with_statistics(), materialised."""
    fine = stats.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("lang", "source", *_NAMES)
    rows = fine.select(F.explode(F.array(*group_names())).alias("grp"), *_NAMES)
    counts = materialise(rows.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST), "counts")
    known = estimate(rows, counts).select("grp", "n", *_MEANS, *_COVS)
    held = materialise(fine.select("lang", "source").distinct(), "held")
    for level, name in enumerate(group_names()):
        mine = known.select(*(F.col(c).alias(f"{c}{level}") for c in known.columns))
        mine = small_side(mine, BROADCAST_ROWS // 10) if level == 2 else F.broadcast(mine.filter(~F.contains(F.col(f"grp{level}"), F.lit("\t"))))
        held = held.withColumn("_name", name).join(mine, F.col("_name") == F.col(f"grp{level}"), "left").drop("_name", f"grp{level}")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            rows = [(lang, source, *m, *(p[i, j] for i, j in _PAIRS)) for lang, source, (m, p) in zip(pdf["lang"], pdf["source"], _drawn(pdf))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _JUDGE.split(", ")])

    return small_side(materialise(held.mapInPandas(run, _JUDGE), "estimates"))


def judged(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """stats with base_failed, distance and kept."""
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    both = stats.join(estimates, same, "left")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return both.withColumns(
        {"base_failed": failed, "distance": distance(), "kept": ~failed & F.coalesce(distance() <= CUTOFF, F.lit(True))}
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the squared distance: one row a document."""
    stats = materialise(with_statistics(docs), "statistics", TEXT_ROWS)
    return judged(stats, fit(stats)).select("doc_id", *COUNTS, "base_failed", "kept", "distance")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, that the rules keep. They are written once with their
    statistics, so that nothing is counted twice and no join on ids is needed."""
    names = [*COUNTS, *_NAMES]

    @F.pandas_udf(STATS)
    def counted(texts: pd.Series) -> pd.DataFrame:
        return statistics(texts.tolist()) if len(texts) else pd.DataFrame(columns=names)

    columns = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col("lang").cast("string"), F.col("source").cast("string"), counted(F.col("text").cast("string")).alias("_s")
    ).select("_doc", "lang", "source", "_s.*")
    rows = materialise(rows, "statistics", TEXT_ROWS)
    return judged(rows, fit(rows)).filter("kept").select(*columns)
