"""URL filters: rules, then host word segmentation and naive Bayes.

A rule names a host (and so its subdomains) and a path prefix; the longest rule that fits a URL
decides. Other URLs are scored: concatenated host names are split into words by a unigram Viterbi
search, and multinomial naive Bayes scores the words of host and path. Its classes are learned from
the URLs that the rules decide; the unigram counts come from the texts of all pages.

All words and all tokens count. Hosts are split once each: a table of the distinct hosts meets those
words that occur in any of their names. What the tasks are sent is bounded: beyond SENT rows, words,
hosts and token odds are joined instead, with the same result. A name of more than 63 letters, which
is more than a host name's part can have, is one word.

Defined results: a null URL, or one without `://`, has empty host and path, no tokens, and the
verdict of the class shares alone; where the rules decide no URL of one class, every other URL is
allowed; a score tie allows; repeated rows are judged alike; an empty table gives no rows; a null
page_id stays null; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, hot_keys, materialise, spread_join

RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
SENT = 100_000  # rows of words, hosts or tokens that may be sent to every task
LONGEST_NAME = 63  # letters of a part of a host name
SMOOTH = 1.0
_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_UNSEEN = re.compile(r"<(script|style)\b|<!--", re.I)
_CLOSING = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "": re.compile("-->")}
_MARKUP = re.compile(r"<[^<>]*>|&#?\w+;")
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[^\W_]+")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path)."""
    m = _HOST.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


@dataclass
class Rules:
    """Rules by host; of those that fit, the longest decides (of equals, the one listed first)."""

    rules: tuple[tuple[str, str], ...]
    by_host: dict[str, list[tuple[str, str, str]]] = field(init=False)

    def __post_init__(self) -> None:
        self.by_host = {}
        for rule, verdict in self.rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_LOWER), []).append((slash + path, rule, verdict))

    def decide(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        labels = host.split(".")
        for k in range(len(labels)):
            for prefix, rule, verdict in self.by_host.get(".".join(labels[k:]), ()):
                if path.startswith(prefix) and (best[0] is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
        return best


class Segmenter:
    """Unigram Viterbi: the split of a name into words that the unigram model finds likeliest. counts:
    the words that may occur in the names; total: of all words."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) or 1
        self.logp = {w: math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(1 / total) if total > 1 else math.log(0.1)

    def cost(self, word: str) -> float:
        # A word that isn't known is the less likely the longer it is.
        return self.logp.get(word, self.unknown - 1 - 2.3 * len(word))

    def split(self, name: str) -> tuple[str, ...]:
        if len(name) > LONGEST_NAME:
            return (name,)
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            score, start = max((best[s] + self.cost(name[s:end]), s) for s in range(end))
            best.append(score)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(out))


def _runs(text: str) -> Iterator[str]:
    """Runs of digits and of other word characters."""
    for part in _PART.findall(text.lower()):
        yield from re.findall(r"\d+|\D+", part)


def path_tokens(path: str) -> list[str]:
    """Words of the path; numbers count by their length."""
    return [f"p:#{len(r)}" if r[0].isdigit() else "p:" + r for r in _runs(path)]


def host_tokens(host: str, segmenter: Segmenter) -> list[str]:
    out = []
    for r in _runs(host):
        out += [f"h:#{len(r)}"] if r[0].isdigit() else ["h:" + w for w in segmenter.split(r)]
    return out


def visible(html: str) -> str:
    """The text of a page with its markup, scripts and character references as blanks."""
    out, at = [], 0
    while m := _UNSEEN.search(html, at):
        out.append(html[at : m.start()])
        end = _CLOSING[(m[1] or "").lower()].search(html, m.end())
        at = end.end() if end else len(html)
    out.append(html[at:])
    return _MARKUP.sub(" ", " ".join(out))


def lexicon(pages: DataFrame) -> DataFrame:
    """word, n: how often each word occurs in all pages' texts. Each task sends what it counted, so
    that words are pre-aggregated before the shuffle."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for pdf in batches(it):
            for html in pdf["html"].array:
                if html:
                    found.update(_WORD.findall(visible(html).lower()))
            if len(found) > 500_000:
                yield pd.DataFrame({"word": list(found), "n": list(found.values())})
                found.clear()
        if found:
            yield pd.DataFrame({"word": list(found), "n": list(found.values())})

    counts = pages.select(F.col("html").cast("string")).mapInPandas(run, "word string, n long")
    return materialise(counts.groupBy("word").agg(F.sum("n").alias("n")), "words")


def observed(pages: DataFrame, rules: Rules) -> DataFrame:
    """host, verdict, token, n: pages by host and the rules' verdict (empty: none; token null), and
    the decided pages' path tokens by verdict (host null)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[tuple[str | None, str, str | None]] = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*k, n) for k, n in found.items()], columns=["host", "verdict", "token", "n"])
            found.clear()
            return out

        for pdf in batches(it):
            for url in pdf["url"].array:
                host, path = split_url(url)
                verdict = rules.decide(host, path)[1]
                found[host, verdict or "", None] += 1
                if verdict:
                    for t in path_tokens(path):
                        found[None, verdict, t] += 1
            if len(found) > 500_000:
                yield flush()
        if found:
            yield flush()

    rows = pages.select(F.col("url").cast("string")).mapInPandas(run, "host string, verdict string, token string, n long")
    return materialise(rows.groupBy("host", "verdict", "token").agg(F.sum("n").alias("n")), "observed")


_SPLIT = "host string, n long, tokens array<string>"


def split_hosts(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """host, n, tokens of the distinct hosts (host, n), by the counts of words."""
    total = words.agg(F.sum("n")).first()[0] or 0

    def parts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            rows = []
            for host in pdf["host"]:
                names = {r for r in _runs(host) if not r[0].isdigit() and len(r) <= LONGEST_NAME}
                rows += [(host, w) for w in {r[i:j] for r in names for i in range(len(r)) for j in range(i + 1, len(r) + 1)}]
            yield pd.DataFrame(rows, columns=["host", "word"])

    inside = materialise(hosts.select("host").mapInPandas(parts, "host string, word string"), "parts")
    uses = inside.groupBy("word").agg(F.count("*").alias("uses"))
    known = materialise(uses.join(words, "word"), "known")
    few = known.limit(SENT + 1).count() <= SENT
    counts = {r["word"]: r["n"] for r in known.collect()} if few else None
    if few:
        rows = hosts
    else:
        held = spread_join(inside, known, ["word"], hot_keys(known, ["word"], "uses"))
        rows = hosts.join(held.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("word", F.col("n")))).alias("words")), "host", "left")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = Segmenter(counts, total) if few else None
        for pdf in batches(it):
            own = [whole] * len(pdf) if few else [Segmenter(dict(w) if w is not None else {}, total) for w in pdf["words"]]
            yield pd.DataFrame({"host": pdf["host"], "n": pdf["n"], "tokens": [host_tokens(h, s) for h, s in zip(pdf["host"], own)]})

    return materialise(rows.mapInPandas(run, _SPLIT), "hosts")


def token_odds(seen: DataFrame, hosts: DataFrame) -> tuple[float, DataFrame]:
    """The prior log odds for block, and token, odds: multinomial naive Bayes over the tokens of all URLs
    that the rules decide. Without one of the classes the prior is minus infinity."""
    decided = seen.filter("verdict <> ''")
    classes = {r[0]: r[1] for r in decided.filter("token is null").groupBy("verdict").agg(F.sum("n")).collect()}
    of_hosts = decided.filter("token is null").select("host", "verdict", F.col("n").alias("pages")).join(hosts.select("host", "tokens"), "host")
    of_hosts = of_hosts.select("verdict", F.explode("tokens").alias("token"), F.col("pages").alias("n"))
    both = decided.filter("token is not null").select("verdict", "token", "n").unionByName(of_hosts)
    per = both.groupBy("token").agg(*(F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")))
    per = materialise(per, "tokens")
    size, a, b = per.agg(F.count("*"), F.sum("allow"), F.sum("block")).first()
    allow, block = classes.get("allow", 0), classes.get("block", 0)
    if not allow or not block:
        return -math.inf, per.select("token", F.lit(0.0).alias("odds"))
    log = lambda n, whole: F.log((F.col(n) + SMOOTH) / F.lit((whole or 0) + SMOOTH * size))
    return math.log(block / allow), per.select("token", (log("block", b) - log("allow", a)).alias("odds"))


_JUDGED = "page_id long, host string, path string, rule string, verdict string, words string, score double"


def judge(pages: DataFrame, rules: Rules, hosts: DataFrame, prior: float, odds: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, words, score: one row a page."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    words = F.array_join(F.transform(F.filter("tokens", lambda t: t.startswith("h:")), lambda t: F.substring(t, F.lit(3), F.length(t))), " ")
    mine = hosts.select("host", F.explode("tokens").alias("token")).join(odds, "token", "left").groupBy("host").agg(F.sum(F.coalesce("odds", F.lit(0.0))).alias("host_score"))
    scored = materialise(hosts.select("host", "n", words.alias("words")).join(mine, "host", "left"), "scored")
    if scored.count() <= SENT and odds.count() <= SENT:
        by_host = {r["host"]: (r["words"], r["host_score"] or 0.0) for r in scored.collect()}
        by_token = {r["token"]: r["odds"] for r in odds.filter("token like 'p:%'").collect()}

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches(it):
                out = []
                for page, url in zip(pdf["page_id"].array, pdf["url"].array):
                    host, path = split_url(url)
                    rule, verdict = rules.decide(host, path)
                    named, score = by_host[host]
                    score = prior + score + sum(by_token.get(t, 0.0) for t in path_tokens(path))
                    out.append((page, host, path, rule, verdict or ("block" if score > 0 else "allow"), named, score))
                yield _frame(out, _JUDGED)

        return rows.mapInPandas(run, _JUDGED)

    def parts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            out = []
            for page, url in zip(pdf["page_id"].array, pdf["url"].array):
                host, path = split_url(url)
                out.append((page, host, path, *rules.decide(host, path), path_tokens(path)))
            yield _frame(out, cut)

    cut = "page_id long, host string, path string, rule string, verdict string, tokens array<string>"
    found = materialise(rows.mapInPandas(parts, cut).withColumn("_row", F.monotonically_increasing_id()), "urls")
    of_path = found.select("_row", F.explode("tokens").alias("token"))
    uses = of_path.groupBy("token").agg(F.count("*").alias("uses"))
    of_path = spread_join(of_path, odds, ["token"], hot_keys(uses, ["token"], "uses"))
    of_path = of_path.groupBy("_row").agg(F.sum("odds").alias("path_score"))
    both = spread_join(found.drop("tokens"), scored.drop("n"), ["host"], hot_keys(scored, ["host"], "n"), "left").join(of_path, "_row", "left")
    score = F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0))
    verdict = F.coalesce("verdict", F.when(score > 0, "block").otherwise("allow"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "words", score.alias("score"))


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    out["page_id"] = out["page_id"].astype("Int64")
    return out


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    known = Rules(rules)
    seen = observed(pages, known)
    hosts = split_hosts(seen.filter("token is null").groupBy("host").agg(F.sum("n").alias("n")), lexicon(pages))
    return judge(pages, known, hosts, *token_odds(seen, hosts))
