"""Command line: python -m lexmill feed|dict|search|lookup|stats STORE ...

feed and dict read an XML dump; search prints ranked snippets, lookup the keys near a word. Feeding
prints how fast it was, and searching how long each phase took (to the error stream)."""

from __future__ import annotations

import argparse
import sys
import time
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import search, snippets
from .operators.analysis import ANALYSERS
from .sources import dump
from .sources.scratch import saved
from .sources.store import StoreAlreadyExists, create_store, open_store


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lexmill", description="Full-text search over Parquet stores.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("feed", "index the articles of a dump"), ("dict", "add the words of a dump as keys, for spelling correction")):
        c = sub.add_parser(name, help=text)
        c.add_argument("store")
        c.add_argument("dump")
        c.add_argument("--skip", type=int, default=0, help="pages to leave out")
        c.add_argument("--empty", action="store_true", help="start with an empty store")
        if name == "feed":
            c.add_argument("--disable-index", action="store_true", help="keep the articles only")
            c.add_argument("--disable-articles", action="store_true", help="index only")
        c.add_argument("--analyser", choices=sorted(ANALYSERS), default="english")
    c = sub.add_parser("search", help="ranked search with snippets")
    c.add_argument("store")
    c.add_argument("query")
    c.add_argument("-n", type=int, default=10, help="results")
    c.add_argument("--skip", type=int, default=0, help="results to leave out")
    c = sub.add_parser("lookup", help="keys within k corrections of a word")
    c.add_argument("store")
    c.add_argument("word")
    c.add_argument("-k", "--mistakes", type=int, default=0)
    c.add_argument("--keys-only", action="store_true")
    c.add_argument("--limit", type=int)
    c.add_argument("--offset", type=int, default=0)
    c = sub.add_parser("stats", help="sizes of a store")
    c.add_argument("store")
    return p.parse_args(argv)


@contextmanager
def _timed(took: dict[str, float], phase: str):
    began = time.perf_counter()
    yield
    took[phase] = took.get(phase, 0.0) + time.perf_counter() - began


def _report(took: dict[str, float], articles: int | None = None) -> None:
    parts = [f"{phase} {s:.1f} s" for phase, s in took.items()]
    if articles is not None:
        parts.append(f"{articles} articles, {articles / max(1e-9, sum(took.values())):.1f} a second")
    print(", ".join(parts), file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    args = _arguments(argv)
    spark = SparkSession.builder.appName("lexmill").getOrCreate()
    if args.command in ("feed", "dict"):
        try:
            store = create_store(spark, args.store, overwrite=args.empty, analyser=args.analyser)
        except StoreAlreadyExists:
            store = open_store(spark, args.store)
        docs = dump.articles(spark, args.dump, args.skip)
        took: dict[str, float] = {}
        with _timed(took, "read and analyse"):
            rows = saved(ANALYSERS[store.analyser](docs))
        with _timed(took, "write"):
            if args.command == "dict":
                store.feed(rows, dictionary_only=True)
            else:
                store.feed(rows, keys=not args.disable_index, articles=not args.disable_articles)
        _report(took, rows.count())
        return 0
    store = open_store(spark, args.store)
    if args.command == "stats":
        store.stats().show(vertical=True)
    elif args.command == "lookup":
        found = store.word_query(args.word, args.mistakes, args.keys_only, args.limit, args.offset)
        print("Total results:", (found.select("exact_total").first() or [0])[0])
        for r in found.drop("word", "exact_total").orderBy("term").toLocalIterator():
            print(*r)
    else:
        took = {}
        with _timed(took, "index"):
            index = store.index()
        queries = spark.createDataFrame([(0, args.query)], "query_id long, text string")
        with _timed(took, "match"):
            ranking = search.search(queries, index, args.n, args.skip)
        with _timed(took, "rank"):
            scores = saved(ranking.scores)
        with _timed(took, "render"):
            hits = ranking.hits.join(scores, ["query_id", "doc"]).select("query_id", "doc", F.explode("positions").alias("pos"))
            if "tokens" in index.articles.columns:
                shown = snippets.snippets(hits, index.articles).join(scores, ["query_id", "doc"])
                for r in shown.orderBy("rank").collect():  # one page of results
                    print(f"Title: {r.display_title}", *(f"... {p} ..." for p in r.parts), "", sep="\n")
            else:
                for r in scores.orderBy("rank").collect():
                    print(r.rank, r.doc, r.score)
        _report(took)
    return 0


if __name__ == "__main__":
    sys.exit(main())
