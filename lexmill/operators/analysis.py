"""Analysers: from documents (doc, title, text) to the index terms of each, in Arrow batches.

A document becomes one row: its words are split, normalised and grouped by term within the row, so
that postings are a mere explode and no token is ever shuffled. `ascii` takes runs of ASCII letters
and digits, lower-cased, without stemming; `english` is the full analyser (sentences, Treebank words
with spans, stop list, stemmer). Columns of the result, of which only those asked for are made:

title_words; title_terms (pos, term); posts (term, positions: title words as -1 - ordinal, then body
ordinals, both among all words); surface (distinct lower-cased words for the dictionary); size (all
body words); maxf (greatest term frequency); for `english` also the spans tokens_title and tokens.

Words are looked at once for each distinct one in a slice of some MB; what goes by the token is
arithmetic on whole columns. So a task holds a slice, however long its batch is."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise, tokens
from ..functions.stopwords import STOPWORDS
from ..schemas import SPAN

ASCII_WORD = "[A-Za-z0-9]+"
_CACHED = 100_000
#: Bytes of text that are looked at together, or a single text.
SLICE = 1 << 20


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ASCII_WORD), F.lit(0))


def is_good(word: Column) -> Column:
    return (F.length(word) > 2) & word.rlike(r"\p{L}")


def english_term(word: str) -> str | None:
    found = normalise.normalise([word])
    return found[0][1] if found else None


class _Cache(dict):
    """What a function gave for the words met first, which are the frequent ones."""

    def __init__(self, f: Callable):
        self.f = f

    def __missing__(self, word: str):
        out = self.f(word)
        if len(self) < _CACHED:
            self[word] = out
        return out


class Words:
    """The words of a column of texts, one after another. codes: of each word the place in names, the
    distinct ones; counts: words of each text; spans: places of the words of each text, or None."""

    def __init__(self, words: pa.Array, counts: np.ndarray, spans: list | None = None):
        self.words, self.counts, self.spans = words, counts, spans
        self.doc = np.repeat(np.arange(len(counts)), counts)
        ends = np.cumsum(counts)
        self.pos = np.arange(len(words)) - np.repeat(ends - counts, counts)


_IS_WORD = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    _IS_WORD[_c] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _strings(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


class Ascii:
    """Runs of ASCII letters and digits, found in the texts' bytes."""

    def split(self, texts: pa.Array, spans: bool) -> Words:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        kept = _IS_WORD[data]
        begins = kept.copy()
        begins[1:] &= ~kept[:-1]
        first = edges[:-1][edges[:-1] < len(data)]
        begins[first] = kept[first]
        counts = np.diff(np.searchsorted(np.flatnonzero(begins), edges))
        ends = np.append(np.flatnonzero(begins[kept]), np.count_nonzero(kept))
        return Words(_strings(ends, data[kept]), counts)

    def lower(self, words: pa.Array) -> pa.Array:
        return pc.ascii_lower(words)

    #: Words are told apart by this.
    key = lower

    def terms(self, names: pa.Array) -> pa.Array:
        """The index term of each distinct word, null if it isn't worth indexing."""
        good = pc.and_(pc.greater(pc.binary_length(names), 2), pc.invert(pc.ascii_is_decimal(names)))
        return pc.if_else(pc.and_(good, pc.invert(pc.is_in(names, pa.array(STOPWORDS, names.type)))), names, None)

    def surface(self, names: pa.Array) -> pa.Array:
        """The dictionary's word of each, or null."""
        return pc.if_else(pc.and_(pc.greater(pc.binary_length(names), 3), pc.invert(pc.ascii_is_decimal(names))), names, None)


class English:
    """Treebank words, terms by stop list and stemmer."""

    def __init__(self):
        self._term = _Cache(english_term)
        self._surface = _Cache(lambda w: w.lower() if normalise.is_dictionary_word(w) else None)

    def split(self, texts: pa.Array, spans: bool) -> Words:
        texts = texts.to_pylist()
        at = [tokens.spans(t) for t in texts] if spans else None
        found = [tokens.words(t, None if at is None else at[k]) for k, t in enumerate(texts)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return Words(pa.array(list(chain.from_iterable(found)), pa.large_string()), counts, at)

    def key(self, words: pa.Array) -> pa.Array:
        return words

    def terms(self, names: pa.Array) -> pa.Array:
        return pa.array([self._term[w] for w in names.to_pylist()], pa.large_string())

    def surface(self, names: pa.Array) -> pa.Array:
        return pa.array([self._surface[w] for w in names.to_pylist()], pa.large_string())


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """A list column: row i has so many of the values as counts[i]."""
    return pa.ListArray.from_arrays(_offsets(counts), values)


def _bits(n: int) -> int:
    return max(int(n) - 1, 1).bit_length()


def _named(names: pa.Array, of: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """of: the place in names of each word. The same for names that are null, as -1, or equal."""
    coded = names.dictionary_encode()
    back = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return back[of] if len(of) else np.zeros(0, np.int64), coded.dictionary


def _groups(doc: np.ndarray, code: np.ndarray, pos: np.ndarray, n: int, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words by document and code, in their order there. Of each group: code and size; of each of n
    documents, its groups; and the positions."""
    a, b = _bits(codes), _bits(len(doc))
    keys = (((doc << a) | code) << b) | np.arange(len(doc))
    keys.sort()
    positions = pos[keys & ((1 << b) - 1)].astype(np.int32)
    keys >>= b
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    sizes = np.diff(np.append(starts, len(keys)))
    heads = keys[starts]
    return heads & ((1 << a) - 1), sizes, np.bincount(heads >> a, minlength=n), positions


def _strs(values: pa.Array) -> pa.Array:
    return values.cast(pa.string())


_TERMS = "array<struct<pos: int, term: string>>"
_COLUMNS = {
    "doc": "string",
    "title": "string",
    "text": "string",
    "title_words": "array<string>",
    "title_terms": _TERMS,
    "posts": "array<struct<term: string, positions: array<int>>>",
    "surface": "array<string>",
    "size": "int",
    "maxf": "int",
}
_SPANS = {"tokens_title": f"array<{SPAN}>", "tokens": f"array<{SPAN}>"}


def _span_lists(parts: list[list[tuple[int, int]]]) -> pa.Array:
    flat = np.array(list(chain.from_iterable(parts)), np.int32).reshape(-1, 2)
    ends = [pa.array(np.ascontiguousarray(flat[:, k])) for k in (0, 1)]
    return _lists(np.fromiter(map(len, parts), np.int64, len(parts)), pa.StructArray.from_arrays(ends, ["from", "to"]))


def slices(it: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of SLICE bytes of a column, or of one row."""
    for whole in it:
        sizes = pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False)
        first = held = 0
        for k, n in enumerate(sizes.tolist()):
            if k > first and held + n > SLICE:
                yield whole.slice(first, k - first)
                first = k
                held = 0
            held += n
        if whole.num_rows > first:
            yield whole.slice(first)


def _analyse(docs: DataFrame, analyser: type, every: dict[str, str], columns: Sequence[str] | None) -> DataFrame:
    wanted = [c for c in every if columns is None or c in columns]
    with_spans = "tokens" in wanted or "tokens_title" in wanted

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = analyser()
        for batch in slices(it):
            n = batch.num_rows
            head, body = (how.split(batch.column(c), with_spans) for c in ("title", "text"))
            made = {c: batch.column(c) for c in ("doc", "title", "text")}
            made["size"] = pa.array(body.counts.astype(np.int32))
            doc = np.concatenate((head.doc, body.doc))
            pos = np.concatenate((-1 - head.pos, body.pos))
            coded = how.key(pa.concat_arrays([head.words, body.words])).dictionary_encode()
            names, of = coded.dictionary, coded.indices.to_numpy()
            term, terms = _named(how.terms(names), of)
            if "posts" in wanted or "maxf" in wanted:
                kept = np.flatnonzero(term >= 0)
                code, tf, lists, positions = _groups(doc[kept], term[kept], pos[kept], n, len(terms))
                some = lists > 0
                most = np.zeros(n, np.int32)
                if len(tf):
                    most[some] = np.maximum.reduceat(tf, (np.cumsum(lists) - lists)[some])
                made["maxf"] = pa.array(most)
                if "posts" in wanted:
                    parts = [_strs(terms.take(pa.array(code))), _lists(tf, pa.array(positions))]
                    made["posts"] = _lists(lists, pa.StructArray.from_arrays(parts, ["term", "positions"]))
            if "surface" in wanted:
                word, words = _named(how.surface(names), of)
                kept = word >= 0
                shift = _bits(len(words))
                pairs = np.unique((doc[kept] << shift) | word[kept])
                found = words.take(pa.array(pairs & ((1 << shift) - 1)))
                made["surface"] = _lists(np.bincount(pairs >> shift, minlength=n), _strs(found))
            if "title_words" in wanted:
                made["title_words"] = _lists(head.counts, _strs(head.words))
            if "title_terms" in wanted:
                kept = np.flatnonzero(term[: len(head.words)] >= 0)
                parts = [pa.array(head.pos[kept].astype(np.int32)), _strs(terms.take(pa.array(term[kept])))]
                made["title_terms"] = _lists(np.bincount(head.doc[kept], minlength=n), pa.StructArray.from_arrays(parts, ["pos", "term"]))
            if with_spans:
                made["tokens_title"], made["tokens"] = _span_lists(head.spans), _span_lists(body.spans)
            yield pa.RecordBatch.from_pydict({c: made[c] for c in wanted})

    return docs.select("doc", "title", "text").mapInArrow(run, ", ".join(f"{c} {every[c]}" for c in wanted))


def analyse_ascii(docs: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _analyse(docs, Ascii, _COLUMNS, columns)


def analyse_english(docs: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _analyse(docs, English, _COLUMNS | _SPANS, columns)


def distinct_words(docs: DataFrame, terms: bool = True) -> DataFrame:
    """term: the distinct surface words of the documents, and their terms if wanted (`ascii`). Words are
    made distinct in each slice first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = Ascii()
        for batch in slices(it):
            found = pa.concat_arrays([how.split(batch.column(c), False).words for c in ("title", "text")])
            names = pc.unique(how.key(found))
            kept = pc.coalesce(how.surface(names), how.terms(names)) if terms else how.surface(names)
            yield pa.RecordBatch.from_pydict({"term": _strs(pc.drop_null(kept))})

    return docs.select("title", "text").mapInArrow(run, "term string").distinct()


def words(text: Column, analyser: str) -> Column:
    """All words of a text."""
    if analyser == "ascii":
        return ascii_words(text)

    @F.pandas_udf("array<string>")
    def split(col: pd.Series) -> pd.Series:
        return col.map(tokens.words)

    return split(text)


ANALYSERS = {"ascii": analyse_ascii, "english": analyse_english}
