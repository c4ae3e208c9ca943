"""Sentences, words and their spans.

A sentence is cut into words in the Treebank manner, by places: a first scan marks cuts around
punctuation, brackets and quotation marks, a second one takes the endings of contractions off the
chunks between. Nothing is rewritten, so that the cuts are the words' spans.

Sentence ends are found by rule: a mark of . ! or ? (with closing quotes or brackets) before white
space and an upper-case letter, digit or opening quote, unless the mark ends a known abbreviation or
an initial. Only a sentence's last full stop is split off its word.
"""

from __future__ import annotations

import re

_ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof sr jr st vs etc fig no vol pp ed eds inc ltd co corp gen col capt lt sgt rev hon gov sen rep jan feb mar apr jun jul aug sep sept oct nov dec".split()
)
_SENTENCE_END = re.compile(r"[.!?]+[\"')\]}”’]*(?=\s+[\"'(\[{“‘]*[^\Wa-z_])|\n\s*\n")
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ."

_INITIALS = re.compile(r"(?:[a-z]\.)*[a-z]")

#: Marks that are words of their own, wherever they stand.
_MARK = re.compile(r"[;@#$%&?!()\[\]{}<>\"]|\.\.\.|--|''|``|[,:](?=[^0-9])")
_CHUNK = re.compile(r"\S+")
_CLOSING = "])}>\"'"
_ENDINGS = ("'",), ("'s", "'S", "'m", "'M", "'d", "'D", "'"), ("'ll", "'re", "'ve", "n't"), ("'LL", "'RE", "'VE", "N'T")
#: Fused words, and how long their first part is.
_FUSED = {"cannot": 3, "d'ye": 1, "gimme": 3, "gonna": 3, "gotta": 3, "lemme": 3, "more'n": 4, "wanna": 3, "'tis": 2, "'twas": 2}
_FUSED_LETTERS = tuple(w for w in _FUSED if w.isalpha())


def sentences(text: str) -> list[tuple[int, int]]:
    """Half-open spans of the sentences, without the white space between them."""
    out, start = [], 0
    for m in _SENTENCE_END.finditer(text):
        if m[0][0] == "." and len(m[0].rstrip("\"')]}")) == 1:
            last = text[max(start, text.rfind(" ", start, m.start())) : m.start()]
            w = last[len(last.rstrip(_LETTERS)) :].lower()
            if w.rpartition(".")[2] in _ABBREVIATIONS or _INITIALS.fullmatch(w):
                continue
        out.append((start, m.end()))
        start = m.end()
    out.append((start, len(text)))
    spans = []
    for a, b in out:
        part = text[a:b]
        lead = len(part) - len(part.lstrip())
        if part.strip():
            spans.append((a + lead, a + len(part.rstrip())))
    return spans


def _cuts(text: str) -> list[int]:
    """Places in a sentence where a word begins or ends for the sake of a mark."""
    cuts = [at for m in _MARK.finditer(text) for at in m.span()]
    # The full stop that ends the sentence, before what closes it.
    body = text.rstrip()
    stop = len(body.rstrip(_CLOSING)) - 1
    if stop > 0 and body[stop] == "." and body[stop - 1] != ".":
        cuts += [stop, stop + 1]
    return cuts


def _parts(chunk: str) -> list[int]:
    """Places within a chunk where endings and fused words are cut."""
    if "'" not in chunk and not chunk.lower().endswith(_FUSED_LETTERS):
        return []
    cuts: list[int] = []
    end = len(chunk)
    for group in _ENDINGS:
        for x in group:
            at = end - len(x)
            if at > 0 and chunk.endswith(x, 0, end) and chunk[at - 1] != "'":
                cuts.append(at)
                end = at
                break
    low = chunk[:end].lower()
    for word, size in _FUSED.items():
        at = end - len(word)
        if word[0] == "'":  # begins a chunk
            after = chunk[len(word) : len(word) + 1]
            if low.startswith(word) and not (after.isalnum() or after == "_"):
                cuts += [size, len(word)]
        elif low.endswith(word) and (not at or not (chunk[at - 1].isalnum() or chunk[at - 1] == "_")):
            cuts += [at] * (at > 0) + [at + size]
    return cuts


def treebank_spans(sentence: str) -> list[tuple[int, int]]:
    """Half-open spans of the words of a sentence."""
    edges = sorted({0, len(sentence), *_cuts(sentence)})
    out = []
    for a, b in zip(edges, edges[1:]):
        for m in _CHUNK.finditer(sentence, a, b):
            start, end = m.span()
            if parts := _parts(m[0]):
                places = sorted({start, end, *(start + x for x in parts)})
                out += zip(places, places[1:])
            else:
                out.append((start, end))
    return out


def treebank(sentence: str) -> list[str]:
    """The words of a sentence."""
    return [sentence[a:b] for a, b in treebank_spans(sentence)]


class _Cache(dict):
    """What a function gave for the chunks met first, which are the frequent ones."""

    def __init__(self, f):
        self.f = f

    def __missing__(self, chunk: str):
        out = self.f(chunk)
        if len(self) < 50_000:
            self[chunk] = out
        return out


def _whole(chunk: str) -> bool:
    return chunk.isalnum() and not chunk.lower().endswith(_FUSED_LETTERS)


def _cut(chunk: str, cutting: str, slow) -> list[tuple[int, int]]:
    """Words of a chunk; letters and digits with at most one mark behind need no scan."""
    n = len(chunk)
    if _whole(chunk):
        return [(0, n)]
    if chunk[-1] in ".,:;?!" and _whole(chunk[:-1]):
        return [(0, n - 1), (n - 1, n)] if chunk[-1] in cutting else [(0, n)]
    return slow(chunk)


# A chunk between white space is cut in the same way wherever it stands in a sentence, but for the
# last one, and the last that is also the first.
_inner = _Cache(lambda c: _cut(c, ",:;?!", lambda c: treebank_spans(c + " x")[:-1]))
_last = _Cache(lambda c: _cut(c, ".;?!", lambda c: [(a - 2, b - 2) for a, b in treebank_spans("x " + c)[1:]]))
_inner_words = _Cache(lambda c: [c[a:b] for a, b in _inner[c]])
_last_words = _Cache(lambda c: [c[a:b] for a, b in _last[c]])


def spans(text: str | None) -> list[tuple[int, int]]:
    """Half-open character spans of the words of a text."""
    out: list[tuple[int, int]] = []
    for begin, end in sentences(text or ""):
        chunks = text[begin:end].split()
        at, most = begin, len(chunks) - 1
        for k, chunk in enumerate(chunks):
            at = text.find(chunk, at)
            for a, b in _inner[chunk] if k < most else _last[chunk] if k else treebank_spans(chunk):
                out.append((at + a, at + b))
            at += len(chunk)
    return out


def words(text: str | None, of: list[tuple[int, int]] | None = None) -> list[str]:
    if of is not None:
        return [text[a:b] for a, b in of]
    out: list[str] = []
    for begin, end in sentences(text or ""):
        sentence = text[begin:end]
        *chunks, last = sentence.split()
        for chunk in chunks:
            if chunk.isalpha() and chunk[-1] not in "aetAET":  # no fused word ends otherwise
                out.append(chunk)
            else:
                out += _inner_words[chunk]
        out += _last_words[last] if chunks else treebank(sentence)
    return out
