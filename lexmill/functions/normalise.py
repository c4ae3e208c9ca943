"""From words to index terms."""

from __future__ import annotations

from .stem import stem
from .stopwords import STOPWORDS

_STOP = frozenset(STOPWORDS)


def has_letter(word: str) -> bool:
    return any(c.isalpha() for c in word)


def is_good_word(word: str) -> bool:
    """Worth indexing: more than two characters, a letter among them."""
    return len(word) > 2 and has_letter(word)


def is_dictionary_word(word: str) -> bool:
    return len(word) > 3 and has_letter(word)


def normalise(words: list[str]) -> list[tuple[int, str]]:
    """(ordinal among all words, stem) of the words worth indexing."""
    kept = ((i, w.lower()) for i, w in enumerate(words) if is_good_word(w))
    return [(i, stem(w)) for i, w in kept if w not in _STOP]


def normalise_drop(words: list[str]) -> list[str]:
    return [w for _, w in normalise(words)]


def normalise_gently(words: list[str]) -> list[str]:
    return [w.lower() for w in words]


def negate(positions: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Title ordinals are stored as negative numbers."""
    return [(-1 - i, w) for i, w in positions]


def merge_sorted(lists: list[list[int]]) -> list[int]:
    return sorted({x for part in lists for x in part})
