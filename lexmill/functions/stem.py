"""The Snowball English stemmer (Porter2), after its published description.

Step 1c asks for the word's length first, so that two-letter words are left alone."""

from __future__ import annotations

from functools import lru_cache

VOWELS = frozenset("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = frozenset("cdeghkmnrt")

WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())

STEP_2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""),
    ("ical", "ic"), ("ness", ""), ("ful", ""),
)
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    """Where the part after the first non-vowel that follows a vowel begins, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _regions(word: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "arsen", "commun") if word.startswith(p)), None)
    r1 = _region(word, 0) if r1 is None else r1
    return r1, _region(word, r1)


def _short_syllable(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS and word[-1] not in "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    word = word.lower().translate({0x2019: "'", 0x2018: "'", 0x201B: "'"})
    if len(word) <= 2:
        return word
    if word in WHOLE_WORDS:
        return WHOLE_WORDS[word]
    word = word.removeprefix("'")
    chars = list(word)
    for i, c in enumerate(chars):
        if c == "y" and (i == 0 or chars[i - 1] in VOWELS):
            chars[i] = "Y"
    word = "".join(chars)
    r1, r2 = _regions(word)

    for end in ("'s'", "'s", "'"):  # step 0
        if word.endswith(end):
            word = word[: -len(end)]
            break

    if word.endswith("sses"):  # step 1a
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word

    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):  # step 1b
        if word.endswith(end):
            if end in ("eedly", "eed"):
                if len(word) - len(end) >= r1:
                    word = word[: -len(end)] + "ee"
            elif _has_vowel(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word.endswith(DOUBLES):
                    word = word[:-1]
                elif r1 >= len(word) and _short_syllable(word):
                    word += "e"
            break

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:  # step 1c
        word = word[:-1] + "i"

    for end, new in STEP_2:
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                before = word[-len(end) - 1 : -len(end)]
                if not (end == "ogi" and before != "l" or end == "li" and before not in LI_ENDINGS):
                    word = word[: -len(end)] + new
            break

    for end, new in STEP_3:
        if word.endswith(end):
            if len(word) - len(end) >= (r2 if end == "ative" else r1):
                word = word[: -len(end)] + new
            break

    for end in STEP_4:
        if word.endswith(end):
            if len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
                word = word[: -len(end)]
            break

    if word.endswith("e"):  # step 5
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_syllable(word[:-1]):
            word = word[:-1]
    elif word.endswith("l") and len(word) - 1 >= r2 and word[-2:-1] == "l":
        word = word[:-1]
    return word.replace("Y", "y")
