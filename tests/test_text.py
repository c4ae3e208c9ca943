import bz2
import random

import pytest

from lexmill.functions import clean, normalise, tokens
from lexmill.functions.stem import stem

STEMS = {
    "consign": "consign", "consistency": "consist", "knightly": "knight", "generously": "generous", "happy": "happi", "flies": "fli",
    "dying": "die", "hopping": "hop", "hoping": "hope", "relational": "relat", "conditional": "condit", "triplicate": "triplic",
    "hopefulness": "hope", "controlling": "control", "ties": "tie", "by": "by", "cry": "cri", "enjoy": "enjoy", "agreed": "agre",
    "gas": "gas", "kiwis": "kiwi", "apologies": "apolog", "skies": "sky", "universities": "univers",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_words_and_spans():
    text = 'Mr. Smith can\'t go, he said. "It\'s 3,000 miles!" They cannot (see: this).'
    got = tokens.words(text)
    assert got[:8] == ["Mr.", "Smith", "ca", "n't", "go", ",", "he", "said"]
    assert "3,000" in got and "'s" in got and got[-5:] == ["see", ":", "this", ")", "."]
    at = tokens.spans(text)
    assert all(0 <= a < b <= len(text) for a, b in at) and [b for _, b in at] == sorted(b for _, b in at)
    assert tokens.words(None) == [] and tokens.words("") == []


def test_spans_are_the_words():
    """No letter is lost: the spans of any text hold all that isn't white space, in order."""
    rng = random.Random(2)
    bits = ["a", "can't", "cannot", "dogs'", "it's'", "'tis", ".", " ", ",", ":", "3", '"', "''", "``", "(", ")", "...", "--", "!", "We'll", "DON'T", "U.S.", "'", "gonna", "é", "\n\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        at = tokens.spans(text)
        assert "".join(text[a:b] for a, b in at) == "".join(text.split())
        assert all(b <= c for (_, b), (c, _) in zip(at, at[1:]))
    assert tokens.words("it's' can't:3 x...y 'tis, gonna") == ["it", "'s", "'", "can't:3", "x", "...", "y", "'t", "is", ",", "gon", "na"]


def test_sentences():
    text = "He saw Dr. Who. It was late! Was it? yes. 3 came."
    assert [text[a:b] for a, b in tokens.sentences(text)] == ["He saw Dr. Who.", "It was late!", "Was it? yes.", "3 came."]


def test_normalise():
    assert normalise.normalise(["The", "Cats", "of", "12345", "running", "amp", "n't"]) == [(1, "cat"), (4, "run")]
    assert normalise.negate([(0, "a"), (2, "b")]) == [(-1, "a"), (-3, "b")]
    assert normalise.merge_sorted([[3, 1], [1, 2]]) == [1, 2, 3]
    assert normalise.merge_sorted([]) == []


@pytest.mark.parametrize(
    "raw, want",
    [
        ("a {{x|{{y}}}} b", "a b"),
        ("x {| t |} after", "x after"),
        ("[[bar|baz]]s and [[foo]] [[File:x.png]]", "bazs and foo "),
        ("[http://x label] [http://y]", "label [http://y]"),
        ("'''bold''' ''it''", 'bold "it"'),
        ("x<!-- c -->y<br />z", "xyz"),
        ("<ref>gone</ref>kept", "kept"),
        ("<math>a</math><math>b</math>", "formula_1formula_2"),
        ("a....... b,, c", "a... b, c"),
        ("&amp;eacute; &#233; &#xe9; &bogus;", "é é é &bogus;"),
        ("<div><b>x</b></div>", "x"),
        ("{{never closed", "{{never closed"),
        ("x{{a}} b {{c {{d}} e", "x b e"),
        ("y[[a:b|c]] [[w:d]] [[x|]]", "y w:d x"),
        ("see [one two three] [word]", "see two three"),
        ("''\"said\"'' and \"\"twice\"\"", '"said" and twice'),
        ("'''''both''''' '''bold", "both bold"),
        ("<math>a</math> <math>a</math> <math>c</math>", "formula_1 formula_1 formula_3"),
        ("<ref name=x/>a<references />b<br>c", "ab<br>c"),
        ("<TABLE a=b>x</Table >y</table>z", "z"),
        ("a\n--\nb\n preformatted\nc", "a\nb\n\nc"),
        ("<< x >>\ty  z", "« x » y z"),
    ],
)
def test_clean(raw, want):
    assert clean.clean(raw).strip() == want.strip()


def test_compact():
    text = "lead\n== One ==\n=== Sub? ===\nplain\n* item\n== Empty ==\n== Two ==\n{| rest\n(bracketed)\n...\nend"
    assert clean.compact(text) == ["lead", "One.", "Sub?", "plain", " item", "Two.", "end"]
    assert clean.unwiki("a & b <x>") == "a &amp; b &lt;x&gt;"


def test_dump(spark, tmp_path):
    from lexmill.sources import dump

    page = "<page><title>{}</title><ns>{}</ns><revision><text>{}</text><sha1>{}</sha1></revision></page>"
    rows = [("A", 0, "'''Alpha''' [[beta]]", "s1"), ("B", 1, "talk", "s2"), ("C", 0, "", "s3"), ("D", 0, "#REDIRECT [[A]]", "s4"), ("E", 0, "same", "s1")]
    xml = "<mediawiki>\n" + "\n".join(page.format(*r) for r in rows) + "\n</mediawiki>"
    path = tmp_path / "dump.xml.bz2"
    path.write_bytes(bz2.compress(xml.encode()))
    assert dump.pages(spark, str(path)).count() == 5
    got = dump.articles(spark, str(path)).collect()
    assert len(got) == 1 and got[0].doc == "s1" and got[0].text in ("Alpha beta", "same")
    assert dump.articles(spark, str(path), skip=4).collect()[0].title == "E"
