import base64
import hashlib
import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import chat as C
from lexmill.llm import html_extract as H
from lexmill.llm import url_filter as U
from lexmill.llm import warc as W

PAGES = [
    (1, "http://a.example.com/en/1", "<html><body><nav><a href='/x'>Menu</a></nav><article><h1>T &amp; t</h1><p>One\n two<p>three<br>four</article><footer>f</footer></body></html>"),
    (2, "http://a.example.com/en/2", "<nav>Menu</nav><div class=ad>Buy</div><article><h1>U</h1><p>five</p><div class='comments'><p>no</p></div></article>"),
    (3, None, None),
    (4, "no host", ""),
    (5, "https://b.example.org/x?y", "<div id=main><p>alone</p></div>"),
    (2, "http://a.example.com/en/2", "<nav>Menu</nav><div class=ad>Buy</div><article><h1>U</h1><p>five</p><div class='comments'><p>no</p></div></article>"),
    (None, "http://a.example.com", "<article>" + "<p>long text</p>" * 20_000 + "</article>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*r, "x", "y", "z") for r in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string, text string").repartition(2)


def test_main_text(pages):
    rows = H.extract(pages).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(PAGES)
    assert got[1] == "T & t\nOne two\nthree four" and got[2] == "U\nfive" and got[3] == got[4] == "" and got[5] == "alone"
    assert got[None].count("long text") == 20_000
    assert all(r.n_chars == len(r.text) for r in rows)


def test_main_text_by_join(pages, monkeypatch):
    whole = sorted((r.page_id or 0, r.text) for r in H.extract(pages).collect())
    monkeypatch.setattr(H, "WRAPPER_BYTES", 1)
    monkeypatch.setattr(H, "HOT_SHARE", 3)
    assert sorted((r.page_id or 0, r.text) for r in H.extract(pages).collect()) == whole


@pytest.mark.parametrize("by_join", [False, True])
def test_constant_texts_are_the_templates(spark, monkeypatch, by_join):
    """A text on every page of a host is left out, in a class of any name; on few pages, or only some, it stays."""
    page = "<article><div class=box>Read our terms</div><h1>Title {0}</h1><p>own {0}</p>{1}<p>Thank you.</p></article>"
    rows = [(k, f"http://t.org/{k}", page.format(k, "<p>some</p>" if k % 2 else "")) for k in range(80)]
    rows += [(100 + k, f"http://few.org/{k}", page.format(k % 2, "")) for k in range(9)]
    rows += [(200 + k, f"http://same.org/{k}", f"<article><p>all alike</p></article><!--{k}-->") for k in range(30)]
    if by_join:
        monkeypatch.setattr(H, "WRAPPER_BYTES", 1)
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Title {k}\nown {k}" + "\nsome" * (k % 2) for k in range(80))
    assert all(got[100 + k] == f"Read our terms\nTitle {k % 2}\nown {k % 2}\nThank you." for k in range(9))
    assert all(got[200 + k] == "all alike" for k in range(30))


def test_empty_pages(pages):
    none = pages.limit(0)
    assert H.extract(none).isEmpty() and U.url_filter(none).isEmpty() and W.derivatives(W.from_pages(none)).isEmpty()


def own(html):
    """A page's text by its own expression."""
    return H.Page(html).text(None, frozenset())


def test_wrappers_cover_their_pages():
    w = lambda h: H.wrapper_text(H.Page(h).items)
    assert w("<article><h1>a</h1><p>b<p>c</article>") == "article(h1(#) p(#)+)"
    a = H.Page("<article><h1>a</h1><p>b<p>c</article><footer>x</footer>").items
    b = H.Page("<nav>m</nav><article><h1>a</h1><h2>s</h2><p>b</article>").items
    both = H.align(a, b)
    assert H.wrapper_text(both) == H.wrapper_text(H.align(both, a)) == "nav? article(h1(#) h2(#)? p(#)+) footer(#)?".replace("nav?", "nav(#)?")
    title = both[1].kids[0].kids[0]
    assert title.pages == 2 and title.key == H.text_key("a") and both[1].kids[2].kids[0].key == 0
    assert H.dump(H.load(H.dump(both))) == H.dump(both)
    assert w("<div>" + "<h2>a</h2><p>b</p>" * 30 + "</div>") == "div(~h2 p(h2(#) p(#))+)".replace("~h2 p", "")


def covers(expression, items):
    """Whether an expression derives a page's own one, by trying every way."""
    if not expression:
        return not items
    x, rest = expression[0], expression[1:]
    if x.quant in ("?", "*") and covers(rest, items):
        return True
    if not items or items[0].label != x.label or (items[0].quant in ("+", "*") and x.quant not in ("+", "*")):
        return False
    if not (x.label == "#" or covers(x.kids, items[0].kids)):
        return False
    return covers(rest, items[1:]) or (x.quant in ("+", "*") and covers(expression, items[1:]))


def test_a_hosts_expression_derives_each_of_its_pages():
    rng = random.Random(1)
    htmls = []
    for k in range(60):
        parts = [f"<div class=top>{'<p>a</p>' * rng.randint(0, 2)}x</div>"] * rng.randint(0, 1)
        parts += [f"<h1>t{k}</h1>"] + [f"<p>b{rng.random()}</p>"] * rng.randint(1, 4) + ["<ul><li>1</li><li>2</li></ul>"] * rng.randint(0, 1) + ["<pre>c</pre>"] * rng.randint(0, 2)
        htmls.append("".join(parts))
    pages = [H.Page(h).items for h in htmls]
    whole = pages[0]
    for p in pages[1:]:
        whole = H.align(whole, p)
    assert all(covers(whole, H.Page(h).items) for h in htmls)
    assert not covers(whole, H.Page("<table><tr><td>x</table>").items)


def built_site(rng, n):
    """(url, html, text): pages without telling names, whose template only their host's other pages show."""
    out = []
    for k in range(n):
        say = lambda: " ".join(rng.choice(WORDS) + str(rng.randrange(900)) for _ in range(rng.randint(5, 30)))  # noqa: E731,B023
        title, body = f"Title {k}", [say() for _ in range(rng.randint(1, 6))]
        links = "".join(f"<li><a href=/{j}>{rng.choice(WORDS)} {j}</a></li>" for j in range(rng.randint(3, 9)))
        extra = f"<div class=xc><ul>{links}</ul></div>" if rng.random() < 0.5 else ""
        parts = f"<h2>{title}</h2>" + "<div class=xe>Subscribe now</div>" + "".join(f"<p>{b}</p>" for b in body) + extra
        html = f"<div class=xa>Our shop is open all day long and on Sundays</div><div><div class=xb>{parts}</div></div><div class=xd>All rights kept</div>"
        out.append((f"http://plain.org/{k}", html, "\n".join([title, *body])))
    return out


WORDS = "river lamp stone garden paper window".split()


def test_text_comes_through_the_wrapper(spark, monkeypatch):
    site = built_site(random.Random(8), 60)
    rows = [(k, u, h) for k, (u, h, _) in enumerate(site)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert got == {k: t for k, (_, _, t) in enumerate(site)}
    monkeypatch.setattr(H, "MERGE", 2)
    assert {r.page_id: r.text for r in H.extract(df).collect()} == got
    # Without alignment, a page tells nothing of its template.
    alone = [own(h) for _, h, _ in site]
    assert all(a != t for a, (_, _, t) in zip(alone, site))
    literal = [H.Page(h).items for _, h, _ in site]
    whole = literal[0]
    for p in literal[1:]:
        whole = H.align(whole, p)
    assert [x.kids[0].literal for x in whole if x.label in ("div.xa", "div.xd")] == [True, True]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<form id=aspnetForm><nav><a href=x>m</a></nav><div><h1>T</h1><p>a whole page</p></div></form>", "T\na whole page"),
        ('<div class="main with-sidebar"><p>running text</p></div>', "running text"),
        ('<div class="article social-science"><h1>T</h1><p>text</p></div><div class=ad>buy</div>', "T\ntext"),
        ("<article><header><h1>Title</h1></header><p>text</p></article>", "Title\ntext"),
        ('<article><p>one <b class="side">two</b> three</p></article>', "one two three"),
        ("<article></article><div class=ad>buy</div><footer>f</footer>", ""),
        ("<article><h1><a href=/x>Linked title</a></h1><p>text</p></article>", "Linked title\ntext"),
        ("<article><p>text</p><div class=comments><article><p>first! and more than the text has</p></article></div></article>", "text"),
        ("<article><p>text</p><form><label>Mail</label><input></form><ul class=related-links><li><a href=x>other</a></ul></article>", "text"),
    ],
)
def test_names_are_evidence_only(html, want):
    assert own(html) == want


def test_broken_markup():
    for html in ("<", "<p", "a < b", "</div></p>", "<div>" * 5000 + "x", "<!-- open", "<script>x", "<a href='>'>t</a>", "&#xFFFFFFFF; &bogus;", None):
        assert isinstance(own(html), str)
    assert own("<article>a<script>var t='</p>';</script>b</article>") == "ab"
    assert own("<div>" * 5000 + "deep") == "deep"
    assert own("<p title='a>b'>x</p><p title=\"open>y</p>") == "x\ny"


@pytest.mark.parametrize("html", ['<a "' * 200_000, "<script>" * 100_000, "<" * 400_000, '<a href="x' * 90_000, "<!--" * 200_000, "<a 'x" * 200_000 + ">"])
def test_broken_markup_takes_linear_time(html):
    began = time.perf_counter()
    own(html)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://Sub.Example.COM/en/5?q=/x", ("sub.example.com", "/en/5", "com/en/", "block")),
        ("https://example.com/en/77#t", ("example.com", "/en/77", "example.com/en/7", "allow")),
        ("http://notexample.com/en/7", ("notexample.com", "/en/7", "com/en/", "block")),
        ("http://x.example.net/de/8", ("x.example.net", "/de/8", "example.net/de/8", "block")),
        ("http://x.example.net/de/9", ("x.example.net", "/de/9", "net/de/", "allow")),
        ("http://a.org/es", ("a.org", "/es", None, None)),
        ("http://h?x", ("h", "", None, None)),
        ("mailto:x", ("", "", None, None)),
        (None, ("", "", None, None)),
    ],
)
def test_rules(url, want):
    host, path = U.split_url(url)
    assert (host, path, *U.Rules(U.RULES).decide(host, path)) == want


def test_segmentation_is_the_likeliest_split():
    counts = {"cheap": 50, "pills": 30, "pill": 20, "heap": 5, "s": 1, "c": 1, "online": 9}
    seg = U.Segmenter(counts)
    assert seg.split("cheappillsonline") == ("cheap", "pills", "online") and seg.split("") == ()

    def splits(s):
        return [[]] if not s else [[s[:k], *r] for k in range(1, len(s) + 1) for r in splits(s[k:])]

    for name in ("cheappills", "heapspill", "xcheap"):
        cost = lambda ws: sum(seg.cost(w) for w in ws)
        assert abs(cost(seg.split(name)) - max(map(cost, splits(name)))) < 1e-9


def test_url_verdicts_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        tld, lang = rng.choice(["com", "net", "org", "info"]), rng.choice(["en", "de", "es"])
        rows.append((i, f"http://{rng.choice(['cheappills', 'goodbooks', 'www.casino', 'x.example'])}.{tld}/{lang}/{rng.randrange(99)}", "<p>cheap pills good books casino</p>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = {r.page_id: r for r in U.url_filter(pages).collect()}
    monkeypatch.setattr(U, "SENT", 1)  # all by joins
    again = {r.page_id: r for r in U.url_filter(pages).collect()}
    assert all((r.verdict, r.words, r.rule) == (again[i].verdict, again[i].words, again[i].rule) and abs(r.score - again[i].score) < 1e-9 for i, r in out.items())
    seg, rules = U.Segmenter({r.word: r.n for r in U.lexicon(pages).collect()}), U.Rules(U.RULES)
    assert seg.split("cheappills") == ("cheap", "pills")
    import math
    from collections import Counter

    count, classes = {"allow": Counter(), "block": Counter()}, Counter()
    seen = {i: (rules.decide(*U.split_url(u)), U.host_tokens(U.split_url(u)[0], seg) + U.path_tokens(U.split_url(u)[1])) for i, u, _ in rows}
    for (_, verdict), found in seen.values():
        if verdict:
            classes[verdict] += 1
            count[verdict].update(found)
    words = set(count["allow"]) | set(count["block"])
    for i, ((rule, verdict), found) in seen.items():
        score = {}
        for c in ("allow", "block"):
            total = sum(count[c].values()) + len(words)
            score[c] = math.log(classes[c] / sum(classes.values())) + sum(math.log((count[c][t] + 1) / total) for t in found if t in words)
        want = verdict or ("block" if score["block"] > score["allow"] else "allow")
        assert (out[i].rule, out[i].verdict) == (rule, want) and out[i].score == pytest.approx(score["block"] - score["allow"], abs=1e-9)


def test_rare_words_and_long_names_count(spark):
    """The lexicon has no cut: a word met once splits a name; a name too long for a host is one word."""
    html = "<script>if (a<b) x</script>" + " ".join(f"w{'abcdefghij'[k % 10]}{k}" for k in range(3000)) + " common " * 50 + "<style>p</style>zebrafish <!-- hidden"
    rows = [(1, "http://commonzebrafish.net/de/1", html), (2, "http://" + "a" * 5000 + ".com/en/", None), (3, "http://x/" + "longpath/" * 3000, "")]
    got = {r.page_id: r.words for r in U.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "common zebrafish net" and got[2].split()[0] == "a" * 5000
    assert U.visible("<" * 100_000 + "<script>" * 1000).strip("< ") == ""


def test_urls_over_odd_pages(pages):
    rows = U.url_filter(pages).collect()
    assert len(rows) == len(PAGES) and all(r.verdict in ("allow", "block") for r in rows)
    assert [(r.host, r.path, r.rule) for r in rows if r.page_id in (3, 4)] == [("", "", None)] * 2


def test_warc_round_trip(spark, pages, tmp_path):
    made = W.from_pages(pages)
    W.to_files(made, str(tmp_path / "w"))
    back = W.responses(spark, str(tmp_path / "w"))
    cols = ["record_id", "refers_to", "target_uri", "block_digest", "source_block_digest", "source_payload_digest", "headers"]
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    assert key(W.derivatives(back)) == key(W.derivatives(made))
    rows = W.derivatives(made).collect()
    assert len(rows) == 2 * len(PAGES)
    assert len({r.record_id for r in rows}) == len(rows) and made.select("record_id").distinct().count() == len(PAGES)
    source = {r.record_id: r for r in made.collect()}
    for r in rows:
        s = source[r.refers_to]
        assert (r.target_uri, r.date, r.source_block_digest, r.source_payload_digest) == (s.target_uri, s.date, s.block_digest, s.payload_digest)
        assert r.block_digest == W.digest(bytes(r.block)) and r.content_length == len(r.block) and f"WARC-Refers-To: {s.record_id}" in r.headers
    text = {r.page_id: bytes(r.block).decode() for r in rows if r.record_type == "conversion"}
    assert text[1] == "Menu\nT & t\nOne two\nthree\nfour\nf" and text[3] == ""
    notes = {r.page_id: bytes(r.block).decode() for r in rows if r.record_type == "metadata"}
    assert "outlink: http://a.example.com/x\r\n" in notes[1] and "http-status: 200" in notes[1]


def test_warc_files_that_others_wrote():
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nTransfer-Encoding: chunked\r\n\r\n5\r\n<p>\xe9x\r\n4\r\n</p>\r\n0\r\n\r\n"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Target-URI: http://h/\r\nWARC-IP-Address: 1.2.3.4\r\nContent-Length: {len(http)}\r\n\r\n".encode()
    (r,) = W.read_records(head + http + b"\r\n\r\n" + b"WARC/1.0\r\nContent-Length: 99\r\n\r\ncut")
    meta, conv = W.derive(None, r[2], r[4], r[5], r[13], r[8], r[9])
    assert b"http-header: Transfer-Encoding: chunked" in meta[-1] and b"warc-header: WARC-IP-Address: 1.2.3.4" in W.derive(None, *(r[k] for k in (2, 4, 5, 13, 8, 9)), r[12])[0][-1]
    assert conv[-1].decode() == "éx" and conv[3] == "<urn:x>" and b"charset: latin-1" in meta[-1]
    image = W.derive(None, "<i>", "http://h/i", None, b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG", None, None)
    assert [x[1] for x in image] == ["metadata"]
    assert list(W.read_records(b"\x1f\x8bbroken")) == list(W.read_records(b"")) == []


def test_derivatives_equal_brute_force(spark):
    """From pages built of known parts: texts, links, titles and digests, counted by hand."""
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(40):
        words = [[rng.choice(WORDS) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 4))]
        links = [f"/{rng.randrange(5)}" for _ in range(rng.randint(0, 4))]
        html = f"<head><title>T {k}</title></head>" + "".join(f"<p>{' '.join(w)}</p>" for w in words) + "".join(f'<a href="{x}">l</a>' for x in links) + "<!--" + "x" * 5000 + "--><script>no</script>"
        rows.append((k, f"http://h.org/a/{k}", html))
        text = "\n".join([" ".join(w) for w in words] + (["l" * len(links)] if links else []))
        want[k] = text, f"T {k}", [f"http://h.org{x}" for x in dict.fromkeys(links)]
    made = W.from_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for r in W.derivatives(made).collect():
        text, title, links = want[r.page_id]
        block = bytes(r.block).decode()
        if r.record_type == "conversion":
            assert block == text and r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        else:
            lines = block.split("\r\n")
            assert f"title: {title}" in lines and [x[9:] for x in lines if x.startswith("outlink: ")] == links
            assert r.source_payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(rows[r.page_id][2].encode()).digest()).decode()
    late = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + b" " * 9000 + b"<meta charset=latin-1>\xe9"
    assert W.derive(None, "<i>", None, None, late, None, None)[1][-1].decode() == "é"


_TEXT = st.text(st.sampled_from(list("<|>/s[]INTSYturnexd \x1bce\né")), max_size=30)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|turn|>"]), _TEXT), max_size=5))
def test_chat_round_trip(turns):
    whole, spans = C.render(turns)
    assert C.parse(whole) == turns
    assert [C.unescape(whole[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert not any(c in C.escape(t) for _, t in turns for c in C.CONTROL)


@pytest.mark.parametrize(
    "record, layout, turns",
    [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "system": "s"}, "messages", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "id": 1}, "from/value", [("user", "a"), ("assistant", "b")]),
        ({"instruction": "do", "input": "", "output": "x"}, "instruction", [("user", "do"), ("assistant", "x")]),
        ({"instruction": "do", "output": None}, "instruction", [("user", "do"), ("assistant", "")]),
        ({"prompt": "p", "response": "r"}, "prompt/response", [("user", "p"), ("assistant", "r")]),
        ({"request": {"prompt": "p"}, "reply": {"text": "r"}}, "nested", [("user", "p"), ("assistant", "r")]),
        ({"unknown": 1}, None, []),
    ],
)
def test_layouts(record, layout, turns):
    known = C.registry()
    _, name, got, rest = C.canonical(json.dumps(record), known)
    assert got == turns and name == layout and (rest == []) == (layout is not None)
    assert C.canonical("not json", known) == C.canonical(None, known) == (None, None, [], [])


@pytest.mark.parametrize(
    "record, layout, turns, rest",
    [
        ({"messages": [{"role": "user", "content": "a", "name": "x"}, {"role": "model", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")], ["messages[].name"]),
        ({"question": "q", "answer": "a", "context": "c", "score": 3}, "question", [("user", "c"), ("user", "q"), ("assistant", "a")], ["score"]),
        ({"turns": [{"role": "human", "text": "a"}]}, "turn rows", [("human", "a")], []),
        ({"prompt": "p", "notes": {"deep": ["x"]}}, None, [], ["notes.deep[]", "prompt"]),
    ],
)
def test_no_text_goes_unseen(record, layout, turns, rest):
    assert C.canonical(json.dumps(record), C.registry())[1:] == (layout, turns, rest)


def test_canonical_turns(spark):
    df = spark.createDataFrame([(1, json.dumps({"prompt": "p", "completion": "c"})), (2, "[]"), (None, None)], "conv_id long, record string")
    got = {r.conv_id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in C.canonical_turns(df).collect()}
    assert got == {1: ("prompt/completion", [("user", "p"), ("assistant", "c")]), 2: (None, []), None: (None, [])}


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b </s>"), (1, 0, "user", "a"), (2, 0, "user", None), (2, 0, "user", None), (3, 0, None, "é" * 100_000), (None, 0, "assistant", "<|turn|>"), (1, 2, "assistant", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in C.digests(C.format_conversations(df)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out[1].turns_sha256 == sha("user\na\nassistant\nb </s>\nassistant\n\n") and out[1].loss_sha256 == sha("b </s>") and out[1].loss_chars == 6
    assert out[2].n_turns == 2 and out[2].turns_sha256 == sha("user\n\nuser\n\n") and out[3].loss_chars == 0
    assert out[None].loss_sha256 == sha("<|turn|>") and len(out) == 4
    assert C.digests(C.format_conversations(df.limit(0))).isEmpty()


@pytest.mark.parametrize("name", ["op4_chat", "op8_url_filter"])
def test_queries_equal_sql(spark, sf, name):
    import duckdb

    from lexmill.llm import queries as Q

    db = duckdb.connect()
    for table in ("conversations", "pages"):
        db.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want = db.sql(Q.oracle_sql()[name])
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, Q.queries()[name](spark, sf).select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)
