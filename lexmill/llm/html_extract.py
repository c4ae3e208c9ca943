"""HTML extraction by union-free regular-expression inference.

Pages of one host are read as token streams. The stream's balanced tags nest it into groups; texts
are slots, and inline markup belongs to its slot. Streams of a host are aligned one after another:
a group that one side lacks becomes optional, neighbours of equal label (or equal sequences of
labels) become one repeated group, equal texts stay literal, differing texts become slots. The
result is the host's wrapper, a regular expression without unions, such as
`nav? div.ad article(h1(#) p(#)+) footer?`. Every group and slot of it carries what the host's pages
have there: pages, characters, characters inside links, and the text if it is one for all.

The wrapper decides what is read, and a page's text is read by matching the page against its host's
wrapper. The main group is the one that holds the host's varying text outside links; groups outside
it, link lists, and literal slots (one text on TEMPLATE_PAGES different pages or more) are template.
Tag and class names such as nav, footer or comments are evidence for a group with a minor share of
its parent's text; a group with nearly all of it, and paragraphs or headings inside, is read
whatever its name. Within repeated groups single texts may be the template's, too: those that every
page of the host with that slot has there. A page that has nothing else keeps its literal texts; a
page that lacks the main group is read by its own expression.

Each task aligns its pages by host first, then the tasks' expressions are merged in groups of about
MERGE, as often as needed: no task ever holds a host's pages. The html is parsed twice.

Defined results: a null or empty html, or a page without a main group, has empty text; a null URL
or one without a host belongs to host ''; repeated rows are read alike and count as one page for
what is literal; an empty table gives no rows; a null page_id stays null; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, materialise
from .url_filter import split_url

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source".split()
)
#: Never text: what isn't shown, and controls.
UNSEEN = frozenset(
    "script style noscript iframe template textarea title head object embed svg canvas audio video "
    "select option button input noembed noframes".split()
)
INVISIBLE = frozenset("script style template noscript".split())  # they end no block
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p pre blockquote".split())
DEEPEST = 150  # as browsers do, deeper tags nest no further; their content stays in the page
IGNORED = frozenset(("html", "body"))  # often left out; their content is the stream's top
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_CLOSES |= {"option": {"option"}, "thead": {"tr", "td", "th", "thead"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_STOP = frozenset("ul ol dl table article section div body".split())
_OPEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_TAG_STOP = re.compile("[>\"']")
_NAME = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: Names that tell what a group may be. LEFT_OUT is never an article; ASIDE may hold one.
_LEFT_OUT_TAGS, _ASIDE_TAGS = frozenset("nav footer aside".split()), frozenset("form fieldset menu dialog header".split())
_LEFT_OUT = re.compile(r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent\w*|comments?|commentlist|respond|replies|disqus\w*")
_ASIDE = re.compile(
    r"banner\w*|notices?|alerts?|sidebar\w*|side|rail|widgets?|nav\w*|menus?|breadcrumbs?|header|masthead|footer|foot|copyright|legal|"
    r"discussion|share\w*|sharing|social\w*|related\w*|recommended|newsletter\w*|subscribe\w*|signup|login|popup|modal|overlay|"
    r"pagination|pager|toolbar|search\w*|contentinfo|navigation|complementary|form"
)
NEARLY_ALL = 0.9  # share of its parent's text at which a group is read whatever its name
MUCH = 0.3  # the same where only a part of a name tells
MAIN_SHARE = 0.1  # of all text: what a group named article or main needs
DOMINANT = 0.8  # of its parent's text: what any other group needs to be the main group


class Node:
    __slots__ = ("tag", "names", "kids")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names, self.kids = tag, names, []

    @property
    def label(self) -> str:
        return self.tag + "".join("." + x for x in sorted(set(self.names.split())) if not any(c.isdigit() for c in x))


class _Scanner:
    """Where tags end. A '>' inside quotes doesn't end one, but quotes that never close are plain
    signs: what has been looked for in vain once isn't looked for again, so a scan is linear."""

    def __init__(self, html: str):
        self.html, self.last, self.plain = html, html.rfind(">"), False
        self.quote = {q: html.rfind(q) for q in "\"'"}

    def tag_end(self, start: int) -> int:
        """The place of the '>' of the tag whose name ends at start; -1 if there is none."""
        if self.last < start:
            return -1
        at = start
        while not self.plain:
            m = _TAG_STOP.search(self.html, at)
            if m is None:
                self.plain = True
            elif m[0] == ">":
                return m.start()
            elif self.quote[m[0]] > m.start():
                at = self.html.find(m[0], m.end()) + 1
            else:
                at = m.end()
        return self.html.find(">", start)


def parse(html: str) -> Node:
    """The nested token stream: nodes and texts under a nameless top."""
    top = Node("")
    stack = [top]
    at, n = 0, len(html)
    scan = _Scanner(html)

    def after(mark: str, start: int) -> int:
        end = html.find(mark, start)
        return n if end < 0 else end + len(mark)

    while at < n:
        m = _OPEN.search(html, at)
        if m is None:
            stack[-1].kids.append(html[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        if not m[2]:
            mark = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            at = after(mark, m.end())
            continue
        end = scan.tag_end(m.end())
        if end < 0:  # no tag ends any more: the rest is text
            stack[-1].kids.append(html[m.start() :])
            break
        attributes, at = html[m.end() : end], end + 1
        tag = m[2].lower()
        if tag in IGNORED:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break  # a stray end tag of inline markup closes no block
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in _CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _CLOSES[tag]:
                    del stack[k:]
                elif stack[k].tag in _STOP:
                    break
        names = " ".join(next(x for x in a[1:] if x) for a in _NAME.findall(attributes) if any(a[1:])) if attributes else ""
        if len(stack) == DEEPEST and tag not in RAW and tag not in VOID:
            tag = "span" if tag in INLINE else "div"
        node = Node(tag, names)
        stack[-1].kids.append(node)
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            node.kids.append(html[at : closing.start() if closing else n])
            at = closing.end() if closing else n
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            if len(stack) < DEEPEST:
                stack.append(node)
    return top


# --- expressions ---


class Item:
    """A group, or a slot (label #), of an expression, with what the pages have there.

    quant: '', '?', '+' or '*'; pages: how many have it; seen: a bit for each by a hash of its html, so
    that repeated pages count once; chars, links: characters of its own text, of these inside links;
    key: hash of the text where it is one for all, else 0; runs: a page's own texts, by number."""

    __slots__ = ("label", "quant", "kids", "pages", "seen", "chars", "links", "key", "runs", "mark", "mass", "total", "linked")

    def __init__(self, label, quant="", kids=(), pages=1, seen=0, chars=0, links=0, key=0, runs=()):
        self.label, self.quant, self.kids, self.pages, self.seen = label, quant, list(kids), pages, seen
        self.chars, self.links, self.key, self.runs, self.mark = chars, links, key, list(runs), False

    @property
    def tag(self) -> str:
        return self.label.split(".", 1)[0]

    @property
    def literal(self) -> bool:
        return self.label == "#" and self.key != 0 and self.seen.bit_count() >= TEMPLATE_PAGES

    def packed(self) -> list:
        return [self.label, self.quant, self.pages, self.seen, self.chars, self.links, self.key, [x.packed() for x in self.kids]]

    @classmethod
    def unpacked(cls, x: list) -> Item:
        return cls(x[0], x[1], [cls.unpacked(k) for k in x[7]], *x[2:7])


def dump(items: list[Item]) -> str:
    return json.dumps([x.packed() for x in items], separators=(",", ":"))


def load(text: str) -> list[Item]:
    return [Item.unpacked(x) for x in json.loads(text)]


def wrapper_text(items: list[Item]) -> str:
    return " ".join(("" if x.label.startswith("~") else x.label) + (f"({wrapper_text(x.kids)})" if x.kids else "") + x.quant for x in items)


def _loosest(a: str, b: str) -> str:
    many, maybe = a in ("+", "*") or b in ("+", "*"), a in ("?", "*") or b in ("?", "*")
    return ("*" if maybe else "+") if many else ("?" if maybe else "")


def _merge(a: Item, b: Item, one_page: bool, quant: str) -> Item:
    """What covers both; one_page: both are of the same page."""
    kids = [_merge(x, y, one_page, _loosest(x.quant, y.quant)) for x, y in zip(a.kids, b.kids)] if a.label.startswith("~") else align(a.kids, b.kids, one_page)
    pages = max(a.pages, b.pages) if one_page else a.pages + b.pages
    key = a.key if a.key == b.key else 0
    return Item(a.label, quant, kids, pages, a.seen | b.seen, a.chars + b.chars, a.links + b.links, key, a.runs + b.runs)


def _repeat(a: Item, b: Item) -> Item:
    return _merge(a, b, True, "+" if a.quant in ("", "+") or b.quant in ("", "+") else "*")


def _group(items: list[Item]) -> Item:
    seen = 0
    for x in items:
        seen |= x.seen
    return Item("~" + " ".join(x.label for x in items), "", items, max(x.pages for x in items), seen)


def _labels(items: list[Item]) -> list[str]:
    return [x.label for x in items]


def _fold(items: list[Item]) -> list[Item]:
    """Neighbours of equal label become one repeated group, and so do neighbouring equal sequences
    of two to four labels."""
    out: list[Item] = []
    for x in items:
        if out and out[-1].label == x.label:
            out[-1] = _repeat(out[-1], x)
        else:
            out.append(x)
    for period in (2, 3, 4):
        if len(out) < 2 * period:
            break
        i, folded, labels = 0, [], _labels(out)
        while i < len(out):
            want, j = labels[i : i + period], i + period
            if len(want) == period and labels[j : j + period] == want:
                group = _group(out[i:j])
                while labels[j : j + period] == want:
                    group = _repeat(group, _group(out[j : j + period]))
                    j += period
                folded.append(group)
                i = j
            else:
                folded.append(out[i])
                i += 1
        out = folded
    return out


def _grouped(items: list[Item], others: list[Item]) -> list[Item]:
    """items, with the sequences that are repeated groups in others grouped, too."""
    for g in others:
        if g.label.startswith("~"):
            want, out, i = _labels(g.kids), [], 0
            while i < len(items):
                if _labels(items[i : i + len(want)]) == want:
                    out.append(_group(items[i : i + len(want)]))
                    i += len(want)
                else:
                    out.append(items[i])
                    i += 1
            items = out
    return items


def pairing(a: list[Item], b: list[Item]) -> Iterator[tuple[Item | None, Item | None]]:
    """Both lists in order, paired along a longest common subsequence of labels."""
    x, y = _labels(a), _labels(b)
    if x == y:
        yield from zip(a, b)
        return
    i = 0
    while i < min(len(a), len(b)) and x[i] == y[i]:  # the common ends need no table
        yield a[i], b[i]
        i += 1
    tail = 0
    while tail < min(len(a), len(b)) - i and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    a_mid, b_mid = a[i : len(a) - tail], b[i : len(b) - tail]
    n, m = len(a_mid), len(b_mid)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for p in range(n - 1, -1, -1):
        for q in range(m - 1, -1, -1):
            best[p][q] = best[p + 1][q + 1] + 1 if a_mid[p].label == b_mid[q].label else max(best[p + 1][q], best[p][q + 1])
    p = q = 0
    while p < n or q < m:
        if p < n and q < m and a_mid[p].label == b_mid[q].label:
            yield a_mid[p], b_mid[q]
            p, q = p + 1, q + 1
        elif q == m or p < n and best[p + 1][q] >= best[p][q + 1]:
            yield a_mid[p], None
            p += 1
        else:
            yield None, b_mid[q]
            q += 1
    if tail:
        yield from zip(a[len(a) - tail :], b[len(b) - tail :])


def align(a: list[Item], b: list[Item], one_page: bool = False) -> list[Item]:
    """The union-free expression that covers both: a longest common subsequence of labels is
    merged, and what only one side has becomes optional."""
    if _labels(a) != _labels(b):
        a, b = _grouped(a, b), _grouped(b, a)
    out, alike = [], True
    for x, y in pairing(a, b):
        if x is not None and y is not None:
            out.append(_merge(x, y, one_page, _loosest(x.quant, y.quant)))
        else:
            one, alike = x or y, False
            out.append(Item(one.label, _loosest(one.quant, "?"), one.kids, one.pages, one.seen, one.chars, one.links, one.key, one.runs))
    return out if alike else _fold(out)


# --- a page's own expression ---


class Page:
    """A page's expression, and its texts (runs) in page order with the paths of their slots."""

    def __init__(self, html: str | None):
        self.texts: list[str] = []
        self.paths: list[str] = []
        html = html or ""
        self.bit = 1 << (text_key(html) & 63)
        self.items = self._layout(parse(html), "", False)

    def _layout(self, node: Node, path: str, link: bool) -> list[Item]:
        items: list[Item] = []
        run: list[str] = []
        linked = 0

        def end() -> None:
            nonlocal linked
            if run:
                text = " ".join(unescape("".join(run)).split())
                if text:
                    items.append(Item("#", "", (), 1, self.bit, len(text), min(linked, len(text)), text_key(text) or 1, (len(self.texts),)))
                    self.texts.append(text)
                    self.paths.append(path)
                run.clear()
            linked = 0

        def walk(node: Node, link: bool) -> None:
            nonlocal linked
            for kid in node.kids:
                if isinstance(kid, str):
                    run.append(kid)
                    if link:
                        linked += len(kid.strip())
                elif kid.tag in UNSEEN:
                    if kid.tag not in INVISIBLE:
                        end()
                elif kid.tag in ("br", "wbr"):
                    run.append(" " if kid.tag == "br" else "")
                elif kid.tag in INLINE:
                    walk(kid, link or kid.tag == "a")
                else:
                    end()
                    label = kid.label
                    inner = self._layout(kid, f"{path}>{label}", link and kid.tag not in HEADINGS)
                    if inner:
                        items.append(Item(label, "", inner, 1, self.bit))

        walk(node, link)
        end()
        if node.tag in HEADINGS:  # a title may link to its own page
            for x in items:
                x.links = 0
        return _fold(items)

    def text(self, wrapper: list[Item] | None, constant: frozenset[int]) -> str:
        """The texts of the wrapper's marked groups. wrapper: with marks, from marked()."""
        found = self._read(wrapper, constant) if wrapper is not None else None
        if not found:
            found = self._read(marked(self.items), constant)
        return "\n".join(found)

    def _read(self, wrapper: list[Item], constant: frozenset[int]) -> list[str]:
        state = [0] * len(self.texts)  # 0 left out, 1 literal, 2 read
        match(wrapper, self.items, state)
        if constant:
            for i, s in enumerate(state):
                if s == 2 and slot_key(self.paths[i], text_key(self.texts[i])) in constant:
                    state[i] = 1
        most = max(state, default=0)
        return [t for t, s in zip(self.texts, state) if s == most] if most else []


def text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def slot_key(path: str, key: int) -> int:
    """A text at a slot, or the slot itself (key 0), as a signed 64-bit number."""
    h = xxhash.xxh64_intdigest(path.encode("utf-8", "surrogatepass"), seed=key & 0xFFFFFFFF) ^ key
    return h - (1 << 64) if h >> 63 else h


# --- what a wrapper says of its groups ---


def weigh(items: list[Item]) -> None:
    """total, linked and mass (characters that vary and are in no link) of every group."""
    for x in items:
        weigh(x.kids)
        x.total = x.chars + sum(k.total for k in x.kids)
        x.linked = x.links + sum(k.linked for k in x.kids)
        x.mass = (0 if x.literal else x.chars - x.links) + sum(k.mass for k in x.kids)


def _holds(item: Item, tags: frozenset[str]) -> bool:
    return any(k.tag in tags or _holds(k, tags) for k in item.kids)


def hint(item: Item) -> tuple[int, bool]:
    """(2, 1 or 0: told by a whole name, by a part of one, or by none to be no article; whether it may
    hold the article all the same)."""
    tag, *names = item.label.split(".")
    if tag == "#" or item.label.startswith("~"):
        return 0, True
    if tag in _LEFT_OUT_TAGS:
        return 2, False
    strength = 2 if tag in _ASIDE_TAGS and not (tag == "header" and _holds(item, HEADINGS)) else 0
    for name in names:
        name = name.lower()
        if _LEFT_OUT.fullmatch(name):
            return 2, False
        if _ASIDE.fullmatch(name):
            strength = max(strength, 0 if name in ("header", "masthead") and _holds(item, HEADINGS) else 2)
        elif any(_LEFT_OUT.fullmatch(x) or _ASIDE.fullmatch(x) and not (x == "header" and _holds(item, HEADINGS)) for x in re.split("[-_]", name)):
            strength = max(strength, 1)
    return (min(strength, 1) if tag in ("article", "main") else strength), True


def left_out(item: Item, of: int) -> bool:
    """Whether a group is template by its links or names, where its parent's groups have `of`
    characters of varying text."""
    if item.label == "#":
        return False
    share = item.mass / of if of else 0.0
    body = _holds(item, PARAGRAPHS)
    if 2 * item.linked > item.total and not (share >= NEARLY_ALL and body):
        return True
    strength, may_hold = hint(item)
    if strength == 2:
        return not (may_hold and body and share >= NEARLY_ALL)
    return strength == 1 and not share >= MUCH


def _kept(items: list[Item]) -> list[Item]:
    """The groups that aren't template. Names that never stand for an article go first, so that they
    don't count in what the others' shares are of."""
    rest = [x for x in items if hint(x) != (2, False)]
    of = sum(x.mass for x in rest)
    return [x for x in rest if not left_out(x, of)]


def main_group(items: list[Item]) -> list[Item]:
    """The main group's own items: of the group named article, else main, that varies most; else,
    from the top down, of the group with nearly all varying text beside which no paragraph stands."""
    named: dict[str, list[Item]] = {"article": [], "main": []}

    def look(items: list[Item]) -> int:
        total = 0
        for x in _kept(items):
            if x.tag in named:
                named[x.tag].append(x)
            total += max(look(x.kids), x.mass)
        return total

    whole = look(items)
    for tag in ("article", "main"):
        if named[tag] and (best := max(named[tag], key=lambda x: (x.mass, x.total))).mass >= MAIN_SHARE * whole:
            return best.kids
    while True:
        kept = _kept(items)
        groups = [x for x in kept if x.kids and x.tag not in PARAGRAPHS]
        if not groups or any(x.mass for x in kept if x.tag in PARAGRAPHS or x.label == "#"):
            return items
        best = max(groups, key=lambda x: x.mass)
        if best.mass < DOMINANT * sum(x.mass for x in kept) or all(k.label == "#" for k in best.kids):
            return items
        items = best.kids


def marked(items: list[Item]) -> list[Item]:
    """The expression with marks on the groups and slots of its main group that are to be read."""
    weigh(items)

    def clear(items: list[Item]) -> None:
        for x in items:
            x.mark = False
            clear(x.kids)

    def mark(items: list[Item]) -> None:
        for x in _kept(items):
            x.mark = True
            mark(x.kids)

    def to(items: list[Item], main: list[Item]) -> bool:
        """Mark the way to the main group."""
        for x in items:
            if x.kids is main or to(x.kids, main):
                x.mark = True
                return True
        return False

    clear(items)
    main = main_group(items)
    mark(main)
    to(items, main)
    return items


def match(wrapper: list[Item], page: list[Item], state: list[int]) -> None:
    """Set the state of a page's texts by the wrapper's groups that they fall in."""
    if _labels(wrapper) != _labels(page):
        wrapper, page = _grouped(wrapper, page), _grouped(page, wrapper)
    for w, p in pairing(wrapper, page):
        if w is None or p is None or not (w.mark or w.label.startswith("~")):
            continue
        for r in p.runs:
            state[r] = 1 if w.literal else 2
        match(w.kids, p.kids, state)


# --- over a table ---

WRAPPER_BYTES = 16 << 20  # wrappers that may be sent to every task; beyond, they are joined
TEMPLATE_PAGES = 4  # different pages that show a text to be the template's; one or two may be near copies
MERGE = 64  # expressions of a host that one task merges
HOT_SHARE = 64  # a host with more than one in so many pages is spread when wrappers are joined
_ENTRIES = 100_000

_SEEN = "host string, kind string, slot long, key long, n long, seen long, wrapper string"


def observations(pages: DataFrame) -> DataFrame:
    """What each task sees: for every host an expression of its pages there (kind w, n pages), and
    for slots and the texts in them how many pages have them (kind t; key 0 is the slot itself)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole: dict[str, tuple[list[Item], int]] = {}
        sums: dict[tuple[str, int, int], list[int]] = {}

        def flush() -> Iterator[pd.DataFrame]:
            cols = ["host", "kind", "slot", "key", "n", "seen", "wrapper"]
            rows = [(h, "t", s, k, n, seen - (1 << 64) * (seen >> 63), None) for (h, s, k), (n, seen) in sums.items()]
            rows += [(h, "w", 0, 0, n, 0, dump(items)) for h, (items, n) in whole.items()]
            sums.clear()
            whole.clear()
            if rows:
                yield pd.DataFrame(rows, columns=cols)

        for pdf in batches(it):
            for url, html in zip(pdf["url"].array, pdf["html"].array):
                host, page = split_url(url)[0], Page(html)
                found = {(slot_key(p, 0), slot_key(p, text_key(t))) for p, t in zip(page.paths, page.texts)}
                for slot, key in found | {(s, 0) for s, _ in found}:
                    v = sums.setdefault((host, slot, key), [0, 0])
                    v[0] += 1
                    v[1] |= page.bit
                items, n = whole.get(host, (None, 0))
                whole[host] = page.items if items is None else align(items, page.items), n + 1
            if len(sums) + 100 * len(whole) > _ENTRIES:
                yield from flush()
        yield from flush()

    rows = pages.select(F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInPandas(run, _SEEN)


def _fold_wrappers(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n", "wrapper"], ascending=[False, True])
    whole: list[Item] | None = None
    for text in pdf["wrapper"]:
        whole = load(text) if whole is None else align(whole, load(text))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "n": [int(pdf["n"].sum())], "wrapper": [dump(whole or [])]})


def wrappers(seen: DataFrame) -> DataFrame:
    """host, n (pages), wrapper: one row a host, merged in groups of about MERGE expressions."""
    parts = seen.filter("kind = 'w'").select("host", "n", "wrapper")
    while True:
        most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return parts
        salts = -(-most // MERGE)
        salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper", "n"), F.lit(salts)))
        parts = materialise(salted.groupBy("host", "salt").applyInPandas(lambda pdf: _fold_wrappers(pdf), "host string, n long, wrapper string"), "wrappers")


def constants(seen: DataFrame) -> DataFrame:
    """host, constant: the keys of the texts that every page with their slot has there."""
    each = seen.filter("kind = 't'").groupBy("host", "slot", "key").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("seen")).alias("pages"))
    each = each.filter(F.col("pages") >= TEMPLATE_PAGES)
    # What a slot has on all its pages is as frequent as the slot.
    whole = each.groupBy("host", "slot").agg(F.max("n").alias("most"), F.collect_list(F.struct("key", "n")).alias("texts"))
    text = whole.select("host", F.explode(F.filter("texts", lambda x: (x["n"] == F.col("most")) & (x["key"] != 0))).alias("text"))
    return text.groupBy("host").agg(F.collect_list("text.key").alias("constant"))


def learned(pages: DataFrame) -> DataFrame:
    """host, n, wrapper, constant: one row a host."""
    seen = materialise(observations(pages), "observations")
    return materialise(wrappers(seen).join(constants(seen), "host", "left"), "learned")


class _Reader:
    """Reads pages, with the wrappers of the hosts met last at hand."""

    def __init__(self) -> None:
        self.hosts: dict[str, tuple[list[Item], frozenset[int]]] = {}

    def __call__(self, host: str, html: str | None, wrapper: str | None, constant) -> str:
        if not html:
            return ""
        if host not in self.hosts:
            if len(self.hosts) > 2000:
                self.hosts.clear()
            items = marked(load(wrapper)) if isinstance(wrapper, str) else None
            self.hosts[host] = items, frozenset(() if constant is None else (int(c) for c in constant))
        return Page(html).text(*self.hosts[host])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row a page."""
    known = learned(pages)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    size = known.agg(F.sum(F.length("wrapper") + 8 * F.greatest(F.size("constant"), F.lit(0))), F.sum("n")).first()
    by_host = None
    if (size[0] or 0) <= WRAPPER_BYTES:
        by_host = {r["host"]: (r["wrapper"], r["constant"]) for r in known.collect()}
    else:
        rows = _with_wrappers(rows, known, size[1])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = _Reader()
        for pdf in batches(it):
            hosts = [split_url(u)[0] for u in pdf["url"].array]
            held = [by_host.get(h, (None, None)) for h in hosts] if by_host is not None else zip(pdf["wrapper"].array, pdf["constant"].array)
            texts = [read(h, html, *w) for h, html, w in zip(hosts, pdf["html"].array, held)]
            yield pd.DataFrame(
                {"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]}
            )

    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def _with_wrappers(rows: DataFrame, known: DataFrame, n_pages: int) -> DataFrame:
    """rows joined with their host's wrapper. Hosts with more than one in HOT_SHARE pages, of which
    there are HOT_SHARE at most, are spread over HOT_SHARE salts."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, lower)
    hot = [r["host"] for r in known.filter(F.col("n") * HOT_SHARE > n_pages).select("host").collect()]
    salt = F.when(F.col("host").isin(hot), F.pmod(F.xxhash64("page_id", "url"), F.lit(HOT_SHARE)).cast("int")).otherwise(0)
    salts = F.when(F.col("host").isin(hot), F.sequence(F.lit(0), F.lit(HOT_SHARE - 1))).otherwise(F.array(F.lit(0)))
    held = known.select("host", "wrapper", "constant", F.explode(salts).alias("salt"))
    return rows.withColumn("host", host).withColumn("salt", salt).join(held, ["host", "salt"], "left").select("page_id", "url", "html", "wrapper", "constant")
