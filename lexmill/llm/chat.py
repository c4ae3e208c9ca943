"""Chat formatting by schema fingerprints.

A record's layout is the sorted list of its nested field paths (array elements as []); the hash of
that list picks a declarative mapping, which says where the turns are and which fields hold role
and text. A layout with more fields than a mapping names is taken by the mapping that covers most of
it, by the fingerprint of that part; what isn't mapped is listed, so no text goes unseen. Every mapping yields canonical turns (role, text); a template then marks each turn and
escapes control strings inside texts, reversibly, and a loss mask covers the assistants' texts.

A turn is written as `<|turn|>` role `<|text|>` text `<|end|>`. Inside roles and texts every control
string (this template's and those of other common templates) is broken up by an escape character
after its first character, and the escape character itself is escaped: unescape() restores the text.

Defined results: a null text or role is empty; texts of any length are kept whole; roles of a table of
turns stay as they stand, those of other layouts get their canonical names; an empty conversation table gives no rows; rows
with equal turn numbers are ordered by role, then text; repeated rows are repeated turns; rows with
a null conv_id form one conversation of id null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

ESCAPE = "\x1b"
CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"

Turn = tuple[str, str]


# --- schema fingerprints ---


def field_paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a JSON value, with its leaves' kinds; [] stands for any element."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items()), set())
    if isinstance(value, list):
        return set().union(*(field_paths(v, at + "[]") for v in value), {at + "[]"} if not value else set())
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns. turns: path of a list of turn objects, with the fields of
    role and text in each, or None; before and fields: (path, role) of single texts, in order, those
    of `before` optional. Other fields, which hold no text of a turn, are allowed by `optional`.
    rename: whether roles get their canonical names."""

    name: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    before: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    rename: bool = True

    def paths(self) -> set[str]:
        """All paths that this mapping names."""
        return set().union(*self.layouts())

    def layouts(self) -> list[set[str]]:
        """Every set of paths that this mapping covers."""
        need = {p for p, _ in self.fields if p not in self.optional}
        if self.turns is not None:
            need |= {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"}
        extra = [*self.optional, *(p for p, _ in self.before if p not in self.optional)]
        out = [need]
        for p in extra:
            out += [s | {p} for s in out]
        return out

    def apply(self, record: dict) -> list[Turn]:
        out: list[Turn] = []
        for path, role in self.before:
            if (v := _at(record, path)) not in (None, ""):
                out.append((role, _text(v)))
        for path, role in self.fields:
            v = _at(record, path)
            if v not in (None, "") or path not in self.optional:
                out.append((role, _text(v)))
        if self.turns is not None:
            for t in _at(record, self.turns) or []:
                role = _text(t.get(self.role))
                out.append((ROLES.get(role.lower(), role) if self.rename else role, _text(t.get(self.text))))
        return out


def _at(record: object, path: str) -> object:
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}

META = ("id", "source", "lang")

MAPPINGS = (
    Mapping("messages", turns="messages", before=(("system", "system"),), optional=META),
    Mapping("turn rows", turns="turns", text="text", before=(("system", "system"),), optional=META, rename=False),
    Mapping("from/value", turns="conversations", role="from", text="value", before=(("system", "system"),), optional=META),
    Mapping("dialogue", turns="dialogue", role="speaker", text="utterance", optional=META),
    Mapping("prompt/response", fields=(("prompt", "user"), ("response", "assistant")), before=(("system", "system"),), optional=META),
    Mapping("prompt/completion", fields=(("prompt", "user"), ("completion", "assistant")), optional=META),
    Mapping("instruction", fields=(("instruction", "user"), ("input", "user"), ("output", "assistant")), before=(("system", "system"),), optional=("input", *META)),
    Mapping("question", fields=(("context", "user"), ("question", "user"), ("answer", "assistant")), optional=("context", *META)),
    Mapping("nested", fields=(("request.prompt", "user"), ("reply.text", "assistant")), optional=META),
)


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    """Mapping of each fingerprint; the first mapping wins where two cover one layout."""
    out: dict[str, Mapping] = {}
    for m in mappings:
        for paths in m.layouts():
            out.setdefault(fingerprint(paths), m)
    return out


def chosen(paths: set[str], known: dict[str, Mapping]) -> tuple[Mapping | None, set[str]]:
    """(mapping, paths that it leaves out) of a layout: by its fingerprint or, where that is unknown,
    by the fingerprint of the part that a mapping names, the largest first."""
    exact = known.get(fingerprint(paths))
    if exact is not None:
        return exact, set()
    parts = [(m, paths & m.paths()) for m in dict.fromkeys(known.values())]
    for m, part in sorted(parts, key=lambda x: -len(x[1])):
        if known.get(fingerprint(part)) is m:
            return m, paths - part
    return None, paths


def canonical(line: str | None, known: dict[str, Mapping], layouts: dict | None = None) -> tuple[str | None, str | None, list[Turn], list[str]]:
    """(fingerprint, layout, turns, unmapped paths) of a JSON record; no layout and no turns where no
    mapping fits or it isn't JSON. layouts: what is known of fingerprints that were met before."""
    try:
        record = json.loads(line) if line else None
    except ValueError:
        record = None
    if not isinstance(record, dict):
        return None, None, [], []
    paths = field_paths(record)
    mark = fingerprint(paths)
    layouts = {} if layouts is None else layouts
    if mark not in layouts:
        if len(layouts) > 10_000:
            layouts.clear()
        layouts[mark] = chosen(paths, known)
    mapping, rest = layouts[mark]
    return mark, mapping and mapping.name, mapping.apply(record) if mapping else [], sorted(rest)


def canonical_turns(records: DataFrame, column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """fingerprint, layout, turns and unmapped (paths) of every JSON record; layout is null where no
    mapping fits."""
    known = registry(mappings)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layouts: dict = {}
        for pdf in batches(it):
            got = [canonical(x, known, layouts) for x in pdf["record"].array]
            yield pd.DataFrame(
                {
                    "conv_id": pdf["conv_id"].astype("Int64"),
                    "fingerprint": [g[0] for g in got],
                    "layout": [g[1] for g in got],
                    "turns": [[{"role": r, "text": t} for r, t in g[2]] for g in got],
                    "unmapped": [g[3] for g in got],
                }
            )

    rows = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col(column).cast("string").alias("record"))
    return rows.mapInPandas(run, "conv_id long, fingerprint string, layout string, turns array<struct<role: string, text: string>>, unmapped array<string>")


# --- the template ---


def escape(text: str, control: tuple[str, ...] = CONTROL) -> str:
    """No control string is left in the result: its first character is set off by an escape."""
    text = text.replace(ESCAPE, ESCAPE + "e")
    for c in control:
        text = text.replace(c, c[0] + ESCAPE + "c" + c[1:])
    return text


def unescape(text: str) -> str:
    return text.replace(ESCAPE + "c", "").replace(ESCAPE + "e", ESCAPE)


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans (in code points) under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{OPEN}{escape(role)}{MIDDLE}"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[Turn]:
    """The turns of a formatted conversation: what render() was given."""
    out = []
    for turn in formatted.split(OPEN)[1:]:
        role, _, rest = turn.partition(MIDDLE)
        out.append((unescape(role), unescape(rest[: -len(CLOSE)])))
    return out


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of every conversation of a table of turns."""
    # The place of a turn: its number, then role and text, so that ties have a defined order.
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    record = F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")))
    known = registry()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layouts: dict = {}
        for pdf in batches(it):
            done = [render(canonical(x, known, layouts)[2]) for x in pdf["record"].array]
            yield pd.DataFrame(
                {
                    "conv_id": pdf["conv_id"].astype("Int64"),
                    "formatted": [f for f, _ in done],
                    "loss_spans": [[{"start": a, "end": b} for a, b in s] for _, s in done],
                }
            )

    return whole.select("conv_id", record.alias("record")).mapInPandas(
        run, "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>"
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as counts and digests."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            rows = []
            for conv, text, spans in zip(pdf["conv_id"].array, pdf["formatted"].array, pdf["loss_spans"].array):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (whole, loss)]
                rows.append((conv, len(turns), sha[0], len(loss), sha[1], len(text)))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out["conv_id"] = out["conv_id"].astype("Int64")
            yield out

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
