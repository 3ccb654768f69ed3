"""Chat formatting by incremental rendering of a template that is a black box.

Successive prefixes of a conversation are rendered; where an output begins with the one
before, what it adds is the new turn's span. Where it does not, the template rewrites
history, and the turn at which it did is reported. A turn rendered with one marker
character instead of its text shows where the text stands within the span.

Prefixes of a long conversation cost the square of its length. A caller whose template
never looks back may have turns rendered in stretches, each behind the turn before it; the
pieces must then add up to the rendering of the whole, which is checked for each
conversation, and where they do not, all prefixes are rendered after all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import grouped

STRETCH = 32  # turns
MARKER = "\ue000"

Turn = tuple[str, str]  # role and text

_CONTROL = re.compile(r"\\|<(?=/turn>)|#(?=## )")
_ROLE_CONTROL = re.compile(r"\\|<(?=/turn>)|#(?=## )|:")
_OUT = {"\\": "\\\\", "<": "\\l", "#": "\\h", ":": "\\c"}
_IN = {"\\": "\\", "l": "<", "h": "#", "c": ":"}
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    """``text`` without control strings; ``unescape`` gives it back."""
    return control.sub(lambda m: _OUT[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _IN[m[1]], text)


def render(turns: list[Turn]) -> str:
    """The built-in template: ``### role: text</turn>`` and a line feed per turn."""
    return "".join(f"### {escape(role, _ROLE_CONTROL)}: {escape(text)}</turn>\n" for role, text in turns)


def parse(text: str) -> list[Turn]:
    """The turns of a rendering of the built-in template."""
    turns = []
    for piece in text.split("</turn>\n")[:-1]:
        role, _, said = piece.removeprefix("### ").partition(": ")
        turns.append((unescape(role), unescape(said)))
    return turns


Span = tuple[int, int, int | None, int | None]  # turn, and the text in it


def text_place(rendered: Callable[[list[Turn]], str], before: list[Turn], role: str, known: str, added: str) -> tuple[int, int] | None:
    """Where the text stands in what a turn adds; None if the marker cannot be found."""
    marked = rendered([*before, (role, MARKER)])
    if not marked.startswith(known) or (head := marked.find(MARKER, len(known))) < 0:
        return None
    head -= len(known)
    tail = len(marked) - len(known) - head - 1
    return (head, len(added) - tail) if head + tail <= len(added) else None


def stretch_spans(rendered: Callable[[list[Turn]], str], turns: list[Turn], first: int, last: int, context: int) -> tuple[list[str], list, list[int]]:
    """What each of the turns ``first`` to ``last`` adds behind ``context`` turns, the place of
    its text therein, and the turns that changed what stood before."""
    begin = max(0, first - context)
    known, added, places, rewrites = rendered(turns[begin:first]), [], [], []
    for k in range(first, last):
        now = rendered(turns[begin : k + 1])
        if now.startswith(known):
            added.append(now[len(known) :])
            places.append(text_place(rendered, turns[begin:k], turns[k][0], known, added[-1]))
        else:
            rewrites.append(k)
            added.append("")
            places.append(None)
        known = now
    return added, places, rewrites


def spans(rendered: Callable[[list[Turn]], str], turns: list[Turn], every: bool = True) -> tuple[str, list[Span] | None, list[int]]:
    """Whole text, each turn's span and its text's span, and the turns that rewrite history.

    Spans are only given where history is never rewritten. Unless ``every`` prefix is
    rendered, beyond STRETCH turns only rewrites within a stretch or visible in the whole
    text are found.
    """
    whole = rendered(turns)
    head = rendered([])
    added, places, rewrites = [], [], []
    for first in range(0, 0 if every else len(turns), STRETCH):
        a, p, r = stretch_spans(rendered, turns, first, min(first + STRETCH, len(turns)), 1)
        added, places, rewrites = added + a, places + p, rewrites + r
    if every or rewrites or head + "".join(added) != whole:
        added, places, rewrites = stretch_spans(rendered, turns, 0, len(turns), 0)
        if rewrites:
            return whole, None, rewrites
    out, at = [], len(head)
    for text, place in zip(added, places):
        out.append((at, at + len(text), *((None, None) if place is None else (at + place[0], at + place[1]))))
        at += len(text)
    return whole, out, []


SPAN = pa.struct([("role", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("text_first", pa.int64()), ("text_last", pa.int64())])


def format_chats(rows: DataFrame, rendered: Callable[[list[Turn]], str] = render, conv_id: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text", every: bool = True) -> DataFrame:
    """``conv_id, formatted, turns, rewrites``, one row per conversation.

    Turns are put in order of ``turn``, then role and text. ``turns`` holds each turn's
    role and spans in characters, ends excluded, or is null where the template rewrote
    history at the turns in ``rewrites``; ``every=False`` renders long conversations in stretches
    (see ``spans``), for templates known not to look back. A null text or role is empty, a null turn comes
    first, rows without an id are one conversation, repeated rows are turns of their own;
    an empty table gives no rows. Other columns are not read. A conversation is one value
    and so has to fit into a task, as its formatted text does; no two must fit together.
    """
    own = rows.select(rows[conv_id].alias("conv_id"), rows[turn].alias("turn"), F.coalesce(rows[role].cast("string"), F.lit("")).alias("role"),
                      F.coalesce(rows[text].cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("key", F.coalesce(F.concat(F.lit("i"), F.col("conv_id").cast("string")), F.lit("")))
    kind = dict(own.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "key"):
            keys, roles, texts = (t.column(c).to_pylist() for c in ("key", "role", "text"))
            edges = [i for i in range(len(keys) + 1) if i in (0, len(keys)) or keys[i] != keys[i - 1]]
            found = [spans(rendered, list(zip(roles[a:b], texts[a:b])), every) for a, b in zip(edges, edges[1:])]
            turns = [None if s is None else [dict(zip(SPAN.names, (r, *x))) for r, x in zip(roles[a:], s)] for a, (_, s, _) in zip(edges, found)]
            for lo in range(0, len(found), 256):
                part = slice(lo, lo + 256)
                yield pa.RecordBatch.from_arrays(
                    [t.column("conv_id").take(pa.array(edges[:-1][part], pa.int64())).combine_chunks(), pa.array([f[0] for f in found[part]], pa.string()),
                     pa.array(turns[part], pa.list_(SPAN)), pa.array([f[2] for f in found[part]], pa.list_(pa.int32()))],
                    ["conv_id", "formatted", "turns", "rewrites"])

    ordered = own.repartition("key").sortWithinPartitions("key", "turn", "role", "text").select("key", "conv_id", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, formatted string, turns array<struct<role: string, first: long, last: long, text_first: long, text_last: long>>, rewrites array<int>")


def read_back(chats: DataFrame, parsed: Callable[[str], list[Turn]] = parse, unescaped: Callable[[str], str] = unescape, learn: str = "assistant") -> DataFrame:
    """``chats`` with ``said`` (role, text of each turn) and ``loss`` (the texts under the loss
    mask: those of turns by ``learn``, unescaped), both taken from ``formatted`` alone and
    its spans. Where history was rewritten, ``loss`` is null."""
    said_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, loss = [], []
            for text, turns in zip(batch.column("formatted").to_pylist(), batch.column("turns").to_pylist()):
                said.append([{"role": r, "text": t} for r, t in parsed(text)])
                mine = None if turns is None else [x for x in turns if x["role"] == learn]
                loss.append(None if mine is None or any(x["text_first"] is None for x in mine) else [unescaped(text[x["text_first"] : x["text_last"]]) for x in mine])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("formatted"), pa.array(said, said_type), pa.array(loss, pa.list_(pa.string()))],
                                             ["conv_id", "formatted", "said", "loss"])

    kind = dict(chats.dtypes)["conv_id"]
    return chats.select("conv_id", "formatted", "turns").mapInArrow(run, f"conv_id {kind}, formatted string, said array<struct<role: string, text: string>>, loss array<string>")
