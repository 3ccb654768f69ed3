"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation has to read as one optional system turn and then user and assistant in
turn. Turns may be kept, given another role, deleted or inserted; the cheapest edits are
a shortest path through four states: nothing yet, behind system, behind user, behind
assistant. A half of a conversation is known by what it costs to get from each state to
each other, so a forward and a backward vector of four costs meet in its middle; the
crossing is chosen and both halves are solved by themselves.

Of equally cheap edits the least in ASCII order count. Every row's edits, the insertions
before it included, end in D, K or R, so no row's edits begin another's: strings of equal
rows compare row by row, and a half ranks the states it reaches by their least strings.
Deletions come before the insertions next to them, which is the lesser order.

The same holds between parts of a long conversation. Rows are sorted over the cluster and
numbered; SEGMENT neighbours make a part. Tasks turn parts into matrices of costs and
ranks, a conversation's matrices are chained from both ends, and then its parts are solved
anywhere. Equal rows are counted, not repeated: all but the first are deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import WORD, staged, stored

SEGMENT_BITS = 8  # rows of a part: 256
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3  # costs
NONE = 1 << 60  # cost of what can't be reached
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
# What the rest of a conversation costs behind its last row: user and assistant, assistant, nothing.
LAST = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")
# Kinds of rows: first letter of the role (s, u, a, another), and whether the text is whole, truncated or must go.
LETTERS, WHOLE, CUT, GONE = "sua", 0, 4, 8

Vector = tuple[tuple[int, ...], tuple[int, ...]]  # costs of and ranks among the four states


def following(state: int) -> int:
    """Where an inserted turn, or one with the role that is due, leads."""
    return ASSISTANT if state == USER else USER


@lru_cache(maxsize=None)
def steps(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest and then least edits that lead a row of this kind from state to state."""
    out = {(q, q): (DELETE, "D") for q in STATES}
    if kind >= GONE:
        return out
    extra, letter = (TRUNCATED if kind >= CUT else 0), kind % 4
    for q in STATES:
        at = q
        for n in range(3):
            ways = [(following(at), REROLE, "R")]
            if (letter == 0 and at == START) or (letter == 1 and at != USER) or (letter == 2 and at == USER):
                ways.append((letter + 1, 0, "K"))
            for to, cost, edit in ways:
                found = (n * INSERT + cost + extra, "I" * n + edit)
                out[q, to] = min(out.get((q, to), (NONE, "")), found)
            at = following(at)
    return out


def forward(kinds: bytes, state: int) -> Vector:
    """Cost of the cheapest edits from ``state`` to each state, and the order of their least strings."""
    costs, ranks = [NONE] * 4, [0] * 4
    costs[state] = 0
    for kind in kinds:
        best: list[tuple[int, int, str]] = [(NONE, 0, "")] * 4
        for (q, to), (cost, edits) in steps(kind).items():
            if costs[q] < NONE:
                best[to] = min(best[to], (costs[q] + cost, ranks[q], edits))
        costs = [b[0] for b in best]
        order = {x: i for i, x in enumerate(sorted({b[1:] for b in best if b[0] < NONE}))}
        ranks = [order.get(b[1:], 0) for b in best]
    return tuple(costs), tuple(ranks)


def backward(kinds: bytes, state: int) -> tuple[int, ...]:
    """Cost of the cheapest edits from each state to ``state``."""
    costs = [NONE] * 4
    costs[state] = 0
    for kind in reversed(kinds):
        best = [NONE] * 4
        for (q, to), (cost, _) in steps(kind).items():
            best[q] = min(best[q], costs[to] + cost)
        costs = best
    return tuple(costs)


def crossing(vector: Vector, rest: tuple[int, ...]) -> int:
    """The state through which the least of the cheapest edits lead."""
    least = min(a + b for a, b in zip(vector[0], rest))
    return min((vector[1][q], q) for q in STATES if vector[0][q] + rest[q] == least)[1]


@lru_cache(maxsize=20_000)
def solved(kinds: bytes, begin: int, end: int) -> tuple[str, ...]:
    """Every row's edits, from state ``begin`` to state ``end``."""
    if len(kinds) == 1:
        return (steps(kinds[0])[begin, end][1],)
    half = len(kinds) // 2
    q = crossing(forward(kinds[:half], begin), backward(kinds[half:], end))
    return solved(kinds[:half], begin, q) + solved(kinds[half:], q, end)


@lru_cache(maxsize=20_000)
def matrix(kinds: bytes) -> tuple[list[int], list[int]]:
    """Costs and ranks from each state (rows) to each state."""
    vectors = [forward(kinds, q) for q in STATES]
    return [c for v in vectors for c in v[0]], [r for v in vectors for r in v[1]]


def chained(costs: list[list[int]], ranks: list[list[int]]) -> tuple[int, list[int]]:
    """The whole cost of parts one behind the other, and the states before, between and behind them."""
    rest = [LAST]
    for m in reversed(costs):
        rest.append(tuple(min(m[4 * q + to] + rest[-1][to] for to in STATES) for q in STATES))
    rest.reverse()
    states = [START]
    for i, (m, r) in enumerate(zip(costs, ranks)):
        row = slice(4 * states[-1], 4 * states[-1] + 4)
        states.append(crossing((tuple(m[row]), tuple(r[row])), rest[i + 1]))
    return rest[0][START], states


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text``: rows of which a fifth or so has a fault, by crc32 of ``conv_id:turn``.

    Of its remainders by 20, 0 drops a row, 1 empties its text, 2 takes out ``.!?``,
    3 repeats it and 4 makes its role user. Nulls count as one space, in the key, too.
    """
    space = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn)).cast("binary")) % 20
    said = F.when(fault == 1, "").when(fault == 2, F.translate(space(text), ".!?", "")).otherwise(space(text))
    out = rows.select(rows[conv_id].alias("conv_id"), rows[turn].alias("turn"), F.when(fault == 4, "user").otherwise(space(role)).alias("role"), said.alias("text"),
                      F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("_times"))
    return out.filter("_times > 0").select(F.explode(F.array_repeat(F.lit(0), F.col("_times"))), "conv_id", "turn", "role", "text").drop("col")


def kind_of(role: Column, text: Column) -> Column:
    """Number of the row's kind, as ``steps`` takes it; what was said before is not known yet."""
    letter = F.substring(role, 1, 1)
    place = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    return (place + F.when(~text.rlike(WORD), GONE).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(WHOLE)).cast("int")


def sorted_rows(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct rows with their count ``n`` in order, stored: ``pos`` numbers them over the cluster."""
    space = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    own = rows.select(rows[conv_id].alias("conv_id"), rows[turn].cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    own = own.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    said = F.concat(F.coalesce(F.concat(F.lit("i"), F.col("conv_id").cast("string")), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    own = own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    return stored(own.withColumns({"seg": F.shiftright("pos", SEGMENT_BITS), "kind": kind_of(F.col("role"), F.col("text")), "said": F.unhex(F.sha2(said, 256))}))


def said_before(table: DataFrame) -> DataFrame:
    """``seg, pos`` of rows whose role and text an earlier row of their conversation has."""
    first = table.groupBy("said").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return table.select("said", "seg", "pos").join(first, "said").filter("pos > _first").select("seg", "pos")


class Part:
    """Rows of one conversation within one segment."""

    def __init__(self, conv_id, seg: int):
        self.conv_id, self.seg, self.at, self.kinds, self.rows, self.given = conv_id, seg, None, bytearray(), [], None
        self.turns: list[int] = []  # distinct and in order

    def add(self, row: dict, before: bool) -> None:
        self.at = row["pos"] if self.at is None else self.at
        kind = row["kind"]
        repeat = before and kind < GONE
        self.kinds.append(GONE + kind % 4 if repeat else kind)
        self.rows.append(row | {"repeat": repeat})
        if row["turn"] is not None and (not self.turns or self.turns[-1] != row["turn"]):
            self.turns.append(row["turn"])


# Kinds of rows that meet at a segment: what is known of a part, a mark of repeated rows, rows.
GIVEN, MARK, ROW = range(3)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """Parts from rows sorted by segment, number and kind."""
    part, before, given = None, False, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["what"] == GIVEN:
                given = row["given"]
            elif row["what"] == MARK:
                before = True
            else:
                if part is None or part.seg != row["seg"] or part.conv_id != row["conv_id"]:
                    if part is not None:
                        yield part
                    part = Part(row["conv_id"], row["seg"])
                    part.given = given
                part.add(row, before)
                before = False
    if part is not None:
        yield part


def batched(rows: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]
LEGAL = {(0, 1), (1, 2), (2, 1)}  # su, ua, au


def summary(part: Part) -> dict:
    """A part's matrix, counts, first and last letters and turns."""
    copies = [r["n"] - 1 for r in part.rows]
    costs, ranks = matrix(bytes(part.kinds))
    letters = [k % 4 for k in part.kinds]
    out = {"conv_id": part.conv_id, "seg": part.seg, "at": part.at, "ranks": ranks, "letters": [letters[0], letters[-1]]}
    out["costs"] = [min(NONE, c + DELETE * sum(copies)) for c in costs]
    out["blank"] = sum(r["n"] for r in part.rows if r["kind"] >= GONE)
    out["duplicate"] = sum(r["n"] if r["repeat"] else r["n"] - 1 for r in part.rows if r["kind"] < GONE)
    out["truncated"] = sum(CUT <= k < GONE for k in part.kinds)
    out["illegal"] = sum(copies) + sum(pair not in LEGAL for pair in zip(letters, letters[1:]))
    out["turns"] = [part.turns[0], part.turns[-1], len(part.turns)] if part.turns else None
    return out


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each conversation, from rows sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["conv_id"] != row["conv_id"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def ends(rows: list[dict]) -> Iterator[dict]:
    """Each part's first and last state; the last part has the conversation's totals."""
    cost, states = chained([r["costs"] for r in rows], [r["ranks"] for r in rows])
    total = {c: sum(r[c] for r in rows) for c in COUNTS[:3]} | {"cost": cost}
    total["illegal"] = sum(r["illegal"] for r in rows) + sum((a["letters"][1], b["letters"][0]) not in LEGAL for a, b in zip(rows, rows[1:]))
    turns = [r["turns"] for r in rows if r["turns"]]
    distinct = sum(t[2] for t in turns) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:]))
    total["gaps"] = turns[-1][1] - turns[0][0] + 1 - distinct if turns else 0
    for i, r in enumerate(rows):
        last = i == len(rows) - 1
        yield {"conv_id": r["conv_id"], "seg": r["seg"], "pos": r["at"],
               "given": {"states": states[i : i + 2], "tail": TAIL[states[-1]] if last else "", "total": total if last else None}}


def rewritten(part: Part) -> dict:
    """A part's edits and the turns that they make."""
    (begin, end), audit, turns = part.given["states"], [], []
    state = begin
    for row, edits in zip([*part.rows, None], [*solved(bytes(part.kinds), begin, end), part.given["tail"]]):
        audit.append(edits)
        for edit in edits:
            if edit in "IR":
                state = following(state)
                turns.append({"role": NAMES[state], "text": row["text"] if edit == "R" else ""})
            elif edit == "K":
                state = row["kind"] % 4 + 1
                turns.append({"role": row["role"], "text": row["text"]})
        if row is not None:
            audit.append("D" * (row["n"] - 1))
    return {"conv_id": part.conv_id, "seg": part.seg, "audit": "".join(audit), "turns": turns, "total": part.given["total"]}


def repaired_parts(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, seg, audit, turns, total``: the repaired conversations in parts, in order of ``seg``.

    ``turns`` is an array of role and text; ``total`` has the conversation's counts and
    stands in its last part.
    """
    table = sorted_rows(rows, conv_id, turn, role, text)
    kind = dict(table.dtypes)["conv_id"]
    marks = staged(said_before(table))
    id_type = to_arrow_type(table.schema["conv_id"].dataType)
    total = "struct<" + ", ".join(f"{c}: long" for c in [*COUNTS, "gaps"]) + ">"
    given = f"struct<states: array<int>, tail: string, total: {total}>"
    spark = rows.sparkSession
    schema = lambda text: pa.schema([(f.name, id_type if f.name == "conv_id" else to_arrow_type(f.dataType)) for f in spark.createDataFrame([], text).schema])

    def met(own: DataFrame) -> DataFrame:
        own = own.unionByName(marks.withColumn("what", F.lit(MARK)), allowMissingColumns=True)
        return own.repartition("seg").sortWithinPartitions("seg", "pos", "what")

    keys = table.select("conv_id", "seg", "pos", "turn", "kind", "n", F.lit(ROW).alias("what"))
    found = f"conv_id {kind}, seg long, at long, costs array<long>, ranks array<int>, letters array<int>, turns array<long>, blank long, duplicate long, truncated long, illegal long"
    found_schema = schema(found)
    sums = met(keys).mapInArrow(lambda b: batched(map(summary, parts(b)), found_schema), found)
    end = f"conv_id {kind}, seg long, pos long, given {given}"
    end_schema = schema(end)
    known = sums.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(
        lambda b: batched((x for rows in conversations(b) for x in ends(rows)), end_schema), end)
    whole = table.select("conv_id", "seg", "pos", "turn", "role", "text", "kind", "n", F.lit(ROW).alias("what"))
    whole = whole.unionByName(known.withColumn("what", F.lit(GIVEN)), allowMissingColumns=True)
    out = f"conv_id {kind}, seg long, audit string, turns array<struct<role: string, text: string>>, total {total}"
    out_schema = schema(out)
    return met(whole).mapInArrow(lambda b: batched(map(rewritten, parts(b)), out_schema, 64), out)


def hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per conversation, from its parts in order; texts pass through one by one."""
    def rows() -> Iterator[dict]:
        now, audit, digest, total, first = None, [], None, None, True
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now[0] != row["conv_id"]:
                    if now is not None:
                        yield {"conv_id": now[0], "audit": "".join(audit), "repaired_sha256": digest.hexdigest(), **total}
                    now, audit, digest, first = (row["conv_id"],), [], hashlib.sha256(), True
                audit.append(row["audit"])
                for t in row["turns"]:
                    digest.update(("" if first else "\n").encode() + f"{t['role']}:{t['text']}".encode())
                    first = False
                total = row["total"] or total
        if now is not None:
            yield {"conv_id": now[0], "audit": "".join(audit), "repaired_sha256": digest.hexdigest(), **total}

    return batched(rows(), schema)


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, one row per conversation.

    Rows are taken in order of ``turn`` (null first), then role and text. A null role or
    text is one space; rows without an id are one conversation; repeated rows are repeated
    turns; an empty table gives no rows. Other columns are not read. ``turn`` is a whole
    number. A conversation's audit is one value, and its digest runs over its turns in
    one task, part by part; all else is spread by parts.
    """
    parts_ = repaired_parts(rows, conv_id, turn, role, text)
    kind = dict(parts_.dtypes)["conv_id"]
    names = ["conv_id", "gaps", *COUNTS, "audit", "repaired_sha256"]
    types = {"conv_id": to_arrow_type(parts_.schema["conv_id"].dataType), "audit": pa.string(), "repaired_sha256": pa.string()}
    schema = pa.schema([(n, types.get(n, pa.int64())) for n in names])
    ordered = parts_.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return ordered.mapInArrow(lambda b: hashed(b, schema), ", ".join(f"{n} {kind if n == 'conv_id' else 'string' if n in types else 'long'}" for n in names))


def for_all(ids: DataFrame, repaired: DataFrame) -> DataFrame:
    """``repaired`` with a row of zeros and empty strings for each id of ``ids`` (column ``conv_id``) that has no rows."""
    ids = ids.select(F.col("conv_id").alias("_id")).distinct()
    rows = ids.join(repaired, F.expr("_id <=> conv_id"), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return rows.select(F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(empty.get(c, 0))).alias(c) for c in repaired.columns if c != "conv_id"])
