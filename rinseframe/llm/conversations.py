"""Repair of conversations at the least cost, with an audit of the edits.

Rows are sorted over the whole cluster, a conversation after the other, and cut into blocks of bounded size; a conversation
of any length may lie in many blocks and tasks. A block is solved by dynamic programming over its rows and the states of
the wanted order of roles. The edits chosen so far are linked nodes that share their prefixes; each has its ancestors
at distances of powers of two and a rolling hash, so two prefixes of equal cost are compared by searching their longest
common prefix in a logarithmic number of steps. Equal hashes are verified letter by letter, back to where both are known
to be the same, and what was verified is remembered. Conversations in one block are done there. Of the others each
block is solved for every state it may begin in, and the blocks' results are joined in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseframe.llm.common import arrays, fields, stored

#: Rows and characters of a block, and forms of conversations whose solution a Python worker remembers.
BLOCK_ROWS, BLOCK_CHARACTERS, REMEMBERED = 2048, 4 << 20, 50_000
#: What edits cost: a new role, a deletion, an insertion, and a truncated row that stays.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: States of the order (s?(ua)+)?: nothing yet, after the system's row, after the user's, after the assistant's.
STATES, ENDS = range(4), (0, 3)
_KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_NEXT = (2, 2, 3, 2)
_ROLES = {2: "user", 3: "assistant"}
_SPACE, _CLOSING = " \t\n\x0b\x0c\r", (".", "!", "?")
_FAR = 1 << 60
_BASE, _PRIME = 0x1F3D5B79A3C1E5F7, (1 << 61) - 1

_BLOCK = {"number": "long", "whole": "boolean", "turns": "longs", "roles": "strings", "texts": "strings"}
_REPORT = {
    "gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string",
}
_SOLVED = {
    "number": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "first_initial": "string",
    "last_initial": "string", "first_turn": "long", "last_turn": "long", "n_turns": "long", "costs": "longs", "audits": "strings",
}


class Prefixes:
    """Strings that grow at the end, as linked nodes; node 0 is the empty one."""

    def __init__(self) -> None:
        self.letter, self.depth, self.hash, self.up, self.known = [""], [0], [0], [()], [0]

    def extend(self, node: int, letter: str) -> int:
        ancestors, k = [node], 0
        while len(self.up[ancestors[k]]) > k:
            ancestors.append(self.up[ancestors[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % _PRIME)
        self.up.append(tuple(ancestors))
        self.known.append(len(self.known))
        return len(self.known) - 1

    def _first(self, node: int) -> int:
        """The node that stands for all that are known to be the same string."""
        while self.known[node] != node:
            self.known[node] = node = self.known[self.known[node]]
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of equal depth are the same string: hashes first, then letters."""
        if self.hash[a] != self.hash[b]:
            return False
        passed = []
        a, b = self._first(a), self._first(b)
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            passed.append((a, b))
            a, b = self._first(self.up[a][0]), self._first(self.up[b][0])
        for a, b in passed:
            self.known[self._first(a)] = self._first(b)
        return True

    def _lift(self, node: int, depth: int) -> int:
        rest, k = self.depth[node] - depth, 0
        while rest:
            if rest & 1:
                node = self.up[node][k]
            rest, k = rest >> 1, k + 1
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether a comes before b, letter by letter; a prefix comes before what goes on."""
        least = min(self.depth[a], self.depth[b])
        x, y = self._lift(a, least), self._lift(b, least)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and k < len(self.up[y]) and not self.same(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def solve(form: str, start: int = 0) -> list[tuple[int, str] | None]:
    """For each end state the cheapest edits from a start state and their cost, or None; ties go to the least audit.

    ``form`` has a letter a row: x must go; s, u, a, o are initials of roles (o any other), in capitals if truncated.
    Prefixes of equal cost in one state are never one the beginning of the other, as what goes on would be insertions, which
    cost; so the lesser prefix stays the lesser whatever follows.
    """
    made = Prefixes()
    best: list[tuple[int, int]] = [(_FAR, 0)] * 4
    best[start] = (0, 0)

    def offer(into: list, state: int, cost: int, node: int, letter: str) -> bool:
        if cost > into[state][0]:
            return False
        node = made.extend(node, letter)
        if cost == into[state][0] and not made.less(node, into[state][1]):
            return False
        into[state] = (cost, node)
        return True

    def insertions(into: list) -> None:
        open_states = [s for s in STATES if into[s][0] < _FAR]
        while open_states:
            s = open_states.pop()
            cost, node = into[s]
            if offer(into, _NEXT[s], cost + INSERT, node, "I"):
                open_states.append(_NEXT[s])

    insertions(best)
    for letter in form:
        then: list[tuple[int, int]] = [(_FAR, 0)] * 4
        extra = CUT_OFF if letter.isupper() else 0
        for s in STATES:
            cost, node = best[s]
            if cost >= _FAR:
                continue
            offer(then, s, cost + DELETE, node, "D")
            if letter != "x":
                if (t := _KEEPS.get((s, letter.lower()))) is not None:
                    offer(then, t, cost + extra, node, "K")
                offer(then, _NEXT[s], cost + REROLE + extra, node, "R")
        insertions(then)
        best = then
    return [(cost, made.text(node)) if cost < _FAR else None for cost, node in best]


@lru_cache(maxsize=REMEMBERED)
def _remembered(form: str) -> tuple[int, str]:
    return min(found for s, found in enumerate(solve(form)) if s in ENDS and found)


def cheapest(form: str) -> tuple[int, str]:
    """The cost and the audit of a whole conversation."""
    return _remembered(form) if len(form) <= 64 else min(found for s, found in enumerate(solve(form)) if s in ENDS and found)


def faults(roles: list[str], texts: list[str], seen_before: Iterable[bytes] = ()) -> tuple[str, list[int]]:
    """The form of rows in order, and how many are blank, duplicates and truncated; a row's first fault counts."""
    form, counts, seen, before = [], [0, 0, 0], set(), set(seen_before)
    for role, text in zip(roles, texts):
        body = text.strip(_SPACE)
        if not body:
            counts[0] += 1
            form.append("x")
        elif (role, text) in seen or (before and _digest(role, text) in before):
            counts[1] += 1
            form.append("x")
        else:
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if body[-1] not in _CLOSING:
                counts[2] += 1
                letter = letter.upper()
            form.append(letter)
    return "".join(form), counts


def _digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode(errors="surrogatepass")).digest()


def illegal(initials: list[str]) -> int:
    """Neighbours whose initials do not follow each other in a conversation."""
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def repaired(roles: list[str], texts: list[str], audit: str, state: int = 0) -> Iterator[tuple[str, str, str]]:
    """Role, text and edit of the rows that an audit leaves, from a state on."""
    rows = iter(zip(roles, texts))
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        state = _KEEPS[state, role[:1]] if edit == "K" else _NEXT[state]
        yield (role if edit == "K" else _ROLES[state]), text, edit


def _gap(low: int | None, high: int | None, n: int) -> int:
    return 0 if low is None else min(high - low + 1 - n, (1 << 63) - 1)


def _blocks(rows: DataFrame, conversation: str, turn: str, role: str, text: str, absent: str | None) -> DataFrame:
    """The rows of conversations in order, cut into blocks; numbers of blocks follow the order."""
    gone = F.lit(False) if absent is None else F.coalesce(F.col(f"`{absent}`").cast("boolean"), F.lit(False))
    words = F.when(~gone, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    source = rows.select(
        F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).cast("binary").alias("role"), words.cast("binary").alias("text"),
    ).withColumns({"hash": F.xxhash64("text"), "copy": F.monotonically_increasing_id()})
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "hash", "copy")]
    in_order = source.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text")
    schema = T.StructType([source.schema["conv"], *fields(_BLOCK)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kind = TaskContext.get().partitionId() << 36, None
        out, characters, began, alone = [], 0, False, False
        current, block, size = None, ([], [], []), 0

        def close(whole: bool) -> None:
            nonlocal number, characters, block, size
            out.append((current, number, whole, *block))
            characters += size
            number, block, size = number + 1, ([], [], []), 0

        def made() -> pa.RecordBatch:
            nonlocal out, characters
            conv, *rest = zip(*out)
            out, characters = [], 0
            return pa.RecordBatch.from_arrays([pa.array(conv, kind), *arrays(_BLOCK, dict(zip(_BLOCK, rest)))], names=["conv", *_BLOCK])

        for batch in batches:
            kind = batch.schema.field("conv").type
            for conv, at, who, said in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not began or conv != current:
                    if began:
                        close(alone)  # of the task's first conversation there may be more before
                        alone = True
                    began, current = True, conv
                elif len(block[0]) >= BLOCK_ROWS or size >= BLOCK_CHARACTERS:
                    alone = False
                    close(False)
                if said is not None:
                    block[0].append(at)
                    block[1].append(who.decode(errors="replace"))
                    block[2].append(said.decode(errors="replace"))
                    size += len(said)
                if characters >= BLOCK_CHARACTERS or len(out) >= BLOCK_ROWS:
                    yield made()
        if began:
            close(False)  # there may be more behind
            yield made()

    return in_order.mapInArrow(cut, schema)


def _map(blocks: DataFrame, spec: dict[str, str], work) -> DataFrame:
    """``conv`` and what ``work`` makes of each block, given as a dictionary; it yields rows."""
    schema = T.StructType([blocks.schema["conv"], *fields(spec)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                rows = [(conv, *row) for conv, block in zip(part.column("conv").to_pylist(), part.drop_columns(["conv"]).to_pylist()) for row in work(block)]
                if rows:
                    conv, *rest = zip(*rows)
                    made = arrays(spec, dict(zip(spec, rest)))
                    yield pa.RecordBatch.from_arrays([pa.array(conv, part.schema.field("conv").type), *made], names=["conv", *spec])

    return blocks.mapInArrow(run, schema)


def _whole(block: dict) -> Iterator[tuple]:
    """The report of a conversation that lies in one block, and the digest of what is left of it."""
    form, counts = faults(block["roles"], block["texts"])
    cost, audit = cheapest(form)
    turns = [t for t in block["turns"] if t is not None]
    gaps = _gap(min(turns, default=None), max(turns, default=None), len(set(turns)))
    left = "\n".join(f"{role}:{text}" for role, text, _ in repaired(block["roles"], block["texts"], audit))
    digest = hashlib.sha256(left.encode(errors="replace")).hexdigest()
    yield (gaps, *counts, illegal([role[:1] for role in block["roles"]]), cost, audit, digest)


def _part(block: dict) -> Iterator[tuple]:
    """One of several blocks: its faults, its ends, and its cheapest edits between any two states."""
    roles, texts = block["roles"], block["texts"]
    form, counts = faults(roles, texts, block["before"] or ())
    turns = [t for t in block["turns"] if t is not None]
    found = [x for start in STATES for x in solve(form, start)]
    ends = (roles[0][:1], roles[-1][:1]) if roles else (None, None)
    yield (
        block["number"], *counts, illegal([role[:1] for role in roles]), *ends, turns[0] if turns else None, turns[-1] if turns else None,
        len(set(turns)), [-1 if x is None else x[0] for x in found], ["" if x is None else x[1] for x in found],
    )


def _joined(table: pa.Table) -> tuple[dict, list[dict]]:
    """The report of a conversation from its blocks, and for each block its state and edits."""
    blocks = sorted(table.to_pylist(), key=lambda b: b["number"])
    best: list[tuple[int, str] | None] = [(0, ""), None, None, None]
    ways, report = [], dict.fromkeys(_REPORT, 0)
    low = high = last = None
    n_turns = 0
    for block in blocks:
        then: list[tuple[int, str] | None] = [None] * 4
        way = [0] * 4
        for s in STATES:
            for t in STATES:
                if best[s] is not None and (cost := block["costs"][4 * s + t]) >= 0:
                    offered = (best[s][0] + cost, best[s][1] + block["audits"][4 * s + t])
                    if then[t] is None or offered < then[t]:
                        then[t], way[t] = offered, s
        best = then
        ways.append(way)
        for c in ("blank", "duplicate", "truncated", "illegal"):
            report[c] += block[c]
        if block["first_initial"] is not None:
            report["illegal"] += 0 if last is None else illegal([last, block["first_initial"]])
            last = block["last_initial"]
        if block["first_turn"] is not None:
            n_turns += block["n_turns"] - (block["first_turn"] == high)
            low, high = block["first_turn"] if low is None else low, block["last_turn"]
    report["gaps"] = _gap(low, high, n_turns)
    (report["cost"], report["audit"]), state = min((found, s) for s, found in enumerate(best) if s in ENDS and found)
    pieces = []
    for block, way in zip(reversed(blocks), reversed(ways)):
        piece = block["audits"][4 * way[state] + state]
        state = way[state]
        pieces.append({"number": block["number"], "state": state, "piece": piece})
    return report, pieces[::-1]


@dataclass
class Repair:
    """What a repair gives: ``report``, a row a conversation, and ``turns``, the rows that are left."""

    report: DataFrame
    turns: DataFrame


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["conv"].eqNullSafe(b["conv"])


def repair(
    rows: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    absent: str | None = None,
) -> Repair:
    """Conversations with roles in the order ``(s?(ua)+)?`` by their initials, at the least cost.

    Rows are taken by turn (nulls first), those of one turn by role and then by a hash of the text. A row is at fault if it
    is blank (nothing but ASCII white space), else if its role and text were there before, else if its last character
    before white space is none of ``.!?``. Keeping costs 0, a new role (user or assistant) 1, deleting 2, inserting an
    empty row of one of them 5, and a truncated row that is not deleted 5; blank and duplicate rows are deleted.

    ``report`` has ``conversation``, ``gaps`` (turns missing between the first and the last), ``blank``, ``duplicate``,
    ``truncated``, ``illegal`` (neighbours whose initials are not su, ua or au), ``cost``, ``audit`` (initials of the edits in
    order, the ASCII-least of the cheapest) and ``repaired_sha256`` (of ``role:text``, a line each). ``turns`` has
    ``conversation``, ``block``, ``place`` (in this order), ``role``, ``text`` and ``edit``.

    A null role or text counts as empty; rows without a conversation are one conversation; ``absent`` may name a boolean
    column: rows where it is true are not there, yet their conversation is reported (zeros, an empty audit and the digest
    of nothing if no row is there). Equal rows are duplicates. An empty table gives none. Further columns are ignored.

    Blocks are written to the shared folder. A conversation may be larger than a task's memory, except for its audit:
    where the blocks of one are joined, a task holds sixteen edits a row.
    """
    blocks = stored(_blocks(rows, conversation, turn, role, text, absent), "blocks")
    whole, split = blocks.where("whole"), blocks.where("NOT whole")
    report = _map(whole, _REPORT | {"repaired_sha256": "string"}, _whole)

    # What stands in an earlier block of the same conversation: at most a row for each block and text, whatever its copies.
    said = _map(split, {"number": "long", "digest": "binary"}, lambda b: ((b["number"], d) for d in {_digest(*x) for x in zip(b["roles"], b["texts"])}))
    first = F.min("number").over(Window.partitionBy("conv", "digest"))
    before = said.withColumn("first", first).where("number > first").groupBy("number").agg(F.collect_list("digest").alias("before"))
    parts = stored(_map(split.join(before, "number", "left"), _SOLVED, _part), "parts")

    pieces = T.ArrayType(T.StructType(fields({"number": "long", "state": "int", "piece": "string"})))
    schema = T.StructType([parts.schema["conv"], *fields(_REPORT), T.StructField("pieces", pieces)])

    def join(table: pa.Table) -> pa.Table:
        found, pieces = _joined(table.drop_columns(["conv"]))
        kind = pa.list_(pa.struct([("number", pa.int64()), ("state", pa.int32()), ("piece", pa.string())]))
        made = arrays(_REPORT, {name: [value] for name, value in found.items()})
        return pa.table([table.column("conv").slice(0, 1), *made, pa.array([pieces], kind)], names=schema.names)

    joined = stored(parts.groupBy("conv").applyInArrow(join, schema), "joined")
    chosen = joined.select(F.explode("pieces").alias("p")).select("p.*")
    edited = split.join(chosen, "number")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha, began, any_row = None, hashlib.sha256(), False, False
        for batch in batches:
            conv_kind = batch.schema.field("conv").type
            made = lambda: pa.RecordBatch.from_arrays([pa.array([current], conv_kind), pa.array([sha.hexdigest()])], names=["conv", "repaired_sha256"])
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if not began or row["conv"] != current:
                    if began:
                        yield made()
                    current, sha, began, any_row = row["conv"], hashlib.sha256(), True, False
                for who, words, _ in repaired(row["roles"], row["texts"], row["piece"], row["state"]):
                    sha.update(("\n" * any_row + f"{who}:{words}").encode(errors="replace"))
                    any_row = True
        if began:
            yield made()

    streamed = edited.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "number").select("conv", "roles", "texts", "piece", "state")
    digested = streamed.mapInArrow(digests, T.StructType([parts.schema["conv"], *fields({"repaired_sha256": "string"})]))
    of_split = joined.join(digested, _same(joined, digested)).select(joined["conv"], *_REPORT, "repaired_sha256")

    spec = {"block": "long", "place": "long", "role": "string", "text": "string", "edit": "string"}
    rows_of = lambda b, audit, state: ((b["number"], i, *x) for i, x in enumerate(repaired(b["roles"], b["texts"], audit, state)))
    turns = _map(whole, spec, lambda b: rows_of(b, cheapest(faults(b["roles"], b["texts"])[0])[1], 0)).unionByName(
        _map(edited, spec, lambda b: rows_of(b, b["piece"], b["state"]))
    )
    name = lambda df: df.withColumnRenamed("conv", conversation)
    return Repair(name(report.unionByName(of_split)), name(turns))
