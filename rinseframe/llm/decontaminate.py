"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Every document streams its words through the automaton, which yields at each word the longest suffix that
occurs in some item. Where it is as long as a window, the window's items and words are marked. The documents
are read once, in place, without a shuffle; items are taken in blocks of bounded size, so that the automaton
which each task builds stays small however long the benchmark is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseframe.llm.common import map_texts, stored

#: Consecutive words that count as leaked.
WINDOW = 10
#: Words of benchmark items in one automaton.
BLOCK_WORDS = 400_000
#: A document is dropped when this share of its words is leaked.
COVERAGE = 0.8

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lowered) and characters beyond ASCII."""
    return (text or b"").translate(_LOWER).split()


class Automaton:
    """Generalised suffix automaton of word sequences; states carry the items of windows that end in them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(key, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for key, ws in items if ws]
        for _, code in coded:
            last = 0
            for c in code:
                last = self._extend(last, c)
        self.shortest = min((min(len(code), window) for _, code in coded), default=window)
        self._mark(coded)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state({}, -1, self.length[last] + 1)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, follow: dict[int, int], link: int, length: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def steps(self, code: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) of the longest match that ends at each word."""
        state = length = 0
        follow, link, longest = self.next, self.link, self.length
        for at, c in enumerate(code):
            while state and c not in follow[state]:
                state = link[state]
                length = longest[state]
            if c in follow[state]:
                state = follow[state][c]
                length += 1
            yield at, state, length

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        full: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for key, code in coded:
            for at, state, length in self.steps(code):
                if length >= self.window:
                    full.setdefault(self._of_length(state, self.window), set()).add(key)
            if len(code) < self.window:
                short.setdefault(self._of_length(state, len(code)), []).append((len(code), key))
        # What a state inherits from its suffixes, shortest states first.
        self.windows: list[tuple[str, ...]] = [()] * len(self.link)
        self.ends: list[tuple[tuple[int, str], ...]] = [()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            above = self.link[s]
            self.windows[s] = tuple(sorted(full[s])) if s in full else self.windows[above]
            self.ends[s] = self.ends[above] + tuple(sorted(short.get(s, ())))

    def _of_length(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def find(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges covered by windows, and the items they belong to."""
        known = np.fromiter(map(self.vocabulary.get, ws, iter(lambda: -1, 0)), dtype=np.int64, count=len(ws))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known >= 0, [0]))))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for start, end in edges.reshape(-1, 2).tolist():
            if end - start < self.shortest:
                continue
            for at, state, length in self.steps(known[start:end].tolist()):
                if length >= self.window and self.windows[state]:
                    found.update(self.windows[state])
                    spans.append((start + at + 1 - self.window, start + at + 1))
                for n, key in self.ends[state]:
                    if n <= length:
                        found.add(key)
                        spans.append((start + at + 1 - n, start + at + 1))
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    kept, last = [], 0
    for start, end in spans:
        kept.append(text[last : at[start][0]])
        last = at[end - 1][1]
    return b"".join([*kept, text[last:]])


def item_blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items with words, in blocks of about ``block_words`` words, read one after another."""
    block, size = [], 0
    rows = benchmark.select(F.col(item).cast("string"), F.col(text).cast("string")).toLocalIterator()
    for key, value in rows:
        ws = words(value.encode()) if value is not None else []
        if ws and key is not None:
            block.append((key, ws))
            size += len(ws)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, coverage: float = COVERAGE, text: str = "text",
    item: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: ``keep`` columns, then ``n_words``, ``n_hit``, ``items``, ``clean_text``, ``rejected``.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window. ``n_hit`` counts the
    words of a document inside any occurrence, ``items`` lists the items (sorted as text), ``clean_text`` is the text
    without those words and what stands between them, and ``rejected`` says that ``n_hit`` reaches ``coverage`` of
    the words. A null text has no words, and stays null; items without id or words match nothing; items that share an
    id count as one. An empty benchmark leaves every document as it is.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    blocks = item_blocks(benchmark, item, item_text, block_words) if benchmark is not None else iter(())
    items, more = next(blocks, []), next(blocks, None)
    if more is None:

        def make():
            automaton = Automaton(items, window)

            def work(texts):
                out = {name: [] for name in ("n_words", "n_hit", "items", "clean_text", "rejected")}
                for value in texts:
                    ws = words(value)
                    spans, keys = automaton.find(ws)
                    spans = merged(spans)
                    hit = sum(b - a for a, b in spans)
                    out["n_words"].append(len(ws))
                    out["n_hit"].append(hit)
                    out["items"].append(sorted(keys))
                    out["clean_text"].append(_without(value, spans) if spans else value)
                    out["rejected"].append(bool(ws) and hit > 0 and hit >= coverage * len(ws))
                return out

            return work

        spec = {"n_words": "long", "n_hit": "long", "items": "strings", "clean_text": "string", "rejected": "boolean"}
        return map_texts(docs, make, spec, keep, text)

    # A long benchmark: the documents pass one automaton after another and carry what was found. Each pass is written,
    # so that no task holds two automata.
    lists = {"__items": "array<string>", "__starts": "array<bigint>", "__ends": "array<bigint>"}
    columns = [*keep, "__body", *lists]
    carried = docs.select(*keep, F.col(text).alias("__body"), *(F.array().cast(kind).alias(name) for name, kind in lists.items()))

    def passed(df: DataFrame, items: list[tuple[str, list[bytes]]]) -> DataFrame:
        def make():
            automaton = Automaton(items, window)

            def work(texts):
                found = [automaton.find(words(value)) for value in texts]
                spans = [merged(ranges) for ranges, _ in found]
                return {"__i": [sorted(keys) for _, keys in found], "__s": [[a for a, _ in x] for x in spans], "__e": [[b for _, b in x] for x in spans]}

            return work

        seen = map_texts(df, make, {"__i": "strings", "__s": "longs", "__e": "longs"}, columns, "__body")
        return stored(seen.select(
            *keep, "__body", F.array_union("__items", "__i").alias("__items"),
            F.concat("__starts", "__s").alias("__starts"), F.concat("__ends", "__e").alias("__ends"),
        ), "passed")

    carried = reduce(passed, chain([items, more], blocks), carried)  # each block is read when its pass begins

    def finish(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.select(["__body", "__items", "__starts", "__ends"]).to_pylist()
            out = {name: [] for name in ("n_words", "n_hit", "items", "clean_text", "rejected")}
            for r in rows:
                value = None if r["__body"] is None else r["__body"].encode()
                n = len(words(value))
                spans = merged(list(zip(r["__starts"], r["__ends"], strict=True)))
                hit = sum(b - a for a, b in spans)
                out["n_words"].append(n)
                out["n_hit"].append(hit)
                out["items"].append(sorted(r["__items"]))
                out["clean_text"].append(_without(value, spans).decode() if spans else r["__body"])
                out["rejected"].append(n > 0 and hit > 0 and hit >= coverage * n)
            made = [pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(out["items"], pa.list_(pa.string())),
                    pa.array(out["clean_text"], pa.string()), pa.array(out["rejected"], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *made], names=[*keep, *out])

    schema = carried.select(*keep).withColumns({
        "n_words": F.lit(None).cast("bigint"), "n_hit": F.lit(None).cast("bigint"), "items": F.lit(None).cast("array<string>"),
        "clean_text": F.lit(None).cast("string"), "rejected": F.lit(None).cast("boolean"),
    }).schema
    return carried.mapInArrow(finish, schema)
