"""Byte-level byte-pair encoding and decoding by a file of ranks.

A text is split by the tokenizer's pattern, and each piece is merged by itself. A segment tree over the byte positions of
a piece holds, for every live symbol, the rank of its pair with the next one; its root is the leftmost least rank. A merge
takes the right symbol out and writes new ranks for the two pairs around it, each a path of logarithmic length to the
root. Pieces that were not seen before are merged many at a time, a row of arrays for each; long ones by themselves. Texts
are encoded where they are read: no shuffle, and a bounded memory of pieces.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterable, Mapping
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseframe.llm.common import map_texts

#: Pieces whose ids a Python worker remembers, and bytes of the longest such piece.
REMEMBERED, LONGEST = 400_000, 64
#: Bytes of the pieces that are merged together, by width of their trees, and such pieces at once.
WIDTHS, AT_ONCE = (8, 16, 32, 64), 1 << 15
_SHIFT, _PLACE, _NONE = 32, (1 << 32) - 1, 1 << 62


def merged(piece: bytes, ranks: Mapping[bytes, int]) -> list[bytes]:
    """The symbols that a piece ends up as: again and again the pair of least rank, leftmost first, becomes one."""
    n, get = len(piece), ranks.get
    if n < 2:
        return [piece] if n else []
    leaves = n - 1  # the pair that begins at byte i is leaf i, at place leaves + i
    found = [get(piece[at : at + 2]) for at in range(leaves)]
    tree = [_NONE] * leaves + [_NONE if rank is None else rank << _SHIFT | at for at, rank in enumerate(found)]
    for node in range(leaves - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree[1]) != _NONE:
        at = least & _PLACE
        gone = ends[at]
        ends[at] = end = ends[gone]
        x = y = z = leaves + at
        if gone < leaves:
            z = leaves + gone
            tree[z] = _NONE
        if end < n:
            before[end] = at
            rank = get(piece[at : ends[end]])
            tree[y] = _NONE if rank is None else rank << _SHIFT | at
        else:
            tree[y] = _NONE
        if (start := before[at]) >= 0:
            x = leaves + start
            rank = get(piece[start:end])
            tree[x] = _NONE if rank is None else rank << _SHIFT | start
        while x > 1 or z > 1:  # the three paths to the root, which soon meet
            x >>= 1
            y >>= 1
            z >>= 1
            if x:
                left, right = tree[2 * x], tree[2 * x + 1]
                tree[x] = left if left < right else right
            if y and y != x:
                left, right = tree[2 * y], tree[2 * y + 1]
                tree[y] = left if left < right else right
            if z and z != y:
                left, right = tree[2 * z], tree[2 * z + 1]
                tree[z] = left if left < right else right
    out, at = [], 0
    while at < n:
        out.append(piece[at : ends[at]])
        at = ends[at]
    return out


def spaces_as_in_unicode(pattern: str) -> str:
    r"""The pattern with ``\s`` and ``\S`` as Unicode's White_Space, which leaves out the separators \x1c to \x1f."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class PairRanks:
    """The rank of each pair of tokens whose bytes together are a token: a table with open addressing."""

    def __init__(self, ranks: Mapping[bytes, int]):
        rows = [
            (left, right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        ]
        lefts, rights, self.made = np.array(rows, np.int64).reshape(-1, 3).T
        self.count = np.int64(max(ranks.values(), default=0) + 2)
        codes = lefts * self.count + rights
        bits = max(int(4 * len(codes)).bit_length(), 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.codes, self.slots = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left, at, self.probes = np.arange(len(codes)), self._place(codes), 0
        while len(left):  # those that find a free place take it, the first of several; the others go one place on
            self.probes += 1
            free = left[self.codes[at[left]] < 0]
            self.codes[at[free]] = codes[free]
            here = self.codes[at[left]] == codes[left]
            self.slots[at[left[here]]] = self.made[left[here]]
            left = left[~here]
            at[left] = (at[left] + 1) & self.mask

    def _place(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where there is none; a negative token has none."""
        codes = np.where((left < 0) | (right < 0), np.int64(-2), left * self.count + right)
        at = self._place(codes)
        found = np.where(self.codes[at] == codes, self.slots[at], -1)
        rest = np.flatnonzero((found < 0) & (self.codes[at] >= 0) & (codes >= 0))
        for _ in range(self.probes - 1):
            if not len(rest):
                break
            at[rest] = (at[rest] + 1) & self.mask
            held = self.codes[at[rest]]
            hit = held == codes[rest]
            found[rest[hit]] = self.slots[at[rest[hit]]]
            rest = rest[~hit & (held >= 0)]
        return found


def merged_together(pieces: list[bytes], pairs: PairRanks, of_byte: np.ndarray, width: int) -> list[tuple[int, ...]]:
    """The ids of pieces of at most ``width`` bytes (a power of two): the trees of all are rows of one array."""
    count, bits, none = len(pieces), width.bit_length() - 1, np.int32((1 << 31) - 1)
    sizes = np.fromiter(map(len, pieces), np.int64, count)
    place = np.arange(width + 1)
    tokens = np.full((count, width + 1), -1, np.int64)
    tokens[place < sizes[:, None]] = of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    ends, before = np.tile(place + 1, (count, 1)), np.tile(place - 1, (count, 1))
    keyed = lambda rank, at: np.where(rank < 0, none, rank << bits | at).astype(np.int32)
    tree = np.full((count, 2 * width), none, np.int32)
    tree[:, width:] = keyed(pairs.of(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(count, width).astype(np.int64), place[:-1])
    level = width
    while level > 1:
        tree[:, level // 2 : level] = tree[:, level : 2 * level].reshape(count, -1, 2).min(axis=2)
        level //= 2
    tokens, ends, before, tree = tokens.ravel(), ends.ravel(), before.ravel(), tree.ravel()
    row = np.arange(count)
    while True:
        least = tree[row * (2 * width) + 1]
        row, least = row[least != none], least[least != none]
        if not len(row):
            break
        base, root = row * (width + 1), row * (2 * width)
        at, made = (least & (width - 1)).astype(np.int64), (least >> bits).astype(np.int64)
        gone = ends[base + at]
        end = ends[base + gone]
        start = before[base + at]
        tokens[base + at], tokens[base + gone] = made, -1
        ends[base + at] = end
        before[base + np.minimum(end, width)] = at
        after = np.where(end < sizes[row], tokens[base + np.minimum(end, width)], -1)
        ahead = np.where(start >= 0, tokens[base + np.maximum(start, 0)], -1)
        both = pairs.of(np.concatenate((made, ahead)), np.concatenate((after, made))).astype(np.int64)
        paths = [width + at, np.where(gone < width, width + gone, width + at), np.where(start >= 0, width + start, width + at)]
        tree[root + paths[1]] = none
        tree[root + paths[2]] = keyed(both[len(row) :], start)
        tree[root + paths[0]] = keyed(both[: len(row)], at)
        for _ in range(bits):
            for i, path in enumerate(paths):
                paths[i] = path >> 1
                child = root + (path & ~1)
                tree[root + paths[i]] = np.minimum(tree[child], tree[child + 1])
    live = tokens.reshape(count, width + 1) >= 0
    flat, cuts = tokens[live.ravel()].tolist(), np.concatenate(([0], np.cumsum(live.sum(axis=1)))).tolist()
    return [tuple(flat[a:b]) for a, b in zip(cuts, cuts[1:])]


class ByteBpe:
    """Encoder and decoder of one vocabulary: bytes of each token, with the id that is also its rank."""

    def __init__(self, ranks: Mapping[bytes, int], pattern: str):
        self.ranks = dict(ranks)
        self.bytes_of = {i: token for token, i in self.ranks.items()}
        self.pairs = PairRanks(self.ranks)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.split = regex.compile(spaces_as_in_unicode(pattern)).findall
        self.seen: dict[str, tuple[int, ...]] = {}

    def pieces(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of matches of the pattern; a piece that is a token is this token."""
        out, wide = {}, {width: [] for width in WIDTHS}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                out[piece] = (whole,)
            elif len(raw) > WIDTHS[-1]:
                out[piece] = tuple(map(self.ranks.__getitem__, merged(raw, self.ranks)))
            else:
                wide[next(width for width in WIDTHS if len(raw) <= width)].append((piece, raw))
        for width, found in wide.items():
            for i in range(0, len(found), AT_ONCE):
                some = found[i : i + AT_ONCE]
                coded = merged_together([raw for _, raw in some], self.pairs, self.of_byte, width)
                out.update(zip((piece for piece, _ in some), coded))
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        found = [self.split(text) for text in texts]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        fresh = set(chain.from_iterable(found)).difference(self.seen)
        once = {}
        if fresh:
            once = self.pieces(fresh)
            self.seen.update((piece, ids) for piece, ids in once.items() if len(piece) <= LONGEST)
            once = {piece: ids for piece, ids in once.items() if len(piece) > LONGEST}
        get = self.seen.__getitem__ if not once else lambda piece: self.seen[piece] if len(piece) <= LONGEST else once[piece]
        return [list(chain.from_iterable(map(get, pieces))) for pieces in found]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        """The bytes of the ids, one after another; unknown and null ids are left out."""
        get = self.bytes_of.get
        return b"".join(filter(None, map(get, ids)))


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a file of ranks: a line has a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def printable_bytes() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict[bytes, int]:
    """The tokens of a byte-level vocabulary in JSON, special ones left out; ids must follow the order of the merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special, place = {t["id"] for t in spec["added_tokens"]}, printable_bytes()
    found = {bytes(place[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
    last = 0
    for pair in spec["model"]["merges"]:
        made = found[bytes(place[c] for c in ("".join(pair) if isinstance(pair, list) else pair.replace(" ", "")))]
        if made <= last:
            raise ValueError(f"{path}: ids do not follow the order of the merges")
        last = made
    return found


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One per Python worker, file and pattern."""
    return ByteBpe(read_vocabulary(path) if path.endswith(".json") else read_ranks(path), pattern)


def _kept(docs: DataFrame, text: str, keep: list[str] | None) -> list[str]:
    return [c for c in docs.columns if c != text] if keep is None else keep


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``keep`` columns (all but the text by default), ``n_tokens`` and ``token_ids``.

    ``path`` names the file, which every worker reads. Strings of special tokens are plain text. A null or empty text has
    no tokens; bytes that are not UTF-8 count as U+FFFD. Rows are independent: repeated rows, null ids and further columns
    change nothing, and a kept column of the name of a new one gives way to it.
    """

    def make():
        bpe = tokenizer(path, pattern)

        def work(texts):
            coded = bpe.encode_all([(value or b"").decode(errors="replace") for value in texts])
            return {"n_tokens": [len(ids) for ids in coded], "token_ids": coded}

        return work

    return map_texts(docs, make, {"n_tokens": "long", "token_ids": "longs"}, _kept(docs, text, keep), text)


def decode(rows: DataFrame, path: str, pattern: str, *, ids: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``decoded`` (binary), the bytes of an array of ids; a null array gives no bytes."""
    keep = [c for c in (_kept(rows, ids, keep)) if c != "decoded"]
    source = rows.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{ids}`").cast("array<bigint>").alias("__ids"))
    schema = T.StructType([*(source.schema[k] for k in keep), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        bpe = tokenizer(path, pattern)
        for batch in batches:
            found = pa.array([bpe.decode(x or ()) for x in batch.column(len(keep)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found], names=[*keep, "decoded"])

    return source.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``keep`` columns, ``n_tokens``, and SHA-256 of the ids and of the bytes decoded from them.

    ``ids_sha256`` is that of the decimal ids with a space between two. Both are made where the text is encoded, so that
    neither list leaves the worker. Nulls and the rest as in ``encode``.
    """

    def make():
        bpe = tokenizer(path, pattern)
        decimal = {i: str(i) for i in bpe.bytes_of}.__getitem__

        def work(texts):
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for ids in bpe.encode_all([(value or b"").decode(errors="replace") for value in texts]):
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return out

        return work

    spec = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return map_texts(docs, make, spec, _kept(docs, text, keep), text)
