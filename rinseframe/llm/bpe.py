"""Byte-pair encoding and decoding with the file of a public word-level tokenizer.

Each word is a doubly linked list of symbols; a priority queue holds the ranks of the merges that neighbouring
symbols allow. The lowest rank, leftmost first, is merged, its new neighbours are queued, and entries whose symbols
have changed meanwhile are skipped. Texts are encoded where they are read: no shuffle, and a bounded memory of words.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from rinseframe.llm.common import map_texts

#: Words whose ids a Python worker remembers.
REMEMBERED = 400_000

# White space as the tokenizer's own pattern language has it (not the separators \x1c-\x1f).
_SPACE = "\t-\r \x85\xa0  -     　"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one tokenizer file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocabulary.items()} | {i: s for s, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocabulary[left], self.vocabulary[right]] = (rank, self.vocabulary[left + right])
        letters, suffix = _byte_letters(), model["end_of_word_suffix"]
        self.inner = [self.vocabulary[c] for c in letters]
        self.final = [self.vocabulary[c + suffix] for c in letters]
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.seen: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        symbols = [self.inner[b] for b in word[:-1]] + [self.final[word[-1]]]
        n, merges = len(symbols), self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(*merges[pair], at, *pair) for at in range(n - 1) if (pair := (symbols[at], symbols[at + 1])) in merges]
        queue = [(rank, at, made, left, right) for rank, made, at, left, right in queue]
        heapq.heapify(queue)
        while queue:
            _, at, made, left, right = heapq.heappop(queue)
            then = after[at]
            if symbols[at] != left or then == -1 or symbols[then] != right:
                continue  # stale
            symbols[at], symbols[then] = made, -1
            after[at] = end = after[then]
            if end != -1:
                before[end] = at
                if (pair := (made, symbols[end])) in merges:
                    rank, new = merges[pair]
                    heapq.heappush(queue, (rank, at, new, *pair))
            if (start := before[at]) != -1 and (pair := (symbols[start], made)) in merges:
                rank, new = merges[pair]
                heapq.heappush(queue, (rank, start, new, *pair))
        return tuple(s for s in symbols if s != -1)

    def _plain(self, text: str, out: array.array) -> None:
        if not text.isascii():
            # Letters are lowered one by one: no rule for a sigma at the end of a word.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        seen = self.seen
        for word in _WORD.findall(text.lower()):
            ids = seen.get(word)
            if ids is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                ids = self.merge(word.encode())
                if len(word) < 64:
                    seen[word] = ids
            out.extend(ids)

    def encode(self, text: str) -> array.array:
        """The ids of a text; the strings of special tokens in it become their ids."""
        out = array.array("I")
        if self.split is None:
            self._plain(text, out)
            return out
        for at, piece in enumerate(self.split.split(text)):
            if at % 2:
                out.append(self.special[piece])
            elif piece:
                self._plain(piece, out)
        return out

    def decode(self, ids) -> str:
        """The vocabulary strings of the ids, a space between two; unknown ids are left out."""
        get = self.strings.get
        return " ".join(s for s in map(get, ids) if s is not None)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """One per Python worker and file."""
    return WordBpe(path)


def little_endian(ids: array.array) -> bytes:
    if sys.byteorder == "big":
        ids = array.array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode(docs: DataFrame, path: str, *, text: str = "text", keep: list[str] | None = None, decoded: bool = True) -> DataFrame:
    """One row per document: ``keep`` columns, ``n_tokens``, ``token_ids`` (array) and, if asked for, ``decoded``.

    ``path`` names the tokenizer's file, which every worker reads. A null text counts as empty: no tokens, and
    empty decoded text. Rows are independent: repeated ids, null ids and further columns change nothing.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    spec = {"n_tokens": "long", "token_ids": "longs"} | ({"decoded": "string"} if decoded else {})

    def make():
        bpe = tokenizer(path)

        def work(texts):
            coded = [bpe.encode((value or b"").decode()) for value in texts]
            out = {"n_tokens": [len(c) for c in coded], "token_ids": coded}
            if decoded:
                out["decoded"] = [bpe.decode(c) for c in coded]
            return out

        return work

    return map_texts(docs, make, spec, keep, text)


def digests(docs: DataFrame, path: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``keep`` columns, ``n_tokens`` and the SHA-256 of ids and decoded text.

    ``ids_sha256`` is that of the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` that of the decoded
    text in UTF-8. Made where the text is encoded, so that neither leaves the worker. Nulls as in ``encode``.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep

    def make():
        bpe = tokenizer(path)

        def work(texts):
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for value in texts:
                ids = bpe.encode((value or b"").decode())
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(little_endian(ids)).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return out

        return work

    return map_texts(docs, make, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, keep, text)


def decode(rows: DataFrame, path: str, *, ids: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``decoded``, the text of an array of ids; a null array gives empty text."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    keep = [c for c in rows.columns if c not in (ids, "decoded")] if keep is None else [c for c in keep if c != "decoded"]
    source = rows.select(*keep, F.col(ids).cast("array<bigint>").alias("__ids"))
    schema = T.StructType([*(source.schema[k] for k in keep), T.StructField("decoded", T.StringType())])

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            texts = [bpe.decode(x or ()) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return source.mapInArrow(run, schema)
