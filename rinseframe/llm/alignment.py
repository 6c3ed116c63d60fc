"""How the tokens of two tokenizers lie to each other, over a whole table of texts.

Both encode the same bytes: a byte-level vocabulary (A) and a piece vocabulary (B). Byte offsets where a token of each ends
cut a text into groups, and the two tokens that end a group are linked. Most groups are one token to one token with the
same bytes: a table made once names, for each A id, the B id of the same bytes, and these groups are counted in a vector as
long as the vocabulary, one for a task. Only the links of the other groups are counted by a shuffle of pairs, as postings:
a row for each pair and chunk of documents, so that a pair which is everywhere has no more rows than there are chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseframe.llm import bytebpe
from rinseframe.llm.common import TEXT, arrays, fields, parts, stored

_DOC, _POSTING, _VECTOR = 0, 1, 2
_ROW = {
    "kind": "int", "chunk": "long", "place": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long",
    "groups_sha256": "string", "code": "long", "total": "long", "ids": "longs", "times": "longs",
}
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
OUT = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "n_best": "long", "count_sum": "long", "groups_sha256": "string"}


class PieceTokenizer:
    """A vocabulary of pieces that writes blanks as U+2581 and puts one before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(pieces)
        ]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Two tokenizers, and the table from A ids to B ids of the same bytes (-1 where there is none)."""

    def __init__(self, path_a: str, pattern: str, path_b: str):
        self.a, self.b = bytebpe.tokenizer(path_a, pattern), PieceTokenizer(path_b)
        self.size_a, self.size_b = max(self.a.bytes_of) + 1, len(self.b.bytes_of)
        known: dict[bytes, int] = {}
        for i, token in enumerate(self.b.bytes_of):
            if token not in known or self.b.model.is_byte(known[token]):  # a piece goes before a single byte's fallback
                known[token] = i
        self.same = np.full(self.size_a, -1, np.int64)
        self.length_a = np.zeros(self.size_a, np.int64)
        for i, token in self.a.bytes_of.items():
            self.same[i], self.length_a[i] = known.get(token, -1), len(token)
        self.length_b = np.array([len(token) for token in self.b.bytes_of], np.int64)
        if not all(self.a.bytes_of.values()) or not self.length_b.all():
            raise ValueError("a token without bytes cannot be aligned")
        shown = lambda n, last: np.array([f"{i}{mark}" for i in range(n) for mark in (",", last)], object)
        self.shown_a, self.shown_b = shown(self.size_a, "|"), shown(self.size_b, ";")

    def encode_all(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both for each text; none where either's bytes are not the text after a blank."""
        coded_a, coded_b = self.a.encode_all([" " + text if text else "" for text in texts]), self.b.encode_all(texts)
        bytes_a, bytes_b = self.a.bytes_of.__getitem__, self.b.bytes_of.__getitem__
        for i, text in enumerate(texts):
            whole = (" " + text).encode()
            if not text or b"".join(map(bytes_b, coded_b[i])) != whole or b"".join(map(bytes_a, coded_a[i])) != whole:
                coded_a[i], coded_b[i] = [], []
        return coded_a, coded_b

    def align(self, texts: list[str]) -> dict[str, list]:
        """For each text its counts, the groups as text, and its links: identical ones as A ids, others as pair codes."""
        coded_a, coded_b = self.encode_all(texts)
        n_a, n_b = ([len(ids) for ids in coded] for coded in (coded_a, coded_b))
        a, b = (np.fromiter(chain.from_iterable(coded), np.int64, sum(n)) for coded, n in ((coded_a, n_a), (coded_b, n_b)))
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        at = np.searchsorted(end_b, end_a)
        meets = end_b[np.minimum(at, len(b) - 1)] == end_a if len(b) else np.zeros(0, bool)
        last_a, last_b = np.flatnonzero(meets), at[meets]  # the tokens that end a group
        link_a, link_b = a[last_a], b[last_b]
        alone = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1)
        identical = alone & (self.same[link_a] == link_b)

        stops_a, stops_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        stops_a[last_a], stops_b[last_b] = 1, 1
        group_a, group_b = np.cumsum(stops_a) - stops_a, np.cumsum(stops_b) - stops_b
        shown = np.empty(len(a) + len(b), object)
        shown[np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]] = self.shown_a[2 * a + stops_a]
        if len(b):
            shown[np.arange(len(b)) + last_a[group_b] + 1] = self.shown_b[2 * b + stops_b]
        shown = shown.tolist()

        cut_a, cut_b = np.concatenate(([0], np.cumsum(n_a, dtype=np.int64))), np.concatenate(([0], np.cumsum(n_b, dtype=np.int64)))
        cut_links = np.searchsorted(last_a, cut_a).tolist()
        cut_shown = (cut_a + cut_b).tolist()
        codes = link_a * self.size_b + link_b
        out: dict[str, list] = {"n_a": n_a, "n_b": n_b, "n_links": [], "groups": [], "identical": [], "others": []}
        for i in range(len(texts)):
            x, y = cut_links[i], cut_links[i + 1]
            out["n_links"].append(y - x)
            out["groups"].append("".join(shown[cut_shown[i] : cut_shown[i + 1]])[:-1])
            out["identical"].append(link_a[x:y][identical[x:y]])
            out["others"].append(codes[x:y][~identical[x:y]])
        return out


@lru_cache(maxsize=1)
def aligner(path_a: str, pattern: str, path_b: str) -> Aligner:
    """One per Python worker."""
    return Aligner(path_a, pattern, path_b)


def _aligned(docs: DataFrame, paths: tuple[str, str, str], text: str, kept: list[str]) -> DataFrame:
    """Rows of documents, rows of pairs with the places in their chunk, and each task's vector."""
    held = F.struct(F.lit(None).cast("int").alias("__none"), *(F.col(f"`{name}`") for name in kept)).alias("kept")
    source = docs.select(held, F.col(f"`{text}`").cast("string").cast("binary").alias(TEXT))
    schema = T.StructType([T.StructField("kept", source.schema["kept"].dataType), *fields(_ROW)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*paths)
        vector, chunk, kind = np.zeros(both.size_a, np.int64), TaskContext.get().partitionId() << 36, None

        def made(n: int, kept: pa.Array | None, **columns: list) -> pa.RecordBatch:
            whole = arrays(_ROW, {name: columns.get(name, [None] * n) for name in _ROW})
            return pa.RecordBatch.from_arrays([pa.nulls(n, kind) if kept is None else kept, *whole], names=["kept", *_ROW])

        for batch in batches:
            kind = batch.schema.field("kept").type
            for part in parts(batch, TEXT):
                texts = [(value or b"").decode(errors="replace") for value in part.column(TEXT).to_pylist()]
                found, n = both.align(texts), len(texts)
                ids, times = zip(*(np.unique(x, return_counts=True) for x in found["identical"]))
                vector += np.bincount(np.concatenate(found["identical"]), minlength=len(vector))
                yield made(
                    n, part.column("kept"), kind=[_DOC] * n, chunk=[chunk] * n, place=list(range(n)), n_a=found["n_a"],
                    n_b=found["n_b"], n_groups=found["n_links"], n_links=found["n_links"], ids=ids, times=times,
                    groups_sha256=[hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found["groups"]],
                )
                codes = np.concatenate(found["others"])
                place = np.repeat(np.arange(n), [len(x) for x in found["others"]])
                if len(codes):
                    order = np.lexsort((place, codes))
                    codes, place = codes[order], place[order]
                    first = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (place[1:] != place[:-1]))))
                    codes, place, times = codes[first], place[first], np.diff(first, append=len(codes))
                    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                    m = len(starts)
                    yield made(
                        m, None, kind=[_POSTING] * m, chunk=[chunk] * m, code=codes[starts], total=np.add.reduceat(times, starts),
                        ids=np.split(place, starts[1:]), times=np.split(times, starts[1:]),
                    )
                chunk += 1
        if vector.any():
            ids = np.flatnonzero(vector)
            yield made(1, None, kind=[_VECTOR], ids=[ids], times=[vector[ids]])

    return source.mapInArrow(run, schema)


def align(docs: DataFrame, path_a: str, pattern: str, path_b: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``keep`` columns (all but the text by default) and how its tokens are aligned.

    ``n_a`` and ``n_b`` are tokens, ``n_groups`` groups, ``n_links`` links (pairs of tokens that end together). A pair of ids
    counts as often as it is linked in the whole table: ``n_best`` are links whose count is the highest of their B id, ties
    included, ``count_sum`` is the sum of the counts over the links. ``groups_sha256`` is that of the groups as decimal ids,
    ``a1,a2|b1;a3|b2``. A text that is null or empty, or that a tokenizer does not give back as a blank and the text,
    has no tokens: zeros and an empty string. Bytes that are not UTF-8 count as U+FFFD. Repeated rows are counted as often
    as they stand there; null ids and further columns change nothing; a kept column of the name of a new one gives way to it.

    The table of aligned documents is written to the shared folder. Of the counts only those of identical tokens and the
    highest of each B id come to the driver and go to all tasks: a number for each id of a vocabulary, whatever the table.
    """
    kept = [name for name in docs.columns if name != text] if keep is None else keep
    kept = [name for name in kept if name not in OUT]
    paths, spark = (path_a, pattern, path_b), docs.sparkSession
    both = aligner(*paths)
    table = stored(_aligned(docs, paths, text, kept), "aligned")

    vector = np.zeros(both.size_a, np.int64)
    summed = table.where(F.col("kind") == _VECTOR).select(F.explode(F.arrays_zip("ids", "times")).alias("x"))
    for a, n in summed.groupBy("x.ids").agg(F.sum("x.times")).toLocalIterator():
        vector[a] = n
    pairs = stored(table.where(F.col("kind") == _POSTING).groupBy("code").agg(F.sum("total").alias("n")), "pairs")
    best = np.zeros(both.size_b, np.int64)
    of_b = F.pmod("code", F.lit(both.size_b))
    for b, n in pairs.groupBy(of_b.alias("b")).agg(F.max("n")).toLocalIterator():
        best[b] = n
    there = np.flatnonzero((both.same >= 0) & (vector > 0))
    np.maximum.at(best, both.same[there], vector[there])

    highest = np.flatnonzero(best)
    bests = spark.createDataFrame(pa.table({"b": highest, "best": best[highest]}).to_pandas(), "b long, best long")
    judged = pairs.withColumn("b", of_b).join(F.broadcast(bests), "b").select("code", "n", (F.col("n") == F.col("best")).alias("top"))
    postings = table.where(F.col("kind") == _POSTING).select("chunk", "code", "ids", "times").join(judged, "code")

    sent = spark.sparkContext.broadcast((vector, np.where(both.same >= 0, vector == best[both.same], False)))
    docs_of = table.where(F.col("kind") == _DOC).select("chunk", "place", "kept", *_COUNTS, "groups_sha256", "ids", "times")
    carried = ["place", "kept", *_COUNTS, "groups_sha256"]
    schema = T.StructType([*(docs_of.schema[c] for c in ("chunk", *carried)), *fields({"n_best": "long", "count_sum": "long"})])

    def of_identical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tops = sent.value
        for batch in batches:
            n_best, count_sum = [], []
            for ids, times in zip(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("ids", "times"))):
                ids = ids.astype(np.int64)
                n_best.append(int(times[tops[ids]].sum()))
                count_sum.append(int((times * counts[ids]).sum()))
            columns = [batch.column(c) for c in ("chunk", *carried)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=schema.names)

    def with_others(found: pa.Table, postings: pa.Table) -> pa.Table:
        n_best, count_sum = (found.column(c).to_numpy().copy() for c in ("n_best", "count_sum"))
        if postings.num_rows:
            place, times = (np.concatenate(postings.column(c).to_numpy(zero_copy_only=False)) for c in ("ids", "times"))
            sizes = pa.compute.list_value_length(postings.column("ids")).to_numpy()
            rows = found.column("place").to_numpy()
            row_of = np.zeros(int(rows.max()) + 1, np.int64)
            row_of[rows] = np.arange(len(rows))
            np.add.at(n_best, row_of[place], times * np.repeat(postings.column("top").to_numpy().astype(np.int64), sizes))
            np.add.at(count_sum, row_of[place], times * np.repeat(postings.column("n").to_numpy(), sizes))
        columns = [found.column(c) for c in carried]
        return pa.table([*columns, pa.array(n_best), pa.array(count_sum)], names=[*carried, "n_best", "count_sum"])

    first = docs_of.mapInArrow(of_identical, schema)
    whole = first.groupBy("chunk").cogroup(postings.groupBy("chunk")).applyInArrow(with_others, T.StructType(schema.fields[1:]))
    return whole.select(*(F.col(f"kept.`{name}`").alias(name) for name in kept), *OUT)
