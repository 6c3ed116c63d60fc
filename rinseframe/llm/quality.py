"""Text quality by an interpolated modified Kneser-Ney model of characters, trained on trusted documents.

Documents are dealt into two halves. The trusted text of each half is a model's, and a document is scored by the model of the
other half: all trusted text is counted, and all of it is unseen where thresholds are taken from it. Counts are summed
before they move; continuation counts, discounts and interpolated probabilities are joins and aggregations of the count
tables, order by order. The finished model is cut into shards by a hash of the whole context, so that no shard
is larger than a bound; documents are scored where they are read, one shard after another, from the longest n-grams down.
A document is held against three quantiles of trusted documents of its language: of its perplexity, of that of its
worst window, and of how many of the n-grams of a window differ, as text that repeats itself has few.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseframe.llm.common import TEXT, arrays, fields, parts, remainder, stored

#: Characters in the longest n-gram, entries of a shard, and trusted ids that are sent to all executors at most.
ORDER, SHARD, MOST_SENT = 5, 4_000_000, 2_000_000
#: The share of unseen trusted documents of a language beyond each threshold: perplexity, worst window, least variety.
BEYOND = (0.005, 0.008, 0.003)
#: Characters of a step, and steps of a window.
STEP, STEPS = 32, 8
_START, _END = 2, 3
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Keeps apart the keys of the two models, and weights of contexts from probabilities.
_MODEL, _WEIGHT = np.uint64(0xA24BAED4963EE407), np.uint64(0x8CB92BA72F3D8DD7)


def points(text: bytes | None) -> np.ndarray:
    """Characters of a text, lowered, digits alike and white space single, between boundary marks."""
    body = np.frombuffer(" ".join((text or b"").decode().lower().split()).encode("utf-32-le"), dtype=np.uint32)
    body = np.where((body >= 48) & (body < 58), np.uint32(48), body)
    return np.concatenate((np.full(ORDER - 1, _START, np.uint32), body, np.array([_END], np.uint32))).astype(np.uint64)


def codes(chars: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n characters."""
    out = np.full(max(len(chars) - n + 1, 0), n * 0xD6E8FEB86659FD93 % (1 << 64), dtype=np.uint64)
    for i in range(n):
        out = (out ^ chars[i : i + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _of_rows(chars: np.ndarray) -> np.ndarray:
    """The same hash of each row of characters."""
    out = np.full(len(chars), chars.shape[1] * 0xD6E8FEB86659FD93 % (1 << 64), dtype=np.uint64)
    for i in range(chars.shape[1]):
        out = (out ^ chars[:, i]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _text(chars: np.ndarray) -> str:
    return chars.astype(np.uint32).tobytes().decode("utf-32-le")


def counts(texts: DataFrame, text: str, model: Column | None = None) -> DataFrame:
    """(m, g, c): how often each run of ORDER characters occurs, by model. Parts are summed before anything moves."""
    body = F.col(f"`{text}`").cast("string").cast("binary").alias(TEXT)
    source = texts.select((F.lit(0) if model is None else model).cast("int").alias("m"), body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, TEXT):
                own = [points(value) for value in part.column(TEXT).to_pylist()]
                chars = np.concatenate(own)
                lengths = np.array([len(o) for o in own])
                models = np.repeat(part.column("m").to_numpy().astype(np.uint64), lengths)
                ends = np.cumsum(lengths)
                inside = np.ones(len(chars), dtype=bool)
                for back in range(1, ORDER):  # runs that would reach into the next text
                    inside[ends - back] = False
                places = np.flatnonzero(inside)
                places = places[places <= len(chars) - ORDER]
                keys = codes(chars, ORDER)[places] ^ (models[places] * _MODEL)
                _, first, n = np.unique(keys, return_index=True, return_counts=True)
                all_ = _text(chars)
                found = [all_[p : p + ORDER] for p in places[first].tolist()]
                columns = [pa.array(models[places[first]].astype(np.int32)), pa.array(found, pa.string()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["m", "g", "c"])

    return source.mapInArrow(run, "m int, g string, c long").groupBy("m", "g").agg(F.sum("c").alias("c"))


def _discount(table: DataFrame) -> Column:
    """Discounts for counts of one, two, and three or more, by model."""
    out = F.lit(0.5)
    for row in table.groupBy("m").agg(*(F.sum((F.col("c") == i).cast("int")) for i in range(1, 5))).collect():
        m, *found = row
        n = [0, *(x or 0 for x in found)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        made = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 for i in range(1, 4)]
        d = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(made, 1)]
        own = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        out = F.when(F.col("m") == m, own).otherwise(out)
    return out


def estimate(grams: DataFrame) -> DataFrame:
    """(m, g, logp, bow) of all orders: the interpolated probability of an n-gram's last character, and the weight that
    it has as a context for what it was not seen with. The empty n-gram has the probability of an unknown character."""
    levels = {ORDER: stored(grams, "counts")}
    for k in range(ORDER - 1, 0, -1):
        # How many different characters stand before it.
        levels[k] = stored(levels[k + 1].groupBy("m", F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("c")), "counts")
    size = F.lit(1.0)
    for m, n in levels[1].groupBy("m").count().collect():
        size = F.when(F.col("m") == m, F.lit(n + 1.0)).otherwise(size)
    lower, done = None, None
    for k in range(1, ORDER + 1):
        table = levels[k]
        discount = _discount(table)
        contexts = table.groupBy("m", F.substring("g", 1, k - 1).alias("context")).agg(F.sum("c").alias("total"), F.sum(discount).alias("taken"))
        contexts = stored(contexts.select("m", "context", "total", (F.col("taken") / F.col("total")).alias("bow")), "contexts")
        rows = table.withColumns({"context": F.substring("g", 1, k - 1), "tail": F.substring("g", 2, k - 1)}).join(contexts, ["m", "context"])
        if lower is None:
            rows = rows.withColumn("below", 1.0 / size)
        else:
            rows = rows.join(lower.select("m", F.col("g").alias("tail"), F.exp("logp").alias("below")), ["m", "tail"])
            # The weight of a context is kept with the n-gram that it is; contexts at a text's start are none themselves.
            named = lower.join(contexts.select("m", F.col("context").alias("g"), F.log("bow").alias("bow")), ["m", "g"], "full")
            done = done.unionByName(named.select("m", "g", "logp", "bow"))
        p = F.greatest(F.col("c") - discount, F.lit(0.0)) / F.col("total") + F.col("bow") * F.col("below")
        lower = stored(rows.select("m", "g", F.log(p).alias("logp")), "probabilities")
        if k == 1:
            unknown = F.log(F.col("bow") / size)
            done = contexts.select("m", F.lit("").alias("g"), unknown.alias("logp"), F.lit(None).cast("double").alias("bow"))
    return stored(done.unionByName(lower.withColumn("bow", F.lit(None).cast("double"))), "model")


@dataclass
class Shard:
    """Open-addressed table of hashes. ``steps`` are (n, i, of): of n-grams those whose context has remainder i of ``of``."""

    keys: np.ndarray
    values: np.ndarray
    steps: list[tuple[int, int, int]]
    unknown: dict[int, float]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def table(self) -> np.ndarray:
        if _LAST.get("name") != self.name:
            bits = max(int(2 * len(self.keys)).bit_length(), 4)
            slots, waiting = np.full(1 << bits, -1, dtype=np.int64), np.arange(len(self.keys))
            at = (self.keys >> np.uint64(64 - bits)).astype(np.int64)
            while len(waiting):
                free = slots[at[waiting]] < 0
                slots[at[waiting[free]]] = waiting[free]  # of several the last one stays
                lost = slots[at[waiting]] != waiting
                waiting = waiting[lost]
                at[waiting] = (at[waiting] + 1) & ((1 << bits) - 1)
            _LAST.update(name=self.name, slots=slots)
        return _LAST["slots"]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places in ``keys``, -1 where there is none."""
        slots = self.table()
        bits = len(slots).bit_length() - 1
        at = (wanted >> np.uint64(64 - bits)).astype(np.int64)
        out = slots[at]
        open_ = np.flatnonzero(out >= 0)
        open_ = open_[self.keys[out[open_]] != wanted[open_]] if len(self.keys) else open_
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(slots) - 1)
            out[open_] = slots[at[open_]]
            open_ = open_[out[open_] >= 0]
            open_ = open_[self.keys[out[open_]] != wanted[open_]]
        return out

    def add(self, chars: np.ndarray, m: int, values: np.ndarray, open_: np.ndarray) -> None:
        """Adds to the logarithms of every character after the first ORDER - 1 what this shard knows of those still open."""
        apart = np.uint64(m) * _MODEL
        for k, i, of in self.steps:
            mine = np.flatnonzero(open_)
            if of > 1:
                context = codes(chars[ORDER - k : -1], k - 1) ^ apart
                mine = mine[(context[mine] >> np.uint64(1)) % np.uint64(of) == i]
            at = self.find((codes(chars[ORDER - k :], k) ^ apart)[mine])
            seen = at >= 0
            values[mine[seen]] += self.values[at[seen]]
            open_[mine[seen]] = False
            mine = mine[~seen]
            if k == 1:
                values[mine] += self.unknown[m]
                open_[mine] = False
            elif len(mine):
                weight = self.find((codes(chars[ORDER - k : -1], k - 1) ^ apart ^ _WEIGHT)[mine])
                known = weight >= 0
                values[mine[known]] += self.values[weight[known]]


#: The table that a Python worker has built last.
_LAST: dict = {}


def _coded(model: DataFrame) -> DataFrame:
    """(h, value, k, place): entries that n-grams of order k are looked up by; ``place`` is the hash of their context.

    An n-gram has its probability for its own order, and its weight as a context for the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = pa.compute.utf8_length(batch.column("g")).to_numpy()
            for n in np.unique(of).tolist():
                some = batch.filter(pa.array(of == n))
                chars = np.frombuffer("".join(some.column("g").to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, n)
                apart = some.column("m").to_numpy().astype(np.uint64) * _MODEL
                own, context = (_of_rows(x) ^ apart for x in (chars, chars[:, :-1]))
                for key, value, k, place in ((own, "logp", n, context), (own ^ _WEIGHT, "bow", n + 1, own)):
                    held = some.column(value).is_valid().to_numpy(zero_copy_only=False)
                    columns = [key[held].view(np.int64), some.column(value).to_numpy(zero_copy_only=False)[held].astype(np.float32), np.full(held.sum(), k, np.int32), (place[held] >> np.uint64(1)).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "value", "k", "place"])

    return model.where("g <> ''").mapInArrow(run, "h long, value float, k int, place long")


def shards(model: DataFrame, most: int = SHARD) -> Iterator[Shard]:
    """The model in shards of about ``most`` entries, from the longest n-grams to single characters.

    A shard has all entries of some contexts; one context has at most as many as there are characters.
    """
    coded = stored(_coded(model), "coded")
    unknown = {m: logp for m, logp in model.where("g = ''").select("m", "logp").collect()}
    sizes = dict(coded.groupBy("k").count().collect())
    steps = [(k, i, of) for k in range(ORDER, 0, -1) for of in [-(-sizes.get(k, 0) // most) or 1] for i in range(of if k > 1 else 1)]
    together: list[list[tuple[int, int, int]]] = [[]]
    filled = 0.0
    for k, i, of in steps:
        size = sizes.get(k, 0) / of
        if together[-1] and filled + size > most:
            together.append([])
            filled = 0.0
        together[-1].append((k, i, of))
        filled += size
    for own in together:
        wanted = F.lit(False)
        for k, i, of in own:
            wanted |= (F.col("k") == k) & ((F.pmod("place", F.lit(of)) == i) if of > 1 and k > 1 else F.lit(True))
        table = coded.where(wanted).select("h", "value").toArrow()
        h = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        yield Shard(h[order], table.column("value").to_numpy()[order], own, unknown)


_SCORE = {"n_scored": "long", "bits": "double", "worst": "double", "variety": "double"}


def _windows(sums: np.ndarray, n: int) -> tuple[float | None, float | None]:
    """Bits a character of the whole text, and most in a window; windows begin at every step."""
    if n <= 1:
        return None, None
    bits = float(-sums.sum() / n / np.log(2))
    steps = sums[: n // STEP] / (-STEP * np.log(2))
    if len(steps) < STEPS:
        return bits, None
    return bits, float(np.lib.stride_tricks.sliding_window_view(steps, STEPS).mean(axis=1).max())


def variety(chars: np.ndarray) -> float | None:
    """The least share of different n-grams in a window; windows follow each other, the last one ends the text."""
    grams, size = codes(chars, ORDER), STEP * STEPS
    if len(grams) < size:
        return None
    rows = np.concatenate((grams[: len(grams) // size * size], grams[-size:])).reshape(-1, size)
    rows = np.sort(rows, axis=1)
    return float((1 + (rows[:, 1:] != rows[:, :-1]).sum(axis=1)).min() / size)


def perplexity(
    docs: DataFrame, model: DataFrame, *, text: str = "text", keep: list[str], use: Column | None = None, most: int = SHARD,
) -> DataFrame:
    """``keep``, ``n_scored`` (characters and the end), ``bits`` (log2 of the perplexity; null for no characters),
    ``worst`` (bits in the worst window) and ``variety`` (the least share of different n-grams in a window; both null below
    one window).

    ``use`` tells which model scores a document; without such a model it is not scored."""
    there = [row["m"] for row in model.where("g = ''").select("m").collect()]
    m = (F.lit(0) if use is None else use).cast("int")
    body = F.col(f"`{text}`").cast("string").cast("binary").alias(TEXT)
    out = docs.select(*keep, body, F.when(m.isin(there), m).alias("__m"), F.lit(None).cast("binary").alias("__open"), F.lit(None).cast("array<double>").alias("__sums"))
    carried = T.StructType([*(out.schema[c] for c in (*keep, TEXT, "__m", "__open", "__sums"))])
    last = T.StructType([*(out.schema[c] for c in keep), *fields(_SCORE)])
    found = shards(model, most)
    pending = next(found)
    while pending is not None:
        shard, pending = pending, next(found, None)
        sent, ending = docs.sparkSession.sparkContext.broadcast(shard), pending is None

        def run(batches: Iterator[pa.RecordBatch], sent=sent, ending=ending) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in parts(batch, TEXT):
                    opens, sums, made = [], [], {name: [] for name in _SCORE}
                    for value, m, held, before in zip(*(part.column(c).to_pylist() for c in (TEXT, "__m", "__open", "__sums"))):
                        chars = points(value)
                        n = len(chars) - ORDER + 1
                        values = np.zeros(n)
                        open_ = np.ones(n, bool) if held is None else np.unpackbits(np.frombuffer(held, np.uint8), count=n).astype(bool)
                        if m is not None:
                            sent.value.add(chars, m, values, open_)
                        steps = np.add.reduceat(values, np.arange(0, n, STEP)) + (0.0 if before is None else np.array(before))
                        opens.append(np.packbits(open_).tobytes())
                        sums.append(steps)
                        if ending:
                            scored = n if m is not None else 0
                            of = (scored, *_windows(steps, scored), variety(chars) if scored else None)
                            for name, x in zip(_SCORE, of):
                                made[name].append(x)
                    kept = [part.column(c) for c in keep]
                    if ending:
                        yield pa.RecordBatch.from_arrays([*kept, *arrays(_SCORE, made)], names=last.names)
                    else:
                        state = [pa.array(opens, pa.binary()), pa.array(sums, pa.list_(pa.float64()))]
                        yield pa.RecordBatch.from_arrays([*kept, part.column(TEXT), part.column("__m"), *state], names=carried.names)

        out = out.mapInArrow(run, last if ending else carried)
        out = out if ending else stored(out, "scored")
    return out


def classify(
    docs: DataFrame, labels: DataFrame, *, beyond: tuple[float, float, float] = BEYOND, doc_id: str = "doc_id", text: str = "text",
    lang: str = "lang", quality: str = "quality", most: int = SHARD,
) -> DataFrame:
    """One row per document: id, language, ``n_scored``, ``perplexity``, its ``threshold``, ``kept``, and ``worst``,
    ``variety`` with ``worst_threshold`` and ``variety_threshold``.

    Trusted documents are those labelled 1. Halves are dealt by the id's checksum; the trusted text of each trains a model that
    scores the other half. Thresholds are quantiles of the trusted documents of a language, rounded to thousandths of a
    bit: all but the shares ``beyond`` of them have a perplexity and a worst window at most, and a variety at least, as
    the thresholds say. ``kept`` is false beyond any of the three. Without characters (null text too) the
    perplexity is null; without windows (a text under 256 characters) ``worst`` and ``variety`` are; without trusted
    documents of a language its thresholds are; none of these rejects a document. A null language is one of its own.
    Where the other half has no trusted text a document is not scored, and kept.
    """
    trusted = labels.where(F.col(quality) == 1).where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id")).distinct()
    trusted = stored(trusted, "trusted")
    # Sent only while they are few; beyond that the texts are joined by id.
    learners = F.broadcast(trusted) if trusted.count() <= MOST_SENT else trusted
    plain = docs.select(F.col(doc_id).alias("__id"), F.col(lang).alias("__lang"), F.col(text).alias("__text"))
    texts = plain.where("__text IS NOT NULL").join(learners, "__id", "left_semi")
    grams = stored(counts(texts, "__text", remainder("__id", 2)), "grams")
    if grams.isEmpty():
        blank = {name: F.lit(None).cast("double") for name in ("bits", "worst", "variety")}
        scored = plain.select("__id", "__lang", F.lit(0).cast("bigint").alias("n_scored")).withColumns(blank)
    else:
        scored = perplexity(plain, estimate(grams), text="__text", keep=["__id", "__lang"], use=1 - remainder("__id", 2), most=most)
        scored = stored(scored, "scored")
    unseen = scored.where("bits IS NOT NULL").join(trusted, "__id", "left_semi")
    high = lambda name, share: F.percentile(F.round(name, 3), F.lit(1.0 - share))
    limits = unseen.groupBy(F.col("__lang").alias("of")).agg(
        high("bits", beyond[0]).alias("most_bits"), high("worst", beyond[1]).alias("most_worst"),
        F.percentile(F.round("variety", 3), F.lit(beyond[2])).alias("least_variety"),
    )
    out = scored.join(stored(limits, "limits"), F.col("__lang").eqNullSafe(F.col("of")), "left")
    kept = [F.col("bits") <= F.col("most_bits"), F.col("worst") <= F.col("most_worst"), F.col("variety") >= F.col("least_variety")]
    power = lambda name: F.pow(F.lit(2.0), name)
    return out.select(
        F.col("__id").alias(doc_id), F.col("__lang").alias(lang), "n_scored", power("bits").alias("perplexity"),
        power("most_bits").alias("threshold"), (F.coalesce(kept[0], F.lit(True)) & F.coalesce(kept[1], F.lit(True)) & F.coalesce(kept[2], F.lit(True))).alias("kept"),
        power("worst").alias("worst"), power("most_worst").alias("worst_threshold"), "variety",
        F.col("least_variety").alias("variety_threshold"),
    )
