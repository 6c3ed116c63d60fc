"""Removal of long strings that occur elsewhere, by hash-compared suffix sorting.

Every window of ``length`` bytes has an anchor, the least hash among its short grams. Equal windows have equal anchors
at the same place in them, so only suffixes that meet in an anchor are ever compared, and an anchor with what its windows
cover (its context) stands for all of them. Contexts that occur twice are settled by counting. The others, at the edges of
repeated passages, are sorted: prefix polynomial hashes and binary search give the common extension of two suffixes in
a logarithmic number of steps, a mergesort puts the suffixes in order, and neighbours that agree over a whole window are
compared byte by byte. Where an anchor has very many contexts, their windows are counted by digest instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinseframe.llm.common import flagged, map_texts, stored

#: Bytes of a string that counts as repeated, and of the grams that anchors are made of.
LENGTH, GRAM = 400, 40
#: Bytes that stand for a word where passages are told by words, and words of the grams of their anchors.
CODE, WORDS_OF_GRAM = 2, 4
#: Contexts of one anchor that are sorted in one job, and contexts sorted at once.
MOST_CONTEXTS, AT_ONCE = 256, 1500
#: Windows of a context that are counted together where it has more.
BLOCK = 16

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTERS = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = np.uint64((1 << 31) - 1)


def _powers(n: int, _kept: dict[str, np.ndarray] = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_kept.get("up", ())) < n:
        size = max(n, 1 << 16)
        ones = np.ones(size, dtype=np.uint64)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = ones.copy()
            steps[1:] = base
            _kept[name] = np.multiply.accumulate(steps)
    return _kept["up"][:n], _kept["down"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2^64."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTERS[data] * _powers(len(data))[0], out=out[1:])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor of a text, in order.

    The anchor of a window is its least gram, the leftmost of equals; windows are named by where they start.
    """
    n = len(text)
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    prefix = prefix_hashes(np.frombuffer(text, dtype=np.uint8))
    grams = _mix((prefix[gram:] - prefix[:-gram]) * _powers(n - gram + 1)[1])
    ranked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, windows = length - gram + 1, n - length + 1
    padded = np.full(-(-len(ranked) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(ranked)] = ranked
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows]) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:] - 1, [windows - 1]))
    return grams[place[first]].view(np.int64), place[first], first, last


class Suffixes:
    """Suffixes of one buffer, compared up to ``length`` bytes by the hashes of their prefixes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix = prefix_hashes(data)
        self.down = _powers(len(data) + 1)[1]
        padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
        self.eight = np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))  # overlapping views of the same bytes

    def _head(self, at: np.ndarray) -> np.ndarray:
        """The first bytes of each suffix as a number, which mostly settles what sorts first."""
        return self.eight[at].astype(np.uint64) >> np.uint64(8 * max(8 - self.length, 0))

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffixes at a and b agree over ``length`` bytes."""
        return self._hash(a, self.length) == self._hash(b, self.length)

    def _hash(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.prefix[at + n] - self.prefix[at]) * self.down[at]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b share, by binary search; at most ``length``."""
        out = np.where(self.same(a, b), self.length, 0)
        open_ = np.flatnonzero(out == 0)
        low, high = np.zeros(len(open_), dtype=np.int64), np.full(len(open_), self.length - 1)
        x, y = a[open_], b[open_]
        (x_prefix, x_down), (y_prefix, y_down) = ((self.prefix[at], self.down[at]) for at in (x, y))
        while len(open_) and (low < high).any():
            middle = (low + high + 1) // 2
            same = (self.prefix[x + middle] - x_prefix) * x_down == (self.prefix[y + middle] - y_prefix) * y_down
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        out[open_] = low
        return out

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether suffix a sorts before suffix b."""
        x, y = self._head(a), self._head(b)
        out = x < y
        tied = np.flatnonzero(x == y)
        a, b = a[tied], b[tied]
        n = self.common(a, b)
        whole = n >= self.length
        n = np.where(whole, 0, n)
        out[tied] = np.where(whole, or_equal, self.data[a + n] < self.data[b + n])
        return out

    def sort(self, starts: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The order of the suffixes within each bucket, buckets being runs of equal values: a bottom-up mergesort.

        A run pairs with its neighbour; an element's place in the merged run is its own place plus the number of
        elements of the other run before it, found by binary search, for all runs at once.
        """
        n = len(starts)
        order = np.arange(n)
        edge = np.concatenate((np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), [n]))
        which = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        begin, end = edge[which], edge[which + 1]
        within, largest, run = np.arange(n) - begin, int(np.diff(edge).max(initial=0)), 2
        # Runs of one take one comparison for two.
        one = np.flatnonzero((within % 2 == 0) & (order + 1 < end))
        one = one[~self.before(starts[one], starts[one + 1], True)]
        order[one], order[one + 1] = one + 1, one
        while run < largest:
            pair = within // (2 * run) * (2 * run)
            left = within - pair < run
            other_low = begin + np.where(left, pair + run, pair)
            other_high = np.minimum(begin + np.where(left, pair + 2 * run, pair + run), end)
            low, high = np.minimum(other_low, other_high), other_high
            own = starts[order]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                mine, theirs = own[open_], starts[order[middle]]
                # Equal suffixes of the left run stay first.
                later = np.where(left[open_], self.before(theirs, mine, False), self.before(theirs, mine, True))
                low[open_] = np.where(later, middle + 1, low[open_])
                high[open_] = np.where(later, high[open_], middle)
            passed = low - np.minimum(other_low, other_high)
            target = begin + pair + (within - pair - np.where(left, 0, run)) + passed
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            run *= 2
        return order


def repeated_windows(contexts: list[tuple[int, bytes, int, int]], length: int) -> list[tuple[int, int, int]]:
    """(context, first, last) runs of windows that occur in another context of the same anchor.

    A context is (anchor, bytes, place of the anchor in it, number of windows).
    """
    data = np.frombuffer(b"".join(c[1] for c in contexts), dtype=np.uint8)
    base = np.concatenate(([0], np.cumsum([len(c[1]) for c in contexts])[:-1]))
    counts = np.array([c[3] for c in contexts])
    owner = np.repeat(np.arange(len(contexts)), counts)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    anchor = np.unique([c[0] for c in contexts], return_inverse=True)[1][owner]
    bucket = anchor.astype(np.int64) << 20 | (np.array([c[2] for c in contexts])[owner] - window)
    by = np.argsort(bucket, kind="stable")
    _, inverse, size = np.unique(bucket[by], return_inverse=True, return_counts=True)
    size = size[inverse]
    by, size = by[size > 1], size[size > 1]
    owner, window, bucket = owner[by], window[by], bucket[by]
    if not len(owner):
        return []
    starts = base[owner] + window
    suffixes = Suffixes(data, length)
    order, more = np.arange(len(starts)), np.flatnonzero(size > 2)  # two are neighbours in any order
    order[more] = more[suffixes.sort(starts[more], bucket[more])]
    one, two = order[:-1], order[1:]
    together = bucket[one] == bucket[two]
    one, two = one[together], two[together]
    same = suffixes.same(starts[one], starts[two])
    one, two = one[same], two[same]
    # Neighbours of one pair of contexts overlap, so the bytes under all of them are compared once.
    pairs = {}
    for i, j, a, b in zip(owner[one].tolist(), owner[two].tolist(), window[one].tolist(), window[two].tolist(), strict=True):
        low, high = pairs.get((i, j, b - a), (a, a))
        pairs[i, j, b - a] = (min(low, a), max(high, a))
    found = set()
    for (i, j, shift), (low, high) in pairs.items():
        x, y = contexts[i][1], contexts[j][1]
        if x[low : high + length] == y[low + shift : high + shift + length]:
            found |= {(i, low, high), (j, low + shift, high + shift)}
        else:  # a collision of hashes: each window for itself
            for w in range(low, high + 1):
                if x[w : w + length] == y[w + shift : w + shift + length]:
                    found |= {(i, w, w), (j, w + shift, w + shift)}
    return sorted(found)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows by two hashes, of the id and of the text: repeated rows share both and have the same spans."""
    body = F.col(text).cast("string")
    return docs.withColumns({"k1": F.xxhash64(F.col(doc_id)), "k2": F.xxhash64(body)})


def _met(texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """The texts with ``met``, false for those that a join with a written table by k1 and k2 cannot meet."""
    both = F.xxhash64("k1", "k2")
    return flagged(texts, both, keyed, both, "met")


def _settle(texts: DataFrame, length: int, gram: int, code: Callable[[bytes | None], bytes] | None = None) -> DataFrame:
    """(k1, k2, start, end) of byte ranges that are covered by repeated windows; they may overlap.

    ``code`` puts other bytes in the place of a text.
    """
    spec = {"h": "longs", "c": "longs", "lo": "ints", "windows": "ints", "place": "ints"}

    def make():
        def work(values):
            out = {name: [] for name in spec}
            for value in values:
                body = code(value) if code else value or b""
                h, place, first, last = anchors(body, length, gram)
                out["h"].append(h)
                out["c"].append(np.array([xxhash.xxh3_64_intdigest(body[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], dtype=np.uint64).view(np.int64))
                out["lo"].append(first.astype(np.int32))
                out["windows"].append((last - first + 1).astype(np.int32))
                out["place"].append((place - first).astype(np.int32))
            return out

        return work

    windowed = texts if code else texts.where(F.octet_length("body") >= length)  # others have no window
    found = map_texts(windowed, make, spec, ["k1", "k2"], "body")
    zipped = F.inline(F.arrays_zip(*spec))
    found = stored(found.where("size(h) > 0").select("k1", "k2", zipped), "anchors")

    often = stored(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "often")
    found = stored(found.join(often, "h"), "shared")
    first = F.min(F.struct("k1", "k2", "lo", "windows", "place")).alias("first")
    classes = stored(found.groupBy("h", "c").agg(F.count("*").alias("n"), first), "classes")
    twice = stored(classes.where("n > 1").select("h", "c"), "twice")
    sure = found.join(twice, ["h", "c"]).select("k1", "k2", F.col("lo").alias("start"), (F.col("lo") + F.col("windows") - 1 + length).alias("end"))

    several = stored(classes.groupBy("h").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 AND least = 1"), "several")
    doubtful = classes.join(several, "h").select("h", "n", "contexts", "first.*")
    ranges = F.collect_list(F.struct("h", "n", "contexts", "lo", "windows", "place")).alias("wanted")
    wanted = stored(doubtful.groupBy("k1", "k2").agg(ranges), "wanted")
    bodies = _met(texts, wanted).where("met").select("k1", "k2", "body")
    if code:
        bodies = map_texts(bodies, lambda: lambda values: {"body": [code(value) for value in values]}, {"body": "binary"}, ["k1", "k2"], "body")
    cut = bodies.join(wanted, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("body").alias("body"), F.first("wanted").alias("wanted"))
    cut = cut.select("k1", "k2", "body", F.explode("wanted").alias("w")).select("k1", "k2", "w.*", F.expr(f"substring(body, w.lo + 1, w.windows - 1 + {length})").alias("context"))
    cut = stored(cut, "contexts")
    few = cut.where(F.col("contexts") <= MOST_CONTEXTS)
    many = cut.where(F.col("contexts") > MOST_CONTEXTS)
    return sure.unionByName(_by_sorting(few, length)).unionByName(_by_counting(many, length))


def _by_sorting(contexts: DataFrame, length: int) -> DataFrame:
    """Ranges from sorted suffixes; the contexts of an anchor come together, a bounded number of them."""
    names = ["h", "k1", "k2", "n", "lo", "windows", "place", "context"]

    def ranges(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for i, a, b in repeated_windows([(r[0], r[7], r[6], r[5]) for r in rows], length):
            if rows[i][3] == 1:  # those that occur more often are covered altogether
                out.append((rows[i][1], rows[i][2], rows[i][4] + a, rows[i][4] + b + length))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["k1", "k2", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if len(held) >= AT_ONCE and r[0] != held[-1][0]:
                    yield ranges(held)
                    held = []
                held.append(r)
        if held:
            yield ranges(held)

    return contexts.select(*names).repartition("h").sortWithinPartitions("h").mapInArrow(run, "k1 long, k2 long, start int, end int")


def _by_counting(contexts: DataFrame, length: int) -> DataFrame:
    """Ranges from 128-bit digests, for anchors with very many contexts; all counts are summed before they move.

    The windows of a context are taken in blocks of BLOCK places of the anchor. What all windows of a block share, its
    core, must occur twice for any of them to repeat; where all that a block covers occurs twice, all of them do. Only
    blocks that neither settles, at the edges of passages, are taken apart, one of each content.
    """
    names = ["k1", "k2", "h", "n", "lo", "windows", "place", "context"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k1, k2, h, n, lo, windows, place, body in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                for j in range((place - windows + 1) // BLOCK, place // BLOCK + 1):
                    first, last = max(place - (j + 1) * BLOCK + 1, 0), min(place - j * BLOCK, windows - 1)
                    core = body[place - j * BLOCK : place - j * BLOCK + length - BLOCK + 1]
                    covered = body[first : last + length]
                    # The offsets are part of the content, so that only equal runs of windows count as equal.
                    whole = xxhash.xxh3_128_digest(b"%d,%d," % (place - first, place - last) + covered)
                    out.append((k1, k2, h, n, lo + first, place - first, last - first + 1, j, xxhash.xxh3_128_digest(core), whole, covered))
            columns = list(zip(*out, strict=True)) if out else [()] * 11
            kinds = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["k1", "k2", "h", "n", "at", "offset", "count", "j", "core", "whole", "covered"])

    schema = "k1 long, k2 long, h long, n long, at int, offset int, count int, j int, core binary, whole binary, covered binary"
    rows = stored(contexts.select(*names).mapInArrow(blocks, schema), "blocks")
    key = ["h", "j", "core", "whole"]
    one = F.min(F.struct("k1", "k2", "n", "at", "offset", "count", "covered")).alias("one")
    kinds = stored(rows.groupBy(*key).agg(F.count("*").alias("times"), one), "kinds")
    settled = rows.where("n = 1").join(stored(kinds.where("times > 1").select(*key), "settled"), key)
    settled = settled.select("k1", "k2", F.col("at").alias("start"), (F.col("at") + F.col("count") - 1 + length).alias("end"))
    mixed = kinds.groupBy("h", "j", "core").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds > 1 AND least = 1")
    apart = kinds.join(stored(mixed.select("h", "j", "core"), "mixed"), ["h", "j", "core"]).select("h", (F.col("times") == 1).alias("asked"), "one.*")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, asked, k1, k2, n, at, offset, count, covered in zip(*(batch.column(c).to_pylist() for c in ("h", "asked", "k1", "k2", "n", "at", "offset", "count", "covered")), strict=True):
                out += [(k1, k2, h, asked and n == 1, offset - w, xxhash.xxh3_128_digest(covered[w : w + length]), at + w) for w in range(count)]
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64()] * 3 + [pa.bool_(), pa.int32(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["k1", "k2", "h", "asked", "offset", "digest", "at"])

    single = stored(apart.mapInArrow(windows, "k1 long, k2 long, h long, asked boolean, offset int, digest binary, at int"), "windows")
    twice = stored(single.groupBy("h", "offset", "digest").agg(F.count("*").alias("times")).where("times > 1").drop("times"), "twice")
    found = single.where("asked").join(twice, ["h", "offset", "digest"]).select("k1", "k2", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    return settled.unionByName(found)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def word_codes(text: bytes | None) -> bytes:
    """CODE bytes of a hash for each word, a word being a run without white space, A-Z lowered."""
    ws = (text or b"").lower().split()
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype="<u8", count=len(ws))
    return codes.view(np.uint8).reshape(-1, 8)[:, :CODE].tobytes()


def _passages(texts: DataFrame, least: int) -> DataFrame:
    """(k1, k2, passages): ranges of at least so many words that stand elsewhere too, from codes in place of words."""
    found = _settle(texts, CODE * least, CODE * WORDS_OF_GRAM, word_codes)
    # Whole words only.
    found = found.select("k1", "k2", F.ceil(F.col("start") / CODE).alias("start"), F.floor(F.col("end") / CODE).alias("end"))
    return found.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("passages"))


def remove_repeats(
    docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", with_bytes: bool = True,
    passage_words: int | None = None,
) -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``starts``, ``ends`` and ``kept_bytes``.

    A byte is removed when it lies in a string of ``length`` bytes of the UTF-8 text that also starts anywhere else, in
    this document or another; strings are judged on the input and may overlap. ``starts`` and ``ends`` are the maximal
    removed runs, ``kept_bytes`` the rest (cuts may fall inside a character); left out without ``with_bytes``. A null
    text counts as empty. Repeated rows are documents that repeat each other.

    ``passage_words`` adds ``n_passage_words``: how many words lie in passages of at least so many words that also stand
    elsewhere, whatever their case and the white space between them, found in the same way over hashes of the words. It
    tells passages that are shorter than ``length``, and removes nothing.
    """
    texts = _keyed(docs.select(F.col(doc_id), F.col(text)), doc_id, text).withColumn("body", F.col(text).cast("string").cast("binary")).select(F.col(doc_id), "k1", "k2", "body")
    found = _settle(texts.select("k1", "k2", "body"), length, gram)
    spans = found.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    shown = [F.col("spans.start").alias("from"), F.col("spans.end").alias("to")]
    if passage_words is not None:
        spans = spans.join(_passages(texts.select("k1", "k2", "body"), passage_words), ["k1", "k2"], "full")
        inside = F.filter("passages", lambda x: x["end"] - x["start"] >= passage_words)
        shown += [inside["start"].alias("first"), inside["end"].alias("last")]
    spans = stored(spans, "spans")
    marked = _met(texts, spans)
    rows = marked.where("met").join(spans, ["k1", "k2"], "left").select(F.col(doc_id), "body", *shown)
    kinds = [("n_bytes", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("n_spans", "long", pa.int64()), ("kept_sha256", "string", pa.string()), ("starts", "array<long>", pa.list_(pa.int64())), ("ends", "array<long>", pa.list_(pa.int64()))]
    kinds += [("kept_bytes", "binary", pa.binary())] if with_bytes else []
    told = [("n_passage_words", "long", pa.int64())] if passage_words is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = {name: [] for name, _, _ in kinds}
                for body, start, end in zip(*(batch.column(c).to_pylist() for c in ("body", "from", "to")), strict=True):
                    body, cuts = body or b"", merged(list(zip(start or (), end or (), strict=True)))
                    kept, last = [], 0
                    for a, b in cuts:
                        kept.append(body[last:a])
                        last = b
                    rest = b"".join([*kept, body[last:]]) if cuts else body
                    values = (len(body), len(body) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest(), [a for a, _ in cuts], [b for _, b in cuts], rest)
                    for (name, _, _), value in zip(kinds, values, strict=False):
                        out[name].append(value)
                columns = [pa.array(out[name], kind) for name, _, kind in kinds]
                if told:
                    ranges = zip(*(batch.column(c).to_pylist() for c in ("first", "last")), strict=True)
                    inside = [sum(b - a for a, b in merged(list(zip(first or (), last or (), strict=True)))) for first, last in ranges]
                    columns.append(pa.array(inside, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(doc_id), *columns], names=[doc_id, *out, *(name for name, _, _ in told)])

    schema = f"`{doc_id}` {dict(rows.dtypes)[doc_id]}, " + ", ".join(f"{name} {kind}" for name, kind, _ in [*kinds, *told])
    # Documents without a range are whole, and need no Python.
    body, none = F.coalesce("body", F.lit(bytearray())), F.array().cast("array<long>")
    whole = {"n_bytes": F.octet_length(body), "kept_sha256": F.sha2(body, 256), "starts": none, "ends": none, "kept_bytes": body}
    alone = [whole.get(name, F.lit(0)).cast(kind).alias(name) for name, kind, _ in [*kinds, *told]]
    return rows.mapInArrow(run, schema).unionByName(marked.where("NOT met").select(F.col(doc_id), *alone))
