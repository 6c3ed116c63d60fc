"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, connected components.

All coordinates of a signature come from two permutations of one universe: the first scatters a document's shingles,
the second, shifted around by one place per coordinate, gives the values whose minima are the signature. The values of
one shingle are therefore neighbours in memory.

Documents with the same set of shingles are one class, which is compared once. In every bucket of a band the classes
are first compared with a hub, the one that meets most others. Buckets whose classes are not all connected by then are
compared further, block by block, so that every pair of a bucket is in the end either compared or connected.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseframe.llm.common import flagged, map_texts, stored
from rinseframe.llm.components import components

#: Words in a shingle and percent of the union that links two documents, unless told otherwise.
WORDS, PERCENT = 5, 80
#: Bands and coordinates in each: a pair at 80 % meets in no band with probability (1 - 0.8^6)^48 < 5e-7.
BANDS, ROWS = 48, 6
#: The universe of the permutations has 2^UNIVERSE places.
UNIVERSE, SEED = 20, 20_011

_SLICE = 2048
#: What a comparison of blocks holds: classes outside the largest component, shingles of a family.
OUTSIDE, INSIDE = 128, 500_000


def words(text: bytes | None) -> list[bytes]:
    """Runs without white space, A-Z lowered."""
    return (text or b"").lower().split()


def shingles(ws: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of k words; the whole sequence if it is shorter; none without words."""
    return set(zip(*(ws[i:] for i in range(k)), strict=False)) if len(ws) >= k else {tuple(ws)} if ws else set()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(ws: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))
    n = max(len(ws) - k + 1, min(len(ws), 1))
    out = np.full(n, min(len(ws), k), dtype=np.uint64)
    for i in range(min(k, len(ws))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n])
    return np.unique(out)


@lru_cache(maxsize=2)
def _permutations(size: int, shifts: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and windows on the circulant one: row p holds its values at p, p + 1, ..."""
    rng = np.random.default_rng(SEED)
    scatter = rng.permutation(1 << size).astype(np.uint32)
    around = rng.permutation(1 << size).astype(np.uint32)
    around = np.concatenate([around, around[: shifts - 1]])
    return scatter, np.lib.stride_tricks.sliding_window_view(around, shifts)


def signature(hashes: np.ndarray, shifts: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k is the minimum of the second permutation, shifted by k, over the scattered shingles."""
    scatter, windows = _permutations(UNIVERSE, shifts)
    places = scatter[(hashes >> np.uint64(64 - UNIVERSE)).astype(np.int64)]
    out = np.full(shifts, 1 << UNIVERSE, dtype=np.uint32)
    for at in range(0, len(places), _SLICE):
        np.minimum(out, windows[places[at : at + _SLICE]].min(axis=0), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different bands apart."""
    rows = values.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i] + np.uint64(1))
    return key.view(np.int64)


def sketches(docs: DataFrame, k: int, text: str, keep: list[str]) -> DataFrame:
    """``keep``, ``n_shingles``, ``set_key`` (the same for the same set; null without shingles) and ``bands``."""

    def make():
        def work(texts):
            out = {"n_shingles": [], "set_key": [], "bands": []}
            for value in texts:
                hashes = shingle_hashes(words(value), k)
                out["n_shingles"].append(len(hashes))
                out["set_key"].append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                out["bands"].append(band_keys(signature(hashes)) if len(hashes) else None)
            return out

        return work

    return map_texts(docs, make, {"n_shingles": "long", "set_key": "binary", "bands": "longs"}, keep, text)


def compare(pairs: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, linked) for pairs of classes, from the full sets of their texts."""
    left = bodies.select(F.col("set_key").alias("a"), F.col("body").alias("a_body"))
    right = bodies.select(F.col("set_key").alias("b"), F.col("body").alias("b_body"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b")
    schema = T.StructType([rows.schema["a"], rows.schema["b"], T.StructField("linked", T.BooleanType())])

    def run(batches):
        last, shown = None, None
        for batch in batches:
            linked = []
            for i in range(batch.num_rows):
                b = batch.column("b")[i].as_py()
                if b != last:
                    last, shown = b, shingles(words(batch.column("b_body")[i].as_py()), k)
                own = shingles(words(batch.column("a_body")[i].as_py()), k)
                common = len(own & shown)
                linked.append(100 * common >= percent * (len(own) + len(shown) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return rows.select("a", "b", "a_body", "b_body").mapInArrow(run, schema)


def _pair(x: str, y: str) -> list[F.Column]:
    """The smaller count of links goes first: b is the one that recurs."""
    return [F.col(x).alias("a"), F.col(y).alias("b")]


def _alike(x: str, y: str, percent: int) -> F.Column:
    """Sets of such sizes can reach the share at all."""
    return F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)


def _new(pairs: DataFrame, done: DataFrame | None) -> DataFrame:
    """Distinct pairs, in either order, that were not compared before."""
    pairs = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).groupBy("lo", "hi").agg(F.max("b").alias("b"))
    if done is not None:
        pairs = pairs.join(done.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), ["lo", "hi"], "left_anti")
    return pairs.select(F.when(F.col("b") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("a"), "b")


def near_duplicates(
    docs: DataFrame, *, words_per_shingle: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text",
    with_text_key: bool = False,
) -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``component_id`` and ``kept``.

    Two documents are linked when 100 * intersection >= percent * union of their shingle sets. ``component_id`` is
    the smallest id that links reach from the document; ``kept`` says that it is its own. Without words or with null
    text a document is empty and alone. Repeated rows are copies of each other, and rows with one id are kept
    together. A null id is never the smallest one; where a component has no other, its rows have a null component and
    are all kept. ``with_text_key`` adds the text's digest, to tell rows of one id apart, and ``component_key``, which
    tells components without ids apart and is null for empty documents.
    """
    k = words_per_shingle
    source = docs.select(F.col(doc_id), F.col(text), F.md5(F.col(text).cast("binary")).alias("text_key"))
    rows = stored(sketches(source, k, text, [doc_id, "text_key"]), "sketches")

    first = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), "text_key")).alias("first")
    classes = rows.where("set_key IS NOT NULL").groupBy("set_key").agg(first, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes, "classes")
    banded = classes.select("set_key", "n", F.explode("bands").alias("band"))
    crowds = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = banded.join(crowds, "band")
    members = stored(members, "members")
    degree = members.groupBy("set_key").agg(F.sum("size").alias("degree"))
    members = stored(members.join(degree, "set_key").select("band", "set_key", "n", "degree"), "buckets")

    wanted = stored(classes.join(degree, "set_key", "left_semi").select("set_key", "first.id", "first.text_key"), "wanted")
    texts = docs.select(F.col(doc_id).alias("__id"), F.md5(F.col(text).cast("binary")).alias("__key"), F.col(text).cast("string").cast("binary").alias("body"))
    texts = flagged(texts, F.xxhash64("__key"), wanted, F.xxhash64("text_key"), "__likely").where("__likely")
    bodies = texts.join(wanted, (F.col("__key") == F.col("text_key")) & F.col("__id").eqNullSafe(F.col("id"))).select("set_key", "body")
    bodies = stored(bodies.groupBy("set_key").agg(F.first("body").alias("body")), "bodies")

    best = F.max(F.struct("degree", "set_key", "n")).alias("hub")
    hubs = members.groupBy("band").agg(best)
    meets = members.join(hubs, "band").where("set_key <> hub.set_key").where(_alike("n", "hub.n", percent))
    done = stored(compare(_new(meets.select(*_pair("set_key", "hub.set_key")), None), bodies, k, percent), "compared")
    roots = _roots(done)

    open_ = _open(members, roots)
    if not open_.isEmpty():
        likely = stored(_rest(open_, bodies, k, percent), "likely")
        done = done.unionByName(stored(compare(_new(likely, done), bodies, k, percent), "compared"))
        roots = _roots(done)

    named = classes.select("set_key", F.col("first.id").alias("id")).join(roots.withColumnRenamed("node", "set_key"), "set_key", "left")
    named = stored(named.select("set_key", "id", F.coalesce("root", "set_key").alias("root")), "roots")
    # Written, so that Spark can split what a large component or class brings to the joins.
    lowest = stored(named.groupBy("root").agg(F.min("id").alias("component_id")), "lowest")
    labels = stored(named.join(lowest, "root").select("set_key", "component_id", "root"), "labels")
    out = rows.join(labels, "set_key", "left").select(
        F.col(doc_id), "n_shingles", F.when(F.col("set_key").isNull(), F.col(doc_id)).otherwise(F.col("component_id")).alias("component_id"),
        "text_key", F.col("root").alias("component_key"),
    )
    out = out.withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id")))
    return out if with_text_key else out.drop("text_key", "component_key")


def _roots(done: DataFrame) -> DataFrame:
    return stored(components(done.where("linked")), "roots")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets whose classes are not all of one component, with their roots."""
    rooted = members.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo <> hi AND size > 2")
    return stored(rooted.join(mixed.select("band"), "band", "left_semi"), "open")


def _rest(open_: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that join components of the buckets in ``open_``, enough of them to connect all that can be.

    Buckets that share classes form a family. In each, the classes outside its largest component are compared with all
    that are not of their own component. Both sides are dealt into blocks of bounded size, and a job counts the common
    shingles of two blocks at once; what it returns is a forest, so it has fewer rows than classes.
    """
    least = open_.groupBy("band").agg(F.min("set_key").alias("b"))
    families = stored(components(open_.join(stored(least, "least"), "band").select(F.col("set_key").alias("a"), "b")), "families")
    own = open_.select("set_key", "n", "root").distinct().join(families.select(F.col("node").alias("set_key"), F.col("root").alias("family")), "set_key")
    own = stored(own, "own")
    sizes = own.groupBy("family", "root").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    sizes = sizes.groupBy("family").agg(
        F.max(F.struct("size", "root")).alias("largest"), F.sum("size").alias("size"), F.sum("weight").alias("weight")
    )
    sizes = stored(sizes.select(
        "family", F.col("largest.root").alias("largest"), F.ceil((F.col("size") - F.col("largest.size")) / OUTSIDE).alias("outside"),
        F.ceil(F.col("weight") / INSIDE).alias("inside"),
    ), "sizes")
    spec = {"hashes": "binary"}
    sets = map_texts(bodies.join(own.select("set_key"), "set_key", "left_semi"), lambda: lambda texts: {"hashes": [shingle_hashes(words(t), k).tobytes() for t in texts]}, spec, ["set_key"], "body")
    rows = own.join(sizes, "family").join(sets, "set_key")
    dealt = F.xxhash64("set_key")
    inner = rows.withColumns({"block": F.pmod(dealt, "inside"), "part": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("outside") - 1)), "outer": F.lit(False)})
    outer = rows.where("root <> largest").withColumns({"part": F.pmod(dealt, "outside"), "block": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("inside") - 1)), "outer": F.lit(True)})
    columns = ["family", "part", "block", "outer", "set_key", "root", "hashes"]

    def job(group: pa.Table) -> pa.Table:
        found = []
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("outer", "set_key", "root", "hashes")), strict=True), key=lambda r: r[:2])
        inside, outside = [r for r in rows if not r[0]], [r for r in rows if r[0]]
        if inside and outside:
            sets = [np.frombuffer(r[3], dtype=np.uint64) for r in inside]
            sizes = np.array([len(x) for x in sets])
            flat, holder = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, holder = flat[order], holder[order]
            up: dict[bytes, bytes] = {}

            def root(x: bytes) -> bytes:
                while x in up:
                    x = up[x]
                return x

            for _, key, label, own in outside:
                own = np.frombuffer(own, dtype=np.uint64)
                starts, ends = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                at = np.repeat(starts - np.concatenate(([0], np.cumsum(ends - starts)[:-1])), ends - starts) + np.arange((ends - starts).sum())
                common = np.bincount(holder[at], minlength=len(sets))
                for j in np.flatnonzero(100 * common >= percent * (len(own) + sizes - common)):
                    a, b = root(label), root(inside[j][2])
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        found.append((key, inside[j][1]))
        return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    return inner.select(columns).unionByName(outer.select(columns)).groupBy("family", "part", "block").applyInArrow(job, "a binary, b binary")


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with all their columns, one of each component of ``near_duplicates``.

    It is the one of the smallest id; a null id only stays where there is no other, then that of the least digest of its
    text. Of several rows with this id and text one stays. Empty documents and null texts all stay.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text, with_text_key=True, **options)
    found = found.where("component_key IS NOT NULL").select("component_key", F.col(doc_id).alias("__id"), F.col("text_key").alias("__key"))
    rows = stored(found.groupBy("component_key", "__id", "__key").agg(F.count("*").alias("n")), "rows")
    place = F.struct(F.col("__id").isNull(), "__id", "__key")
    first = rows.groupBy("component_key").agg(F.min_by(F.struct("__id", "__key"), place).alias("first"))
    judged = rows.join(first, "component_key").withColumn("stays", F.struct("__id", "__key").eqNullSafe(F.col("first")))
    # All rows that go, and those that stay once.
    judged = stored(judged.where("NOT stays OR n > 1").select("__id", "__key", "stays"), "judged")
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.md5(F.col(text).cast("binary")) == F.col("__key"))
    marked = flagged(docs, F.xxhash64(F.md5(F.col(text).cast("binary"))), judged, F.xxhash64("__key"), "__marked")
    alone, met = (marked.where(rows).drop("__marked") for rows in ("NOT __marked", "__marked"))
    once = met.join(judged.where("stays"), same).drop("__id", "stays").dropDuplicates([doc_id, "__key"]).select(*(F.col(f"`{c}`") for c in docs.columns))
    return alone.unionByName(met.join(judged, same, "left_anti")).unionByName(once)
