"""Near-duplicate vectors: dual traversal of cover trees, with exact links at a cosine threshold.

Equal vectors are one class. The classes of a label are dealt into blocks of bounded size, and every pair of blocks is
one small job: each block becomes a cover tree, whose levels halve the radius, and pairs of nodes are followed down only
while their covering radii let some of their vectors be close enough. Pairs of nodes that must link altogether are
counted without looking inside. What a job returns grows with its vectors, not with their links: a count for each and
a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseframe.llm.common import stored
from rinseframe.llm.components import components

COSINE = 0.98
#: Classes in a block; a job holds two blocks.
BLOCK = 4096
#: Nodes of so few vectors are compared directly; rows of a comparison made at once.
LEAF, STRIP = 48, 512
#: Bounds are taken this much wider, so that rounding never decides; the cosine itself does.
SLACK = 1e-7


@dataclass
class Node:
    """Vectors within ``radius`` (the true covering radius) of ``center``; children cover them with half the level."""

    center: np.ndarray
    members: np.ndarray
    radius: float
    level: float
    vectors: np.ndarray
    _children: list[Node] | None = None

    def children(self) -> list[Node]:
        if self._children is None:
            self._children = list(self._cover())
        return self._children

    def _cover(self) -> Iterator[Node]:
        left, half = self.members, self.level / 2
        while len(left):
            center = self.vectors[left[0]]
            far = np.sqrt(np.maximum(2 - 2 * (self.vectors[left] @ center), 0))
            inside = far <= half
            inside[0] = True
            yield Node(center, left[inside], float(far[inside].max()), half, self.vectors)
            left = left[~inside]

    def centers(self) -> np.ndarray:
        return np.array([c.center for c in self.children()])


def tree(vectors: np.ndarray) -> Node:
    """The root of unit vectors; a chord is at most 2."""
    far = np.sqrt(np.maximum(2 - 2 * (vectors @ vectors[0]), 0))
    return Node(vectors[0], np.arange(len(vectors)), float(far.max()), 2.0, vectors)


class Forest:
    """Union-find over the vectors of a job."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self, which: np.ndarray) -> np.ndarray:
        out = self.up[which]
        while True:
            above = self.up[out]
            if (above == out).all():
                return out
            out = above


class Links:
    """Counts and components of the links between two sets of unit vectors (or within one)."""

    def __init__(self, left: np.ndarray, right: np.ndarray | None, weights: tuple[np.ndarray, np.ndarray], cosine: float):
        self.own, self.cosine = right is None, cosine
        self.reach = float(np.sqrt(max(2 - 2 * cosine, 0)))
        self.sides = (left, left if self.own else right)
        self.shift = 0 if self.own else len(left)
        self.weights = weights
        self.forest = Forest(len(left) + (0 if self.own else len(right)))
        self.counts = np.zeros(len(self.forest.up), dtype=np.int64)
        self.compared = 0
        if len(left) and len(self.sides[1]):
            root = tree(left)
            self._walk(root, root if self.own else tree(right))

    def _walk(self, a: Node, b: Node) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            same = a is b
            apart = float(np.sqrt(max(2 - 2 * (a.center @ b.center), 0)))
            if apart - a.radius - b.radius > self.reach + SLACK:
                continue
            if apart + a.radius + b.radius < self.reach - SLACK:
                self._all(a.members, b.members, same)
            elif len(a.members) <= LEAF and len(b.members) <= LEAF or min(a.level, b.level) < self.reach / 4:
                self._some(a.members, b.members, same)
            elif same:
                todo += self._within(a)
            else:
                # The wider node is opened; of two alike, both.
                todo += self._between(a if len(a.members) <= LEAF or b.level > a.level else None, b if len(b.members) <= LEAF or a.level > b.level else None, a, b)

    def _within(self, a: Node) -> Iterator[tuple[Node, Node]]:
        kids, at = a.children(), a.centers()
        yield from ((kid, kid) for kid in kids if len(kid.members) > 1)
        radii = np.array([k.radius for k in kids])
        for start in range(0, len(kids), STRIP):
            far = np.sqrt(np.maximum(2 - 2 * (at[start : start + STRIP] @ at.T), 0))
            near = far - radii[start : start + STRIP, None] - radii <= self.reach + SLACK
            for i, j in np.argwhere(near):
                if start + i < j:
                    yield kids[start + i], kids[j]

    def _between(self, keep_a: Node | None, keep_b: Node | None, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        if keep_a is not None and keep_b is not None:
            keep_a = keep_b = None
        left, right = ([a] if keep_a else a.children()), ([b] if keep_b else b.children())
        at, bt = np.array([k.center for k in left]), np.array([k.center for k in right])
        radii_a, radii_b = np.array([k.radius for k in left]), np.array([k.radius for k in right])
        for start in range(0, len(left), STRIP):
            far = np.sqrt(np.maximum(2 - 2 * (at[start : start + STRIP] @ bt.T), 0))
            near = far - radii_a[start : start + STRIP, None] - radii_b <= self.reach + SLACK
            for i, j in np.argwhere(near):
                yield left[start + i], right[j]

    def _all(self, left: np.ndarray, right: np.ndarray, same: bool) -> None:
        for i in left:
            self.forest.join(int(left[0]), int(i))
        if same:
            self.counts[left] += self.weights[0][left].sum() - self.weights[0][left]
            return
        for j in right + self.shift:
            self.forest.join(int(left[0]), int(j))
        self.counts[left] += self.weights[1][right].sum()
        self.counts[right + self.shift] += self.weights[0][left].sum()

    def _some(self, left: np.ndarray, right: np.ndarray, same: bool) -> None:
        for start in range(0, len(left), STRIP):
            rows = left[start : start + STRIP]
            linked = self.sides[0][rows] @ self.sides[1][right].T >= self.cosine
            self.compared += linked.size
            if same:
                linked[np.arange(len(rows)), start + np.arange(len(rows))] = False
            self.counts[rows] += linked @ self.weights[1][right]
            if not same:
                self.counts[right + self.shift] += linked.T @ self.weights[0][rows]
            self._connect(rows, right + self.shift, linked)

    def _connect(self, rows: np.ndarray, columns: np.ndarray, linked: np.ndarray) -> None:
        """Joins along the links, one per row and round, until none leads to another tree."""
        while True:
            open_ = linked & (self.forest.roots(rows)[:, None] != self.forest.roots(columns))
            some = np.flatnonzero(open_.any(axis=1))
            if not len(some):
                return
            for i, j in zip(some, open_[some].argmax(axis=1), strict=True):
                self.forest.join(int(rows[i]), int(columns[j]))


def _unit(values) -> tuple[bytes, bytes] | None:
    """The vector's doubles and the unit vector, None where it links with nothing."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    v = np.array(values, dtype=np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    scaled = v / np.abs(v).max()
    return (v + 0.0).tobytes(), (scaled / np.sqrt(scaled @ scaled)).tobytes()


def near_duplicates(
    table: DataFrame, *, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    block: int = BLOCK,
) -> DataFrame:
    """One row per vector: its id, ``n_links``, ``component_id`` and ``kept``.

    Vectors of equal labels and lengths link when the cosine, in double precision, is ``cosine`` (above 0) or more.
    Null labels, and vectors that are null, empty, zero or hold nulls or non-finite numbers, link with nothing. ``n_links``
    counts the other rows that are linked directly, repeated rows included; ``component_id`` is the smallest id
    within reach, ``kept`` says that it is the row's own. A null id is never the smallest; a component that has
    only null ids has a null one and is kept.
    """
    source = table.select(F.col(vec_id).alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units = [], []
            for name, values in zip(batch.column("label").to_pylist(), batch.column("v").to_pylist(), strict=True):
                made = None if name is None else _unit(values)
                keys.append(None if made is None else xxhash.xxh3_128_digest(name.encode() + b"\0" + made[0]))
                units.append(None if made is None else made[1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["id", "label", "key", "unit"])

    schema = T.StructType([source.schema["id"], source.schema["label"], T.StructField("key", T.BinaryType()), T.StructField("unit", T.BinaryType())])
    rows = stored(source.mapInArrow(prepare, schema), "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.first("label").alias("label"), F.first("unit").alias("unit"), F.count("*").alias("n"), F.min("id").alias("id")
    )
    classes = stored(classes.withColumn("width", F.length("unit")), "classes")

    sizes = classes.groupBy("label", "width").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = classes.join(stored(sizes, "sizes"), ["label", "width"])
    placed = placed.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks").cast("bigint")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "width", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "key", "unit", "n"
    )

    def job(group: pa.Table) -> pa.Table:
        own, lo, hi = group.column("own").to_numpy(), group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        keys, weights = group.column("key").to_pylist(), group.column("n").to_numpy()
        vectors = np.frombuffer(b"".join(group.column("unit").to_pylist()), dtype=np.float64).reshape(len(keys), -1)
        if lo == hi:
            order = np.arange(len(keys))
            links = Links(vectors, None, (weights, weights), cosine)
        else:
            a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            order = np.concatenate([a, b])
            links = Links(vectors[a], vectors[b], (weights[a], weights[b]), cosine)
        roots = links.forest.roots(np.arange(len(order)))
        told = np.flatnonzero((links.counts > 0) | (roots != np.arange(len(order))))
        return pa.table({
            "a": pa.array([keys[order[i]] for i in told], pa.binary()), "b": pa.array([keys[order[roots[i]]] for i in told], pa.binary()),
            "links": pa.array(links.counts[told], pa.int64()),
        })

    found = stored(dealt.groupBy("label", "width", "lo", "hi").applyInArrow(job, "a binary, b binary, links long"), "found")
    counts = found.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    roots = components(found).withColumnRenamed("node", "key")
    named = classes.select("key", "id", "n").join(counts, "key", "left").join(roots, "key", "left")
    named = stored(named.select("key", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "key").alias("root")), "named")
    lowest = stored(named.groupBy("root").agg(F.min("id").alias("component_id")), "lowest")
    told = stored(named.join(lowest, "root").select("key", "n_links", "component_id"), "told")
    out = rows.join(told, "key", "left").select(
        F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id")))
