import math

import numpy as np
import pytest

from rinseframe.llm import queries
from rinseframe.llm import vectors as op
from tests.llm.helpers import FOLDER


def brute(rows, cosine=0.98):
    """(id, links, component) of every row by comparing all pairs."""
    n = len(rows)
    usable = [lab is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    links = [set() for _ in range(n)]
    for lab, width in {(r[2], len(r[1])) for r, ok in zip(rows, usable, strict=True) if ok}:
        own = [i for i in range(n) if usable[i] and rows[i][2] == lab and len(rows[i][1]) == width]
        m = np.array([rows[i][1] for i in own], dtype=float)
        m /= np.sqrt((m * m).sum(1))[:, None]
        for a, b in np.argwhere(m @ m.T >= cosine):
            if a != b:
                links[own[a]].add(own[b])
    component = list(range(n))
    for start in range(n):
        if component[start] == start:
            todo, seen = [start], {start}
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            for i in seen:
                component[i] = start
    groups = {}
    for i, c in enumerate(component):
        groups.setdefault(c, []).append(rows[i][0])
    least = {c: min((x for x in ids if x is not None), default=None) for c, ids in groups.items()}
    out = [(rows[i][0], len(links[i]), least[component[i]]) for i in range(n)]
    return sorted(out, key=repr)


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    kept = [(r[0], None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]], r[2]) for r in rows]
    out = op.near_duplicates(df, **options).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in out], key=repr) == brute(kept, options.get("cosine", 0.98))
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def clustered(rng, n, groups, spread, width=16):
    centers = rng.normal(size=(groups, width))
    return [(i, [float(x) for x in centers[rng.integers(groups)] + rng.normal(scale=spread, size=width)], int(rng.integers(2))) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 60])
def test_dense_and_loose_groups(spark, block):
    rng = np.random.default_rng(5)
    rows = clustered(rng, 300, 4, 0.12) + [(i + 1000, v, lab) for i, v, lab in clustered(rng, 200, 200, 0.0)]
    rows += [(2000 + i, rows[i][1], rows[i][2]) for i in range(40)] + [(3000 + i, [x * 3 for x in rows[i][1]], rows[i][2]) for i in range(20)]
    check(spark, rows, block=block)


def test_chain_and_other_thresholds(spark):
    rows = [(i, [math.cos(0.15 * i), math.sin(0.15 * i)], 1) for i in range(40)]
    check(spark, rows, block=7)
    check(spark, rows, cosine=0.7)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1),
            (8, [1.0, 0.0], None), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (11, [-1.0, 0.0], 1), (12, [1.0, 0.0], 2), (13, [1e-30, 0.0], 2), (None, [0.0, 5.0], 3)]
    check(spark, rows)


def test_empty_table_and_further_columns(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, kept string, n_links int")
    assert op.near_duplicates(df).count() == 0


def test_few_pairs_are_compared():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 64))
    v /= np.sqrt((v * v).sum(1))[:, None]
    links = op.Links(v, None, (np.ones(3000, int), np.ones(3000, int)), 0.98)
    assert links.compared < 0.02 * 3000**2 and links.counts.sum() == 0


def test_query(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    out = queries.op10_embedding_neardup(spark, FOLDER)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted([(r.vec_id, r.n_links, r.component_id) for r in out.collect()], key=repr)
    assert got == brute([(r.vec_id, r.embedding, r.label) for r in table])
