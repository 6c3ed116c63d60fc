import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from rinseframe.llm import neardup as op
from rinseframe.llm import queries
from rinseframe.llm.common import flagged, stored
from rinseframe.llm.components import components
from tests.llm.helpers import FOLDER, SCHEMA, documents, odd, shuffled_bytes

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_set(text, k):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def brute(rows, k, percent=80):
    """id -> (set size, component) by comparing all documents that share a shingle."""
    sets = {i: plain_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def check(rows, out, k):
    expected = brute(rows, k)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert got == expected


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    check(rows, op.near_duplicates(documents(spark)), 5)
    out = queries.op8_minhash(spark, FOLDER)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    check(rows, out, 2)


def test_families_of_copies(spark):
    """Copies of one base, each changed a little: some meet the base only, some only each other."""
    rng, texts = random.Random(5), []
    for family in range(4):
        base = [f"w{family}x{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(60):
            copy = list(base)
            for _ in range(rng.randrange(14)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    texts += ["one", "ONE ", "one two", "two one", "a b a b a b", "a b a", ""]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    for k in (2, 3):
        check(rows, op.near_duplicates(docs, words_per_shingle=k), k)


def test_the_rest_of_a_bucket_is_compared(spark):
    """A chain in which the hub of most buckets is far from the ends."""
    ws = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(ws[8 * i : 8 * i + 100])) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    check(rows, op.near_duplicates(docs, words_per_shingle=2), 2)


def test_signatures_estimate_the_share():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[500:2500]
    share = np.mean(op.signature(a) == op.signature(b))
    assert abs(share - 1500 / 2500) < 0.12
    assert len(set(op.band_keys(op.signature(a)).tolist()) & set(op.band_keys(op.signature(x[10:2000])).tolist())) > 40


def test_odd_and_empty_tables(spark):
    out = op.near_duplicates(odd(spark)).collect()
    assert len(out) == 8
    by = {r.doc_id: r for r in out}
    assert by[2].n_shingles == by[3].n_shingles == by[5].n_shingles == 0 and by[2].kept and by[3].kept and by[5].kept
    assert by[None].component_id is None and by[None].kept
    assert sum(r.doc_id == 1 for r in out) == 2 and by[1].kept
    assert op.near_duplicates(odd(spark).limit(0)).count() == 0


def test_dropping_copies_keeps_columns_and_one_of_each_group(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, None), (5, "g h i j k l")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).selectExpr("*", "7 AS kept")
    out = op.deduplicate(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5]


def test_one_row_stays_whatever_its_id(spark):
    """Null ids, repeated ids and repeated rows: copies of each kind leave one row a group."""
    a, b, c, d = ("a b c d e f", "g h i j k l", "m n o p q r s", "t u v w x y")
    rows = [(None, a), (1, a), (None, a), (None, b), (None, b), (None, b + "!"), (7, c), (7, c), (7, c), (8, c), (9, d), (9, a), (None, ""), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((str(r.doc_id), r.text or "") for r in op.deduplicate(docs).collect())
    expected = [("1", a), ("None", b), ("None", b + "!"), ("7", c), ("9", d), ("None", ""), ("None", ""), ("None", "")]
    assert got == sorted(expected)
    many = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, id) AS doc_id", f"IF(id % 2 = 0, '{a}', concat('{b} ', id % 5)) AS text")
    assert op.deduplicate(many, percent=100).count() == 6


def test_texts_that_stay_are_not_shuffled(spark):
    """Only texts that a copy's digest may belong to move: 20 of 400 here, and whatever shares their bits."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(300)) for _ in range(380)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts + texts[:10] + [texts[0]] * 10)], SCHEMA)
    out = op.deduplicate(docs)
    assert shuffled_bytes(out) < 0.25 * sum(map(len, texts))
    assert sorted(r.doc_id for r in out.collect()) == list(range(380))


def test_a_filter_flags_all_keys_and_few_others(spark):
    keys = stored(spark.range(0, 100_000, 1).selectExpr("IF(id = 7, NULL, concat('k', id)) AS k"), "keys")
    df = spark.range(200_000).selectExpr("id", "IF(id = 8, NULL, concat('k', id)) AS `a.b`")
    out = flagged(df, F.xxhash64("`a.b`"), keys, F.xxhash64("k"), "flag")
    assert out.columns == ["id", "a.b", "flag"]
    row = out.selectExpr("count(*) AS n", "count_if(flag AND id < 100000) AS keys", "count_if(flag AND id >= 100000) AS others").first()
    assert row.n == 200_000 and row["keys"] >= 99_999 and row.others < 10_000
    assert flagged(df, F.xxhash64("`a.b`"), stored(keys.limit(0), "none"), F.xxhash64("k"), "flag").where("flag").count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3)]
    rng.shuffle(links)
    out = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200}
