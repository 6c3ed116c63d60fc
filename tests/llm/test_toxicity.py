import random
import zlib

import numpy as np
import pytest

from rinseframe.llm import queries
from rinseframe.llm import toxicity as op
from tests.llm.helpers import FOLDER, SCHEMA, documents, odd


def made(n, seed=1):
    """Documents that are toxic when an insult meets a group's name; either alone is harmless."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        ws = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(10, 40))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        ws += ["grubling"] * insult + ["martians"] * group
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), int(insult and group)))
    return rows


def test_interactions_are_learned(spark):
    rows = made(1500)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    model = op.fit(docs, labels)
    scores = {r.doc_id: r.score for r in op.score(docs, model, keep=["doc_id"]).collect()}
    held = [(scores[i], y) for i, _, y in rows if i % 3 == 0]
    assert np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.95


def test_pairs_say_what_sums_cannot():
    """Label 1 when exactly one of two terms is there: no sum of weights tells that."""
    rng = np.random.default_rng(4)
    documents = [np.flatnonzero(rng.random(8) < 0.5) for _ in range(1500)]
    labels = np.array([(0 in d) != (1 in d) for d in documents], dtype=float)
    model = op.train(documents[:1000], labels[:1000], np.arange(8))

    def logit(own):
        v = model.vectors[own]
        return model.bias + model.weights[own].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum())

    right = [(logit(d) > 0) == bool(y) for d, y in zip(documents[1000:], labels[1000:], strict=True)]
    assert np.mean(right) > 0.9


@pytest.mark.parametrize(("n", "others"), [(1500, 40), (4500, 400)])
def test_terms_that_count_only_together_are_learned_by_fit(spark, n, others):
    """Label 1 when exactly one of two terms is there, among words that say nothing: no term is strong alone."""
    rng, rows = random.Random(2), []
    for i in range(n):
        one, two = (i // 3) % 2, (i // 6) % 2  # in all four ways equally often
        ws = [f"w{rng.randrange(others)}" for _ in range(rng.randrange(5, 20))] + ["grubling"] * one + ["martians"] * two
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), int(one != two)))
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x, _ in rows], SCHEMA)
    model = op.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int"))
    scores = {r.doc_id: r.score for r in op.score(docs.where("doc_id % 3 = 0"), model, keep=["doc_id"]).collect()}
    assert np.mean([(scores[i] >= 0.5) == bool(y) for i, _, y in rows if i % 3 == 0]) > 0.9


def test_held_out_rows_of_given_tables(spark):
    folder = "/root/testdata/sf0.1"
    out = queries.op7_toxicity(spark, folder)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = [r for r in rows if r.toxic == 1 and r.predicted == 1]
    wrong = [r for r in rows if r.toxic == 0 and r.predicted == 1]
    toxic = sum(r.toxic == 1 for r in rows)
    assert len(right) > 0.8 * toxic and len(wrong) < 0.02 * len(rows)


@pytest.mark.parametrize("value", [None, 0, 1])
def test_without_labels_of_both_kinds(spark, value):
    labels = spark.createDataFrame([(1, value), (None, 1), (999, 1), (4, value)], "doc_id long, toxic int")
    if value is None:
        labels = labels.limit(0)
    model = op.fit(odd(spark), labels)
    rows = op.score(odd(spark), model, name="s").collect()
    assert len(rows) == 8 and all(0 <= r.s <= 1 for r in rows) and len({round(r.s, 12) for r in rows}) == 1


def test_odd_and_empty_tables(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = op.fit(documents(spark), labels)
    by = {r.doc_id: r["__score"] for r in op.score(odd(spark), model, name="__score").collect()}
    assert by[2] == by[3] == by[5]
    assert op.score(odd(spark).limit(0), model).count() == 0
    assert op.fit(documents(spark).limit(0), labels).score(b"x") == pytest.approx(0.5)
