import math
import statistics
import zlib
from collections import Counter

import pytest

from rinseframe.llm import quality as op
from rinseframe.llm import queries
from tests.llm.helpers import FOLDER, SCHEMA, documents, odd

N = op.ORDER


def plain_chars(text):
    body = " ".join((text or "").lower().split())
    return "\x02" * (N - 1) + "".join("0" if c in "0123456789" else c for c in body) + "\x03"


class Plain:
    """The model by its definition, with dictionaries."""

    def __init__(self, texts):
        level = Counter(t[i : i + N] for t in map(plain_chars, texts) for i in range(len(t) - N + 1))
        self.levels = {N: level}
        for k in range(N - 1, 0, -1):
            self.levels[k] = level = Counter(g[1:] for g in level)
        self.v = len(self.levels[1]) + 1
        self.d, self.total, self.taken = {}, {}, {}
        for k, level in self.levels.items():
            n = Counter(level.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
            made = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 for i in (1, 2, 3)]
            self.d[k] = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(made, 1)]
            self.total[k], self.taken[k] = Counter(), Counter()
            for g, c in level.items():
                self.total[k][g[:-1]] += c
                self.taken[k][g[:-1]] += self.d[k][min(c, 3) - 1]

    def p(self, g):
        k = len(g)
        if k == 0:
            return 1 / self.v
        total = self.total[k][g[:-1]]
        if not total:
            return self.p(g[1:])
        c = self.levels[k][g]
        own = max(c - self.d[k][min(c, 3) - 1], 0) / total if c else 0
        return own + self.taken[k][g[:-1]] / total * self.p(g[1:])

    def each(self, text):
        t = plain_chars(text)
        return [-math.log2(self.p(t[i : i + N])) for i in range(len(t) - N + 1)]

    def bits(self, text):
        found = self.each(text)
        return None if len(found) <= 1 else sum(found) / len(found)

    def windows(self, text):
        found = self.each(text)
        steps = [sum(found[i : i + op.STEP]) / op.STEP for i in range(0, len(found) - op.STEP + 1, op.STEP)]
        windows = [steps[i : i + op.STEPS] for i in range(len(steps) - op.STEPS + 1)]
        grams = [plain_chars(text)[i : i + N] for i in range(len(found))]
        size = op.STEP * op.STEPS
        starts = [*range(0, len(grams) - size + 1, size), len(grams) - size]
        return (max(map(statistics.fmean, windows)), min(len(set(grams[i : i + size])) / size for i in starts)) if windows else (None, None)


@pytest.mark.parametrize("most", [op.SHARD, 3000])
def test_model_is_the_one_of_the_definition(spark, most):
    rows = [(r.doc_id, r.text) for r in documents(spark).where("length(text) < 1500").limit(60).collect()]
    plain = Plain([t for i, t in rows if i % 2 == 0])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = op.estimate(op.counts(docs.where("doc_id % 2 = 0"), "text"))
    got = {r.doc_id: r for r in op.perplexity(docs, model, keep=["doc_id"], most=most).collect()}
    for i, t in rows:
        assert got[i].bits == pytest.approx(plain.bits(t), rel=1e-4), i
        assert (got[i].worst, got[i].variety) == pytest.approx(plain.windows(t), rel=1e-3) if got[i].worst is not None else plain.windows(t)[0] is None
    # Probabilities of what can follow a context sum to one.
    context = plain_chars(rows[0][1])[10 : 10 + N - 1]
    assert sum(plain.p(context + c) for c in plain.levels[1]) + plain.p(context + "￿") == pytest.approx(1, abs=1e-6)


def test_shards_are_bounded(spark):
    """Every entry is in one shard, and none is larger than a bound even though most characters follow a blank."""
    docs = documents(spark).where("length(text) < 1500")
    model = op.estimate(op.counts(docs, "text"))
    entries = op._coded(model).count()
    found = list(op.shards(model, 3000))
    assert sum(len(s.keys) for s in found) == entries and max(len(s.keys) for s in found) < 4500
    assert [step for s in found for step in s.steps] == sorted((step for s in found for step in s.steps), key=lambda step: (-step[0], step[1]))


def test_each_half_is_scored_by_the_other(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in documents(spark).where("length(text) < 1500").limit(50).collect()]
    labels = [(i, int(i % 3 > 0)) for i, _, _ in rows]
    half = lambda i: zlib.crc32(str(i).encode()) % 2
    models = [Plain([t for i, t, _ in rows if half(i) == h and i % 3 > 0]) for h in (0, 1)]
    out = op.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"), beyond=(0.2, 0.2, 0.2))
    got = {r.doc_id: r for r in out.collect()}
    bits = {i: models[1 - half(i)].bits(t) for i, t, _ in rows}
    for i, t, lang in rows:
        assert math.log2(got[i].perplexity) == pytest.approx(bits[i], rel=1e-4)
        own = sorted(round(bits[j], 3) for j, _, of in rows if of == lang and j % 3 > 0)
        if own:
            at = 0.8 * (len(own) - 1)
            limit = own[int(at)] + (at % 1) * (own[min(int(at) + 1, len(own) - 1)] - own[int(at)])
            assert math.log2(got[i].threshold) == pytest.approx(limit, abs=2e-3)
            if abs(bits[i] - limit) > 3e-3 and bits[i] > limit:
                assert not got[i].kept


def test_counts(spark):
    texts = ["ab  AB", "ab1 ab2", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(2)
    expected = Counter(t[i : i + N] for t in map(plain_chars, texts) for i in range(len(t) - N + 1))
    assert {r.g: r.c for r in op.counts(docs, "text").collect()} == expected


def test_junk_is_rejected_and_trusted_text_kept(spark):
    folder = "/root/testdata/sf0.1"
    out = queries.op4_quality(spark, folder)
    assert out.columns[:6] == ["doc_id", "lang", "n_scored", "perplexity", "threshold", "kept"]
    rows = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good, junk = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert sum(r.kept for r in good) > 0.97 * len(good)
    assert sum(not r.kept for r in junk) > 0.95 * len(junk)


def test_odd_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1), (5, 1), (6, None), (None, 1), (4, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    out = op.classify(odd(spark), labels).collect()
    assert len(out) == 8
    by = {r.doc_id: r for r in out}
    assert by[2].perplexity is None and by[3].kept and by[5].perplexity is None and by[6].perplexity > 1
    assert op.classify(odd(spark).limit(0), labels).count() == 0
    assert {r.perplexity for r in op.classify(odd(spark), labels.limit(0)).collect()} == {None}
    assert op.classify(documents(spark), spark.read.parquet(f"{FOLDER}/labels.parquet")).count() == documents(spark).count()
