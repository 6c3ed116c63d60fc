import hashlib
import random
from collections import Counter

import numpy as np

from rinseframe.llm import queries
from rinseframe.llm import suffixes as op
from tests.llm.helpers import FOLDER, SCHEMA, documents, odd, shuffled_bytes


def brute(rows, length):
    """(id, bytes, removed, runs, digest) with a table of all windows."""
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in bodies for p in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b) + 1, dtype=int)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length if p + length < len(gone) else -1] -= 1
        mask = np.cumsum(gone[:-1]) > 0 if len(b) else np.zeros(0, bool)
        runs = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        rest = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        out.append((i, len(b), int(mask.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def check(rows, out, length):
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()], key=repr)
    assert got == brute(rows, length)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)


def pieces(rng, n, alphabet="abcdefgh é"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def made(seed=3):
    rng = random.Random(seed)
    passages = [pieces(rng, rng.randrange(20, 90)) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else pieces(rng, rng.randrange(5, 60)) for _ in range(rng.randrange(1, 7))]
        texts.append("".join(parts))
    texts += [texts[3], texts[4][:70], "x" * 130, "xy" * 90, "", pieces(rng, 39), "é" * 60]
    return texts


def test_small_windows(spark, monkeypatch):
    texts = made()
    for length, gram in ((40, 8), (25, 25), (50, 6)):
        check(list(enumerate(texts)), op.remove_repeats(frame(spark, texts), length=length, gram=gram), length)
    monkeypatch.setattr(op, "MOST_CONTEXTS", 1)
    monkeypatch.setattr(op, "BLOCK", 5)
    check(list(enumerate(texts)), op.remove_repeats(frame(spark, texts), length=40, gram=8), 40)


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    out = queries.op2_suffix_dedup(spark, FOLDER)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"]
    check(rows, out, 400)
    passages(rows, out, queries.PASSAGE)


def passages(rows, out, least):
    """Words inside passages that stand in two places, with a table of all runs of words."""
    texts = [(i, (t or "").encode().lower().split()) for i, t in rows]
    seen = Counter(tuple(ws[p : p + least]) for _, ws in texts for p in range(len(ws) - least + 1))
    expected = []
    for i, ws in texts:
        covered = {q for p in range(len(ws) - least + 1) if seen[tuple(ws[p : p + least])] > 1 for q in range(p, p + least)}
        expected.append((i, len(covered)))
    got = sorted(((r.doc_id, r.n_passage_words) for r in out.collect()), key=repr)
    assert got == sorted(expected, key=repr) and any(n for _, n in expected)


def test_passages_too_short_to_be_removed(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(1, 6))) for _ in range(400)]
    run = lambda n: " ".join(rng.choices(words, k=n))
    shared = [run(n) for n in (50, 51, 52, 70, 90)]
    texts = [f"{run(rng.randrange(60))} {rng.choice(shared)}\n{run(rng.randrange(60))}" for _ in range(60)]
    texts += [shared[1].upper().replace(" ", "\t"), "a " * 200, "b " * 51, "", None, run(51), texts[7]]
    rows = list(enumerate(texts))
    passages(rows, op.remove_repeats(frame(spark, texts), length=10_000, passage_words=51), 51)


def test_suffixes_are_sorted_and_extensions_right():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    data[400:600] = data[100:300]
    length, starts = 50, np.concatenate([rng.permutation(850)[:300], np.arange(100, 200), np.arange(400, 500)])
    bucket = np.sort(rng.integers(0, 4, len(starts)))
    s = op.Suffixes(data, length)
    order = s.sort(starts, bucket)
    keys = [(b, bytes(data[p : p + length])) for b, p in zip(bucket[order], starts[order], strict=True)]
    assert sorted(order.tolist()) == list(range(len(starts))) and keys == sorted(keys)
    a, b = starts[:200], starts[200:400]
    for x, y, n in zip(a.tolist(), b.tolist(), s.common(a, b).tolist(), strict=True):
        u, v = bytes(data[x : x + length]), bytes(data[y : y + length])
        assert n == next((i for i in range(length) if u[i] != v[i]), length)


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(op.Suffixes, "_hash", lambda self, at, n: np.zeros(len(at), dtype=np.uint64))
    rng = random.Random(1)
    one, two = pieces(rng, 60).encode(), pieces(rng, 60).encode()
    assert op.repeated_windows([(1, one, 5, 10), (1, two, 5, 10)], 50) == []


def test_windows_of_few_and_many_contexts(monkeypatch):
    """Against a table of all windows; contexts of an anchor in twos, threes and more, and windows shorter than a number.

    Where a window meets only one other, no common extension is searched for: they are neighbours in any order.
    """
    searched, common = [], op.Suffixes.common
    monkeypatch.setattr(op.Suffixes, "common", lambda self, a, b: searched.append(len(a)) or common(self, a, b))
    rng = random.Random(4)
    for length, sizes in ((60, [2] * 40), (60, [2, 3, 5, 8, 30]), (5, [2, 3, 30]), (8, [40])):
        contexts = []
        for anchor, n in enumerate(sizes):
            base = pieces(rng, 2 * length - 1)
            for _ in range(n):
                left, right = rng.randrange(length), rng.randrange(length, 2 * length - 1)
                text = (pieces(rng, left) + base[left:right] + pieces(rng, 2 * length - 1 - right)).encode("ascii", "replace")
                first, last = sorted((rng.randrange(length), rng.randrange(length)))
                contexts.append((anchor, text[first : last + length], length - 1 - first, last - first + 1))
        seen = Counter((h, place - w, x[w : w + length]) for h, x, place, n in contexts for w in range(n))
        expected = {(i, w) for i, (h, x, place, n) in enumerate(contexts) for w in range(n) if seen[h, place - w, x[w : w + length]] > 1}
        searched.clear()
        found = op.repeated_windows(contexts, length)
        assert {(i, w) for i, a, b in found for w in range(a, b + 1)} == expected and expected
        assert (sum(searched) == 0) == (max(sizes) == 2)


def test_texts_without_repeats_are_not_shuffled(spark):
    """Of 400 texts 20 share a passage; what moves is these, the ranges and what the filter's bits let through."""
    rng = random.Random(9)
    texts = [pieces(rng, 3000) for _ in range(400)]
    texts[:20] = [t + texts[-1][:500] for t in texts[:20]]
    out = op.remove_repeats(frame(spark, texts), with_bytes=False, passage_words=51)
    assert shuffled_bytes(out) < 0.25 * sum(map(len, texts))
    assert sorted(r.doc_id for r in out.where("n_removed > 0").collect()) == [*range(20), 399]


def test_odd_and_empty_tables(spark):
    small = odd(spark)
    out = {r.doc_id: r for r in op.remove_repeats(small).collect()}
    assert len(out) == 7 and out[2].n_bytes == out[3].n_bytes == 0 and out[4].n_removed == out[4].n_bytes
    assert op.remove_repeats(small.limit(0)).count() == 0
    rows = [(r.doc_id, r.text) for r in small.where("doc_id <> 4 OR doc_id IS NULL").collect()]
    check(rows, op.remove_repeats(small.where("doc_id <> 4 OR doc_id IS NULL"), length=20, gram=5), 20)
