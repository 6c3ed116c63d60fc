import re

from rinseframe.llm import decontaminate as op
from rinseframe.llm import queries
from tests.llm.helpers import FOLDER, SCHEMA, documents, odd

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def brute(text, items, window=10):
    """(words, hit words, items) by comparing every slice with a set of windows."""
    ws, hit, found = plain_words(text), set(), set()
    windows = {}
    for key, body in items:
        code = plain_words(body)
        if code and len(code) < window:
            windows.setdefault(tuple(code), set()).add(key)
        for i in range(len(code) - window + 1):
            windows.setdefault(tuple(code[i : i + window]), set()).add(key)
    for n in {len(w) for w in windows}:
        for i in range(len(ws) - n + 1):
            if keys := windows.get(tuple(ws[i : i + n])):
                found |= keys
                hit |= set(range(i, i + n))
    return len(ws), len(hit), sorted(found)


def check(docs, items, out, **options):
    expected = sorted([(r.doc_id is None, r.doc_id or 0, *brute(r.text, items, **options)) for r in docs.collect()])
    assert sorted([(r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in out.collect()]) == expected


def bench(spark):
    return spark.read.parquet(f"{FOLDER}/benchmark.parquet")


def test_given_tables(spark):
    items = [(str(r.item_id), r.text) for r in bench(spark).collect()]
    out = op.decontaminate(documents(spark), bench(spark), keep=["doc_id"])
    check(documents(spark), items, out)
    assert out.where("n_hit > 0").count() > 0


def test_blocks_of_items_give_the_same(spark):
    items = [(str(r.item_id), r.text) for r in bench(spark).collect()]
    check(documents(spark), items, op.decontaminate(documents(spark), bench(spark), keep=["doc_id"], block_words=300))


def test_short_items_and_repeats(spark):
    rows = [("a", "b c a"), ("b", "c a b a c a b a c a b a c a b a"), ("c", "a b"), ("d", "..."), ("e", None), ("f", "A-B"), (None, "a")]
    items = spark.createDataFrame(rows, "item_id string, text string")
    texts = ["a b a b c a b a c a b a c a b a c a", "b", "B c a", "c a b a c a b a c a", "x a x b c x", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    plain = [(k, v) for k, v in rows if k is not None]
    for window in (3, 10):
        check(docs, plain, op.decontaminate(docs, items, window=window), window=window)


def test_spans_leave_the_text_and_covered_documents_are_rejected(spark):
    item = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Before, {item.upper()}! after it comes much more", "en", "s", 1), (2, f"<{item}>", "en", "s", 1), (3, "clean", "en", "s", 1)], SCHEMA)
    rows = {r.doc_id: r for r in op.decontaminate(docs, items).collect()}
    assert rows[1].clean_text == "Before, ! after it comes much more" and not rows[1].rejected
    assert rows[2].rejected and rows[3].clean_text == "clean"


def test_odd_and_empty_tables(spark):
    out = op.decontaminate(odd(spark), bench(spark))
    assert out.count() == 8 and out.where("doc_id = 2").first().n_words == 0
    assert out.where("doc_id = 2").first().clean_text is None
    assert op.decontaminate(odd(spark).limit(0), bench(spark)).count() == 0
    assert op.decontaminate(odd(spark), bench(spark).limit(0)).where("n_hit > 0").count() == 0


def test_query(spark):
    out = queries.op3_decontaminate(spark, FOLDER)
    assert out.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert out.count() == documents(spark).count()
