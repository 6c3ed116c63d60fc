import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from rinseframe.llm import pii, toxicity
from rinseframe.llm.queries import PSEUDONYM_KEY, toxicity_model
from tests.llm import test_decontaminate, test_neardup
from tests.llm.helpers import FOLDER, documents, odd


def test_stages_keep_the_columns(spark):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        docs = out
    rows = docs.collect()
    assert {r.doc_id for r in rows} >= {1, 2, 3, 5, 6, None}
    assert {(r.n_words, r["items"], r.starts, r.kept, r.component_id) for r in rows} == {("x", 1, "y", "k", 0)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).columns == ["doc_id", "n_tokens", "token_ids", "decoded"]


def test_run_against_plain_python(spark):
    model = toxicity_model(spark, FOLDER)
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    rows = [(i, t) for i, t in rows if model.score((t or "").encode()) < toxicity.THRESHOLD]
    component = test_neardup.brute(rows, 5)
    rows = [(i, t) for i, t in rows if component[i][1] == i]
    items = [(str(r.item_id), r.text) for r in test_decontaminate.bench(spark).collect()]
    kept = {}
    for i, t in rows:
        n, hit, _ = test_decontaminate.brute(t, items)
        if not hit:
            kept[i] = t
        elif hit < 0.8 * n:
            kept[i] = None  # its text is checked where the spans are
    docs = spark.createDataFrame([(i, t) for i, t in kept.items() if t is not None], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in pii.pseudonymize(docs, PSEUDONYM_KEY, counts=False).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got.keys() == kept.keys() and len(kept) < documents(spark).count()
    for i, text in texts.items():
        assert got[i].token_ids == library.encode(text, add_special_tokens=False).ids and got[i].n_tokens == len(got[i].token_ids)
    assert all(got[i].n_tokens > 0 for i, t in kept.items() if t is None)
