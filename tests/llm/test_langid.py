import zlib

from rinseframe.llm import langid as op
from rinseframe.llm import queries
from tests.llm.helpers import FOLDER, SCHEMA, documents, odd


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = queries.op1_language_id(spark, folder)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_document_frequencies_are_those_of_all_rows(spark):
    texts = [r.text for r in documents(spark).collect() if r.text is not None]
    total, seen = op.document_frequencies(documents(spark).where("text IS NOT NULL").repartition(5), "text")
    assert total == len(texts)
    plain = [0] * op.BUCKETS
    for t in texts[:]:
        for b in op.grams(t.encode())[0]:
            plain[b] += 1
    assert plain == seen.tolist()


def test_most_weights_are_zero(spark):
    model = op.fit(documents(spark))
    assert (model.weights == 0).mean() > 0.5 and 0.05 <= model.temperature <= 10


def test_odd_texts(spark):
    model = op.fit(documents(spark))
    by = {r.doc_id: r for r in op.identify(odd(spark).drop("score"), model).collect()}
    assert by[2].lang_pred == by[3].lang_pred == by[5].lang_pred == "und" and by[2].score == 0
    docs = spark.createDataFrame([(1, "123 --- 45", "en", "s", 1), (2, "a", "en", "s", 1)], SCHEMA)
    by = {r.doc_id: r for r in op.identify(docs, model).collect()}
    assert by[1].lang_pred == "und" and by[2].lang_pred != "und"
    assert op.identify(docs.limit(0), model).count() == 0


def test_without_languages(spark):
    docs = documents(spark).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    model = op.fit(docs)
    assert {r.lang_pred for r in op.identify(docs, model, keep=["doc_id"]).collect()} == {"und"}


def test_the_sample_is_bounded_and_every_language_in_it(spark):
    model = op.fit(documents(spark), per_language=5)
    assert model.languages == sorted(r.lang for r in documents(spark).where("lang IS NOT NULL").select("lang").distinct().collect())
