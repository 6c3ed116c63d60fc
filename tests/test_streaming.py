import pytest

from rinseframe import apply_recipe
from rinseframe.streaming.live import NotStreamable, clean_stream, count_violations

STEPS = [
    {"action": "strip_whitespace", "column": "event_type"},
    {"action": "normalize_text", "column": "event_type", "value": "uppercase"},
    {"action": "drop_violated", "rule": {"type": "Range Check", "col": "value", "min": 1, "max": 200, "desc": "v"}},
]
FILL = {"action": "fill_null", "column": "value", "value": "mean"}


@pytest.fixture
def source(spark, tmp_path):
    from suite.views import dirty_events

    table = dirty_events(spark, "/root/testdata/sf0.001", "event_id", "value", "event_type").drop("_row_id")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in")), str(tmp_path)


def _stream(spark, static, folder):
    return spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@pytest.mark.parametrize("steps, frozen", [(STEPS, False), ([FILL, *STEPS], True)])
def test_a_stream_is_cleaned_like_the_table(spark, source, steps, frozen):
    static, folder = source
    out, messages = clean_stream(_stream(spark, static, folder), steps, fit_on=static if frozen else None)
    assert messages == []
    query = (
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
    )
    query.trigger(availableNow=True).start().awaitTermination()
    expected = apply_recipe(static, steps)[0]
    got = spark.read.parquet(f"{folder}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_steps_without_meaning_on_a_stream_are_refused(spark, source):
    static, folder = source
    stream = _stream(spark, static, folder)
    for step in [
        *(FILL | {"value": how} for how in ("mean", "median", "mode", "knn", "iterative")),
        {"action": "normalize_text", "column": "event_type", "value": "fuzzy_dedupe"},
        {"action": "drop_empty_columns"},
    ]:
        with pytest.raises(NotStreamable):
            clean_stream(stream, [step])
    with pytest.raises(NotStreamable):
        clean_stream(stream, [{"action": "drop_duplicates"}], fit_on=static)


def test_messages_of_steps_are_returned(spark, source):
    static, folder = source
    _, messages = clean_stream(_stream(spark, static, folder), [{"action": "drop_nulls", "column": "nowhere"}])
    assert len(messages) == 1 and "nowhere" in messages[0]


def test_violations_per_batch(spark, source):
    static, folder = source
    rules = [{"type": "Null Check", "col": "value", "desc": "value is there"}]
    count_violations(_stream(spark, static, folder), rules, f"{folder}/counts", f"{folder}/cp").awaitTermination()
    counts = spark.read.parquet(f"{folder}/counts")
    assert counts.select("batch").distinct().count() == 3
    assert counts.agg({"violations": "sum"}).first()[0] == static.filter("value IS NULL").count()
