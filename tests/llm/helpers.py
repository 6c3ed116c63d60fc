"""Small tables with everything that can be odd in them."""

from __future__ import annotations

FOLDER = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 40_000
ODD = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 62),
    (2, None, None, None, None), (3, "", "en", "a", 0), (None, "an id is missing here", "en", None, 21),
    (4, LONG, "en", "a", len(LONG)), (5, " \n\t ", "de", "b", 4), (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 62),
    (6, "é\x00ß \x1c Σίσυφος ΑΣ 😀 İstanbul ſ K", "el", "b", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like results."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.selectExpr("*", "'x' AS n_words", "1 AS items", "'y' AS starts", "2 AS token_ids", "3 AS score", "'k' AS kept", "0 AS component_id")


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def shuffled_bytes(df):
    """What the exchanges of a collected result held, with joins that are never broadcast by size."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())
