"""The given tables with dirt added: nulls, outliers, padding, mixed text, bad dates, copies.

The given tables hold no missing values. Every expression below means the same in Spark
SQL and in DuckDB, so the queries and their check share one definition. All rows are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rinseframe.plans.compile import apply_recipe
from rinseframe.model import ROW_ID
from rinseframe.sources.tables import with_row_id

EVENTS = {
    "event_id": "event_id",
    "ts": "ts",
    "user_id": "user_id",
    "value": "CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 97 = 1 THEN value * 100 ELSE value END",
    "value2": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE value + user_id END",
    "event_type": "CASE WHEN event_id % 4 = 0 THEN concat('  ', event_type, ' ') "
    "WHEN event_id % 4 = 1 THEN upper(event_type) ELSE event_type END",
    "mixed": "CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE cast(event_id AS varchar(20)) END",
    "ts_text": "CASE WHEN event_id % 9 = 0 THEN 'invalid_date' ELSE concat('2024-01-', "
    "CASE WHEN event_id % 28 < 9 THEN '0' ELSE '' END, cast(event_id % 28 + 1 AS varchar(2)), ' 14:30:00') END",
    "constant_col": "42",
    "mostly_null": "CASE WHEN event_id % 20 = 3 THEN cast(1.5 AS double) ELSE NULL END",
    "empty_col": "cast(NULL AS double)",
}

# many copies of few rows, and rows without any value
ROWS = {
    "event_id": "event_id",
    "user_id": "CASE WHEN event_id % 101 = 7 THEN NULL ELSE user_id % 50 END",
    "event_type": "CASE WHEN event_id % 101 = 7 THEN NULL ELSE event_type END",
    "constant_col": "CASE WHEN event_id % 101 = 7 THEN NULL ELSE 42 END",
}

PARTS = {
    "p_partkey": "p_partkey",
    "p_name": "CASE WHEN p_partkey % 7 = 0 THEN concat(p_name, 's') "
    "WHEN p_partkey % 7 = 1 THEN concat(p_name, '!') ELSE p_name END",
    "p_brand": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END",
    "p_type": "p_type",
    "p_size": "p_size",
    "p_retailprice": "p_retailprice",
}


def _body(columns: dict[str, str], table: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table}"


EVENTS_SQL = f"WITH d AS ({_body(EVENTS, 'events')}) "
ROWS_SQL = f"WITH d AS ({_body(ROWS, 'events')}) "
PARTS_SQL = f"WITH d AS ({_body(PARTS, 'part')}) "


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _view(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def dirty_events(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """All columns or the named ones, numbered by event_id."""
    df = with_row_id(_view(table(spark, folder, "events"), EVENTS), key="event_id")
    return df.select(*columns, ROW_ID) if columns else df


def dirty_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered by event_id, which is not a column of the table itself."""
    return with_row_id(_view(table(spark, folder, "events"), ROWS), key="event_id").drop("event_id")


def dirty_parts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    df = with_row_id(_view(table(spark, folder, "part"), PARTS), key="p_partkey")
    return df.select(*columns, ROW_ID) if columns else df


def cleaned(df: DataFrame, *steps) -> DataFrame:
    """The table after the steps, which must all apply."""
    out, messages = apply_recipe(df, steps)
    wrong = [m for m in messages if m.startswith("Error")]
    if wrong:
        raise ValueError("; ".join(wrong))
    return out.drop(ROW_ID)
