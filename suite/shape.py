"""Steps on columns and rows."""

from rinseframe.model import ROW_ID
from rinseframe.operators.rows import drop_duplicates as dedupe, duplicate_rows as copies
from suite.registry import query
from suite.views import EVENTS_SQL, ROWS_SQL, cleaned, dirty_events, dirty_rows, table


@query("drop_column", EVENTS_SQL + "SELECT * EXCLUDE (constant_col) FROM d")
def drop_column(spark, folder):
    return cleaned(dirty_events(spark, folder), {"action": "drop_column", "column": "constant_col"})


@query("rename_column", EVENTS_SQL + "SELECT * EXCLUDE (value), value AS amount FROM d")
def rename_column(spark, folder):
    return cleaned(dirty_events(spark, folder), {"action": "rename_column", "column": "value", "value": "amount"})


@query("reorder_columns", EVENTS_SQL + "SELECT value, event_id, ts, user_id, value2, event_type FROM d")
def reorder_columns(spark, folder):
    df = dirty_events(spark, folder, "event_id", "ts", "user_id", "value2", "event_type", "value")
    return cleaned(df, {"action": "reorder_columns", "value": ["value", "event_id", "no_such_column"]})


@query("normalize_columns", "SELECT r_regionkey AS region_key, r_name AS region_name_full FROM region")
def normalize_columns(spark, folder):
    df = table(spark, folder, "region").toDF("Region-Key ", "Region  Name (Full)")
    return cleaned(df, {"action": "normalize_column_names", "value": "snake_case"})


@query("normalize_columns_upper", 'SELECT c_custkey AS "C_CUSTKEY", c_name AS "C_NAME" FROM customer')
def normalize_columns_upper(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_name")
    return cleaned(df, {"action": "normalize_column_names", "value": "uppercase"})


@query("drop_empty_columns", EVENTS_SQL + "SELECT * EXCLUDE (empty_col) FROM d")
def drop_empty_columns(spark, folder):
    return cleaned(dirty_events(spark, folder), {"action": "drop_empty_columns"})


@query("drop_nulls", EVENTS_SQL + "SELECT * FROM d WHERE value IS NOT NULL")
def drop_nulls(spark, folder):
    return cleaned(dirty_events(spark, folder), {"action": "drop_nulls", "column": "value"})


@query(
    "drop_empty_rows",
    ROWS_SQL
    + "SELECT user_id, event_type, constant_col FROM d "
    + "WHERE NOT (user_id IS NULL AND event_type IS NULL AND constant_col IS NULL)",
)
def drop_empty_rows(spark, folder):
    return cleaned(dirty_rows(spark, folder), {"action": "drop_empty_rows"})


@query(
    "drop_duplicates",
    ROWS_SQL
    + "SELECT user_id, event_type, constant_col, min(event_id) AS first_id FROM d "
    + "GROUP BY user_id, event_type, constant_col",
)
def drop_duplicates(spark, folder):
    return dedupe(dirty_rows(spark, folder)).withColumnRenamed(ROW_ID, "first_id")


@query(
    "duplicate_rows",
    ROWS_SQL
    + "SELECT event_id, user_id, event_type, constant_col FROM (SELECT *, count(*) OVER "
    + "(PARTITION BY user_id, event_type, constant_col) AS n FROM d) WHERE n > 1",
)
def duplicate_rows(spark, folder):
    return copies(dirty_rows(spark, folder)).withColumnRenamed(ROW_ID, "event_id")


def _dropped(spark, folder, rule):
    df = dirty_events(spark, folder, "event_id", "user_id", "value", "value2", "mixed", "event_type")
    return cleaned(df, {"action": "drop_violated", "rule": rule})


_KEPT = EVENTS_SQL + "SELECT event_id, user_id, value, value2, mixed, event_type FROM d WHERE "


@query("drop_violated_null", _KEPT + "value2 IS NOT NULL")
def drop_violated_null(spark, folder):
    return _dropped(spark, folder, {"type": "Null Check", "col": "value2", "desc": "value2 is there"})


@query("drop_violated_range", _KEPT + "value BETWEEN 0 AND 100")
def drop_violated_range(spark, folder):
    return _dropped(spark, folder, {"type": "Range Check", "col": "value", "min": 0, "max": 100, "desc": "range"})


@query("drop_violated_relational", _KEPT + "value2 > value")
def drop_violated_relational(spark, folder):
    rule = {"type": "Relational Check", "col_a": "value2", "op": ">", "col_b": "value", "target_type": "Feature"}
    return _dropped(spark, folder, rule)


@query("drop_violated_expression", _KEPT + "value > 5 AND lower(trim(event_type)) = 'click'")
def drop_violated_expression(spark, folder):
    query_text = "value > 5 AND lower(trim(event_type)) = 'click'"
    return _dropped(spark, folder, {"type": "Custom Expression", "query": query_text, "desc": "clicks over 5"})


@query("drop_violated_note", _KEPT + "true")
def drop_violated_note(spark, folder):
    return _dropped(spark, folder, {"type": "Informational", "desc": "only a note"})

