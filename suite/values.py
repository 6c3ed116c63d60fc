"""Steps on cell values."""

from rinseframe.model import CastType
from suite.registry import query
from suite.views import EVENTS_SQL, PARTS_SQL, cleaned, dirty_events, dirty_parts

NUMBER = r"'^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)\s*$'"
PADDING = r"'^\s+|\s+$'"


# ------------------------------------------------------------------ casts


@query(
    "cast_double",
    EVENTS_SQL
    + f"SELECT event_id, CASE WHEN regexp_matches(mixed, {NUMBER}) THEN try_cast(mixed AS double) END AS mixed FROM d",
)
def cast_double(spark, folder):
    df = dirty_events(spark, folder, "event_id", "mixed")
    return cleaned(df, {"action": "cast_type", "column": "mixed", "dtype": "float64"})


@query(
    "cast_int",
    EVENTS_SQL
    + f"SELECT event_id, CASE WHEN regexp_matches(mixed, {NUMBER}) THEN try_cast(mixed AS bigint) END AS mixed FROM d",
)
def cast_int(spark, folder):
    df = dirty_events(spark, folder, "event_id", "mixed")
    return cleaned(df, {"action": "cast_type", "column": "mixed", "dtype": "int64"})


@query(
    "cast_int_lenient",
    EVENTS_SQL + "SELECT event_id, CASE WHEN value = floor(value) THEN cast(value AS bigint) END AS value FROM d",
)
def cast_int_lenient(spark, folder):
    return cleaned(dirty_events(spark, folder, "event_id", "value"), CastType("value", "int64", strict=False))


@query("cast_timestamp", EVENTS_SQL + "SELECT event_id, try_cast(ts_text AS timestamp) AS ts_text FROM d")
def cast_timestamp(spark, folder):
    df = dirty_events(spark, folder, "event_id", "ts_text")
    return cleaned(df, {"action": "cast_type", "column": "ts_text", "dtype": "datetime64[ns]"})


@query("cast_string", EVENTS_SQL + "SELECT event_id, cast(user_id AS varchar) AS user_id FROM d")
def cast_string(spark, folder):
    df = dirty_events(spark, folder, "event_id", "user_id")
    return cleaned(df, {"action": "cast_type", "column": "user_id", "dtype": "string"})


@query("cast_float32", EVENTS_SQL + "SELECT event_id, cast(cast(value2 AS float) AS double) AS value2 FROM d")
def cast_float32(spark, folder):
    df = dirty_events(spark, folder, "event_id", "value2")
    narrowed = cleaned(df, {"action": "cast_type", "column": "value2", "dtype": "float32"})
    return narrowed.withColumn("value2", narrowed["value2"].cast("double"))


# ------------------------------------------------------------------ replace


@query(
    "replace_literal",
    EVENTS_SQL + "SELECT event_id, CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS event_type FROM d",
)
def replace_literal(spark, folder):
    step = {"action": "replace", "column": "event_type", "find": "click", "replace": "tap", "regex": False}
    return cleaned(dirty_events(spark, folder, "event_id", "event_type"), step)


@query(
    "replace_all",
    EVENTS_SQL
    + "SELECT event_id, value, event_type, CASE WHEN mixed = 'n/a' THEN 'unknown' ELSE mixed END AS mixed, ts_text FROM d",
)
def replace_all(spark, folder):
    df = dirty_events(spark, folder, "event_id", "value", "event_type", "mixed", "ts_text")
    return cleaned(df, {"action": "replace", "column": "All", "find": "n/a", "replace": "unknown", "regex": False})


@query(
    "replace_regex",
    EVENTS_SQL
    + r"SELECT event_id, regexp_replace(ts_text, '(\d+)-(\d+)-(\d+)', '\3/\2/\1 $', 'g') AS ts_text, event_type FROM d",
)
def replace_regex(spark, folder):
    step = {"action": "replace", "column": "ts_text", "find": r"(\d+)-(\d+)-(\d+)", "replace": r"\3/\2/\1 $"}
    return cleaned(dirty_events(spark, folder, "event_id", "ts_text", "event_type"), step | {"regex": True})


# ------------------------------------------------------------------ text


@query(
    "strip_whitespace",
    EVENTS_SQL + f"SELECT event_id, regexp_replace(event_type, {PADDING}, '', 'g') AS event_type, mixed FROM d",
)
def strip_whitespace(spark, folder):
    df = dirty_events(spark, folder, "event_id", "event_type", "mixed")
    return cleaned(df, {"action": "strip_whitespace", "column": "All"})


@query("text_lower", EVENTS_SQL + "SELECT event_id, lower(event_type) AS event_type FROM d")
def text_lower(spark, folder):
    df = dirty_events(spark, folder, "event_id", "event_type")
    return cleaned(df, {"action": "normalize_text", "column": "event_type"})


@query("text_upper", EVENTS_SQL + "SELECT event_id, upper(event_type) AS event_type, upper(mixed) AS mixed FROM d")
def text_upper(spark, folder):
    df = dirty_events(spark, folder, "event_id", "event_type", "mixed")
    return cleaned(df, {"action": "normalize_text", "column": "All", "value": "uppercase"})


def _title(name: str) -> str:
    runs = rf"regexp_extract_all({name}, '(\p{{L}}+|[^\p{{L}}]+)')"
    cased = f"list_transform({runs}, lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2))))"
    return f"CASE WHEN {name} IS NOT NULL THEN array_to_string({cased}, '') END AS {name}"


@query(
    "text_title",
    PARTS_SQL + f"SELECT p_partkey, {_title('p_name')}, {_title('p_brand')}, {_title('p_type')} FROM d",
)
def text_title(spark, folder):
    df = dirty_parts(spark, folder, "p_partkey", "p_name", "p_brand", "p_type")
    return cleaned(df, {"action": "normalize_text", "column": "All", "value": "titlecase"})


@query(
    "text_punct",
    "SELECT doc_id, regexp_replace(text, "
    + r"""'[!"#$%&''()*+,\-./:;<=>?@\[\]^_`{|}~]', '', 'g') AS text FROM documents""",
)
def text_punct(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return cleaned(df, {"action": "normalize_text", "column": "text", "value": "remove_punctuation"})


@query("fuzzy_merge")
def fuzzy_merge(spark, folder):
    df = dirty_parts(spark, folder, "p_partkey", "p_name")
    return cleaned(df, {"action": "normalize_text", "column": "p_name", "value": "fuzzy_dedupe"})


# ------------------------------------------------------------------ numbers


@query(
    "cap_range",
    EVENTS_SQL
    + "SELECT event_id, CASE WHEN value < 5 THEN 5 WHEN value > 100.5 THEN 100.5 ELSE value END::double AS value FROM d",
)
def cap_range(spark, folder):
    df = dirty_events(spark, folder, "event_id", "value")
    return cleaned(df, {"action": "cap_range", "column": "value", "min": 5.0, "max": 100.5})


@query(
    "log_transform",
    "SELECT c_custkey, round(ln(1 + CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END), 6) AS c_acctbal FROM customer",
)
def log_transform(spark, folder):
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", "c_acctbal")
    logged = cleaned(df, {"action": "log_transform", "column": "c_acctbal"})
    return logged.withColumn("c_acctbal", F.round("c_acctbal", 6))


# ------------------------------------------------------------------ dates


def _part(component: str, expression: str) -> None:
    sql = EVENTS_SQL + f"SELECT event_id, ts_text, {expression} AS part FROM d"

    @query({"day_of_week": "dt_day_name"}.get(component, f"dt_{component}"), sql)
    def run(spark, folder):
        df = dirty_events(spark, folder, "event_id", "ts_text")
        step = {"action": "extract_datetime", "column": "ts_text", "component": component, "new_column": "part"}
        return cleaned(df, step)


_T = "try_cast(ts_text AS timestamp)"
_part("year", f"cast(year({_T}) AS bigint)")
_part("month", f"cast(month({_T}) AS bigint)")
_part("day", f"cast(day({_T}) AS bigint)")
_part("hour", f"cast(hour({_T}) AS bigint)")
_part("day_of_week", f"dayname({_T})")


@query("dt_hour_of_timestamp", "SELECT event_id, cast(hour(ts) AS bigint) AS ts_hour FROM events")
def dt_hour_of_timestamp(spark, folder):
    df = dirty_events(spark, folder, "event_id", "ts")
    step = {"action": "extract_datetime", "column": "ts", "component": "hour", "new_column": "ts_hour"}
    return cleaned(df, step, {"action": "drop_column", "column": "ts"})
