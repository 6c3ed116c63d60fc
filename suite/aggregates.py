"""Profiles and insight tables."""

from pyspark.sql import functions as F

from rinseframe.operators import insight as I, profile as P
from suite.checks import _COUNTS, BOOK
from suite.registry import query
from suite.views import EVENTS, EVENTS_SQL, PARTS_SQL, ROWS_SQL, dirty_events, dirty_parts, dirty_rows, table

_HELD = " + ".join(f"count({c})" for c in EVENTS)
_HEALTH = f"(100 * ({_HELD}) // ({len(EVENTS)} * count(*)))::bigint"


@query("health", EVENTS_SQL + f"SELECT {_HEALTH} AS health FROM d")
def health(spark, folder):
    return P.health(dirty_events(spark, folder))


@query(
    "overview",
    EVENTS_SQL
    + f"""SELECT {_HEALTH} AS health, count(*) AS rows, {len(EVENTS)}::bigint AS columns,
          count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicates,
          (SELECT sum(violations) FROM ({_COUNTS}))::bigint AS violations FROM d""",
)
def overview(spark, folder):
    return P.overview(dirty_events(spark, folder), BOOK)


@query("duplicates_of_rows", ROWS_SQL + "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, "
       "constant_col FROM d)) AS duplicates, count(*) AS rows FROM d")  # fmt: skip
def duplicates_of_rows(spark, folder):
    return P.overview(dirty_rows(spark, folder)).select("duplicates", "rows")


# ------------------------------------------------------------------ per column

_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "value": "double", "value2": "double",
          "event_type": "string", "mixed": "string", "ts_text": "string", "constant_col": "int",
          "mostly_null": "double", "empty_col": "double"}
_NUMERIC = [c for c, t in _TYPES.items() if t in ("bigint", "double", "int")]
_TEXT = [c for c, t in _TYPES.items() if t == "string"]


def _mode(c: str, table: str = "d") -> str:
    return (
        f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
    )


def _summary(c: str) -> str:
    if c in _NUMERIC:
        rest = f"round(avg({c})::double, 6) AS mean, NULL::varchar AS mode, min({c})::double AS low, max({c})::double AS high"
    elif c in _TEXT:
        rest = f"NULL::double AS mean, {_mode(c)} AS mode, NULL::double AS low, NULL::double AS high"
    else:
        rest = f"NULL::double AS mean, {_mode(c)}::varchar AS mode, NULL::double AS low, NULL::double AS high"
    return (
        f"SELECT '{c}' AS name, '{_TYPES[c]}' AS type, count(*) - count({c}) AS nulls, "
        f"round(100.0 * (count(*) - count({c})) / count(*), 4)::double AS null_percent, "
        f'count(DISTINCT {c}) AS "unique", {rest} FROM d'
    )


@query("column_summary", EVENTS_SQL + " UNION ALL ".join(_summary(c) for c in EVENTS))
def column_summary(spark, folder):
    found = P.column_summary(dirty_events(spark, folder))
    return found.select(
        F.col("column").alias("name"), "type", "nulls", F.round("null_percent", 4).alias("null_percent"), "unique",
        F.round("mean", 6).alias("mean"), "mode", F.col("min").alias("low"), F.col("max").alias("high"),
    )


def _describe(c: str) -> str:
    head = f'SELECT \'{c}\' AS name, count({c}) AS "count"'
    x = f"(epoch_us({c}) / 1e6)" if c == "ts" else f"{c}::double"
    if c in _TEXT:
        top = f"(SELECT count(*) FROM d WHERE {c} = {_mode(c)})"
        blank = ", ".join(f"NULL::double AS {n}" for n in ("mean", "std", "low", "q1", "median", "q3", "high"))
        return f'{head}, count(DISTINCT {c}) AS "unique", {_mode(c)} AS top, {top} AS freq, {blank} FROM d'
    spread = f"round(avg({x}), 3) AS mean, round(stddev_samp({x}), 3) AS std, round(min({x}), 3) AS low"
    inner = ", ".join(
        f"round(quantile_cont({x}, {q}), 3) AS {n}" for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    )
    return (
        f'{head}, NULL::bigint AS "unique", NULL::varchar AS top, NULL::bigint AS freq, {spread}, {inner}, '
        f"round(max({x}), 3) AS high FROM d"
    )


@query("describe", EVENTS_SQL + " UNION ALL ".join(_describe(c) for c in EVENTS))
def describe(spark, folder):
    found = P.describe(dirty_events(spark, folder))
    rounded = [F.round(c, 3).alias({"min": "low", "max": "high"}.get(c, c))
               for c in ("mean", "std", "min", "q1", "median", "q3", "max")]
    return found.select(F.col("column").alias("name"), "count", "unique", "top", "freq", *rounded)


_SECONDS = "epoch_us(o_orderdate) / 1e6"


@query(
    "describe_times",
    f"SELECT count(o_orderdate) AS n, round(avg({_SECONDS}), 2) AS mean, round(min({_SECONDS}), 2) AS low, "
    f"round(quantile_cont({_SECONDS}, 0.25), 2) AS q1, round(quantile_cont({_SECONDS}, 0.5), 2) AS median, "
    f"round(quantile_cont({_SECONDS}, 0.75), 2) AS q3, round(max({_SECONDS}), 2) AS high FROM orders",
)
def describe_times(spark, folder):
    found = P.describe(table(spark, folder, "orders").select("o_orderdate"))
    names = {"mean": "mean", "min": "low", "q1": "q1", "median": "median", "q3": "q3", "max": "high"}
    return found.select(F.col("count").alias("n"), *[F.round(c, 2).alias(n) for c, n in names.items()])


def _each(columns, line):
    return " UNION ALL ".join(line(c) for c in columns)


def _skew(c: str) -> str:
    """Equal values have none, in either engine's way of saying so."""
    return f"CASE WHEN min({c}) = max({c}) THEN 0.0::double ELSE round(skewness({c}::double), 4) END"


@query(
    "diag_numeric",
    EVENTS_SQL
    + _each(
        _NUMERIC,
        lambda c: f"SELECT '{c}' AS name, '{_TYPES[c]}' AS type, count(*) - count({c}) AS nulls, "
        f'count(DISTINCT {c}) AS "unique", {_skew(c)} AS skew FROM d',
    ),
)
def diag_numeric(spark, folder):
    found = P.numeric_diagnostics(dirty_events(spark, folder))
    return found.select(F.col("column").alias("name"), "type", "nulls", "unique", F.round("skew", 4).alias("skew"))


def _quartiles(c: str) -> str:
    return ", ".join(
        f"round(quantile_cont({c}::double, {q}), 6) AS {n}" for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    )


_LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


_FIVE = _each(
    _LINEITEM,
    lambda c: f"SELECT '{c}' AS name, min({c})::double AS low, {_quartiles(c)}, max({c})::double AS high, "
    f"round(avg({c})::double, 4) AS mean FROM lineitem",
)


def _five(found):
    inner = [F.round(c, 6).alias(c) for c in ("q1", "median", "q3")]
    return found.select(
        F.col("column").alias("name"), F.col("min").alias("low"), *inner, F.col("max").alias("high"),
        F.round("mean", 4).alias("mean"),
    )


@query("five_number", _FIVE)
def five_number(spark, folder):
    return _five(P.five_number(table(spark, folder, "lineitem")))


@query("five_number_narrowed", _FIVE)
def five_number_narrowed(spark, folder):
    """The same by the plan for large tables."""
    return _five(P.five_number(table(spark, folder, "lineitem"), small=0, bracket=500))


#: All numeric columns that hold values.
_BOX = [c for c in _NUMERIC if c != "empty_col"]


def _box(c: str) -> str:
    return f"""SELECT '{c}' AS name, round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median,
      round(any_value(q3), 4) AS q3, round(any_value(lo), 4) AS low_fence, round(any_value(hi), 4) AS high_fence,
      min({c}::double) FILTER (WHERE {c} >= lo) AS low_whisker, max({c}::double) FILTER (WHERE {c} <= hi) AS high_whisker,
      count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outliers
      FROM d, (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
        (SELECT quantile_cont({c}::double, 0.25) AS q1, quantile_cont({c}::double, 0.5) AS q2,
          quantile_cont({c}::double, 0.75) AS q3 FROM d))"""


@query("box_stats", EVENTS_SQL + _each(_BOX, _box))
def box_stats(spark, folder):
    found = P.box_stats(dirty_events(spark, folder))
    rounded = [F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "low_fence", "high_fence")]
    return found.select(F.col("column").alias("name"), *rounded, "low_whisker", "high_whisker", "outliers")


@query(
    "outlier_points",
    EVENTS_SQL
    + _each(
        _BOX,
        lambda c: f"""SELECT event_id, '{c}' AS name, {c}::double AS value FROM d,
            (SELECT quantile_cont({c}::double, 0.25) AS q1, quantile_cont({c}::double, 0.75) AS q3 FROM d)
            WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)""",
    ),
)
def outlier_points(spark, folder):
    return P.outlier_points(dirty_events(spark, folder)).toDF("event_id", "name", "value")


def _top(c: str) -> str:
    return f"""SELECT '{c}' AS name, CASE WHEN k > 10 AND place > 9 THEN 'Other' ELSE v END AS value, sum(n)::bigint AS n
      FROM (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS place, count(*) OVER () AS k FROM
        (SELECT {c} AS v, count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY {c})) GROUP BY 1, 2"""


@query("top_values", PARTS_SQL + _each(("p_name", "p_brand", "p_type"), _top))
def top_values(spark, folder):
    found = P.top_values(dirty_parts(spark, folder), ["p_name", "p_brand", "p_type"])
    return found.select(F.col("column").alias("name"), "value", "n")


@query(
    "diag_categorical",
    PARTS_SQL
    + _each(
        ("p_name", "p_brand", "p_type"),
        lambda c: f"""SELECT '{c}' AS name, count(DISTINCT {c}) AS "unique", {_mode(c)} AS mode,
            (SELECT count(*) FROM d WHERE {c} = {_mode(c)}) AS frequency,
            round(100.0 * (SELECT count(*) FROM d WHERE {c} = {_mode(c)}) / count(*), 4)::double AS frequency_percent,
            count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 4)::double AS null_percent
            FROM d""",
    ),
)
def diag_categorical(spark, folder):
    found = P.categorical_diagnostics(dirty_parts(spark, folder))
    return found.select(
        F.col("column").alias("name"), "unique", "mode", "frequency",
        F.round("frequency_percent", 4).alias("frequency_percent"), "nulls",
        F.round("null_percent", 4).alias("null_percent"),
    )


# ------------------------------------------------------------------ insight

def _matrix(columns) -> str:
    varies = "min({0}) < max({0})".format
    lines = []
    for a in columns:
        for b in columns:
            r = "1.0::double" if a == b else f"round(corr({a}, {b}), 6)"
            lines.append(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN {varies(a)} AND {varies(b)} THEN {r} END AS r FROM d")
    return " UNION ALL ".join(lines)


@query("correlation", EVENTS_SQL + _matrix(_NUMERIC))
def correlation(spark, folder):
    found = I.correlation(dirty_events(spark, folder))
    return found.withColumn("r", F.round("r", 6))


@query("correlation_lineitem", f"WITH d AS (SELECT * FROM lineitem) {_matrix(_LINEITEM)}")
def correlation_lineitem(spark, folder):
    """All numeric columns of a table."""
    return I.correlation(table(spark, folder, "lineitem")).withColumn("r", F.round("r", 6))


@query(
    "correlation_range",
    EVENTS_SQL
    + f""", m AS ({_matrix(_NUMERIC)}), kept AS (SELECT DISTINCT a FROM m WHERE a <> b AND r BETWEEN 0.2 AND 1.0)
      SELECT m.a, m.b, m.r FROM m WHERE m.a IN (SELECT a FROM kept) AND m.b IN (SELECT a FROM kept)
      AND (SELECT count(*) FROM kept) > 1""",
)
def correlation_range(spark, folder):
    found = I.correlation_range(dirty_events(spark, folder), 0.2, 1.0)
    return found.withColumn("r", F.round("r", 6))


@query(
    "missingness",
    EVENTS_SQL
    + f"SELECT {', '.join(f'({c} IS NULL)::int AS {c}' for c in EVENTS)}, count(*) AS n FROM d GROUP BY ALL",
)
def missingness(spark, folder):
    return I.missingness_patterns(dirty_events(spark, folder))


@query(
    "missingness_map",
    EVENTS_SQL
    + f"""SELECT event_id AS row_id, {', '.join(f'({c} IS NULL)::int AS {c}' for c in EVENTS if c != 'event_id')} FROM d
      ORDER BY md5(concat(cast(event_id AS varchar), ':42')), event_id LIMIT 1000""",
)
def missingness_map(spark, folder):
    flags, _ = I.missingness_map(dirty_events(spark, folder).drop("event_id"))
    return flags.withColumnRenamed("_row_id", "row_id")


def _z(c: str) -> str:
    spread = f"(SELECT stddev_samp({c}) FROM d)"
    return f"CASE WHEN {spread} > 0 THEN round(({c} - (SELECT avg({c}) FROM d)) / {spread}, 5) ELSE 0.0::double END"


@query("zscore", EVENTS_SQL + f"SELECT event_id AS row_id, {', '.join(f'{_z(c)} AS {c}' for c in _NUMERIC)} FROM d")
def zscore(spark, folder):
    scaled = I.zscores(dirty_events(spark, folder))
    return scaled.select(F.col("_row_id").alias("row_id"), *[F.round(c, 5).alias(c) for c in _NUMERIC])


@query(
    "zscore_long",
    EVENTS_SQL + _each(_NUMERIC, lambda c: f"SELECT event_id, '{c}' AS feature, {_z(c)} AS value FROM d"),
)
def zscore_long(spark, folder):
    long = I.zscores_long(dirty_events(spark, folder))
    return long.select(F.col("_row_id").alias("event_id"), "feature", F.round("value", 5).alias("value"))
