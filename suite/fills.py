"""Filling missing values."""

from pyspark.sql import functions as F

from rinseframe.operators import fill
from suite.registry import query
from suite.views import EVENTS_SQL, PARTS_SQL, cleaned, dirty_events, dirty_parts, table


def _fill(df, column, value):
    return cleaned(df, {"action": "fill_null", "column": column, "value": value})


@query(
    "fill_mean", EVENTS_SQL + "SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM d)), 6) AS value FROM d"
)
def fill_mean(spark, folder):
    filled = _fill(dirty_events(spark, folder, "event_id", "value"), "value", "mean")
    return filled.withColumn("value", F.round("value", 6))


@query(
    "fill_median",
    EVENTS_SQL + "SELECT event_id, round(coalesce(value, (SELECT median(value) FROM d)), 6) AS value FROM d",
)
def fill_median(spark, folder):
    filled = _fill(dirty_events(spark, folder, "event_id", "value"), "value", "median")
    return filled.withColumn("value", F.round("value", 6))


@query(
    "fill_mode",
    PARTS_SQL
    + """SELECT p_partkey, coalesce(p_brand, (SELECT p_brand FROM d WHERE p_brand IS NOT NULL
         GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 1)) AS p_brand FROM d""",
)
def fill_mode(spark, folder):
    return _fill(dirty_parts(spark, folder, "p_partkey", "p_brand"), "p_brand", "mode")


@query("fill_constant", EVENTS_SQL + "SELECT event_id, coalesce(value2, -1.0::double) AS value2 FROM d")
def fill_constant(spark, folder):
    return _fill(dirty_events(spark, folder, "event_id", "value2"), "value2", -1.0)


@query(
    "fill_constant_text",
    "WITH d AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS user_id "
    "FROM events) SELECT event_id, coalesce(cast(user_id AS varchar), 'none') AS user_id FROM d",
)
def fill_constant_text(spark, folder):
    gaps = F.when(F.col("event_id") % 7 != 0, F.col("user_id"))
    df = table(spark, folder, "events").select("event_id", gaps.alias("user_id"))
    return _fill(df, "user_id", "none")


# every missing row against every donor, ranked by (distance, donor); a value counts where both rows have it
_PREDICTORS = ["user_id", "value2", "constant_col", "mostly_null"]
_BOTH = " + ".join(f"(CASE WHEN m.{c} IS NULL OR k.{c} IS NULL THEN 0 ELSE 1 END)" for c in _PREDICTORS)
_GAPS = " + ".join(f"coalesce((m.{c} - k.{c})::double * (m.{c} - k.{c})::double, 0)" for c in _PREDICTORS)
_PAIRS = f""", m AS (SELECT * FROM d WHERE value IS NULL), k AS (SELECT * FROM d WHERE value IS NOT NULL),
pairs AS (SELECT m.event_id AS id, k.event_id AS donor, k.value AS y,
  ({len(_PREDICTORS) + 1}.0::double / ({_BOTH})) * ({_GAPS}) AS d2 FROM m, k),
near AS (SELECT id, y, row_number() OVER (PARTITION BY id ORDER BY d2, donor) AS n FROM pairs),
fills AS (SELECT id, avg(y) AS y FROM near WHERE n <= 5 GROUP BY id)
SELECT event_id, {", ".join(_PREDICTORS)}, round(coalesce(value, y), 6) AS value
FROM d LEFT JOIN fills ON event_id = id"""


@query("fill_knn", EVENTS_SQL + _PAIRS)
def fill_knn(spark, folder):
    # by all numeric columns that hold values; the row id is the event id, and not a predictor
    filled = _fill_keeping_id(dirty_events(spark, folder, *_PREDICTORS, "value"), "value", "knn")
    return filled.withColumn("value", F.round("value", 6))


def _fill_keeping_id(df, column, value):
    from rinseframe.plans.compile import apply_recipe

    out, messages = apply_recipe(df, [{"action": "fill_null", "column": column, "value": value}])
    if messages:
        raise ValueError("; ".join(messages))
    return out.withColumnRenamed("_row_id", "event_id")


# one column with gaps, one predictor: the evidence updates of the ridge as a recursive query
_RIDGE = """, k AS (SELECT user_id::double AS x, value AS y FROM d WHERE value IS NOT NULL),
s AS (SELECT count(*)::double AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx,
      covar_pop(x, y) * count(*) AS sxy, var_pop(y) * count(*) AS syy FROM k),
steps AS (
  SELECT 0 AS i, 1.0 / (syy / n + 2.220446049250313e-16) AS a, 1.0::double AS l, NULL::double AS c, false AS done FROM s
  UNION ALL
  SELECT i + 1,
         (n - g + 2e-6) / (greatest(syy - 2 * c2 * sxy + c2 * c2 * sxx, 0) + 2e-6),
         (g + 2e-6) / (c2 * c2 + 2e-6), c2, i > 0 AND abs(c - c2) < 1e-3
  FROM (SELECT i, a, l, c, n, sxx, sxy, syy, sxy / (sxx + l / a) AS c2, a * sxx / (l + a * sxx) AS g, done
        FROM steps, s WHERE NOT done AND i < 300) t
),
fit AS (SELECT sxy / (sxx + l / a) AS b, mx, my FROM steps, s ORDER BY i DESC LIMIT 1)
SELECT event_id, user_id, round(coalesce(value, my + b * (user_id - mx)), 5) AS value FROM d, fit"""


@query("fill_iterative", EVENTS_SQL.replace("WITH d", "WITH RECURSIVE d", 1) + _RIDGE)
def fill_iterative(spark, folder):
    filled = _fill_keeping_id(dirty_events(spark, folder, "user_id", "value"), "value", "iterative")
    return filled.select("event_id", "user_id", F.round("value", 5).alias("value"))


@query("fill_iterative_chained")
def fill_iterative_chained(spark, folder):
    """Two columns with gaps, so the rounds matter; checked against a row-by-row version in the tests."""
    filled = _fill_keeping_id(dirty_events(spark, folder, "user_id", "value", "value2"), "value", "iterative")
    return filled.withColumn("value", F.round("value", 4))


_SCORE = """SELECT name, round(r, 6) AS r FROM (
  SELECT 'l_quantity' AS name, abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem
  UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)) FROM lineitem
  UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)) FROM lineitem
  UNION ALL SELECT 'l_partkey', abs(corr(l_partkey, l_extendedprice)) FROM lineitem
  UNION ALL SELECT 'l_suppkey', abs(corr(l_suppkey, l_extendedprice)) FROM lineitem
  UNION ALL SELECT 'l_orderkey', abs(corr(l_orderkey, l_extendedprice)) FROM lineitem
  UNION ALL SELECT 'l_linenumber', abs(corr(l_linenumber, l_extendedprice)) FROM lineitem)
ORDER BY r DESC, name LIMIT 3"""


@query("top_predictors", _SCORE)
def top_predictors(spark, folder):
    best = fill.top_predictors(table(spark, folder, "lineitem"), "l_extendedprice", 3)
    return spark.createDataFrame([(c, round(r, 6)) for c, r in best], "name string, r double")

