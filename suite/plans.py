"""Whole recipes, lineage and reports."""

from pyspark.sql import functions as F

from rinseframe.model import Recipe, Rulebook
from rinseframe.plans import compile as C, report as L
from rinseframe.plans.saved import CleaningPlan
from suite.checks import _BOOK_SQL, _COUNTS, BOOK
from suite.registry import query
from suite.values import NUMBER, PADDING
from suite.views import EVENTS, EVENTS_SQL, dirty_events

RECIPE = Recipe.of(
    {"action": "drop_column", "column": "constant_col"},
    {"action": "strip_whitespace", "column": "All"},
    {"action": "normalize_text", "column": "event_type", "value": "lowercase"},
    {"action": "replace", "column": "event_type", "find": "click", "replace": "tap", "regex": False},
    {"action": "cast_type", "column": "mixed", "dtype": "float64"},
    {"action": "cast_type", "column": "ts_text", "dtype": "datetime64[ns]"},
    {"action": "drop_nulls", "column": "ts_text"},
    {"action": "extract_datetime", "column": "ts_text", "component": "day", "new_column": "day"},
    {"action": "fill_null", "column": "value", "value": "median"},
    {"action": "cap_range", "column": "value", "min": 0.0, "max": 100.0},
    {"action": "drop_empty_columns"},
    {"action": "rename_column", "column": "value2", "value": "total"},
    {"action": "drop_violated", "rule": {"type": "Null Check", "col": "total", "desc": "total is there"}},
)

# the same recipe, one state per step
_S2 = f"""s AS (SELECT event_id, ts, user_id, value, value2, regexp_replace(event_type, {PADDING}, '', 'g') AS event_type,
  regexp_replace(mixed, {PADDING}, '', 'g') AS mixed, regexp_replace(ts_text, {PADDING}, '', 'g') AS ts_text,
  mostly_null, empty_col FROM d)"""
_S4 = """t AS (SELECT * REPLACE (CASE WHEN lower(event_type) = 'click' THEN 'tap' ELSE lower(event_type) END AS event_type)
  FROM s)"""
_S6 = f"""u AS (SELECT * REPLACE (CASE WHEN regexp_matches(mixed, {NUMBER}) THEN try_cast(mixed AS double) END AS mixed,
  try_cast(ts_text AS timestamp) AS ts_text) FROM t)"""
_S8 = "v AS (SELECT *, cast(day(ts_text) AS bigint) AS day FROM u WHERE ts_text IS NOT NULL)"
_S9 = "w AS (SELECT * REPLACE (coalesce(value, (SELECT median(value) FROM v)) AS value) FROM v)"
_S10 = "x AS (SELECT * REPLACE (greatest(least(value, 100), 0)::double AS value) FROM w)"
_STATES = EVENTS_SQL + ", " + ", ".join((_S2, _S4, _S6, _S8, _S9, _S10)) + " "


@query(
    "recipe_full",
    _STATES + "SELECT * EXCLUDE (empty_col, value2), value2 AS total FROM x WHERE value2 IS NOT NULL",
)
def recipe_full(spark, folder):
    return C.apply_recipe(dirty_events(spark, folder), RECIPE)[0].drop("_row_id")


@query("recipe_prefix", _STATES + "SELECT * FROM u")
def recipe_prefix(spark, folder):
    return C.apply_prefix(dirty_events(spark, folder), RECIPE, 6).drop("_row_id")


def _held(columns) -> str:
    return f"(100 * ({' + '.join(f'count({c})' for c in columns)}) // ({len(columns)} * count(*)))::bigint"


_C1 = [c for c in EVENTS if c != "constant_col"]
_C8 = _C1 + ["day"]
_C11 = [c for c in _C8 if c != "empty_col"]
# (step, columns, relation) of every state
_TRAIL = [
    (0, list(EVENTS), "d"), (1, _C1, "d"), (2, _C1, "s"), (3, _C1, "s"), (4, _C1, "t"),
    (5, _C1, "(SELECT * REPLACE (CASE WHEN regexp_matches(mixed, " + NUMBER + ") THEN 1 END AS mixed) FROM t)"),
    (6, _C1, "u"), (7, _C1, "v"), (8, _C8, "v"), (9, _C8, "w"), (10, _C8, "x"), (11, _C11, "x"), (12, _C11, "x"),
    (13, _C11, "(SELECT * FROM x WHERE value2 IS NOT NULL)"),
]


@query(
    "audit_trail",
    _STATES
    + "SELECT *, coalesce(lag(rows) OVER (ORDER BY step) - rows, 0)::bigint AS removed FROM ("
    + " UNION ALL ".join(f"SELECT {k} AS step, {_held(cs)} AS health, count(*) AS rows FROM {t}" for k, cs, t in _TRAIL)
    + ")",
)
def audit_trail(spark, folder):
    return L.audit_trail(dirty_events(spark, folder), RECIPE).select("step", "health", "rows", "removed")


_NULLS = {
    "before": (len(EVENTS), f"{len(EVENTS)} * count(*) - ({' + '.join(f'count({c})' for c in EVENTS)})", "d"),
    "after": (len(_C11), f"{len(_C11)} * count(*) - ({' + '.join(f'count({c})' for c in _C11)})", _TRAIL[-1][2]),
}


def _side(name: str) -> str:
    width, nulls, relation = _NULLS[name]
    return f"""{name}_side AS (SELECT unnest(['rows', 'columns', 'nulls', 'null_percent']) AS metric,
      unnest([count(*)::double, {width}::double, ({nulls})::double, ({nulls}) * 100.0::double / ({width} * count(*))]) AS v
      FROM {relation})"""


@query(
    "report_impact",
    _STATES.rstrip()
    + f""", {_side('before')}, {_side('after')}
      SELECT metric, round(b.v, 6) AS before, round(a.v, 6) AS after, round(a.v - b.v, 6) AS change
      FROM before_side b JOIN after_side a USING (metric)""",
)
def report_impact(spark, folder):
    df = dirty_events(spark, folder)
    impact = L.cleaning_impact(df, C.apply_recipe(df, RECIPE)[0])
    return impact.select("metric", *[F.round(c, 6).alias(c) for c in ("before", "after", "change")])


@query(
    "report_rules",
    EVENTS_SQL
    + f"""SELECT position, type, "desc", CASE WHEN broken THEN 'ERROR' WHEN violations > 0 THEN 'FAILED' ELSE 'PASSED' END
      AS status, violations FROM ({_COUNTS}) UNION ALL SELECT 7, 'Informational', 'made for the tests', 'INFO', NULL""",
)
def report_rules(spark, folder):
    return L.rule_summary(dirty_events(spark, folder), BOOK).drop("error")


_HITS = " UNION ALL ".join(f"SELECT {p} AS position, event_id FROM d WHERE {c}" for p, _, _, c in _BOOK_SQL if c)


@query(
    "report_details",
    EVENTS_SQL
    + f"""SELECT position, event_id FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY event_id) AS n
      FROM ({_HITS})) WHERE n <= 100""",
)
def report_details(spark, folder):
    return L.violation_details(dirty_events(spark, folder), BOOK).withColumnRenamed("_row_id", "event_id")


_SAVED = CleaningPlan(
    RECIPE.prefix(10),
    Rulebook.of(
        {"type": "Range Check", "col": "value", "min": 0, "max": 50, "desc": "value up to 50"},
        {"type": "Null Check", "col": "ts_text", "desc": "date is there"},
        {"type": "Null Check", "col": "mixed", "desc": "mixed is there"},
    ),
)


@query(
    "saved_plan_run",
    _STATES
    + """SELECT * FROM (SELECT 'value up to 50' AS "desc", count(*) FILTER (WHERE NOT value BETWEEN 0 AND 50) AS violations
      FROM x UNION ALL SELECT 'date is there', count(*) FILTER (WHERE ts_text IS NULL) FROM x
      UNION ALL SELECT 'mixed is there', count(*) FILTER (WHERE mixed IS NULL) FROM x) WHERE violations > 0""",
)
def saved_plan_run(spark, folder):
    """The plan goes through JSON, as when it is kept in a file and used on the next delivery."""
    plan = CleaningPlan.from_json(_SAVED.to_json())
    _, broken, _ = plan.run(dirty_events(spark, folder))
    return broken.select("desc", "violations")
