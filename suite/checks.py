"""Rules, validation and the scout."""

from pyspark.sql import functions as F

from rinseframe.model import Rulebook
from rinseframe.operators import rules as R, scout as S
from rinseframe.operators.rows import duplicate_count
from rinseframe.plans.compile import apply_recipe
from suite.registry import query
from suite.values import NUMBER
from suite.views import EVENTS, EVENTS_SQL, ROWS_SQL, cleaned, dirty_events, dirty_rows

# ------------------------------------------------------------------ single rules: the violating rows

_COLUMNS = ("event_id", "user_id", "value", "value2", "event_type", "mixed")


def _rule(name: str, rule: dict, violated: str) -> None:
    @query(name, EVENTS_SQL + f"SELECT {', '.join(_COLUMNS)} FROM d WHERE {violated}")
    def run(spark, folder):
        df = dirty_events(spark, folder, *_COLUMNS)
        return R.violating_rows(df, [rule], limit=None).select(*_COLUMNS)


def _relation(op: str) -> dict:
    return {"type": "Relational Check", "col_a": "value2", "op": op, "col_b": "value", "target_type": "Feature"}


_rule("rule_null", {"type": "Null Check", "col": "value", "desc": "value is there"}, "value IS NULL")
_rule(
    "rule_range",
    {"type": "Range Check", "col": "value", "min": 0, "max": 100, "desc": "value in range"},
    "value IS NULL OR value < 0 OR value > 100",
)
_rule(
    "rule_range_text",
    {"type": "Range Check", "col": "mixed", "min": 100, "max": 5000.5, "desc": "mixed in range"},
    f"NOT coalesce(CASE WHEN regexp_matches(mixed, {NUMBER}) THEN try_cast(mixed AS double) END "
    "BETWEEN 100 AND 5000.5, false)",
)
_rule("rule_rel_gt", _relation(">"), "NOT coalesce(value2 > value, false)")
_rule("rule_rel_lt", _relation("<"), "NOT coalesce(value2 < value, false)")
_rule("rule_rel_eq", _relation("=="), "NOT coalesce(value2 = value, false)")
_rule("rule_rel_ne", _relation("!="), "NOT coalesce(value2 <> value, true)")
_rule("rule_rel_ge", _relation(">="), "NOT coalesce(value2 >= value, false)")
_rule("rule_rel_le", _relation("<="), "NOT coalesce(value2 <= value, false)")
_rule(
    "rule_rel_value",
    {"type": "Relational Check", "col_a": "value", "op": ">=", "value": 20.0, "target_type": "Value"},
    "NOT coalesce(value >= 20, false)",
)
_rule(
    "rule_rel_text_value",
    {"type": "Relational Check", "col_a": "event_type", "op": "==", "value": "click", "target_type": "Value"},
    "event_type <> 'click'",
)
_rule(
    "rule_expr",
    {"type": "Custom Expression", "query": "value > 5 AND event_type <> 'CLICK'", "desc": "expr"},
    "NOT coalesce(value > 5 AND event_type <> 'CLICK', false)",
)

# ------------------------------------------------------------------ the rulebook

BOOK = Rulebook.of(
    {"type": "Null Check", "col": "value", "desc": "value is there"},
    {"type": "Range Check", "col": "value", "min": 0, "max": 100, "desc": "value in range"},
    {"type": "Relational Check", "col_a": "value2", "op": ">", "col_b": "value", "target_type": "Feature",
     "desc": "value2 above value"},
    {"type": "Relational Check", "col_a": "value2", "op": "!=", "col_b": "value", "target_type": "Feature",
     "desc": "value2 differs"},
    {"type": "Relational Check", "col_a": "event_type", "op": "==", "value": "click", "target_type": "Value",
     "desc": "clicks only"},
    {"type": "Custom Expression", "query": "user_id BETWEEN 1 AND 100000", "desc": "known user"},
    {"type": "Null Check", "col": "event_id", "desc": "event has an id"},
    {"type": "Informational", "desc": "made for the tests"},
    {"type": "Null Check", "col": "empty_col", "desc": "switched off", "enabled": False},
    {"type": "Range Check", "col": "absent", "min": 0, "max": 1, "desc": "no such column"},
)

# (position, type, description, violating condition or None when the rule is broken)
_BOOK_SQL = [
    (0, "Null Check", "value is there", "value IS NULL"),
    (1, "Range Check", "value in range", "NOT coalesce(value BETWEEN 0 AND 100, false)"),
    (2, "Relational Check", "value2 above value", "NOT coalesce(value2 > value, false)"),
    (3, "Relational Check", "value2 differs", "NOT coalesce(value2 <> value, true)"),
    (4, "Relational Check", "clicks only", "NOT coalesce(event_type = 'click', false)"),
    (5, "Custom Expression", "known user", "NOT coalesce(user_id BETWEEN 1 AND 100000, false)"),
    (6, "Null Check", "event has an id", "event_id IS NULL"),
    (9, "Range Check", "no such column", None),
]
_COUNTS = " UNION ALL ".join(
    f"SELECT {p} AS position, '{t}' AS type, '{d}' AS \"desc\", "
    + (f"count(*) FILTER (WHERE {c}) AS violations, false AS broken FROM d" if c else "NULL, true")
    for p, t, d, c in _BOOK_SQL
)


@query("validate", EVENTS_SQL + f"SELECT * FROM ({_COUNTS}) WHERE violations > 0 OR broken")
def validate(spark, folder):
    found = R.validate(dirty_events(spark, folder), BOOK)
    return found.withColumn("broken", F.col("error").isNotNull()).drop("error")


@query("total_violations", EVENTS_SQL + f"SELECT cast(sum(violations) AS bigint) AS violations FROM ({_COUNTS})")
def total_violations(spark, folder):
    return R.total_violations(dirty_events(spark, folder), BOOK)


_ANY = " OR ".join(f"({c})" for *_, c in _BOOK_SQL if c)
_SHOWN = ("event_id", "user_id", "value", "value2", "event_type")


@query(
    "violating_rows", EVENTS_SQL + f"SELECT {', '.join(_SHOWN)} FROM d WHERE {_ANY} ORDER BY event_id LIMIT 100"
)
def violating_rows(spark, folder):
    return R.violating_rows(dirty_events(spark, folder), BOOK, 100).select(*_SHOWN)


def _cells(book: list, columns: dict[str, list[int]]) -> str:
    conditions = {p: c for p, _, _, c in book if c}
    lines = []
    for name, positions in columns.items():
        whens = " ".join(f"WHEN {conditions[p]} THEN {p}" for p in sorted(positions, reverse=True))
        lines.append(f"SELECT event_id, '{name}' AS name, CASE {whens} END AS rule FROM d")
    return f"SELECT * FROM ({' UNION ALL '.join(lines)}) WHERE rule IS NOT NULL"


_TOUCHED = {c: [5] for c in EVENTS} | {
    "value": [0, 1, 2, 3, 5], "value2": [2, 3, 5], "event_type": [4, 5], "event_id": [5, 6],
}


@query("violation_cells", EVENTS_SQL + _cells(_BOOK_SQL, _TOUCHED))
def violation_cells(spark, folder):
    cells = R.violation_cells(dirty_events(spark, folder), BOOK)
    return cells.select(F.col("_row_id").alias("event_id"), F.col("column").alias("name"), "rule")


def _resolved(df, rule, method):
    return cleaned(df, R.resolution(Rulebook.of(rule).rules[0], method))


_RANGE = {"type": "Range Check", "col": "value", "min": 1.0, "max": 90.0, "desc": "value in range"}


@query(
    "resolve_cap",
    EVENTS_SQL
    + "SELECT event_id, CASE WHEN value < 1 THEN 1 WHEN value > 90 THEN 90 ELSE value END::double AS value FROM d",
)
def resolve_cap(spark, folder):
    return _resolved(dirty_events(spark, folder, "event_id", "value"), _RANGE, "Cap at Bounds")


@query("resolve_drop", EVENTS_SQL + "SELECT event_id, value FROM d WHERE value BETWEEN 1 AND 90")
def resolve_drop(spark, folder):
    return _resolved(dirty_events(spark, folder, "event_id", "value"), _RANGE, "Drop Rows")


@query(
    "resolve_fill",
    EVENTS_SQL + "SELECT event_id, round(coalesce(value2, (SELECT avg(value2) FROM d)), 5) AS value2 FROM d",
)
def resolve_fill(spark, folder):
    rule = {"type": "Null Check", "col": "value2", "desc": "value2 is there"}
    filled = _resolved(dirty_events(spark, folder, "event_id", "value2"), rule, "Fill with Mean")
    return filled.withColumn("value2", F.round("value2", 5))


_EXPRESSIONS = ["value > 5", "value > 1000000000", "no_such_column > 1", "value >> > 1", "ts + true"]


@query(
    "expression_matches",
    EVENTS_SQL
    + """SELECT 'value > 5' AS expression, count(*) > 0 AS accepted, CASE WHEN count(*) > 0 THEN '' ELSE 'no match' END
         AS reason FROM d WHERE value > 5
         UNION ALL SELECT 'value > 1000000000', count(*) > 0, CASE WHEN count(*) > 0 THEN '' ELSE 'no match' END
         FROM d WHERE value > 1000000000
         UNION ALL SELECT 'no_such_column > 1', false, 'column'
         UNION ALL SELECT 'value >> > 1', false, 'syntax'
         UNION ALL SELECT 'ts + true', false, 'type'""",
)
def expression_matches(spark, folder):
    df = dirty_events(spark, folder)
    rows = [(q, *R.check_expression(df, q)) for q in _EXPRESSIONS]
    return spark.createDataFrame(rows, "expression string, accepted boolean, reason string")


@query(
    "range_defaults",
    EVENTS_SQL
    + "SELECT 'value' AS name, min(value) AS low, max(value) AS high FROM d "
    + "UNION ALL SELECT 'value2', min(value2), max(value2) FROM d "
    + "UNION ALL SELECT 'user_id', min(user_id)::double, max(user_id)::double FROM d",
)
def range_defaults(spark, folder):
    found = R.range_defaults(dirty_events(spark, folder), ["value", "value2", "user_id", "event_type"])
    return found.toDF("name", "low", "high")


# ------------------------------------------------------------------ scout

_NUMBERS = ["event_id", "user_id", "value", "value2", "constant_col", "mostly_null", "empty_col"]
_TEXTS = ["event_type", "mixed", "ts_text"]
_SPACE = r"'^\s+|\s+$'"


def _detector(name: str, i: int, kind: str, measure: str, condition: str) -> str:
    return (
        f"SELECT {i} AS place, '{name}' AS name, '{kind}' AS type, round(({measure})::double, 4) AS measure "
        f"FROM d HAVING {condition}"
    )


def _null_share(c: str) -> str:
    return f"100.0 * (count(*) - count({c})) / count(*)"


def _outliers(c: str) -> str:
    return (
        f"SELECT 0 AS place, '{c}' AS name, 'Range Check' AS type, count(*)::double AS measure FROM d, "
        f"(SELECT quantile_cont({c}::double, 0.25) AS q1, quantile_cont({c}::double, 0.75) AS q3 FROM d) "
        f"WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) HAVING count(*) > 0"
    )


_NULLS_SQL = [
    _detector(c, 0, "Redundant Column", _null_share(c), f"{_null_share(c)} > 90") for c in EVENTS
] + [
    _detector(c, 0, "Null Check", _null_share(c), f"{_null_share(c)} > 0 AND {_null_share(c)} <= 90") for c in EVENTS
]
_CONSTANT_SQL = [
    _detector(c, 0, "Constant Value", f"count({c}) > 0", f"count(DISTINCT {c}) <= 1") for c in EVENTS
]
_OUTLIER_SQL = [_outliers(c) for c in _NUMBERS]
_SKEW_SQL = [
    _detector(c, 0, "Distribution Warning", f"skewness({c}::double)", f"abs(skewness({c}::double)) > 2")
    for c in ("event_id", "user_id", "value", "value2")
]


def _mixed_share(c: str) -> str:
    return f"count(*) FILTER (WHERE regexp_matches({c}, {NUMBER})) / count({c})"


_MIXED_SQL = [
    _detector(c, 0, "Type Cast", _mixed_share(c), f"{_mixed_share(c)} >= 0.60 AND {_mixed_share(c)} < 0.99")
    for c in _TEXTS
]
_CARDINALITY_SQL = [
    _detector(c, 0, "High Cardinality", f"100.0 * count(DISTINCT {c}) / count(*)",
              f"100.0 * count(DISTINCT {c}) / count(*) > 80")
    for c in _TEXTS
]
_SPACE_SQL = [
    _detector(c, 0, "Formatting Issue", "1", f"bool_or(regexp_matches({c}, {_SPACE}))") for c in _TEXTS
]


def _scout(name: str, kinds: set[str] | None, parts: list[str]) -> None:
    @query(name, EVENTS_SQL + f"SELECT name, type, measure FROM ({' UNION ALL '.join(parts)})")
    def run(spark, folder):
        found = S.scout(dirty_events(spark, folder))
        if kinds is not None:
            found = found.filter(F.col("type").isin(*kinds))
        return found.select(F.col("column").alias("name"), "type", F.round("measure", 4).alias("measure"))


_scout("scout_nulls", {"Redundant Column", "Null Check"}, _NULLS_SQL)
_scout("scout_constant", {"Constant Value"}, _CONSTANT_SQL)
_scout("scout_outliers", {"Range Check"}, _OUTLIER_SQL)
_scout("scout_skew", {"Distribution Warning"}, _SKEW_SQL)
_scout("scout_mixed", {"Type Cast"}, _MIXED_SQL)
_scout("scout_cardinality", {"High Cardinality"}, _CARDINALITY_SQL)
_scout("scout_whitespace", {"Formatting Issue"}, _SPACE_SQL)
_scout(
    "scout_all",
    None,
    _NULLS_SQL + _CONSTANT_SQL + _OUTLIER_SQL + _SKEW_SQL + _MIXED_SQL + _CARDINALITY_SQL + _SPACE_SQL,
)


@query(
    "scout_accept",
    EVENTS_SQL
    + f"""SELECT event_id, value, regexp_replace(event_type, {_SPACE}, '', 'g') AS event_type,
          CASE WHEN regexp_matches(mixed, {NUMBER}) THEN try_cast(mixed AS double) END AS mixed FROM d""",
)
def scout_accept(spark, folder):
    """Findings on four columns turned into steps; the finding-free columns stay as they are."""
    df = dirty_events(spark, folder, "event_id", "value", "event_type", "mixed", "mostly_null", "empty_col")
    found = [p for p in S.find_problems(df) if (p.column, p.type) != ("empty_col", "Constant Value")]
    found = [p for p in found if (p.column, p.type) != ("mostly_null", "Constant Value")]
    recipe, _, _ = S.accept(found)
    return apply_recipe(df, recipe)[0].drop("_row_id")


@query(
    "quick_duplicates",
    ROWS_SQL
    + "SELECT (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type, constant_col FROM d))"
    + " AS duplicates",
)
def quick_duplicates(spark, folder):
    return duplicate_count(dirty_rows(spark, folder))


@query(
    "quick_empty",
    EVENTS_SQL
    + f"""SELECT (SELECT {' + '.join(f'(count({c}) = 0)::bigint' for c in EVENTS)} FROM d) AS empty_columns,
          (SELECT count(*) FROM d WHERE {' AND '.join(f'{c} IS NULL' for c in EVENTS)}) AS empty_rows""",
)
def quick_empty(spark, folder):
    return S.empty_counts(dirty_events(spark, folder))


@query(
    "padded_columns",
    EVENTS_SQL
    + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS name, count(*) FILTER (WHERE regexp_matches({c}, {_SPACE})) AS padded FROM d) "
        "WHERE padded > 0"
        for c in _TEXTS
    ),
)
def padded_columns(spark, folder):
    return S.padded_columns(dirty_events(spark, folder)).toDF("name", "padded")
