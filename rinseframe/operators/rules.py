"""Validation: rules become boolean violation columns, evaluated together in one pass."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rinseframe.frames import col, data_columns, dtype, groups_of, is_numeric, is_text, is_time, quoted
from rinseframe.functions.casts import as_number
from rinseframe.model import (
    BrokenRule, CapRange, DropNulls, DropViolated, ExpressionCheck, FillNull, LogTransform, Note, NullCheck,
    RangeCheck, RelationalCheck, ROW_ID, Rule, Rulebook, Step,
)
from rinseframe.operators.stats import AGGREGATE_WIDTH

DETAIL_ROWS = 100


class RuleError(ValueError):
    """A rule that cannot be evaluated on a table."""


def rules_of(rules: Rulebook | Iterable) -> tuple[Rule, ...]:
    return rules.rules if isinstance(rules, Rulebook) else Rulebook.of(*rules).rules


# ------------------------------------------------------------------ masks


def _require(df: DataFrame, *names: str) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise RuleError(f"column '{absent[0]}' was not found")


def _kind(t: T.DataType) -> str:
    if is_numeric(t) or isinstance(t, T.BooleanType):
        return "number"
    return "text" if is_text(t) else "time" if is_time(t) else "other"


def _operand(df: DataFrame, name: str) -> Column:
    return col(name).cast("int") if isinstance(dtype(df, name), T.BooleanType) else col(name)


def _bound(t: T.DataType, value: float) -> Column:
    """A number to compare a column with; whole for whole columns, so that the scan can use it."""
    if isinstance(t, T.IntegralType) and float(value).is_integer() and abs(value) < 2**53:
        return F.lit(int(value))
    return F.lit(value)


def _literal(value, t: T.DataType) -> tuple[Column, str]:
    if isinstance(value, bool):
        return F.lit(int(value)), "number"
    if isinstance(value, (int, float)):
        return _bound(t, value), "number"
    if _kind(t) == "time":
        return F.lit(str(value)).try_cast("timestamp_ntz"), "time"
    return F.lit(str(value)), "text"


def _relation(df: DataFrame, rule: RelationalCheck) -> Column:
    """A comparison with NULL is unknown, except ``!=``, which holds."""
    _require(df, *rule.columns())
    a, type_a = _operand(df, rule.col_a), dtype(df, rule.col_a)
    kind_a = _kind(type_a)
    if rule.col_b is not None:
        b, kind_b = _operand(df, rule.col_b), _kind(dtype(df, rule.col_b))
    else:
        b, kind_b = _literal(rule.value, type_a)
    if rule.op == "!=":
        return F.lit(True) if kind_a != kind_b else (a != b) | a.isNull() | b.isNull()
    if rule.op == "==":
        return F.lit(False) if kind_a != kind_b else a == b
    compare = {">": lambda: a > b, "<": lambda: a < b, ">=": lambda: a >= b, "<=": lambda: a <= b}.get(rule.op)
    if compare is None:
        return F.lit(False)
    if kind_a != kind_b or kind_a == "other":
        raise RuleError(f"'{rule.op}' cannot compare {kind_a} with {kind_b}")
    return compare()


def _range(df: DataFrame, rule: RangeCheck) -> Column:
    _require(df, rule.col)
    t = dtype(df, rule.col)
    if is_numeric(t):
        x = col(rule.col)  # NaN is above every bound
    else:
        try:
            x = as_number(df, rule.col)
        except TypeError as exc:
            raise RuleError(str(exc)) from exc
    return (x >= _bound(t, rule.min)) & (x <= _bound(t, rule.max))


def _valid(df: DataFrame, rule: Rule) -> Column:
    if isinstance(rule, NullCheck):
        _require(df, rule.col)
        return col(rule.col).isNotNull()
    if isinstance(rule, RangeCheck):
        return _range(df, rule)
    if isinstance(rule, RelationalCheck):
        return _relation(df, rule)
    if isinstance(rule, ExpressionCheck):
        return F.expr(rule.query)
    if isinstance(rule, BrokenRule) and rule.problem:
        raise RuleError(rule.problem)
    return F.lit(True)


def valid(df: DataFrame, rule: Rule) -> Column:
    """A predicate that is true on exactly the rows that keep the rule (false or NULL on the others).

    Left as plain as it is written, so that it can be pushed into a scan. Raises RuleError; runs no job.
    """
    try:
        holds = _valid(df, rule)
        df.filter(holds)
        return holds
    except RuleError as exc:
        raise RuleError(f"{rule.type or 'rule'} ({rule.desc or 'no description'}): {exc}") from exc
    except PySparkException as exc:
        text = str(exc).strip().splitlines()[0]
        raise RuleError(f"{rule.type} ({rule.desc or 'no description'}): {text}") from exc


def violation(df: DataFrame, rule: Rule) -> Column:
    """A column that is true on violating rows and never NULL. Raises RuleError; runs no job."""
    return ~F.coalesce(valid(df, rule), F.lit(False))


@dataclass(frozen=True)
class Resolved:
    position: int
    rule: Rule
    mask: Column | None
    error: str | None


def resolve_rules(df: DataFrame, rules: Rulebook | Iterable) -> list[Resolved]:
    """Each enabled rule with its mask, or with its error; a bad rule does not affect the others."""
    out = []
    for i, rule in enumerate(rules_of(rules)):
        if not rule.enabled:
            continue
        try:
            out.append(Resolved(i, rule, violation(df, rule), None))
        except RuleError as exc:
            out.append(Resolved(i, rule, None, f"Error: {exc}"))
    return out


def _checked(df: DataFrame, rules) -> list[Resolved]:
    return [r for r in resolve_rules(df, rules) if not isinstance(r.rule, Note)]


# ------------------------------------------------------------------ counts

_RESULT_FIELDS = "position int, type string, desc string, violations bigint, error string"


def _count_rows(df: DataFrame, checked: list[Resolved]) -> DataFrame:
    """(position, type, desc, violations, error) for every checked rule, from one aggregate.

    A book of very many rules takes a few, so that the generated code stays compilable.
    """
    if not checked:
        return df.sparkSession.createDataFrame([], _RESULT_FIELDS)
    return reduce(DataFrame.unionByName, [_counted(df, part) for part in groups_of(checked, AGGREGATE_WIDTH)])


def _counted(df: DataFrame, checked: list[Resolved]) -> DataFrame:
    sums = [F.count_if(r.mask).alias(f"v{r.position}") for r in checked if r.mask is not None]
    lines = [
        F.struct(
            F.lit(r.position).alias("position"),
            F.lit(_type_name(r.rule)).alias("type"),
            F.lit(r.rule.desc).alias("desc"),
            (F.col(f"v{r.position}") if r.mask is not None else F.lit(None).cast("bigint")).alias("violations"),
            F.lit(r.error).cast("string").alias("error"),
        )
        for r in checked
    ]
    totals = df.agg(*sums) if sums else df.sparkSession.range(1)
    return totals.select(F.inline(F.array(*lines)))


def _type_name(rule: Rule) -> str:
    return rule.kind if isinstance(rule, BrokenRule) else rule.type


def rule_counts(df: DataFrame, rules: Rulebook | Iterable) -> DataFrame:
    """Every active rule with its violation count, zero included, or its error."""
    return _count_rows(df, _checked(df, rules))


def validate(df: DataFrame, rules: Rulebook | Iterable) -> DataFrame:
    """(position, type, desc, violations, error) of the rules that fail or cannot be evaluated.

    Disabled and informational rules are left out. All masks share one scan.
    """
    return rule_counts(df, rules).filter((F.col("violations") > 0) | F.col("error").isNotNull())


def violation_report(df: DataFrame, rules: Rulebook | Iterable) -> dict[str, int | str]:
    """Description -> count or error text, evaluated now.

    An expression may also fail on some value while it runs; then the rules are
    evaluated one by one, so that only the failing one reports an error.
    """
    checked = _checked(df, rules)
    try:
        rows = _count_rows(df, checked).collect()
        found = {r["position"]: (r["violations"], r["error"]) for r in rows}
    except PySparkException:
        found = {}
        for r in checked:
            try:
                row = _count_rows(df, [r]).first()
                found[r.position] = (row["violations"], row["error"])
            except PySparkException as exc:
                found[r.position] = (None, f"Error: {str(exc).strip().splitlines()[0]}")
    out: dict[str, int | str] = {}
    for r in checked:
        count, error = found[r.position]
        if error:
            out[r.rule.desc] = error
        elif count:
            out[r.rule.desc] = count
    return out


def total_violations(df: DataFrame, rules: Rulebook | Iterable) -> DataFrame:
    return rule_counts(df, rules).agg(F.coalesce(F.sum("violations"), F.lit(0)).cast("bigint").alias("violations"))


# ------------------------------------------------------------------ rows and cells


def violating_rows(df: DataFrame, rules: Rulebook | Iterable, limit: int | None = DETAIL_ROWS) -> DataFrame:
    """Rows that break any rule, the first ``limit`` by row id (all with None)."""
    masks = [r.mask for r in _checked(df, rules) if r.mask is not None]
    hit = df.filter(reduce(lambda a, b: a | b, masks) if masks else F.lit(False))
    return hit if limit is None else hit.orderBy(ROW_ID).limit(limit)


def _rule_cells(df: DataFrame, rule: Rule) -> tuple[str, ...]:
    return tuple(data_columns(df)) if isinstance(rule, ExpressionCheck) else rule.columns()


def violation_cells(df: DataFrame, rules: Rulebook | Iterable) -> DataFrame:
    """(_row_id, column, rule): cells that break a rule; where several do, the last rule in the book.

    Row-wise: the winner of each cell is picked inside the row, nothing is shuffled.
    """
    checked = [r for r in _checked(df, rules) if r.mask is not None]
    flags = df.select("*", *[r.mask.alias(f"_rf_m{r.position}") for r in checked])
    cells = []
    for c in data_columns(df):
        marks = [
            F.when(F.col(f"_rf_m{r.position}"), F.lit(r.position))
            for r in reversed(checked)
            if c in _rule_cells(df, r.rule)
        ]
        if marks:
            cells.append(F.struct(F.lit(c).alias("column"), F.coalesce(*marks).alias("rule")))
    if not cells:
        return df.select(ROW_ID).filter("false").select(ROW_ID, F.lit("").alias("column"), F.lit(0).alias("rule"))
    return flags.select(ROW_ID, F.inline(F.filter(F.array(*cells), lambda x: x["rule"].isNotNull())))


def violation_hits(df: DataFrame, rules: Rulebook | Iterable) -> DataFrame:
    """(_row_id, position): one row per broken rule and row."""
    checked = [r for r in _checked(df, rules) if r.mask is not None]
    if not checked:
        return df.select(ROW_ID, F.lit(0).alias("position")).filter("false")
    hits = F.array(*[F.when(r.mask, F.lit(r.position)) for r in checked])
    return df.select(ROW_ID, F.explode(F.array_compact(hits)).alias("position"))


# ------------------------------------------------------------------ helpers for rule editing


def check_expression(df: DataFrame, query: str) -> tuple[bool, str]:
    """Whether an expression may become a rule, and why not.

    Reasons: ``syntax``, ``column``, ``type``, ``other`` (it failed while running),
    ``no match`` (no row satisfies it). Looks for one matching row, not for all.
    """
    try:
        wanted = df.filter(F.expr(query))
        if wanted.limit(1).count() or df.limit(1).count() == 0:
            return True, ""
        return False, "no match"
    except AnalysisException as exc:
        condition = exc.getCondition() or ""
        if condition.startswith("PARSE"):
            return False, "syntax"
        return False, "column" if condition.startswith("UNRESOLVED") else "type" if "TYPE" in condition else "other"
    except PySparkException as exc:
        condition = exc.getCondition() or ""
        return False, "syntax" if condition.startswith("PARSE") else "other"


def range_defaults(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, min, max) of numeric columns, as bounds to start a range rule with."""
    names = [c for c in (columns or data_columns(df)) if is_numeric(dtype(df, c))]
    bounds = [F.min(col(c)).cast("double").alias(f"lo{i}") for i, c in enumerate(names)]
    bounds += [F.max(col(c)).cast("double").alias(f"hi{i}") for i, c in enumerate(names)]
    lines = [
        F.struct(F.lit(c).alias("column"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(names)
    ]
    return df.agg(*bounds).select(F.inline(F.array(*lines)))


def _uses(df: DataFrame, rule: Rule, column: str) -> bool:
    if not isinstance(rule, ExpressionCheck):
        return column in rule.columns()
    try:
        df.select(F.expr(rule.query))
    except PySparkException:
        return False
    try:
        df.drop(col(column)).select(F.expr(rule.query))
        return False
    except PySparkException:
        return True


def rules_using(df: DataFrame, rules: Rulebook | Iterable, column: str) -> list[str]:
    """Descriptions of rules that need a column; for expressions this is asked of the analyser."""
    return [r.desc for r in rules_of(rules) if column in df.columns and _uses(df, r, column)]


def rename_in_rules(df: DataFrame, rules: Rulebook, names: dict[str, str]) -> tuple[Rulebook, list[str]]:
    """The rulebook after columns were renamed, with messages for expressions that need a hand.

    ``df`` is the table before the renaming. Back-quoted columns in expressions are rewritten.
    """
    out, notes = [], []
    for rule in rules.rules:
        for old, new in names.items():
            if old == new:
                continue
            if isinstance(rule, ExpressionCheck):
                if not _uses(df, rule, old):
                    continue
                if quoted(old) in rule.query:
                    rule = replace(
                        rule,
                        query=rule.query.replace(quoted(old), quoted(new)),
                        desc=rule.desc.replace(quoted(old), quoted(new)),
                    )
                else:
                    notes.append(f"Warning: rule '{rule.desc}' uses '{old}', now '{new}'; edit its expression.")
            elif old in rule.columns():
                changed = {f: new for f in ("col", "col_a", "col_b") if getattr(rule, f, None) == old}
                rule = replace(rule, desc=rule.desc.replace(old, new), **changed)
        out.append(rule)
    return Rulebook(tuple(out)), notes


# Words that name a way to deal with a failing rule.
_FILL_WORDS = ("mean", "median", "mode", "knn", "iterative")


def resolution(rule: Rule, method: str) -> Step:
    """The step that deals with a failing rule.

    ``method``: drop, mean, median, mode, knn or iterative for null checks; drop, cap
    or log for range checks; everything else drops the violating rows. A longer label
    that contains the word ("Fill with Mean") is understood too.
    """
    words = method.lower().split()
    if isinstance(rule, NullCheck):
        if "drop" in words:
            return DropNulls(rule.col)
        named = [w for w in words if w in _FILL_WORDS]
        if not named:
            raise ValueError(f"no way to fill nulls is named '{method}'")
        return FillNull(rule.col, named[0])
    if isinstance(rule, RangeCheck) and "log" in words:
        return LogTransform(rule.col)
    if isinstance(rule, RangeCheck) and "cap" in words:
        return CapRange(rule.col, rule.min, rule.max)
    return DropViolated(rule)
