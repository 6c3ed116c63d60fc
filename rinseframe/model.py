"""Recipe steps and rulebook rules as immutable values with a JSON form.

A step says *what* to do to a table; ``rinseframe.plans.compile`` turns it into
DataFrame transformations. A rule says what a valid row looks like;
``rinseframe.operators.rules`` turns it into a boolean violation column.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from typing import Any, ClassVar

ROW_ID = "_row_id"
HIDDEN_PREFIX = "_rf_"


class _AllText:
    """Stands for "every text column" where a step takes a column."""

    def __repr__(self) -> str:
        return "ALL_TEXT"

    def __reduce__(self):
        return "ALL_TEXT"


ALL_TEXT = _AllText()

# Fixed values of the JSON format: saved recipes and rulebooks use these words.
ALL_TEXT_WORD = "All"
FILL_STRATEGIES = ("mean", "median", "mode", "knn", "iterative")
COMPARISONS = (">", "<", "==", "!=", ">=", "<=")
DATE_PARTS = ("year", "month", "day", "day_of_week", "hour")


# --------------------------------------------------------------------- rules


@dataclass(frozen=True, kw_only=True)
class Rule:
    desc: str = ""
    enabled: bool = True
    resolved: bool = False
    type: ClassVar[str] = ""

    def columns(self) -> tuple[str, ...]:
        """Columns the rule names outright (expressions are handled by analysis)."""
        return ()

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"type": self.type}
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name == "resolved" and not value:
                continue
            if value is None and f.name in ("col_b", "value"):
                continue
            out[f.name] = value
        return out


@dataclass(frozen=True, kw_only=True)
class NullCheck(Rule):
    col: str
    type: ClassVar[str] = "Null Check"

    def columns(self):
        return (self.col,)


@dataclass(frozen=True, kw_only=True)
class RangeCheck(Rule):
    col: str
    min: float
    max: float
    type: ClassVar[str] = "Range Check"

    def columns(self):
        return (self.col,)


@dataclass(frozen=True, kw_only=True)
class RelationalCheck(Rule):
    """``col_a op col_b`` when ``col_b`` is given, else ``col_a op value``."""

    col_a: str
    op: str
    col_b: str | None = None
    value: Any = None
    type: ClassVar[str] = "Relational Check"

    def columns(self):
        return (self.col_a,) if self.col_b is None else (self.col_a, self.col_b)

    def to_dict(self):
        out = super().to_dict()
        out["target_type"] = "Value" if self.col_b is None else "Feature"
        return out


@dataclass(frozen=True, kw_only=True)
class ExpressionCheck(Rule):
    """A Spark SQL predicate that valid rows satisfy."""

    query: str
    type: ClassVar[str] = "Custom Expression"


@dataclass(frozen=True, kw_only=True)
class Note(Rule):
    """Information only; it never has violations."""

    type: ClassVar[str] = "Informational"


@dataclass(frozen=True, kw_only=True)
class BrokenRule(Rule):
    """A stored rule that lacks a field or has an unknown type; kept so that it can be reported."""

    kind: str
    raw: str
    problem: str | None = None

    def to_dict(self):
        return json.loads(self.raw)


RULE_TYPES = {t.type: t for t in (NullCheck, RangeCheck, RelationalCheck, ExpressionCheck, Note)}


def rule_from_dict(data: dict[str, Any]) -> Rule:
    kind = data.get("type")
    shared = {k: data[k] for k in ("desc", "enabled", "resolved") if k in data}
    cls = RULE_TYPES.get(kind)
    if cls is None:
        return BrokenRule(kind=str(kind), raw=json.dumps(data), **shared)
    args = {f.name: data[f.name] for f in fields(cls) if f.name in data}
    if cls is RelationalCheck:
        by_column = data.get("target_type", "Feature" if "col_b" in data else "Value") == "Feature"
        args.pop("value" if by_column else "col_b", None)
        if by_column and args.get("col_b") is None:
            return BrokenRule(kind=kind, raw=json.dumps(data), problem="missing field 'col_b'", **shared)
        if not by_column and "value" not in args:
            return BrokenRule(kind=kind, raw=json.dumps(data), problem="missing field 'value'", **shared)
    required = {
        NullCheck: ("col",),
        RangeCheck: ("col", "min", "max"),
        RelationalCheck: ("col_a", "op"),
        ExpressionCheck: ("query",),
        Note: (),
    }[cls]
    missing = [name for name in required if args.get(name) is None]
    if missing:
        return BrokenRule(
            kind=kind, raw=json.dumps(data), problem=f"missing field {', '.join(map(repr, missing))}", **shared
        )
    return cls(**args)


# --------------------------------------------------------------------- steps


@dataclass(frozen=True)
class Step:
    action: ClassVar[str] = ""

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"action": self.action}
        for f in fields(self):
            value = getattr(self, f.name)
            if value is ALL_TEXT:
                value = ALL_TEXT_WORD
            elif isinstance(value, Rule):
                value = value.to_dict()
            elif isinstance(value, tuple):
                value = list(value)
            out[f.name] = value
        return out

    @property
    def target(self) -> str:
        """Short text for the audit trail: the column, or ``dataset``."""
        column = getattr(self, "column", None)
        if column is ALL_TEXT:
            return ALL_TEXT_WORD
        return "dataset" if column is None else column


@dataclass(frozen=True)
class DropColumn(Step):
    column: str
    action: ClassVar[str] = "drop_column"


@dataclass(frozen=True)
class RenameColumn(Step):
    column: str
    value: str
    action: ClassVar[str] = "rename_column"


@dataclass(frozen=True)
class ReorderColumns(Step):
    value: tuple[str, ...]
    action: ClassVar[str] = "reorder_columns"


@dataclass(frozen=True)
class NormalizeColumnNames(Step):
    value: str = "snake_case"
    action: ClassVar[str] = "normalize_column_names"


@dataclass(frozen=True)
class DropEmptyColumns(Step):
    action: ClassVar[str] = "drop_empty_columns"


@dataclass(frozen=True)
class DropNulls(Step):
    column: str
    action: ClassVar[str] = "drop_nulls"


@dataclass(frozen=True)
class DropEmptyRows(Step):
    action: ClassVar[str] = "drop_empty_rows"


@dataclass(frozen=True)
class DropDuplicates(Step):
    action: ClassVar[str] = "drop_duplicates"


@dataclass(frozen=True)
class DropViolated(Step):
    rule: Rule | None
    action: ClassVar[str] = "drop_violated"


@dataclass(frozen=True)
class CastType(Step):
    """``strict`` fails the step when a value is not integral (integer targets only)."""

    column: str
    dtype: str
    format: str | None = None
    strict: bool = True
    action: ClassVar[str] = "cast_type"

    def to_dict(self):
        out = super().to_dict()
        if self.format is None:
            out.pop("format")
        if self.strict:
            out.pop("strict")
        return out


@dataclass(frozen=True)
class Replace(Step):
    column: str | _AllText
    find: Any
    replace: Any
    regex: bool = False
    action: ClassVar[str] = "replace"


@dataclass(frozen=True)
class StripWhitespace(Step):
    column: str | _AllText
    action: ClassVar[str] = "strip_whitespace"


@dataclass(frozen=True)
class NormalizeText(Step):
    column: str | _AllText
    value: str = "lowercase"
    threshold: int = 85
    action: ClassVar[str] = "normalize_text"

    def to_dict(self):
        out = super().to_dict()
        for f in fields(self):
            if f.name == "threshold" and out[f.name] == f.default:
                out.pop(f.name)
        return out


@dataclass(frozen=True)
class CapRange(Step):
    column: str
    min: float
    max: float
    action: ClassVar[str] = "cap_range"


@dataclass(frozen=True)
class LogTransform(Step):
    column: str
    action: ClassVar[str] = "log_transform"


@dataclass(frozen=True)
class ExtractDatetime(Step):
    column: str
    component: str
    new_column: str
    action: ClassVar[str] = "extract_datetime"


@dataclass(frozen=True)
class FillNull(Step):
    """``strategy`` is one of FILL_STRATEGIES or ``constant`` (then ``value`` is used).

    ``predictors`` names the columns that knn and iterative go by; without it they take all other numeric ones. Only where
    the gaps of these form too many patterns to tell apart they take the ten that correlate best, and a message says so.
    """

    column: str
    strategy: str
    value: Any = None
    predictors: tuple[str, ...] | None = None
    action: ClassVar[str] = "fill_null"

    def to_dict(self):
        out = {"action": self.action, "column": self.column, "value": self.strategy}
        if self.strategy == "constant":
            out["value"] = self.value
            if self.value in FILL_STRATEGIES:
                out["strategy"] = "constant"
        if self.predictors is not None:
            out["predictors"] = list(self.predictors)
        return out


@dataclass(frozen=True)
class BadStep(Step):
    """A stored step that cannot be read; applying it only yields its message."""

    raw: str
    message: str

    def to_dict(self):
        return json.loads(self.raw)

    @property
    def target(self) -> str:
        return json.loads(self.raw).get("column", "dataset")


STEP_TYPES = {
    t.action: t
    for t in (
        DropColumn, RenameColumn, ReorderColumns, NormalizeColumnNames, DropEmptyColumns, DropNulls,
        DropEmptyRows, DropDuplicates, DropViolated, CastType, Replace, StripWhitespace, NormalizeText,
        CapRange, LogTransform, ExtractDatetime, FillNull,
    )
}


def step_from_dict(data: dict[str, Any]) -> Step:
    action = data.get("action")
    cls = STEP_TYPES.get(action)
    if cls is None:
        return BadStep(json.dumps(data), f"Warning: Unknown action '{action}' was skipped.")
    args = {f.name: data[f.name] for f in fields(cls) if f.name in data}
    if "rule" in args and isinstance(args["rule"], dict):
        args["rule"] = rule_from_dict(args["rule"])
    if cls is DropViolated:
        args.setdefault("rule", None)
    if cls in (Replace, StripWhitespace, NormalizeText) and args.get("column") == ALL_TEXT_WORD:
        args["column"] = ALL_TEXT
    if cls is FillNull:
        value = data.get("value")
        named = data.get("strategy") or (value if value in FILL_STRATEGIES else "constant")
        args = {"column": data.get("column"), "strategy": named}
        if named == "constant":
            args["value"] = value
        if data.get("predictors") is not None:
            args["predictors"] = tuple(data["predictors"])
    if cls is ReorderColumns:
        if not isinstance(args.get("value"), (list, tuple)):
            return BadStep(json.dumps(data), "Error: reorder_columns requires a list of column names.")
        args["value"] = tuple(args["value"])
    if cls is ExtractDatetime:
        args.setdefault("new_column", "")
        args.setdefault("component", "")
    try:
        return cls(**args)
    except TypeError as exc:
        return BadStep(json.dumps(data), f"Error: {action} is incomplete: {exc}")


# ------------------------------------------------------------ recipe, rulebook


@dataclass(frozen=True)
class Recipe:
    steps: tuple[Step, ...] = ()

    @staticmethod
    def of(*steps: Step | dict[str, Any]) -> "Recipe":
        return Recipe(tuple(step_from_dict(s) if isinstance(s, dict) else s for s in steps))

    def then(self, step: Step | dict[str, Any]) -> "Recipe":
        return Recipe(self.steps + Recipe.of(step).steps)

    def prefix(self, n: int) -> "Recipe":
        return Recipe(self.steps[: max(n, 0)])

    def undo(self) -> "Recipe":
        return Recipe(self.steps[:-1])

    def without(self, index: int) -> "Recipe":
        """The recipe with one step (0-based) taken out; later steps replay from the source."""
        return Recipe(self.steps[:index] + self.steps[index + 1 :])

    def to_json(self) -> str:
        return json.dumps([s.to_dict() for s in self.steps])

    @staticmethod
    def from_json(text: str) -> "Recipe":
        return Recipe.of(*json.loads(text))

    def __len__(self) -> int:
        return len(self.steps)


@dataclass(frozen=True)
class Rulebook:
    rules: tuple[Rule, ...] = ()

    @staticmethod
    def of(*rules: Rule | dict[str, Any]) -> "Rulebook":
        return Rulebook(tuple(rule_from_dict(r) if isinstance(r, dict) else r for r in rules))

    def add(self, rule: Rule | dict[str, Any], at_end: bool = False) -> "Rulebook":
        new = Rulebook.of(rule).rules
        return Rulebook(self.rules + new if at_end else new + self.rules)

    def remove(self, index: int) -> "Rulebook":
        return Rulebook(self.rules[:index] + self.rules[index + 1 :])

    def _edit(self, index: int, **changes) -> "Rulebook":
        edited = replace(self.rules[index], **changes)
        return Rulebook(self.rules[:index] + (edited,) + self.rules[index + 1 :])

    def set_enabled(self, index: int, enabled: bool) -> "Rulebook":
        return self._edit(index, enabled=enabled)

    def mark_resolved(self, index: int) -> "Rulebook":
        return self._edit(index, resolved=True)

    @property
    def active(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.enabled)

    def to_json(self) -> str:
        return json.dumps([r.to_dict() for r in self.rules])

    @staticmethod
    def from_json(text: str) -> "Rulebook":
        return Rulebook.of(*json.loads(text))

    def __len__(self) -> int:
        return len(self.rules)


@dataclass(frozen=True)
class Proposal:
    """One scout finding with the step or rule that would deal with it."""

    position: int
    column: str
    type: str
    reason: str
    measure: float
    remedy: Step | Rule = field(repr=False)

    def to_row(self) -> tuple:
        return (
            self.position, self.column, self.type, self.reason, float(self.measure), json.dumps(self.remedy.to_dict()),
        )
