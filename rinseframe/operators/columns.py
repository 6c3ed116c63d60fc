"""Steps on column names, order and presence."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from rinseframe.frames import col, data_columns, hidden_columns, same_name
from rinseframe.model import DropColumn, DropEmptyColumns, NormalizeColumnNames, RenameColumn, ReorderColumns
from rinseframe.operators.stats import run_aggregates
from rinseframe.plans.compile import Context, effect_of
from rinseframe.plans.effects import Effect, missing_column, nothing


def _snake(name: str) -> str:
    joined = re.sub(r"[ -]", "_", name.strip())
    return re.sub(r"_{2,}", "_", re.sub(r"[^A-Za-z0-9_]", "", joined)).lower()


NAME_STYLES = {
    "snake_case": _snake,
    "lowercase": str.lower,
    "uppercase": str.upper,
    "remove_spaces": lambda name: name.replace(" ", ""),
}


def normalized_names(names: list[str], style: str) -> dict[str, str]:
    """Old name -> new name for every column; a name that would vanish becomes ``column_<old>``."""
    convert = NAME_STYLES.get(style, lambda name: name)
    return {name: convert(name) or f"column_{name}" for name in names}


def needs_normalizing(name: str) -> bool:
    return any(not (ch.isalnum() or ch == "_") for ch in name)


def _renaming(names: dict[str, str]):
    return lambda df: df.select(*[col(c).alias(names.get(c, c)) for c in df.columns])


@effect_of.register
def _(step: DropColumn, df: DataFrame, ctx: Context) -> Effect:
    if step.column not in df.columns:
        return missing_column(step)
    used = ctx.rules_using(df, step.column)
    notes = (f"Warning: dropped column '{step.column}' is used by {', '.join(used)}.",) if used else ()
    return Effect(project=lambda f: f.drop(col(step.column)), messages=notes)


@effect_of.register
def _(step: RenameColumn, df: DataFrame, ctx: Context) -> Effect:
    if step.column not in df.columns:
        return missing_column(step)
    if not step.value or not step.value.strip():
        return nothing("Error: rename_column requires a new name that is not empty.")
    taken = [c for c in df.columns if c != step.column and same_name(df, c, step.value)]
    if taken:
        return nothing(f"Error: column '{step.column}' was not renamed, '{taken[0]}' already exists.")
    return Effect(project=_renaming({step.column: step.value}))


@effect_of.register
def _(step: ReorderColumns, df: DataFrame, ctx: Context) -> Effect:
    known = [c for c in dict.fromkeys(step.value) if c in data_columns(df)]
    order = known + [c for c in data_columns(df) if c not in known]
    return Effect(project=lambda f: f.select(*map(col, order), *map(col, hidden_columns(f))))


@effect_of.register
def _(step: NormalizeColumnNames, df: DataFrame, ctx: Context) -> Effect:
    names = normalized_names(data_columns(df), step.value)
    seen: dict[str, str] = {}
    for old, new in names.items():
        clash = next((o for o, n in seen.items() if same_name(df, n, new)), None)
        if clash is not None:
            return nothing(f"Error: '{clash}' and '{old}' would both be named '{new}'; no column was renamed.")
        seen[old] = new
    if step.value not in NAME_STYLES:
        return nothing(f"Warning: unknown naming style '{step.value}', no column was renamed.")
    return Effect(project=_renaming(names))


@effect_of.register
def _(step: DropEmptyColumns, df: DataFrame, ctx: Context) -> Effect:
    names = data_columns(df)
    counts = run_aggregates(df, {f"c{i}": F.count(col(c)) for i, c in enumerate(names)})
    empty = [c for i, c in enumerate(names) if counts[f"c{i}"] == 0]
    if not empty:
        return Effect(messages=("Every column has values, none was removed.",), whole_table=True)
    return Effect(
        project=lambda f: f.drop(*map(col, empty)),
        messages=(f"Columns without any value were removed: {', '.join(empty)}.",),
        whole_table=True,
    )
