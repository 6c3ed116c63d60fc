"""Row-wise steps on cell values. All of them are expressions; none needs a shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rinseframe.frames import col, dtype, is_numeric, is_text, is_time, targets
from rinseframe.functions import casts, text
from rinseframe.model import (
    CapRange, CastType, ExtractDatetime, LogTransform, NormalizeText, Replace, StripWhitespace,
)
from rinseframe.operators.fuzzy import fuzzy_effect
from rinseframe.plans.compile import Context, effect_of
from rinseframe.plans.effects import Effect, missing_column, nothing, values


# ------------------------------------------------------------------ casts


def _whole(x: Column) -> Column:
    return x.isNull() | ((x == F.floor(x)) & (F.abs(x) < F.lit(2.0**63)))


def _cast_integer(step: CastType, df: DataFrame) -> Effect:
    """To bigint. Unreadable text becomes NULL; a fraction or infinity fails the whole step if strict."""
    source = dtype(df, step.column)
    if isinstance(source, T.IntegralType):
        return values({step.column: col(step.column).cast("bigint")})
    x = casts.as_number(df, step.column)
    if step.strict and df.filter(~_whole(x)).limit(1).count():
        return nothing(f"Error: '{step.column}' was not cast to {step.dtype}, it holds values that are not whole.")
    # whole text is read as an integer first: a double cannot hold every bigint
    exact = col(step.column).try_cast("bigint") if is_text(source) else F.lit(None).cast("bigint")
    result = F.when(x.isNotNull() & _whole(x), F.coalesce(exact, x.try_cast("bigint")))
    return values({step.column: result}, whole_table=step.strict)


@effect_of.register
def _(step: CastType, df: DataFrame, ctx: Context) -> Effect:
    if step.column not in df.columns:
        return missing_column(step)
    if step.dtype == casts.TIME_TYPE:
        return values({step.column: casts.as_timestamp(df, step.column, step.format)})
    if step.dtype in casts.TEXT_TYPES:
        return values({} if step.dtype == "object" else {step.column: col(step.column).cast("string")})
    if step.dtype in casts.INTEGER_TYPES:
        return _cast_integer(step, df)
    if step.dtype in casts.OTHER_NUMBER_TYPES:
        x = casts.as_number(df, step.column)
        name = casts.OTHER_NUMBER_TYPES[step.dtype]
        return values({step.column: x if name == "double" else x.cast(name) if name == "boolean" else x.try_cast(name)})
    return nothing(f"Error: '{step.column}' was not cast, type '{step.dtype}' is unknown.")


# ------------------------------------------------------------------ text


def _replaced(df: DataFrame, name: str, step: Replace) -> Column | None:
    t = dtype(df, name)
    if is_text(t) and isinstance(step.find, str):
        if step.regex:
            return F.regexp_replace(col(name), text.java_pattern(step.find), text.java_replacement(step.replace))
        new = F.lit(None if step.replace is None else str(step.replace)).cast("string")
        return F.when(col(name) == F.lit(step.find), new).otherwise(col(name))
    numbers = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in (step.find, step.replace))
    if is_numeric(t) and numbers and not step.regex:
        new = F.lit(step.replace).cast(t)
        return F.when(col(name) == F.lit(step.find), new).otherwise(col(name))
    return None  # text never equals a number: nothing matches


def _pattern_problem(df: DataFrame, step: Replace) -> str | None:
    """Why a pattern or its replacement cannot be used; found now rather than on the executors."""
    if not isinstance(step.find, str) or not isinstance(step.replace, str):
        return "a pattern and its replacement must be text"
    try:
        re.compile(step.find).sub(step.replace, "")
    except re.error as exc:
        return str(exc)
    # Java may know less than Python; one row on the driver tells
    pattern, new = text.java_pattern(step.find), text.java_replacement(step.replace)
    df.sparkSession.range(1).select(F.regexp_replace(F.lit(""), pattern, new)).first()
    return None


@effect_of.register
def _(step: Replace, df: DataFrame, ctx: Context) -> Effect:
    names = targets(df, step.column)
    if names is None:
        return missing_column(step)
    problem = _pattern_problem(df, step) if step.regex else None
    if problem:
        return nothing(f"Error: replace was skipped: {problem}.")
    new = {c: _replaced(df, c, step) for c in names}
    return values({c: e for c, e in new.items() if e is not None})


@effect_of.register
def _(step: StripWhitespace, df: DataFrame, ctx: Context) -> Effect:
    names = targets(df, step.column)
    if names is None:
        return missing_column(step)
    return values({c: text.strip(col(c)) for c in names if is_text(dtype(df, c))})


@effect_of.register
def _(step: NormalizeText, df: DataFrame, ctx: Context) -> Effect:
    names = targets(df, step.column)
    if names is None:
        return missing_column(step)
    names = [c for c in names if is_text(dtype(df, c))]
    if step.value == "fuzzy_dedupe":
        return fuzzy_effect(df, names, step)
    method = text.SIMPLE_METHODS.get(step.value)
    if method is None:
        return nothing(f"Warning: unknown text method '{step.value}', nothing was changed.")
    return values({c: method(col(c)) for c in names})


# ------------------------------------------------------------------ numbers


@effect_of.register
def _(step: CapRange, df: DataFrame, ctx: Context) -> Effect:
    if step.column not in df.columns:
        return missing_column(step)
    if not is_numeric(dtype(df, step.column)):
        return nothing(f"Error: cap_range requires a numeric column, '{step.column}' is not.")
    c = col(step.column)
    return values({step.column: F.when(c < step.min, F.lit(step.min)).when(c > step.max, F.lit(step.max)).otherwise(c)})


@effect_of.register
def _(step: LogTransform, df: DataFrame, ctx: Context) -> Effect:
    if step.column not in df.columns:
        return missing_column(step)
    if not is_numeric(dtype(df, step.column)):
        return nothing(f"Error: log_transform requires a numeric column, '{step.column}' is not.")
    c = col(step.column)
    return values({step.column: F.log1p(F.when(c < 0, F.lit(0.0)).otherwise(c.cast("double")))})


# ------------------------------------------------------------------ dates

_PARTS = {
    "year": lambda t: F.year(t).cast("bigint"),
    "month": lambda t: F.month(t).cast("bigint"),
    "day": lambda t: F.dayofmonth(t).cast("bigint"),
    "day_of_week": lambda t: F.date_format(t, "EEEE"),
    "hour": lambda t: F.hour(t).cast("bigint"),
}


@effect_of.register
def _(step: ExtractDatetime, df: DataFrame, ctx: Context) -> Effect:
    if step.column not in df.columns:
        return missing_column(step)
    if not step.new_column or not step.new_column.strip():
        return nothing("Error: extract_datetime requires a name for the new column.")
    part = _PARTS.get(step.component)
    if part is None:
        return nothing(f"Error: '{step.component}' is not a part of a date.")
    if not (is_text(dtype(df, step.column)) or is_time(dtype(df, step.column))):
        return nothing(f"Error: '{step.column}' holds no dates.")
    return values({step.new_column: part(casts.as_timestamp(df, step.column))})
