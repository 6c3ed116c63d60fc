"""Parsing of text into numbers and timestamps; what cannot be read becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rinseframe.frames import col, dtype, is_numeric, is_text, is_time

# Text that counts as a number. Spark alone would also take type suffixes such as ``1.0d``.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def number_from_text(c: Column) -> Column:
    return F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))


def as_number(df: DataFrame, name: str) -> Column:
    """A column as DOUBLE, whatever its type; unreadable text and NaN are NULL."""
    t = dtype(df, name)
    if is_text(t):
        return number_from_text(col(name))
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col(name)), col(name).cast("double"))
    if is_numeric(t) or isinstance(t, T.BooleanType):
        return col(name).cast("double")
    raise TypeError(f"column '{name}' of type {t.simpleString()} has no numeric reading")


def as_timestamp(df: DataFrame, name: str, fmt: str | None = None) -> Column:
    """A column as a timestamp without time zone."""
    t = dtype(df, name)
    if isinstance(t, T.TimestampNTZType):
        return col(name)
    if is_time(t):
        return col(name).cast("timestamp_ntz")
    if not is_text(t):
        raise TypeError(f"column '{name}' of type {t.simpleString()} has no timestamp reading")
    if fmt is None:
        return col(name).try_cast("timestamp_ntz")
    return F.try_to_timestamp(col(name), F.lit(fmt)).cast("timestamp_ntz")


# Type names used in recipes, and the Spark types they mean.
OTHER_NUMBER_TYPES = {
    "float32": "float",
    "float": "double",
    "float64": "double",
    "int8": "tinyint",
    "int16": "smallint",
    "bool": "boolean",
}
INTEGER_TYPES = ("int", "int32", "int64")
TEXT_TYPES = ("string", "object")
TIME_TYPE = "datetime64[ns]"
