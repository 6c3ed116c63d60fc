"""Small schema helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rinseframe.model import ALL_TEXT, HIDDEN_PREFIX, ROW_ID


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col(quoted(name))


def is_hidden(name: str) -> bool:
    return name == ROW_ID or name.startswith(HIDDEN_PREFIX)


def data_columns(df: DataFrame) -> list[str]:
    """The user's columns: everything but the row id and internal flags."""
    return [c for c in df.columns if not is_hidden(c)]


def hidden_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_hidden(c)]


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.VarcharType, T.CharType))


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if is_numeric(dtype(df, c))]


def text_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if is_text(dtype(df, c))]


def targets(df: DataFrame, column) -> list[str] | None:
    """Columns a text step works on; None when the named column is absent."""
    if column is ALL_TEXT:
        return text_columns(df)
    return [column] if column in df.columns else None


def assign(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """Replace or append columns with one projection, keeping the order of the others."""
    return df.withColumns(changed) if changed else df


def same_name(df: DataFrame, a: str, b: str) -> bool:
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive", "false").lower() == "true"
    return a == b if sensitive else a.lower() == b.lower()


def groups_of(items: Iterable, size: int) -> list[list]:
    items = list(items)
    return [items[i : i + size] for i in range(0, len(items), size)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN becomes NULL (Spark ranks NaN above every number)."""
    floats = [c for c in data_columns(df) if isinstance(dtype(df, c), (T.DoubleType, T.FloatType))]
    return assign(df, {c: F.when(~F.isnan(col(c)), col(c)) for c in floats})
