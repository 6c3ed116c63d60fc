"""Steps that remove rows, and the duplicate-row report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rinseframe.frames import col, data_columns
from rinseframe.model import ROW_ID, DropDuplicates, DropEmptyRows, DropNulls, DropViolated, Note
from rinseframe.operators.rules import RuleError, valid
from rinseframe.plans.compile import Context, effect_of
from rinseframe.plans.effects import Effect, missing_column, nothing
from rinseframe.plans.skew import semi_join_counted


def all_missing(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [col(c).isNull() for c in names]) if names else F.lit(False)


@effect_of.register
def _(step: DropNulls, df: DataFrame, ctx: Context) -> Effect:
    if step.column not in df.columns:
        return missing_column(step)
    return Effect(keep=col(step.column).isNotNull())


@effect_of.register
def _(step: DropEmptyRows, df: DataFrame, ctx: Context) -> Effect:
    return Effect(keep=~all_missing(data_columns(df)))


@effect_of.register
def _(step: DropViolated, df: DataFrame, ctx: Context) -> Effect:
    if step.rule is None or isinstance(step.rule, Note):
        return nothing()
    try:
        return Effect(keep=valid(df, step.rule))
    except RuleError as exc:
        return nothing(f"Error: drop_violated was skipped: {exc}")


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row per distinct row, the one with the smallest row id.

    A grouped minimum is combined before the shuffle, so a row that is copied a
    billion times crosses it once per input partition.
    """
    names = data_columns(df)
    if ROW_ID not in df.columns:
        return df.dropDuplicates(names)
    return df.groupBy(*map(col, names)).agg(F.min(ROW_ID).alias(ROW_ID)).select(*map(col, df.columns))


@effect_of.register
def _(step: DropDuplicates, df: DataFrame, ctx: Context) -> Effect:
    return Effect(rebuild=drop_duplicates, whole_table=True)


def row_groups(df: DataFrame) -> DataFrame:
    return df.groupBy(*map(col, data_columns(df))).agg(F.count("*").alias("_rf_n"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one. Counting copies needs one shuffle of distinct rows."""
    return row_groups(df).agg(F.coalesce(F.sum(F.col("_rf_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every member of every group of equal rows, however many members a group has."""
    repeated = row_groups(df).filter(F.col("_rf_n") > 1)
    return semi_join_counted(df, repeated, data_columns(df), "_rf_n", df.count())
