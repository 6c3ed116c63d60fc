"""Filling missing values: statistics, constants, and the choice of predictors."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rinseframe.frames import col, dtype, is_numeric, is_text, numeric_columns
from rinseframe.model import FillNull
from rinseframe.operators.stats import correlation_of, quantiles, run_aggregates
from rinseframe.plans.compile import Context, effect_of
from rinseframe.plans.effects import Effect, missing_column, nothing, values

# The best ones, where gaps come in too many patterns for all.
PREDICTORS = 10


def _statistic(frame: DataFrame, ctx: Context) -> Column:
    """The single value of a one-row frame: a scalar subquery, or a literal when compiling eagerly.

    Catalyst merges scalar subqueries over the same input, so several fills share a scan.
    """
    if ctx.eager:
        return F.lit(frame.first()[0])
    return frame.scalar()


def most_frequent(df: DataFrame, name: str) -> DataFrame:
    """One row with the most frequent value, the smallest on ties; NULL when all are missing."""
    counted = df.filter(col(name).isNotNull()).groupBy(col(name).alias("v")).agg(F.count("*").alias("n"))
    return counted.agg(F.min_by("v", F.struct((-F.col("n")).alias("a"), F.col("v").alias("b"))).alias("v"))


def _constant(df: DataFrame, step: FillNull) -> Effect:
    if step.value is None:
        return nothing(f"Warning: no fill value for column '{step.column}', nothing was changed.")
    c, t, v = col(step.column), dtype(df, step.column), step.value
    if is_text(t):
        return values({step.column: F.coalesce(c, F.lit(str(v)))})
    if is_numeric(t) and isinstance(v, (int, float)) and not isinstance(v, bool):
        return values({step.column: F.coalesce(c, F.lit(v))})
    if isinstance(t, T.BooleanType) and isinstance(v, bool):
        return values({step.column: F.coalesce(c, F.lit(v))})
    # a value of another type: the column becomes text, so that it can hold both
    return values({step.column: F.coalesce(c.cast("string"), F.lit(str(v)))})


@effect_of.register
def _(step: FillNull, df: DataFrame, ctx: Context) -> Effect:
    if step.column not in df.columns:
        return missing_column(step)
    if step.strategy == "constant":
        return _constant(df, step)
    c, t = col(step.column), dtype(df, step.column)
    if step.strategy == "mode":
        if df.filter(c.isNotNull()).limit(1).count() == 0:
            return nothing(f"Warning: column '{step.column}' has no values to take a mode from.")
        return values({step.column: F.coalesce(c, _statistic(most_frequent(df, step.column), ctx))}, whole_table=True)
    if not is_numeric(t):
        return nothing(
            f"Error: filling with {step.strategy} requires a numeric column, '{step.column}' is {t.simpleString()}."
        )
    if step.strategy == "mean":
        mean = df.agg(F.avg(c.cast("double")).alias("v"))
        return values({step.column: F.coalesce(c, _statistic(mean, ctx))}, whole_table=True)
    if step.strategy == "median":
        found = quantiles(df, [step.column], [0.5], approx=ctx.approximate)[step.column][0]
        return values({step.column: F.coalesce(c, F.lit(found).cast("double"))}, whole_table=True)
    if step.strategy == "knn":
        from rinseframe.operators.knn import knn_effect

        names, notes = predictors_for(df, step)
        effect = knn_effect(df, step.column, names)
        return replace(effect, messages=(*notes, *effect.messages))
    if step.strategy == "iterative":
        from rinseframe.operators.chained import chained_effect

        names, notes = predictors_for(df, step)
        effect = chained_effect(df, step.column, names)
        return replace(effect, messages=(*notes, *effect.messages))
    return nothing(f"Error: fill strategy '{step.strategy}' is unknown.")


# ------------------------------------------------------------------ predictors


def top_predictors(df: DataFrame, target: str, k: int = PREDICTORS) -> list[tuple[str, float]]:
    """The k numeric columns with the highest absolute correlation to ``target``, in one pass.

    An undefined correlation counts as 0; ties keep the column order.
    """
    others = [c for c in numeric_columns(df) if c != target]
    y = col(target).cast("double")
    found = run_aggregates(df, {f"r{i}": correlation_of(col(c).cast("double"), y) for i, c in enumerate(others)})
    scored = [(c, abs(found[f"r{i}"] or 0.0)) for i, c in enumerate(others)]
    return sorted(scored, key=lambda item: -item[1])[:k]


def _patterns_fit(df: DataFrame, step: FillNull, others: list[str]) -> bool:
    """Whether the imputer can tell apart the patterns that the gaps of all columns form."""
    from rinseframe.operators.chained import MOST_PATTERNS, gap_pattern
    from rinseframe.operators.knn import MOST_ASKED, MOST_PAIRS

    missing = col(step.column).isNull()
    pattern = gap_pattern(others)
    found = df.agg(
        F.count_distinct(F.when(missing, pattern)).alias("asked"), F.count_distinct(F.when(~missing, pattern)).alias("held"),
        F.count_distinct(F.concat(pattern, missing.cast("string"))).alias("all"),
    ).first()
    if step.strategy == "iterative":
        return found["all"] <= MOST_PATTERNS
    return found["asked"] <= MOST_ASKED and found["asked"] * found["held"] <= MOST_PAIRS


def predictors_for(df: DataFrame, step: FillNull) -> tuple[list[str], tuple[str, ...]]:
    """Columns an imputer uses besides the target: the named ones, else all other numeric ones.

    The ten that correlate best take the place of all where the gaps form too many patterns; a message says so.
    """
    others = [c for c in numeric_columns(df) if c != step.column]
    if step.predictors is not None:
        if unfit := [c for c in step.predictors if c not in others]:
            raise ValueError(f"no numeric predictors: {', '.join(unfit)}")
        others = list(step.predictors)
    if len(others) <= PREDICTORS or _patterns_fit(df, step, others):
        return others, ()
    if step.predictors is not None:
        raise ValueError(f"the gaps of the {len(others)} predictors of '{step.column}' form too many patterns")
    chosen = [c for c, _ in top_predictors(df, step.column)]
    return chosen, (f"'{step.column}' is filled by the {PREDICTORS} best of {len(others)} columns: {', '.join(chosen)}.",)
