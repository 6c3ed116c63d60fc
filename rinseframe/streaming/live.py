"""Applying a recipe, and counting rule violations, on a stream.

Row-wise steps work on a stream as they are. Steps that need the whole table take their
statistics from a reference table (``fit_on``), where they stay frozen; steps that
regroup rows (duplicates, nearest neighbours) are refused.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rinseframe.model import DropEmptyColumns, FillNull, NormalizeText, Recipe, Rulebook, Step
from rinseframe.operators.rules import rule_counts
from rinseframe.plans.compile import Context, compile_recipe


class NotStreamable(ValueError):
    """A step that has no meaning on a stream."""


def _needs_table(step: Step) -> bool:
    """Whether a step's result depends on more than the row, whatever the table holds."""
    return (
        isinstance(step, DropEmptyColumns)
        or (isinstance(step, FillNull) and step.strategy != "constant")
        or (isinstance(step, NormalizeText) and step.value == "fuzzy_dedupe")
    )


def clean_stream(
    stream: DataFrame, recipe: Recipe | Iterable, fit_on: DataFrame | None = None
) -> tuple[DataFrame, list[str]]:
    """The cleaned stream and the messages of its steps. ``fit_on`` is a static table with the columns of the stream."""
    recipe = recipe if isinstance(recipe, Recipe) else Recipe.of(*recipe)
    static = fit_on if fit_on is not None else stream.sparkSession.createDataFrame([], stream.schema)
    if fit_on is None and (whole := [s.action for s in recipe.steps if _needs_table(s)]):
        raise NotStreamable(f"{', '.join(whole)}: a reference table is needed to take statistics from")
    effects, _ = compile_recipe(static, recipe, Context(eager=True))
    out = stream
    for step, effect in zip(recipe.steps, effects):
        if effect.rebuild is not None:
            raise NotStreamable(f"{step.action} regroups the table")
        if effect.whole_table and fit_on is None:
            raise NotStreamable(f"{step.action} needs a reference table to take its statistics from")
        out = effect.apply(out)
    return out, [message for effect in effects for message in effect.messages]


def count_violations(
    stream: DataFrame, rules: Rulebook | Iterable, into: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Append the violation counts of every micro-batch to the parquet folder ``into``.

    A batch that is replayed after a failure overwrites its own counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        rule_counts(batch, rules).write.mode("overwrite").parquet(f"{into}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
