"""Turning a recipe into DataFrame transformations."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import singledispatch

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from rinseframe.model import BadStep, Recipe, Rule, Step
from rinseframe.plans.effects import Effect, nothing


@dataclass
class Context:
    """Settings of one compilation. ``eager`` evaluates statistics now instead of as subqueries."""

    rules: tuple[Rule, ...] = ()
    eager: bool = False
    approximate: bool = False

    def rules_using(self, df: DataFrame, column: str) -> list[str]:
        from rinseframe.operators.rules import rules_using

        return rules_using(df, self.rules, column)


@singledispatch
def effect_of(step: Step, df: DataFrame, ctx: Context) -> Effect:
    """The effect of a step on a table with the schema (and statistics) of ``df``."""
    return nothing(f"Warning: Unknown action '{step.action}' was skipped.")


@effect_of.register
def _(step: BadStep, df: DataFrame, ctx: Context) -> Effect:
    return nothing(step.message)


def compile_step(step: Step, df: DataFrame, ctx: Context) -> tuple[Effect, DataFrame]:
    """The effect and the table after it. A step that cannot be applied leaves the table as it was."""
    try:
        effect = effect_of(step, df, ctx)
        after = effect.apply(df)
        after.schema  # analysis: names and types are checked here, no job runs
        return effect, after
    except (PySparkException, TypeError, ValueError, KeyError) as exc:
        text = str(exc).strip().splitlines()[0] if str(exc).strip() else type(exc).__name__
        return nothing(f"Error: {step.action} was skipped: {text}"), df


def compile_recipe(
    df: DataFrame, recipe: Recipe | Iterable, ctx: Context | None = None
) -> tuple[list[Effect], list[DataFrame]]:
    """Effects of all steps, and the table after each prefix (index 0 is the input)."""
    recipe = recipe if isinstance(recipe, Recipe) else Recipe.of(*recipe)
    ctx = ctx or Context()
    effects, states = [], [df]
    for step in recipe.steps:
        effect, after = compile_step(step, states[-1], ctx)
        effects.append(effect)
        states.append(after)
    return effects, states


def apply_recipe(df: DataFrame, recipe: Recipe | Iterable, ctx: Context | None = None) -> tuple[DataFrame, list[str]]:
    """The cleaned table (lazy) and the messages of all steps, in order."""
    effects, states = compile_recipe(df, recipe, ctx)
    return states[-1], [m for e in effects for m in e.messages]


def apply_prefix(df: DataFrame, recipe: Recipe | Iterable, n: int, ctx: Context | None = None) -> DataFrame:
    """The table after the first n steps; undo is the prefix one shorter."""
    recipe = recipe if isinstance(recipe, Recipe) else Recipe.of(*recipe)
    return apply_recipe(df, recipe.prefix(n), ctx)[0]
