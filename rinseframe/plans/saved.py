"""A recipe and a rulebook kept together as JSON, to be run on new data."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame

from rinseframe.frames import data_columns
from rinseframe.model import NormalizeColumnNames, Recipe, RenameColumn, Rulebook
from rinseframe.operators.columns import normalized_names
from rinseframe.operators.rules import rename_in_rules, validate
from rinseframe.plans.compile import Context, apply_recipe, compile_step


@dataclass(frozen=True)
class CleaningPlan:
    recipe: Recipe = Recipe()
    rulebook: Rulebook = Rulebook()

    def to_json(self) -> str:
        return json.dumps({"recipe": json.loads(self.recipe.to_json()), "rules": json.loads(self.rulebook.to_json())})

    @staticmethod
    def from_json(text: str) -> "CleaningPlan":
        data = json.loads(text)
        return CleaningPlan(Recipe.of(*data.get("recipe", [])), Rulebook.of(*data.get("rules", [])))

    def run(self, df: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
        """The cleaned table, the rules it still breaks, and the messages of the steps."""
        cleaned, messages = apply_recipe(df, self.recipe, Context(rules=self.rulebook.rules))
        return cleaned, validate(cleaned, self.rulebook), messages


def follow_renames(df: DataFrame, recipe: Recipe, rulebook: Rulebook) -> tuple[Rulebook, list[str]]:
    """The rulebook as it reads after the recipe: rules written for ``df`` follow its column renames."""
    notes: list[str] = []
    state, ctx = df, Context()
    for step in recipe.steps:
        effect, after = compile_step(step, state, ctx)
        if isinstance(step, RenameColumn) and effect.project is not None:
            rulebook, more = rename_in_rules(state, rulebook, {step.column: step.value})
            notes += more
        elif isinstance(step, NormalizeColumnNames) and effect.project is not None:
            rulebook, more = rename_in_rules(state, rulebook, normalized_names(data_columns(state), step.value))
            notes += more
        state = after
    return rulebook, notes
