"""What a step does to a table, described so that it can be applied to any frame with the same columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rinseframe.frames import assign

ALIVE = "_rf_alive"


@dataclass(frozen=True)
class Effect:
    """One of

    * ``project``: a row-wise change (columns only), no shuffle;
    * ``keep``: a row filter; rows where it is false or NULL go;
    * ``rebuild``: anything that regroups rows or joins;

    or nothing at all, with a message. ``whole_table`` says that the effect was
    derived from, or needs, the whole table, which a stream does not have.
    """

    project: Callable[[DataFrame], DataFrame] | None = None
    keep: Column | None = None
    rebuild: Callable[[DataFrame], DataFrame] | None = None
    messages: tuple[str, ...] = ()
    whole_table: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        if self.project is not None:
            return self.project(df)
        if self.keep is not None:
            return df.filter(self.keep)
        if self.rebuild is not None:
            return self.rebuild(df)
        return df

    def flag(self, df: DataFrame) -> DataFrame:
        """Like ``apply`` for project and keep, but dropped rows stay with ``_rf_alive`` = false."""
        if self.project is not None:
            return self.project(df)
        if self.keep is not None:
            return df.withColumn(ALIVE, F.col(ALIVE) & F.coalesce(self.keep, F.lit(False)))
        return df


def nothing(*messages: str) -> Effect:
    return Effect(messages=messages)


def values(changed: dict[str, Column], *messages: str, whole_table: bool = False) -> Effect:
    if not changed:
        return nothing(*messages)
    return Effect(project=lambda df: assign(df, changed), messages=messages, whole_table=whole_table)


def missing_column(step) -> Effect:
    return nothing(f"Warning: {step.action} was skipped, column '{step.column}' was not found.")
