"""Automatic findings: what looks wrong with a table, and what would fix it.

All detectors share their scans: one pass of plain aggregates over all columns, one or
more (bounded memory) for quartiles, one for outlier counts, and one shuffle of distinct
texts - whatever the number of columns (very wide tables split a pass into groups).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rinseframe.frames import col, data_columns, dtype, is_numeric, is_text, text_columns
from rinseframe.functions.casts import number_from_text
from rinseframe.functions.text import is_padded
from rinseframe.model import (
    CastType, DropColumn, Note, NullCheck, Proposal, RangeCheck, Recipe, Rule, Rulebook, StripWhitespace,
)
from rinseframe.operators.columns import needs_normalizing
from rinseframe.operators.rows import all_missing, duplicate_count
from rinseframe.operators.stats import adjusted_skewness, quantiles, run_aggregates, value_counts

PROPOSAL_SCHEMA = "position int, column string, type string, reason string, measure double, remedy string"


@dataclass(frozen=True)
class Thresholds:
    """When a finding is reported."""

    null_drop_percent: float = 90.0
    outlier_iqr_scale: float = 1.5
    high_skewness: float = 2.0
    mixed_share_min: float = 0.60
    mixed_share_below: float = 0.99
    high_cardinality_percent: float = 80.0


DEFAULTS = Thresholds()


def _plain_facts(df: DataFrame, names: list[str]) -> dict[str, Column]:
    facts: dict[str, Column] = {"rows": F.count("*")}
    for i, c in enumerate(names):
        x, t = col(c), dtype(df, c)
        facts[f"n{i}"] = F.count(x)
        if not is_text(t):
            # one value at most: the smallest is the largest (both NULL when all are missing)
            facts[f"same{i}"] = F.min(x).eqNullSafe(F.max(x))
        if is_numeric(t):
            facts[f"skew{i}"] = adjusted_skewness(x.cast("double"))
    return facts


@dataclass(frozen=True)
class TextFacts:
    unique: int = 0
    numbers: int = 0
    padded: bool = False


def _text_facts(df: DataFrame, names: list[str], approx: bool) -> dict[str, TextFacts]:
    """What the text detectors need. The patterns are matched once per distinct value, not per row."""
    if not names:
        return {}
    if approx:
        facts: dict[str, Column] = {}
        for i, c in enumerate(names):
            x = col(c)
            facts[f"u{i}"] = F.approx_count_distinct(x)
            facts[f"d{i}"] = F.count_if(number_from_text(x).isNotNull())
            facts[f"p{i}"] = F.coalesce(F.bool_or(is_padded(x)), F.lit(False))
        seen = run_aggregates(df, facts)
        return {c: TextFacts(seen[f"u{i}"], seen[f"d{i}"], seen[f"p{i}"]) for i, c in enumerate(names)}
    value = F.col("value")
    rows = (
        value_counts(df, names)
        .groupBy("column")
        .agg(
            F.count("*").alias("unique"),
            F.sum(F.when(number_from_text(value).isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("numbers"),
            F.bool_or(is_padded(value)).alias("padded"),
        )
        .collect()
    )
    found = {r["column"]: TextFacts(r["unique"], r["numbers"], r["padded"]) for r in rows}
    return {c: found.get(c, TextFacts()) for c in names}


def find_problems(
    df: DataFrame, skip: Iterable[str] = (), thresholds: Thresholds = DEFAULTS, approx: bool = False
) -> list[Proposal]:
    """Findings in column order; within a column nulls, constant, outliers, skew, mixed, cardinality, padding."""
    skipped = set(skip)
    names = [c for c in data_columns(df) if c not in skipped]
    if not names:
        return []
    seen = run_aggregates(df, _plain_facts(df, names))
    rows = seen["rows"]
    if rows == 0:
        return []
    numbers = [i for i, c in enumerate(names) if is_numeric(dtype(df, c))]
    texts = [i for i, c in enumerate(names) if is_text(dtype(df, c)) and seen[f"n{i}"]]
    counts = {names[i]: seen[f"n{i}"] for i in numbers}
    quartiles = quantiles(df, [names[i] for i in numbers], [0.25, 0.75], counts, approx)
    bounds = {}
    for c, (q1, q3) in quartiles.items():
        if q1 is not None:
            reach = thresholds.outlier_iqr_scale * (q3 - q1)
            bounds[c] = (q1 - reach, q3 + reach)
    outside = {
        c: F.count_if((col(c) < F.lit(low)) | (col(c) > F.lit(high))) for c, (low, high) in bounds.items()
    }
    outliers = run_aggregates(df, {f"o{i}": outside[names[i]] for i in numbers if names[i] in outside})
    text = _text_facts(df, [names[i] for i in texts], approx)

    found: list[Proposal] = []

    def report(c: str, kind: str, reason: str, measure: float, remedy) -> None:
        found.append(Proposal(len(found), c, kind, reason, measure, remedy))

    for i, c in enumerate(names):
        missing = 100.0 * (rows - seen[f"n{i}"]) / rows
        if missing > thresholds.null_drop_percent:
            report(c, "Redundant Column", f"{missing:.1f}% of the values are missing", missing, DropColumn(c))
        elif missing > 0:
            rule = NullCheck(col=c, desc=f"{c} is NOT NULL")
            report(c, "Null Check", f"{missing:.1f}% of the values are missing", missing, rule)
        constant = seen[f"same{i}"] if f"same{i}" in seen else c not in text or text[c].unique == 1
        if constant:
            report(c, "Constant Value", "all values are the same", float(seen[f"n{i}"] > 0), DropColumn(c))
        if outliers.get(f"o{i}"):
            low, high = bounds[c]
            n = outliers[f"o{i}"]
            rule = RangeCheck(col=c, min=low, max=high, desc=f"{c} within its usual range")
            report(c, "Range Check", f"{n} values lie far outside the middle half", n, rule)
        skew = seen.get(f"skew{i}")
        if skew is not None and abs(skew) > thresholds.high_skewness:
            note = Note(desc=f"'{c}' is skewed: {skew:.2f}")
            report(c, "Distribution Warning", f"skewness is {skew:.2f}", skew, note)
        if i in texts:
            share = text[c].numbers / seen[f"n{i}"]
            if thresholds.mixed_share_min <= share < thresholds.mixed_share_below:
                report(c, "Type Cast", f"{share:.1%} of the texts are numbers", share, CastType(c, "float64"))
            unique = 100.0 * text[c].unique / rows
            if unique > thresholds.high_cardinality_percent:
                note = Note(desc=f"'{c}' has {text[c].unique} unique values")
                report(c, "High Cardinality", f"{text[c].unique} unique values, {unique:.1f}% of the rows", unique, note)
            if text[c].padded:
                report(c, "Formatting Issue", "leading or trailing white space", 1.0, StripWhitespace(c))
    return found


def scout(df: DataFrame, skip: Iterable[str] = (), thresholds: Thresholds = DEFAULTS, approx: bool = False) -> DataFrame:
    """The findings as a table; ``remedy`` is the step or rule as JSON."""
    found = find_problems(df, skip, thresholds, approx)
    return df.sparkSession.createDataFrame([p.to_row() for p in found], PROPOSAL_SCHEMA)


def accept(
    proposals: list[Proposal], recipe: Recipe = Recipe(), rulebook: Rulebook = Rulebook()
) -> tuple[Recipe, Rulebook, set[str]]:
    """Add the remedies to a recipe and a rulebook; also returns the columns now dealt with."""
    for p in proposals:
        if isinstance(p.remedy, Rule):
            rulebook = rulebook.add(p.remedy, at_end=True)
        else:
            recipe = recipe.then(p.remedy)
    return recipe, rulebook, {p.column for p in proposals}


def dismiss(proposals: list[Proposal], position: int) -> tuple[list[Proposal], str]:
    """The proposals without one of them, and its column, to be skipped from now on."""
    gone = next(p for p in proposals if p.position == position)
    return [p for p in proposals if p.position != position], gone.column


# ------------------------------------------------------------------ quick checks


def padded_columns(df: DataFrame) -> DataFrame:
    """(column, padded): how many texts of each text column have white space around them."""
    names = text_columns(df)
    sums = [F.count_if(is_padded(col(c))).alias(f"p{i}") for i, c in enumerate(names)]
    lines = [F.struct(F.lit(c).alias("column"), F.col(f"p{i}").alias("padded")) for i, c in enumerate(names)]
    return df.agg(*sums).select(F.inline(F.array(*lines))).filter("padded > 0")


def empty_counts(df: DataFrame) -> DataFrame:
    """One row: number of all-missing columns and of all-missing rows, in one pass."""
    names = data_columns(df)
    counts = [F.count(col(c)).alias(f"c{i}") for i, c in enumerate(names)]
    blank = sum((F.when(F.col(f"c{i}") == 0, 1).otherwise(0) for i in range(len(names))), F.lit(0))
    both = df.agg(*counts, F.count_if(all_missing(names)).alias("empty_rows"))
    return both.select(blank.cast("bigint").alias("empty_columns"), "empty_rows")


def quick_actions(df: DataFrame) -> dict[str, object]:
    """What the one-click fixes would act on."""
    blank = empty_counts(df).first()
    return {
        "duplicate_rows": duplicate_count(df).first()[0],
        "empty_columns": blank["empty_columns"],
        "empty_rows": blank["empty_rows"],
        "padded_columns": [r["column"] for r in padded_columns(df).collect()],
        "names_to_normalize": [c for c in data_columns(df) if needs_normalizing(c)],
    }
