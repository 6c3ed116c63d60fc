"""Lineage, audit trail and the evidence tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rinseframe.frames import data_columns, quoted
from rinseframe.model import ROW_ID, BadStep, Note, Recipe, Rulebook, Step
from rinseframe.operators.profile import health_of, table_facts
from rinseframe.operators.rules import DETAIL_ROWS, _type_name, resolve_rules, rule_counts, violation_hits
from rinseframe.plans.compile import Context, compile_recipe
from rinseframe.plans.effects import ALIVE

# How a step reads in the audit trail; {name} is a field of the step in its JSON form.
_SENTENCES = {
    "drop_column": "Removed column {column}",
    "rename_column": "Column {column} is now called {value}",
    "reorder_columns": "New column order: {value}",
    "normalize_column_names": "Column names brought to {value}",
    "drop_empty_columns": "Removed columns without values",
    "drop_nulls": "Removed rows where {column} is missing",
    "drop_empty_rows": "Removed rows without values",
    "drop_duplicates": "Removed repeated rows",
    "cast_type": "Column {column} converted to {dtype}",
    "replace": "In {column}, {find} became {replace} (pattern: {regex})",
    "strip_whitespace": "Outer white space removed in {column}",
    "normalize_text": "Text of {column} normalised: {value}",
    "cap_range": "Column {column} limited to {min} .. {max}",
    "log_transform": "Column {column} replaced by its logarithm",
    "extract_datetime": "Took the {component} of {column} into {new_column}",
    "fill_null": "Missing values of {column} filled: {value}",
}


def describe_step(step: Step) -> str:
    data = step.to_dict()
    if step.action == "drop_violated":
        rule = data.get("rule") or {}
        return f"Removed rows that break the rule: {rule.get('desc') or 'unnamed'}"
    sentence = _SENTENCES.get(step.action)
    if sentence is None or isinstance(step, BadStep):
        return f"Step {data.get('action')} on {step.target}"
    return sentence.format(**data)


def _state(frame: DataFrame, names: list[str], k: int) -> tuple[DataFrame, dict[str, Column]]:
    """Carry how many cells of step k's table hold a value, and whether the row is still there."""
    held = " + ".join(f"int({quoted(c)} IS NOT NULL)" for c in names) or "0"
    flagged = frame.withColumn(f"_rf_held{k}", F.expr(f"CASE WHEN {ALIVE} THEN {held} END"))
    sums = {
        f"rows{k}": F.count(f"_rf_held{k}"),
        f"held{k}": F.coalesce(F.sum(f"_rf_held{k}"), F.lit(0)).cast("bigint"),
    }
    return flagged, sums


def audit_trail(df: DataFrame, recipe: Recipe | Iterable, ctx: Context | None = None) -> DataFrame:
    """(step, action, target, description, health, rows, removed), step 0 being the original data.

    Row-wise steps and filters are all measured in one scan: filters only flag rows, and
    each state adds one small number per row. A new scan starts only at a step that
    regroups the table.
    """
    recipe = recipe if isinstance(recipe, Recipe) else Recipe.of(*recipe)
    effects, states = compile_recipe(df, recipe, ctx)
    widths = [len(data_columns(s)) for s in states]
    scans: list[tuple[DataFrame, list[int], list[Column]]] = []

    def start(k: int):
        frame, sums = _state(states[k].withColumn(ALIVE, F.lit(True)), data_columns(states[k]), k)
        return frame, [k], [e.alias(n) for n, e in sums.items()]

    frame, members, sums = start(0)
    for k, effect in enumerate(effects, start=1):
        if effect.rebuild is not None:
            scans.append((frame, members, sums))
            frame, members, sums = start(k)
            continue
        frame, more = _state(effect.flag(frame), data_columns(states[k]), k)
        members.append(k)
        sums += [e.alias(n) for n, e in more.items()]
    scans.append((frame, members, sums))

    parts = []
    for frame, members, sums in scans:
        lines = []
        for k in members:
            step = recipe.steps[k - 1] if k else None
            cells = F.col(f"rows{k}") * F.lit(widths[k]).cast("bigint")
            lines.append(
                F.struct(
                    F.lit(k).alias("step"),
                    F.lit(step.to_dict()["action"] if step else "load").alias("action"),
                    F.lit(step.target if step else "dataset").alias("target"),
                    F.lit(describe_step(step) if step else "Original data").alias("description"),
                    health_of(F.col(f"held{k}"), cells).alias("health"),
                    F.col(f"rows{k}").alias("rows"),
                )
            )
        parts.append(frame.agg(*sums).select(F.inline(F.array(*lines))))
    trail = reduce(DataFrame.unionByName, parts)
    # one row per step, so one small window
    before = F.lag("rows").over(Window.partitionBy(F.lit(0)).orderBy("step"))
    return trail.withColumn("removed", F.coalesce(before - F.col("rows"), F.lit(0)).cast("bigint"))


# ------------------------------------------------------------------ evidence


def cleaning_impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, change) for rows, columns, nulls and null density in percent."""
    measures = ["rows", "columns", "nulls", "null_percent"]

    def side(df: DataFrame, name: str) -> DataFrame:
        facts = table_facts(df)
        share = F.coalesce(F.try_divide(F.col("nulls") * 100.0, F.col("cells")), F.lit(0.0))
        shown = [F.col(m).cast("double") if m != "null_percent" else share for m in measures]
        pairs = [F.struct(F.lit(m).alias("metric"), v.alias(name)) for m, v in zip(measures, shown)]
        return facts.select(F.inline(F.array(*pairs)))

    # four rows on either side
    both = side(before, "before").join(F.broadcast(side(after, "after")), "metric")
    return both.withColumn("change", F.col("after") - F.col("before"))


def rule_summary(df: DataFrame, rules: Rulebook | Iterable) -> DataFrame:
    """(position, type, desc, status, violations) of every active rule: PASSED, FAILED, ERROR or INFO."""
    resolved = resolve_rules(df, rules)
    notes = [(r.position, _type_name(r.rule), r.rule.desc) for r in resolved if isinstance(r.rule, Note)]
    status = (
        F.when(F.col("error").isNotNull(), "ERROR").when(F.col("violations") > 0, "FAILED").otherwise("PASSED")
    )
    checked = rule_counts(df, rules).select("position", "type", "desc", status.alias("status"), "violations", "error")
    if not notes:
        return checked
    info = df.sparkSession.createDataFrame(notes, "position int, type string, desc string").select(
        "position", "type", "desc", F.lit("INFO").alias("status"), F.lit(None).cast("bigint").alias("violations"),
        F.lit(None).cast("string").alias("error"),
    )
    return checked.unionByName(info)


def violation_details(df: DataFrame, rules: Rulebook | Iterable, limit: int = DETAIL_ROWS) -> DataFrame:
    """(position, _row_id): the first ``limit`` violating rows of each failed rule.

    Each partition passes on its first ``limit`` rows per rule only. Whether a list was
    cut is told by ``rule_summary``: its count exceeds the limit.
    """
    order = Window.partitionBy("position").orderBy(ROW_ID)
    ranked = violation_hits(df, rules).withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") <= limit).select("position", ROW_ID)


def details_shown(df: DataFrame, rules: Rulebook | Iterable, limit: int = DETAIL_ROWS) -> DataFrame:
    """(position, violations, shown, truncated) of each failed rule: whether ``violation_details`` leaves rows out."""
    failed = rule_counts(df, rules).filter(F.col("violations") > 0)
    return failed.select(
        "position", "violations", F.least("violations", F.lit(limit).cast("bigint")).alias("shown"),
        (F.col("violations") > limit).alias("truncated"),
    )
