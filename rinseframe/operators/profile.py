"""Profiles: health, overview, per-column summaries, value counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from rinseframe.frames import col, data_columns, dtype, is_numeric, is_time, numeric_columns
from rinseframe.model import Rulebook
from rinseframe.operators.rows import duplicate_count
from rinseframe.operators.rules import total_violations
from rinseframe.operators.stats import (
    adjusted_skewness, distinct_counts, quantiles, run_aggregates, value_counts, value_facts,
)

MAX_CATEGORIES = 10
QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]


def health_of(present: Column, cells: Column) -> Column:
    """Share of cells that hold a value, as a whole percentage rounded down; 0 without cells."""
    return F.when(cells == 0, F.lit(0)).otherwise(F.floor(F.try_divide(present * 100, cells))).cast("bigint")


def table_facts(df: DataFrame) -> DataFrame:
    """One row: rows, columns, nulls, cells, health. One pass."""
    names = data_columns(df)
    present = [F.count(col(c)).alias(f"c{i}") for i, c in enumerate(names)]
    totals = df.agg(F.count("*").alias("rows"), *present)
    held = sum((F.col(f"c{i}") for i in range(len(names))), F.lit(0).cast("bigint"))
    cells = F.col("rows") * F.lit(len(names)).cast("bigint")
    return totals.select(
        "rows",
        F.lit(len(names)).cast("bigint").alias("columns"),
        (cells - held).alias("nulls"),
        cells.alias("cells"),
        health_of(held, cells).alias("health"),
    )


def health(df: DataFrame) -> DataFrame:
    return table_facts(df).select("health")


def overview(df: DataFrame, rules: Rulebook | Iterable = ()) -> DataFrame:
    """One row: health, rows, columns, duplicates, violations."""
    facts = table_facts(df)
    return facts.select(
        "health",
        "rows",
        "columns",
        duplicate_count(df).scalar().alias("duplicates"),
        total_violations(df, rules).scalar().alias("violations"),
    )


def type_composition(df: DataFrame) -> dict[str, int]:
    """Number of columns per type; needs the schema only."""
    out: dict[str, int] = {}
    for c in data_columns(df):
        name = dtype(df, c).simpleString()
        out[name] = out.get(name, 0) + 1
    return out


# ------------------------------------------------------------------ per column

_SUMMARY = (
    "position int, column string, type string, nulls bigint, null_percent double, unique bigint, "
    "mean double, mode string, min double, max double"
)


def column_summary(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Type, nulls, distinct count, and mean/min/max of numbers or the mode of anything else."""
    names = columns or data_columns(df)
    numbers = [c for c in names if is_numeric(dtype(df, c))]
    others = [c for c in names if c not in numbers]
    facts: dict[str, Column] = {"rows": F.count("*")}
    for i, c in enumerate(names):
        facts[f"n{i}"] = F.count(col(c))
        if c in numbers:
            x = col(c).cast("double")
            facts |= {f"avg{i}": F.avg(x), f"lo{i}": F.min(x), f"hi{i}": F.max(x)}
    seen = run_aggregates(df, facts)
    modes = value_facts(df, others)
    distinct = distinct_counts(df, numbers, approx) | {c: modes[c]["unique"] for c in others}
    rows = []
    for i, c in enumerate(names):
        nulls = seen["rows"] - seen[f"n{i}"]
        rows.append(
            (
                i, c, dtype(df, c).simpleString(), nulls,
                100.0 * nulls / seen["rows"] if seen["rows"] else 0.0,
                distinct[c], seen.get(f"avg{i}"), modes[c]["top"] if c in modes else None,
                seen.get(f"lo{i}"), seen.get(f"hi{i}"),
            )
        )
    return df.sparkSession.createDataFrame(rows, _SUMMARY)


_DESCRIBE = (
    "position int, column string, count bigint, unique bigint, top string, freq bigint, mean double, "
    "std double, min double, q1 double, median double, q3 double, max double"
)


def describe(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Count for every column; unique/top/freq for texts and flags; moments and quartiles for numbers and times.

    Times are given in seconds since 1970-01-01.
    """
    names = columns or data_columns(df)
    shown = df.select(*[_seconds(df, c).alias(c) for c in names])
    numbers = [c for c in names if is_numeric(dtype(shown, c))]
    facts: dict[str, Column] = {}
    for i, c in enumerate(names):
        facts[f"n{i}"] = F.count(col(c))
        if c in numbers:
            x = col(c).cast("double")
            facts |= {f"avg{i}": F.avg(x), f"std{i}": F.stddev_samp(x), f"lo{i}": F.min(x), f"hi{i}": F.max(x)}
    seen = run_aggregates(shown, facts)
    counts = {c: seen[f"n{i}"] for i, c in enumerate(names)}
    # apart, since a time has to be converted wherever it is compared
    times = [c for c in names if is_time(dtype(df, c))]
    inner = quantiles(df, [c for c in numbers if c not in times], [0.25, 0.5, 0.75], counts, approx)
    inner |= quantiles(shown, times, [0.25, 0.5, 0.75], counts, approx)
    tops = value_facts(shown, [c for c in names if c not in numbers])
    rows = []
    for i, c in enumerate(names):
        top = tops.get(c, {})
        rows.append(
            (
                i, c, seen[f"n{i}"], top.get("unique"), top.get("top"), top.get("freq"),
                seen.get(f"avg{i}"), seen.get(f"std{i}"), seen.get(f"lo{i}"),
                *inner.get(c, [None, None, None]), seen.get(f"hi{i}"),
            )
        )
    return df.sparkSession.createDataFrame(rows, _DESCRIBE)


def _seconds(df: DataFrame, name: str) -> Column:
    t = dtype(df, name)
    if not is_time(t):
        return col(name)
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, col(name).cast("timestamp_ntz")) / F.lit(1e6)


def numeric_diagnostics(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, type, nulls, unique, skew) of numeric columns."""
    names = columns or numeric_columns(df)
    facts: dict[str, Column] = {"rows": F.count("*")}
    for i, c in enumerate(names):
        facts |= {f"n{i}": F.count(col(c)), f"s{i}": adjusted_skewness(col(c).cast("double"))}
    seen = run_aggregates(df, facts)
    distinct = distinct_counts(df, names, approx)
    rows = [
        (c, dtype(df, c).simpleString(), seen["rows"] - seen[f"n{i}"], distinct[c], seen[f"s{i}"])
        for i, c in enumerate(names)
    ]
    return df.sparkSession.createDataFrame(rows, "column string, type string, nulls bigint, unique bigint, skew double")


def five_number(df: DataFrame, columns: list[str] | None = None, approx: bool = False, **plan: int) -> DataFrame:
    """(column, min, q1, median, q3, max, mean) of numeric columns. ``plan``: see ``quantiles``."""
    names = columns or numeric_columns(df)
    facts: dict[str, Column] = {}
    for i, c in enumerate(names):
        x = col(c).cast("double")
        facts |= {f"n{i}": F.count(x), f"a{i}": F.avg(x), f"lo{i}": F.min(x), f"hi{i}": F.max(x)}
    seen = run_aggregates(df, facts)
    inner = quantiles(df, names, [0.25, 0.5, 0.75], {c: seen[f"n{i}"] for i, c in enumerate(names)}, approx, **plan)
    rows = [(c, seen[f"lo{i}"], *inner[c], seen[f"hi{i}"], seen[f"a{i}"]) for i, c in enumerate(names)]
    return df.sparkSession.createDataFrame(
        rows, "column string, min double, q1 double, median double, q3 double, max double, mean double"
    )


_BOX = (
    "column string, q1 double, median double, q3 double, low_fence double, high_fence double, "
    "low_whisker double, high_whisker double, outliers bigint"
)


def box_stats(df: DataFrame, columns: list[str] | None = None, scale: float = 1.5, approx: bool = False) -> DataFrame:
    """Quartiles, fences, the outermost values inside the fences, and the number of values outside."""
    names = columns or numeric_columns(df)
    quart = {c: q for c, q in quantiles(df, names, [0.25, 0.5, 0.75], approx=approx).items() if q[0] is not None}
    fences = {c: (q[0] - scale * (q[2] - q[0]), q[2] + scale * (q[2] - q[0])) for c, q in quart.items()}
    facts: dict[str, Column] = {}
    for i, c in enumerate(names):
        if c in fences:
            x, (low, high) = col(c).cast("double"), fences[c]
            inside = F.when((x >= F.lit(low)) & (x <= F.lit(high)), x)
            facts |= {f"lo{i}": F.min(inside), f"hi{i}": F.max(inside), f"out{i}": F.count(x) - F.count(inside)}
    seen = run_aggregates(df, facts)
    rows = [
        (c, *quart[c], *fences[c], seen[f"lo{i}"], seen[f"hi{i}"], seen[f"out{i}"])
        for i, c in enumerate(names)
        if c in fences
    ]
    return df.sparkSession.createDataFrame(rows, _BOX)


def outlier_points(df: DataFrame, columns: list[str] | None = None, scale: float = 1.5, approx: bool = False) -> DataFrame:
    """(_row_id, column, value) of the values outside the fences."""
    names = columns or numeric_columns(df)
    quart = {c: q for c, q in quantiles(df, names, [0.25, 0.75], approx=approx).items() if q[0] is not None}
    cells = []
    for c, (q1, q3) in quart.items():
        x, reach = col(c).cast("double"), scale * (q3 - q1)
        far = (x < F.lit(q1 - reach)) | (x > F.lit(q3 + reach))
        cells.append(F.when(far, F.struct(F.lit(c).alias("column"), x.alias("value"))))
    return df.select("_row_id", F.inline(F.array_compact(F.array(*cells))))


# ------------------------------------------------------------------ categories


def top_values(df: DataFrame, columns: list[str], limit: int = MAX_CATEGORIES) -> DataFrame:
    """(column, value, n, is_other): counts per value; with over ``limit`` values the first limit - 1 and a rest.

    Ties go to the smaller value. Only the best values of each partition are shuffled
    for the ranking, however many distinct values a column has.
    """
    counts = value_counts(df, columns)
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"), F.count("*").alias("values"))
    # one row of totals per column
    kept = ranked.join(F.broadcast(totals), "column").filter(
        (F.col("values") <= limit) | (F.col("place") < limit)
    )
    shown = kept.select("column", "value", "n", F.lit(False).alias("is_other"), "total", "values")
    rest = (
        shown.groupBy("column")
        .agg((F.first("total") - F.sum("n")).alias("n"), F.first("values").alias("values"))
        .filter(F.col("values") > limit)
        .select("column", F.lit("Other").alias("value"), "n", F.lit(True).alias("is_other"))
    )
    return shown.drop("total", "values").unionByName(rest)


def categorical_diagnostics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, type, unique, mode, frequency, frequency_percent, nulls, null_percent)."""
    names = columns or [c for c in data_columns(df) if not is_numeric(dtype(df, c))]
    seen = run_aggregates(df, {"rows": F.count("*")} | {f"n{i}": F.count(col(c)) for i, c in enumerate(names)})
    facts, rows = value_facts(df, names), seen["rows"]
    out = []
    for i, c in enumerate(names):
        freq, nulls = facts[c]["freq"], rows - seen[f"n{i}"]
        out.append(
            (
                c, dtype(df, c).simpleString(), facts[c]["unique"], facts[c]["top"], freq,
                100.0 * freq / rows if freq else 0.0, nulls, 100.0 * nulls / rows if rows else 0.0,
            )
        )
    return df.sparkSession.createDataFrame(
        out,
        "column string, type string, unique bigint, mode string, frequency bigint, frequency_percent double, "
        "nulls bigint, null_percent double",
    )
