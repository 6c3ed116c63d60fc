"""Relations between columns: correlation, missingness patterns, standardised values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rinseframe.frames import assign, col, data_columns, numeric_columns
from rinseframe.model import ROW_ID
from rinseframe.operators.stats import finite, run_aggregates
from rinseframe.sources.tables import downsample

_PAIRS = "a string, b string, r double"

def _pairs(df: DataFrame, names: list[str], means: list[float | None]) -> dict[tuple[int, int], float | None]:
    """All pairs from one pass of matrix products per Arrow batch, summed per partition and then by Spark.

    Numbers that are not finite count as missing, here and in the means.
    """
    width = len(names)
    centred = df.select(*[(finite(col(c)) - F.lit(m)).alias(f"x{i}") for i, (c, m) in enumerate(zip(names, means))])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((4, width, width))
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            held = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            totals += np.stack([held.T @ held, x.T @ held, (x * x).T @ held, x.T @ x])
        i, j = np.triu_indices(width, 1)
        n, sums, squares, cross = totals
        yield pd.DataFrame(
            {"i": i, "j": j, "n": n[i, j], "sx": sums[i, j], "sy": sums[j, i], "sxx": squares[i, j],
             "syy": squares[j, i], "sxy": cross[i, j]}
        )

    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    rows = centred.mapInPandas(products, schema).groupBy("i", "j")
    out: dict[tuple[int, int], float | None] = {}
    for r in rows.agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).collect():
        n = max(r["n"], 1.0)
        vx, vy = r["sxx"] - r["sx"] ** 2 / n, r["syy"] - r["sy"] ** 2 / n
        flat = vx <= 1e-12 * r["sxx"] or vy <= 1e-12 * r["syy"]
        cov = r["sxy"] - r["sx"] * r["sy"] / n
        found = math.nan if flat else cov / (math.sqrt(vx) * math.sqrt(vy))
        out[r["i"], r["j"]] = max(-1.0, min(1.0, found)) if math.isfinite(found) else None
    return out


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of every pair over the rows that have two finite values; None without spread."""
    names = columns or numeric_columns(df)
    facts = {}
    for i, c in enumerate(names):
        facts |= {f"m{i}": F.avg(finite(col(c))), f"v{i}": F.min(finite(col(c))) < F.max(finite(col(c)))}
    seen = run_aggregates(df, facts)
    found = _pairs(df, names, [seen[f"m{i}"] for i in range(len(names))]) if len(names) > 1 else {}
    out: dict[tuple[str, str], float | None] = {}
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            # a column with itself is 1 wherever it varies
            out[a, b] = (1.0 if seen[f"v{i}"] else None) if i == j else found.get((min(i, j), max(i, j)))
    return out


def correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The correlation matrix in long form: (a, b, r)."""
    pairs = correlation_pairs(df, columns)
    return df.sparkSession.createDataFrame([(a, b, r) for (a, b), r in pairs.items()], _PAIRS)


def correlation_range(df: DataFrame, low: float, high: float, columns: list[str] | None = None) -> DataFrame:
    """The matrix of the columns that correlate with another one within [low, high]; under two, nothing."""
    pairs = correlation_pairs(df, columns)
    kept = {a for (a, b), r in pairs.items() if a != b and r is not None and low <= r <= high}
    rows = [(a, b, r) for (a, b), r in pairs.items() if a in kept and b in kept] if len(kept) > 1 else []
    return df.sparkSession.createDataFrame(rows, _PAIRS)


def missing_flags(df: DataFrame) -> DataFrame:
    """The table as 0 (present) and 1 (missing), with the row id."""
    return df.select(
        *[c for c in [ROW_ID] if c in df.columns], *[col(c).isNull().cast("int").alias(c) for c in data_columns(df)]
    )


def missingness_map(df: DataFrame, n: int = 1000) -> tuple[DataFrame | None, bool]:
    """Flags of at most n rows in row order, and whether rows were left out; None without any missing value."""
    any_null = df.select(F.greatest(*[col(c).isNull() for c in data_columns(df)], F.lit(False)).alias("m"))
    if any_null.filter("m").limit(1).count() == 0:
        return None, False
    return downsample(missing_flags(df), n)


def missingness_patterns(df: DataFrame) -> DataFrame:
    """Every combination of missing columns with its number of rows: the whole table in one small shuffle."""
    flags = missing_flags(df).drop(ROW_ID)
    return flags.groupBy(*map(col, data_columns(df))).agg(F.count("*").alias("n"))


def zscores(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numeric columns as (x - mean) / sample deviation; missing stays missing. A column without spread is all 0."""
    names = columns or numeric_columns(df)
    facts = {}
    for i, c in enumerate(names):
        facts |= {f"a{i}": F.avg(col(c).cast("double")), f"s{i}": F.stddev_samp(col(c).cast("double"))}
    seen = run_aggregates(df, facts)
    scaled = {}
    for i, c in enumerate(names):
        mean, spread = seen[f"a{i}"], seen[f"s{i}"]
        has_spread = spread is not None and spread == spread and spread > 0
        scaled[c] = (col(c) - F.lit(mean)) / F.lit(spread) if has_spread else F.lit(0.0)
    ids = [c for c in [ROW_ID] if c in df.columns]
    return assign(df.select(*ids, *map(col, names)), scaled)


def zscores_long(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, value): standardised values of all numeric columns below each other."""
    names = columns or numeric_columns(df)
    wide = zscores(df, names)
    ids = [c for c in [ROW_ID] if c in df.columns]
    return wide.unpivot(ids, [col(c) for c in names], "feature", "value")
