"""Statistics shared by the scout, the profiles and the imputers.

Everything here returns a handful of numbers per column. Aggregates over many
columns run in groups, so that the generated code of one aggregate stays small
enough to be compiled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rinseframe.frames import col, dtype, groups_of, is_numeric, is_text

AGGREGATE_WIDTH = 120

# Up to this many rows, or different values of any number of rows, the built-in exact percentile (one map of values and
# counts per column) is used; beyond it, order statistics are narrowed down by repeated scans with bounded memory.
PERCENTILE_ROWS = 100_000
BRACKET_ROWS = 200_000
SKETCH_SIZE = 4_000
# Intervals finished in one pass, so that their condition stays compilable.
FINISH_INTERVALS = 30


def run_aggregates(df: DataFrame, exprs: dict[str, Column], width: int = AGGREGATE_WIDTH) -> dict[str, object]:
    """Evaluate named aggregates in as few passes as their number allows.

    Callers list them column by column, so that each pass reads its own columns of a columnar file.
    """
    out: dict[str, object] = {}
    for names in groups_of(exprs, width):
        row = df.agg(*[exprs[n].alias(n) for n in names]).first()
        out.update(row.asDict())
    return out


# ------------------------------------------------------------- order statistics


@dataclass
class _Search:
    """The open interval (low, high) still known to hold the value of one rank."""

    column: str
    rank: int
    below: int = 0
    inside: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None


def _within(x: Column, low: float | None, high: float | None) -> Column:
    cond = x.isNotNull()
    if low is not None:
        cond = cond & (x > F.lit(low))
    if high is not None:
        cond = cond & (x < F.lit(high))
    return cond


def _number(name: str) -> Column:
    """As double; NaN counts as missing."""
    x = col(name).cast("double")
    return F.when(~F.isnan(x), x)


def _sketched(x: Column, probs: list[float]) -> Column:
    """Approximate quantiles from a sketch of bounded size (rank error about 1 / SKETCH_SIZE)."""
    sketch = F.kll_sketch_agg_double(x, F.lit(SKETCH_SIZE))
    return F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, probs)))


def _by_interval(searches: list[_Search]) -> dict[tuple, list[_Search]]:
    out: dict[tuple, list[_Search]] = {}
    for s in searches:
        out.setdefault((s.column, s.low, s.high), []).append(s)
    return out


def _cut_probs(searches: list[_Search]) -> list[float]:
    """Probabilities a margin to either side of the ranks of one interval; close ranks share them."""
    margin = 6.0 / SKETCH_SIZE
    at = sorted((s.rank - s.below) / max(s.inside - 1, 1) for s in searches)
    out = []
    for i, p in enumerate(at):
        if i == 0 or p - at[i - 1] > margin:
            out.append(max(p - margin, 0.0))
        if i + 1 == len(at) or at[i + 1] - p > margin:
            out.append(min(p + margin, 1.0))
    return out


def _narrow(df: DataFrame, open_searches: list[_Search]) -> None:
    """One round: sketch cut points on both sides of each rank, count exactly around them, keep the part in between.

    Searches in the same interval share a sketch, and equal cut points share their counts.
    """
    shared = _by_interval(open_searches)
    sketches = {}
    for i, ((name, low, high), searches) in enumerate(shared.items()):
        x = F.when(_within(_number(name), low, high), _number(name))
        sketches[f"c{i}"] = _sketched(x, _cut_probs(searches))
    found = run_aggregates(df, sketches)
    cuts = sorted({(name, v) for i, (name, _, _) in enumerate(shared) for v in found[f"c{i}"]})
    counts = {}
    for i, (name, v) in enumerate(cuts):
        counts[f"lt{i}"] = F.count_if(_number(name) < F.lit(v))
        counts[f"le{i}"] = F.count_if(_number(name) <= F.lit(v))
    seen = run_aggregates(df, counts)
    for s in open_searches:
        end = s.below + s.inside
        for i, (name, v) in enumerate(cuts):
            if name != s.column:
                continue
            lt, le = seen[f"lt{i}"], seen[f"le{i}"]
            if lt <= s.rank < le:
                s.value = v
            elif le <= s.rank and le >= s.below:
                s.low, s.below = v, le
            elif lt > s.rank and lt < end:
                s.high, end = v, lt
        s.inside = end - s.below


def _finish(df: DataFrame, searches: list[_Search]) -> None:
    """Pick each rank from its interval, which by now holds at most BRACKET_ROWS rows."""
    for batch in groups_of(_by_interval(searches).items(), FINISH_INTERVALS):
        ranges = [(name, _within(_number(name), low, high)) for (name, low, high), _ in batch]
        tagged = F.array(
            *[
                F.when(inside, F.struct(F.lit(i).alias("i"), _number(name).alias("x")))
                for i, (name, inside) in enumerate(ranges)
            ]
        )
        # first drop, in generated code, the rows that are in none of the intervals
        near = df.filter(reduce(lambda a, b: a | b, [inside for _, inside in ranges]))
        counted = near.select(F.inline(F.filter(tagged, lambda t: t.isNotNull()))).groupBy("i", "x").count()
        upto = F.sum("count").over(Window.partitionBy("i").orderBy("x"))
        wanted = F.array(
            *[
                F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s.rank - s.below).alias("r")) for k, s in enumerate(own)])
                for _, own in batch
            ]
        )
        ranked = counted.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("count"))
        picked = ranked.select(
            "i", "x", F.filter(F.element_at(wanted, F.col("i") + 1), lambda w: (w["r"] >= F.col("from")) & (w["r"] < F.col("upto"))).alias("w")
        ).filter(F.size("w") > 0)
        for row in picked.collect():
            for w in row["w"]:
                batch[row["i"]][1][w["k"]].value = row["x"]


def order_statistics(
    df: DataFrame, ranks: dict[str, list[int]], counts: dict[str, int], bracket: int | None = None
) -> dict[str, dict[int, float]]:
    """Exact values at 0-based ranks among the non-null values of each numeric column."""
    searches = [_Search(c, r, inside=counts[c]) for c, rs in ranks.items() for r in sorted(set(rs))]
    while True:
        wide = [s for s in searches if s.value is None and s.inside > (BRACKET_ROWS if bracket is None else bracket)]
        before = sum(s.inside for s in wide)
        if not wide:
            break
        _narrow(df, wide)
        if sum(s.inside for s in wide if s.value is None) >= before:
            break  # nothing got narrower: the last step takes intervals of any size
    left = [s for s in searches if s.value is None]
    if left:
        _finish(df, left)
    out: dict[str, dict[int, float]] = {}
    for s in searches:
        out.setdefault(s.column, {})[s.rank] = s.value
    return out


def quantiles(
    df: DataFrame, columns: list[str], probs: list[float], counts: dict[str, int] | None = None, approx: bool = False,
    small: int | None = None, bracket: int | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation, exact unless ``approx``.

    ``small`` and ``bracket`` (BRACKET_ROWS without it) choose the plan, not the result: columns of up to ``small`` values
    take the built-in percentile (without it, those of up to PERCENTILE_ROWS rows or different values), others are
    narrowed until ``bracket`` rows are left.

    ``counts`` are non-null counts per column, when the caller already has them.
    """
    if not columns:
        return {}
    if counts is None:
        counts = run_aggregates(df, {c: F.count(col(c)) for c in columns})
    if approx:
        found = run_aggregates(df, {f"q{i}": _sketched(_number(c), probs) for i, c in enumerate(columns) if counts[c]})
        return {c: found.get(f"q{i}") or [None] * len(probs) for i, c in enumerate(columns)}
    most = PERCENTILE_ROWS if small is None else small
    long = [c for c in columns if counts[c] > most]
    if long and small is None:
        # Many rows of few values: their map is small. The estimate is a few percent off.
        seen = run_aggregates(df, {c: F.approx_count_distinct(_number(c)) for c in long})
        long = [c for c in long if seen[c] > 0.9 * most]
    short = [c for c in columns if c not in long]
    direct = run_aggregates(df, {c: F.percentile(_number(c), probs) for c in short}) if short else {}
    direct = {c: direct[c] or [None] * len(probs) for c in short}
    if not long:
        return direct
    # Counts that callers bring include NaN, which has no rank here.
    if fractional := [c for c in long if isinstance(dtype(df, c), (T.DoubleType, T.FloatType))]:
        counts = counts | run_aggregates(df, {c: F.count(_number(c)) for c in fractional})
    ranks: dict[str, list[int]] = {}
    for c in long:
        if counts[c]:
            at = [p * (counts[c] - 1) for p in probs]
            ranks[c] = [math.floor(h) for h in at] + [math.ceil(h) for h in at]
    values = order_statistics(df, ranks, counts, bracket)
    out: dict[str, list[float | None]] = dict(direct)
    for c in long:
        if c not in ranks:
            out[c] = [None] * len(probs)
            continue
        row = []
        for p in probs:
            h = p * (counts[c] - 1)
            low, high = values[c][math.floor(h)], values[c][math.ceil(h)]
            row.append(low if low == high else low + (high - low) * (h - math.floor(h)))
        out[c] = row
    return out


# ------------------------------------------------------------- moments


def adjusted_skewness(x: Column) -> Column:
    """Sample skewness with the small-sample factor; under 3 values NULL, without spread 0."""
    n = F.count(x)
    return F.when(n < 3, None).otherwise(
        F.coalesce(F.skewness(x), F.lit(0.0)) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    )


def finite(x: Column) -> Column:
    """A number as double; NULL where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def correlation_of(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows that have two finite values; NULL without spread or beyond double precision."""
    x, y = finite(x), finite(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    r = finite(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
    return F.when(varies & r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


# ------------------------------------------------------------- value counts


def value_text(df: DataFrame, name: str) -> Column:
    """A value as text, one text per distinct value (-0.0 counts as 0.0)."""
    t = dtype(df, name)
    if is_text(t):
        return col(name)
    if is_numeric(t):
        return (col(name) + F.lit(0)).cast("string")
    return col(name).cast("string")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): every distinct non-null value, all columns in one shuffle.

    The count is combined before the shuffle, so a value that fills a third of the
    table arrives as one row per input partition.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), value_text(df, c).alias("value")) for c in columns])
    return (
        df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    )


def _distinct_of_type(df: DataFrame, columns: list[str], type_name: str) -> dict[str, int]:
    """Distinct non-null values per column, all columns of one type in one shuffle of narrow keys."""
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), col(c).cast(type_name).alias("v")) for i, c in enumerate(columns)])
    once = df.select(F.inline(pairs)).filter(F.col("v").isNotNull()).select("c", "v").distinct()
    found = {r["c"]: r["count"] for r in once.groupBy("c").count().collect()}
    return {c: found.get(i, 0) for i, c in enumerate(columns)}


def distinct_counts(df: DataFrame, columns: list[str], approx: bool = False) -> dict[str, int]:
    if not columns:
        return {}
    if approx:
        return run_aggregates(df, {c: F.approx_count_distinct(col(c)) for c in columns})
    kinds: dict[str, list[str]] = {}
    for c in columns:
        t = dtype(df, c)
        kind = "bigint" if isinstance(t, T.IntegralType) else "double" if isinstance(t, T.FractionalType) else "string"
        kinds.setdefault("string" if isinstance(t, T.DecimalType) else kind, []).append(c)
    out: dict[str, int] = {}
    for kind, names in kinds.items():
        out |= _distinct_of_type(df, names, kind)
    return out


def value_facts(df: DataFrame, columns: list[str]) -> dict[str, dict[str, object]]:
    """Per column: distinct count, most frequent value (smallest on ties) and its count."""
    if not columns:
        return {}
    rows = (
        value_counts(df, columns)
        .groupBy("column")
        .agg(
            F.count("*").alias("unique"),
            F.max("n").alias("freq"),
            # smallest value among those with the highest count
            F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("top"),
        )
        .collect()
    )
    found = {r["column"]: r.asDict() for r in rows}
    return {c: found.get(c, {"column": c, "unique": 0, "freq": None, "top": None}) for c in columns}
