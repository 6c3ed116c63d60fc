"""Chained-regression imputation ("iterative") from sufficient statistics.

Every numeric column with gaps is regressed on the others (Bayesian ridge), its gaps are
re-predicted, and this goes round until the largest change is small, ten rounds at most.

Within one pattern of missing cells, every filled value is an affine function of the
row's known values, and stays one through all rounds. So the sums and cross-products of
the known values per pattern (grouped aggregates over the table; at most MOST_PATTERNS patterns)
are enough to run all rounds on small matrices, and the table itself is read only

1. for means and maxima, 2. for the sums per pattern, 3. when needed, once more for the
largest row change of every round, and 4. lazily, to fill.

No intermediate table is written and nothing grows with the rounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rinseframe.frames import assign, col, dtype, is_numeric, numeric_columns
from rinseframe.operators.stats import run_aggregates
from rinseframe.plans.effects import Effect, nothing

# Defaults of the usual chained imputer and its Bayesian ridge.
MAX_ROUNDS = 10
TOLERANCE = 1e-3
PRIOR = 1e-6
RIDGE_ROUNDS = 300
RIDGE_TOLERANCE = 1e-3

#: Patterns of gaps that are told apart at most, and sums of one aggregate.
MOST_PATTERNS = 4096
SUMS_AT_ONCE = 600


def bayesian_ridge(xtx: np.ndarray, xty: np.ndarray, yty: float, n: float) -> np.ndarray:
    """Coefficients from centred cross-products; noise and weight precision by evidence updates."""
    if not len(xty):
        return np.zeros(0)
    eig, vec = np.linalg.eigh(xtx)
    eig = np.clip(eig, 0.0, None)
    turned = vec.T @ xty
    noise = 1.0 / (yty / n + np.finfo(float).eps)
    weight = 1.0
    before = None

    def solve():
        return vec @ (turned / (eig + weight / noise))

    for _ in range(RIDGE_ROUNDS):
        coef = solve()
        rest = max(yty - 2.0 * coef @ xty + coef @ xtx @ coef, 0.0)
        known = np.sum(noise * eig / (weight + noise * eig))
        weight = (known + 2 * PRIOR) / (coef @ coef + 2 * PRIOR)
        noise = (n - known + 2 * PRIOR) / (rest + 2 * PRIOR)
        if before is not None and np.abs(before - coef).sum() < RIDGE_TOLERANCE:
            break
        before = coef
    return solve()


def gap_pattern(names: list[str]) -> Column:
    """A letter for each column: 1 where its value is missing."""
    return F.concat(*[F.when(col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in names])


def _bits(pattern: str) -> int:
    return int(pattern[::-1], 2)


def _letters(bits: int, d: int) -> str:
    return f"{bits:0{d}b}"[::-1]


def _centred(names: list[str], means: list[float]) -> list[Column]:
    return [F.coalesce(col(c).cast("double") - F.lit(m), F.lit(0.0)) for c, m in zip(names, means)]


def _pattern_sums(df: DataFrame, names: list[str], means: list[float]) -> dict[int, np.ndarray]:
    """Pattern of gaps -> cross-products of (1, known values), from grouped aggregates."""
    d = len(names)
    z = df.select(gap_pattern(names).alias("p"), *[e.alias(f"z{i}") for i, e in enumerate(_centred(names, means))])
    sums = {(0, 0): F.count("*").cast("double")}
    sums |= {(0, i + 1): F.sum(f"z{i}") for i in range(d)}
    sums |= {(i + 1, j + 1): F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i in range(d) for j in range(i, d)}
    out: dict[int, np.ndarray] = {}
    places = list(sums)
    for some in (places[i : i + SUMS_AT_ONCE] for i in range(0, len(places), SUMS_AT_ONCE)):
        for row in z.groupBy("p").agg(*[sums[at].alias(f"s_{at[0]}_{at[1]}") for at in some]).collect():
            g = out.setdefault(_bits(row["p"]), np.zeros((d + 1, d + 1)))
            for i, j in some:
                g[i, j] = g[j, i] = row[f"s_{i}_{j}"]
    return out


def _rounds(sums: dict[int, np.ndarray], d: int) -> list[dict[int, np.ndarray]]:
    """Affine maps (1, known) -> (1, full row) per pattern: the start, then after every round."""
    missing_rows = [sum(g[0, 0] for p, g in sums.items() if p >> i & 1) for i in range(d)]
    order = [i for i in sorted(range(d), key=lambda i: missing_rows[i]) if missing_rows[i]]
    maps = {}
    for p in sums:
        m = np.eye(d + 1)
        for i in range(d):
            if p >> i & 1:
                m[i + 1, i + 1] = 0.0
        maps[p] = m
    history = [{p: m.copy() for p, m in maps.items()}]
    for _ in range(MAX_ROUNDS):
        for i in order:
            others = [j + 1 for j in range(d) if j != i]
            full = sum(maps[p] @ g @ maps[p].T for p, g in sums.items() if not p >> i & 1)
            n = full[0, 0]
            mean_x, mean_y = full[0, others] / n, full[0, i + 1] / n
            xtx = full[np.ix_(others, others)] - n * np.outer(mean_x, mean_x)
            xty = full[others, i + 1] - n * mean_x * mean_y
            coef = bayesian_ridge(xtx, xty, full[i + 1, i + 1] - n * mean_y**2, n)
            start = mean_y - mean_x @ coef
            for p, m in maps.items():
                if p >> i & 1:
                    m[i + 1] = start * m[0] + coef @ m[others]
        history.append({p: m.copy() for p, m in maps.items()})
        if len(order) == 1 and len(history) > 2:
            break  # the predictors have no gaps, so a second round repeats the first
    return history


def _row_changes(df: DataFrame, names: list[str], means: list[float], steps: list[dict[int, np.ndarray]]) -> list[float]:
    """Largest sum of absolute changes in a row, for each of the given map differences, in one pass."""
    d = len(names)
    rows = [(_letters(p, d), [m[1:].tolist() for m in (s[p] for s in steps)]) for p in steps[0] if p]
    table = df.sparkSession.createDataFrame(rows, "_rf_p string, _rf_m array<array<array<double>>>")
    u = F.array(F.lit(1.0), *_centred(names, means))
    gaps = df.select(gap_pattern(names).alias("_rf_p"), u.alias("_rf_u")).filter(F.col("_rf_p").contains("1"))
    joined = gaps.join(F.broadcast(table), "_rf_p")

    def dot(line):
        return F.aggregate(F.zip_with(line, "_rf_u", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    change = F.transform("_rf_m", lambda m: F.aggregate(m, F.lit(0.0), lambda s, line: s + F.abs(dot(line))))
    tops = joined.select(change.alias("c")).agg(*[F.max(F.get("c", F.lit(t))) for t in range(len(steps))]).first()
    return [t or 0.0 for t in tops]


def fitted_maps(df: DataFrame, names: list[str]) -> tuple[dict[int, np.ndarray], list[float], int]:
    """Final affine map per gap pattern, the column means, and the number of rounds used."""
    d = len(names)
    facts = {}
    for i, c in enumerate(names):
        x = col(c).cast("double")
        facts |= {f"m{i}": F.avg(x), f"lo{i}": F.min(x), f"hi{i}": F.max(x)}
    seen = run_aggregates(df, facts)
    means = [seen[f"m{i}"] for i in range(d)]
    reach = np.array([1.0] + [max(seen[f"hi{i}"] - means[i], means[i] - seen[f"lo{i}"]) for i in range(d)])
    stop = TOLERANCE * max(max(abs(seen[f"lo{i}"]), abs(seen[f"hi{i}"])) for i in range(d))
    if d == 1:
        return {1: np.array([[1.0, 0.0], [0.0, 0.0]])}, means, 0
    history = _rounds(_pattern_sums(df, names, means), d)
    steps = [{p: history[t][p] - history[t - 1][p] for p in history[0]} for t in range(1, len(history))]
    # no row can change more than this, so a small bound settles a round without reading the table
    bounds = [max((np.abs(m) @ reach).sum() for m in s.values()) for s in steps]
    settled = next((t for t, b in enumerate(bounds) if b < stop), len(steps) - 1)
    if settled:
        changes = _row_changes(df, names, means, steps[:settled])
        settled = next((t for t, c in enumerate(changes) if c < stop), settled)
    return history[settled + 1], means, settled + 1


def chained_effect(df: DataFrame, target: str, predictors: list[str]) -> Effect:
    if not is_numeric(dtype(df, target)):
        return nothing(f"Error: ITERATIVE imputation requires a numeric column, '{target}' is not.")
    every = numeric_columns(df)
    names = every if len(predictors) + 1 == len(every) else [target, *predictors]
    counts = run_aggregates(df, {f"n{i}": F.count(col(c)) for i, c in enumerate(names)} | {"rows": F.count("*")})
    blank = [c for i, c in enumerate(names) if counts[f"n{i}"] == 0]
    if blank:
        return nothing(f"Error: ITERATIVE imputation of '{target}' was skipped, column '{blank[0]}' has no values.")
    at = names.index(target)
    if counts[f"n{at}"] == counts["rows"]:
        return Effect(whole_table=True)
    maps, means, _ = fitted_maps(df, names)
    rows = [(_letters(p, len(names)), m[at + 1].tolist()) for p, m in maps.items() if p >> at & 1]

    def fill(frame: DataFrame) -> DataFrame:
        table = frame.sparkSession.createDataFrame(rows, "_rf_p string, _rf_w array<double>")
        joined = frame.withColumn("_rf_p", gap_pattern(names)).join(F.broadcast(table), "_rf_p", "left")
        value = F.col("_rf_w")[0] + F.lit(means[at])
        for i, z in enumerate(_centred(names, means)):
            value = value + F.col("_rf_w")[i + 1] * z
        filled = assign(joined, {target: F.coalesce(col(target).cast("double"), value)})
        return filled.select(*map(col, frame.columns))

    return Effect(project=fill, whole_table=True)
