"""Imputers and quantiles against straightforward row-by-row versions on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rinseframe import Recipe, apply_recipe
from rinseframe.operators import chained, knn, stats
from rinseframe.operators.fill import top_predictors


def _frame(spark, columns, names):
    rows = [(i, *[None if math.isnan(v) else float(v) for v in row]) for i, row in enumerate(np.column_stack(columns))]
    schema = "_row_id bigint, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema).repartition(5)


def _gaps(values, every, offset=0):
    out = np.array(values, dtype=float)
    out[offset::every] = np.nan
    return out


def _knn_by_hand(target, others, k=5):
    width = len(others) + 1
    filled = target.copy()
    points = np.column_stack(others)
    donors = np.flatnonzero(~np.isnan(target))
    for i in np.flatnonzero(np.isnan(target)):
        found = []
        for j in donors:
            both = ~np.isnan(points[i]) & ~np.isnan(points[j])
            if both.any():
                gap = points[i][both] - points[j][both]
                found.append((width / both.sum() * float(gap @ gap), j))
        near = [target[j] for _, j in sorted(found)[:k]]
        filled[i] = np.mean(near) if near else np.nanmean(target)
    return filled


def _impute(df, strategy):
    out, messages = apply_recipe(df, [{"action": "fill_null", "column": "y", "value": strategy}])
    assert messages == []
    rows = out.orderBy("_row_id").collect()
    return np.array([r["y"] for r in rows])


@pytest.fixture
def cloud():
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(0, 10, 400), 1)
    b = np.round(rng.normal(0, 3, 400), 1)
    a[100:230] = 4.0  # a third of the rows share one value
    b[100:160] = 1.0
    y = np.round(a * 2 - b + rng.normal(0, 1, 400), 2)
    return _gaps(y, 7), _gaps(a, 11, 3), _gaps(b, 9, 3)


def test_knn_in_one_cell(spark, cloud):
    got = _impute(_frame(spark, cloud, ["y", "a", "b"]), "knn")
    assert np.allclose(got, _knn_by_hand(cloud[0], cloud[1:]))


@pytest.mark.parametrize("cell, chunk", [(40, 7), (9, 50), (150, 1000)])
def test_knn_over_many_cells_parts_and_chunks(spark, cloud, monkeypatch, cell, chunk):
    monkeypatch.setattr(knn, "CELL_ROWS", cell)
    monkeypatch.setattr(knn, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(knn, "MAX_CELLS", 6)
    got = _impute(_frame(spark, cloud, ["y", "a", "b"]), "knn")
    assert np.allclose(got, _knn_by_hand(cloud[0], cloud[1:]))


def test_knn_with_fewer_donors_than_neighbours_and_no_shared_predictor(spark):
    y = np.array([1.0, 3.0, np.nan, np.nan])
    a = np.array([0.0, 5.0, 1.0, np.nan])
    got = _impute(_frame(spark, (y, a), ["y", "a"]), "knn")
    assert got.tolist() == [1.0, 3.0, 2.0, 2.0]


def _ridge_rows(x, y):
    """Bayesian ridge on rows, with the singular values of the centred table."""
    mx, my = x.mean(axis=0), y.mean()
    xc, yc = x - mx, y - my
    _, s, vt = np.linalg.svd(xc, full_matrices=False)
    eig, n = s**2, len(y)
    alpha, lam, old = 1 / (np.var(yc) + np.finfo(float).eps), 1.0, None
    xty = xc.T @ yc

    def solve():
        return vt.T @ ((vt @ xty) / (eig + lam / alpha))

    for i in range(300):
        w = solve()
        sse = np.sum((yc - xc @ w) ** 2)
        gamma = np.sum(alpha * eig / (lam + alpha * eig))
        lam = (gamma + 2e-6) / (np.sum(w**2) + 2e-6)
        alpha = (n - gamma + 2e-6) / (sse + 2e-6)
        if i and np.abs(old - w).sum() < 1e-3:
            break
        old = w
    w = solve()
    return w, my - mx @ w


def _chained_by_hand(table):
    gaps = np.isnan(table)
    full = np.where(gaps, np.nanmean(table, axis=0), table)
    stop = 1e-3 * np.abs(table[~gaps]).max()
    order = [i for i in np.argsort(gaps.mean(axis=0), kind="stable") if gaps[:, i].any()]
    for _ in range(10):
        before = full.copy()
        for i in order:
            rest = [j for j in range(full.shape[1]) if j != i]
            w, b = _ridge_rows(full[~gaps[:, i]][:, rest], full[~gaps[:, i], i])
            full[gaps[:, i], i] = full[gaps[:, i]][:, rest] @ w + b
        if np.abs(full - before).sum(axis=1).max() < stop:
            break
    return full


def test_chained_regression_matches_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(100, 20, 300)
    table = np.column_stack([base, base * 0.5 + rng.normal(0, 4, 300), 300 - base + rng.normal(0, 9, 300)])
    table[::6, 0] = np.nan
    table[2::5, 1] = np.nan
    table[3::11, 2] = np.nan
    got = _impute(_frame(spark, table.T, ["y", "a", "b"]), "iterative")
    assert np.allclose(got, _chained_by_hand(table)[:, 0], atol=1e-6)


def test_chained_regression_reads_the_table_for_undecided_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, 200)
    table = np.column_stack([base + rng.normal(0, 0.05, 200), base + rng.normal(0, 0.05, 200), base])
    table[::3, 0] = np.nan
    table[1::3, 1] = np.nan
    table[2::7, 2] = np.nan
    seen = []
    real = chained._row_changes
    monkeypatch.setattr(chained, "_row_changes", lambda *a: seen.append(real(*a)) or seen[-1])
    got = _impute(_frame(spark, table.T, ["y", "a", "b"]), "iterative")
    assert np.allclose(got, _chained_by_hand(table)[:, 0], atol=1e-6)
    assert seen


def test_chained_regression_of_a_single_column_is_the_mean(spark):
    got = _impute(_frame(spark, (np.array([1.0, np.nan, 5.0]),), ["y"]), "iterative")
    assert got.tolist() == [1.0, 3.0, 5.0]


@pytest.mark.parametrize("strategy", ["knn", "iterative"])
def test_imputers_refuse_text_and_empty_columns(spark, strategy):
    df = spark.createDataFrame([(0, "a", 1.0, None)], "_row_id bigint, t string, y double, e double")
    out, messages = apply_recipe(df, [{"action": "fill_null", "column": "t", "value": strategy}])
    assert "requires a numeric column" in messages[0] and out.collect() == df.collect()
    out, messages = apply_recipe(df, [{"action": "fill_null", "column": "y", "value": strategy}])
    assert "has no values" in messages[0] and out.collect() == df.collect()


def _wide(width=15, rows=120, seed=0):
    """A target of many predictors, each with gaps of its own."""
    rng = np.random.default_rng(seed)
    columns = [_gaps(rng.normal(0, 1 + i, rows), 7 + i, i) for i in range(width)]
    y = np.nansum(columns, axis=0) + rng.normal(0, 0.1, rows)
    return [_gaps(y, 6, 1), *columns], ["y", *[f"c{i}" for i in range(width)]]


@pytest.mark.parametrize("cells", [100_000, 20])
def test_knn_goes_by_all_columns_of_a_wide_table(spark, monkeypatch, cells):
    monkeypatch.setattr(knn, "CELL_ROWS", cells)
    columns, names = _wide(24, 90) if cells > 20 else _wide(12, 80)
    got = _impute(_frame(spark, columns, names), "knn")
    assert np.allclose(got, _knn_by_hand(columns[0], columns[1:]))


def test_regression_goes_by_all_columns_of_a_wide_table(spark, monkeypatch):
    monkeypatch.setattr(chained, "SUMS_AT_ONCE", 50)
    columns, names = _wide(33, 200)
    got = _impute(_frame(spark, columns, names), "iterative")
    assert np.allclose(got, _chained_by_hand(np.column_stack(columns))[:, 0], atol=1e-5)


def test_too_many_patterns_leave_the_ten_best_predictors(spark, monkeypatch):
    columns, names = _wide()
    df = _frame(spark, columns, names)
    best = top_predictors(df, "y")
    assert len(best) == 10
    monkeypatch.setattr(chained, "MOST_PATTERNS", 20)
    monkeypatch.setattr(knn, "MOST_PAIRS", 40)
    for how in ("knn", "iterative"):
        _, messages = apply_recipe(df, [{"action": "fill_null", "column": "y", "value": how, "predictors": names[1:]}])
        assert "too many patterns" in messages[0]
    monkeypatch.setattr(knn, "MOST_PAIRS", 1 << 20)
    out, messages = apply_recipe(df, [{"action": "fill_null", "column": "y", "value": "iterative"}])
    assert "10 best of 15" in messages[0] and best[0][0] in messages[0] and out.filter("y IS NULL").count() == 0


@pytest.mark.parametrize("size", [8, 4_000])
def test_order_statistics_by_narrowing(spark, monkeypatch, size):
    monkeypatch.setattr(stats, "PERCENTILE_ROWS", 10)
    monkeypatch.setattr(stats, "BRACKET_ROWS", 10)
    monkeypatch.setattr(stats, "SKETCH_SIZE", size)
    rng = np.random.default_rng(1)
    columns = [rng.normal(0, 1, 400), rng.integers(0, 3, 400), _gaps(rng.exponential(5, 400), 4), np.full(400, 7.0)]
    columns.append(np.where(rng.random(400) < 0.4, 2.0, rng.normal(0, 9, 400)))  # one hot value
    df = _frame(spark, columns, list("abcde"))
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = stats.quantiles(df, list("abcde"), probs)
    for name, values in zip("abcde", columns):
        assert np.allclose(got[name], np.nanquantile(values, probs)), name


def test_recipe_of_imputers_survives_json(spark, cloud):
    recipe = Recipe.of(
        {"action": "fill_null", "column": "a", "value": "mean"},
        {"action": "fill_null", "column": "b", "value": "median"},
        {"action": "fill_null", "column": "y", "value": "knn"},
    )
    df = _frame(spark, cloud, ["y", "a", "b"])
    once, _ = apply_recipe(df, recipe)
    again, _ = apply_recipe(df.repartition(1), Recipe.from_json(recipe.to_json()))
    rounded = [F.round(c, 9).alias(c) for c in ("y", "a", "b")]
    assert sorted(once.select("_row_id", *rounded).collect()) == sorted(again.select("_row_id", *rounded).collect())


def test_predictors_can_be_named(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 18))
    rows = [(i, None if i % 7 == 0 else float(x[i, :17].sum()), *map(float, x[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "_row_id bigint, t double, " + ", ".join(f"c{i} double" for i in range(18)))
    for how in ("knn", "iterative"):
        step = {"action": "fill_null", "column": "t", "value": how}
        out, messages = apply_recipe(df, [step])
        assert messages == [] and out.filter("t IS NULL").count() == 0
        out, messages = apply_recipe(df, [step | {"predictors": [f"c{i}" for i in range(17)]}])
        assert messages == [] and out.filter("t IS NULL").count() == 0
        if how == "iterative":
            filled = {r["_row_id"]: r["t"] for r in out.collect()}
            assert all(abs(filled[i] - x[i, :17].sum()) < 1e-6 for i in range(0, 60, 7))
        _, messages = apply_recipe(df, [step | {"predictors": ["nowhere"]}])
        assert "nowhere" in messages[0]
