import math

import numpy as np
import pytest

from rinseframe import accept, audit_trail, cleaning_impact, find_problems, scout
from rinseframe.model import DropColumn, FillNull, Recipe
from rinseframe.operators import insight, profile
from rinseframe.operators.rows import duplicate_rows
from rinseframe.operators.scout import dismiss, quick_actions
from rinseframe.plans import skew
from rinseframe.sources import tables


@pytest.fixture
def crates(spark):
    """24 crates, one fault to a column."""
    ports = ["oslo ", "  rio", "lima", "  cairo  ", "perth", "baku"]
    rows = [
        (
            i,
            0.5 if i == 11 else None,
            2.0 * (i % 6) if i % 6 else None,
            7,
            2400.0 if i % 12 == 3 else 50 + i * 5 % 12 / 4,
            300.0 if i % 12 == 5 else 2 + i % 4 / 10,
            "n.a." if i % 8 == 7 else f"{i % 4}.25",
            ports[i % 6],
            f"crate-{i:03d}",
            i % 3 == 0,
        )
        for i in range(24)
    ]
    return spark.createDataFrame(
        rows,
        "_row_id bigint, lost double, gap double, lane int, mass double, wait double, code string, port string, "
        "tag string, sealed boolean",
    ).repartition(4)


def test_every_detector(crates):
    found = {}
    for p in find_problems(crates):
        found.setdefault(p.type, []).append(p.column)
    assert found == {
        "Redundant Column": ["lost"],
        "Null Check": ["gap"],
        "Constant Value": ["lost", "lane"],
        "Range Check": ["mass", "wait"],
        "Distribution Warning": ["mass", "wait"],
        "Type Cast": ["code"],
        "Formatting Issue": ["port"],
        "High Cardinality": ["tag"],
    }
    assert {p.column for p in find_problems(crates, skip={"lost", "lane"})}.isdisjoint(
        {"lost", "lane"}
    )
    assert find_problems(crates.limit(0)) == []
    table = scout(crates).orderBy("position").collect()
    assert [r["position"] for r in table] == list(range(len(table)))


def test_accept_and_dismiss(crates):
    found = find_problems(crates)
    recipe, book, columns = accept(found)
    assert DropColumn("lost") in recipe.steps and len(book) == 6
    assert columns == {p.column for p in found}
    rest, column = dismiss(found, 0)
    assert column == "lost" and len(rest) == len(found) - 1


def test_quick_actions(spark):
    df = spark.createDataFrame(
        [(0, 1, " a", None), (1, 1, " a", None), (2, None, None, None)], "_row_id bigint, n int, t string, e int"
    ).withColumnRenamed("t", "the text")
    assert quick_actions(df) == {
        "duplicate_rows": 1, "empty_columns": 1, "empty_rows": 1, "padded_columns": ["the text"],
        "names_to_normalize": ["the text"],
    }


def test_duplicate_rows_with_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_SHARE", 4)  # groups over a quarter of the rows go the other way
    rows = [(i, None if i < 40 else i % 7, "x") for i in range(100)] + [(100, 99, "single")]
    df = spark.createDataFrame(rows, "_row_id bigint, a int, b string").repartition(3)
    assert sorted(r["_row_id"] for r in duplicate_rows(df).collect()) == list(range(100))


@pytest.mark.parametrize("cells, health", [([1, 2, 3], 100), ([None, None, None], 0), ([1, None, 2, None], 50), ([], 0)])
def test_health(spark, cells, health):
    df = spark.createDataFrame([(c,) for c in cells], "a int")
    assert profile.health(df).first()[0] == health


def test_overview_and_summary(crates):
    row = profile.overview(crates, [{"type": "Null Check", "col": "gap", "desc": "x"}]).first()
    assert (row["rows"], row["columns"], row["duplicates"], row["violations"]) == (24, 9, 0, 4)
    summary = {r["column"]: r for r in profile.column_summary(crates).collect()}
    assert summary["gap"]["nulls"] == 4 and summary["gap"]["mean"] == 6.0
    assert summary["code"]["mode"] == "0.25" and summary["code"]["mean"] is None
    assert summary["sealed"]["mode"] == "false" and summary["sealed"]["unique"] == 2
    assert profile.type_composition(crates) == {"double": 4, "int": 1, "string": 3, "boolean": 1}
    described = {r["column"]: r for r in profile.describe(crates).collect()}
    assert described["port"]["unique"] == 6 and described["port"]["freq"] == 4
    assert described["gap"]["median"] == 6.0 and described["lane"]["std"] == 0.0


def test_top_values(spark):
    """Value k of a to r occurs 1 + k // 6 times: nine stand for themselves, the rest together."""
    letters = "abcdefghijklmnopqr"
    df = spark.createDataFrame([(c,) for k, c in enumerate(letters) for _ in range(1 + k // 6)], "a string")
    found = {r["value"]: r["n"] for r in profile.top_values(df, ["a"]).collect()}
    assert found == {c: 3 for c in "mnopqr"} | {c: 2 for c in "ghi"} | {"Other": 12}
    few = df.filter("a > 'h'")
    assert {r["value"] for r in profile.top_values(few, ["a"]).collect()} == set("ijklmnopqr")


def test_correlation(spark):
    df = spark.createDataFrame(
        [(1, 2, 5, 7), (2, 4, 1, 7), (3, 6, 9, 7), (4, 8, 2, 7), (5, 10, 8, 7)], "A int, B int, C int, K int"
    )
    pairs = insight.correlation_pairs(df)
    assert pairs["A", "B"] == pytest.approx(1.0) and pairs["A", "K"] is None and pairs["K", "K"] is None
    kept = {r["a"] for r in insight.correlation_range(df, 0.9, 1.0).collect()}
    assert kept == {"A", "B"}
    assert insight.correlation_range(df, 0.99, 1.0, ["A", "C"]).count() == 0


def test_correlation_of_odd_columns(spark):
    """Missing, NaN and infinite values are left out of a pair; a column without spread correlates with nothing."""
    from rinseframe.frames import col
    from rinseframe.operators.stats import correlation_of

    rng = np.random.default_rng(2)
    columns = [rng.normal(1000 * i, i + 1, 300) for i in range(8)]
    columns[2] = columns[1] * 3 + rng.normal(0, 2, 300)
    columns[4] = np.full(300, 5.5)
    table = np.column_stack(columns)
    table[rng.random(table.shape) < 0.2] = np.nan
    table[:, 5] = np.where(np.isnan(table[:, 0]), table[:, 5], np.where(np.isnan(table[:, 5]), np.nan, 3.0))
    rows = [[None if math.isnan(v) else float(v) for v in r] for r in table]
    for at, odd in ((3, math.inf), (40, -math.inf), (77, math.nan)):
        rows[at][6] = rows[at][7] = odd
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"c{i} double" for i in range(8))).repartition(4)
    found = insight.correlation_pairs(df)
    plain = np.array([[math.nan if v is None or not math.isfinite(v) else v for v in r] for r in rows])
    single = df.agg(*[correlation_of(col(f"c{i}"), col(f"c{j}")).alias(f"r{i}_{j}") for i in range(8) for j in range(i)]).first()
    for i in range(8):
        for j in range(i):
            x, y = plain[~np.isnan(plain[:, [i, j]]).any(axis=1)][:, [i, j]].T
            flat = np.ptp(x) == 0 or np.ptp(y) == 0
            for r in (found[f"c{i}", f"c{j}"], single[f"r{i}_{j}"]):
                assert r is None if flat else r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9), (i, j)
    assert found["c0", "c5"] is None and found["c4", "c1"] is None and found["c6", "c6"] == 1.0
    alone = spark.createDataFrame([(1.0, 2.0), (2.0, math.inf)], "a double, b double")
    assert insight.correlation_pairs(alone)["a", "b"] is None and insight.correlation_pairs(alone, ["a"])["a", "a"] == 1.0


def test_missingness_and_zscores(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, None, 2.0), (2, 3.0, 2.0)], "_row_id bigint, a double, b double")
    flags, cut = insight.missingness_map(df)
    assert [(r["a"], r["b"]) for r in flags.collect()] == [(0, 1), (1, 0), (0, 0)] and not cut
    assert insight.missingness_map(df.select("_row_id", "_row_id", df["a"].isNotNull().alias("x")).select("x")) == (None, False)
    z = {r["_row_id"]: (r["a"], r["b"]) for r in insight.zscores(df).collect()}
    assert z[0][0] == pytest.approx(-math.sqrt(0.5)) and z[1] == (None, 0.0)
    assert insight.zscores_long(df).count() == 6


def test_samples(spark):
    df = spark.range(2000).selectExpr("id AS _row_id", "id AS v")
    one = [r["_row_id"] for r in tables.sample_rows(df, 50).collect()]
    two = [r["_row_id"] for r in tables.sample_rows(df.repartition(9), 50).collect()]
    assert one == two and len(set(one)) == 50
    sample, cut = tables.downsample(df)
    ids = [r["_row_id"] for r in sample.collect()]
    assert cut and ids == sorted(ids) and len(ids) == 1000
    assert not tables.downsample(df.limit(5))[1]
    assert [r["v"] for r in tables.preview(df, "last", 3).collect()] == [1997, 1998, 1999]
    assert tables.preview(df, "all").count() == 2000
    assert tables.working_sample(df, 3).collect() == tables.sample_rows(df, 3).collect()


def test_audit_trail_and_impact(spark):
    rows = [(0, "a", 1.0), (1, "a", 1.0), (2, None, None), (3, "b", None), (4, "c", 2.0)]
    df = spark.createDataFrame(rows, "_row_id bigint, t string, v double").repartition(2)
    recipe = Recipe.of(
        {"action": "drop_empty_rows"},
        {"action": "drop_duplicates"},
        FillNull("v", "mean"),
        {"action": "nonsense"},
        {"action": "drop_nulls", "column": "t"},
        {"action": "drop_violated", "rule": {"type": "Range Check", "col": "v", "min": 0, "max": 1.5, "desc": "small"}},
    )
    trail = [tuple(r) for r in audit_trail(df, recipe).orderBy("step").select("step", "health", "rows", "removed").collect()]
    assert trail == [
        (0, 70, 5, 0), (1, 87, 4, 1), (2, 83, 3, 1), (3, 100, 3, 0), (4, 100, 3, 0), (5, 100, 3, 0), (6, 100, 2, 1),
    ]
    impact = {r["metric"]: (r["before"], r["after"], r["change"]) for r in cleaning_impact(df, df.dropna()).collect()}
    assert impact["rows"] == (5.0, 3.0, -2.0) and impact["null_percent"] == (30.0, 0.0, -30.0)


def test_csv(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as f:
        f.write('Id,Age,Sex,Alley,Flag,Note\n1,22,male,,True,"a ""b"", c"\n2,38,NA,Pave,False,\n3,,female,,True, x \n')
    df = tables.read_csv(spark, path)
    assert dict(df.dtypes) == {"Id": "bigint", "Age": "bigint", "Sex": "string", "Alley": "string", "Flag": "boolean", "Note": "string"}
    assert [tuple(r) for r in df.orderBy("Id").collect()] == [
        (1, 22, "male", None, True, 'a "b", c'), (2, 38, None, "Pave", False, None), (3, None, "female", None, True, " x "),
    ]
    out = str(tmp_path / "out")
    tables.write_csv(tables.with_row_id(df), out)
    again = tables.read_csv(spark, out)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect())) and again.columns == df.columns
    assert tables.read_csv(spark, path, nrows=2).count() == 2
    assert tables.read_csv(spark, path, schema="Id int, Age double, Sex string, Alley string, Flag string, Note string").count() == 3
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "absent.csv"))


def test_downcast_and_nan(spark):
    df = spark.createDataFrame([(100, 70000, 1.5), (-3, 5, float("nan"))], "a bigint, b bigint, c double")
    assert dict(tables.downcast_types(df).dtypes) == {"a": "tinyint", "b": "int", "c": "float"}
    from rinseframe import nan_to_null

    assert [r["c"] for r in nan_to_null(df).collect()] == [1.5, None]
    assert np.isnan(df.collect()[1]["c"])
