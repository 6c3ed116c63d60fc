"""Every cleaning step on small tables, with its messages."""

import datetime

import pytest
from pyspark.sql import Row

from rinseframe import ALL_TEXT, Context, Recipe, Rulebook, apply_prefix, apply_recipe, with_row_id
from rinseframe.frames import col, data_columns
from rinseframe.model import CastType, NormalizeText, Replace, StripWhitespace


def table(spark, schema, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_row_id bigint, {schema}")
    return df.repartition(3)


def run(df, *steps):
    out, messages = apply_recipe(df, steps)
    rows = out.orderBy("_row_id").select(*map(col, data_columns(out))).collect()
    return [tuple(r) for r in rows], messages


def column(df, *steps, name="a"):
    out, messages = apply_recipe(df, steps)
    return [r[0] for r in out.orderBy("_row_id").select(col(name)).collect()], messages


# ------------------------------------------------------------------ messages


@pytest.mark.parametrize(
    "step, words",
    [
        ({"action": "polish"}, "Unknown action"),
        ({"action": "drop_column", "column": "absent"}, "not found"),
        ({"action": "drop_nulls", "column": "absent"}, "not found"),
        ({"action": "fill_null", "column": "absent", "value": "mean"}, "not found"),
        ({"action": "cap_range", "column": "absent", "min": 0, "max": 1}, "not found"),
        ({"action": "cast_type", "column": "absent", "dtype": "int64"}, "not found"),
        ({"action": "rename_column", "column": "absent", "value": "n"}, "not found"),
        ({"action": "replace", "column": "absent", "find": "a", "replace": "b"}, "not found"),
        ({"action": "strip_whitespace", "column": "absent"}, "not found"),
        ({"action": "normalize_text", "column": "absent"}, "not found"),
        ({"action": "log_transform", "column": "absent"}, "not found"),
        ({"action": "extract_datetime", "column": "absent", "component": "year", "new_column": "y"}, "not found"),
        ({"action": "reorder_columns", "value": "x, y"}, "requires a list of column names"),
        ({"action": "log_transform", "column": "B"}, "requires a numeric column"),
        ({"action": "cap_range", "column": "B", "min": 0, "max": 1}, "requires a numeric column"),
        ({"action": "cap_range", "column": "A"}, "incomplete"),
        ({"action": "fill_null", "column": "B", "value": "mean"}, "requires a numeric column"),
        ({"action": "fill_null", "column": "A"}, "no fill value"),
        ({"action": "cast_type", "column": "A", "dtype": "quaternion"}, "Error"),
        ({"action": "drop_violated", "rule": {"type": "Range Check", "desc": "no bounds"}}, "Error"),
        ({"action": "drop_violated", "rule": {"type": "Null Check", "col": "absent"}}, "Error"),
        ({"action": "extract_datetime", "column": "B", "component": "year"}, "Error"),
        ({"action": "extract_datetime", "column": "B", "component": "millisecond", "new_column": "m"}, "Error"),
        ({"action": "rename_column", "column": "A", "value": " "}, "Error"),
        ({"action": "rename_column", "column": "A", "value": "B"}, "already exists"),
        ({"action": "normalize_text", "column": "B", "value": "rot13"}, "unknown text method"),
        ({"action": "drop_empty_columns"}, "Every column has values"),
        ({"action": "replace", "column": "B", "find": "(", "replace": "x", "regex": True}, "skipped"),
        ({"action": "replace", "column": "B", "find": "a(p)", "replace": r"\2", "regex": True}, "invalid group"),
    ],
)
def test_a_step_that_cannot_be_applied_says_so_and_changes_nothing(spark, step, words):
    df = table(spark, "A double, B string", (0.75, "tin"), (-3.0, "zinc"), (None, "lead"))
    before, _ = run(df)
    after, messages = run(df, step, {"action": "drop_violated", "rule": {"type": "Informational", "desc": "x"}})
    assert after == before
    assert len(messages) == 1 and words in messages[0]


# ------------------------------------------------------------------ columns


def test_columns(spark):
    df = table(spark, "A bigint, B bigint, C bigint", (1, 2, 3))
    assert run(df, {"action": "rename_column", "column": "A", "value": "Z"})[0] == [(1, 2, 3)]
    out, _ = apply_recipe(df, [{"action": "reorder_columns", "value": ["C", "nope", "A"]}])
    assert data_columns(out) == ["C", "A", "B"] and "_row_id" in out.columns
    out, _ = apply_recipe(df, [{"action": "drop_column", "column": "B"}])
    assert data_columns(out) == ["A", "C"]


@pytest.mark.parametrize(
    "style, expected",
    [
        ("snake_case", ["id_field", "name_full", "column_"]),
        ("lowercase", ["id-field", " name  (full)", "column_"]),
        ("uppercase", ["ID-FIELD", " NAME  (FULL)", "column_"]),
        ("remove_spaces", ["Id-Field", "Name(Full)", "column_"]),
        ("unknown", ["Id-Field", " Name  (Full)", ""]),
    ],
)
def test_column_names(spark, style, expected):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("Id-Field", " Name  (Full)", "")
    out, _ = apply_recipe(df, [{"action": "normalize_column_names", "value": style}])
    assert out.columns == expected


def test_column_names_that_would_meet_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int").toDF("a b", "a-b")
    out, messages = apply_recipe(df, [{"action": "normalize_column_names"}])
    assert out.columns == ["a b", "a-b"] and "both be named 'a_b'" in messages[0]


def test_names_with_any_character(spark):
    df = table(spark, "a string", (" x ",)).withColumnRenamed("a", "we.ird `name`")
    rows, messages = run(df, StripWhitespace("we.ird `name`"), {"action": "drop_nulls", "column": "we.ird `name`"})
    assert rows == [("x",)] and messages == []


def test_shape_steps_together(spark):
    df = spark.createDataFrame(
        [(0, 1.0, "a", None), (1, 1.0, "a", None), (2, None, None, None), (3, 2.0, "b", None), (4, None, "c", None)],
        "_row_id bigint, i double, n string, e double",
    ).toDF("_row_id", "Id-Field", "Name Field", "Empty Col")
    rows, messages = run(
        df,
        {"action": "drop_duplicates"},
        {"action": "drop_empty_rows"},
        {"action": "drop_empty_columns"},
        {"action": "normalize_column_names", "value": "snake_case"},
    )
    assert rows == [(1.0, "a"), (2.0, "b"), (None, "c")]
    assert messages == ["Columns without any value were removed: Empty Col."]


def test_duplicates_without_row_id(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    out, _ = apply_recipe(df, [{"action": "drop_duplicates"}])
    assert sorted(out.collect(), key=lambda r: r.a) == [Row(a=1, b=None), Row(a=2, b="x")]


# ------------------------------------------------------------------ values


def test_cast_to_double(spark):
    texts = ["1.5", " 2 ", "1e3", ".5", "5.", "inf", "nan", "1.0d", "1_000", "", "two", None, "-7", "0x1F"]
    df = table(spark, "a string", *[(t,) for t in texts])
    got, _ = column(df, {"action": "cast_type", "column": "a", "dtype": "float64"})
    assert got == [1.5, 2.0, 1000.0, 0.5, 5.0, float("inf"), None, None, None, None, None, None, -7.0, None]


def test_cast_to_int(spark):
    big = 2**60 + 1
    df = table(spark, "a string", ("1",), ("two",), ("3.0",), (None,), (str(big),))
    got, _ = column(df, {"action": "cast_type", "column": "a", "dtype": "int64"})
    assert got == [1, None, 3, None, big]
    df = table(spark, "a double", (1.0,), (2.5,))
    got, messages = column(df, {"action": "cast_type", "column": "a", "dtype": "int"})
    assert got == [1.0, 2.5] and "not whole" in messages[0]
    got, messages = column(df, CastType("a", "int64", strict=False))
    assert got == [1, None] and messages == []


def test_cast_to_time_text_and_others(spark):
    df = table(spark, "a string", ("2024-01-02 03:04:05",), ("invalid_date",), ("2024-02-29",))
    got, _ = column(df, {"action": "cast_type", "column": "a", "dtype": "datetime64[ns]"})
    assert got == [datetime.datetime(2024, 1, 2, 3, 4, 5), None, datetime.datetime(2024, 2, 29)]
    df = table(spark, "a string", ("02/01/2024",))
    got, _ = column(df, CastType("a", "datetime64[ns]", format="dd/MM/yyyy"))
    assert got == [datetime.datetime(2024, 1, 2)]
    df = table(spark, "a bigint", (1,), (None,))
    assert column(df, {"action": "cast_type", "column": "a", "dtype": "string"})[0] == ["1", None]
    assert column(df, {"action": "cast_type", "column": "a", "dtype": "object"})[0] == [1, None]
    out, _ = apply_recipe(df, [{"action": "cast_type", "column": "a", "dtype": "int16"}])
    assert out.schema["a"].dataType.simpleString() == "smallint"


def test_replace(spark):
    df = table(spark, "a string, n bigint", ("alder", 5), ("papaya", 6), ("almond", 5), (None, None))
    step = {"action": "replace", "column": "a", "find": "^al.*", "replace": "tree", "regex": True}
    assert column(df, step)[0] == ["tree", "papaya", "tree", None]
    assert column(df, Replace("a", "al", "X"))[0] == ["alder", "papaya", "almond", None]
    assert column(df, Replace(ALL_TEXT, "alder", "$1"))[0] == ["$1", "papaya", "almond", None]
    assert column(df, Replace("a", r"(?P<x>pa)(?P=x)", r"[\g<x>$]", regex=True))[0][1] == "[pa$]ya"
    assert column(df, Replace("a", r"(a)(l)", r"\2\1", regex=True))[0][0] == "lader"
    assert column(df, Replace("n", "5", "9"), name="n")[0] == [5, 6, 5, None]
    assert column(df, Replace("n", 5, 9), name="n")[0] == [9, 6, 9, None]


def test_strip(spark):
    df = table(spark, "a string, b string, n bigint", ("  x y\t", " q\n", 1), (None, "\x1cz ", 2))
    assert run(df, {"action": "strip_whitespace", "column": "All"})[0] == [("x y", "q", 1), (None, "z", 2)]
    assert run(df, StripWhitespace("n"))[0] == run(df)[0]


@pytest.mark.parametrize(
    "method, expected",
    [
        ("lowercase", "it's a-b 3rd ÉCOLE".lower()),
        ("uppercase", "it's a-b 3rd ÉCOLE".upper()),
        ("titlecase", "it's a-b 3rd ÉCOLE".title()),
        ("remove_punctuation", "its ab 3rd ÉCOLE"),
    ],
)
def test_text_methods(spark, method, expected):
    df = table(spark, "a string", ("it's a-b 3rd ÉCOLE",), ("",), (None,))
    assert column(df, NormalizeText("a", method))[0] == [expected, "", None]


def test_punctuation_keeps_the_backslash(spark):
    df = table(spark, "a string", ("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~x",))
    assert column(df, NormalizeText("a", "remove_punctuation"))[0] == ["\\x"]


def test_cap_and_log(spark):
    df = table(spark, "a bigint", (1,), (50,), (None,), (200,))
    got, _ = column(df, {"action": "cap_range", "column": "a", "min": 10, "max": 99.5})
    assert got == [10.0, 50.0, None, 99.5]
    got, _ = column(df, {"action": "cap_range", "column": "a", "min": 10, "max": 99})
    assert got == [10, 50, None, 99]
    df = table(spark, "a double", (0.0,), (-3.0,), (None,), (1.718281828459045,))
    got, _ = column(df, {"action": "log_transform", "column": "a"})
    assert got[:3] == [0.0, 0.0, None] and abs(got[3] - 1) < 1e-12


def test_date_parts(spark):
    df = table(spark, "a string", ("2024-02-29 13:00:00",), ("bad",))
    for component, expected in (("year", 2024), ("month", 2), ("day", 29), ("hour", 13), ("day_of_week", "Thursday")):
        step = {"action": "extract_datetime", "column": "a", "component": component, "new_column": "p"}
        assert column(df, step, name="p")[0] == [expected, None]


def test_fill(spark):
    df = table(spark, "debt double, void double, term bigint, grade string",
               (8.0, None, 12, "C"), (None, None, 24, "B"), (3.5, None, None, None), (8.0, None, 60, "C"), (0.5, None, 36, "B"), (30.0, None, 48, None))
    fill = lambda c, v: column(df, {"action": "fill_null", "column": c, "value": v}, name=c)
    assert fill("debt", "mean")[0][1] == 10.0
    assert fill("debt", "median")[0][1] == 8.0
    assert fill("debt", "mode")[0][1] == 8.0
    assert [fill("grade", "mode")[0][i] for i in (2, 5)] == ["B", "B"]  # a tie: the smaller value
    assert fill("term", "mean")[0][2] == 36.0
    assert fill("debt", "unpaid")[0] == ["8.0", "unpaid", "3.5", "8.0", "0.5", "30.0"]
    assert fill("term", 18)[0] == [12, 24, 18, 60, 36, 48]
    values, messages = fill("void", "mode")
    assert values == [None] * 6 and "no values" in messages[0]


# ------------------------------------------------------------------ recipes


RECIPE = Recipe.of(
    {"action": "strip_whitespace", "column": "name"},
    {"action": "normalize_text", "column": "name", "value": "uppercase"},
    {"action": "fill_null", "column": "age", "value": "mean"},
    {"action": "cap_range", "column": "age", "min": 0, "max": 100},
    {"action": "drop_violated", "rule": {"type": "Range Check", "col": "id", "min": 2, "max": 9, "desc": "id"}},
    {"action": "rename_column", "column": "age", "value": "years"},
    {"action": "cast_type", "column": "hired", "dtype": "datetime64[ns]"},
    {"action": "drop_nulls", "column": "hired"},
    {"action": "extract_datetime", "column": "hired", "component": "year", "new_column": "since"},
    {"action": "replace", "column": "All", "find": "BOB", "replace": "ROB", "regex": False},
    {"action": "reorder_columns", "value": ["name", "id"]},
    {"action": "fill_null", "column": "city", "value": "mean", "strategy": "constant"},
)


@pytest.fixture
def people(spark):
    return table(
        spark, "id bigint, name string, age double, hired string, city string",
        (1, "  Ann ", 20.0, "2020-01-01", "A"), (2, "Bob", 150.0, "2021-05-06", None), (3, " Cid", None, "x", "B"),
        (4, "dee", 30.0, "2019-12-31", "C"),
    )


def test_recipe(people):
    rows, messages = run(people, *RECIPE.steps)
    assert messages == []
    assert rows == [
        ("ROB", 2, 100.0, datetime.datetime(2021, 5, 6), "mean", 2021),
        ("DEE", 4, 30.0, datetime.datetime(2019, 12, 31), "C", 2019),
    ]


def test_recipe_does_not_depend_on_partitions_or_json(people):
    expected = run(people, *RECIPE.steps)
    assert run(people.repartition(1), *RECIPE.steps) == expected
    assert run(people.repartition(7), *Recipe.from_json(RECIPE.to_json()).steps) == expected
    assert Recipe.from_json(RECIPE.to_json()) == RECIPE


def test_every_prefix_equals_the_shorter_recipe(people):
    for n in range(len(RECIPE) + 1):
        short, _ = run(people, *RECIPE.steps[:n])
        out = apply_prefix(people, RECIPE, n)
        got = [tuple(r) for r in out.orderBy("_row_id").select(*data_columns(out)).collect()]
        assert got == short
    assert RECIPE.undo() == RECIPE.prefix(len(RECIPE) - 1)
    assert RECIPE.without(0).steps == RECIPE.steps[1:]


def test_drop_column_warns_about_rules(people):
    book = Rulebook.of(
        {"type": "Null Check", "col": "age", "desc": "age is there"},
        {"type": "Custom Expression", "query": "age > 3", "desc": "old enough"},
        {"type": "Custom Expression", "query": "name <> 'age'", "desc": "not about the column"},
    )
    _, messages = apply_recipe(people, [{"action": "drop_column", "column": "age"}], Context(rules=book.rules))
    assert messages == ["Warning: dropped column 'age' is used by age is there, old enough."]


def test_every_step_has_a_sentence():
    from rinseframe.plans.report import describe_step

    said = [describe_step(s) for s in RECIPE.steps]
    assert said[0] == "Outer white space removed in name"
    assert said[4] == "Removed rows that break the rule: id"
    assert said[5] == "Column age is now called years"
    assert describe_step(Recipe.of({"action": "magic", "column": "x"}).steps[0]) == "Step magic on x"


def test_row_ids(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id AS k")
    ids = with_row_id(df, contiguous=True).orderBy("_row_id").collect()
    assert [(r["k"], r["_row_id"]) for r in ids] == [(i, i) for i in range(1000)]
    plain = with_row_id(df).orderBy("_row_id").collect()
    assert [r["k"] for r in plain] == list(range(1000)) and len({r["_row_id"] for r in plain}) == 1000
    assert {r["_row_id"] for r in with_row_id(df, key="k").collect()} == set(range(1000))
