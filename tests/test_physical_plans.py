"""What the plans must and must not contain."""

from rinseframe import Recipe, apply_recipe, audit_trail, validate, violation_details
from rinseframe.operators import profile
from suite.checks import BOOK
from suite.plans import RECIPE
from suite.views import dirty_events, dirty_parts, table
from tests.oracle import plan_text as plan

FOLDER = "/root/testdata/sf0.001"


def test_filters_and_columns_reach_the_scan(spark):
    raw = table(spark, FOLDER, "events")
    steps = [
        {"action": "drop_nulls", "column": "value"},
        {"action": "drop_violated", "rule": {"type": "Relational Check", "col_a": "user_id", "op": ">=", "value": 3}},
        {"action": "drop_column", "column": "props"},
        {"action": "normalize_text", "column": "event_type"},
    ]
    text = plan(apply_recipe(raw, steps)[0].select("value", "event_type"))
    assert "IsNotNull(value)" in text and "user_id" in text.split("PushedFilters")[1].splitlines()[0]
    read = text.split("ReadSchema: ")[1].splitlines()[0]
    assert "props" not in read and "ts" not in read.replace("struct", "")
    assert "Exchange" not in text


def test_all_rules_share_one_scan(spark):
    text = plan(validate(dirty_events(spark, FOLDER), BOOK))
    assert text.count("Scan parquet") == 2  # once in the tree, once in the details
    assert "Join" not in text


def test_audit_trail_reads_once_per_regrouping(spark):
    rowwise = [s for s in RECIPE.steps if s.action not in ("fill_null", "drop_empty_columns")]
    one = plan(audit_trail(dirty_events(spark, FOLDER), Recipe(tuple(rowwise))))
    assert one.count("Scan parquet") == 2
    two = plan(audit_trail(dirty_events(spark, FOLDER), Recipe(tuple(rowwise)).then({"action": "drop_duplicates"})))
    assert two.count("Scan parquet") == 4


def test_ranked_outputs_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(violation_details(dirty_events(spark, FOLDER), BOOK))
    assert "WindowGroupLimit" in plan(profile.top_values(dirty_parts(spark, FOLDER), ["p_name", "p_brand"]))


def test_counts_are_combined_before_the_shuffle(spark):
    text = plan(profile.top_values(dirty_parts(spark, FOLDER), ["p_name"]))
    assert "partial_count" in text
