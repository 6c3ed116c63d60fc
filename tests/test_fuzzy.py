import random

import pytest

from rinseframe import apply_recipe
from rinseframe.functions.similarity import common_length, comparable, partial_ratio, ratio, weighted_ratio
from rinseframe.operators import fuzzy
from rinseframe.operators.fuzzy import Spellings, merge_table


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("a, b", [("abcde", "ace"), ("kitten", "sitting"), ("", "x"), ("aaaa", "aa"), ("xyz", "abc")])
def test_common_length(a, b):
    assert common_length(a, b) == _lcs(a, b) == common_length(b, a)


@pytest.mark.parametrize(
    "a, b, score",
    [
        ("new york jets", "new york jets", 100.0),
        ("new york jets", "new york giants", 78.571),
        ("cowboys", "dallas cowboys", 90.0),
        ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 95.0),
        ("small ring", "small rings", 95.238),
        ("", "x", 0.0),
    ],
)
def test_published_scores(a, b, score):
    assert weighted_ratio(a, b) == pytest.approx(score, abs=0.01)


def test_parts():
    assert ratio("this is a test", "this is a test!") == pytest.approx(96.55, abs=0.01)
    assert partial_ratio("this is a test", "this is a test!") == 100.0
    assert comparable("  Héllo, W_orld! ") == "héllo  w_orld"


def plain_merge(order, threshold=85):
    """Value -> canonical value, by scoring every leader with every value in turn."""
    into = {}
    for v in order:
        if v not in into:
            into |= {o: v for o in order if round(weighted_ratio(comparable(v), comparable(o))) > threshold}
            into.setdefault(v, v)
    return {v: c for v, c in into.items() if v != c}


def _names(n, seed):
    rng = random.Random(seed)
    words = ["north", "harbor", "mill", "stone", "bridge", "old", "quay", "river", "tower", "grove"]
    out = []
    for _ in range(n):
        name = list(" ".join(rng.choices(words, k=rng.randrange(1, 4))) + rng.choice(["", "", " 12", " of the north east quay side"]))
        for _ in range(rng.randrange(3)):
            name[rng.randrange(len(name))] = rng.choice("abcxyz -")
        out.append("".join(name))
    return [*out, "", "--", "é", "E"]


@pytest.mark.parametrize("threshold", [55, 85, 92])
def test_no_match_is_lost_by_counting_characters(threshold):
    names = list(dict.fromkeys(_names(250, 3)))
    block = Spellings(names, threshold)
    for v in names[::3]:
        assert block.matches(v) == [i for i, o in enumerate(names) if round(weighted_ratio(comparable(v), comparable(o))) > threshold]


@pytest.mark.parametrize("alone, block, threshold", [(4096, 2048, 90), (40, 25, 90), (0, 60, 80), (3, 7, 95)])
def test_leaders_in_blocks(spark, monkeypatch, alone, block, threshold):
    """One task, and rounds of pairs of blocks, down to blocks of a few values and no task that settles a rest."""
    monkeypatch.setattr(fuzzy, "ALONE", alone)
    monkeypatch.setattr(fuzzy, "BLOCK", block)
    names = _names(100, 5)
    df = spark.createDataFrame(list(enumerate(names)), "_row_id bigint, a string").repartition(4)
    found = {r["v"]: r["lead"] for r in merge_table(df, "a", threshold).collect()}
    assert found == plain_merge(list(dict.fromkeys(names)), threshold) and len(found) > 2


def test_chains_take_rounds(spark, monkeypatch):
    """Each value matches its neighbours only: every second one leads, and that is known round by round."""
    monkeypatch.setattr(fuzzy, "ALONE", 2)
    monkeypatch.setattr(fuzzy, "BLOCK", 4)
    chain = ["".join("b" if j < i else "a" for j in range(9)) for i in range(10)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(chain)], "_row_id bigint, a string")
    found = {r["v"]: r["lead"] for r in merge_table(df, "a", 85).collect()}
    assert found == plain_merge(chain, 85) and found


def test_unlike_values_take_one_round(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "ALONE", 100)
    monkeypatch.setattr(fuzzy, "BLOCK", 300)
    rounds = []
    matched = fuzzy._matched
    monkeypatch.setattr(fuzzy, "_matched", lambda *a, **b: rounds.append(1) or matched(*a, **b))
    rng = random.Random(2)
    unlike = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=12)) for _ in range(1000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*unlike, "one thing more", "one thing more!"])], "_row_id bigint, a string")
    found = {r["v"]: r["lead"] for r in merge_table(df, "a", 85).collect()}
    assert found == {"one thing more!": "one thing more"} and len(rounds) == 3


def test_empty_and_missing_only(spark):
    for rows in ([], [(1, None)], [(1, ""), (2, "--")]):
        assert merge_table(spark.createDataFrame(rows, "_row_id bigint, a string"), "a", 85).count() == 0


def test_merging_a_column(spark):
    rows = ["New York", "new york!", "London", None, "Londonn", "Paris", "New York", "new yorkk"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "_row_id bigint, city string").repartition(3)
    step = {"action": "normalize_text", "column": "city", "value": "fuzzy_dedupe"}
    out, messages = apply_recipe(df, [step])
    got = [r["city"] for r in out.orderBy("_row_id").collect()]
    assert messages == []
    assert got == ["New York", "New York", "London", None, "London", "Paris", "New York", "New York"]
    everywhere, _ = apply_recipe(df, [step | {"column": "All"}])
    assert [r["city"] for r in everywhere.orderBy("_row_id").collect()] == got


def test_any_number_of_values_and_of_spellings(spark):
    """1500 values and a leader with thirty spellings, on a table without row ids (alphabetical order)."""
    spellings = ["observatory" + c for c in "abcdefghijklmnopqrstuvwxyzABCD"]
    others = [f"{i:04d}" * 3 for i in range(1500)]
    df = spark.createDataFrame([(v,) for v in spellings + others], "a string")
    out, messages = apply_recipe(df, [{"action": "normalize_text", "column": "a", "value": "fuzzy_dedupe", "threshold": 90}])
    assert messages == []
    got = sorted(r["a"] for r in out.collect())
    into = plain_merge(sorted(spellings), 90)
    assert [v for v in got if v.startswith("obs")] == sorted(into.get(v, v) for v in spellings) == ["observatoryA"] * 30


def test_query_against_brute_force(spark):
    """The registered queries at the smallest scale, merged value by value in plain Python."""
    import suite
    from suite.views import dirty_parts

    folder = "/root/testdata/sf0.001"
    names = [r["p_name"] for r in dirty_parts(spark, folder, "p_name").orderBy("_row_id").collect()]
    into = plain_merge(list(dict.fromkeys(names)))
    rows = suite.QUERIES["fuzzy_merge"](spark, folder).orderBy("p_partkey").collect()
    assert [r["p_name"] for r in rows] == [into.get(n, n) for n in names]
    assert len(set(into.values())) < len(set(names))
