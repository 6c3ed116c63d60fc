"""Joins of a large table with a table of its own distinct keys, safe for hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rinseframe.frames import col

# A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are fewer than
# HOT_SHARE hot keys whatever the table holds: that bounds the broadcast side.
HOT_SHARE = 2_000


def _all_equal(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [left[_q(k)].eqNullSafe(right[_q(v)]) for k, v in keys.items()])


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def semi_join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], count_column: str, total: int) -> DataFrame:
    """Rows whose key occurs in ``groups``, a table with one row per key and its row count.

    Hot keys are matched through a broadcast of fewer than HOT_SHARE keys and never
    shuffled; the other rows are joined by key, at most total / HOT_SHARE rows each.
    """
    renamed = groups.select(*[col(k).alias(f"_rf_k{i}") for i, k in enumerate(keys)], F.col(count_column).alias("_rf_n"))
    names = {k: f"_rf_k{i}" for i, k in enumerate(keys)}
    limit = max(total // HOT_SHARE, 1)
    hot = F.broadcast(renamed.filter(F.col("_rf_n") > limit))
    cold = renamed.filter(F.col("_rf_n") <= limit)
    hot_rows = rows.join(hot, _all_equal(rows, hot, names), "left_semi")
    rest = rows.join(hot, _all_equal(rows, hot, names), "left_anti")
    return hot_rows.unionByName(rest.join(cold, _all_equal(rest, cold, names), "left_semi"))
