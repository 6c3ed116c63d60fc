"""Merging near-equal spellings of a text column.

Values are taken in the order of their first appearance (by row id; alphabetically on a table without one). A value
that no earlier leader has merged leads all values that score above the threshold; a later leader takes over what
an earlier one holds.

Few values are settled by one task. More are numbered in their order and compared in pairs of blocks, each pair a group of
its own. A value without any earlier undecided match is a leader, whatever the others turn out to be; what leaders match
is merged, and the rest, in practice few, takes another round. So a column of unlike values takes one round,
no value visits the driver, and a task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rinseframe.frames import col
from rinseframe.functions.similarity import (
    LONG_FROM, LONG_WEIGHT, PARTIAL_FROM, PARTIAL_WEIGHT, TOKEN_WEIGHT, comparable, weighted_ratio,
)
from rinseframe.model import ROW_ID, NormalizeText
from rinseframe.plans.effects import Effect
from rinseframe.plans.runtime import written

# Values that one task settles by itself, and values of a block.
ALONE = 4096
BLOCK = 2048


class Spellings:
    """A block of texts, prepared so that most that cannot match a given one are told by counting characters."""

    def __init__(self, texts: list[str], threshold: int):
        self.threshold = threshold
        self.least = threshold + 0.5 - 1e-9  # scores are rounded before they are compared
        self.cleaned = [comparable(t) for t in texts]
        letters = sorted(set("".join(self.cleaned)))
        self.place = {c: i for i, c in enumerate(letters)}
        self.counts = np.zeros((len(texts), len(letters)), dtype=np.uint16)
        self.holders: dict[str, list[int]] = {}
        for i, text in enumerate(self.cleaned):
            for c in text:
                self.counts[i, self.place[c]] += 1
            for token in set(text.split()):
                self.holders.setdefault(token, []).append(i)
        self.length = np.array([len(t) for t in self.cleaned], dtype=float)
        self.once = np.array([len(" ".join(set(t.split()))) for t in self.cleaned], dtype=float)

    def matches(self, text: str) -> list[int]:
        """Places of the texts whose weighted ratio with ``text`` rounds to more than the threshold."""
        text = comparable(text)
        if not text or not len(self.length):
            return []
        own = np.zeros(len(self.place), dtype=np.uint16)
        for c in text:
            if c in self.place:
                own[self.place[c]] += 1
        # No common subsequence, of any order or part of the words, is longer than the common characters.
        common = np.minimum(self.counts, own).sum(axis=1, dtype=float)
        n, once = float(len(text)), float(len(" ".join(set(text.split()))))
        longer = np.maximum(self.length, n) / np.maximum(np.minimum(self.length, n), 1)
        weight = np.where(longer <= LONG_FROM, PARTIAL_WEIGHT, LONG_WEIGHT)
        whole = 200 * common / (self.length + n)
        tokens = TOKEN_WEIGHT * 200 * common / np.maximum(self.once + once, 1)
        part = weight * 200 * common / np.maximum(np.minimum(self.once, once) + common, 1)
        close = longer < PARTIAL_FROM
        likely = (whole >= self.least) | (np.where(close, tokens, part) >= self.least)
        shares = np.zeros(len(likely), dtype=bool)
        for token in set(text.split()):
            shares[self.holders.get(token, [])] = True
        likely |= shares & (close | (100 * weight >= self.least))
        # A shared word makes the partial token ratio 100.
        sure = shares & ~close & (100 * TOKEN_WEIGHT * weight >= self.least)
        likely &= ~sure & (self.length > 0)
        exact = [i for i in np.flatnonzero(likely) if round(weighted_ratio(text, self.cleaned[i])) > self.threshold]
        return sorted([*np.flatnonzero(sure & (self.length > 0)).tolist(), *map(int, exact)])


def leaders_of(block: list[str], threshold: int) -> list[str]:
    """Those of a block, in order, that no earlier leader of the block merges."""
    spellings, merged, leaders = Spellings(block, threshold), np.zeros(len(block), dtype=bool), []
    for i, value in enumerate(block):
        if not merged[i]:
            leaders.append(value)
            merged[i] = True
            merged[spellings.matches(value)] = True
    return leaders


def _settled(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """(no, v, lead) of a few values in their order: ``lead`` is the last of the leaders that merges one, or itself."""
    nos, values = [], []
    for batch in batches:
        nos += batch.column("no").to_pylist()
        values += batch.column("v").to_pylist()
    spellings, leaders = Spellings(values, threshold), leaders_of(values, threshold)
    leads = list(values)
    for leader in leaders:
        for i in spellings.matches(leader):
            leads[i] = leader
    of = set(leaders)
    leads = [v if v in of else lead for v, lead in zip(values, leads)]
    yield pa.RecordBatch.from_arrays([pa.array(nos, pa.int64()), pa.array(values, pa.string()), pa.array(leads, pa.string())], names=["no", "v", "lead"])


def _alone(values: DataFrame, threshold: int) -> DataFrame:
    few = values.select("no", "v").repartition(1).sortWithinPartitions("no")
    return few.mapInArrow(partial(_settled, threshold=threshold), "no long, v string, lead string")


def _compared(asked: pa.Table, known: pa.Table, threshold: int, last: bool) -> pa.Table:
    """(no, by) of the asked values that a known one of a smaller number matches; ``last``: the greatest number of any
    known one that matches."""
    spellings = Spellings(asked.column("v").to_pylist(), threshold)
    nos = asked.column("no").to_numpy()
    by = np.full(len(nos), -1, dtype=np.int64)
    for no, value in sorted(zip(known.column("known_no").to_pylist(), known.column("known_v").to_pylist()), reverse=last):
        for i in spellings.matches(value):
            if by[i] < 0 and (last or no < nos[i]):
                by[i] = no
        if (by >= 0).all():
            break
    return pa.table({"no": nos[by >= 0], "by": by[by >= 0]})


def _matched(asked: DataFrame, known: DataFrame, threshold: int, last: bool = False) -> DataFrame:
    """(no, by): one row for each asked value with a match, from all pairs of a block of asked and one of known values."""
    own, other = (df.select(F.expr(f"at div {BLOCK}").alias(block), "no", "v") for df, block in ((asked, "a"), (known, "k")))
    # All pairs of blocks, but for those that hold no earlier value: as many as there are groups to compare.
    held = other.groupBy("k").agg(F.min("no").alias("low")).agg(F.collect_list(F.struct("k", "low"))).scalar()
    pairs = own.groupBy("a").agg(F.max("no").alias("high")).withColumn("with", F.explode(held))
    pairs = pairs if last else pairs.filter(F.col("with")["low"] < F.col("high"))
    pairs = written(pairs.select("a", F.col("with")["k"].alias("k")), "pairs")
    own = own.join(pairs, "a").select("a", "k", "no", "v")
    # New names, as both sides may be one table.
    other = other.join(pairs, "k").select("a", "k", F.col("no").alias("known_no"), F.col("v").alias("known_v"))
    task = lambda x, y: _compared(x, y, threshold, last)
    found = own.groupBy("a", "k").cogroup(other.groupBy("a", "k")).applyInArrow(task, "no long, by long")
    return found.groupBy("no").agg(F.max("by").alias("by"))


def _numbered(values: DataFrame, *order: str) -> DataFrame:
    """With ``at``, which follows the order and has no holes within a partition."""
    in_order = values.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(in_order.withColumn("at", F.monotonically_increasing_id()), "spellings")


def merge_table(df: DataFrame, name: str, threshold: int) -> DataFrame:
    """(v, lead) for every value that another one replaces."""
    seen = df.filter(col(name).isNotNull()).groupBy(col(name).alias("v"))
    at = F.min(col(ROW_ID).cast("bigint")) if ROW_ID in df.columns else F.lit(None).cast("bigint")
    values = _numbered(seen.agg(at.alias("first")), "first", "v").withColumn("no", F.col("at"))
    if values.count() <= ALONE:
        return written(_alone(values, threshold).filter("lead <> v").select("v", "lead"), "spellings")
    leaders, undecided = None, values
    while (left := undecided.count()) > ALONE:
        touched = written(_matched(undecided, undecided, threshold).select("no"), "touched")
        free = undecided.join(touched, "no", "left_anti").select("no", "v")
        free = _numbered(free, "no")
        leaders = free if leaders is None else leaders.unionByName(free)
        others = _numbered(undecided.join(touched, "no", "left_semi").select("no", "v"), "no")
        merged = written(_matched(others, free, threshold).select("no"), "merged")
        undecided = _numbered(others.join(merged, "no", "left_anti").select("no", "v"), "no")
    if left:
        rest = _alone(undecided, threshold).filter("lead = v").select("no", "v")
        leaders = rest if leaders is None else leaders.select("no", "v").unionByName(rest)
    leaders = _numbered(leaders.select("no", "v"), "no")
    merged = _numbered(values.join(leaders.select("no"), "no", "left_anti").select("no", "v"), "no")
    best = _matched(merged, leaders, threshold, last=True)
    led = merged.select("no", "v").join(best, "no").join(leaders.select(F.col("no").alias("by"), F.col("v").alias("lead")), "by")
    return written(led.select("v", "lead"), "spellings")


def _translated(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Values replaced by a join with their table; Spark sends the table to all tasks if it is small."""
    out = df
    for i, (name, into) in enumerate(tables.items()):
        lookup = into.select(F.col("v").alias(f"_rf_from{i}"), F.col("lead").alias(f"_rf_to{i}"))
        out = out.join(lookup, col(name) == F.col(f"_rf_from{i}"), "left")
    numbers = {name: i for i, name in enumerate(tables)}
    return out.select(
        *[
            F.coalesce(F.col(f"_rf_to{numbers[c]}"), col(c)).alias(c) if c in numbers else col(c)
            for c in df.columns
        ]
    )


def fuzzy_effect(df: DataFrame, names: list[str], step: NormalizeText) -> Effect:
    tables = {c: merge_table(df, c, step.threshold) for c in names}
    return Effect(project=lambda f: _translated(f, tables), whole_table=True)
