"""Exact k-nearest-neighbour imputation as a partitioned join.

Distance follows the usual nearest-neighbour imputer: squared differences over the
predictors that both rows have, scaled up by (all features / shared features); the fill
is the plain mean of the k nearest known targets, ties by the smaller row id; a row that
shares no predictor with any donor gets the column mean.

No pair of tables is crossed. Rows are matched per *class*: the set of predictors a
receiver has, and the subset of it that a donor has. Within a class one shared predictor
cuts the donors into value ranges, *cells*, of bounded size:

1. donors with equal predictors are cut to the k with the smallest ids - no other can win;
2. each receiver meets its own cell of every class, which bounds its k-th distance;
3. it then visits the other cells that the bound reaches along the cutting predictor;
   farther cells cannot hold a nearer donor;
4. the k best candidates over all visits win.

A cell that is too large (many donors with one value) is split by a hash of the donor id,
and receivers that crowd into one cell are split into chunks, so a task holds about
CELL_ROWS donors and CHUNK_ROWS receivers at most, whatever the data looks like.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rinseframe.frames import col, dtype, is_numeric
from rinseframe.model import ROW_ID
from rinseframe.operators.stats import run_aggregates
from rinseframe.plans.effects import Effect, nothing
from rinseframe.plans.runtime import durable
from rinseframe.sources.tables import with_row_id

NEIGHBOURS = 5
CELL_ROWS = 100_000
CHUNK_ROWS = 2_000
MAX_CELLS = 4_000
# Inside a task: receivers measured together, and donors looked at first on either side of them.
BLOCK = 32
LOOK = 256
# Widens a reach a little, against rounding.
SLACK = 1.0 + 1e-9
# Pairs of a receiver's and a donor's set of present predictors that are told apart at most, and receivers' sets, as a
# donor goes to each of them.
MOST_PAIRS, MOST_ASKED = 1 << 20, 1 << 10
# A lookup of cells is broadcast up to this many rows (about 30 bytes each), joined by key beyond.
LOOKUP_ROWS = 200_000


class TooManyPatterns(ValueError):
    """The gaps of the predictors form more sets than can be told apart."""


def _pattern(names: list[str]) -> Column:
    """A letter for each predictor: 1 where it is present."""
    return F.concat(*[F.when(F.col(f"x{i}").isNotNull(), F.lit("1")).otherwise(F.lit("0")) for i in range(len(names))])


def _points(df: DataFrame, predictors: list[str], *more: Column) -> DataFrame:
    xs = [col(c).cast("double").alias(f"x{i}") for i, c in enumerate(predictors)]
    return df.select(F.col(ROW_ID).alias("id"), *more, *xs)


def _both(p: str, q: str) -> str:
    return "".join("1" if a == b == "1" else "0" for a, b in zip(p, q))


def _classes(asked: dict[str, int], held: list, width: int) -> tuple[list[tuple[str, str]], list[int], dict[int, int]]:
    """The classes as (receiver's predictors, shared ones), their donors, and the predictor that cuts each: the one that
    spreads most."""
    numbers: dict[tuple[str, str], int] = {}
    sizes: list[int] = []
    spread: list[np.ndarray] = []
    for p in sorted(asked):
        for row in held:
            q = _both(p, row["p"])
            if "1" in q:
                g = numbers.setdefault((p, q), len(sizes))
                if g == len(sizes):
                    sizes.append(0)
                    spread.append(np.zeros(width))
                sizes[g] += row["n"]
                spread[g] += [row["n"] * (row[f"s{i}"] or 0.0) for i in range(width)]
    classes = list(numbers)
    cuts = {g: max(_shared(q), key=lambda i: spread[g][i]) for g, (_, q) in enumerate(classes)}
    return classes, sizes, cuts


def _shared(q: str) -> list[int]:
    """The predictors that both sides of a class have."""
    return [i for i, there in enumerate(q) if there == "1"]


def _k_smallest(d2: np.ndarray, k: int) -> np.ndarray:
    """The k-th smallest entry of each row; infinite when a row has fewer."""
    if d2.shape[1] < k:
        return np.full(len(d2), np.inf)
    return np.partition(d2, k - 1, axis=1)[:, k - 1]


def _best(receivers: pd.DataFrame, donors: pd.DataFrame, own: list[int], cut: int, width: int, k: int) -> pd.DataFrame:
    """k nearest donors of every receiver of one group: (id, donor, d2, y).

    Donors are ordered by the cutting predictor. A first look at the donors around a block
    of receivers bounds how far along that predictor a nearer donor can be; only donors
    within that range are measured.
    """
    columns = [f"x{i}" for i in own]
    at = own.index(cut)
    points, ids = donors[columns].to_numpy(dtype=float), donors["id"].to_numpy()
    order = np.lexsort((ids, points[:, at]))
    points, ids, ys = points[order], ids[order], donors["y"].to_numpy(dtype=float)[order]
    axis = points[:, at]
    scale = (width + 1.0) / len(own)
    # equal receivers are answered once, in the order of the cutting predictor
    wanted, back = np.unique(receivers[columns].to_numpy(dtype=float), axis=0, return_inverse=True)
    along = np.argsort(wanted[:, at], kind="stable")

    def measure(block: np.ndarray, start: int, stop: int) -> np.ndarray:
        d2 = np.zeros((len(block), stop - start))
        for j in range(len(own)):
            gap = block[:, j, None] - points[None, start:stop, j]
            gap *= gap
            d2 += gap
        d2 *= scale
        return d2

    answers: list = [None] * len(wanted)
    for first in range(0, len(wanted), BLOCK):
        members = along[first : first + BLOCK]
        block = wanted[members]
        edge = block[:, at]
        start = max(np.searchsorted(axis, edge[0]) - LOOK, 0)
        stop = min(np.searchsorted(axis, edge[-1], side="right") + LOOK, len(ids))
        d2 = measure(block, start, stop)
        kth = _k_smallest(d2, k)
        if start > 0 or stop < len(ids):
            reach = np.sqrt(kth / scale) * SLACK
            low = np.searchsorted(axis, (edge - reach).min())
            high = np.searchsorted(axis, (edge + reach).max(), side="right")
            if low < start or high > stop:
                start, stop = min(low, start), max(high, stop)
                d2 = measure(block, start, stop)
                kth = _k_smallest(d2, k)
        for row, limit, member in zip(d2, kth, members):
            near = np.flatnonzero(row <= limit)
            near = near[np.lexsort((ids[start + near], row[near]))][:k]
            answers[member] = (start + near, row[near])
    picked = [answers[b] for b in np.ravel(back)]
    places = np.concatenate([near for near, _ in picked])
    return pd.DataFrame(
        {
            "id": np.repeat(receivers["id"].to_numpy(), [len(near) for near, _ in picked]),
            "donor": ids[places],
            "d2": np.concatenate([dist for _, dist in picked]),
            "y": ys[places],
        }
    )


_CANDIDATES = "id bigint, donor bigint, d2 double, y double"


def _match(receivers: DataFrame, donors: DataFrame, key: list[str], k: int) -> DataFrame:
    """Candidates from groups of receivers and donors with equal ``key``; receivers carry what their class shares."""

    def best(group, asking: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(near):
            return pd.DataFrame({"id": [], "donor": [], "d2": [], "y": []})
        q, cut = asking["q"].iloc[0], int(asking["cut"].iloc[0])
        return _best(asking, near, _shared(q), cut, len(q), k)

    return receivers.groupBy(*key).cogroup(donors.groupBy(*key)).applyInPandas(best, _CANDIDATES)


def _k_best(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy("d2", "donor")
    return candidates.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")


def _chunk(chunks) -> Column:
    return F.pmod(F.xxhash64("id"), chunks).cast("int")


def _every_chunk(chunks) -> Column:
    return F.explode(F.sequence(F.lit(0), chunks - 1))


def _meet(visits: DataFrame, donors: DataFrame, k: int) -> DataFrame:
    """Candidates of all receivers in the (class, cell, part) they visit.

    The visitors of a cell are split into chunks, and its donors go to each chunk.
    """
    place = ["g", "cell", "part"]
    chunks = durable(visits.groupBy(*place).agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks")))
    if chunks.count() <= LOOKUP_ROWS:
        chunks = F.broadcast(chunks)
    left = visits.join(chunks, place).withColumn("chunk", _chunk(F.col("chunks")))
    right = donors.join(chunks, place).withColumn("chunk", _every_chunk(F.col("chunks")))
    return _match(left, right, [*place, "chunk"], k)


def _cell_finder(bounds: dict[int, list[float]]):
    edges = {g: np.asarray(b, dtype=float) for g, b in bounds.items()}

    @F.pandas_udf("int")
    def find(g: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros(len(g), dtype=np.int32)
        xs = x.to_numpy(dtype=float)
        for value in g.unique():
            at = (g == value).to_numpy()
            if (own := edges.get(int(value))) is not None:
                out[at] = np.searchsorted(own, xs[at], side="right")
        return pd.Series(out)

    return find


def nearest_mean(df: DataFrame, target: str, predictors: list[str], donor_rows: int, k: int = NEIGHBOURS) -> DataFrame:
    """(id, fill) for the rows of ``df`` (which has row ids) whose target is missing."""
    width = len(predictors)
    xs = [f"x{i}" for i in range(width)]
    receivers = _points(df.filter(col(target).isNull()), predictors).withColumn("p", _pattern(predictors))
    donors = _points(df.filter(col(target).isNotNull()), predictors, col(target).cast("double").alias("y"))
    donors = donors.withColumn("p", _pattern(predictors))
    one_cell = donor_rows <= CELL_ROWS
    if not one_cell:
        nearest_ids = Window.partitionBy(*xs).orderBy("id")
        donors = donors.withColumn("n", F.row_number().over(nearest_ids)).filter(F.col("n") <= k).drop("n")
        donors, receivers = durable(donors), durable(receivers)

    asked = {r["p"]: r["count"] for r in receivers.groupBy("p").count().limit(MOST_ASKED + 1).collect()}
    spreads = [F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(xs)]
    held = donors.groupBy("p").agg(F.count("*").alias("n"), *spreads).limit(MOST_PAIRS // max(len(asked), 1) + 1).collect()
    if len(asked) > MOST_ASKED or len(asked) * len(held) > MOST_PAIRS:
        raise TooManyPatterns(f"the gaps of {width} predictors form {len(asked)} and {len(held)} patterns")
    classes, sizes, cuts = _classes(asked, held, width)
    spark = df.sparkSession
    if not cuts:
        return spark.createDataFrame([], "id bigint, fill double")
    number = {pair: g for g, pair in enumerate(classes)}
    facts = [(g, cuts[g], math.ceil(asked[p] / CHUNK_ROWS)) for g, (p, _) in enumerate(classes)]
    of_pattern: dict[str, list[tuple]] = {}
    for g, (p, q) in enumerate(classes):
        of_pattern.setdefault(p, []).append((*facts[g], q))
    offers = {r["p"]: [facts[number[p, q]] for p in of_pattern if "1" in (q := _both(p, r["p"]))] for r in held}

    def classed(table: DataFrame, of: dict[str, list[tuple]], more: str = "") -> DataFrame:
        """Each row once for every class that its pattern belongs to, with what is known of the class."""
        rows = [(p, found) for p, found in of.items() if found]
        lookup = spark.createDataFrame(rows, f"p string, found array<struct<g: int, cut: int, chunks: int{more}>>")
        return table.join(F.broadcast(lookup), "p").select(*[c for c in table.columns if c != "p"], F.inline("found"))

    asking, donors = classed(receivers, of_pattern, ", q: string"), classed(donors, offers)
    if one_cell:
        asking = asking.withColumn("chunk", _chunk(F.col("chunks")))
        donors = donors.withColumn("chunk", _every_chunk(F.col("chunks")))
        best = _match(asking, donors, ["g", "chunk"], k)
        best = _k_best(best, k) if len(cuts) > len(of_pattern) else best
    else:
        best = _best_over_cells(asking, donors, sizes, cuts, xs, k)
    return best.groupBy("id").agg(F.avg("y").alias("fill"))


def _best_over_cells(
    asking: DataFrame, donors: DataFrame, sizes: list[int], cuts: dict[int, int], xs: list[str], k: int
) -> DataFrame:
    width = len(xs)
    # cell edges: quantiles of the cutting predictor among the donors of the class
    most = max(1, min(MAX_CELLS, LOOKUP_ROWS // (2 * len(cuts))))
    cells = {g: min(most, math.ceil(n / CELL_ROWS)) for g, n in enumerate(sizes)}
    marks = {
        f"q{g}": F.percentile_approx(
            F.when(F.col("g") == g, F.col(f"x{cuts[g]}")), [i / n for i in range(1, n)], max(20 * n, 10_000)
        )
        for g, n in cells.items()
        if n > 1
    }
    seen = run_aggregates(donors, marks) if marks else {}
    find = _cell_finder({g: sorted(set(seen[f"q{g}"] or [])) for g, n in cells.items() if n > 1})
    cut_value = F.element_at(F.array(*xs), F.col("cut") + 1)

    placed = donors.withColumn("cell", find("g", cut_value))
    parts = placed.groupBy("g", "cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"))
    parts = durable(parts)  # one row per class and cell: at most LOOKUP_ROWS
    placed = placed.join(F.broadcast(parts), ["g", "cell"])
    placed = placed.withColumn("part", _chunk(F.col("parts"))).select("g", "cell", "part", "id", "y", *xs)

    # every receiver first visits one part of its own cell in each class
    asking = asking.withColumn("at", cut_value).withColumn("home", find("g", "at"))
    own = parts.select("g", F.col("cell").alias("home"), "parts")
    asking = asking.join(F.broadcast(own), ["g", "home"], "left")
    asking = asking.withColumn("part", _chunk(F.coalesce("parts", F.lit(1)))).drop("parts")
    first = durable(_k_best(_meet(asking.drop("chunks").withColumnRenamed("home", "cell"), placed, k), k))
    reach = first.groupBy("id").agg(F.count("*").alias("found"), F.max("d2").alias("far"))
    # d2 >= (width + 1) / (shared predictors) * gap ** 2 for every donor of the class
    common = F.length(F.regexp_replace("q", "0", ""))
    radius = F.sqrt(F.col("far") * common / F.lit(width + 1.0)) * F.lit(SLACK)
    radius = F.when(F.col("found") >= k, radius).otherwise(F.lit(math.inf))
    reached = asking.join(reach, "id", "left").withColumn("radius", F.coalesce(radius, F.lit(math.inf)))
    reached = reached.withColumn("low", find("g", F.col("at") - F.col("radius"))).withColumn(
        "high", find("g", F.col("at") + F.col("radius"))
    )
    visits = (
        reached.withColumnRenamed("part", "home_part")
        .withColumn("cell", F.explode(F.sequence("low", "high")))
        .join(F.broadcast(parts), ["g", "cell"])
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .filter((F.col("cell") != F.col("home")) | (F.col("part") != F.col("home_part")))
        .select("id", "g", "cell", "part", "q", "cut", *xs)
    )
    return _k_best(first.unionByName(_meet(visits, placed, k)), k)


def knn_effect(df: DataFrame, target: str, predictors: list[str], k: int = NEIGHBOURS) -> Effect:
    if not is_numeric(dtype(df, target)):
        return nothing(f"Error: KNN imputation requires a numeric column, '{target}' is not.")
    used = [target, *predictors]
    counts = run_aggregates(df, {f"n{i}": F.count(col(c)) for i, c in enumerate(used)} | {"rows": F.count("*")})
    blank = [c for i, c in enumerate(used) if counts[f"n{i}"] == 0]
    if blank:
        return nothing(f"Error: KNN imputation of '{target}' was skipped, column '{blank[0]}' has no values.")
    if counts["n0"] == counts["rows"]:
        return Effect(whole_table=True)

    def fill(frame: DataFrame) -> DataFrame:
        had_id = ROW_ID in frame.columns
        numbered = frame if had_id else durable(with_row_id(frame))
        mean = numbered.agg(F.avg(col(target).cast("double")).alias("v")).scalar()
        fills = nearest_mean(numbered, target, predictors, counts["n0"], k).withColumnRenamed("id", "_rf_id")
        joined = numbered.join(fills, numbered[ROW_ID] == fills["_rf_id"], "left")
        filled = F.coalesce(col(target).cast("double"), F.col("fill"), mean)
        return joined.select(
            *[filled.alias(c) if c == target else col(c) for c in frame.columns if had_id or c != ROW_ID]
        )

    return Effect(rebuild=fill, whole_table=True)
