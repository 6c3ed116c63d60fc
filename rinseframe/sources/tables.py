"""Reading, writing, row identity, samples and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rinseframe.frames import assign, col, data_columns, dtype, is_time, nan_to_null
from rinseframe.functions.casts import number_from_text
from rinseframe.model import ROW_ID
from rinseframe.operators.stats import run_aggregates
from rinseframe.plans.runtime import durable

# CSV fields that are read as missing (the pandas defaults).
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

DEFAULT_SAMPLE_ROWS = 10_000
DEFAULT_PLOT_ROWS = 1_000
DEFAULT_SEED = 42


# ------------------------------------------------------------------ CSV


def _infer(df: DataFrame) -> DataFrame:
    """Give all-text columns the narrowest of bigint, double, boolean or string that fits every value."""
    tests: dict[str, Column] = {}
    names = df.columns
    for i, c in enumerate(names):
        x = col(c)
        tests[f"n{i}"] = F.count(x)
        tests[f"i{i}"] = F.count_if(x.rlike(r"^\s*[+-]?\d+\s*$") & x.try_cast("bigint").isNotNull())
        tests[f"d{i}"] = F.count_if(number_from_text(x).isNotNull())
        tests[f"b{i}"] = F.count_if(x.isin("True", "False", "TRUE", "FALSE", "true", "false"))
    seen = run_aggregates(df, tests, width=len(tests))  # rows of text are read whole: one pass
    changed: dict[str, Column] = {}
    for i, c in enumerate(names):
        n = seen[f"n{i}"]
        if n == 0 or seen[f"d{i}"] == n:
            whole = n > 0 and seen[f"i{i}"] == n
            changed[c] = col(c).try_cast("bigint") if whole else number_from_text(col(c))
        elif seen[f"b{i}"] == n:
            changed[c] = col(c).try_cast("boolean")
    return assign(df, changed)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    nrows: int | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """A CSV file or folder with a header; types are inferred in one pass unless a schema is given.

    ``multi_line`` allows line breaks inside quotes; such files cannot be split, so it is off by default.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if schema is not None:
        df = reader.schema(schema).csv(path)
        return nan_to_null(df if nrows is None else df.limit(nrows))
    df = reader.csv(path)
    if nrows is not None:
        df = df.limit(nrows)
    df = assign(df, {c: F.when(~col(c).isin(*MISSING_WORDS), col(c)) for c in df.columns})
    return _infer(df)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The user's columns as CSV with a header, one file per partition.

    An empty text is written as ``""`` and a missing value as nothing.
    """
    times = {c: col(c).cast("string") for c in data_columns(df) if is_time(dtype(df, c))}  # all digits of a second
    writer = assign(df.select(*map(col, data_columns(df))), times).write.mode(mode).option("header", True)
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(*map(col, data_columns(df))).write.mode(mode).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


# ------------------------------------------------------------------ types


def downcast_types(df: DataFrame) -> DataFrame:
    """Floats become float32 and integers the smallest type that holds them.

    Narrowing a float loses precision, so nothing else in the library calls this.
    """
    whole = [c for c in data_columns(df) if isinstance(dtype(df, c), T.IntegralType)]
    bounds = run_aggregates(
        df, {f"{w}{i}": agg(col(c)) for i, c in enumerate(whole) for w, agg in (("lo", F.min), ("hi", F.max))}
    )
    changed = {c: col(c).cast("float") for c in data_columns(df) if isinstance(dtype(df, c), T.DoubleType)}
    for i, c in enumerate(whole):
        low, high = bounds[f"lo{i}"], bounds[f"hi{i}"]
        if low is None:
            continue
        for bits, name in ((8, "tinyint"), (16, "smallint"), (32, "int")):
            if -(2 ** (bits - 1)) <= low and high < 2 ** (bits - 1):
                changed[c] = col(c).cast(name)
                break
    return assign(df, changed)


# ------------------------------------------------------------------ row identity


def with_row_id(df: DataFrame, key: str | None = None, contiguous: bool = False) -> DataFrame:
    """Add ``_row_id``.

    * ``key``: a column that is already unique; costs nothing and survives any re-execution.
    * default: increasing and unique in input order, no job. Stable as long as the
      input is (files are; the output of a shuffle is not - checkpoint that first).
    * ``contiguous``: 0..n-1 in input order. The rows are first put on shared storage,
      so that counting and numbering see the same partitions; then one count per
      partition and a broadcast of one offset per partition, no global sort.
    """
    if key is not None:
        return df.withColumn(ROW_ID, col(key).cast("bigint"))
    if not contiguous:
        return df.withColumn(ROW_ID, F.monotonically_increasing_id())
    fixed = durable(df)
    # monotonically_increasing_id keeps the partition number above bit 33
    tagged = fixed.withColumn("_rf_mid", F.monotonically_increasing_id()).withColumn(
        "_rf_part", F.shiftright("_rf_mid", 33).cast("int")
    )
    sizes = {r["_rf_part"]: r["count"] for r in tagged.groupBy("_rf_part").count().collect()}
    rows, start = [], 0
    for part in sorted(sizes):
        rows.append((part, start - (part << 33)))
        start += sizes[part]
    offsets = df.sparkSession.createDataFrame(rows, "_rf_part int, _rf_off bigint")
    return (
        tagged.join(F.broadcast(offsets), "_rf_part")
        .withColumn(ROW_ID, F.col("_rf_mid") + F.col("_rf_off"))
        .select(*map(col, df.columns), ROW_ID)
    )


# ------------------------------------------------------------------ samples


def _draw(seed: int) -> Column:
    """A pseudo-random order that depends on the row id and the seed alone, not on partitions."""
    return F.md5(F.concat(F.col(ROW_ID).cast("string"), F.lit(f":{seed}")))


def sample_rows(df: DataFrame, n: int = DEFAULT_SAMPLE_ROWS, seed: int = DEFAULT_SEED) -> DataFrame:
    """n rows at random: the same ones on every run and cluster. Each task keeps its best n only."""
    return df.orderBy(_draw(seed), ROW_ID).limit(n)


def working_sample(df: DataFrame, n: int = DEFAULT_SAMPLE_ROWS, seed: int = DEFAULT_SEED) -> DataFrame:
    """A working set: n rows drawn by a hash of the row id, however large the table is."""
    return sample_rows(df, n, seed)


def downsample(df: DataFrame, n: int = DEFAULT_PLOT_ROWS, seed: int = DEFAULT_SEED) -> tuple[DataFrame, bool]:
    """At most n rows for a chart, in row order, and whether rows were left out."""
    if len(df.select(ROW_ID).limit(n + 1).take(n + 1)) <= n:
        return df.orderBy(ROW_ID), False
    return sample_rows(df, n, seed).orderBy(ROW_ID), True


def preview(df: DataFrame, mode: str = "first", n: int = 100, seed: int = DEFAULT_SEED) -> DataFrame:
    """``first``, ``last``, ``random`` or ``all`` rows."""
    if mode == "first":
        return df.orderBy(ROW_ID).limit(n)
    if mode == "last":
        return df.orderBy(F.desc(ROW_ID)).limit(n).orderBy(ROW_ID)
    if mode == "random":
        return sample_rows(df, n, seed)
    if mode == "all":
        return df
    raise ValueError(f"unknown preview mode '{mode}'")


def select_columns(df: DataFrame, names: list[str] | None = None, dtypes: list[str] | None = None) -> DataFrame:
    """Keep the named columns (none named: all) whose type is listed (none listed: any)."""
    kept = [c for c in (names or data_columns(df)) if c in df.columns]
    if dtypes:
        kept = [c for c in kept if dtype(df, c).simpleString() in dtypes]
    return df.select(*map(col, kept))
