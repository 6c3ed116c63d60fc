"""What the operators of this subpackage share: whole texts through Arrow in small parts, and written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinseframe.plans.runtime import fresh_path

#: Rows and bytes of text that a task looks at together.
PART_ROWS, PART_BYTES = 512, 4 << 20
#: Bits of a filter for each key, and in all; Spark's bitmaps have 2^15 each.
BITS_A_KEY, MOST_BITS, _MAP_BITS = 16, 1 << 26, 1 << 15

_ARROW = {
    "long": (T.LongType(), pa.int64()), "int": (T.IntegerType(), pa.int32()), "double": (T.DoubleType(), pa.float64()),
    "boolean": (T.BooleanType(), pa.bool_()), "string": (T.StringType(), pa.string()),
    "binary": (T.BinaryType(), pa.binary()), "longs": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "ints": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "strings": (T.ArrayType(T.StringType()), pa.list_(pa.string())),
}

TEXT = "__text_bytes"
Work = Callable[[list[bytes | None]], dict[str, list]]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fields(spec: dict[str, str]) -> list[T.StructField]:
    return [T.StructField(name, _ARROW[kind][0]) for name, kind in spec.items()]


def arrays(spec: dict[str, str], columns: dict[str, list]) -> list[pa.Array]:
    return [pa.array(columns[name], type=_ARROW[kind][1]) for name, kind in spec.items()]


def parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch cut so that long texts do not pile up in Python."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > PART_BYTES or i - start >= PART_ROWS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(docs: DataFrame, make: Callable[[], Work], spec: dict[str, str], keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns with new ones computed from whole texts.

    ``make`` runs once per task and returns a function from UTF-8 texts (None for null) to columns.
    A kept column whose name is taken by a new one is dropped; the order is kept columns first.
    """
    keep = [name for name in keep if name not in spec]
    source = docs.select(*(F.col(f"`{name}`") for name in keep), F.col(text).cast("string").cast("binary").alias(TEXT))
    schema = T.StructType([source.schema[name] for name in keep] + fields(spec))
    names = [*keep, *spec]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in parts(batch, TEXT):
                made = arrays(spec, work(part.column(TEXT).to_pylist()))
                yield pa.RecordBatch.from_arrays([*(part.column(name) for name in keep), *made], names=names)

    return source.mapInArrow(run, schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table written to the shared folder and read again: nothing before it runs twice or is lost with an executor."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flagged(df: DataFrame, hashed: F.Column, keys: DataFrame, keys_hashed: F.Column, flag: str) -> DataFrame:
    """``df`` with a boolean column: false where no row of ``keys``, a written table, has that hash, true where one may have it.

    Rows with long texts that no join can meet are so kept out of its shuffle. The hashes are marked in a bitmap of
    BITS_A_KEY bits a key, MOST_BITS in all; a fuller one only flags more, and the join that follows decides.
    """
    bits = min(MOST_BITS, max(_MAP_BITS, 1 << (BITS_A_KEY * keys.count()).bit_length()))
    slots = keys.select(F.pmod(keys_hashed, F.lit(bits)).alias("slot"))
    maps = slots.groupBy(F.shiftright("slot", 15).alias("__map")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(_MAP_BITS - 1)).alias("__marks"))
    slot = F.pmod(hashed, F.lit(bits))
    marked = df.withColumns({"__map": F.shiftright(slot, 15), "__place": slot.bitwiseAND(_MAP_BITS - 1).cast("int")})
    marked = marked.join(F.broadcast(stored(maps, "filter")), "__map", "left")
    byte = F.conv(F.hex(F.substring("__marks", F.shiftright("__place", 3) + 1, F.lit(1))), 16, 10).cast("int")
    return marked.withColumn(flag, F.coalesce(F.getbit(byte, F.col("__place").bitwiseAND(7)) == 1, F.lit(False))).drop("__map", "__place", "__marks")


def remainder(key: str, modulus: int) -> F.Column:
    """crc32 of an id's text, by a modulus: which rows are held out. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
