"""Sources, samples, previews and column selection."""

from rinseframe.model import ROW_ID
from rinseframe.plans.runtime import fresh_path
from rinseframe.sources import tables as src
from suite.registry import query
from suite.views import EVENTS_SQL, dirty_events, table


@query(
    "csv_round_trip",
    EVENTS_SQL
    + """SELECT event_id, cast(ts AS varchar) AS ts, user_id, value, value2, event_type,
       CASE WHEN mixed = 'n/a' THEN NULL ELSE cast(mixed AS bigint) END AS mixed, ts_text,
       cast(constant_col AS bigint) AS constant_col, mostly_null, empty_col FROM d""",
)
def csv_round_trip(spark, folder):
    path = fresh_path(spark, "csv")
    src.write_csv(dirty_events(spark, folder), path)
    return src.read_csv(spark, path)


def _narrow(name: str) -> str:
    tests = " ".join(
        f"WHEN min({name}) >= {-(2 ** (b - 1))} AND max({name}) < {2 ** (b - 1)} THEN '{t}'"
        for b, t in ((8, "tinyint"), (16, "smallint"), (32, "int"))
    )
    return f"SELECT '{name}' AS name, CASE {tests} ELSE 'bigint' END AS type FROM lineitem"


@query(
    "downcast_ints",
    " UNION ALL ".join(_narrow(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    + " UNION ALL SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']), 'float'",
)
def downcast_ints(spark, folder):
    narrowed = src.downcast_types(table(spark, folder, "lineitem"))
    kept = [(f.name, f.dataType.simpleString()) for f in narrowed.schema if f.name.startswith("l_")]
    kept = [(n, t) for n, t in kept if t in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    return spark.createDataFrame(kept, "name string, type string")


@query("row_id", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_id FROM events")
def row_id(spark, folder):
    numbered = src.with_row_id(table(spark, folder, "events").select("event_id"), contiguous=True)
    return numbered.withColumnRenamed(ROW_ID, "row_id")


_DRAW = "ORDER BY md5(concat(cast(event_id AS varchar), ':42')), event_id LIMIT"


@query("sample_hash", EVENTS_SQL + f"SELECT event_id, value, event_type FROM d {_DRAW} 1000")
def sample_hash(spark, folder):
    return src.sample_rows(dirty_events(spark, folder), 1000).select("event_id", "value", "event_type")


@query("working_sample_large", EVENTS_SQL + f"SELECT event_id, value, event_type FROM d {_DRAW} 1000")
def working_sample_large(spark, folder):
    return src.working_sample(dirty_events(spark, folder), 1000).select("event_id", "value", "event_type")


@query(
    "downsample",
    EVENTS_SQL
    + f"""SELECT event_id, value, (SELECT count(*) FROM d) > 1000 AS is_sampled FROM (SELECT * FROM d {_DRAW} 1000)""",
)
def downsample(spark, folder):
    from pyspark.sql import functions as F

    sample, cut = src.downsample(dirty_events(spark, folder, "event_id", "value"))
    return sample.select("event_id", "value", F.lit(cut).alias("is_sampled"))


@query("preview_first", EVENTS_SQL + "SELECT * FROM d ORDER BY event_id LIMIT 100")
def preview_first(spark, folder):
    return src.preview(dirty_events(spark, folder), "first", 100).drop(ROW_ID)


@query("preview_last", EVENTS_SQL + "SELECT * FROM d ORDER BY event_id DESC LIMIT 100")
def preview_last(spark, folder):
    return src.preview(dirty_events(spark, folder), "last", 100).drop(ROW_ID)


@query("preview_random", EVENTS_SQL + f"SELECT * FROM d {_DRAW} 100")
def preview_random(spark, folder):
    return src.preview(dirty_events(spark, folder), "random", 100).drop(ROW_ID)


@query("select_by_dtype", EVENTS_SQL + "SELECT value, value2, mostly_null, empty_col FROM d")
def select_by_dtype(spark, folder):
    return src.select_columns(dirty_events(spark, folder), dtypes=["double"])
