"""Registration of queries, and the tables of recordings that they derive from the test data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparktrode.operators.windows import ranked

#: Rows of a range of samples that are numbered in one task.
RANGE_ROWS = 1_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison with the SQL; -0.0 becomes 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor((F.dayofmonth("ts") - 1) / 6).cast("int")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', ts)")
    return table(spark, sf_dir, "events").select(
        (day + 1).alias("recording_index"),
        F.concat(F.lit("rec_"), (day + 1).cast("string")).alias("recording_name"),
        F.element_at(F.array(*map(F.lit, ("Baseline", "-70nA", "Post", "-90nA", "Post"))), day + 1).alias("epoch_label"),
        F.col("event_type").alias("channel"),
        F.when(F.col("event_type").isin("click", "error"), "A").otherwise("B").alias("grp"),
        *("event_id", "ts", "user_id", "value"),
        (us - day.cast("long") * F.lit(518400000000)).alias("t_us"),
    )


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("t_s", F.col("t_us") / F.lit(1e6))


def signal(spark: SparkSession, sf_dir: str, rate: float = 100.0, holes: bool = False) -> DataFrame:
    """recording_index, channel, n, t_s, x_uv; with holes every 17th event is missing."""
    x = F.col("value") - 50
    x = F.when(F.col("event_id") % 17 == 0, None).otherwise(x) if holes else x
    n = F.row_number().over(W.partitionBy("recording_index", "channel").orderBy("ts", "event_id")).cast("long") - 1
    return events(spark, sf_dir).withColumn("n", n).select("recording_index", "recording_name", "channel", "n", (F.col("n") / F.lit(rate)).alias("t_s"), x.alias("x_uv"))


def ranges(spark: SparkSession, sf_dir: str) -> int:
    """Ranges of RANGE_ROWS that hold all raw words, by the files' own counts."""
    return -(-table(spark, sf_dir, "lineitem").count() // RANGE_ROWS)


def raw_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, n, tick, word from lineitem; the four recordings are numbered by ranges of rows."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem").select(*order)
    base = lines.withColumn("recording", (F.col("l_suppkey") % 4).cast("int"))
    n = ranked(base, *order, keys=["recording"], parts=ranges(spark, sf_dir), few=True).withColumn("n", F.col("rank") - 1)
    return n.select("recording", "n", (F.col("n") + F.floor(F.col("n") / 100)).alias("tick"), (F.floor("l_extendedprice") % 65536).cast("int").alias("word"))


#: The same tables in DuckDB's SQL, to stand after WITH.
EV = """ev as (select *, (day(ts)-1)//6 as d, epoch_us(ts) - epoch_us(timestamp '2024-01-01') as us from events),
fx_spikes as (select cast(d+1 as int) as recording_index, 'rec_' || (d+1) as recording_name,
 case d when 0 then 'Baseline' when 1 then '-70nA' when 3 then '-90nA' else 'Post' end as epoch_label, event_type as channel,
 case when event_type in ('click','error') then 'A' else 'B' end as grp, event_id, ts, user_id, value, us - d*518400000000 as t_us,
 (us - d*518400000000)/1e6 as t_s from ev)"""
SIGNAL = EV + """, fx_signal as (select recording_index, recording_name, channel,
 row_number() over (partition by recording_index, channel order by ts, event_id) - 1 as n,
 (row_number() over (partition by recording_index, channel order by ts, event_id) - 1)/{rate} as t_s, {x} as x_uv from fx_spikes)"""


def signal_sql(rate: float = 100.0, holes: bool = False) -> str:
    return SIGNAL.format(rate=rate, x="case when event_id % 17 = 0 then null else value - 50 end" if holes else "value - 50")


RAW = """fx_raw as (select recording, n, n + n//100 as tick, word from (select cast(l_suppkey % 4 as int) as recording,
 row_number() over (partition by l_suppkey % 4 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as n,
 cast(cast(floor(l_extendedprice) as bigint) % 65536 as int) as word from lineitem))"""

WINDOW_S, RECORDING_S = 21600.0, 518400.0
