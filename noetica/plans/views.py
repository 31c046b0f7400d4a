"""Derived inputs over the driver's tables, the same for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import table_quads

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t) for t in TABLES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its times without zone are taken as times of the session's zone (UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in df.dtypes])


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_quads(tables(spark, sf_dir))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location histories made of events: time shrunk by 60, places on a grid by user and value."""
    e = table(spark, sf_dir, "events")
    level = F.floor(F.col("value") / 50)
    us = F.unix_micros(F.col("ts"))
    t0 = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.timestamp_micros(t0 + F.floor((us - t0) / 60)).alias("ts"),
        (F.lit(2.35) + F.lit(0.001) * ((7 * F.col("user_id") + level) % 40)).alias("lon"),
        (F.lit(48.85) + F.lit(0.001) * (level % 25)).alias("lat"),
        (F.lit(10.0) + F.lit(10.0) * (F.col("event_id") % 5)).alias("acc"),
    )


LOCATIONS = """
locations as (
  select event_id id, user_id, make_timestamp((t0 + floor((epoch_us(ts) - t0) / 60.0))::bigint) ts,
    2.35::double + 0.001::double * ((7 * user_id + floor(value / 50)::bigint) % 40)::double lon,
    48.85::double + 0.001::double * (floor(value / 50)::bigint % 25)::double lat,
    10::double + 10::double * (event_id % 5)::double acc
  from events, (select epoch_us(timestamp '2024-01-01') t0))"""


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of locations without a gap over 15 minutes, of some length."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "id")
    us = F.unix_micros("ts")
    marked = locations(spark, sf_dir).withColumn("new", F.coalesce(us - F.lag(us).over(w) > 900_000_000, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    runs = marked.groupBy("user_id", "run").agg(F.min("id").alias("id"), F.min("ts").alias("t_start"), F.max("ts").alias("t_end"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    return runs.where("t_start < t_end").drop("run")


STAYS = """
marked as (select *, case when coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, id)) > 900000000, true) then 1 else 0 end nw from locations),
runs as (select *, sum(nw) over (partition by user_id order by ts, id) run from marked),
stays as (select user_id, min(id) id, min(ts) t_start, max(ts) t_end, avg(lon) lon, avg(lat) lat from runs group by user_id, run having min(ts) < max(ts))"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half an hour from each purchase; every third has no place."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id")
    located = locations(spark, sf_dir).join(e.withColumnRenamed("event_id", "id"), "id", "left_semi")
    place = lambda c: F.when(F.col("id") % 3 != 0, F.col(c)).alias(c)
    return located.select("id", "user_id", F.col("ts").alias("t_start"), (F.col("ts") + F.expr("interval 30 minutes")).alias("t_end"), place("lon"), place("lat"))


CALENDAR = """
cal as (select id, user_id, ts t_start, ts + interval 30 minute t_end, case when id % 3 <> 0 then lon end lon, case when id % 3 <> 0 then lat end lat
  from locations where id in (select event_id from events where event_type = 'purchase'))"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with message counts: customers by orders, and a shared short form as a contact."""
    t = tables(spark, sf_dir)
    counts = t["orders"].groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    own = t["customer"].join(counts, "c_custkey", "left").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("agent"), F.col("c_name").alias("name"), F.coalesce("n", F.lit(0)).alias("msg_count"))
    parts = t["part"].select(F.concat(F.lit("c"), (F.col("p_partkey") % 150).cast("string")).alias("agent"), F.col("p_name").alias("name"), (F.col("p_size") % 3).cast("long").alias("msg_count"))
    return own.unionByName(parts)


NAMES = """
names as (
  select 'c' || c_custkey agent, c_name "name", coalesce(n, 0) msg_count from customer left join (select o_custkey, count(*) n from orders group by 1) on o_custkey = c_custkey
  union all select 'c' || (p_partkey % 150), p_name, (p_size % 3)::bigint from part)"""

HAVERSINE = "2 * {r} * asin(least(1.0, sqrt(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"
