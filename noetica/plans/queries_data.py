"""Registered queries: joins, aggregates, sequences, scalars, graphs, inference, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, prob, text
from ..functions import time as when
from ..model import DIFFERENT_FROM, TYPE, schema
from ..operators import graph, inference, places, relational, resolve, stays
from ..operators.alignment import align
from .registry import query
from .views import CALENDAR, HAVERSINE, LOCATIONS, NAMES, STAYS, calendar, locations, names, quads, tables
from .views import stays as stay_view

R = repr(geo.RADIUS)


def _r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


# -- joins and sequences


@query(
    "interval_overlap_join",
    f"with {LOCATIONS}, {STAYS}, {CALENDAR}, met as (select c.id event, s.id stay, (least(epoch_us(c.t_end), epoch_us(s.t_end)) - greatest(epoch_us(c.t_start), epoch_us(s.t_start)))::double / (epoch_us(c.t_end) - epoch_us(c.t_start)) share, "
    f"{HAVERSINE.format(r=R, x1='c.lon', y1='c.lat', x2='s.lon', y2='s.lat')} d from cal c join stays s on c.user_id = s.user_id and c.t_start <= s.t_end and s.t_start <= c.t_end) select event, stay from met where share > 0.2 and coalesce(d <= 1000, true)",
)
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.stay_event_matches(calendar(spark, sf_dir), stay_view(spark, sf_dir), ["user_id"]).select(F.col("id").alias("event"), F.col("r_id").alias("stay"))


@query("near_join_grid", f"with p as (select event_id id, 2::double + value / 500::double lon, 48::double + (event_id * 7919 % 10007)::double / 10007::double lat from events) select a.id a, b.id b, round({HAVERSINE.format(r=R, x1='a.lon', y1='a.lat', x2='b.lon', y2='b.lat')}, 3) distance from p a join p b on a.id < b.id where {HAVERSINE.format(r=R, x1='a.lon', y1='a.lat', x2='b.lon', y2='b.lat')} <= 500")
def near_join_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    points = tables(spark, sf_dir)["events"].select(key.alias("id"), (F.lit(2.0) + F.col("value") / 500.0).alias("lon"), (F.lit(48.0) + (key * 7919 % 10007).cast("double") / 10007.0).alias("lat"))
    return relational.near_pairs(points, 500.0).select("a", "b", _r("distance", 3))


@query("trail_length", f"with {LOCATIONS}, s as (select user_id, {HAVERSINE.format(r=R, x1='x', y1='y', x2='lon', y2='lat')} d from (select *, lag(lon) over w x, lag(lat) over w y from locations window w as (partition by user_id order by ts, id))) select user_id, round(coalesce(sum(d), 0), 4) length, count(*) n_points from s group by 1")
def trail_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.trail_length(locations(spark, sf_dir), ["user_id"], ["ts", "id"]).select("user_id", _r("length", 4), "n_points")


@query("consecutive_dedup", "select user_id, event_id from (select *, lead(event_type) over (partition by user_id order by ts, event_id) nx, count(*) over (partition by user_id) n from events) where nx <> event_type or n = 1")
def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"]
    return relational.drop_repeats(e, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id")


@query("cluster_stats", f"with {LOCATIONS} select user_id, round(sum(lon / (acc * acc)) / sum(1 / (acc * acc)), 6) lon, round(sum(lat / (acc * acc)) / sum(1 / (acc * acc)), 6) lat, round(sqrt(count(*) / sum(1 / (acc * acc))), 6) accuracy from locations group by 1")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.cluster_stats(locations(spark, sf_dir), ["user_id"]).select("user_id", _r("lon"), _r("lat"), _r("accuracy"))


@query("weighted_mean_by_accuracy", f"with {LOCATIONS} select user_id, round(sum((1 + id % 3) * lon / acc) / sum((1 + id % 3) / acc), 6) lon from locations group by 1")
def weighted_mean_by_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = (1 + F.col("id") % 3) / F.col("acc")
    return locations(spark, sf_dir).groupBy("user_id").agg((F.sum(w * F.col("lon")) / F.sum(w)).alias("lon")).select("user_id", _r("lon"))


@query("window_count_distribution", f"with {LOCATIONS}, t as (select distinct user_id, epoch_us(ts) t from locations), o as (select user_id, t - min(t) over (partition by user_id) t from t), n as (select user_id, greatest(1, ceil(max(t) / 600000000.0)::bigint) n from o group by 1), w as (select user_id, unnest(range(0, n)) w from n), c as (select user_id, t // 600000000 w, count(*) c from o group by 1, 2) select user_id, coalesce(c, 0) n_in_window, count(*) n_windows from w left join c using (user_id, w) group by 1, 2")
def window_count_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.window_counts(locations(spark, sf_dir), ["user_id"], "ts")


@query("locations_by_day", "select user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) n from events group by 1, 2")
def locations_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["events"].groupBy("user_id", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("top_k_per_query", "select o_custkey, o_orderkey, rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as rank from orders) where rank <= 3")
def top_k_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.top_k(tables(spark, sf_dir)["orders"], ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("arg_extremes", "select user_id, arg_min(event_id, value) low, arg_max(event_id, value) high from (select * from events qualify row_number() over (partition by user_id, value order by event_id) = 1) group by 1")
def arg_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"].groupBy("user_id", "value").agg(F.min("event_id").alias("event_id"))
    return e.groupBy("user_id").agg(F.min_by("event_id", "value").alias("low"), F.max_by("event_id", "value").alias("high"))


@query("cumulative_counts", "select event_type, value_level, sum(n) over (partition by event_type order by value_level)::bigint running from (select event_type, floor(value / 50)::bigint value_level, count(*) n from events group by 1, 2)")
def cumulative_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"].groupBy("event_type", F.floor(F.col("value") / 50).alias("value_level")).agg(F.count("*").alias("n"))
    return e.select("event_type", "value_level", F.sum("n").over(Window.partitionBy("event_type").orderBy("value_level")).alias("running"))


# -- aggregates


@query("msg_counts_by_name", "select c_name \"name\", count(o_orderkey) n from customer left join orders on o_custkey = c_custkey group by 1")
def msg_counts_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return t["customer"].join(t["orders"], F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_name").alias("name")).agg(F.count("o_orderkey").alias("n"))


@query("service_rollup", "select case when user_id % 2 = 0 then 'even' else 'odd' end service, user_id account, count(*) filter (event_type = 'click') click, count(*) filter (event_type = 'view') as view, count(*) filter (event_type = 'purchase') purchase, count(*) total from events group by grouping sets ((1, 2), (1))")
def service_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"].withColumn("service", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")).withColumn("account", F.col("user_id"))
    kinds = [F.count(F.when(F.col("event_type") == k, 1)).alias(k) for k in ("click", "view", "purchase")]
    return e.groupingSets([["service", "account"], ["service"]], "service", "account").agg(*kinds, F.count("*").alias("total"))


@query("score_histogram", "select greatest(1, ceil(round((l_discount * 10 - 0.02)::decimal(20,10) / 0.05, 8)))::int bucket, count(*) n from lineitem group by 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.score_histogram(tables(spark, sf_dir)["lineitem"].withColumn("score", F.col("l_discount") * 10 - 0.02), "score")


@query("functionality", "select count(distinct c_nationkey || c_mktsegment)::double / count(*) functionality, count(distinct o_custkey)::double / count(*) inverse_functionality from (select distinct c_nationkey, c_mktsegment, o_custkey from orders join customer on c_custkey = o_custkey)")
def functionality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    pairs = t["orders"].join(t["customer"], F.col("c_custkey") == F.col("o_custkey")).select(F.concat(F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("s"), F.col("o_custkey").alias("v"))
    return relational.functionality(pairs, "s", "v")


@query("class_sizes", "select n as class_size, count(*) n_classes from (select count(*) n from documents group by md5(text)) group by 1")
def class_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["documents"].groupBy(F.md5("text").alias("k")).agg(F.count("*").alias("class_size")).groupBy("class_size").agg(F.count("*").alias("n_classes"))


@query("part_type_distribution", "select p_type kind, count(distinct split_part(p_name, ' ', 1)) firsts, count(*) n from part group by 1")
def part_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["part"].groupBy(F.col("p_type").alias("kind")).agg(F.count_distinct(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("firsts"), F.count("*").alias("n"))


@query("domain_pattern_rollup", "select c_mktsegment seg, c_nationkey nation, count(*) n, round(avg(c_acctbal), 4) mean from customer group by rollup (c_mktsegment, c_nationkey)")
def domain_pattern_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)["customer"].select(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nation"), "c_acctbal")
    return c.rollup("seg", "nation").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("cache_misses", "select distinct o_custkey k from orders where o_custkey not in (select o_custkey from orders group by 1 having max(o_orderdate) > timestamp '2000-12-31')")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables(spark, sf_dir)["orders"].select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("modified_at"))
    return relational.cache_misses(o, o, "k", F.lit("2001-12-31").cast("timestamp"))


@query("etag_changes", "select c_custkey k, case when c_custkey % 5 = 0 then 'changed' else 'new' end change from customer where c_custkey % 5 = 0 or c_custkey % 11 = 1")
def etag_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)["customer"]
    key = F.col("c_custkey")
    old = c.where((key % 11 != 1) | (key % 5 == 0)).select(key.alias("path"), F.lit("v1").alias("etag"))
    now = c.select(key.alias("path"), F.when(key % 5 == 0, "v2").otherwise("v1").alias("etag"))
    return places.changed(now, old).where("change <> 'gone'").select(F.col("path").alias("k"), "change")


@query("task_registry", "select user_id source, arg_max(event_type, event_id) status, max(event_id) last from events group by 1")
def task_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["events"].groupBy(F.col("user_id").alias("source")).agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("last"))


# -- scalars


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    return locations(spark, sf_dir).select("id", "acc", *[F.lag(c).over(w).alias(c + "1") for c in ("lon", "lat", "acc")], F.col("lon").alias("lon2"), F.col("lat").alias("lat2")).where("lon1 is not null")


_P = f"{LOCATIONS}, p as (select * from (select id, acc, lag(lon) over w lon1, lag(lat) over w lat1, lag(acc) over w acc1, lon lon2, lat lat2 from locations window w as (partition by user_id order by ts, id)) where lon1 is not null)"
_H = HAVERSINE.format(r=R, x1="lon1", y1="lat1", x2="lon2", y2="lat2")


@query("haversine", f"with {_P} select id, round({_H}, 4) d from p")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("id", F.round(geo.haversine(*map(F.col, ("lon1", "lat1", "lon2", "lat2"))), 4).alias("d"))


_SIN = {"p1": "radians(lat1)", "p2": "radians(lat2)", "d": "radians(lon2 - lon1)"}
_V = "atan2(sqrt(pow(cos({p2}) * sin({d}), 2) + pow(cos({p1}) * sin({p2}) - sin({p1}) * cos({p2}) * cos({d}), 2)), sin({p1}) * sin({p2}) + cos({p1}) * cos({p2}) * cos({d}))".format(**_SIN)
_AZ = "degrees(atan2(sin({d}) * cos({p2}), cos({p1}) * sin({p2}) - sin({p1}) * cos({p2}) * cos({d})))".format(**_SIN)


@query("sphere_inverse", f"with {_P} select id, round({R} * {_V}, 4) d, round({_AZ}, 5) azimuth from p")
def sphere_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x) for x in ("lon1", "lat1", "lon2", "lat2")]
    return _pairs(spark, sf_dir).select("id", F.round(geo.vincenty_sphere(*c), 4).alias("d"), F.round(geo.sphere_azimuth(*c), 5).alias("azimuth"))


@query("sphere_direct", f"with {LOCATIONS}, s as (select id, lon, radians(lat) p, radians(id % 360) a, (100 + id % 5000) / {R} d from locations), t as (select *, sin(p) * cos(d) + cos(p) * sin(d) * cos(a) s from s) select id, round(degrees(radians(lon) + atan2(sin(a) * sin(d) * cos(p), cos(d) - sin(p) * s)), 8) lon, round(degrees(asin(least(1.0, s))), 8) lat from t")
def sphere_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = geo.sphere_direct(F.col("lon"), F.col("lat"), (F.col("id") % 360).cast("double"), (100 + F.col("id") % 5000).cast("double"))
    return locations(spark, sf_dir).select("id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query("xyz", f"with {LOCATIONS} select id, round(cos(radians(lat)) * cos(radians(lon)), 9) x, round(cos(radians(lat)) * sin(radians(lon)), 9) y, round(sin(radians(lat)), 9) z, round(lon, 6) lon from locations")
def xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = geo.unit_xyz(F.col("lon"), F.col("lat"))
    return locations(spark, sf_dir).select("id", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"), F.round(z, 9).alias("z"), F.round(geo.xyz_to_lonlat(x, y, z)[0], 6).alias("lon"))


@query("spheroid_xyz", f"with {LOCATIONS}, n as (select *, {geo.A} / sqrt(1 - {geo.ECCENTRICITY2!r} * pow(sin(radians(lat)), 2)) n from locations) select id, round((n + acc) * cos(radians(lat)) * cos(radians(lon)), 3) x, round((n * {geo.B * geo.B / (geo.A * geo.A)!r} + acc) * sin(radians(lat)), 3) z from n")
def spheroid_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _, z = geo.spheroid_xyz(F.col("lon"), F.col("lat"), F.col("acc"))
    return locations(spark, sf_dir).select("id", F.round(x, 3).alias("x"), F.round(z, 3).alias("z"))


_SX = HAVERSINE.format(r=R, x1="2.36", y1="48.86", x2="(2.36 + 0.01)", y2="48.86")
_SY = HAVERSINE.format(r=R, x1="2.36", y1="48.86", x2="2.36", y2="(48.86 + 0.01)")


@query("local_projection", f"with {LOCATIONS} select id, round((lon - 2.36) * {_SX} / 0.01, 3) x, round((lat - 48.86) * {_SY} / 0.01, 3) y from locations")
def local_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.local_projection(F.col("lon"), F.col("lat"), F.lit(2.36), F.lit(48.86))
    return locations(spark, sf_dir).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("hellinger", f"with {_P} select id, round(sqrt(greatest(0, least(1, 1 - 2 * sqrt(acc * acc * acc1 * acc1) / (acc * acc + acc1 * acc1) * exp(-pow({_H}, 2) / (4 * (acc * acc + acc1 * acc1)))))), 6) h from p")
def hellinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.haversine(*map(F.col, ("lon1", "lat1", "lon2", "lat2")))
    return _pairs(spark, sf_dir).select("id", F.round(prob.hellinger(d, F.pow("acc", F.lit(2)), F.pow("acc1", F.lit(2))), 6).alias("h"))


@query("vector_algebra", "select event_id id, round(user_id * value + value * (event_id % 7), 4) dot, round(sqrt(user_id * user_id + value * value), 6) norm, round(sqrt(pow(value - greatest(0, least(1, value / 10)) * 10, 2) + pow(user_id, 2)), 6) dist from events")
def vector_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"]
    u, v, m = F.col("user_id").cast("double"), F.col("value"), (F.col("event_id") % 7).cast("double")
    zero = F.lit(0.0)
    return e.select(F.col("event_id").alias("id"), F.round(geo.dot((u, v), (v, m)), 4).alias("dot"), F.round(geo.norm((u, v)), 6).alias("norm"), F.round(geo.segment_distance((v, u), (zero, zero), (F.lit(10.0), zero)), 6).alias("dist"))


@query("envelope", f"with {LOCATIONS} select user_id, min(lon) x0, max(lon) x1, min(lat) y0, max(lat) y1 from locations group by 1")
def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locations(spark, sf_dir).groupBy("user_id").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))


@query("tokenise", "select p_partkey, len(list_filter(regexp_split_to_array(p_name || '. - ' || p_brand, '[[:punct:]\\s•]+'), lambda t: t <> ''))::int n, array_to_string(list_filter(regexp_split_to_array(lower(p_name || '. - ' || p_brand), '[[:punct:]\\s•]+'), lambda t: t <> ''), '_') joined from part")
def tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables(spark, sf_dir)["part"]
    x = F.concat("p_name", F.lit(". - "), "p_brand")
    return p.select("p_partkey", F.size(text.tokens(x)).alias("n"), F.array_join(text.tokens(F.lower(x)), "_").alias("joined"))


@query("strip_accents", "select doc_id, strip_accents(text) t, lower(strip_accents(text)) n, regexp_replace(text, '\\s', ' ', 'g') s from documents")
def strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("text")
    return tables(spark, sf_dir)["documents"].select("doc_id", text.strip_accents(own).alias("t"), text.normalise(own).alias("n"), text.plain_spaces(own).alias("s"))


@query("levenshtein_sim", "select p_partkey, round(1 - levenshtein(p_name, p_type)::double / greatest(length(p_name), length(p_type)), 8) sim from part")
def levenshtein_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["part"].select("p_partkey", F.round(text.levenshtein_similarity(F.col("p_name"), F.col("p_type")), 8).alias("sim"))


@query("ngrams", "select p_partkey, array_to_string(list_sort(list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_concat(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)), list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))))))), ' ') gs from part")
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["part"].select("p_partkey", F.array_join(F.array_sort(text.grams(F.col("p_name"))), " ").alias("gs"))


@query("email_parse", "select c_custkey, 'C' || c_custkey as local, 'Example.ORG' as domain, 'mailto:c' || c_custkey || '@example.org' iri from customer")
def email_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)["customer"].withColumn("e", text.email_address(F.concat(F.lit(" C"), F.col("c_custkey").cast("string"), F.lit("@Example.ORG "))))
    return c.select("c_custkey", "e.local", "e.domain", "e.iri")


@query("display_names", "select c_custkey, c_name n, '' blank from customer")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.org"))
    quoted = F.concat(F.lit('"'), F.col("c_name"), F.lit(" ("), address, F.lit(')"'))
    return tables(spark, sf_dir)["customer"].select("c_custkey", text.display_name(quoted, address).alias("n"), text.display_name(address, address).alias("blank"))


@query("message_iri", "select o_orderkey, 'mid:' || o_orderkey || '.a@mail.example' iri from orders")
def message_iri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["orders"].select("o_orderkey", text.message_iri(F.concat(F.lit("<"), F.col("o_orderkey").cast("string"), F.lit(".a@mail.example>"))).alias("iri"))


@query("uuid_v3", "select c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::int % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21) u from (select c_custkey, md5(c_name) h from customer)")
def uuid_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["customer"].select("c_custkey", text.uuid3(F.col("c_name")).alias("u"))


@query("phone_numbers", "select c_custkey, 'tel:+336' || lpad(c_custkey::varchar, 8, '0') iri, 'cell' kind from customer")
def phone_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)["customer"].withColumn("p", text.phone(F.concat(F.lit("06 "), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))))
    return c.select("c_custkey", "p.iri", "p.kind")


@query("provider_domains", "select c_custkey, case c_custkey % 3 when 0 then 'free' when 1 then 'disposable' end kind from customer")
def provider_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    return tables(spark, sf_dir)["customer"].select("c_custkey", text.provider_kind(F.when(k == 0, "GMail.com").when(k == 1, "yopmail.com").otherwise("example.org")).alias("kind"))


@query("place_hierarchy", "select c_custkey, unnest(['country', 'region', 'street']) as level, unnest(['N' || c_nationkey, c_mktsegment, '4 Main St']) \"name\" from customer")
def place_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)["customer"]
    levels = text.place_hierarchy(F.lit("Main St"), F.lit("4"), F.lit(None).cast("string"), F.col("c_mktsegment"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    return c.select("c_custkey", F.explode(levels).alias("l")).select("c_custkey", "l.level", "l.name")


@query("duration_ms", "select l_orderkey, l_linenumber, epoch_ms(l_shipdate) - epoch_ms(o_orderdate) ms from lineitem join orders on l_orderkey = o_orderkey")
def duration_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", when.duration_millis(F.col("o_orderdate"), F.col("l_shipdate")).alias("ms"))


@query("date_parsing", "select event_id, epoch_us(ts) // 1000 ms, strftime(ts, '%Y-%m-%d') d, case when year(ts) = 1970 then '' else strftime(ts, '%Y-%m-%d') end b from events")
def date_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"]
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    offset = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000"))
    return e.select("event_id", when.epoch_millis(iso).alias("ms"), F.date_format(when.iso_offset(offset), "yyyy-MM-dd").alias("d"), when.birthday(F.to_date("ts")).alias("b"))


@query("lenient_dates", "select c_custkey, unnest(['date:2001-02-03', 'year:1999', 'monthday:--07-04']) d from customer")
def lenient_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["customer"].select("c_custkey", F.explode(F.array(F.lit("2/3/2001"), F.lit("1999"), F.lit("7/4"))).alias("x")).select("c_custkey", when.lenient_date(F.col("x")).alias("d"))


@query("soft_tf_idf", "select o_custkey, round(least(coalesce(sum((o_totalprice + o_orderkey) * (o_orderkey % 100) / 100.0) / nullif(sum(o_totalprice + o_orderkey), 0), 0), 1), 6) s from orders group by 1")
def soft_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.collect_list(F.struct(F.col("o_totalprice").alias("t1"), F.col("o_orderkey").cast("double").alias("t2"), (F.col("o_orderkey") % 100 / 100).alias("sim")))
    return tables(spark, sf_dir)["orders"].groupBy("o_custkey").agg(pairs.alias("p")).select("o_custkey", F.round(prob.soft_tf_idf(F.col("p")), 6).alias("s"))


@query("log_domain_shares", "select event_id, round(value / sum(value) over (partition by user_id), 8) share from events")
def log_domain_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"].withColumn("lw", prob.log_weight(F.col("value")))
    return prob.normalised(e, ["user_id"], "lw", "share").select("event_id", _r("share", 8))


# -- graphs and inference


def _same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of parts with equal first words within a brand, chained by key."""
    p = tables(spark, sf_dir)["part"]
    w = Window.partitionBy("p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_type").orderBy("p_partkey")
    return p.select(F.col("p_partkey").alias("src"), F.lag("p_partkey").over(w).alias("dst")).where("dst is not null")


_SAME = "same as (select * from (select p_partkey src, lag(p_partkey) over (partition by p_brand, split_part(p_name, ' ', 1), p_type order by p_partkey) dst from part) where dst is not null)"
_COMP = "walk as (select src a, dst b from both_ union select a, dst from walk join both_ on b = src), comp as (select a node, least(a, min(b)) component from walk group by a)"


@query("same_as_components", f"with recursive {_SAME}, both_ as (select * from same union select dst, src from same), {_COMP} select node, component from comp")
def same_as_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(_same(spark, sf_dir))


@query("equivalence_by_threshold", f"with recursive {_SAME}, s as (select *, ((src * 7 + dst) % 100) / 100.0 score from same), lv as (select * from (values (0.3), (0.6)) t(th)), both_ as (select th, src, dst from s, lv where score >= th union select th, dst, src from s, lv where score >= th), walk as (select th, src a, dst b from both_ union select w.th, a, dst from walk w join both_ e on w.th = e.th and b = src) select th::double threshold, a node, least(a, min(b)) component from walk group by th, a")
def equivalence_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _same(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"), (((F.col("src") * 7 + F.col("dst")) % 100) / 100).alias("score"))
    return resolve.threshold_classes(s, [0.3, 0.6])


@query("primary_facet", f"with recursive {_SAME}, both_ as (select * from same union select dst, src from same), {_COMP}, n as (select l_partkey node, count(*) n from lineitem group by 1), m as (select p_partkey node, coalesce(component, p_partkey) component, coalesce(n, 0) n from part left join comp on p_partkey = node left join n on n.node = p_partkey) select component, node facet, n from m qualify row_number() over (partition by component order by n desc, node) = 1")
def primary_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return inference.primary_facets(_same(spark, sf_dir), t["lineitem"].select(F.col("l_partkey").alias("node")), t["part"].select(F.col("p_partkey").alias("node")))


@query("ifp_same_as", "with d as (select doc_id, md5(text) h from documents) select '<urn:d:' || a.doc_id || '>' a, '<urn:d:' || b.doc_id || '>' b from d a join d b using (h)")
def ifp_same_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables(spark, sf_dir)["documents"]
    q = d.select(F.concat(F.lit("<urn:d:"), F.col("doc_id").cast("string"), F.lit(">")).alias("s"), F.lit(schema("email")).alias("p"), F.md5("text").alias("o"))
    return inference.shared_identifiers(q, [schema("email")])


@query("ifp_stars", "with d as (select doc_id, md5(text) h from documents) select '<urn:d:' || lpad(doc_id::varchar, 9, '0') || '>' src, '<urn:d:' || lpad(m::varchar, 9, '0') || '>' dst from (select doc_id, min(doc_id) over (partition by h) m from d) where doc_id <> m")
def ifp_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables(spark, sf_dir)["documents"]
    q = d.select(F.concat(F.lit("<urn:d:"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(">")).alias("s"), F.lit(schema("email")).alias("p"), F.md5("text").alias("o"))
    return inference.shared_identifier_stars(q, [schema("email")])


@query("differs_from_pairs", f"with recursive {_SAME}, both_ as (select * from same union select dst, src from same), {_COMP}, al as (select node, component from comp union all select p_partkey, p_partkey from part where p_partkey not in (select node from comp)), diff as (select x.component x, y.component y from (values (3, 5), (10, 11)) t(a, b) join al x on x.node = a join al y on y.node = b), bo as (select x, y from diff union select y, x from diff) select distinct p.node a, q.node b from bo join al p on p.component = x join al q on q.component = y")
def differs_from_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    different = spark.createDataFrame([(3, 5), (10, 11)], "src long, dst long")
    return inference.differing(_same(spark, sf_dir), different)


@query("transitive_closure", "with recursive e as (select p_partkey src, case when p_partkey = 0 then 5 else p_partkey // 3 end dst from part), w as (select src, dst from e union select w.src, e.dst from w join e on w.dst = e.src) select * from w")
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's ancestors in a ternary tree whose root is on a cycle."""
    key = F.col("p_partkey")
    return graph.transitive_closure(tables(spark, sf_dir)["part"].select(key.alias("src"), F.when(key == 0, F.lit(5).cast("long")).otherwise(F.floor(key / 3)).alias("dst")))


def _roads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Weighted edges between all parts, and the source."""
    p = tables(spark, sf_dir)["part"]
    n = p.count()
    edge = lambda dst, w: p.select(F.col("p_partkey").alias("src"), (dst % n).alias("dst"), w.cast("double").alias("w"))
    edges = edge(F.col("p_partkey") * 5 + 2, 1 + F.col("p_size") % 7).unionByName(edge(F.col("p_partkey") + 1, F.lit(9)))
    return edges, spark.createDataFrame([(0,)], "node long")


@query("shortest_paths", "with recursive n as (select count(*) n from part), e as (select p_partkey a, (p_partkey * 5 + 2) % n b, 1 + p_size % 7 w from part, n union all select p_partkey, (p_partkey + 1) % n, 9 from part, n), d as (select 0::bigint node, 0::bigint cost union select b, cost + w from d join e on node = a where cost + w <= 60) select node, min(cost)::double distance from d group by 1")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances up to the bound of the SQL."""
    return graph.shortest_paths(*_roads(spark, sf_dir), 60.0).select("node", "distance")


@query("shortest_paths_whole", "with recursive n as (select count(*) n from part), e as (select p_partkey a, (p_partkey * 5 + 2) % n b, 1 + p_size % 7 w from part, n union all select p_partkey, (p_partkey + 1) % n, 9 from part, n), d(node, cost) using key (node) as (select 0::bigint, 0::bigint union select node, min(cost) from (select b node, d.cost + w cost from d join e on node = a where d.cost + w < coalesce((select r.cost from recurring.d r where r.node = b), 9223372036854775807)) group by node) select node, cost::double distance from d")
def shortest_paths_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all parts, without a bound: the SQL keeps the least cost of each node only."""
    return graph.shortest_paths(*_roads(spark, sf_dir)).select("node", "distance")


@query("sub_class_closure", "select '<urn:c:' || c_custkey || '>' s, unnest(['<http://schema.org/Agent>', '<http://schema.org/Thing>']) o from customer")
def sub_class_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub, top = inference.SUB_CLASS, schema("Thing")
    ontology = spark.createDataFrame([(schema("Person"), sub, schema("Agent")), (schema("Agent"), sub, top)], "s string, p string, o string")
    q = quads(spark, sf_dir).where((F.col("p") == TYPE) & (F.col("o") == schema("Person")))
    return inference.rdfs_closure(q, ontology).select("s", "o")


@query("domain_range", "select s, o from (select distinct '<urn:o:' || o_orderkey || '>' s, '<urn:Message>' o from orders union select '<urn:c:' || o_custkey || '>', '<urn:Sender>' from orders)")
def domain_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ontology = spark.createDataFrame([(schema("sender"), inference.DOMAIN, "<urn:Message>"), (schema("sender"), inference.RANGE, "<urn:Sender>")], "s string, p string, o string")
    return inference.rdfs_closure(quads(spark, sf_dir).where(F.col("p") == schema("sender")), ontology).select("s", "o")


@query("owl_inverse_transitive", "with c as (select n_nationkey n, n_regionkey r from nation) select '<urn:r:' || r || '>' s, '<urn:contains>' p, '<urn:n:' || n || '>' o from c union select '<urn:n:' || n || '>', '<http://schema.org/containedInPlace>', '<urn:world>' from c union select '<urn:world>', '<urn:contains>', '<urn:r:' || r || '>' from c union select '<urn:world>', '<urn:contains>', '<urn:n:' || n || '>' from c")
def owl_inverse_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = schema("containedInPlace")
    rules = [("<urn:contains>", inference.INVERSE_OF, inside), (inside, TYPE, inference.TRANSITIVE)]
    facts = quads(spark, sf_dir).where(F.col("p") == inside).select("s", "p", "o")
    regions = facts.select(F.col("o").alias("s"), F.lit(inside).alias("p"), F.lit("<urn:world>").alias("o")).distinct()
    found = inference.owl_closure(facts.unionByName(regions).unionByName(spark.createDataFrame(rules, "s string, p string, o string")))
    return found.where(F.col("p").isin("<urn:contains>", inside))


@query("counted_inference", "with c as (select user_id s, sum(case when event_type = 'error' then -1 else 1 end) n from events group by 1) select s::varchar s, n::bigint n from c where n > 0")
def counted_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"]
    changes = e.select(F.col("user_id").cast("string").alias("s"), F.lit("p").alias("p"), F.lit("o").alias("o"), F.lit("g").alias("g"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("op"))
    support = spark.createDataFrame([], "s string, p string, o string, g string, n long")
    return inference.counted(support, changes)[0].select("s", "n")


# -- entity resolution


@query("name_weights", f"with {NAMES}, k as (select agent, name, msg_count = 0 c, sum(case when msg_count = 0 then 1 else msg_count end) n from names group by 1, 2, 3), s as (select *, sum(case when c then n else 0 end) over (partition by agent) cs, sum(case when c then 0 else n end) over (partition by agent) ms from k) select agent, \"name\", round(sum(case when cs = 0 or ms = 0 or cs / (cs + ms) >= 0.5 then n / (cs + ms) when c then n * 0.5 / cs else n * 0.5 / ms end), 8) weight from s group by 1, 2")
def name_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.name_weights(names(spark, sf_dir)).select("agent", "name", _r("weight", 8))


@query("term_idf", f"with {NAMES}, k as (select agent, name, msg_count = 0 c, sum(case when msg_count = 0 then 1 else msg_count end) n from names group by 1, 2, 3), s as (select *, sum(case when c then n else 0 end) over (partition by agent) cs, sum(case when c then 0 else n end) over (partition by agent) ms from k), w as (select agent, name, sum(case when cs = 0 or ms = 0 or cs / (cs + ms) >= 0.5 then n / (cs + ms) when c then n * 0.5 / cs else n * 0.5 / ms end) weight from s group by 1, 2), t as (select agent, unnest(list_distinct(list_filter(regexp_split_to_array(lower(name), '[[:punct:]\\s]+'), lambda x: x <> ''))) term, weight from w), g as (select agent, term, least(sum(weight), 1) weight from t group by 1, 2) select term, round(ln((select count(distinct agent) from g) / sum(weight)), 6) idf from g group by 1")
def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.term_idf(resolve.term_weights(resolve.name_weights(names(spark, sf_dir)))).select("term", _r("idf"))


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_concat(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)), list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))))))"


@query("blocking_pairs", f"with n as (select p_name t, min(p_partkey) id, {_GRAMS.format('p_name')} gs from part group by 1) select a.id q, b.id e, len(list_intersect(a.gs, b.gs))::bigint n_common from n a, n b where len(list_intersect(a.gs, b.gs)) >= greatest(1, floor(len(a.gs) * 70 / 100))")
def blocking_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables(spark, sf_dir)["part"].groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("id"))
    return relational.blocking_pairs(n, n, 70)


@query("max_merge_scores", "select least(o_custkey, o_orderkey % 500) a, greatest(o_custkey, o_orderkey % 500) b, max(o_totalprice) score from orders group by 1, 2")
def max_merge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.max_merge(tables(spark, sf_dir)["orders"].select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 500).alias("b"), F.col("o_totalprice").alias("score")))


@query("samples_truth", f"with recursive {_SAME}, both_ as (select * from same union select dst, src from same), {_COMP} select s.a, s.b, coalesce(x.component, s.a) = coalesce(y.component, s.b) same from (select p_partkey a, (p_partkey * 13) % 200 b from part) s left join comp x on x.node = s.a left join comp y on y.node = s.b")
def samples_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables(spark, sf_dir)["part"].select(F.col("p_partkey").alias("a"), ((F.col("p_partkey") * 13) % 200).alias("b"))
    return resolve.sample_truth(samples, graph.connected_components(_same(spark, sf_dir)))


@query("missing_name_parts", "select c_custkey agent from customer where c_custkey % 10 < 3 or c_custkey % 7 < 2")
def missing_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)["customer"]
    part = lambda kind, w: c.select(F.col("c_custkey").alias("agent"), F.lit(kind).alias("part_type"), F.col("c_name").alias("part"), w.alias("weight"))
    return resolve.missing_name_parts(part("given", F.col("c_custkey") % 10 / 10).unionByName(part("family", F.col("c_custkey") % 7 / 7)))


@query("agent_match")
def agent_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    agents = t["supplier"].select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("agent"), F.col("s_name").alias("name"), F.lit(2).cast("long").alias("msg_count"))
    doubles = t["supplier"].select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("agent"), F.replace(F.lower("s_name"), F.lit("#"), F.lit(" nr ")).alias("name"), F.lit(0).cast("long").alias("msg_count"))
    different = spark.createDataFrame([("s3", "t3")], "src string, dst string")
    return resolve.match_agents(agents.unionByName(doubles), different)


@query("paris", "with c as (select c_custkey k, c_custkey % 2 = 0 even from customer), n as (select 1 - 0.97007 * 0.9 pn, 1 - 0.80435 * (1 - 0.9) neg) select 'a' || k x, 'b' || k x2, round(case when even then (1 - (1 - 0.99) * pn) * neg else (1 - pn) * (1 - 0.87314) * neg end::double, 6) score from c, n union all select 'b' || k, 'a' || k, round(case when even then (1 - (1 - 0.99) * pn) * neg else (1 - pn) * neg end::double, 6) from c, n")
def paris(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)["customer"]
    key = F.col("c_custkey")
    fact = lambda x, p, y: c.select(x.alias("x"), F.lit(p).alias("p"), y.alias("y"))
    one, two = F.concat(F.lit("a"), key.cast("string")), F.concat(F.lit("b"), key.cast("string"))
    mail = F.concat(F.lit("m"), key.cast("string"))
    facts = fact(one, "email", mail).unionByName(fact(one, "name", F.col("c_name"))).unionByName(fact(two, "name", F.lower("c_name"))).unionByName(c.where("c_custkey % 2 = 0").select(two.alias("x"), F.lit("email").alias("p"), mail.alias("y")))
    eq = c.select(F.col("c_name").alias("y"), F.lower("c_name").alias("y2"), F.lit(0.9).alias("eq"))
    return resolve.paris(facts, eq.unionByName(eq.select(F.col("y2").alias("y"), F.col("y").alias("y2"), "eq"))).select("x", "x2", _r("score"))


@query("stays_three_stage")
def stays_three_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stays.stays(locations(spark, sf_dir), "user_id")


@query("stays_sequential")
def stays_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stays.stays(locations(spark, sf_dir), "user_id", stages=1)


@query("jaro_winkler", "select p_partkey, round(case when j < 0.7 then j else j + least(0.1, 1.0::double / greatest(length(a), length(b))) * k * (1 - j) end, 6) sim from (select *, (select count(*) from range(1, least(length(a), length(b)) + 1) t(i) where substr(a, 1, i) = substr(b, 1, i)) k from (select p_partkey, p_name a, lower(p_type) b, jaro_similarity(p_name, lower(p_type)) j from part))")
def jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["part"].select("p_partkey", F.round(text.jaro_winkler(F.col("p_name"), F.lower("p_type")), 6).alias("sim"))


@query("geo_uri_round_trip", f"with {LOCATIONS} select id, true same from locations")
def geo_uri_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = geo.parse_geo_uri(geo.geo_uri(F.col("lon"), F.col("lat"), uncertainty=F.col("acc")))
    return locations(spark, sf_dir).withColumn("b", back).select("id", ((F.col("b.lon") == F.col("lon")) & (F.col("b.lat") == F.col("lat")) & (F.col("b.uncertainty") == F.col("acc"))).alias("same"))


@query("text_alignment", "with w as (select p_partkey, string_split(upper(p_name), ' ') ws from part), u as (select p_partkey, ws, unnest(range(1, len(ws) + 1)) i from w) select p_partkey, ws[i] part, coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x) + 1)), 0)::int lo, (coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x) + 1)), 0) + length(ws[i]) - 1)::int hi from u")
def text_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables(spark, sf_dir)["part"].select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit("."))).alias("local"), F.array_sort(F.split(F.upper("p_name"), " ")).alias("parts"))
    found = resolve.local_part_matches(p)
    return found.select("p_partkey", F.explode("found").alias("m")).select("p_partkey", "m.part", "m.lo", "m.hi")


@query("weighted_samples", "with e as (select event_type element, count(*) weight from events group by 1), r as (select element, sum(weight) over (order by substr(md5(element), 1, 2), element) t, weight from e), d as (select floor((('0x' || substr(md5('7|' || i), 1, 13))::bigint::double / 4503599627370496) * (select sum(weight) from e))::bigint x from range(10000) s(i)) select element event_type, count(*) drawn from d join r on x >= t - weight and x < t group by 1")
def weighted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)["events"].groupBy(F.col("event_type").alias("element")).agg(F.count("*").alias("weight"))
    return prob.weighted_draws(e, 10_000, 7).groupBy(F.col("element").alias("event_type")).agg(F.count("*").alias("drawn"))


@query("stratified_samples", f"with {_SAME}, s as (select src a, dst b, ((src * 7 + dst) % 100) / 100.0 score from same), l as (select *, floor(score * 4) / 4 threshold from s) select threshold::double threshold, a, b, score::double score from l qualify row_number() over (partition by threshold order by md5('42|' || a || '|' || b)) <= 10")
def stratified_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _same(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"), (((F.col("src") * 7 + F.col("dst")) % 100) / 100).alias("score"))
    return resolve.stratified_samples(s, [0.0, 0.25, 0.5, 0.75], 10)


# -- places


@query("reverse_geocode", f"with {LOCATIONS}, g as (select s_suppkey id, 2.35::double + 0.0008::double * (s_suppkey % 50)::double lon, 48.85::double + 0.0005::double * (s_suppkey % 37)::double lat from supplier), d as (select p.id, g.id place, {HAVERSINE.format(r=R, x1='p.lon', y1='p.lat', x2='g.lon', y2='g.lat')} d from locations p, g) select id, place, round(d, 2) distance from d where d <= 400 qualify row_number() over (partition by id order by d, place) = 1")
def reverse_geocode(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gazetteer(spark, sf_dir)
    return places.reverse(locations(spark, sf_dir), g, 400.0).select("id", "place", _r("distance", 2))


def _gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(spark, sf_dir)["supplier"]
    return s.select(F.col("s_suppkey").alias("place"), F.col("s_name").alias("name"), (F.lit(2.35) + F.lit(0.0008) * (F.col("s_suppkey") % 50)).alias("lon"), (F.lit(48.85) + F.lit(0.0005) * (F.col("s_suppkey") % 37)).alias("lat"))


@query("direct_geocode", "select s_suppkey q, s_suppkey place from supplier")
def direct_geocode(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables(spark, sf_dir)["supplier"].select(F.col("s_suppkey").alias("q"), F.lower("s_name").alias("text"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"))
    return places.direct(asked, _gazetteer(spark, sf_dir)).where("rank = 1").select("q", "place")


@query("geocoder_fallback", "select c_custkey q, case when c_custkey % 2 = 0 then 'place' when c_custkey % 3 = 0 then 'address' end src from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0")
def geocoder_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)["customer"].select(F.col("c_custkey").alias("q"))
    a = c.where("q % 2 = 0").withColumn("src", F.lit("place"))
    b = c.where("q % 3 = 0").withColumn("src", F.lit("address"))
    return places.first_source([a, b], "q").select("q", "src")


@query("place_same_as", f"select '<urn:p:' || c_custkey || '>' s, case when c_custkey % 3 = 0 then '<urn:uncertain>' else '<urn:places>' end g from customer where c_custkey % 4 <> 0")
def place_same_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables(spark, sf_dir)["customer"].select("c_custkey", F.concat(F.lit("<urn:p:"), F.col("c_custkey").cast("string"), F.lit(">")).alias("place"))
    hit = lambda n, where: c.where(where).select("place", F.concat(F.lit(f"<urn:f{n}:"), F.col("c_custkey").cast("string"), F.lit(">")).alias("feature"))
    found = hit(1, "true").unionByName(hit(2, "c_custkey % 3 = 0"))
    parts = c.where("c_custkey % 4 = 0").select("place")
    different = spark.createDataFrame([("<x>", DIFFERENT_FROM, "<y>", "<g>")], "s string, p string, o string, g string")
    return places.place_links(found, parts, different).where("s like '<urn:p:%'").select("s", "g").distinct()


# -- ranked lists, phrases, parts


@query("merge_ranked_lists", "with o as (select o_custkey, o_orderkey, o_totalprice / 25 d, o_orderpriority < '3' as one from orders), r as (select *, row_number() over (partition by o_custkey, one order by d, o_orderkey) k from o) select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by d, not one, k)::int as rank from r where d <= 10000")
def merge_ranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables(spark, sf_dir)["orders"].select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 25).alias("distance"), (F.col("o_orderpriority") < "3").alias("one"))
    ranked = o.withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey", "one").orderBy("distance", "o_orderkey")))
    return relational.merge_ranked_lists(ranked.where("one").drop("one"), ranked.where("not one").drop("one"), "o_custkey", "rank").select("o_custkey", "o_orderkey", "rank")


@query(
    "phrase_search",
    f"with n as (select p_name t, min(p_partkey) id, {_GRAMS.format('p_name')} gs from part group by 1), x as (select p_partkey id, string_split(p_type || ' ' || p_name, ' ') w from part), "
    "win as (select id, i, c, array_to_string(w[i:i + c - 1], ' ') ph from (select *, unnest(range(1, len(w) + 1)) i from x), range(1, 4) t(c) where i + c - 1 <= len(w)), "
    f"ph as (select ph, {_GRAMS.format('ph')} gs from (select distinct ph from win)), h as (select ph, n.id entity from ph, n where len(list_intersect(ph.gs, n.gs)) >= greatest(1, floor(len(ph.gs) * 80 / 100))), "
    "hit as (select win.*, entity from win join h using (ph)), ok as (select distinct id, i, c from hit), "
    "met as (select id, i, c, entity from hit x where (c < 2 or exists (from ok where ok.id = x.id and ok.i = x.i and ok.c = 1)) and (c < 3 or exists (from ok where ok.id = x.id and ok.i = x.i and ok.c = 2))) "
    'select id, (i - 1)::int "index", c::int "count", entity from met x where not exists (from met y where y.id = x.id and y.entity = x.entity and y.c > x.c and y.i <= x.i and x.i + x.c <= y.i + y.c)',
)
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables(spark, sf_dir)["part"]
    entries = p.groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("id"))
    return relational.phrase_search(p.select(F.col("p_partkey").alias("id"), F.concat("p_type", F.lit(" "), "p_name").alias("text")), entries)


@query("part_types", "with recursive e as (select 'n' || p_name a, 'b' || p_brand b, min(1 + p_size % 5) w from part group by 1, 2), both_ as (select a, b, w from e union all select b, a, w from e), k as (select 'b' || min(p_brand) part, 'family' as type from part union all select 'b' || max(p_brand), 'given' from part), d as (select type, part, 0::bigint c from k union select type, b, c + w from d join both_ on a = part where c + w <= 12), m as (select part, type, min(c)::double distance from d group by 1, 2) select part, type, distance from m qualify row_number() over (partition by part order by distance, type) = 1")
def part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types up to the bound of the SQL."""
    return resolve.part_types(*_evidence(spark, sf_dir), 12.0)


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = tables(spark, sf_dir)["part"]
    name, brand = F.concat(F.lit("n"), F.col("p_name")), F.concat(F.lit("b"), F.col("p_brand"))
    evidence = p.groupBy(name.alias("a"), brand.alias("b")).agg(F.min(1 + F.col("p_size") % 5).alias("cost"))
    ends = p.agg(F.min(brand).alias("family"), F.max(brand).alias("given"))
    known = ends.select(F.explode(F.array(F.struct(F.col("family").alias("part"), F.lit("family").alias("type")), F.struct(F.col("given").alias("part"), F.lit("given").alias("type")))).alias("x")).select("x.*")
    return evidence, known


@query("part_types_whole", "with recursive e as (select 'n' || p_name a, 'b' || p_brand b, min(1 + p_size % 5) w from part group by 1, 2), both_ as (select a, b, w from e union all select b, a, w from e), k as (select 'b' || min(p_brand) part, 'family' as type from part union all select 'b' || max(p_brand), 'given' from part), d(type, part, c) using key (type, part) as (select type, part, 0::bigint from k union select type, part, min(c) from (select d.type, b part, d.c + w c from d join both_ on a = d.part where d.c + w < coalesce((select r.c from recurring.d r where r.type = d.type and r.part = b), 9223372036854775807)) group by type, part) select part, type, c::double distance from d qualify row_number() over (partition by part order by c, type) = 1")
def part_types_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of all parts that evidence joins to a known one, at any cost."""
    return resolve.part_types(*_evidence(spark, sf_dir))


@query("deduplicate_parts")
def deduplicate_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = names(spark, sf_dir).select("agent", F.explode(text.tokens(F.lower("name"))).alias("part"), F.col("msg_count").cast("double").alias("weight"))
    return resolve.deduplicate_parts(n).select("agent", "part", _r("weight"))


@query("global_clusters")
def global_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stays.global_clusters(tables(spark, sf_dir)["events"].select(F.col("event_id").alias("id"), (F.lit(2.0) + F.col("value") / 500.0).alias("lon"), (F.lit(48.0) + (F.col("event_id") * 7919 % 10007).cast("double") / 10007.0).alias("lat")), 100.0)


@query("durations", "select l_orderkey, l_linenumber, case when ms < 0 then '-' else '' end || printf('P0Y0M%dDT%dH%dM%d.%03dS', s // 86400000, s % 86400000 // 3600000, s % 3600000 // 60000, s % 60000 // 1000, s % 1000) iso from (select *, abs(ms) s from (select l_orderkey, l_linenumber, epoch_ms(l_shipdate) - epoch_ms(o_orderdate) ms from lineitem join orders on l_orderkey = o_orderkey))")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    met = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select("l_orderkey", "l_linenumber", when.duration_iso(F.col("o_orderdate"), F.col("l_shipdate")).alias("iso"))


@query("text_pieces", "select p_partkey, p_name || '- ' || p_brand plain, len(list_filter(ps, lambda x: not regexp_matches(x, '^[[:punct:]\\s•]+$')))::int n_tokens, array_to_string(ps, '|') pieces from (select *, regexp_extract_all(p_name || '- ' || p_brand, '[[:punct:]\\s•]+|[^[:punct:]\\s•]+') ps from part)")
def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables(spark, sf_dir)["part"].withColumn("x", F.concat("p_name", F.lit("- "), "p_brand"))
    pieces = text.tokens_and_separators(F.col("x"))
    quoted = F.concat(F.lit("\"'"), F.col("x"), F.lit("'\""))
    return p.select("p_partkey", text.unquote(quoted).alias("plain"), F.size(F.filter(pieces, lambda t: t["is_token"])).alias("n_tokens"), F.array_join(F.transform(pieces, lambda t: t["text"]), "|").alias("pieces"))
