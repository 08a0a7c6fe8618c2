"""Registered queries over the driver's tables and their DuckDB twins.

Roles: events are a forcing (T = day, F = event type), nations a grid (Y = region, X = rank in the
region), embeddings cohort and layer arrays, lineitems predictions and observations.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import biology, random_streams, transport
from ..plans.timegrid import TimeGrid, time_of
from ..plans.storage import shared_dir, written
from ..sources import chunks
from . import align, buckets, coordinates, distinct_set, keysets, metrics, objectives, recurrence, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DAY = 86400.0


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(func: Query) -> Query:
        QUERIES[func.__name__] = func
        if sql:
            ORACLE_SQL[func.__name__] = sql
        return func

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a side of a join may have to be sent to every task.
LITTLE = 10_000


def little(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, if it is found to have no more than ``LITTLE`` rows; else as it is."""
    return F.broadcast(df) if df.limit(LITTLE + 1).count() <= LITTLE else df


def r6(c, name: str):
    """Rounded for comparison, without negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


# ---- time and forcings ----


def event_grid(spark: SparkSession, sf_dir: str, dt: str = "1d") -> TimeGrid:
    span = table(spark, sf_dir, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    first = span["a"].replace(hour=0, minute=0, second=0, microsecond=0)
    last = span["b"].replace(hour=0, minute=0, second=0, microsecond=0)
    return TimeGrid.of(first, last, dt)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value by day and type."""
    days = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("T"), "event_type", "value")
    return days.groupBy("T", "event_type").agg(F.avg("value").alias("value"))


SPAN = "span as (select date_trunc('day', min(ts)) as a, date_trunc('day', max(ts)) as b from events)"
DAILY = "daily as (select date_trunc('day', ts) as T, event_type, avg(value) as value from events group by 1, 2)"
#: Every event is a source; targets are every six hours, also before the first source of a type.
SPARSE = "src as (select event_type as k, ts as t, value as v from events)"
TARGETS = (
    "tgt as (select k, t from (select distinct event_type as k from events), "
    "(select unnest(generate_series(a, b - interval 6 hour, interval 6 hour)) as t from span))"
)


@query(f"with {SPAN} select i as t_idx, strftime(a + to_days(i::int), '%Y-%m-%d') as day, i // 7 as chunk from span, lateral (select unnest(generate_series(0, date_diff('day', a, b) - 1)) as i)")
def timegrid_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = event_grid(spark, sf_dir).frame(spark)
    return grid.select("t_idx", F.date_format("T", "yyyy-MM-dd").alias("day"), F.floor(F.col("t_idx") / 7).alias("chunk"))


@query(f"with {DAILY} select strftime(T, '%Y-%m-%d') as day, event_type, round(value, 6) as mean_value from daily")
def forcing_daily_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).select(F.date_format("T", "yyyy-MM-dd").alias("day"), "event_type", r6(F.col("value"), "mean_value"))


def _aligned(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    grid = event_grid(spark, sf_dir, "6h")
    source = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("T"), "value")
    got = align.as_of(source, grid.frame(spark).select("T"), method, ["event_type"])
    return got.select("event_type", F.date_format("T", "yyyy-MM-dd HH").alias("hour"), r6(F.col("value"), "value"))


_BRACKET = f"""with {SPAN}, {DAILY}, {SPARSE}, {TARGETS},
b as (select k, t, (select max(s.t) from src s where s.k = tgt.k and s.t <= tgt.t) as lo, (select min(s.t) from src s where s.k = tgt.k and s.t >= tgt.t) as hi from tgt),
e as (select k, min(t) as e0, max(t) as e3, (list_sort(list(t)))[2] as e1, (list_sort(list(t)))[-2] as e2 from src group by k)"""


@query(_BRACKET + " select b.k as event_type, strftime(b.t, '%Y-%m-%d %H') as hour, round(s.v, 6) as value from b left join src s on s.k = b.k and s.t = b.lo")
def forcing_ffill_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, "ffill")


@query(
    _BRACKET + """ select b.k as event_type, strftime(b.t, '%Y-%m-%d %H') as hour, round(s.v, 6) as value from b left join src s on s.k = b.k
    and s.t = case when lo is null then hi when hi is null then lo when b.t - lo < hi - b.t then lo else hi end"""
)
def forcing_nearest_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, "nearest")


@query(
    _BRACKET + """, p as (select b.k, b.t, case when lo is null then e0 when hi is null then e2 else lo end as x0, case when lo is null then e1 when hi is null then e3 else hi end as x1
    from b join e on e.k = b.k)
    select p.k as event_type, strftime(p.t, '%Y-%m-%d %H') as hour,
    round(case when x0 = x1 then s0.v else s0.v + (s1.v - s0.v) * (epoch_us(p.t) - epoch_us(x0))::double / (epoch_us(x1) - epoch_us(x0))::double end, 6) as value
    from p join src s0 on s0.k = p.k and s0.t = x0 join src s1 on s1.k = p.k and s1.t = x1"""
)
def forcing_linear_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, "linear")


@query("select event_type, min(ts) <= timestamp '2024-01-02' and max(ts) >= timestamp '2024-01-29' as covers from events group by event_type")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select("event_type", ((F.col("a") <= F.lit("2024-01-02").cast("timestamp")) & (F.col("b") >= F.lit("2024-01-29").cast("timestamp"))).alias("covers"))


@query(
    """with h as (select event_type, date_trunc('hour', ts) as t, count(*) as n from events group by 1, 2),
    s as (select unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), interval 1 hour)) as t from events),
    m as (select k.event_type, count(*) as n from (select distinct event_type from h) k, s where not exists (select 1 from h where h.event_type = k.event_type and h.t = s.t) group by 1)
    select h.event_type, coalesce(any_value(m.n), 0)::bigint as n_missing, sum(h.n - 1)::bigint as n_repeated from h left join m on m.event_type = h.event_type group by 1"""
)
def forcing_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours without an event and events beyond the first of their hour, by type."""
    hours = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("T"), "event_type")
    ends = table(spark, sf_dir, "events").agg(F.date_trunc("day", F.min("ts")).alias("a"), F.date_trunc("day", F.max("ts")).alias("b"))
    steps = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("T"))
    return align.completeness(hours, steps, ["event_type"])


@query(
    """select 'events' as source, count(*) filter (where value is null or isnan(value)) as bad from events
    union all select 'lineitem', count(*) filter (where l_quantity is null or isnan(l_quantity)) from lineitem
    union all select 'supplier', count(*) filter (where s_acctbal is null or isnan(s_acctbal)) from supplier"""
)
def nan_null_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, c in (("events", "value"), ("lineitem", "l_quantity"), ("supplier", "s_acctbal")):
        one = table(spark, sf_dir, name).agg(F.sum((F.col(c).isNull() | F.isnan(c)).cast("long")).alias("bad")).select(F.lit(name).alias("source"), "bad")
        out = one if out is None else out.unionByName(one)
    return out


#: (dimension, source, table, column); the customers of orders and events are some of all customers.
KEYS = (
    ("region", "nation", "nation", "n_regionkey"), ("region", "region", "region", "r_regionkey"), ("nation", "nation", "nation", "n_nationkey"), ("nation", "supplier", "supplier", "s_nationkey"),
    ("customer", "customer", "customer", "c_custkey"), ("customer", "orders", "orders", "o_custkey"), ("customer", "events", "events", "user_id"),
    ("supplier", "supplier", "supplier", "s_suppkey"), ("supplier", "lineitem", "lineitem", "l_suppkey"),
)
_KEYS = "keys as (" + " union ".join(f"select '{d}' as dim, '{s}' as source, {c}::varchar as key from {t}" for d, s, t, c in KEYS) + ")"


def _key_sources(spark: SparkSession, sf_dir: str) -> list[keysets.Source]:
    return [(dim, source, table(spark, sf_dir, name), c) for dim, source, name, c in KEYS]


@query(
    f"""with {_KEYS}, n as (select dim, source, count(*) as n from keys group by 1, 2), k as (select dim, key, count(*) as held from keys group by 1, 2), s as (select dim, count(distinct source) as many from keys group by 1)
    select dim, not exists (select 1 from k join s on s.dim = k.dim where k.dim = n.dim and k.held < s.many) as aligned, max(n) as size from n group by dim"""
)
def grid_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sources of a dimension have the same keys, not just as many."""
    return keysets.alignment(_key_sources(spark, sf_dir))


@query(
    f"""with {_KEYS}, p as (select distinct a.dim, a.source, b.key from keys a join keys b on a.dim = b.dim)
    select dim, source, count(*) as n_lacking, min(key) as first_lacking from p where not exists (select 1 from keys where keys.dim = p.dim and keys.source = p.source and keys.key is not distinct from p.key)
    group by 1, 2"""
)
def key_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys each source lacks that another one of its dimension has, and the first by text."""
    found = keysets.conflicts(_key_sources(spark, sf_dir))
    return found.groupBy("dim", "source").agg(F.count("*").alias("n_lacking"), F.min("key").alias("first_lacking"))


def _day_sources(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str]]:
    day = lambda name, c: (table(spark, sf_dir, name).select(F.to_date(c).alias("day")), "day")
    return {"events": day("events", "ts"), "orders": day("orders", "o_orderdate"), "lineitem": day("lineitem", "l_shipdate")}


_DAYS = """days as (select ts::date as day, 'events' as source from events union select o_orderdate::date, 'orders' from orders union select l_shipdate::date, 'lineitem' from lineitem)"""


@query(f"with {_DAYS} select strftime(day, '%Y-%m-%d') as day, dense_rank() over (order by day) - 1 as idx, count(*) as n_sources from days group by day")
def coordinates_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index over the days of three tables."""
    found = coordinates.coordinates(_day_sources(spark, sf_dir))
    return found.select(F.date_format("value", "yyyy-MM-dd").alias("day"), "idx", F.size("sources").cast("long").alias("n_sources"))


@query(
    f"""with {_DAYS}, lack as (select s.source, d.day from (select distinct source from days) s, (select distinct day from days) d where not exists (select 1 from days where days.source = s.source and days.day = d.day))
    select source, count(*) as n_missing, strftime(min(day), '%Y-%m-%d') as first_missing, strftime(max(day), '%Y-%m-%d') as last_missing from lack group by 1"""
)
def coordinate_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that each of three tables lacks; a table that lacks none is left out."""
    sources = _day_sources(spark, sf_dir)
    found = coordinates.disagreements(coordinates.coordinates(sources), list(sources)).where("n_missing > 0")
    return found.select("source", "n_missing", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_missing", "last_missing")])


# ---- alignment by dimension names and coordinates ----


@query(
    """select n_nationkey, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as n, round(sum(value) * any_value(r_regionkey), 6) as scaled
    from nation join region on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join events on user_id = c_custkey group by 1, 2"""
)
def dim_broadcast_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = table(spark, sf_dir, "nation").join(little(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    users = table(spark, sf_dir, "customer").join(little(grid), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey", "r_regionkey")
    flows = table(spark, sf_dir, "events").join(users, F.col("user_id") == F.col("c_custkey"))
    return flows.groupBy("n_nationkey", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), r6(F.sum("value") * F.first("r_regionkey"), "scaled")
    )


@query(
    """with c as (select n_nationkey as idx, n_nationkey * 400.0 - 1000.0 as value from nation)
    select s_suppkey, (select arg_min(idx, struct_pack(d := abs(s_acctbal - value), v := -value)) from c)::int as idx from supplier"""
)
def nearest_coord_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    coords = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), (F.col("n_nationkey") * 400.0 - 1000.0).alias("value"))
    return align.nearest_index(table(spark, sf_dir, "supplier"), coords, "s_acctbal").select("s_suppkey", F.col("s_acctbal_idx").alias("idx"))


_COORDS = "c as (select n_nationkey as idx, n_nationkey * 400.0::double - 1000.0::double as value from nation)"


def _coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), (F.col("n_nationkey") * 400.0 - 1000.0).alias("value"))


@query(
    f"""with {_COORDS} select s_suppkey, coalesce((select arg_min(idx, struct_pack(d := abs(s_acctbal - value), v := -value)) from c where abs(s_acctbal - value) <= 100), -1)::int as idx
    from supplier"""
)
def nearest_coord_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates within a tolerance; suppliers further from any get -1."""
    got = align.nearest_index(table(spark, sf_dir, "supplier"), _coords(spark, sf_dir), "s_acctbal", tolerance=100.0)
    return got.select("s_suppkey", F.coalesce("s_acctbal_idx", F.lit(-1)).alias("idx"))


@query(
    f"""with {_COORDS} select count(*) filter (where idx is not null) as found, count(*) filter (where idx is null) as missing
    from (select o_orderkey, (select min(idx) from c where value = round(o_totalprice / 400) * 400 - 1000 - case when o_orderkey % 3 = 0 then 1 else 0 end) as idx from orders)"""
)
def exact_coord_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact coordinates: order totals on the grid, a third of them moved off it; what is not on it has none."""
    off = F.when(F.col("o_orderkey") % 3 == 0, 1.0).otherwise(0.0)
    points = table(spark, sf_dir, "orders").select(F.round(F.col("o_totalprice") / 400).alias("r"), off.alias("off")).select((F.col("r") * 400 - 1000 - F.col("off")).alias("x"))
    got = align.nearest_index(points, _coords(spark, sf_dir), "x", method="exact")
    return got.agg(F.count("x_idx").alias("found"), F.count(F.when(F.col("x_idx").isNull(), 1)).alias("missing"))


@query(
    f"""with {SPAN}, {DAILY}, o as (select event_id, ts, event_type, value from events),
    n as (select o.*, (select arg_min(d.T, struct_pack(x := abs(epoch_us(o.ts) - epoch_us(d.T)), y := -epoch_us(d.T))) from (select distinct T from daily) d) as near from o)
    select n.event_id, round(n.value, 6) as obs, round(d.value, 6) as pred from n left join daily d on d.T = n.near and d.event_type = n.event_type"""
)
def sparse_obs_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = event_grid(spark, sf_dir).start
    model = daily(spark, sf_dir).withColumn("t_idx", F.datediff("T", F.lit(start)))
    days = model.select(F.col("t_idx").alias("idx"), F.col("T").alias("value"))
    obs = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("T"), "event_type", F.col("value").alias("obs"))
    got = align.extract_observations(model.drop("T"), obs, {"T": days}, "obs", "value", carried=("event_id",))
    return got.select("event_id", r6(F.col("obs"), "obs"), r6(F.col("pred"), "pred"))


@query(
    f"""select event_id, round(value * (1 + 0.1::double * (2 * {random_streams.uniform_sql(0, 'noise', 'event_id')} - 1)), 6) as obs from events
    where {random_streams.uniform_sql(0, 'observed', 'event_id')} < 0.05"""
)
def sampled_noisy_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event in twenty as an observation, disturbed by up to a tenth."""
    got = align.sample_observations(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", "value", 0.05, 0.1)
    return got.select("event_id", r6(F.col("value"), "obs"))


PRIORS = {
    "efficiency": random_streams.even(0.1, 0.4),
    "offset": random_streams.normal(-2.0, 3.0),
    "rate": random_streams.log_normal(-1.0, 0.5),
    "spread": random_streams.half_normal(2.0),
    "threshold": random_streams.truncated_normal(0.2, 0.1, 0.5, 1.0),
}
_U = {n: random_streams.uniform_sql(7, n, "s_suppkey") for n in PRIORS}
_Z = random_streams.normal_quantile_sql
#: Probabilities of a standard normal below -8 and below -3, the bounds of the truncated prior reflected.
_TAILS = [0.5 * math.erfc(z / math.sqrt(2)) for z in (8.0, 3.0)]
_DRAWS = f"""draws as (select s_suppkey, 0.1::double + 0.3::double * {_U['efficiency']} as efficiency, -2::double + 3::double * {_Z(_U['offset'])} as offset_, exp(-1::double + 0.5::double * {_Z(_U['rate'])}) as rate,
  2::double * {_Z(f"(0.5::double + 0.5::double * {_U['spread']})")} as spread, 0.2::double - 0.1::double * {_Z(f"({_TAILS[0]!r}::double + ({_TAILS[1]!r}::double - {_TAILS[0]!r}::double) * (1 - {_U['threshold']}))")} as threshold from supplier)"""


@query(f"with {_DRAWS} select s_suppkey, round(efficiency, 6) as efficiency, round(offset_, 6) as \"offset\", round(rate, 6) as rate, round(spread, 6) as spread, round(threshold, 6) as threshold from draws")
def prior_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start for each supplier: one draw of each of five priors."""
    got = random_streams.sample(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", PRIORS, seed=7)
    return got.select("s_suppkey", *[r6(F.col(n), n) for n in PRIORS])


@query(
    f"""with {_DRAWS}, l as (select *, ln(2 * pi()) / 2 as c from draws)
    select s_suppkey, round(-ln(0.3::double) - ((offset_ + 2) / 3) ** 2 / 2 - ln(3::double) - c - ((ln(rate) + 1) / 0.5::double) ** 2 / 2 - ln(0.5::double) - c - ln(rate)
      + ln(2::double) - (spread / 2) ** 2 / 2 - ln(2::double) - c - ((threshold - 0.2::double) / 0.1::double) ** 2 / 2 - ln(0.1::double) - c - ln({_TAILS[1]!r}::double - {_TAILS[0]!r}::double), 6) as log_density,
      case when s_suppkey % 2 = 0 then '-Infinity'::double else 0 end as moved from l"""
)
def prior_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint log density of the starts, and that of every second threshold moved below its bound."""
    got = random_streams.sample(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", PRIORS, seed=7)
    moved = PRIORS["threshold"].log_density(F.when(F.col("s_suppkey") % 2 == 0, 0.4).otherwise(F.col("threshold")))
    return got.select("s_suppkey", r6(random_streams.log_density(PRIORS), "log_density"), F.when(moved > float("-inf"), 0.0).otherwise(moved).alias("moved"))


def grid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a 5 x 5 grid: Y region, X rank; c customers, flows from the keys, one land cell."""
    n = table(spark, sf_dir, "nation").withColumn("X", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("c"))
    g = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_regionkey").cast("int").alias("Y"), F.col("X").cast("int").alias("X"), F.coalesce("c", F.lit(0.0)).alias("c"),
        (F.lit(0.1) * F.col("X") - 0.2).alias("u"), (F.lit(0.3) - F.lit(0.1) * F.col("n_regionkey")).alias("v"),
        (F.lit(1000.0) + F.lit(10.0) * F.col("n_regionkey")).alias("dx"), F.lit(1000.0).alias("dy"), F.lit(1000.0).alias("face_height"),
        F.lit(1000.0).alias("face_width"), F.lit(1e6).alias("cell_area"),
        F.when((F.col("n_regionkey") == 2) & (F.col("X") == 2), 0.0).otherwise(1.0).alias("mask"),
    )
    return g


GRID5 = """n as (select n_regionkey as Y, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int as X, n_nationkey as k from nation),
g as (select Y, X, coalesce(c, 0)::double as c, 0.1::double * X - 0.2::double as u, 0.3::double - 0.1::double * Y as v, 1000::double + 10::double * Y as dx, 1000::double as dy,
  case when Y = 2 and X = 2 then 0 else 1 end::double as mask from n left join (select c_nationkey, count(*) as c from customer group by 1) on c_nationkey = k)"""


@query(f"with {GRID5} select Y as y, X as x, c as pred, (Y * 10 + X)::double as obs from g")
def gridded_obs_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid5(spark, sf_dir)
    coords = {d: cells.select(F.col(d).alias("idx"), (F.col(d) * 10.0).alias("value")).distinct() for d in ("Y", "X")}
    obs = cells.select((F.col("Y") * 10.0 + 2).alias("Y"), (F.col("X") * 10.0 - 3).alias("X"), (F.col("Y") * 10.0 + F.col("X")).alias("obs"))
    got = align.extract_observations(cells.select("Y", "X", "c"), obs, coords, "obs", "c")
    return got.select(((F.col("Y") - 2) / 10).cast("int").alias("y"), ((F.col("X") + 3) / 10).cast("int").alias("x"), "pred", "obs")


# ---- functions ----


@query(
    """with d as (select n_nationkey, n_nationkey * 4.0::double - 48 as lat, doy from nation, (select distinct dayofyear(ts)::double as doy from events)),
    t as (select *, radians(23.45::double * sin(radians(360::double * (284 + doy) / 365))) as tilt from d)
    select n_nationkey, doy::int as doy, round(acos(greatest(-1::double, least(1::double, -tan(radians(lat)) * tan(tilt)))) / pi(), 6) as day_length from t"""
)
def day_length_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.dayofyear("ts").cast("double").alias("doy")).distinct()
    cells = table(spark, sf_dir, "nation").crossJoin(little(days))
    length = biology.day_length(F.col("n_nationkey") * 4.0 - 48, F.col("doy"))
    return cells.select("n_nationkey", F.col("doy").cast("int").alias("doy"), r6(length, "day_length"))


@query(
    """with w as (select vec_id, 20 * (embedding[label % 3 + 1]::double * 0.4::double + embedding[10]::double * (1 - 0.4::double)) as m from embeddings),
    t as (select vec_id, greatest(m, 0::double) as th from w), g as (select vec_id, th, th / (1 + th / 273::double) as gi from t)
    select vec_id, round(th, 6) as threshold, round(gi, 6) as gillooly, round(10.38::double * exp(-0.11::double * (gi - 0)), 6) as rec_days from g"""
)
def temperature_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("z"), (F.col("label") % 3).alias("day"))
    mean = e.withColumn("m", 20 * biology.layer_weighted_mean(F.col("z"), F.lit(0.4), F.col("day"), F.lit(9)))
    th = mean.withColumn("th", biology.threshold_temperature(F.col("m"), F.lit(0.0)))
    g = th.withColumn("gi", biology.gillooly_temperature(F.col("th")))
    age = biology.recruitment_age(F.col("gi"), F.lit(10.38), F.lit(0.11), F.lit(0.0))
    return g.select("vec_id", r6(F.col("th"), "threshold"), r6(F.col("gi"), "gillooly"), r6(age, "rec_days"))


@query("select s_suppkey, round(-0.01::double * exp(0.15::double * (s_nationkey - 10)) * s_acctbal, 6) as rate from supplier")
def mortality_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    rate = biology.mortality(F.col("s_acctbal"), F.col("s_nationkey").cast("double"), F.lit(0.01), F.lit(0.15), F.lit(10.0))
    return s.select("s_suppkey", r6(rate, "rate"))


def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five cohorts a row: production from the embedding, ages in uneven steps, recruitment at 1 to 3 days."""
    ages = F.array(*[F.lit(x * DAY) for x in (0.0, 1.0, 2.0, 4.0, 7.0)])
    prod = F.transform(F.slice("embedding", 1, 5), lambda x: F.abs(x.cast("double")) * 1e6)
    return table(spark, sf_dir, "embeddings").select("vec_id", prod.alias("p"), ages.alias("ages"), ((F.col("label") % 3 + 1) * DAY).alias("rec"))


COHORTS = """a as (select * from (values (1, 0.0::double, 1.0::double), (2, 1, 1), (3, 2, 2), (4, 4, 3), (5, 7, 3)) as a(i, age, gap)),
c as (select vec_id, i, abs(embedding[i]::double) * 1e6 as p, age * 86400 as age, gap * 86400 as gap, (label % 3 + 1) * 86400::double as rec from embeddings, a),
f as (select *, 1 / (1 + exp(-(ln(99::double) / 86400) * (age - rec))) as s from c),
o as (select *, case when i = 5 then 0 else (1 - s) * p / gap end as leave, s * p / gap as recruit from f)"""


def _exploded(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.select("vec_id", F.posexplode(column).alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("int").alias("i"), r6(F.col("x"), name))


@query(f"with {COHORTS} select vec_id, i, round(gap, 6) as duration from c")
def cohort_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(cohorts(spark, sf_dir).withColumn("d", biology.cohort_durations(F.col("ages"))), "d", "duration")


@query(f"with {COHORTS} select vec_id, i, round(case when i = 1 then rec * 0.1668::double else 0 end, 6) as injected from c")
def npp_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(cohorts(spark, sf_dir).withColumn("d", biology.npp_injection(F.col("rec"), F.lit(0.1668), F.col("p"))), "d", "injected")


@query(f"with {COHORTS} select vec_id, i, round(coalesce(lag(leave) over (partition by vec_id order by i), 0) - leave, 6) + 0.0 as flow from o")
def aging_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(cohorts(spark, sf_dir).withColumn("d", biology.aging_flow(F.col("p"), F.col("ages"), F.col("rec"))), "d", "flow")


@query(f"with {COHORTS} select vec_id, round(sum(recruit), 6) as gain, round(min(-recruit), 6) as most_lost from o group by vec_id")
def recruitment_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss, gain = biology.recruitment_flow(F.col("p"), F.col("ages"), F.col("rec"))
    return cohorts(spark, sf_dir).select("vec_id", r6(gain, "gain"), r6(F.array_min(loss), "most_lost"))


# ---- transport ----

_NEAR = {
    "closed": "coalesce({f}({c}) over (partition by {p} order by {o}), {c})",
    "periodic": "coalesce({f}({c}) over (partition by {p} order by {o}), {e}({c}) over (partition by {p} order by {o} rows between unbounded preceding and unbounded following))",
}


def _near_sql(column: str, side: str, bc: str) -> str:
    along, across = ("X", "Y") if side in ("east", "west") else ("Y", "X")
    ahead = side in ("east", "north")
    return _NEAR[bc].format(c=column, p=across, o=along, f="lead" if ahead else "lag", e="first_value" if ahead else "last_value")


def _neighbours(spark: SparkSession, sf_dir: str, bc: int) -> DataFrame:
    return grid5(spark, sf_dir).select("Y", "X", *[transport.window_neighbour("c", s, bc, []).alias(s) for s in transport.SIDES])


@query(f"with {GRID5} select Y, X, {', '.join(f'{_near_sql("c", s, "closed")} as {s}' for s in transport.SIDES)} from g")
def neighbor_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, transport.Boundary.CLOSED)


@query(f"with {GRID5} select Y, X, {', '.join(f'{_near_sql("c", s, "periodic")} as {s}' for s in transport.SIDES)} from g")
def neighbor_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, transport.Boundary.PERIODIC)


#: East and west periodic, north open, south closed.
BC = {"east": 2, "west": 2, "north": 1, "south": 0}


def _step_sql(source: str, name: str, d: float) -> str:
    """Tendencies of one step on the grid, as common table expressions."""
    kinds = {0: "closed", 1: "closed", 2: "periodic"}
    near = ", ".join(
        f"{_near_sql(f, s, kinds[BC[s]])} as {f}_{s}" for s in transport.SIDES for f in ("c", "mask", *(("u", "dx") if s in ("east", "west") else ("v", "dy")))
    )
    adv, dif = [], []
    for s, (axis, step) in transport.SIDES.items():
        flow, size = ("u", "dx") if axis == -1 else ("v", "dy")
        edge = {"south": "case when Y = 0 then 0 else 1 end"}.get(s, "1")
        speed = f"(0.5::double * ({flow} + {flow}_{s}))"
        up = f"case when {speed} > 0 then {'c' if step > 0 else f'c_{s}'} else {f'c_{s}' if step > 0 else 'c'} end"
        adv.append(f"{step} * {speed} * {up} * (1000 * mask * mask_{s} * {edge})")
        dif.append(f"{step} * {-d}::double * ((c_{s} - c) / (0.5::double * ({size} + {size}_{s})) * {step}) * (1000 * mask * mask_{s} * {edge})")
    return f"""{name}_w as (select *, {near} from {source}),
    {name} as (select Y, X, c, u, v, dx, dy, mask, -({' + '.join(adv)}) / 1e6 * mask as adv, -({' + '.join(dif)}) / 1e6 * mask as dif from {name}_w)"""


@query(f"with {GRID5}, {_step_sql('g', 's1', 50.0)} select Y, X, round(adv, 6) + 0.0 as advection, round(dif, 6) + 0.0 as diffusion from s1")
def transport_tendency(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = transport.tendency_by_window(grid5(spark, sf_dir), 50.0, BC, 5, 5)
    return got.select("Y", "X", r6(F.col("advection_rate"), "advection"), r6(F.col("diffusion_rate"), "diffusion"))


@query(ORACLE_SQL["transport_tendency"])
def transport_tendency_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = transport.tendency_by_tiles(grid5(spark, sf_dir), 50.0, BC, 5, 5, tile=2)
    return got.select("Y", "X", r6(F.col("advection_rate"), "advection"), r6(F.col("diffusion_rate"), "diffusion"))


def _update_sql(before: str, name: str) -> str:
    return f"{name} as (select Y, X, greatest(0::double, c + 600 * (adv + dif)) as c, u, v, dx, dy, mask from {before})"


@query(
    f"with {GRID5}, {_step_sql('g', 's1', 50.0)}, {_update_sql('s1', 'g1')}, {_step_sql('g1', 's2', 50.0)}, {_update_sql('s2', 'g2')}, "
    f"{_step_sql('g2', 's3', 50.0)}, {_update_sql('s3', 'g3')} select Y, X, round(c, 6) as c from g3"
)
def transport_3_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid5(spark, sf_dir)
    for _ in range(3):
        got = transport.tendency_by_window(cells, 50.0, BC, 5, 5)
        cells = got.withColumn("c", F.greatest(F.lit(0.0), F.col("c") + 600 * (F.col("advection_rate") + F.col("diffusion_rate")))).drop("advection_rate", "diffusion_rate")
    return cells.select("Y", "X", r6(F.col("c"), "c"))


# ---- runs ----


STEPS = 40


def _growth(rate: float | str = 0.05 / DAY, capacity: float = 200.0):
    """A day of logistic growth, held between nothing and 400; the rate may be carried in the state."""

    def step(s: recurrence.State, _) -> recurrence.State:
        r = s[rate] if isinstance(rate, str) else F.lit(rate)
        grown = recurrence.euler({"biomass": s["biomass"]}, {"biomass": biology.logistic(s["biomass"], r, F.lit(capacity))}, DAY, 0.0, 400.0)
        return {**s, **grown}

    return step


def _logistic(spark: SparkSession, sf_dir: str, **growth) -> DataFrame:
    return recurrence.trajectory(grid5(spark, sf_dir), ["Y", "X"], {"biomass": F.col("c") + 1.0}, _growth(**growth), STEPS)


def _shown(out: DataFrame) -> DataFrame:
    return out.select("Y", "X", "t_idx", r6(F.col("biomass"), "biomass"))


_LOGISTIC = f"""with recursive {GRID5},
run(Y, X, t, b) as (select Y, X, 0, c + 1.0::double from g union all
  select Y, X, t + 1, least(400::double, greatest(0::double, b + 86400::double * (0.05::double / 86400 * b * (1 - b / 200)))) from run where t < 40)"""


@query(_LOGISTIC + " select Y, X, (t - 1)::bigint as t_idx, round(b, 6) as biomass from run where t > 0")
def logistic_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_logistic(spark, sf_dir))


@query(ORACLE_SQL["logistic_growth"])
def logistic_growth_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(s, _):
        b = s["biomass"]
        return {"biomass": np.clip(b + DAY * (0.05 / DAY * b * (1 - b / 200.0)), 0.0, 400.0)}

    return _shown(recurrence.trajectory_by_kernel(grid5(spark, sf_dir), ["Y", "X"], {"biomass": F.col("c") + 1.0}, step, STEPS))


@query(ORACLE_SQL["logistic_growth"])
def chunked_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(recurrence.trajectory_by_chunks(grid5(spark, sf_dir), ["Y", "X"], {"biomass": F.col("c") + 1.0}, _growth(), STEPS, 16))


@query(_LOGISTIC + " select Y, X, (t - 1)::bigint as t_idx, round(b, 6) as biomass from run where t - 1 in (0, 10, 20, 30)")
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_logistic(spark, sf_dir).where("t_idx in (0, 10, 20, 30)"))


@query(_LOGISTIC.replace("0.05::double", "0.3::double").replace("b / 200", "b / 1000") + " select Y, X, (t - 1)::bigint as t_idx, round(b, 6) as biomass from run where t > 0")
def euler_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth that would pass the upper bound."""
    return _shown(_logistic(spark, sf_dir, rate=0.3 / DAY, capacity=1000.0))


@query(_LOGISTIC + " select Y, X, t::bigint as t_idx, round(0.05::double * b * (1 - b / 200), 6) as growth_per_day from run where t < 40")
def export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The growth of each step, from the state before it, alone."""
    def step(s, x):
        growth = biology.logistic(s["biomass"], F.lit(0.05 / DAY), F.lit(200.0))
        return {**_growth()({"biomass": s["biomass"]}, x), "growth": growth}

    out = recurrence.trajectory(grid5(spark, sf_dir), ["Y", "X"], {"biomass": F.col("c") + 1.0, "growth": F.lit(0.0)}, step, STEPS)
    return out.select("Y", "X", "t_idx", r6(F.col("growth") * DAY, "growth_per_day"))


@query(_LOGISTIC + " select Y, X, (t - 1)::bigint as t_idx, round(b, 6) as biomass from run where t - 1 between 4 and 9")
def time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times from first to last, both included."""
    out = _logistic(spark, sf_dir).withColumn("T", time_of("t_idx", datetime(2024, 1, 1), DAY))
    return _shown(out.where("T between timestamp '2024-01-05' and timestamp '2024-01-10'"))


@query(_LOGISTIC + " select (t - 1)::bigint as t_idx, round(avg(b), 6) as mean_biomass from run where t - 1 >= 20 group by 1")
def spinup_spatial_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _logistic(spark, sf_dir).where("t_idx >= 20")
    return out.groupBy("t_idx").agg(r6(F.avg("biomass"), "mean_biomass"))


@query(
    f"""with recursive {GRID5}, m as (select s_suppkey as E, 0.01::double + s_suppkey * 0.002::double as rate from supplier),
    run(E, rate, Y, X, t, b) as (select E, rate, Y, X, 0, c + 1.0::double from g, m union all
      select E, rate, Y, X, t + 1, least(400::double, greatest(0::double, b + 86400::double * (rate / 86400 * b * (1 - b / 200)))) from run where t < 40)
    select E::int as E, Y, X, round(b, 6) as biomass from run where t = 40"""
)
def ensemble_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's rate on every cell: each member is a row, its last state is kept."""
    members = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("E"), ((F.lit(0.01) + F.col("s_suppkey") * F.lit(0.002)) / DAY).alias("rate"))
    cells = grid5(spark, sf_dir).select("Y", "X", "c")
    runs = recurrence.dealt(members, "E", times=cells.count()).crossJoin(little(cells))
    out = recurrence.last_state(runs, ["E", "Y", "X"], {"biomass": F.col("c") + 1.0, "rate": F.col("rate")}, _growth(rate="rate"), STEPS)
    return out.select("E", "Y", "X", r6(F.col("biomass"), "biomass"))


def _hunt(s: recurrence.State, food) -> recurrence.State:
    """A day of predator and prey, the prey's growth scaled by its food."""
    rate = lambda x: F.lit(x / DAY)
    eaten, gained = biology.predation(s["prey"], s["predator"], rate(0.005), F.lit(0.5))
    prey = biology.prey_growth(s["prey"], rate(0.04)) * food + eaten
    return recurrence.euler(s, {"prey": prey, "predator": gained + biology.predator_death(s["predator"], rate(0.1))}, DAY, 0.0)


def _hunted() -> recurrence.State:
    return {"prey": 20.0 + F.col("Y") * 4 + F.col("X"), "predator": F.lit(7.0)}


def _pair(out: DataFrame) -> DataFrame:
    return out.select("Y", "X", "t_idx", r6(F.col("prey"), "prey"), r6(F.col("predator"), "predator"))


_LV = f"""with recursive {GRID5},
run(Y, X, t, n, p) as (select Y, X, 0, 20::double + Y * 4 + X, 7::double from g union all
  select Y, X, t + 1, greatest(0::double, n + 86400::double * (0.04::double / 86400 * n + -(0.005::double / 86400) * n * p)),
    greatest(0::double, p + 86400::double * (0.5::double * (0.005::double / 86400) * n * p + -(0.1::double / 86400) * p)) from run where t < 40)
select Y, X, (t - 1)::bigint as t_idx, round(n, 6) as prey, round(p, 6) as predator from run where t > 0"""


@query(_LV)
def lotka_volterra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(recurrence.trajectory(grid5(spark, sf_dir), ["Y", "X"], _hunted(), lambda s, _: _hunt(s, F.lit(1.0)), STEPS))


def daily_food(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the means of the days from the first on, without the last, as an array in order of time."""
    days = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("T")).agg((F.avg("value") / 50.0).alias("food"))
    # As many elements as days.
    whole = days.agg(F.sort_array(F.collect_list(F.struct("T", "food"))).alias("d"))
    return whole.select(F.transform(F.slice("d", F.lit(1), F.size("d") - 1), lambda x: x["food"]).alias("food"))


_FORCED = f"""with recursive {GRID5}, {SPAN}, w as (select date_diff('day', a, date_trunc('day', ts)) as t, avg(value) / 50::double as food from events, span group by 1),
run(Y, X, t, n, p) as (select Y, X, 0::bigint, 20::double + Y * 4 + X, 7::double from g union all
  select Y, X, run.t + 1, greatest(0::double, n + 86400::double * (0.04::double / 86400 * n * food + -(0.005::double / 86400) * n * p)),
    greatest(0::double, p + 86400::double * (0.5::double * (0.005::double / 86400) * n * p + -(0.1::double / 86400) * p)) from run join w on w.t = run.t, span where run.t < date_diff('day', a, b))
select Y, X, t - 1 as t_idx, round(n, 6) as prey, round(p, 6) as predator from run where t > 0"""


@query(_FORCED)
def lotka_volterra_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of food is given to every cell as an array."""
    cells = grid5(spark, sf_dir).crossJoin(F.broadcast(daily_food(spark, sf_dir)))
    return _pair(recurrence.trajectory(cells, ["Y", "X"], _hunted(), _hunt, given="food"))


@query(_FORCED)
def time_indexed_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the food looked up by the number of the step."""
    food = daily_food(spark, sf_dir)
    steps = food.select(F.size("food")).first()[0]
    cells = grid5(spark, sf_dir).crossJoin(F.broadcast(food))
    return _pair(recurrence.trajectory(cells, ["Y", "X"], _hunted(), lambda s, i: _hunt(s, F.get("food", i)), steps))


@query(
    """with recursive s as (select n_nationkey as k, 0.01::double * n_nationkey as a0 from nation),
    run(k, t, px, pv, a, w) as (
      select k, 0, 0::double, 0::double, a0, 0::double from s union all
      select k, t + 1, px + 0.01::double * pv, pv + 0.01::double * ((0.05::double * (w * w * sin(a) - dw * cos(a))) / 1.1::double), a + 0.01::double * w, w + 0.01::double * dw from (
        select *, (9.81::double * sin(a) + cos(a) * ((-0.05::double * w * w * sin(a)) / 1.1::double)) / (0.5::double * (4.0::double / 3 - 0.1::double * cos(a) * cos(a) / 1.1::double)) as dw from run where t < 50))
    select k as cart, round(px, 6) + 0.0 as position, round(a, 6) + 0.0 as angle from run where t = 50"""
)
def cartpole_free_fall(spark: SparkSession, sf_dir: str) -> DataFrame:
    m_cart, m_pole, length, gravity, force = (F.lit(x) for x in (1.0, 0.1, 0.5, 9.81, 0.0))

    def step(s: recurrence.State, _) -> recurrence.State:
        turn = biology.angular_acceleration(s["angle"], s["spin"], force, m_cart, m_pole, length, gravity)
        push = biology.linear_acceleration(s["angle"], s["spin"], turn, force, m_cart, m_pole, length)
        return recurrence.euler(s, {"position": s["speed"], "speed": push, "angle": s["spin"], "spin": turn}, 0.01)

    start = {"position": F.lit(0.0), "speed": F.lit(0.0), "angle": F.col("n_nationkey") * 0.01, "spin": F.lit(0.0)}
    carts = table(spark, sf_dir, "nation").withColumn("cart", F.col("n_nationkey").cast("int"))
    out = recurrence.trajectory(carts, ["cart"], start, step, 50)
    return out.where("t_idx = 49").select("cart", r6(F.col("position"), "position"), r6(F.col("angle"), "angle"))


# ---- metrics and populations ----

_LINES = "l as (select l_returnflag as k, l_extendedprice as obs, l_quantity * 1500::double as pred, l_linestatus = 'O' as m from lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_returnflag").alias("k"), c("l_extendedprice").alias("obs"), (c("l_quantity") * 1500.0).alias("pred"), (c("l_linestatus") == "O").alias("m")
    )


@query(
    f"""with {_LINES} select k, round(avg((pred - obs) ** 2) / 1e6, 6) as mse, round(sqrt(avg((pred - obs) ** 2)) / 1e3, 6) as rmse,
    round(sqrt(avg((pred - obs) ** 2)) / stddev_pop(obs), 6) as nrmse_std, round(sqrt(avg((pred - obs) ** 2)) / abs(avg(obs)), 6) as nrmse_mean,
    round(sqrt(avg((pred - obs) ** 2)) / (max(obs) - min(obs)), 6) as nrmse_minmax from l group by k"""
)
def loss_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o = F.col("pred"), F.col("obs")
    m = metrics.METRICS
    return lines(spark, sf_dir).groupBy("k").agg(
        r6(m["mse"](p, o) / 1e6, "mse"), r6(m["rmse"](p, o) / 1e3, "rmse"), r6(m["nrmse_std"](p, o), "nrmse_std"),
        r6(m["nrmse_mean"](p, o), "nrmse_mean"), r6(m["nrmse_minmax"](p, o), "nrmse_minmax"),
    )


@query(
    f"""with {_LINES} select k, round(avg((pred - obs) ** 2) filter (where m) / 1e6, 6) as mse, round(sqrt(avg((pred - obs) ** 2) filter (where m)) / 1e3, 6) as rmse,
    round(sqrt(avg((pred - obs) ** 2) filter (where m)) / stddev_pop(obs) filter (where m), 6) as nrmse_std,
    round(sqrt(avg((pred - obs) ** 2) filter (where m)) / (max(obs) filter (where m) - min(obs) filter (where m)), 6) as nrmse_minmax
    from l group by k having count(*) filter (where m) > 0"""
)
def loss_metrics_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o, k = F.col("pred"), F.col("obs"), F.col("m")
    m = metrics.METRICS
    return lines(spark, sf_dir).groupBy("k").agg(
        r6(m["mse"](p, o, k) / 1e6, "mse"), r6(m["rmse"](p, o, k) / 1e3, "rmse"), r6(m["nrmse_std"](p, o, k), "nrmse_std"),
        r6(m["nrmse_minmax"](p, o, k), "nrmse_minmax"), F.max(F.col("m").cast("int")).alias("any"),
    ).where("any = 1").drop("any")


@query(
    f"""with {_LINES} select k, round(sqrt(avg((pred - obs) ** 2) filter (where m)) / greatest(abs(avg(obs) filter (where m)), 1e-10), 6) as nrmse_mean
    from l group by k having count(*) filter (where m) > 0"""
)
def loss_nrmse_mean_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    nrmse = metrics.METRICS["nrmse_mean"](F.col("pred"), F.col("obs"), F.col("m"))
    return lines(spark, sf_dir).groupBy("k").agg(r6(nrmse, "nrmse_mean"), F.max(F.col("m").cast("int")).alias("any")).where("any = 1").drop("any")


@query(
    f"""with {_LINES}, e as (select unnest(generate_series(0, 3)) as i) select i::int as E, case when i % 2 = 1 then 1e6
    else round(sqrt(avg((pred * (1 + i) - obs) ** 2)), 4) end as loss from l, e group by i"""
)
def loss_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members whose predictions are not finite get the penalty as their loss."""
    member = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("E")
    pred = F.when(F.col("E") == 1, float("nan")).when(F.col("E") == 3, float("inf")).otherwise(F.col("pred") * (1 + F.col("E")))
    rows = lines(spark, sf_dir).select(member, "obs", "pred").withColumn("pred", pred)
    return metrics.composite_loss([(rows, "rmse", 1.0)]).select("E", F.round("loss", 4).alias("loss"))


@query(
    """with p as (select l_orderkey as k, sum(l_extendedprice * case when l_linestatus = 'O' then 1.0::double else 0.5::double end) as pred from lineitem group by 1)
    select o_orderpriority as priority, count(*) as n, round(sqrt(avg((pred - o_totalprice) ** 2)) / 1e3, 4) as loss from orders join p on k = o_orderkey group by 1"""
)
def combined_group_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's total observes all its lines together, open ones with weight 1, others with one half."""
    weight = F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.5)
    pred = metrics.combined_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_extendedprice", weight)
    pairs = table(spark, sf_dir, "orders").join(pred, F.col("o_orderkey") == F.col("l_orderkey"))
    loss = metrics.rmse(F.col("pred"), F.col("o_totalprice"))
    return pairs.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(loss / 1e3, 4).alias("loss"))


@query(
    f"""with {SPAN}, {DAILY}, d as (select date_diff('day', (select min(T) from daily), T) as t, value from daily)
    select (t // 10)::int as t_bucket, count(*) as n, round(sum(value), 4) as total from d group by 1"""
)
def partitioned_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily values written in three chunks to a folder partitioned by stretches of ten steps, and read back."""
    rows = daily(spark, sf_dir)
    first = rows.agg(F.min("T").alias("first"))
    steps = rows.crossJoin(F.broadcast(first)).select(F.datediff("T", "first").cast("long").alias("t_idx"), "value")
    # The chunks come from one written table, not from three runs of all before it.
    steps = written(steps, "daily")
    with sinks.DiskWriter(spark, f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}", bucket_steps=10) as writer:
        writer.initialize(["value"])
        for low, high in ((0, 10), (10, 20), (20, 1 << 30)):
            writer.append(steps.where(F.col("t_idx").between(low, high - 1)))
        back = writer.finalize()
    return back.groupBy("t_bucket").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    f"""with {SPAN}, {DAILY}, d as (select date_diff('day', (select min(T) from daily), T) as t, event_type, value from daily)
    select event_type, count(*) as n, round(sum(value), 4) as total from d where t // 10 = 1 group by 1"""
)
def pruned_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stretch of ten steps of a partitioned folder: the others are not read."""
    rows = daily(spark, sf_dir)
    first = rows.agg(F.min("T").alias("first"))
    steps = rows.crossJoin(F.broadcast(first)).select(F.datediff("T", "first").cast("long").alias("t_idx"), F.col("event_type").alias("F"), "value")
    with sinks.DiskWriter(spark, f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}", bucket_steps=10) as writer:
        writer.initialize(["value"])
        writer.append(steps)
        back = writer.finalize()
    return back.where("t_bucket = 1").groupBy(F.col("F").alias("event_type")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_LOSSES = f"""{_LINES}, e as (select i as E, 1000 + i * 100 as f from (select unnest(generate_series(0, 9)) as i)),
losses as (select E, round(0.7::double * sqrt(avg((pred / 1500 * f - obs) ** 2)) / 1e3 + 0.3::double * sqrt(avg((pred / 1500 * f - obs) ** 2)) / stddev_pop(obs), 6) as loss from l, e group by E)"""


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("E")
    rows = lines(spark, sf_dir).select(member, "obs", "pred").withColumn("pred", F.col("pred") / 1500.0 * (1000.0 + F.col("E") * 100))
    thousands = lambda p, o: metrics.rmse(p, o) / 1e3
    return metrics.composite_loss([(rows, thousands, 0.7), (rows, "nrmse_std", 0.3)]).select("E", r6(F.col("loss"), "loss"))


@query(f"with {_LOSSES} select E::int as E, loss from losses")
def composite_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _losses(spark, sf_dir)


@query(f"with {_LOSSES} select arg_min(E, struct_pack(loss, E))::int as best, min(loss) as best_loss, round(avg(loss), 6) as mean_loss, count(*) as n_valid from losses")
def population_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.population_stats(_losses(spark, sf_dir)).select("best", "best_loss", r6(F.col("mean_loss"), "mean_loss"), "n_valid")


@query(
    """with b as (select min(s_acctbal) as a, max(s_acctbal) as z from supplier), n as (select s_suppkey, (s_acctbal - a) / (z - a) as x, s_nationkey / 24.0::double as y from supplier, b),
    c as (select x as cx, y as cy from n order by s_suppkey limit 1)
    select s_suppkey, round(x, 6) as x, round(sqrt((x - cx) ** 2 + (y - cy) ** 2), 6) as distance from n, c"""
)
def param_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    ends = s.agg(F.min("s_acctbal").alias("a"), F.max("s_acctbal").alias("z"), F.min_by(F.struct("s_acctbal", "s_nationkey"), "s_suppkey").alias("c"))
    n = s.crossJoin(F.broadcast(ends)).withColumn("x", (F.col("s_acctbal") - F.col("a")) / (F.col("z") - F.col("a"))).withColumn("y", F.col("s_nationkey") / 24.0)
    cx, cy = (F.col("c.s_acctbal") - F.col("a")) / (F.col("z") - F.col("a")), F.col("c.s_nationkey") / 24.0
    gap = F.sqrt((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy))
    return n.select("s_suppkey", r6(F.col("x"), "x"), r6(gap, "distance"))


_GREEDY = """with recursive p as (select p_partkey as id, abs(p_retailprice - {target}) as loss, (p_retailprice - 900) / 1200::double as x, p_size / 50::double as y from part),
n as (select *, row_number() over (order by loss, id) as r from p),
run(r, taken) as (select 0::bigint, []::struct(id bigint, x double, y double)[] union all
  select run.r + 1, case when len(taken) < {most} and len(list_filter(taken, lambda t: sqrt((t.x - n.x) ** 2 + (t.y - n.y) ** 2) < {distance})) = 0 then list_append(taken, {{id: n.id, x: n.x, y: n.y}}) else taken end
  from run join n on n.r = run.r + 1)
select unnest(list_transform(taken, lambda t: t.id)) as p_partkey, unnest(range(1, len(taken) + 1)) as place from (select taken from run order by r desc limit 1)"""
PART_BOUNDS = {"p_retailprice": (900.0, 2100.0), "p_size": (0.0, 50.0)}


@query(_GREEDY.format(target=1400, most=1 << 30, distance=0.1))
def distinct_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts nearest to a price, each at least a tenth of the space from all before it."""
    parts = table(spark, sf_dir, "part").withColumn("loss", F.abs(F.col("p_retailprice") - 1400))
    return distinct_set.distinct_ranked(parts, ["loss", "p_partkey"], PART_BOUNDS, 0.1).select("p_partkey", "place")


@query(_GREEDY.format(target=1000, most=10, distance=0.05))
def hall_of_fame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of a diverse set."""
    parts = table(spark, sf_dir, "part").withColumn("loss", F.abs(F.col("p_retailprice") - 1000))
    return distinct_set.distinct_ranked(parts, ["loss", "p_partkey"], PART_BOUNDS, 0.05, most=10).select("p_partkey", "place")


@query(
    """with h as (select date_trunc('hour', ts) as hour, event_type, avg(value) as mean from events group by 1, 2)
    select e.event_type, count(*) as n, round(sum((e.value - h.mean) ** 2), 4) as spread from events e join h on h.hour = date_trunc('hour', e.ts) and h.event_type = e.event_type group by 1"""
)
def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events against the means of their hours, both stored in buckets of hour and type."""
    events = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("hour"), "event_type", "value")
    means = events.groupBy("hour", "event_type").agg(F.avg("value").alias("mean"))
    many = buckets.bucket_count(events.count())
    keys = ["hour", "event_type"]
    both = buckets.joined(spark, buckets.store(events, "events", keys, many), buckets.store(means, "means", keys, many), keys)
    off = F.col("value") - F.col("mean")
    return both.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(off * off), 4).alias("spread"))


@query(
    """with p as (select l_linenumber % 3 as E, date_trunc('month', l_shipdate) as m, sum(l_extendedprice) * 3 as pred from lineitem group by 1, 2),
    o as (select date_trunc('month', o_orderdate) as m, sum(o_totalprice) as obs from orders group by 1)
    select p.E::int as E, count(*) as n, round(sqrt(avg((pred - obs) ** 2)) / 1e6, 6) as loss from p join o on p.m = o.m group by 1"""
)
def transformed_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members observed by a transform of their rows: thrice the sum of a third of the lines by month, against the orders' totals."""
    lines_of = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).cast("int").alias("E"), "l_shipdate", "l_extendedprice")
    seen = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("total"))

    def by_month(rows: DataFrame) -> DataFrame:
        return rows.groupBy("E", F.date_trunc("month", "l_shipdate").alias("month")).agg((F.sum("l_extendedprice") * 3).alias("pred"))

    pairs = objectives.paired(lines_of, seen, "total", transform=by_month)
    loss = metrics.rmse(F.col("pred"), F.col("obs")) / 1e6
    return pairs.groupBy("E").agg(F.count("*").alias("n"), r6(loss, "loss"))


@query(
    f"""with {SPAN}, {DAILY}, h as (select event_id % 4 as E, date_diff('day', a, date_trunc('day', ts)) as t_idx, event_type as F, avg(value) as pred from events, span group by 1, 2, 3),
    n as (select T, event_type, value, (select arg_min(t_idx, struct_pack(x := abs(epoch_us(T) + 7 * 3600000000 - epoch_us(a + to_days(t_idx::int))), y := -t_idx)) from (select distinct t_idx from h)) as near from daily, span)
    select h.E::int as E, count(*) as n, round(sqrt(avg((pred - value) ** 2)), 6) as loss from n join h on h.t_idx = n.near and h.F = n.event_type group by 1"""
)
def targeted_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of the events as members; daily means, seven hours late, observe the nearest of their days."""
    start = event_grid(spark, sf_dir).start
    events = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    member = (F.col("event_id") % 4).cast("int").alias("E")
    outputs = events.groupBy(member, F.datediff("day", F.lit(start)).alias("t_idx"), F.col("event_type").alias("F")).agg(F.avg("value").alias("value"))
    days = events.select(F.datediff("day", F.lit(start)).alias("idx"), F.col("day").alias("value"))
    late = daily(spark, sf_dir).select((F.col("T") + F.expr("interval 7 hours")).alias("T"), F.col("event_type").alias("F"), F.col("value").alias("seen"))
    pairs = objectives.paired(outputs, late, "seen", target="value", coords={"T": days})
    return pairs.groupBy("E").agg(F.count("*").alias("n"), r6(metrics.rmse(F.col("pred"), F.col("obs")), "loss"))


@query(f"with {COHORTS} select vec_id, round(sum(p) filter (where i <= 2), 6) as young, round(sum(p) filter (where i > 2), 6) as old, count(*) filter (where i > 2) as n_old from c group by vec_id")
def sliced_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outputs of one function, each a slice of the cohorts, and what they add up to."""
    young, old = F.slice("p", 1, 2), F.slice("p", F.lit(3), F.size("p") - 2)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return cohorts(spark, sf_dir).select("vec_id", r6(total(young), "young"), r6(total(old), "old"), F.size(old).cast("long").alias("n_old"))


@query(f"with {GRID5} select Y, X, c as value from g")
def renamed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid under other names and in another order, brought to the canonical ones."""
    other = grid5(spark, sf_dir).select(F.col("X").alias("lon"), F.col("c").alias("value"), F.col("Y").alias("lat"))
    return dims.transpose(dims.rename_dims(other, {"lat": "Y", "lon": "X", "depth": "Z"}))


@query(f"with {SPAN}, {DAILY} select event_type, count(*) as n, round(sum(value::float::double), 4) as total from daily group by 1")
def single_precision_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily values through the memory writer in two chunks, then on disk in single precision, and read back."""
    first = event_grid(spark, sf_dir).start
    steps = daily(spark, sf_dir).select(F.datediff("T", F.lit(first)).cast("long").alias("t_idx"), F.col("event_type").alias("F"), "value")
    steps = written(steps, "daily")
    with sinks.MemoryWriter() as memory:
        memory.initialize(["value"])
        for part in (steps.where("t_idx < 12"), steps.where("t_idx >= 12")):
            memory.append(part)
        whole = memory.finalize()
    with sinks.DiskWriter(spark, f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}", bucket_steps=10, single=True) as disk:
        disk.initialize(["value"])
        disk.append(whole)
        back = disk.finalize()
    return back.groupBy(F.col("F").alias("event_type")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 4).alias("total"))


# ---- chunks of arrays ----


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value by hour and user group, as an array over T and Y."""
    rows = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("timestamp").alias("T"), (F.col("user_id") % 10).cast("int").alias("Y"), "value")
    return rows.groupBy("T", "Y").agg(F.avg("value").alias("value"))


_HOURLY = "hourly as (select date_trunc('hour', ts) as T, (user_id % 10)::int as Y, avg(value) as value from events group by 1, 2)"


@query(
    f"""with {_HOURLY} select strftime(date_trunc('day', T), '%Y-%m-%d') as day, Y::bigint as Y, count(*) as n, round(sum(value), 4) as total from hourly group by 1, 2"""
)
def chunk_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means appended along time to a table of array chunks in two commits, and read back."""
    rows = _hourly(spark, sf_dir)
    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    half = F.lit("2024-01-16").cast("timestamp")
    for part in (rows.where(F.col("T") < half), rows.where(F.col("T") >= half)):
        chunks.write_chunks(part, path, 3600.0)
    back = chunks.read_chunks(spark, path)
    return back.groupBy(F.date_format("T", "yyyy-MM-dd").alias("day"), "Y").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    f"""with {_HOURLY}, e as (select (select max(T) from hourly where T <= timestamp '2024-01-10 00:30:00') as a, (select min(T) from hourly where T >= timestamp '2024-01-11 00:30:00') as b)
    select strftime(T, '%Y-%m-%d %H') as hour, Y::bigint as Y, round(value, 6) as value from hourly, e where T between a and b"""
)
def chunk_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's window of a table of array chunks with one step on either side: only the chunks that hold it are read."""
    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    chunks.write_chunks(_hourly(spark, sf_dir), path, 3600.0, steps=24)
    got = chunks.read_chunks(spark, path, "2024-01-10T00:30:00", "2024-01-11T00:30:00", bracket=True)
    return got.select(F.date_format("T", "yyyy-MM-dd HH").alias("hour"), "Y", r6(F.col("value"), "value"))


# ---- streams ----


@query("select count(*) as n_events, round(sum(value), 4) as total from events")
def streaming_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by type from a stream of several batches, summed at the end."""
    from ..streaming.stateful import run_stream

    return run_stream(spark, sf_dir).agg(F.sum("n").alias("n_events"), F.round(F.sum("total"), 4).alias("total"))


@query(ORACLE_SQL["forcing_ffill_6h"])
def streaming_ffill_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event value of each type at six-hourly times, over streams with state by key and a watermark."""
    from ..streaming import as_of, stateful

    grid = event_grid(spark, sf_dir, "6h")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("k"), F.col("ts").cast("timestamp").alias("T"), F.lit(0).cast("long").alias("number"), F.col("value").alias("v"))
    events = events.where("v is not null")
    asked = events.select("k").distinct().crossJoin(grid.frame(spark).select("T", F.col("t_idx").cast("long").alias("number"))).select("k", "T", "number", F.lit(None).cast("double").alias("v"))
    # A last row of no key lets the watermark pass all others.
    end = spark.createDataFrame([(None, grid.end + timedelta(days=90), -1, 0.0)], events.schema)
    stream = stateful.as_stream(events.unionByName(asked).repartition(spark.sparkContext.defaultParallelism), "series", last=end)
    home = f"{shared_dir(spark)}/as-of-{uuid.uuid4().hex}"
    # Files come in any order, so rows wait for as long as the series is.
    as_of.run_to_folder(as_of.stream_as_of(stream, "60 days", shares=2, grid=grid), home).awaitTermination()
    got = as_of.results(spark, home)
    return got.select(F.col("k").alias("event_type"), F.date_format("T", "yyyy-MM-dd HH").alias("hour"), r6(F.col("value"), "value"))


from . import cohort_queries  # noqa: E402, F401  (registers further queries)
