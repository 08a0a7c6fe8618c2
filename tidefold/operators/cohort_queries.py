"""Queries of the cohort model and their twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import biology
from . import catalogue as base
from . import recurrence

DAY = base.DAY
#: Cohorts, and the coldest temperature that counts.
C, COLDEST = 4, 5.0
GROUP = {"lambda_0": 1 / 150 / DAY, "gamma_lambda": 0.15, "tau_r_0": 3 * DAY, "gamma_tau_r": 0.11, "efficiency": 0.1668}


def cohort_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts of production that age, recruit into biomass, and die, on the nation grid; temperature and production follow the daily event means.

    What depends on the day and the cell alone is computed by columns first; each cell then folds over its days.
    """
    grid = base.event_grid(spark, sf_dir)
    days = base.table(spark, sf_dir, "events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("T")).agg(F.avg("value").alias("m"))
    days = days.where(F.col("T") < F.lit(grid.end)).select(F.datediff("T", F.lit(grid.start)).alias("t"), "m")
    spots = days.crossJoin(base.little(base.grid5(spark, sf_dir).select("Y", "X", "c")))
    light = biology.day_length(F.col("Y") * 15.0 - 30.0, (F.col("t") + 1).cast("double"))
    layers = F.array(*[10 + F.col("m") / 20 + F.col("Y") - 4.0 * z for z in (0, 1)])
    mean = biology.layer_weighted_mean(layers, light, F.lit(1), F.lit(0))
    spots = spots.withColumn("warm", biology.gillooly_temperature(biology.threshold_temperature(mean, F.lit(COLDEST))))
    cold = biology.gillooly_temperature(F.lit(COLDEST))
    age = biology.recruitment_age(F.col("warm"), F.lit(GROUP["tau_r_0"]), F.lit(GROUP["gamma_tau_r"]), cold)
    spots = spots.select("Y", "X", "c", F.struct("t", "warm", age.alias("age"), ((1 + F.col("X") * 0.1) / DAY).alias("npp")).alias("day"))
    # An array of all days for each cell.
    cells = spots.groupBy("Y", "X", "c").agg(F.sort_array(F.collect_list("day")).alias("days"))
    ages = F.array(*[F.lit(i * DAY) for i in range(C)])

    def step(s: recurrence.State, day: Column) -> recurrence.State:
        loss, gain = biology.recruitment_flow(s["production"], ages, day["age"])
        fed = biology.npp_injection(day["npp"], F.lit(GROUP["efficiency"]), s["production"])
        moved = F.zip_with(fed, biology.aging_flow(s["production"], ages, day["age"]), lambda a, b: a + b)
        rate = F.zip_with(moved, loss, lambda a, b: a + b)
        died = biology.mortality(s["biomass"], day["warm"], F.lit(GROUP["lambda_0"]), F.lit(GROUP["gamma_lambda"]), cold)
        return {
            **recurrence.euler({"biomass": s["biomass"]}, {"biomass": died + gain}, DAY, 0.0),
            "production": F.zip_with(s["production"], rate, lambda p, r: recurrence.held(p + F.lit(DAY) * r, 0.0)),
        }

    start = {"biomass": 1 + F.col("c") / 100, "production": F.array(*[F.lit(0.05)] * C)}
    return recurrence.trajectory(cells, ["Y", "X"], start, step, given="days")


def _sql() -> str:
    """Scalar columns p0.. for the cohorts; the recurrence as a recursive table."""
    share = [f"1 / (1 + exp(-(ln(99::double) / 86400) * ({i} * 86400::double - rec)))" for i in range(C)]
    leave = [f"((1 - {share[i]}) * p{i} / 86400::double)" for i in range(C - 1)]
    gone = [f"({share[i]} * p{i} / 86400::double)" for i in range(C)]
    new = []
    for i in range(C):
        flow = f"{leave[i - 1]} - {leave[i] if i < C - 1 else '0::double'}" if i else f"-{leave[0]}"
        food = "npp * 0.1668::double + " if not i else ""
        new.append(f"greatest(0::double, p{i} + 86400::double * ({food}({flow}) - {gone[i]}))")
    day = "acos(greatest(-1::double, least(1::double, -tan(radians(Y * 15::double - 30)) * tan(radians(23.45::double * sin(radians(360::double * (284 + t + 1) / 365)))))))  / pi()"
    return f"""with recursive {base.GRID5}, {base.SPAN},
    w as (select date_diff('day', a, date_trunc('day', ts)) as t, avg(value) as m from events, span group by 1),
    f0 as (select Y, X, t, (10 + m / 20 + Y - 4) as t1, (10 + m / 20 + Y) as t0, (1 + X * 0.1::double) / 86400 as npp, {day} as dl from g, w),
    f1 as (select *, greatest(t1 * dl + t0 * (1 - dl), 5::double) as th from f0),
    f2 as (select *, th / (1 + th / 273::double) as tn, 5::double / (1 + 5::double / 273) as rn from f1),
    f as (select Y, X, t, npp, tn, rn, 3 * 86400::double * exp(-0.11::double * (tn - rn)) as rec from f2),
    run(Y, X, t, b, {', '.join(f'p{i}' for i in range(C))}) as (
      select Y, X, 0::bigint, 1 + c / 100, {', '.join(['0.05::double'] * C)} from g union all
      select r.Y, r.X, r.t + 1, greatest(0::double, b + 86400::double * (-(1::double / 150 / 86400) * exp(0.15::double * (tn - rn)) * b + ({' + '.join(gone)}))), {', '.join(new)}
      from run r join f on f.Y = r.Y and f.X = r.X and f.t = r.t, span where r.t < date_diff('day', a, b))
    select Y, X, t - 1 as t_idx, round(b, 6) as biomass, round(p0, 6) as first_cohort from run where t > 0"""


SQL = _sql().replace("date_diff('day', a, b))", "date_diff('day', span.a, span.b))").replace("greatest(0::double, b + ", "greatest(0::double, r.b + ").replace("(tn - rn)) * b +", "(tn - rn)) * r.b +")


@base.query(SQL)
def lmtl_no_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cohort_run(spark, sf_dir)
    return out.select("Y", "X", "t_idx", base.r6(F.col("biomass"), "biomass"), base.r6(F.col("production")[0], "first_cohort"))
