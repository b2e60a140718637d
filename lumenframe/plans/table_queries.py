"""Registered queries over tables (events as curves, orders and line items as inventories), and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import curves, dose, inventory, noise, uptake
from lumenframe.plans.volume_queries import tidy

Q, SQL = {}, {}


def register(name: str, sql: str | None = None):  # noqa: ANN201
    def keep(query):  # noqa: ANN001, ANN202
        Q[name] = query
        if sql:
            SQL[name] = sql
        return query

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, keys: list[str], digits: int = 5) -> DataFrame:
    return df.select(*keys, *(tidy(F.col(c), digits).alias(c) for c in df.columns if c not in keys))


def r(expression: str, name: str, digits: int = 5) -> str:
    return f"round({expression}, {digits}) + 0.0 as {name}"


# ---- uptake ----------------------------------------------------------------------------------------------------
@register("suv_factor", f"""with e as (select event_id, user_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) as a,
        lead(hour(ts) * 3600 + minute(ts) * 60 + second(ts) + (microsecond(ts) % 1000000) / 1e6::double) over (partition by user_id order by ts, event_id) as b from events),
    d as (select *, case when b - a < 0 then b - a + 86400 else b - a end as dt from e)
    select event_id, {r('(50 + user_id % 50) * 1000 / (3.7e8::double * exp(-ln(2) * dt / 6586.2::double))', 'factor', 9)} from d""")
def suv_factor(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("scan", F.lead(F.date_format("ts", "HHmmss.SSSSSS")).over(w))
    factor = uptake.suv_factor((F.col("user_id") % 50 + 50).cast("string"), F.lit("370000000"), F.lit("6586.2"), F.date_format("ts", "HHmmss"), F.col("scan"))
    return e.select("event_id", tidy(factor, 9).alias("factor"))


@register("ode_decay", f"""with recursive d as (select user_id, sum(value) as dose from events group by user_id),
    s as (select user_id, 0 as k, dose as blood, 0.0::double as free, 0.0::double as bound, 0.0::double as total from d
        union all select user_id, k + 1, blood + 0.1::double * (-0.55::double * blood + 0.2::double * free), free + 0.1::double * (0.5::double * blood - 0.35::double * free),
            bound + 0.1::double * (0.1::double * free - 0.05::double * bound),
            total + 0.1::double * (free + bound) from s where k < 50)
    select user_id, {r('blood', 'blood')}, {r('free', 'free')}, {r('bound', 'bound')}, {r('total', 'total')} from s where k = 50""")
def ode_decay(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("dose"))
    s = d.select("user_id", dose.decay_chain(F.col("dose"), 50, 0.1, 0.5, 0.2, 0.1, 0.05).alias("s")).select("user_id", "s.*")
    return rounded(s, ["user_id"])


# ---- curves ----------------------------------------------------------------------------------------------------
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("curve"), F.unix_date(F.to_date("ts")).cast("double").alias("t")).agg(F.round(F.sum("value"), 4).alias("a"))


PTS = """pts as (select user_id as curve, date_diff('day', date '1970-01-01', ts::date)::double as t, round(sum(value), 4) as a from events group by 1, 2),
    c as (select * from (select *, row_number() over w as i, count(*) over (partition by curve) as n, max(a) over (partition by curve) as a_max, sum(greatest(a, 0)) over (partition by curve) as a_sum,
        lead(t) over w as t_next, lead(a) over w as a_next from pts window w as (partition by curve order by t, a)) where n >= 2)"""


def simpson_sql(source: str, by: str, t: str, y: str, out: str, name: str) -> str:
    return f"""{name} as (select {by}, sum(case when n = 2 then (case when i = 1 then h0 * (y0 + y1) / 2 else 0 end)
            else (case when i % 2 = 1 and i + 2 <= n then (h0 + h1) / 6 * ((2 - h1 / h0) * y0 + (h0 + h1) ** 2 / (h0 * h1) * y1 + (2 - h0 / h1) * y2) else 0 end)
            + (case when n % 2 = 0 and i = n - 2 then y2 * (2 * h1 * h1 + 3 * h0 * h1) / (6 * (h0 + h1)) + y1 * (h1 * h1 + 3 * h1 * h0) / (6 * h0) - y0 * h1 ** 3 / (6 * h0 * (h0 + h1)) else 0 end) end) as {out}
        from (select *, t1 - t0 as h0, t2 - t1 as h1 from (select {by}, i, count(*) over (partition by {by}) as n, {t} as t0, {y} as y0, lead({t}) over w as t1, lead({t}, 2) over w as t2, lead({y}) over w as y1, lead({y}, 2) over w as y2
            from {source} window w as (partition by {by} order by i))) group by {by})"""


@register("tac_features", f"""with {PTS}, m as (select curve, count(*) as n, avg(a) as m, max(a) as hi, min(a) as lo, stddev_pop(a) as s, quantile_cont(a, 0.5) as md, sum(a * a) as e from c group by curve),
    x as (select c.curve, sum((a - m) ** 3) / count(*) as m3, sum((a - m) ** 4) / count(*) as m4, -sum(greatest(a, 0) / a_sum * ln(greatest(a, 0) / a_sum + 1e-12)) as h, min(t) as t0 from c join m using (curve) group by c.curve),
    p as (select curve, t as tp from c qualify row_number() over (partition by curve order by a desc, i) = 1), l as (select curve, t as tl from c qualify row_number() over (partition by curve order by a, i) = 1)
    select curve, n, {r('hi', 'a_max')}, {r('lo', 'a_min')}, {r('tp', 't_max')}, {r('tp - t0', 'time_to_peak')}, {r('tl', 't_min')}, {r('tl - tp', 'peak_to_min')}, {r('m', 'a_mean')}, {r('s', 'a_std')}, {r('md', 'a_median')},
        {r('m3 / s ** 3', 'skewness')}, {r('m4 / s ** 4 - 3', 'kurtosis')}, {r('e', 'energy', 3)}, {r('h', 'entropy')} from m join x using (curve) join p using (curve) join l using (curve)""")
def tac_features(spark, sf_dir):
    f = curves.features(curves.clean(points(spark, sf_dir)))
    return rounded(f, ["curve", "n", "energy"]).withColumn("energy", tidy(F.col("energy"), 3))


@register("tac_auc", f"""with {PTS}, {simpson_sql('c', 'curve', 't', 'a', 'auc', 's')}, z as (select curve, sum(coalesce((t_next - t) * (a + a_next) / 2, 0)) as z from c group by curve)
    select curve, {r('auc', 'auc', 3)}, {r('z', 'auc_trapezoid', 3)} from s join z using (curve)""")
def tac_auc(spark, sf_dir):
    return rounded(curves.areas(curves.clean(points(spark, sf_dir))), ["curve"], 3)


@register("tac_crossings", f"""with {PTS}, p as (select curve, i as pi, t as pt from c qualify row_number() over (partition by curve order by a desc, i) = 1), j as (select * from c join p using (curve))
    select curve, min(case when a <= a_max / 2 then t end) - any_value(pt) as half_life, {', '.join(f'min(case when a >= a_max * ({x} / 100.0::double) then t end) as t_{x}' for x in range(10, 101, 10))},
        {', '.join(f'min(case when i >= pi and a <= a_max * ({x} / 100.0::double) then t end) as t_down_{x}' for x in range(10, 100, 10))} from j group by curve""")
def tac_crossings(spark, sf_dir):
    return curves.crossings(curves.clean(points(spark, sf_dir)))


@register("tac_slopes", f"""with {PTS}, s as (select curve, case when t_next <> t then (a_next - a) / (t_next - t) end as s from c)
    select curve, {r('coalesce(max(case when s > 0 then s end), 0)', 'rising')}, {r('coalesce(min(case when s < 0 then s end), 0)', 'falling')}, {r('coalesce(max(s), 0)', 'max_slope')}, {r('coalesce(min(s), 0)', 'min_slope')} from s group by curve""")
def tac_slopes(spark, sf_dir):
    return rounded(curves.slopes(curves.clean(points(spark, sf_dir))), ["curve"])


@register("tac_percentiles", f"with {PTS} select curve, {', '.join(r(f'quantile_cont(a, {p / 100})', f'p{p}') for p in (1, 5, 10, 25, 50, 75, 90, 95, 99))} from c group by curve")
def tac_percentiles(spark, sf_dir):
    return rounded(curves.percentiles(curves.clean(points(spark, sf_dir))), ["curve"])


# Organ parameters by curve: S value, repair rate per day and alpha/beta.
def dose_sql(days: str) -> str:
    """Nested integrals spelled out: every point against all before it. `days` is a point's time."""
    return f"""with {PTS}, k as (select curve, i, {days} as t, a, 0.004125::double * (1 + curve % 3) as mu from c),
    pr as (select x.curve, x.i as upto, y.i as i, y.t as u, y.a * exp(-x.mu * (x.t - y.t)) as y from k x join k y on x.curve = y.curve and y.i <= x.i), {simpson_sql('pr', 'curve, upto', 'u', 'y', 'inn', 'inn')},
    b as (select k.curve, k.i, k.t, k.a * case when k.i = 1 then k.a * (1 - exp(-k.mu * k.t)) else inn.inn end as y from k join inn on inn.curve = k.curve and inn.upto = k.i), {simpson_sql('b', 'curve', 't', 'y', 'o', 'o')},
    z as (select curve, sum(coalesce((t_next - t) * (a + a_next) / 2, 0)) as z from (select *, lead(t) over w as t_next, lead(a) over w as a_next from k window w as (partition by curve order by i)) group by curve),
    g as (select curve, z, z * 4.82e-6::double as d, greatest(0, least(1, 2 * o / (z * z))) as g from z join o using (curve))
    select curve, {r('z', 'auc', 3)}, {r('d', 'dose')}, {r('g', 'g', 7)}, {r('d * (1 + g * d / 2.5::double)', 'bed', 4)}, {r('d * (1 + g * d / 2.5::double) / (1 + 2 / 2.5::double)', 'eqd2', 4)} from g"""


def doses(c: DataFrame) -> DataFrame:
    organs = c.select("curve").distinct().select("curve", F.lit(4.82e-6).alias("s_value"), (0.004125 * (F.col("curve") % 3 + 1)).alias("mu"), F.lit(2.5).alias("alpha_beta"))
    d = curves.organ_dose(c, organs)
    digits = {"auc": 3, "dose": 5, "g": 7, "bed": 4, "eqd2": 4}
    return d.select("curve", *(tidy(F.col(name), n).alias(name) for name, n in digits.items()))


@register("dose_table", dose_sql("t"))
def dose_table(spark, sf_dir):
    return doses(curves.clean(points(spark, sf_dir)))


@register("dose_table_long", dose_sql("(t - 19000) * 10001.234567::double"))
def dose_table_long(spark, sf_dir):
    """Curves of 10^5 days: repair rate times span is up to 3600, where a growing exponent would overflow."""
    return doses(curves.clean(points(spark, sf_dir).withColumn("t", (F.col("t") - 19000) * 10001.234567)))


FEATURES = ("a_max", "a_mean", "a_std", "a_median", "energy", "time_to_peak", "t_max", "sparse")


@register("feature_ranking", f"""with {PTS}, {simpson_sql('c', 'curve', 't', 'a', 'auc', 's')},
    e as (select curve, max(a) as a_max, avg(a) as a_mean, stddev_pop(a) as a_std, quantile_cont(a, 0.5) as a_median, sum(a * a) as energy, first(t order by a desc, i) - min(t) as time_to_peak, first(t order by a desc, i) as t_max,
        case when curve % 3 = 0 then max(a) end as sparse from c group by curve),
    ta as (select curve, auc as y1, auc * 4.82e-6::double * (1 + auc * 1e-5::double) as y2 from s where curve % 13 <> 5),
    f as ({' union all '.join(f"select curve, {i} as place, '{n}' as name, {'case when curve % 11 <> 0 then a_std end' if n == 'a_std' else n}::double as x from e where curve in (select curve from ta)" for i, n in enumerate(FEATURES))}),
    f1 as (select * from f where name in (select name from f group by name having count(x) >= floor(0.8 * count(*)))),
    f2 as (select * from f1 where curve not in (select curve from f1 where x is null)),
    tw as (select a.name from f2 a join f2 b on a.curve = b.curve and b.place < a.place group by a.name, b.name having abs(corr(a.x, b.x)) > 0.9),
    p as (select f2.curve, name as feature, x, t.target, t.y from f2 join (select curve, 'y1' as target, y1 as y from ta union all select curve, 'y2', y2 from ta) t using (curve) where name not in (select name from tw)),
    l as (select target, feature, regr_slope(y, x) as slope, regr_intercept(y, x) as base from p group by all),
    g as (select target, feature, y, base + slope * x as p from p join l using (target, feature)),
    k as (select target, feature, avg(abs(y - p)) as mae, avg((y - p) ** 2) as mse, sqrt(avg((y - p) ** 2)) as rmse, 1 - avg((y - p) ** 2) / var_pop(y) as r2, quantile_cont(abs(y - p), 0.5) as medae, avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) as mape from g group by all),
    q as (select target, feature, {' + '.join(f'rank() over (partition by target order by round({c}, 9))' for c in ('mae', 'mse', 'rmse', 'medae', 'mape'))} + rank() over (partition by target order by round(r2, 9) desc) as rank_sum from k)
    select target, feature, rank_sum::int as rank_sum, row_number() over (partition by target order by rank_sum, feature) = 1 as best from q""")
def feature_ranking(spark, sf_dir):
    """Curve features joined to dose targets, columns dropped, and what is left ranked as predictors."""
    c = curves.clean(points(spark, sf_dir))
    f = curves.features(c).withColumn("sparse", F.when(F.col("curve") % 3 == 0, F.col("a_max"))).withColumn("a_std", F.when(F.col("curve") % 11 != 0, F.col("a_std")))
    auc = F.col("auc")
    targets = curves.areas(c).where("curve % 13 <> 5").select("curve", auc.alias("y1"), (auc * 4.82e-6 * (1 + auc * 1e-5)).alias("y2"))
    return curves.feature_ranking(f.select("curve", *FEATURES), targets, "curve")


GUESSES = """g as (select l_returnflag as grp, m.m as model, l_extendedprice as y, l_quantity * case m.m when 0 then 1400 when 1 then 1500 when 2 then 1600 else 1550 end * (1 - l_discount * m.m) as p from lineitem, range(4) m(m))"""
METRICS = f"""{GUESSES}, x as (select grp, model, avg(abs(y - p)) as mae, avg((y - p) ** 2) as mse, quantile_cont(abs(y - p), 0.5) as medae, avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) as mape, var_pop(y) as v from g group by all),
    k as (select grp, model, mae, mse, sqrt(mse) as rmse, 1 - mse / v as r2, medae, mape from x)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("model")
    li = table(spark, sf_dir, "lineitem").withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(3))))
    guess = F.col("l_quantity") * F.when(m == 0, 1400).when(m == 1, 1500).when(m == 2, 1600).otherwise(1550) * (1 - F.col("l_discount") * m)
    return curves.regression_metrics(li.select(F.col("l_returnflag").alias("grp"), F.col("model").cast("long"), F.col("l_extendedprice").alias("y"), guess.alias("p")), "y", "p", ["grp", "model"])


@register("regression_metrics", f"with {METRICS} select grp, model, {', '.join(r(c, c, 4) for c in ('mae', 'mse', 'rmse', 'r2', 'medae', 'mape'))} from k".replace("round(mse, 4)", "round(mse, 1)"))
def regression_metrics(spark, sf_dir):
    return rounded(metrics(spark, sf_dir), ["grp", "model", "mse"], 4).withColumn("mse", tidy(F.col("mse"), 1))


@register("model_rank", f"""with {METRICS}, q as (select grp, model, {' + '.join(f'rank() over (partition by grp order by round({c}, 9))' for c in ('mae', 'mse', 'rmse', 'medae', 'mape'))} + rank() over (partition by grp order by round(r2, 9) desc) as rank_sum from k)
    select grp, model, rank_sum::int as rank_sum, row_number() over (partition by grp order by rank_sum, model) = 1 as best from q""")
def model_rank(spark, sf_dir):
    return curves.rank_models(metrics(spark, sf_dir), "grp", "model")


COLUMNS = ("q", "price", "disc", "net", "tax")


@register("drop_correlated", f"""with w as (select l_quantity as q, l_extendedprice as price, l_discount as disc, l_extendedprice * (1 - l_discount) as net, l_tax as tax from lineitem),
    k as (select unnest([{', '.join(f"{{'c': '{b}', 'r': abs(corr({a}, {b}))}}" for j, b in enumerate(COLUMNS) for a in COLUMNS[:j])}]) as p from w) select p.c as name, count(*) > 0 as dropped from k where p.r > 0.9 group by p.c""")
def drop_correlated(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.col("l_tax").alias("tax"))
    return curves.correlated_columns(li, COLUMNS).select(F.col("column").alias("name"), F.lit(True).alias("dropped"))


# ---- inventories -----------------------------------------------------------------------------------------------
ACQ = """acq as (select o_orderkey, 'PR2' || (o_custkey % 3)::varchar || '-' || o_custkey::varchar as patient, o_orderdate::date as day,
    (['NM', 'PT', 'CT', 'SR', 'RTSTRUCT', 'NM', 'CT'])[o_orderkey % 7 + 1] as modality,
    (['QSPECT Recon', 'Recon bed', 'Bed 2', 'CRF 1', 'reviewed cycle_' || (o_orderkey % 4 + 1)::varchar, null])[o_orderkey % 6 + 1] as description, o_totalprice from orders)"""


def acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    texts = lambda *t: F.array(*[F.lit(x) if isinstance(x, str) or x is None else x for x in t])
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("PR2"), (F.col("o_custkey") % 3).cast("string"), F.lit("-"), F.col("o_custkey").cast("string")).alias("patient"), F.to_date("o_orderdate").alias("day"),
        F.get(texts("NM", "PT", "CT", "SR", "RTSTRUCT", "NM", "CT"), (k % 7).cast("int")).alias("modality"),
        F.get(texts("QSPECT Recon", "Recon bed", "Bed 2", "CRF 1", F.concat(F.lit("reviewed cycle_"), (k % 4 + 1).cast("string")), None), (k % 6).cast("int")).alias("description"), "o_totalprice",
    )


REFINED = """ref as (select * replace (case when modality = 'NM' and coalesce(description ilike '%qspect%', false) then 'NM-QSPECT' when modality = 'NM' and coalesce(description ilike '%recon%', false) then 'NM-SPECT'
    when modality = 'NM' and coalesce(description ilike '%bed%', false) then 'NM-Projections' else modality end as modality) from acq)"""


@register("inventory_modality", f"with {ACQ}, {REFINED} select modality, count(*) as n from ref group by modality")
def inventory_modality(spark, sf_dir):
    return inventory.refine_modality(acquisitions(spark, sf_dir)).groupBy("modality").agg(F.count("*").alias("n"))


@register("inventory_filter", f"""with {ACQ}, {REFINED} select o_orderkey, patient, modality, description from ref where not (modality in ('NM', 'PT', 'SR', 'NM-SPECT') or coalesce(description ilike '%crf%', false) or coalesce(description ilike '%00001%', false)
    or (modality = 'RTSTRUCT' and not coalesce(description ilike '%reviewed%', false)) or not patient ilike '%pr21%' or (modality = 'CT' and (coalesce(description ilike '%arms%', false) or coalesce(description ilike '%wb%', false) or coalesce(description ilike '%stnd%', false))))""")
def inventory_filter(spark, sf_dir):
    return inventory.of_use(inventory.refine_modality(acquisitions(spark, sf_dir)), "PR21").select("o_orderkey", "patient", "modality", "description")


CYCLES = """days as (select distinct patient, day from acq), gaps as (select *, case when date_diff('day', lag(day) over (partition by patient order by day), day) < 10 then 0 else 1 end as new from days),
    cyc as (select patient, day, sum(new) over (partition by patient order by day)::int as cycle from gaps)"""


@register("inventory_cycles", f"with {ACQ}, {CYCLES} select o_orderkey, acq.patient, acq.day, cycle from acq join cyc on acq.patient = cyc.patient and acq.day = cyc.day")
def inventory_cycles(spark, sf_dir):
    return inventory.assign_cycles(acquisitions(spark, sf_dir), "patient", "day").select("o_orderkey", "patient", "day", "cycle")


@register("inventory_dedup", f"with {ACQ} select patient, modality, description, o_orderkey from acq qualify row_number() over (partition by patient, modality, description order by o_orderkey) = 1")
def inventory_dedup(spark, sf_dir):
    return inventory.first_rows(acquisitions(spark, sf_dir), ["patient", "modality", "description"], ["o_orderkey"]).select("patient", "modality", "description", "o_orderkey")


@register("inventory_timepoints", f"""with {ACQ} select o_orderkey, patient, 'TP' || dense_rank() over (partition by patient order by day)::varchar as timepoint, right(description, 5) as bed from acq
    where patient in (select patient from acq where modality = 'RTSTRUCT')""")
def inventory_timepoints(spark, sf_dir):
    t = inventory.timepoints(acquisitions(spark, sf_dir), "patient", "day", F.col("modality") == "RTSTRUCT")
    return t.select("o_orderkey", "patient", "timepoint", F.right("description", F.lit(5)).alias("bed"))


@register("inventory_mismatches", f"""with {ACQ}, {CYCLES}, j as (select o_orderkey, cycle, list_transform(regexp_extract_all(lower(description), 'cycle_?(\\d+)', 1), lambda d: d::int) as named from acq join cyc on acq.patient = cyc.patient and acq.day = cyc.day)
    select o_orderkey, cycle, named[1] as first_named from j where len(list_filter(named, lambda d: d <= 6)) > 0 and not list_contains(named, cycle)""")
def inventory_mismatches(spark, sf_dir):
    c = inventory.assign_cycles(acquisitions(spark, sf_dir), "patient", "day")
    return inventory.cycle_mismatches(c, "description", "cycle").select("o_orderkey", "cycle", F.col("named")[0].alias("first_named"))


@register("mixed_dates", """select o_orderkey, o_orderdate::date as day, strftime(o_orderdate, '%H%M%S') as clock from orders""")
def mixed_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return o.select("o_orderkey", inventory.mixed_date(text).alias("day"), inventory.clock(F.date_format("o_orderdate", "HH:mm:ss.SSS")).alias("clock"))


@register("param_parse", "select p_partkey, split_part(p_brand || '_' || p_size::varchar || '_' || p_retailprice::varchar || '_x', '_', 1) as brand, p_size as size, round(p_retailprice, 2) + 0.0 as price, null::int as missing from part")
def param_parse(spark, sf_dir):
    text = F.concat_ws("_", "p_brand", "p_size", F.col("p_retailprice").cast("string"), F.lit("x"))
    fields = [("brand", "string"), ("size", "int"), ("price", "double"), ("missing", "int")]
    return table(spark, sf_dir, "part").select("p_partkey", *inventory.split_parameters(text, fields)).withColumn("price", tidy(F.col("price"), 2))


@register("catalog_topk", """with s as (select l_returnflag as modality, l_orderkey, count(*) as slices, case when l_orderkey % 3 = 0 then null else sum(l_quantity) * 1000 end as size from lineitem group by l_returnflag, l_orderkey)
    select modality, l_orderkey, coalesce(size, slices * 512000) as bytes, place::int as place from (select *, row_number() over (partition by modality order by coalesce(size, slices * 512000) desc, l_orderkey) as place from s where slices >= 2) where place <= 5""")
def catalog_topk(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("modality"), "l_orderkey").agg(F.count("*").alias("slices"), F.sum("l_quantity").alias("q"))
    size = F.when(F.col("l_orderkey") % 3 != 0, F.col("q") * 1000)
    return inventory.top_series(s, "modality", size, F.col("slices"), 512000, 2, 5, ["l_orderkey"]).select("modality", "l_orderkey", F.col("bytes").cast("double").alias("bytes"), "place")


@register("bench_match", """with p as (select distinct p_size, split_part(p_type, ' ', 1) as prefix from part), m as (select p_size, prefix, p_type, p_partkey from p join part using (p_size) where contains(p_type, prefix))
    select p_size, prefix, max_by(p_type, p_partkey) as matched from m group by all""")
def bench_match(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_size", "p_type", "p_partkey")
    left = part.select("p_size", F.split("p_type", " ")[0].alias("prefix")).distinct()
    return inventory.match_names(left, part, "p_size", "prefix", "p_type", "p_partkey")


@register("first_existing", """select c_custkey, coalesce(a.k, b.k) as found from customer left join (select o_custkey, min(o_orderkey) as k from orders where o_orderstatus = 'F' group by 1) a on a.o_custkey = c_custkey
    left join (select o_custkey, min(o_orderkey) as k from orders where o_orderstatus = 'O' group by 1) b on b.o_custkey = c_custkey""")
def first_existing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    least = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("k"))
    return inventory.first_existing(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", (least("F"), "k"), (least("O"), "k"))


@register("complete_cases", "select user_id from events where event_type in ('click', 'view', 'purchase') group by user_id having count(distinct event_type) = 3")
def complete_cases(spark, sf_dir):
    return inventory.complete_cases(table(spark, sf_dir, "events"), "user_id", "event_type", ("click", "view", "purchase"))


@register("seeded_split", "select c_custkey, ('0x' || substr(md5('7:' || c_custkey::varchar), 1, 8))::bigint % 10000 < 1500 as validation from customer")
def seeded_split(spark, sf_dir):
    return inventory.seeded_split(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 7, 0.15)


@register("kfold_split", "select c_custkey, (c_custkey % 5)::int as fold, row_number() over (partition by c_mktsegment order by c_custkey) <= 20 as labeled from customer")
def kfold_split(spark, sf_dir):
    return inventory.k_folds(table(spark, sf_dir, "customer"), "c_custkey", 5, 20, "c_mktsegment").select("c_custkey", "fold", "labeled")


@register("speedups", f"""with m as (select event_type as operation, user_id % 10 as size, case when event_id % 2 = 0 then 'cpu' else 'fast' end as backend, quantile_cont(value, 0.5) as v from events group by all),
    w as (select operation, size, max(case when backend = 'cpu' then v end) / max(case when backend = 'fast' then v end) as s from m group by all)
    select operation, count(*) as n, {r('avg(s)', 'mean')}, {r('min(s)', 'least')}, {r('max(s)', 'most')} from w where s is not null group by operation""")
def speedups(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), (F.col("user_id") % 10).alias("size"), F.when(F.col("event_id") % 2 == 0, "cpu").otherwise("fast").alias("backend"), "value")
    return rounded(inventory.speedups(e, "operation", "backend", "value", "cpu", "fast"), ["operation", "n"])


@register("nmol_activity", f"select event_id, round(value * 1e-9 * 6.02214076e23::double * 0.6931471805599453 / 6586.2::double / 1e6, 1) + 0.0 as mbq from events")
def nmol_activity(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tidy(curves.mbq(F.col("value"), "F18"), 1).alias("mbq"))


@register("tac_clearance", f"""with {PTS}, {simpson_sql('c', 'curve', 't', 'a', 'auc', 's')}, m as (select curve, max(a) as a_max from c group by curve) select curve, {r('case when auc > 0 then a_max / auc end', 'clearance', 7)} from s join m using (curve)""")
def tac_clearance(spark, sf_dir):
    return rounded(curves.clearance(curves.clean(points(spark, sf_dir))), ["curve"], 7)


SIDECARS = """side as (select p_partkey, p_size, '/data/' || case when p_size >= 40 then 'xlarge' when p_size >= 25 then 'large' else 'small' end || '/img' || p_partkey::varchar as stem, p_retailprice as mb, split_part(p_brand, '#', 1) as modality from part),
    cat as (select stem || '.nii.gz' as file, split_part(stem, '/', 3) as size_category, [p_size, p_size, p_size // 2] as dimensions, [1.0, 1.0, 2.5]::double[] as spacing, modality, round(mb, 2) + 0.0 as size_mb from side where p_partkey % 5 <> 0 and p_partkey % 7 <> 0)"""


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars of images, every seventh broken, and every fifth image gone."""
    size = F.when(F.col("p_size") >= 40, "xlarge").when(F.col("p_size") >= 25, "large").otherwise("small")
    p = table(spark, sf_dir, "part").withColumn("stem", F.concat(F.lit("/data/"), size, F.lit("/img"), F.col("p_partkey").cast("string")))
    fields = F.struct(F.concat("stem", F.lit(".nii.gz")).alias("nifti_file"), F.array("p_size", "p_size", F.floor(F.col("p_size") / 2).cast(dict(p.dtypes)["p_size"])).alias("dimensions"), F.array(*map(F.lit, (1.0, 1.0, 2.5))).alias("spacing"), F.split("p_brand", "#")[0].alias("modality"), F.round("p_retailprice", 2).alias("size_mb"))
    text = F.when(F.col("p_partkey") % 7 == 0, "{broken").otherwise(F.to_json(fields))
    return inventory.from_sidecars(p.select(F.concat("stem", F.lit("_metadata.json")).alias("path"), text.alias("text")), p.where("p_partkey % 5 <> 0").select(F.concat("stem", F.lit(".nii.gz")).alias("file")))


@register("sidecar_catalog", f"with {SIDECARS} select file, size_category, array_to_string(dimensions, 'x') as dimensions, array_to_string(spacing, 'x') as spacing, modality, size_mb from cat")
def sidecar_catalog(spark, sf_dir):
    c = sidecars(spark, sf_dir)
    return c.withColumns({"dimensions": F.concat_ws("x", F.col("dimensions").cast("array<string>")), "spacing": F.concat_ws("x", F.col("spacing").cast("array<string>")), "size_mb": tidy(F.col("size_mb"), 2)})


@register("size_classes", f"with {SIDECARS} select size_category, len(list(file))::int as n, list_sort(list(file))[1] as first from cat where size_category in ('large', 'xlarge') group by size_category")
def size_classes(spark, sf_dir):
    return inventory.by_size_class(sidecars(spark, sf_dir)).groupBy("size_category").agg(F.count("*").cast("int").alias("n"), F.min("file").alias("first"))


@register("inventory_walk", """with f as (select o_orderkey, '/scans/' || o_custkey::varchar || '/' || o_orderkey::varchar || '.dcm' as path, '/scans/' || o_custkey::varchar as folder, o_orderstatus from orders)
    select folder, path from f where o_orderstatus <> 'O' qualify row_number() over (partition by folder order by path) = 1""")
def inventory_walk(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    files = o.select(F.concat(F.lit("/scans/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".dcm")).alias("path"), "o_orderstatus")
    return inventory.inventory_walk(files, F.col("o_orderstatus") != "O").select("folder", "path")


@register("tidied_results", "select c_custkey, c_mktsegment as segment, c_nationkey as nation, round(c_acctbal, 2) + 0.0 as c_acctbal from customer")
def tidied_results(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("parameters"))
    return inventory.tidy_results(c, "c_custkey", "parameters", [("segment", "string"), ("nation", dict(table(spark, sf_dir, "customer").dtypes)["c_nationkey"])]).withColumn("c_acctbal", tidy(F.col("c_acctbal"), 2))


@register("inventory_etl", f"""with {ACQ}, {REFINED}, kept as (select * from ref where not (modality in ('NM', 'PT', 'SR', 'NM-SPECT') or coalesce(description ilike '%crf%', false) or (modality = 'RTSTRUCT' and not coalesce(description ilike '%reviewed%', false)) or not patient ilike '%pr2%')),
    days as (select distinct patient, day from kept), gaps as (select *, case when date_diff('day', lag(day) over (partition by patient order by day), day) < 10 then 0 else 1 end as new from days),
    cyc as (select patient, day, sum(new) over (partition by patient order by day)::int as cycle from gaps), j as (select o_orderkey, kept.patient, kept.day, modality, description, cycle from kept join cyc on kept.patient = cyc.patient and kept.day = cyc.day),
    one as (select * from j qualify row_number() over (partition by patient, modality, description, cycle order by o_orderkey) = 1)
    select o_orderkey, patient, cycle, 'TP' || dense_rank() over (partition by patient order by day)::varchar as timepoint from one where patient in (select patient from one where modality = 'RTSTRUCT')""")
def inventory_etl(spark, sf_dir):
    """From acquisitions to labelled time points: refine, drop, number cycles, keep the first of equals, label."""
    kept = inventory.of_use(inventory.refine_modality(acquisitions(spark, sf_dir)), "PR2")
    one = inventory.first_rows(inventory.assign_cycles(kept, "patient", "day"), ["patient", "modality", "description", "cycle"], ["o_orderkey"])
    return inventory.timepoints(one, "patient", "day", F.col("modality") == "RTSTRUCT").select("o_orderkey", "patient", "cycle", "timepoint")


# ---- without SQL -----------------------------------------------------------------------------------------------
@register("lognormal_noise")
def lognormal_noise(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", noise.lognormal(F.col("value"), F.col("event_id"), 0.1, 11).alias("value"))


@register("binomial_thin")
def binomial_thin(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", noise.thinned(F.col("l_quantity").cast("long"), F.xxhash64("l_orderkey", "l_linenumber"), 0.25, 5).alias("kept"))
