"""Time-activity curves: features, areas, crossings, slopes, organ dose tables and model comparison.

Curves are rows (curve, t, a). Features sort by (t, a) within a curve and drop non-finite values.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Half-lives in seconds.
HALF_LIFE = {"F18": 6586.2, "Ga68": 4071.8, "Cu64": 43200.0}


def mbq(nmol: Column, isotope: str) -> Column:
    """Activity of an amount of substance: N * ln 2 / half-life, in MBq."""
    return nmol * 1e-9 * 6.02214076e23 * 0.6931471805599453 / HALF_LIFE[isotope] / 1e6


def clean(points: DataFrame) -> DataFrame:
    """Finite points of curves with two or more of them, numbered in time order."""
    finite = points.where(~(F.isnan("t") | F.isnan("a") | (F.abs("t") == float("inf")) | (F.abs("a") == float("inf")))).where("t is not null and a is not null")
    w = Window.partitionBy("curve").orderBy("t", "a")
    whole = Window.partitionBy("curve")
    return finite.withColumns({"i": F.row_number().over(w), "n": F.count("*").over(whole), "a_max": F.max("a").over(whole), "a_sum": F.sum(F.greatest("a", F.lit(0.0))).over(whole), "t_next": F.lead("t").over(w), "a_next": F.lead("a").over(w), "t_prev": F.lag("t").over(w), "a_prev": F.lag("a").over(w)}).where("n >= 2")


def features(curves: DataFrame) -> DataFrame:
    """Extremes (the first of equals), moments (population), entropy and energy per curve."""
    p = F.try_divide(F.greatest("a", F.lit(0.0)), F.col("a_sum"))
    first = lambda key: F.min(key)
    agg = curves.groupBy("curve").agg(
        F.count("*").alias("n"), F.max("a").alias("a_max"), F.min("a").alias("a_min"),
        first(F.struct(-F.col("a"), F.col("i"), F.col("t"))).alias("_peak"), first(F.struct(F.col("a"), F.col("i"), F.col("t"))).alias("_low"), F.min(F.struct("i", "t")).alias("_start"),
        F.avg("a").alias("a_mean"), F.stddev_pop("a").alias("a_std"), F.percentile("a", 0.5).alias("a_median"),
        F.skewness("a").alias("skewness"), F.kurtosis("a").alias("kurtosis"), F.sum(F.col("a") * F.col("a")).alias("energy"),
        (-F.sum(p * F.log(p + 1e-12))).alias("entropy"),
    )
    return agg.select("curve", "n", "a_max", "a_min", F.col("_peak.t").alias("t_max"), (F.col("_peak.t") - F.col("_start.t")).alias("time_to_peak"), F.col("_low.t").alias("t_min"), (F.col("_low.t") - F.col("_peak.t")).alias("peak_to_min"), "a_mean", "a_std", "a_median", "skewness", "kurtosis", "energy", "entropy")


def simpson(rows: DataFrame, t: str, y: str, by: Sequence[str], out: str) -> DataFrame:
    """Simpson's rule on an irregular grid, by pairs of intervals; an even number of points adds the last interval's correction.

    rows: numbered i from 1 to n with columns t and y, per group. Two points give the trapezoid.
    """
    w = Window.partitionBy(*by).orderBy("i")
    r = rows.select(*by, "i", F.count("*").over(Window.partitionBy(*by)).alias("n"), F.col(t).alias("t0"), F.col(y).alias("y0"), *(F.lead(c, k).over(w).alias(f"{m}{k}") for m, c in (("t", t), ("y", y)) for k in (1, 2)))
    h0, h1 = F.col("t1") - F.col("t0"), F.col("t2") - F.col("t1")
    pair = (h0 + h1) / 6 * ((2 - h1 / h0) * F.col("y0") + (h0 + h1) * (h0 + h1) / (h0 * h1) * F.col("y1") + (2 - h0 / h1) * F.col("y2"))
    body = F.when((F.col("i") % 2 == 1) & (F.col("i") + 2 <= F.col("n")), F.when((h0 != 0) & (h1 != 0), pair).otherwise(0.0))
    last = F.when((F.col("n") % 2 == 0) & (F.col("i") == F.col("n") - 2) & (h0 != 0) & (h1 != 0), F.col("y2") * (2 * h1 * h1 + 3 * h0 * h1) / (6 * (h0 + h1)) + F.col("y1") * (h1 * h1 + 3 * h1 * h0) / (6 * h0) - F.col("y0") * h1 * h1 * h1 / (6 * h0 * (h0 + h1)))
    two = F.when((F.col("n") == 2) & (F.col("i") == 1), h0 * (F.col("y0") + F.col("y1")) / 2)
    return r.groupBy(*by).agg(F.sum(F.coalesce(body, F.lit(0.0)) + F.coalesce(last, F.lit(0.0)) + F.coalesce(two, F.lit(0.0))).alias(out))


def areas(curves: DataFrame) -> DataFrame:
    """Area under the curve by Simpson's rule and by trapezoids."""
    trapezoid = curves.groupBy("curve").agg(F.sum(F.coalesce((F.col("t_next") - F.col("t")) * (F.col("a") + F.col("a_next")) / 2, F.lit(0.0))).alias("auc_trapezoid"))
    return simpson(curves.select("curve", "i", "t", "a"), "t", "a", ["curve"], "auc").join(trapezoid, "curve")


def crossings(curves: DataFrame, levels: Sequence[int] = tuple(range(10, 101, 10))) -> DataFrame:
    """Half-life from the peak to the first a <= max / 2 anywhere; first t with a >= x % of max; first after the peak with a <= x %."""
    peak = curves.groupBy("curve").agg(F.min(F.struct(-F.col("a"), F.col("i"), F.col("t"))).alias("p"))
    rows = curves.join(peak.select("curve", F.col("p.i").alias("peak_i"), F.col("p.t").alias("peak_t")), "curve")
    when = lambda cond: F.min(F.when((F.col("a_max") > 0) & cond, F.struct("i", "t")))["t"]
    ups = [when(F.col("a") >= F.col("a_max") * (x / 100)).alias(f"t_{x}") for x in levels]
    downs = [when((F.col("i") >= F.col("peak_i")) & (F.col("a") <= F.col("a_max") * (x / 100))).alias(f"t_down_{x}") for x in levels if x < 100]
    half = (when(F.col("a") <= F.col("a_max") / 2) - F.first("peak_t")).alias("half_life")
    return rows.groupBy("curve").agg(half, *ups, *downs)


def slopes(curves: DataFrame) -> DataFrame:
    """Largest rising, steepest falling, largest and smallest slope between neighbours; equal times are left out."""
    dt = F.col("t_next") - F.col("t")
    s = F.when(dt != 0, (F.col("a_next") - F.col("a")) / dt)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = curves.withColumn("s", s)
    return rows.groupBy("curve").agg(zero(F.max(F.when(F.col("s") > 0, F.col("s")))).alias("rising"), zero(F.min(F.when(F.col("s") < 0, F.col("s")))).alias("falling"), zero(F.max("s")).alias("max_slope"), zero(F.min("s")).alias("min_slope"))


def percentiles(curves: DataFrame, at: Sequence[int] = (1, 5, 10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    return curves.groupBy("curve").agg(*[F.percentile("a", p / 100).alias(f"p{p}") for p in at])


def clearance(curves: DataFrame) -> DataFrame:
    """The largest activity over the area by Simpson's rule; null for an area that isn't positive."""
    tops = curves.groupBy("curve").agg(F.max("a").alias("a_max"))
    return areas(curves).join(tops, "curve").select("curve", F.when(F.col("auc") > 0, F.col("a_max") / F.col("auc")).alias("clearance"))


def decayed_simpson(t: np.ndarray, y: np.ndarray, mu: float) -> np.ndarray:
    """For every point i the integral of y(u) exp(-mu (t_i - u)) up to it: Simpson's rule of simpson() over points 0 to i.

    A pair of intervals gives its integral as seen from its end, and all before it fades by exp(-mu * the pair's length): exponents never grow, however long the curve.
    """
    n, out = len(t), np.zeros(len(t))
    if n < 2:
        return out
    h = np.diff(t)
    fade = np.exp(-mu * h)
    out[1] = h[0] * (y[0] * fade[0] + y[1]) / 2
    if n > 2:
        h0, h1 = h[:-1], h[1:]
        seen0, seen1, seen2 = y[:-2] * fade[:-1] * fade[1:], y[1:-1] * fade[1:], y[2:]
        with np.errstate(divide="ignore", invalid="ignore"):
            pair = (h0 + h1) / 6 * ((2 - h1 / h0) * seen0 + (h0 + h1) ** 2 / (h0 * h1) * seen1 + (2 - h0 / h1) * seen2)
            last = seen2 * (2 * h1 * h1 + 3 * h0 * h1) / (6 * (h0 + h1)) + seen1 * (h1 * h1 + 3 * h1 * h0) / (6 * h0) - seen0 * h1**3 / (6 * h0 * (h0 + h1))
        whole = (h0 != 0) & (h1 != 0)
        pair, last, fade2 = np.where(whole, pair, 0.0).tolist(), np.where(whole, last, 0.0), (fade[:-1] * fade[1:]).tolist()
        held = 0.0
        for i in range(2, n, 2):
            out[i] = held = held * fade2[i - 2] + pair[i - 2]
        odd = np.arange(3, n, 2)
        out[odd] = out[odd - 1] * fade[odd - 1] + last[odd - 2]
    return out


def organ_dose(curves: DataFrame, organs: DataFrame) -> DataFrame:
    """Dose = area * S; G of Lea and Catcheside (nested Simpson, clipped to [0, 1] where it is finite); BED = D (1 + G D / ab); EQD2.

    organs: curve, s_value, mu (per unit of t), alpha_beta. One pass over each curve's points in time order gives its area by trapezoids, the inner integral of
    a(u) exp(-mu (t - u)) at every point and the outer one over them, for any mu and length. A null mu gives null G, BED and EQD2. A curve's points meet in one task.
    """

    @F.pandas_udf("struct<auc: double, outer: double>")
    def integrals(points: pd.Series, mu: pd.Series) -> pd.DataFrame:
        rows = []
        for p, m in zip(points, mu, strict=True):
            t, a = (np.array([x[k] for x in p], float) for k in ("t", "a"))
            y = a * decayed_simpson(t, a, m)
            y[0] = a[0] * a[0] * (1 - np.exp(-m * t[0]))
            rows.append((float((np.diff(t) * (a[:-1] + a[1:]) / 2).sum()), float(decayed_simpson(t, y, 0.0)[-1]) if pd.notna(m) else None))
        return pd.DataFrame(rows, columns=["auc", "outer"])

    points = curves.groupBy("curve").agg(F.array_sort(F.collect_list(F.struct("i", "t", "a"))).alias("points"))
    rows = points.join(organs, "curve").withColumn("n", integrals("points", "mu")).select("curve", "s_value", "alpha_beta", "n.auc", "n.outer")
    raw = F.when(F.col("auc") != 0, 2 * F.col("outer") / (F.col("auc") * F.col("auc")))
    finite = ~F.isnan(raw) & (F.abs(raw) != float("inf"))
    rows = rows.withColumn("dose", F.col("auc") * F.col("s_value")).withColumn("g", F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))))
    rows = rows.withColumn("bed", F.col("dose") * (1 + F.col("g") * F.col("dose") / F.col("alpha_beta")))
    return rows.select("curve", "auc", "dose", "g", "bed", (F.col("bed") / (1 + 2 / F.col("alpha_beta"))).alias("eqd2"))


def medians(rows: DataFrame, value: Column, by: Sequence[str], few: bool = False) -> DataFrame:
    """(by, median): exact medians without holding a group in one task.

    Approximate quantiles just below and above bracket the median (their rank error is a tenth of the bracket's width). Rows are counted by distinct value inside the
    bracket, all below it as one, before the shuffle; only those counts are put in order. Rows that tie at the median are one count, however many they are.
    few: groups are few and may be large, so their brackets go to the rows (two numbers a group), and no task gets or sorts a whole group.
    """
    v = rows.select(*by, value.cast("double").alias("v")).where("v is not null")
    ends = v.groupBy(*by).agg(F.percentile_approx("v", [0.498, 0.502], 5000).alias("e"), F.count("*").alias("n"))
    met = v.join(F.broadcast(ends) if few else ends, list(by)).where(F.col("v") <= F.col("e")[1])
    counts = met.groupBy(*by, "n", F.when(F.col("v") >= F.col("e")[0], F.col("v")).alias("v")).agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("v")))
    reached = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    middle = [reached(F.floor((F.col("n") + k) / 2)) for k in (1, 2)]
    return counts.withColumn("upto", upto).groupBy(*by).agg(((middle[0] + middle[1]) / 2).alias("median"))


def regression_metrics(rows: DataFrame, truth: str, guess: str, by: Sequence[str]) -> DataFrame:
    """MAE, MSE, RMSE, R2, median absolute error and MAPE per group; groups (models, targets) are few, whatever their size."""
    e = F.col(truth) - F.col(guess)
    sums = rows.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.avg(F.abs(e) / F.greatest(F.abs(F.col(truth)), F.lit(2.220446049250313e-16))).alias("mape"), F.var_pop(truth).alias("_var"))
    sums = sums.join(medians(rows, F.abs(e), by, few=True).withColumnRenamed("median", "medae"), list(by))
    return sums.select(*by, "mae", "mse", F.sqrt("mse").alias("rmse"), F.when(F.col("_var") > 0, 1 - F.col("mse") / F.col("_var")).alias("r2"), "medae", "mape")


def rank_models(metrics: DataFrame, group: str, model: str) -> DataFrame:
    """Sum of ranks (ties share the smallest) over mae, mse, rmse, medae and mape rising and r2 falling; best per group first by name."""
    by = lambda c: F.rank().over(Window.partitionBy(group).orderBy(c))
    ranks = [by(F.round(F.col(c), 9)) for c in ("mae", "mse", "rmse", "medae", "mape")] + [by(F.round(F.col("r2"), 9).desc())]
    total = ranks[0]
    for r in ranks[1:]:
        total = total + r
    scored = metrics.withColumn("rank_sum", total)
    best = F.row_number().over(Window.partitionBy(group).orderBy("rank_sum", model)) == 1
    return scored.select(group, model, "rank_sum", best.alias("best"))


def correlated_columns(rows: DataFrame, columns: Sequence[str], most: float = 0.9) -> DataFrame:
    """(column): those with |r| > most to an earlier column of the list; all pairwise correlations in one aggregation."""
    pairs = [(a, b) for j, b in enumerate(columns) for a in columns[:j]]
    wide = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(b).alias("column"), F.abs(F.col(f"`{a}|{b}`")).alias("r")) for a, b in pairs])).alias("p")).select("p.*")
    return long.groupBy("column").agg(F.max("r").alias("r")).where(F.col("r") > most).select("column")


def feature_ranking(features: DataFrame, targets: DataFrame, case: str, filled: float = 0.8, most: float = 0.9) -> DataFrame:
    """From curve features and dose targets to a ranking of features as predictors: join, clean, drop, fit, measure and rank as one plan.

    features and targets: `case` and numeric columns; rows meet on `case`. Features with fewer than `filled` of their values are dropped, then rows with a missing one, then
    features that correlate by more than `most` with an earlier kept column. Each that is left predicts each target by a straight line; measures are those of regression_metrics and
    places those of rank_models. Which columns go hangs on the data, so columns become rows and the plan is the same for all. A target that is constant has no R2 and ranks on the rest.
    Returns target, feature, rank_sum, best.
    """
    names, aims = [c for c in features.columns if c != case], [c for c in targets.columns if c != case]
    long = lambda df, columns, name, value: df.select(case, F.inline(F.array(*[F.struct(F.lit(i).alias(f"{name}_at"), F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for i, c in enumerate(columns)])))
    there = lambda c: c.isNotNull() & ~F.isnan(c)
    met = features.join(targets.select(case), case, "left_semi")
    x = long(met, names, "feature", "x").withColumn("x", F.when(there(F.col("x")), F.col("x")))
    enough = x.groupBy("feature").agg(F.count("x").alias("held"), F.count("*").alias("n")).where(F.col("held") >= F.floor(filled * F.col("n"))).select("feature")
    x = x.join(enough, "feature", "left_semi")
    x = x.join(x.where("x is null").select(case).distinct(), case, "left_anti")
    # Pairs of columns of one row: names are fixed by the schema, so a row meets itself len(names) times at most.
    y = x.select(case, F.col("feature_at").alias("earlier"), F.col("x").alias("other"))
    twins = x.join(y, case).where("earlier < feature_at").groupBy("feature", "earlier").agg(F.abs(F.corr("x", "other")).alias("r")).where(F.col("r") > most).select("feature").distinct()
    x = x.join(twins, "feature", "left_anti")
    pairs = x.join(long(targets, aims, "target", "y").where(there(F.col("y"))), case)
    lines = pairs.groupBy("target", "feature").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("base"))
    guessed = pairs.join(lines, ["target", "feature"]).withColumn("guess", F.col("base") + F.col("slope") * F.col("x"))
    measured = regression_metrics(guessed.where("guess is not null").select("target", "feature", "y", "guess"), "y", "guess", ["target", "feature"])
    return rank_models(measured, "target", "feature")
