"""Statistics over paired and repeated measures.

Resamples are multinomial and of fixed size, by the splitting tree of ``resampling``.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import materialised
from .resampling import drawn_sums, vector_sums

#: As in the study; fewer make p and the bounds coarser.
RESAMPLES = 5000


def resampled_means(values: DataFrame, by: list[str], unit: str, value: str, n_boot: int = RESAMPLES) -> DataFrame:
    """by, b, mean: means of resamples of each group's units, nulls left out. Each resample draws as many as the group has."""
    rows = values.where(F.col(value).isNotNull()).select(*by, F.col(unit).alias("_u"), F.col(value).alias("x"))
    return drawn_sums(rows, by, "_u", "x", n_boot).select(*by, "b", (F.col("s") / F.col("n")).alias("mean"))


def interval(value: str) -> list[Column]:
    """The 95 % percentile interval of resampled values."""
    return [F.percentile(value, F.lit(0.025)).alias("lo"), F.percentile(value, F.lit(0.975)).alias("hi")]


def two_sided(value: str) -> Column:
    """Twice the smaller share of resampled values on either side of 0, at most 1."""
    tail = lambda c: F.avg(c.cast("double"))
    return F.least(F.lit(1.0), 2 * F.least(tail(F.round(value, 12) <= 0), tail(F.round(value, 12) >= 0)))


def bootstrap_ci(values: DataFrame, by: list[str], unit: str, value: str, n_boot: int = RESAMPLES) -> DataFrame:
    """by, n, mean, lo, hi: mean and 95 % percentile interval of each group."""
    ci = resampled_means(values, by, unit, value, n_boot).groupBy(*by).agg(*interval("mean"))
    base = values.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return base.join(ci, by, "left")


def paired_bootstrap(pairs: DataFrame, by: list[str], unit: str, n_boot: int = RESAMPLES) -> DataFrame:
    """by, n, diff, lo, hi, p, dz of pairs (a, b), pairs with a null left out: two-sided p and Cohen's dz (null without spread)."""
    rows = pairs.where("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b"))
    ci = resampled_means(rows, by, unit, "d", n_boot).groupBy(*by).agg(*interval("mean"), two_sided("mean").alias("p"))
    sd = F.stddev_samp("d")
    base = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("diff"), F.when(sd > 1e-12, F.avg("d") / sd).alias("dz"))
    return base.join(ci, by, "left")


def holm(rows: DataFrame, by: list[str], p: str, order: str, into: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values within ``by``; a null p counts as 1."""
    x = rows.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0)))
    w = Window.partitionBy(*by).orderBy("_p", order)
    x = x.withColumn("_s", F.least(F.lit(1.0), F.col("_p") * (F.count(F.lit(1)).over(Window.partitionBy(*by)) - F.row_number().over(w) + 1)))
    return x.withColumn(into, F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_p", "_s")


def complete(long: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows (by, id, level, x) of ids that have a value at every level that their group has."""
    known = long.where("x is not null")
    levels = known.groupBy(*by).agg(F.countDistinct("level").alias("_all"))
    have = known.groupBy(*by, "id").agg(F.countDistinct("level").alias("_k"))
    full = (have.join(levels, by) if by else have.join(levels, F.lit(True))).where("_k = _all").select(*by, "id")
    return known.join(full, [*by, "id"], "left_semi")


def to_wide(long: DataFrame, levels: list[str]) -> DataFrame:
    """One row for each complete id, one column for each level."""
    return long.groupBy("id").pivot("level", levels).agg(F.first("x", ignorenulls=True)).na.drop("any")


def repeated_measures(long: DataFrame, by: list[str] = [], n_boot: int = RESAMPLES) -> DataFrame:  # noqa: B006
    """One row for each group of a one-way repeated-measures analysis over complete ids.

    Sums of squares, F and its p, partial eta squared, range of level means with its interval, the range in standard
    deviations of subject means, best and worst level, numbers of ids and levels, and the mean of all values. Resamples
    draw as many ids as there are, each with all its levels.
    """
    rows = complete(long, by)
    key = by or ["_one"]
    rows = rows if by else rows.withColumn("_one", F.lit(1))
    per_level = rows.groupBy(*key, "level").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    per_id = rows.groupBy(*key, "id").agg(F.avg("x").alias("m"))
    total = rows.groupBy(*key).agg(F.avg("x").alias("grand_mean"), F.var_pop("x").alias("v"), F.count(F.lit(1)).alias("cells"))
    a = per_level.groupBy(*key).agg(F.var_pop("m").alias("vl"), (F.max("m") - F.min("m")).alias("range"), F.max_by("level", "m").alias("best"), F.min_by("level", "m").alias("worst"), F.max("n").alias("n_ids"), F.count(F.lit(1)).alias("n_levels"))
    s = per_id.groupBy(*key).agg(F.var_pop("m").alias("vs"), F.stddev_samp("m").alias("sd"))
    # Every id has every level of its group, so a level's place in the order of the levels stands for it.
    sums = rows.groupBy(*key, F.col("id").alias("_u"), "level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("double")).alias("s"))
    units = sums.groupBy(*key, "_u").agg(F.array_sort(F.collect_list(F.struct("level", "n", "s"))).alias("l")).select(*key, "_u", F.col("l.n").alias("n"), F.col("l.s").alias("s"))
    means = vector_sums(units, key, n_boot).select(*key, "b", (F.col("s") / F.col("n")).alias("mean"))
    spread = means.groupBy(*key, "b").agg((F.max("mean") - F.min("mean")).alias("spread"))
    ci = spread.groupBy(*key).agg(F.percentile("spread", F.lit(0.025)).alias("range_lo"), F.percentile("spread", F.lit(0.975)).alias("range_hi"))
    one = total.join(a, key).join(s, key).join(ci, key, "left")
    ss_level, ss_id = F.col("vl") * F.col("cells"), F.col("vs") * F.col("cells")
    ss_err = F.col("v") * F.col("cells") - ss_level - ss_id
    d1, d2 = F.col("n_levels") - 1, (F.col("n_levels") - 1) * (F.col("n_ids") - 1)
    f = F.when((ss_err > 0) & (d2 > 0), ss_level / d1 / (ss_err / d2))
    out = one.where("n_levels > 1").select(
        *by, "n_ids", "n_levels", "grand_mean", ss_level.alias("ss_level"), ss_id.alias("ss_subject"), ss_err.alias("ss_error"), f.alias("f"),
        F.when(ss_level + ss_err > 0, ss_level / (ss_level + ss_err)).alias("eta2"), "range", "range_lo", "range_hi",
        F.when(F.col("sd") > 1e-12, F.col("range") / F.col("sd")).alias("std_range"), "best", "worst", d1.alias("_d1"), d2.alias("_d2"),
    )
    tail = F.pandas_udf(lambda x, a, b: pd.Series([None if pd.isna(v) else f_p_value(v, int(i), int(j)) for v, i, j in zip(x, a, b)], dtype="float64"), "double")
    return out.withColumn("p", tail("f", "_d1", "_d2")).drop("_d1", "_d2")


def f_p_value(f: float, d1: int, d2: int) -> float:
    """Upper tail of the F distribution by the continued fraction of the incomplete beta function."""
    if not f > 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    return _beta(x, a, b)


def _beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction from the far end."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tail = 1.0
    for n in range(300, 0, -1):
        m = n // 2
        part = m * (b - m) / ((a + n - 1) * (a + n)) if n % 2 == 0 else -(a + m) * (a + b + m) / ((a + n - 1) * (a + n))
        tail = 1 + part * x / tail
    return front / tail


def average_rank(rows: DataFrame, by: list[str], value: str, descending: bool = True, into: str = "avg_rank") -> DataFrame:
    """Rank within ``by``; ties share the mean of their places."""
    w = Window.partitionBy(*by).orderBy(F.desc(value) if descending else F.asc(value))
    peers = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return rows.withColumn(into, F.rank().over(w) + (peers - 1) / 2)


def against_baseline(long: DataFrame, baseline: str, by: list[str] = [], n_boot: int = RESAMPLES) -> DataFrame:  # noqa: B006
    """by, level, paired statistics, p_holm, significant: each level against the baseline over common ids, adjusted within ``by``."""
    base = long.where(F.col("level") == baseline).select(*by, "id", F.col("x").alias("b"))
    pairs = long.where(F.col("level") != baseline).join(base, [*by, "id"]).select(*by, "level", "id", F.col("x").alias("a"), "b")
    rows = paired_bootstrap(pairs, [*by, "level"], "id", n_boot).withColumn("_all", F.lit(1))
    return holm(rows, [*by, "_all"], "p", "level").drop("_all").withColumn("significant", F.col("p_holm") <= 0.05)


def matched_contrast(long: DataFrame, baseline: str, by: list[str] = [], n_boot: int = RESAMPLES) -> DataFrame:  # noqa: B006
    """by, best and paired statistics: the level with the best mean, other than the baseline, against it, over complete ids."""
    return paired_bootstrap(matched_pairs(long, baseline, by), [*by, "best"], "id", n_boot)


def matched_pairs(long: DataFrame, baseline: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, best, id, a, b: each complete id's values at the level with the best mean, other than the baseline, and at the baseline."""
    rows = complete(long, by)
    means = rows.where(F.col("level") != baseline).groupBy(*by, "level").agg(F.avg("x").alias("m"))
    best = means.groupBy(*by).agg(F.max_by("level", F.struct("m", "level")).alias("best"))
    on = lambda x, y: x.join(y, by) if by else x.join(y, F.lit(True))
    a = on(rows, best).where(F.col("level") == F.col("best")).select(*by, "best", "id", F.col("x").alias("a"))
    b = rows.where(F.col("level") == baseline).select(*by, "id", F.col("x").alias("b"))
    return a.join(b, [*by, "id"])


def pair_contrasts(long: DataFrame, pairs: list[tuple[str, str]], by: list[str], n_boot: int = RESAMPLES) -> DataFrame:
    """by, level, baseline and paired statistics of given pairs of levels over the ids that have both."""
    out = None
    for level, baseline in pairs:
        of = lambda v, n: long.where((F.col("level") == v) & F.col("x").isNotNull()).select(*by, "id", F.col("x").alias(n))  # noqa: B023, E731
        both = of(level, "a").join(of(baseline, "b"), [*by, "id"]).withColumns({"level": F.lit(level), "baseline": F.lit(baseline)})
        out = both if out is None else out.unionByName(both)
    return paired_bootstrap(out, [*by, "level", "baseline"], "id", n_boot)


def main_effects(long: DataFrame, baselines: dict[str, str], directions: dict[str, int], n_boot: int = RESAMPLES) -> DataFrame:
    """One row for each factor and metric of rows (factor, metric, level, id, x).

    The repeated-measures analysis, its p adjusted across the factors of a metric, the level that is best in the metric's
    direction (1, or -1 where less is better), and the matched contrast against the factor's baseline.
    """
    by = ["factor", "metric"]
    spark = long.sparkSession
    long = materialised(long)  # several steps read it
    rows = holm(repeated_measures(long, by, n_boot), ["metric"], "p", "factor").withColumn("significant", F.col("p_holm") <= 0.05)
    sign = F.broadcast(spark.createDataFrame(list(directions.items()), "metric string, direction int"))
    rows = rows.join(sign, "metric", "left").withColumn("best_for_metric", F.when(F.coalesce("direction", F.lit(1)) > 0, F.col("best")).otherwise(F.col("worst"))).drop("direction")
    pairs = None
    for factor, baseline in baselines.items():
        got = matched_pairs(long.where(F.col("factor") == factor), baseline, by)
        pairs = got if pairs is None else pairs.unionByName(got)
    matched = paired_bootstrap(pairs, [*by, "best"], "id", n_boot).select(*by, F.col("best").alias("matched_best"), *[F.col(c).alias(f"matched_{c}") for c in ("diff", "lo", "hi", "p", "dz")])
    return rows.join(matched, by, "left")


def ranked_factors(effects: DataFrame, statistic: str = "std_range") -> DataFrame:
    """factor and, over metrics, mean and median of the statistic, mean eta2, mean range, mean rank, metrics won and number, from
    effects (factor, metric, statistic, eta2, range); the largest mean first."""
    rows = average_rank(effects.where(F.col(statistic).isNotNull()), ["metric"], statistic)
    out = rows.groupBy("factor").agg(
        F.avg(statistic).alias("mean_statistic"), F.percentile(statistic, F.lit(0.5)).alias("median_statistic"), F.avg("eta2").alias("mean_eta2"), F.avg("range").alias("mean_range"),
        F.avg("avg_rank").alias("mean_rank"), F.count_if(F.col("avg_rank") == 1).alias("metrics_won"), F.count(F.lit(1)).alias("n_metrics"),
    )
    return out.orderBy(F.desc("mean_statistic"), "factor")


def metric_winners(effects: DataFrame, statistic: str = "std_range") -> DataFrame:
    """metric and the factor with the largest statistic there."""
    return effects.groupBy("metric").agg(F.max_by("factor", F.struct(statistic, "factor")).alias("factor"), F.max(statistic).alias("statistic"))


def signed_contrasts(effects: DataFrame, directions: dict[str, int]) -> DataFrame:
    """factor, mean_matched_diff (in each metric's direction), metrics whose interval leaves out 0, and their number."""
    sign = F.broadcast(effects.sparkSession.createDataFrame(list(directions.items()), "metric string, direction int"))
    rows = effects.where("matched_diff is not null").join(sign, "metric", "left")
    return rows.groupBy("factor").agg(F.avg(F.col("matched_diff") * F.coalesce("direction", F.lit(1))).alias("mean_matched_diff"), F.count_if((F.col("matched_lo") > 0) | (F.col("matched_hi") < 0)).alias("resolved"), F.count(F.lit(1)).alias("n_metrics"))


def leading_answer(ranking: DataFrame, winners: DataFrame) -> DataFrame:
    """One row: the factor that ranks first by its mean statistic, by how much, and how many metrics it wins of all."""
    place = F.row_number().over(Window.orderBy(F.desc("mean_statistic"), "factor"))
    top = ranking.withColumn("place", place).where("place <= 2")
    one = top.agg(F.max_by("factor", -F.col("place")).alias("factor"), F.max("mean_statistic").alias("mean_statistic"), F.min("mean_statistic").alias("next_statistic"))
    won = winners.groupBy("factor").agg(F.count(F.lit(1)).alias("won"))
    total = winners.agg(F.count(F.lit(1)).alias("metrics"))
    return one.join(won, "factor", "left").join(total, F.lit(True)).select("factor", "mean_statistic", "next_statistic", F.coalesce("won", F.lit(0)).alias("won"), "metrics")


def described(contrasts: DataFrame, digits: int = 4) -> DataFrame:
    """Contrasts (level, diff, lo, hi, n) with a sentence, and whether the interval leaves out 0."""
    clear = (F.col("lo") > 0) | (F.col("hi") < 0)
    says = F.format_string(f"%s: %+.{digits}f [%+.{digits}f, %+.{digits}f], n = %d, %s", "level", "diff", "lo", "hi", "n", F.when(clear, "resolved").otherwise("not resolved"))
    return contrasts.withColumn("resolved", clear).withColumn("text", says)
