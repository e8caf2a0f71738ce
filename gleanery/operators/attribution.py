"""Stage attribution: the first stage of a pipeline that loses a question's evidence.

A trace row has configuration, question_id, split, in_top_20, in_top_5, coverage and ceiling. S1: the segmentation cannot
carry the evidence; S2: its document is not retrieved; S3: it does not reach the context; R: it is reachable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import RESAMPLES, against_baseline, bootstrap_ci, holm, paired_bootstrap

ENOUGH = 0.80
STAGES = ("S1", "S2", "S3", "R")
BLOCKING = STAGES[:3]


def stage(threshold: Column | float = ENOUGH) -> Column:
    """The stage of a trace row; a missing ceiling counts as 1, missing coverage as 0."""
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    reached = F.col("in_top_5") & (F.coalesce("coverage", F.lit(0.0)) >= t)
    return F.when(F.coalesce("ceiling", F.lit(1.0)) < t, "S1").when(~F.col("in_top_20"), "S2").when(~reached, "S3").otherwise("R")


def attributed(traces: DataFrame, threshold: float = ENOUGH) -> DataFrame:
    return traces.withColumn("stage", stage(threshold))


def partition(traces: DataFrame, by: tuple[str, ...] = ("configuration",), threshold: float = ENOUGH) -> DataFrame:
    """Share of questions in each stage, and of those that some stage blocks."""
    rows = attributed(traces, threshold)
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[share(F.col("stage") == s).alias(f"share_{s.lower()}") for s in STAGES], share(F.col("stage") != "R").alias("blocked"))


def partition_ci(traces: DataFrame, threshold: float = ENOUGH, n_boot: int = RESAMPLES) -> DataFrame:
    """configuration, stage (or blocked), share and its bootstrap interval."""
    rows = attributed(traces, threshold).select("configuration", "question_id", F.explode(F.array(*map(F.lit, (*STAGES, "blocked")))).alias("at"), "stage")
    is_at = F.when(F.col("at") == "blocked", F.col("stage") != "R").otherwise(F.col("stage") == F.col("at"))
    rows = rows.select("configuration", F.col("at").alias("stage"), "question_id", is_at.cast("double").alias("x"))
    return bootstrap_ci(rows, ["configuration", "stage"], "question_id", "x", n_boot)


def transitions(traces: DataFrame, level: str, baseline: str, threshold: float = ENOUGH) -> DataFrame:
    """from_stage, to_stage, n of every pair of stages, those without questions too."""
    rows = attributed(traces, threshold)
    of = lambda c, n: rows.where(F.col("configuration") == c).select("question_id", F.col("stage").alias(n))
    seen = of(baseline, "from_stage").join(of(level, "to_stage"), "question_id").groupBy("from_stage", "to_stage").count()
    grid = rows.sparkSession.createDataFrame([(a, b) for a in STAGES for b in STAGES], "from_stage string, to_stage string")
    return grid.join(seen, ["from_stage", "to_stage"], "left").select("from_stage", "to_stage", F.coalesce("count", F.lit(0)).alias("n"))


def threshold_sweep(traces: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)) -> DataFrame:
    """Stage shares of each configuration at each threshold, in one pass."""
    rows = traces.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    rows = rows.withColumn("stage", stage(F.col("threshold")))
    return rows.groupBy("configuration", "threshold").agg(*[F.avg((F.col("stage") == s).cast("double")).alias(f"share_{s.lower()}") for s in STAGES])


def decomposition(traces: DataFrame, baseline: str, threshold: float = ENOUGH, n_boot: int = RESAMPLES) -> DataFrame:
    """configuration, stage, n, diff, lo, hi, p, p_holm, moved, net_reachable, dominant: how each configuration changes the
    shares of the stages against the baseline; dominant is the blocking stage with the largest change that is resolved."""
    rows = attributed(traces, threshold)
    base = rows.where(F.col("configuration") == baseline).select("question_id", F.col("stage").alias("b_stage"))
    both = rows.where(F.col("configuration") != baseline).select("configuration", "question_id", "stage").join(base, "question_id")
    moved = both.groupBy("configuration").agg(F.count_if(F.col("stage") != F.col("b_stage")).alias("moved"), (F.count_if(F.col("stage") == "R") - F.count_if(F.col("b_stage") == "R")).alias("net_reachable"))
    long = both.select("configuration", "question_id", F.explode(F.array(*map(F.lit, STAGES))).alias("at"), "stage", "b_stage")
    long = long.select("configuration", "question_id", F.col("at").alias("stage"), (F.col("stage") == F.col("at")).cast("double").alias("a"), (F.col("b_stage") == F.col("at")).cast("double").alias("b"))
    test = paired_bootstrap(long, ["configuration", "stage"], "question_id", n_boot).drop("dz")
    blocking = holm(test.where(F.col("stage") != "R"), ["configuration"], "p", "stage").select("configuration", "stage", "p_holm")
    test = test.join(blocking, ["configuration", "stage"], "left")
    resolved = ((F.col("lo") > 0) | (F.col("hi") < 0)) & (F.col("p_holm") < 0.05)
    top = test.where(resolved).groupBy("configuration").agg(F.max_by("stage", F.struct(F.abs("diff"), "stage")).alias("dominant"))
    return test.join(moved, "configuration").join(top, "configuration", "left")


def trace_defects(traces: DataFrame) -> DataFrame:
    """How many rows break a rule that every trace keeps."""
    c = F.col
    return traces.agg(
        F.count_if(c("in_top_5") & ~c("in_top_20")).alias("in_5_not_20"), F.count_if((c("coverage") > 1e-4) & ~c("in_top_5")).alias("covered_not_in_5"),
        F.count_if((c("coverage") < -1e-4) | (c("coverage") > 1 + 1e-4)).alias("coverage_range"), F.count_if((c("mrr") > 0) & ~c("in_top_20")).alias("mrr_not_in_20"),
    )


def above_ceiling(traces: DataFrame) -> DataFrame:
    """Rows whose coverage is above what their segmentation allows."""
    return traces.where(F.col("coverage") > F.col("ceiling") + 1e-4)


def outcomes(answers: DataFrame, stages: DataFrame, threshold: float = 0.15) -> DataFrame:
    """configuration, question_id, stage, abstained, correct and outcome of answers (configuration, question_id, token_f1,
    abstained): the stage that blocked the question, else OK or S4. Of several answers the best scored counts, then one
    that does not abstain; a missing score fails."""
    first = F.row_number().over(Window.partitionBy("configuration", "question_id").orderBy(F.desc_nulls_last("token_f1"), "abstained"))
    one = answers.select("configuration", "question_id", "token_f1", "abstained").withColumn("nth", first).where("nth = 1")
    ok = F.coalesce(F.col("token_f1") >= threshold, F.lit(False))
    rows = one.join(stages.select("configuration", "question_id", "stage"), ["configuration", "question_id"])
    outcome = F.when(F.col("stage") != "R", F.col("stage")).when(ok, "OK").otherwise("S4")
    return rows.select("configuration", "question_id", "stage", F.coalesce(F.col("abstained").cast("boolean"), F.lit(False)).alias("abstained"), ok.alias("correct"), outcome.alias("outcome"))


def _share(c: Column) -> Column:
    return F.avg(c.cast("double"))


def outcome_summary(rows: DataFrame, centre: str) -> DataFrame:
    """For each configuration of ``outcomes``: shares of the outcomes, correct answers outside the reach, the share of S4 that
    refused, and the reach that was lost: questions reachable at the centre but not here, and those of them whose answer
    was wrong at the centre."""
    at = rows.where(F.col("configuration") == centre).select("question_id", F.col("outcome").alias("was"))
    both = rows.join(at, "question_id", "left")
    gone = F.col("was").isin("OK", "S4") & ~F.col("outcome").isin("OK", "S4")
    return both.groupBy("configuration").agg(
        F.count(F.lit(1)).alias("n"), *[_share(F.col("outcome") == s).alias(f"share_{s.lower()}") for s in ("S1", "S2", "S3", "S4", "OK")],
        F.count_if((F.col("stage") != "R") & F.col("correct")).alias("correct_outside_reachable"), F.avg(F.when(F.col("outcome") == "S4", F.col("abstained").cast("double"))).alias("s4_refusal_share"),
        F.count_if(gone).alias("lost_reach"), F.count_if(gone & (F.col("was") == "S4")).alias("lost_reach_s4"),
    )


def outcome_contrasts(rows: DataFrame, centre: str, n_boot: int = RESAMPLES) -> DataFrame:
    """Each configuration's share of correct answers against the centre's, paired by question, adjusted over all of them."""
    long = rows.select(F.col("configuration").alias("level"), F.col("question_id").alias("id"), F.col("correct").cast("double").alias("x"))
    return against_baseline(long, centre, n_boot=n_boot).withColumnRenamed("level", "configuration")


def outcomes_by_stage(rows: DataFrame, by: tuple[str, ...] = ("stage",)) -> DataFrame:
    """Correct and abstaining answers of each stage."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _share(F.col("correct")).alias("correct"), _share(F.col("abstained")).alias("abstained"))


def outcome_totals(rows: DataFrame) -> DataFrame:
    """One row over all configurations: questions, and abstention and correctness inside and outside the reach."""
    reach = F.col("stage") == "R"
    part = lambda c, when: F.avg(F.when(when, F.col(c).cast("double")))
    return rows.agg(
        F.countDistinct("question_id").alias("questions"), part("abstained", reach).alias("abstention_reachable"), part("abstained", ~reach).alias("abstention_blocked"),
        part("correct", reach).alias("correct_reachable"), part("correct", ~reach).alias("correct_blocked"), part("abstained", F.col("outcome") == "S4").alias("s4_refusal_share"),
    )


def prompt_comparison(first: DataFrame, second: DataFrame, centre: str, n_boot: int = RESAMPLES) -> DataFrame:
    """Two runs of ``outcomes`` over the same retrieval, paired by configuration and question, in groups.

    Groups: all pairs and those of the centre, each also inside and outside the reach, every configuration, and every
    stage. Rows: grp, n, shares of correct and abstaining answers in both runs, and the paired change of both. A resample
    draws pairs. ``same_stage`` says whether all pairs of the group have one stage in both runs.
    """
    keys = ["configuration", "question_id"]
    cols = lambda df, end: df.select(*keys, *[F.col(c).alias(f"{c}_{end}") for c in ("stage", "correct", "abstained")])
    both = cols(first, "a").join(cols(second, "b"), keys)
    at, reach = F.col("configuration") == centre, F.col("stage_a") == "R"
    groups = F.array_compact(F.array(
        F.lit("all"), F.when(reach, "all reachable").otherwise("all blocked"), F.when(at, "centre"), F.when(at & reach, "centre reachable"), F.when(at & ~reach, "centre blocked"),
        F.concat(F.lit("configuration "), F.col("configuration")), F.concat(F.lit("stage "), F.col("stage_a")),
    ))
    rows = both.withColumn("grp", F.explode(groups)).withColumn("pair", F.concat_ws("|", *keys))
    base = rows.groupBy("grp").agg(F.bool_and(F.col("stage_a") == F.col("stage_b")).alias("same_stage"), *[_share(F.col(f"{c}_{e}")).alias(f"{c}_{n}") for c in ("correct", "abstained") for e, n in (("a", "first"), ("b", "second"))])
    long = rows.select("grp", "pair", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_b").cast("double").alias("a"), F.col(f"{m}_a").cast("double").alias("b")) for m in ("correct", "abstained")])).alias("s"))
    test = paired_bootstrap(long.select("grp", "pair", "s.*"), ["grp", "metric"], "pair", n_boot)
    of = lambda m: test.where(F.col("metric") == m).select("grp", *[F.col(c).alias(f"{c}_{m}") for c in ("diff", "lo", "hi", "p")])
    n = test.where("metric = 'correct'").select("grp", "n")
    return base.join(n, "grp").join(of("correct"), "grp").join(of("abstained"), "grp")


def reviewed_outcomes(reviewed: DataFrame, by: list[str], threshold: float = ENOUGH) -> DataFrame:
    """One row for each group of reviewed answers (trace columns and ``label``): the partition, labels, label by stage, and what
    the rule gets right: correct and partial answers in and outside the reach, S4 strictly and with partial answers passed."""
    rows = reviewed.withColumn("label", F.lower(F.trim("label"))).withColumn("stage", stage(threshold))
    reach, label = F.col("stage") == "R", F.col("label")
    names = ("correct", "partial", "incorrect")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("stage") == s).alias(f"n_{s.lower()}") for s in STAGES], *[F.count_if(label == x).alias(x) for x in names],
        *[F.count_if((F.col("stage") == s) & (label == x)).alias(f"{s.lower()}_{x}") for s in STAGES for x in names],
        F.count_if(~reach & (label == "correct")).alias("correct_outside_reachable"), F.count_if(~reach & (label == "partial")).alias("partial_outside_reachable"),
        F.count_if(reach & (label != "correct")).alias("s4_strict"), F.count_if(reach & ~label.isin("correct", "partial")).alias("s4_lenient"),
    )


def ablation(first: DataFrame, second: DataFrame, threshold: float = ENOUGH) -> DataFrame:
    """One row on two reviewed runs (trace columns, question_id, segment_ids, label): whether questions, contexts and partition are
    the same, and what the second gains in correct answers, inside the reach, and in S4."""
    take = lambda df, e: df.select("question_id", F.col("segment_ids").alias(f"s_{e}"), stage(threshold).alias(f"g_{e}"), (F.lower(F.trim("label")) == "correct").alias(f"c_{e}"))
    both = take(first, "a").join(take(second, "b"), "question_id", "full")
    paired = F.col("g_a").isNotNull() & F.col("g_b").isNotNull()
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    inside = lambda e: n(F.col(f"c_{e}") & (F.col(f"g_{e}") == "R"))
    failed = lambda e: n(~F.col(f"c_{e}") & (F.col(f"g_{e}") == "R"))
    parts = [n(F.col("g_a") == s) == n(F.col("g_b") == s) for s in STAGES]
    return both.agg(
        F.bool_and(paired).alias("same_questions"), F.bool_and(F.coalesce(F.col("s_a") == F.col("s_b"), F.lit(False))).alias("identical_contexts"), (parts[0] & parts[1] & parts[2] & parts[3]).alias("identical_partition"),
        (n(F.col("c_b")) - n(F.col("c_a"))).alias("gain_correct"), (inside("b") - inside("a")).alias("gain_inside_reachable"), (failed("b") - failed("a")).alias("s4_strict_change"),
    )


def reviewed_check(reviewed: DataFrame, check: float = 0.15, threshold: float = ENOUGH) -> DataFrame:
    """One row on reviewed answers (trace columns, token_f1, label): blocked ones, those of them that pass the check or are
    labelled correct, and the labels of those that pass."""
    rows = reviewed.withColumn("blocked", stage(threshold) != "R").withColumn("passes", F.coalesce(F.col("token_f1") >= check, F.lit(False))).withColumn("label", F.lower(F.trim("label")))
    passing = F.col("blocked") & F.col("passes")
    return rows.agg(F.count_if("blocked").alias("blocked"), F.count_if(passing).alias("blocked_passing"), F.count_if(F.col("blocked") & (F.col("label") == "correct")).alias("blocked_correct"), *[F.count_if(passing & (F.col("label") == x)).alias(f"passing_{x}") for x in ("correct", "partial", "incorrect")])


def sophistication_path(parts: DataFrame, path: tuple[str, ...]) -> DataFrame:
    """step and the stage profile of ``partition`` along a path of configurations; those that are not there are left out."""
    order = parts.sparkSession.createDataFrame([(i, c) for i, c in enumerate(path)], "step int, configuration string")
    return F.broadcast(order).join(parts, "configuration").select("step", "configuration", *[f"share_{s.lower()}" for s in STAGES], "blocked")


def identity_defects(copies: dict[str, DataFrame], fields: tuple[str, ...] = ("in_top_20", "in_top_5", "coverage")) -> DataFrame:
    """question_id and how many values its copies have between them, of questions whose independently measured copies of one
    configuration differ, or that a copy lacks."""
    every = None
    for name, df in copies.items():
        rows = df.select("question_id", F.lit(name).alias("copy"), F.struct(*fields).alias("v"))
        every = rows if every is None else every.unionByName(rows)
    found = every.groupBy("question_id").agg(F.countDistinct("v").alias("values"), F.countDistinct("copy").alias("copies"))
    return found.where((F.col("values") > 1) | (F.col("copies") < len(copies)))


def calibrated_threshold(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: the threshold of a fixed grid with the best balanced accuracy (ties to the one nearest 0.15), with agreement,
    kappa and false passes."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(69)), lambda i: F.round(0.05 + 0.005 * i, 3)))
    rows = rows.select(F.col(score).cast("double").alias("s"), F.col(positive).alias("y")).select("*", grid.alias("threshold"))
    pred, y = F.col("s") >= F.col("threshold"), F.col("y")
    n = rows.groupBy("threshold").agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"), F.count_if(~pred & y).alias("fn"), F.count_if(~pred & ~y).alias("tn"))
    c = F.col
    total = c("tp") + c("fp") + c("fn") + c("tn")
    bal = (c("tp") / F.greatest(F.lit(1), c("tp") + c("fn")) + c("tn") / F.greatest(F.lit(1), c("tn") + c("fp"))) / 2
    chance = (c("tp") + c("fp")) / total * (c("tp") + c("fn")) / total + (c("fn") + c("tn")) / total * (c("tn") + c("fp")) / total
    n = n.withColumn("balanced_accuracy", F.round(bal, 9)).withColumn("agreement", (c("tp") + c("tn")) / total)
    n = n.withColumn("kappa", F.when(chance < 1, (c("agreement") - chance) / (1 - chance))).withColumn("false_pass_rate", c("fp") / F.greatest(F.lit(1), c("fp") + c("tn")))
    best = n.agg(F.max_by(F.struct("threshold", "balanced_accuracy", "agreement", "kappa", "false_pass_rate", total.alias("n"), (c("tp") + c("fn")).alias("positives")), F.struct("balanced_accuracy", -F.round(F.abs(c("threshold") - 0.15), 6), -c("threshold"))).alias("b"))
    return best.select("b.*")
