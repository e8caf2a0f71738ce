"""Certainty: query-time signals, a logistic score, its calibration, and bands."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_body, bind, cited_segments, is_abstention
from ..sources.sinks import materialised
from .retrieval import ROW, ranked
from .resampling import drawn_ranks, draws
from .statistics import interval

CUTS = (0.35, 0.60, 0.85)
BANDS = ("insufficient", "low", "probable", "certain")
BINS = 10
SIGNALS = ("dense_top1", "dense_gap12", "dense_top5_mean", "dense_z_top1", "bm25_z_top1", "agree_top5", "agree_top1_doc", "ctx_docs", "top1_doc_share", "log_query_tokens")
#: Computed and audited, but no feature: it depends on how candidates were offered.
EXCLUDED = ("log_candidates",)
RERANK_SIGNALS = ("rerank_top1", "rerank_gap12", "rerank_std")
CITATION_BANDS = ("low", "medium", "high")
#: Resamples of AUROC intervals and of the citation test.
AUROC_RESAMPLES, CITATION_RESAMPLES = 2000, 1000
#: Rows of a part of the scores, about, that a task ranks in a chunk of resamples.
PART = 8192


def signals(asked: DataFrame, dense: DataFrame, lexical: DataFrame, traces: DataFrame, k: int = 5) -> DataFrame:
    """One row for each question: its signals, null with fewer than two candidates, and labels from the same ranking.

    ``log_candidates`` is computed but is no feature, as it depends on how candidates were offered.
    """
    a, b = ranked(dense), ranked(lexical)
    z = lambda c: (F.max(c) - F.avg(c)) / (F.stddev_pop(c) + 1e-9)
    top = F.col("rnk") <= k
    d = a.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("rnk") == 1, F.col("score"))).alias("dense_top1"), F.max(F.when(F.col("rnk") == 2, F.col("score"))).alias("second"),
        F.avg(F.when(top, F.col("score"))).alias("dense_top5_mean"), z("score").alias("dense_z_top1"), F.countDistinct(F.when(top, F.col("doc_id"))).alias("ctx_docs"),
        F.collect_set(F.when(top, F.struct(*ROW))).alias("set_a"), F.max(F.when(F.col("rnk") == 1, F.col("doc_id"))).alias("doc_a"),
    )
    first = a.where(top).select("question_id", "doc_id").join(d.select("question_id", "doc_a"), "question_id").groupBy("question_id").agg(F.avg((F.col("doc_id") == F.col("doc_a")).cast("double")).alias("top1_doc_share"))
    x = b.groupBy("question_id").agg(z("score").alias("bm25_z_top1"), F.collect_set(F.when(top, F.struct(*ROW))).alias("set_b"), F.max(F.when(F.col("rnk") == 1, F.col("doc_id"))).alias("doc_b"))
    rows = asked.select("question_id", "split", "answerable", "query").join(d, "question_id", "left").join(x, "question_id", "left").join(first, "question_id", "left")
    enough = lambda c, n: F.when(F.col("n") >= 2, c).cast("double").alias(n)
    label = traces.select("question_id", (F.col("in_top_20") & F.col("in_top_5") & (F.col("coverage") >= 0.80)).alias("reached"))
    rows = rows.join(label, "question_id", "left")
    stage = F.when(~F.col("answerable"), "U").when(F.coalesce("n", F.lit(0)) < 2, "S1").when(F.col("reached"), "R").otherwise("B")
    return rows.select(
        "question_id", "split", "answerable", enough(F.col("dense_top1"), "dense_top1"), enough(F.col("dense_top1") - F.col("second"), "dense_gap12"), enough(F.col("dense_top5_mean"), "dense_top5_mean"),
        enough(F.col("dense_z_top1"), "dense_z_top1"), enough(F.col("bm25_z_top1"), "bm25_z_top1"), enough(F.size(F.array_intersect("set_a", "set_b")) / F.size(F.array_union("set_a", "set_b")), "agree_top5"),
        enough((F.col("doc_a") == F.col("doc_b")).cast("int"), "agree_top1_doc"), enough(F.col("ctx_docs"), "ctx_docs"), enough(F.col("top1_doc_share"), "top1_doc_share"),
        enough(F.log1p(F.size(F.split(F.trim("query"), r"\s+"))), "log_query_tokens"), enough(F.log1p("n"), "log_candidates"), stage.alias("label_stage"), (stage == "R").cast("double").alias("label_evidence"),
    )


def _by_score(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """by, s, n, pos: rows and positives of each distinct score; sums that combine on the map side."""
    x = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return x.groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(label) == 1).cast("long")).alias("pos"))


def _area(total: Column, pos: Column, ranks: Column) -> Column:
    return F.when((pos > 0) & (pos < total), (ranks - pos * (pos + 1) / 2) / (pos * (total - pos)))


def auroc(rows: DataFrame, by: list[str], score: str, label: str, parts: int | None = None) -> DataFrame:
    """by, n, positives, auroc by the rank sum with ties shared; nulls left out, null with one class only.

    In two levels: scores are counted, cut into ``parts`` ranges at approximate quantiles, and ranked within a range behind
    the rows of the ranges below, so that a task holds one range of one group.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _by_score(rows, by, score, label)
    on = (lambda x, y: x.join(F.broadcast(y), by)) if by else (lambda x, y: x.join(F.broadcast(y), F.lit(True)))
    cuts = found.groupBy(*by).agg(F.percentile_approx("s", F.array(*[F.lit(k / parts) for k in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5)), F.lit(1000)).alias("cuts"))
    found = on(found, cuts).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("s")))).drop("cuts")
    sums = found.groupBy(*by, "part").agg(F.sum("n").alias("part_n"))
    below = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "part", F.coalesce(F.sum("part_n").over(below), F.lit(0)).alias("below"))
    within = Window.partitionBy(*by, "part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked_ = found.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, [*by, "part"])
    mean_rank = F.col("below") + F.col("before") + (F.col("n") + 1) / 2
    one = ranked_.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("pos").alias("positives"), F.sum(F.col("pos") * mean_rank).alias("_r"))
    return one.select(*by, "n", "positives", _area(F.col("n"), F.col("positives"), F.col("_r")).alias("auroc"))


def auroc_ci(rows: DataFrame, by: list[str], unit: str, score: str, label: str, n_boot: int = AUROC_RESAMPLES) -> DataFrame:
    """by, n, positives, auroc, lo, hi: resamples draw units; those with one class only are left out."""
    x = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*by, F.col(unit).alias("_u"), F.col(score).cast("double").alias("s"), (F.col(label) == 1).cast("long").alias("y"))
    key = by or ["_one"]
    x = materialised(x if by else x.withColumn("_one", F.lit(1)))
    most = x.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-most // PART)
    ends = F.array(*[F.lit(k / parts) for k in range(1, parts)]) if parts > 1 else F.array(F.lit(1.0))
    cuts = x.groupBy(*key).agg(F.array_distinct(F.percentile_approx("s", ends, F.lit(max(1000, 10 * parts)))).alias("cuts"))
    drawn = drawn_ranks(x, key, "_u", "s", "y", n_boot, cuts)
    areas = drawn.select(*key, _area(F.col("n"), F.col("pos"), F.col("r")).alias("area")).where("area is not null")
    ci = areas.groupBy(*by).agg(*interval("area"))
    base = auroc(rows, by, score, label)
    return base.join(ci, by, "left") if by else base.join(ci, F.lit(True), "left")


def univariate(rows: DataFrame, features: tuple[str, ...] = (*SIGNALS, *EXCLUDED), label: str = "label_evidence", unit: str = "question_id", n_boot: int = AUROC_RESAMPLES) -> DataFrame:
    """signal, n, positives, auroc with its interval, strength (free of direction), direction, and whether the model may use it."""
    long = rows.select(F.col(unit).alias("unit"), F.explode(F.array(*[F.struct(F.lit(f).alias("signal"), F.col(f).alias("x")) for f in features])).alias("s"), label).select("unit", "s.signal", "s.x", label)
    out = auroc_ci(long, ["signal"], "unit", "x", label, n_boot)
    return out.withColumn("strength", F.greatest("auroc", 1 - F.col("auroc"))).withColumn("direction", F.when(F.col("auroc") >= 0.5, 1).otherwise(-1)).withColumn("used", ~F.col("signal").isin(*EXCLUDED))


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def bin_of(score: Column, bins: int) -> Column:
    """The equal-width bin of a score."""
    return sum(((score >= i * (1 / bins)).cast("int") for i in range(1, bins)), F.lit(0))


def binned(rows: DataFrame, score: str, label: str, bins: int = BINS) -> DataFrame:
    """bin, n, mean_score, rate for every equal-width bin, empty ones too; a score on an edge belongs above it, 1 to the last."""
    got = rows.withColumn("bin", bin_of(F.col(score), bins)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_score", "rate")


def calibration_error(rows: DataFrame, score: str, label: str, bins: int = BINS) -> DataFrame:
    """One row: brier, ece."""
    one = rows.agg(brier(F.col(score), F.col(label)).alias("brier"))
    gap = binned(rows, score, label, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))
    return one.join(gap, F.lit(True))


def band(score: Column, cuts: tuple[float, ...] = CUTS) -> Column:
    """The band of a score; a cut belongs to the band above it."""
    return F.when(score >= cuts[2], BANDS[3]).when(score >= cuts[1], BANDS[2]).when(score >= cuts[0], BANDS[1]).otherwise(BANDS[0])


def band_table(rows: DataFrame, score: str, label: str) -> DataFrame:
    """band, n, share, mean_score, rate of each band, empty ones too."""
    got = rows.withColumn("band", band(F.col(score))).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))
    every = rows.sparkSession.createDataFrame([(b,) for b in BANDS], "band string")
    out = every.join(got, "band", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return out.join(total, F.lit(True)).select("band", "n", (F.col("n") / F.col("total")).alias("share"), "mean_score", "rate")


def stage_bands(rows: DataFrame, score: str, label: str = "label_evidence", stage: str = "label_stage") -> DataFrame:
    """``band_table`` of scored questions, with how many of each band are unanswerable, blocked and reachable."""
    of = F.when(F.col(score).isNotNull(), band(F.col(score)))
    n = rows.where(F.col(score).isNotNull()).groupBy(of.alias("band")).agg(F.count_if(F.col(stage) == "U").alias("unanswerable"), F.count_if(~F.col(stage).isin("R", "U")).alias("blocked"), F.count_if(F.col(stage) == "R").alias("reachable"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    table = band_table(rows.where(F.col(score).isNotNull()), score, label)
    return table.join(n, "band", "left").select(*table.columns, zero("unanswerable"), zero("blocked"), zero("reachable"))


def selective(rows: DataFrame, score: str, label: str, cut: float = CUTS[0]) -> DataFrame:
    """One row: the share withheld below the cut, of wrong and of right answers (caught, lost), and the rates of right ones."""
    held, y = F.col(score) < cut, F.col(label) == 1
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(held.cast("double")).alias("withheld_share"), F.avg(F.when(~y, held.cast("double"))).alias("caught"), F.avg(F.when(y, held.cast("double"))).alias("lost"),
        F.avg(F.when(~held, y.cast("double"))).alias("rate_answered"), F.avg(y.cast("double")).alias("rate_all"),
    )


class Logistic:
    """A logistic score on imputed, standardised features: L2 penalty, intercept free, Newton steps.

    Each step sums gradient and Hessian over the rows in Spark and solves the small system on the driver.
    """

    def __init__(self, features: tuple[str, ...], l2: float = 1.0, rounds: int = 100):
        self.features, self.l2, self.rounds = features, l2, rounds

    def fit(self, rows: DataFrame, label: str) -> "Logistic":
        f = self.features
        stats = rows.agg(*[F.percentile(c, F.lit(0.5)).alias(f"m{i}") for i, c in enumerate(f)]).first()
        self.median = [0.0 if stats[f"m{i}"] is None else float(stats[f"m{i}"]) for i in range(len(f))]
        filled = [F.coalesce(c, F.lit(m)) for c, m in zip(f, self.median)]
        s = rows.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(filled)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(filled)]).first()
        self.mean = [float(s[f"a{i}"] or 0.0) for i in range(len(f))]
        self.sd = [float(s[f"s{i}"]) if s[f"s{i}"] and s[f"s{i}"] > 1e-12 else 1.0 for i in range(len(f))]
        k = len(f) + 1
        self.weights = np.zeros(k)
        x = rows.select(F.array(F.lit(1.0), *self._scaled()).alias("x"), F.col(label).cast("double").alias("y")).where("y is not null")
        x = materialised(x)  # each step reads it
        for _ in range(self.rounds):
            z = self._logit(F.col("x"))
            p = 1 / (1 + F.exp(-z))
            g = [F.sum((p - F.col("y")) * F.col("x")[i]).alias(f"g{i}") for i in range(k)]
            h = [F.sum(p * (1 - p) * F.col("x")[i] * F.col("x")[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
            r = x.agg(*g, *h).first()
            if r["g0"] is None:
                break
            grad = np.array([r[f"g{i}"] for i in range(k)])
            hess = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            penalty = np.diag([0.0, *[self.l2] * len(f)])
            step = np.linalg.solve(hess + penalty + 1e-12 * np.eye(k), grad + penalty @ self.weights)
            self.weights = self.weights - step
            if np.abs(step).max() < 1e-10:
                break
        return self

    def _scaled(self) -> list[Column]:
        return [(F.coalesce(c, F.lit(m)) - a) / s for c, m, a, s in zip(self.features, self.median, self.mean, self.sd)]

    def _logit(self, x: Column) -> Column:
        z = F.lit(0.0)
        for i, w in enumerate(self.weights):
            z = z + F.lit(float(w)) * x[i]
        return F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))

    def score(self, shift: float = 0.0) -> Column:
        """The probability; ``shift`` moves the log-odds to another base rate."""
        return 1 / (1 + F.exp(-(self._logit(F.array(F.lit(1.0), *self._scaled())) + shift)))


def log_odds_shift(fitted: float | None, served: float | None) -> float:
    """The difference of two base rates in log-odds; 0 where one of them is none, 0 or 1."""
    if not (fitted and served and 0 < fitted < 1 and 0 < served < 1):
        return 0.0
    return float(np.log(served / (1 - served)) - np.log(fitted / (1 - fitted)))


def shifted(score: Column, shift: float) -> Column:
    """A probability moved by ``shift`` in log-odds."""
    return bind(F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), score)), lambda p: 1 / (1 + F.exp(-(F.ln(p / (1 - p)) + shift))))


def cross_fitted(rows: DataFrame, features: tuple[str, ...], label: str, split: str = "split", parts: tuple[str, str] = ("train", "dev")) -> DataFrame:
    """Each part with ``score`` by the model of the other, and ``score_shifted`` to the base rate of its own.

    A part without rows is neither scored nor fitted on.
    """
    rates = {r[split]: r["m"] for r in rows.groupBy(split).agg(F.avg(label).alias("m")).collect()}  # one for each part
    out = rows.where("1 = 0").withColumns({"score": F.lit(0.0), "score_shifted": F.lit(0.0)})
    for fit, test in (parts, parts[::-1]):
        if fit in rates and test in rates:
            model = Logistic(features).fit(rows.where(F.col(split) == fit), label)
            got = rows.where(F.col(split) == test).withColumn("score", model.score())
            out = out.unionByName(got.withColumn("score_shifted", shifted(F.col("score"), log_odds_shift(rates[fit], rates[test]))))
    return out


def evaluate(scored: DataFrame, label: str, fitted_rate: float, unit: str, top: str, answerable: str, n_boot: int = AUROC_RESAMPLES) -> DataFrame:
    """One row for the scores and one for the shifted scores of a test split: what ranking and probabilities are worth.

    form, n, base rates, AUROC with interval, of the first signal alone, and among answerable questions; Brier score, that
    of the fitted base rate, skill, calibration error, and mean score.
    """
    forms = {"as fitted": "score", "shifted": "score_shifted"}
    rows = scored.select(F.col(unit).alias("unit"), F.col(label).cast("double").alias("y"), F.col(top).cast("double").alias("top"), F.col(answerable).alias("ok"), *forms.values())
    rows = materialised(rows)  # several steps read it
    of = lambda form, c: rows.select(F.lit(form).alias("form"), "unit", F.col(c).alias("p"), "y", "ok")
    long = of("as fitted", "score").unionByName(of("shifted", "score_shifted"))
    by = ["form"]
    # Both forms and the first signal draw the same units, so one call makes their draws once.
    areas = materialised(auroc_ci(long.unionByName(of("top", "top")), by, "unit", "p", "y", n_boot))
    area = areas.where("form <> 'top'").select("form", "auroc", F.col("lo").alias("auroc_lo"), F.col("hi").alias("auroc_hi"))
    first = areas.where("form = 'top'").select(F.col("auroc").alias("auroc_top1_only"), F.col("lo").alias("auroc_top1_lo"), F.col("hi").alias("auroc_top1_hi"))
    only = auroc(long.where("ok"), by, "p", "y").select("form", F.col("auroc").alias("auroc_answerable_only"))
    base = F.lit(float(fitted_rate))
    p, y = F.col("p"), F.col("y")
    one = long.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("base_rate_test"), brier(p, y).alias("brier"), brier(base, y).alias("brier_base_rate"), F.avg("p").alias("mean_score"))
    one = one.withColumn("base_rate_fit", base).withColumn("brier_skill", F.when(F.col("brier_base_rate") > 0, 1 - F.col("brier") / F.col("brier_base_rate")))
    bins = long.groupBy("form", bin_of(p, BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    ece = bins.groupBy("form").agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    return one.join(area, by).join(first, F.lit(True)).join(only, by, "left").join(ece, by)


def citation_features(answer: Column, top_doc: Column) -> Column:
    """Struct of n_cited, cites_top, abstained and band. low: abstained, nothing cited, or three segments or more; high: one or two
    with the top document; else medium. An answer abstains if it or its body does."""
    once = F.struct(cited_segments(answer).alias("c"), (is_abstention(answer) | is_abstention(answer_body(answer))).alias("out"), top_doc.cast("string").alias("top"))

    def judge(v: Column) -> Column:
        n, top = F.size(v["c"]), F.coalesce(F.exists(v["c"], lambda c: F.split(c, "::")[0] == v["top"]), F.lit(False))
        name = F.when(v["out"] | (n == 0) | (n >= 3), "low").when(top, "high").otherwise("medium")
        return F.struct(n.alias("n_cited"), top.alias("cites_top"), v["out"].alias("abstained"), name.alias("band"))

    return bind(once, judge)


def citation_band(answer: Column, top_doc: Column) -> Column:
    """The band of ``citation_features``."""
    return citation_features(answer, top_doc)["band"]


def credit(label: Column) -> Column:
    """What a reviewer's label is worth."""
    return F.when(label == "correct", 1.0).when(label == "partial", 0.5).otherwise(0.0)


def citation_table(rows: DataFrame, label: str) -> DataFrame:
    """band, n, correct, partial, incorrect, credit of rows with a citation ``band``, empty bands too."""
    y = F.lower(F.trim(F.col(label)))
    got = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(y == k).alias(k) for k in ("correct", "partial", "incorrect")], F.avg(credit(y)).alias("credit"))
    every = rows.sparkSession.createDataFrame([(b,) for b in CITATION_BANDS[::-1]], "band string")
    return every.join(got, "band", "left").select("band", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "correct", "partial", "incorrect")], "credit")


def tested_answers(answers: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Answers (question_id, configuration, answerable, answer, segment_ids, token_f1) with their citation features and ``correct``.

    The top document is that of the first segment. Answers to unanswerable questions are never correct.
    """
    top = F.split(F.split("segment_ids", r"\|")[0], "::")[0]
    rows = answers.withColumn("f", citation_features(F.col("answer"), top))
    ok = F.col("answerable") & F.coalesce(F.col("token_f1") >= threshold, F.lit(False))
    return rows.select("question_id", "configuration", "answerable", "token_f1", "f.*", ok.alias("correct"))


def band_correctness(tested: DataFrame, by: list[str]) -> DataFrame:
    """by, band, n, correct (share) of answers to answerable questions; every band of every group."""
    rows = tested.where("answerable")
    every = rows.select(*by).distinct().select(*by, F.explode(F.array(*map(F.lit, CITATION_BANDS))).alias("band")) if by else rows.sparkSession.createDataFrame([(b,) for b in CITATION_BANDS], "band string")
    got = rows.groupBy(*by, "band").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("correct"))
    return every.join(got, [*by, "band"], "left").select(*by, "band", F.coalesce("n", F.lit(0)).alias("n"), "correct")


def high_minus_low(tested: DataFrame, by: list[str], n_boot: int = CITATION_RESAMPLES) -> DataFrame:
    """by, high, low, diff, lo, hi: correct shares of the outer bands and their difference.

    Resamples draw whole questions, as one question has an answer in every configuration; each question's sums are made
    first, so that a resample adds one row for each question.
    """
    rows = tested.where("answerable")
    sums = lambda b: [F.count_if(F.col("band") == b).alias(f"n_{b}"), F.count_if((F.col("band") == b) & F.col("correct")).alias(f"c_{b}")]
    per = rows.groupBy(*by, "question_id").agg(*sums("high"), *sums("low"))
    share = lambda b, w: F.try_divide(F.sum(w * F.col(f"c_{b}")), F.sum(w * F.col(f"n_{b}")))  # noqa: E731  (null without answers)
    base = per.groupBy(*by).agg(share("high", F.lit(1)).alias("high"), share("low", F.lit(1)).alias("low"))
    drawn = draws(per, "question_id", n_boot, by)
    diffs = drawn.groupBy(*by, "b").agg((share("high", F.col("w")) - share("low", F.col("w"))).alias("d")).where("d is not null")
    ci = diffs.groupBy(*by).agg(*interval("d"))
    out = base.join(ci, by, "left") if by else base.join(ci, F.lit(True), "left")
    return out.select(*by, "high", "low", (F.col("high") - F.col("low")).alias("diff"), "lo", "hi")


def band_auroc(tested: DataFrame, by: list[str]) -> DataFrame:
    """AUROC of the citation band, as a number, for correct answers to answerable questions."""
    rank = F.when(F.col("band") == "high", 2.0).when(F.col("band") == "medium", 1.0).otherwise(0.0)
    return auroc(tested.where("answerable").withColumn("rank", rank).withColumn("y", F.col("correct").cast("int")), by, "rank", "y")


def low_band_shares(tested: DataFrame) -> DataFrame:
    """One row: how many questions and answers, and the share of the low band by answerability."""
    low = (F.col("band") == "low").cast("double")
    return tested.agg(F.countDistinct("question_id").alias("questions"), F.count(F.lit(1)).alias("answers"), F.avg(F.when(~F.col("answerable"), low)).alias("unanswerable_low_band"), F.avg(F.when(F.col("answerable"), low)).alias("answerable_low_band"))


def joint_bands(tested: DataFrame, scores: DataFrame) -> DataFrame:
    """retrieval_band, citation_band, n, correct, unanswerable of answers with a score (question_id, score_shifted); cells with answers."""
    rows = tested.join(scores.select("question_id", "score_shifted"), "question_id")
    return rows.groupBy(band(F.col("score_shifted")).alias("retrieval_band"), F.col("band").alias("citation_band")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("correct"), F.avg((~F.col("answerable")).cast("double")).alias("unanswerable"))


def joint_rule(tested: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: what withholding answers of the lowest band of either kind does to correctness."""
    rows = tested.join(scores.select("question_id", "score_shifted"), "question_id")
    held = (band(F.col("score_shifted")) == BANDS[0]) | (F.col("band") == CITATION_BANDS[0])
    ok, out = F.col("correct"), ~F.col("answerable")
    return rows.agg(
        F.avg(held.cast("double")).alias("withheld_share"), F.avg(F.when(~held, ok.cast("double"))).alias("correct_if_kept"), F.avg(ok.cast("double")).alias("correct_all"),
        (F.count_if(held & out) / F.greatest(F.lit(1), F.count_if(out))).alias("unanswerable_caught"), (F.count_if(held & ok) / F.greatest(F.lit(1), F.count_if(ok))).alias("correct_lost"),
    )
