"""Worked examples: one question, one answer or one contrast followed through its rows, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .attribution import ENOUGH, attributed
from .certainty import SIGNALS, band


def _of(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of the question in the one row of ``chosen``."""
    return rows.join(F.broadcast(chosen.select(F.col("question_id").alias("_q"))), F.col("question_id") == F.col("_q")).drop("_q")


def picked(rows: DataFrame, question_id: int | None = None) -> DataFrame:
    """One row: the given question if it is there, else the smallest."""
    wanted = F.lit(question_id).cast("long")
    return rows.agg(F.coalesce(F.max(F.when(F.col("question_id") == wanted, wanted)), F.min("question_id")).alias("question_id"))


def widest(traces: DataFrame, value: str = "coverage") -> DataFrame:
    """One row: the question over whose levels the value is spread most, the smallest of equal ones, and its spread."""
    spread = traces.groupBy("question_id").agg((F.max(value) - F.min(value)).alias("spread"))
    return spread.agg(F.max(F.struct(F.round("spread", 9).alias("spread"), (-F.col("question_id")).alias("q"))).alias("m")).select((-F.col("m.q")).alias("question_id"), F.col("m.spread").alias("spread"))


def chunking_example(traces: DataFrame, question_id: int | None = None) -> DataFrame:
    """A question under each segmentation (rows with ``method``), by default the one that they disagree on most, with the best
    and the worst method marked."""
    chosen = widest(traces) if question_id is None else picked(traces, question_id)
    rows = _of(traces, chosen)
    top = lambda f, n: (F.col("method") == f(F.struct("coverage", "method")).over(Window.partitionBy("question_id"))["method"]).alias(n)
    return rows.select("question_id", "method", "coverage", "ndcg_5", "in_top_5", top(F.max, "best"), top(F.min, "worst"))


def retrieval_example(traces: DataFrame, question_id: int | None = None) -> DataFrame:
    """A question under each retriever."""
    return _of(traces, picked(traces, question_id)).select("question_id", "configuration", "gold_rank", "recall_20", "coverage")


def reranking_example(off: DataFrame, on: DataFrame, question_id: int | None = None) -> DataFrame:
    """A question without and with reranking, by default the first whose coverage it changes, else the first."""
    both = off.select("question_id", F.round("coverage", 9).alias("x")).join(on.select("question_id", F.round("coverage", 9).alias("y")), "question_id")
    changed = both.agg(F.coalesce(F.min(F.when(F.col("x") != F.col("y"), F.col("question_id"))), F.min("question_id")).alias("question_id"))
    chosen = changed if question_id is None else picked(off, question_id)
    rows = off.withColumn("reranking", F.lit("off")).unionByName(on.withColumn("reranking", F.lit("on")))
    return _of(rows, chosen).select("question_id", "reranking", "in_top_5", "coverage", "context_precision")


def effects_example(centre: DataFrame, level: DataFrame, value: str = "coverage") -> DataFrame:
    """One row: the paired column behind a contrast - means, how many questions are worse, unchanged or better, the largest loss."""
    both = centre.select("question_id", F.col(value).alias("a")).join(level.select("question_id", F.col(value).alias("b")), "question_id").where("a is not null and b is not null")
    both = both.withColumn("d", F.round(F.col("b") - F.col("a"), 9))
    worst = F.min(F.struct("d", "question_id"))
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_centre"), F.avg("b").alias("mean_level"), F.avg("d").alias("mean_diff"), F.count_if(F.col("d") < 0).alias("worse"),
        F.count_if(F.col("d") == 0).alias("unchanged"), F.count_if(F.col("d") > 0).alias("better"), worst["question_id"].alias("largest_loss"), worst["d"].alias("loss"),
    )


def generation_example(scored: DataFrame, configuration: str, question_id: int | None = None, threshold: float = 0.15, chars: int = 420) -> DataFrame:
    """One answer to an answerable question: its segments, its beginning, its scores, and whether it passes."""
    rows = scored.where((F.col("configuration") == configuration) & F.col("answerable"))
    return _of(rows, picked(rows, question_id)).select("question_id", "configuration", "segment_ids", F.substring("answer", 1, chars).alias("answer"), "n_cited", "groundedness", "faithfulness", "token_f1", "abstained", F.coalesce(F.col("token_f1") >= threshold, F.lit(False)).alias("passes"))


def attribution_example(traces: DataFrame, configuration: str, question_id: int | None = None, threshold: float = ENOUGH) -> DataFrame:
    """A blocked question (the first, or any if none is) under the tests in the order of the pipeline: test, observed, passed, read.

    Tests behind the first that fails are not read.
    """
    rows = attributed(traces.where(F.col("configuration") == configuration), threshold)
    first = rows.agg(F.coalesce(F.min(F.when(F.col("stage") != "R", F.col("question_id"))), F.min("question_id")).alias("question_id"))
    one = _of(rows, first if question_id is None else picked(rows, question_id))
    ceiling, coverage = F.coalesce("ceiling", F.lit(1.0)), F.coalesce("coverage", F.lit(0.0))
    tests = [(1, "segmentation", ceiling, ceiling >= threshold), (2, "retrieval", F.col("in_top_20").cast("double"), F.col("in_top_20")), (3, "context", coverage, F.col("in_top_5") & (coverage >= threshold))]
    steps = F.explode(F.array(*[F.struct(F.lit(n).alias("step"), F.lit(name).alias("test"), seen.alias("observed"), ok.alias("passed")) for n, name, seen, ok in tests]))
    long = one.select("question_id", "stage", steps.alias("t")).select("question_id", "stage", "t.*")
    failed = F.count_if(~F.col("passed")).over(Window.partitionBy("question_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return long.withColumn("read", F.coalesce(failed, F.lit(0)) == 0)


def prompt_example(outcomes: DataFrame, configuration: str, question_id: int | None = None) -> DataFrame:
    """Stage and outcome of one question."""
    rows = outcomes.where(F.col("configuration") == configuration)
    return _of(rows, picked(rows, question_id)).select("question_id", "stage", "abstained", "correct", "outcome")


def certainty_example(scored: DataFrame, split: str = "dev", question_id: int | None = None, features: tuple[str, ...] = SIGNALS) -> DataFrame:
    """One question's signals, its cross-fitted score, the band, and whether the evidence arrived."""
    rows = scored.where(F.col("split") == split)
    return _of(rows, picked(rows, question_id)).select("question_id", *features, "score", band(F.col("score")).alias("band"), "label_evidence")


def citation_example(tested: DataFrame, wanted: str = "high") -> DataFrame:
    """The first answer in a band: what it cites, and whether it passes."""
    rows = tested.where(F.col("band") == wanted)
    nth = F.row_number().over(Window.orderBy("question_id", "configuration"))
    first = rows.agg(F.min(F.struct("question_id", "configuration")).alias("m")).select("m.*")
    out = rows.join(F.broadcast(first), ["question_id", "configuration"]).withColumn("nth", nth).where("nth = 1")
    return out.select("question_id", "configuration", "n_cited", "cites_top", "abstained", "band", "token_f1", "correct")


def segmentation_scenario(by_method: DataFrame, by_retriever: DataFrame, question_id: int | None = None) -> DataFrame:
    """The question that segmentations disagree on most under each method, then under each retriever."""
    chosen = widest(by_method) if question_id is None else picked(by_method, question_id)
    a = _of(by_method, chosen).select("question_id", F.lit("segmentation").alias("changed"), F.col("method").alias("level"), "gold_rank", "coverage")
    b = _of(by_retriever, chosen).select("question_id", F.lit("retriever").alias("changed"), F.col("configuration").alias("level"), "gold_rank", "coverage")
    return a.unionByName(b)


def attribution_scenario(traces: DataFrame, configuration: str, question_id: int | None = None) -> DataFrame:
    """``attribution_example`` and, on each row, the share of all questions whose evidence arrives: the generator's upper bound."""
    rows = attributed(traces.where(F.col("configuration") == configuration))
    reach = rows.agg(F.count(F.lit(1)).alias("questions"), F.avg((F.col("stage") == "R").cast("double")).alias("reachable"))
    return attribution_example(traces, configuration, question_id).join(F.broadcast(reach), F.lit(True))


def certainty_scenario(scored: DataFrame, split: str = "dev") -> DataFrame:
    """The questions with the lowest and the highest score of a split: band, two signals, and whether the evidence arrived."""
    rows = scored.where((F.col("split") == split) & F.col("score").isNotNull())
    ends = rows.agg(F.min(F.struct("score", "question_id")).alias("lo"), F.max(F.struct("score", "question_id")).alias("hi"))
    ends = ends.select(F.explode(F.array(F.struct(F.lit("lowest").alias("end"), F.col("lo.question_id").alias("question_id")), F.struct(F.lit("highest").alias("end"), F.col("hi.question_id").alias("question_id")))).alias("e")).select("e.*")
    return rows.join(F.broadcast(ends), "question_id").select("end", "question_id", "score", band(F.col("score")).alias("band"), "dense_z_top1", "agree_top5", "label_evidence")
