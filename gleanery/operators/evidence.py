"""Evidence metrics: how much of a question's gold span a ranking brings, and the most that a segmentation allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH, CONTEXT, ENOUGH = 20, 5, 0.80


def union_coverage(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys and coverage: the share of [lo, hi) that the union of intervals (a, b) covers; touching intervals merge.

    Rows of ``spans``: keys, lo, hi, a, b.
    """
    cut = spans.where("b > lo and a < hi").select(*keys, "lo", "hi", F.greatest("a", "lo").alias("a"), F.least("b", "hi").alias("b"))
    w = Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    seen = cut.withColumn("seen", F.max("b").over(w))
    fresh = F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce("seen", F.col("a"))))
    return seen.groupBy(*keys).agg((F.sum(fresh) / F.greatest(F.lit(1), F.max(F.col("hi") - F.col("lo")))).alias("coverage"))


def evidence_metrics(asked: DataFrame, ranking: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each answerable question: rank of the gold document among distinct documents of the first 20 chunks, its
    presence in 20 and 5 chunks, coverage and precision of the 5 chunks of the context, and recall, precision and nDCG at
    5, 10 and 20.
    """
    gold = asked.where("answerable").select("question_id", "split", "gold_doc", "gold_start", "gold_end")
    top = ranking.where(F.col("rnk") <= DEPTH).join(chunks, ["doc_id", "chunk_no"])
    docs = top.groupBy("question_id", "doc_id").agg(F.min("rnk").alias("first"))
    docs = docs.withColumn("gold_rank", F.row_number().over(Window.partitionBy("question_id").orderBy("first")))
    rank = gold.join(docs, (docs.question_id == gold.question_id) & (docs.doc_id == gold.gold_doc)).select(gold.question_id, "gold_rank")
    context = top.where(F.col("rnk") <= CONTEXT).join(gold, "question_id")
    hit = (F.col("doc_id") == F.col("gold_doc")) & (F.col("char_end") > F.col("gold_start")) & (F.col("char_start") < F.col("gold_end"))
    seen = context.groupBy("question_id").agg(F.max(F.col("doc_id") == F.col("gold_doc")).alias("in_top_5"), F.avg(hit.cast("double")).alias("context_precision"))
    cover = union_coverage(context.where(hit).select("question_id", F.col("gold_start").alias("lo"), F.col("gold_end").alias("hi"), F.col("char_start").alias("a"), F.col("char_end").alias("b")), ["question_id"])
    rows = gold.join(rank, "question_id", "left").join(seen, "question_id", "left").join(cover, "question_id", "left")
    at = lambda k, v: F.when(F.col("gold_rank") <= k, v).otherwise(0.0)
    coverage, in5 = F.coalesce("coverage", F.lit(0.0)), F.coalesce("in_top_5", F.lit(False))
    return rows.select(
        "question_id", "split", "gold_rank", F.col("gold_rank").isNotNull().alias("in_top_20"), in5.alias("in_top_5"), coverage.alias("coverage"),
        F.coalesce("context_precision", F.lit(0.0)).alias("context_precision"), (in5 & (coverage < ENOUGH)).alias("boundary_loss"), at(DEPTH, 1.0 / F.col("gold_rank")).alias("mrr"),
        *[at(k, F.lit(1.0)).alias(f"recall_{k}") for k in (5, 10, 20)], *[at(k, F.lit(1.0 / k)).alias(f"precision_{k}") for k in (5, 10, 20)],
        *[at(k, 1.0 / F.log2(F.col("gold_rank") + 1.0)).alias(f"ndcg_{k}") for k in (5, 10, 20)],
    )


def best_union(spans: Column, k: int = CONTEXT) -> Column:
    """The most that k of an array's intervals (structs a, b in order of a, then b) cover together; exact for any number.

    Chosen intervals can be taken in order with growing ends, as one inside another adds nothing. Then what a choice
    covers grows, with each interval, by what lies beyond the end of the one chosen before it: k rounds over the pairs.
    """
    width = lambda s: (s["b"] - s["a"]).cast("long")

    def longer(done: Column, x: Column, i: Column) -> Column:
        earlier = F.filter(F.slice(F.arrays_zip(spans.alias("s"), done.alias("n")), F.lit(1), i), lambda p: p["s"]["b"] < x["b"])
        return F.greatest(done[i], F.coalesce(F.array_max(F.transform(earlier, lambda p: p["n"] + x["b"] - F.greatest(x["a"], p["s"]["b"]))), F.lit(0)))

    rounds = F.when(F.lit(k) > 1, F.sequence(F.lit(2), F.lit(max(2, k)))).otherwise(F.array().cast("array<int>"))
    best = F.aggregate(rounds, F.transform(spans, width), lambda done, _: F.transform(spans, lambda x, i: longer(done, x, i)))
    return F.coalesce(F.array_max(best), F.lit(0).cast("long"))


def segmentation_ceiling(asked: DataFrame, chunks: DataFrame, k: int = CONTEXT) -> DataFrame:
    """question_id, split, ceiling, best_single, n_hits, n_gold_chunks: what any k chunks of the gold document cover of the gold
    span, the best that one covers, how many overlap it, and how many chunks the gold document has."""
    gold = asked.where("answerable").select("question_id", "split", "gold_doc", F.col("gold_start").alias("lo"), F.col("gold_end").alias("hi"))
    of = gold.join(chunks, chunks.doc_id == gold.gold_doc)
    inside = (F.col("char_end") > F.col("lo")) & (F.col("char_start") < F.col("hi"))
    span = F.struct(F.greatest("char_start", "lo").alias("a"), F.least("char_end", "hi").alias("b"))
    found = of.groupBy("question_id").agg(F.array_sort(F.collect_list(F.when(inside, span))).alias("s"), F.count(F.lit(1)).alias("n_gold_chunks"))
    rows = gold.join(found, "question_id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<a:bigint,b:bigint>>")))
    width = F.greatest(F.lit(1), F.col("hi") - F.col("lo"))
    single = F.coalesce(F.array_max(F.transform("s", lambda x: x["b"] - x["a"])), F.lit(0))
    return rows.select("question_id", "split", (best_union(F.col("s"), k) / width).alias("ceiling"), (single / width).alias("best_single"), F.size("s").cast("long").alias("n_hits"), F.coalesce("n_gold_chunks", F.lit(0)).alias("n_gold_chunks"))


def ceiling_summary(ceilings: DataFrame, by: list[str], enough: float = ENOUGH) -> DataFrame:
    """Mean and least ceiling of each group, and the share below what counts as enough."""
    return ceilings.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("ceiling").alias("mean_ceiling"), F.min("ceiling").alias("min_ceiling"), F.avg((F.col("ceiling") < enough).cast("double")).alias("below"))
