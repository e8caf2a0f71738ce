"""Queries by name: each takes the session and the folder of the tables, and uses them whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import answers as A
from .operators import attribution as P
from .operators import certainty as Q
from .operators import chunking as C
from .operators import evidence as E
from .operators import examples as N
from .operators import models as M
from .operators import retrieval as R
from .operators import segmentation as G
from .operators import statistics as B
from .plans.runs import ARMS, CENTRE, FACTOR_BASELINES, FACTOR_DIRECTIONS, METHODS, PATH, RETRIEVERS, RetrievalRun, factors, levels, records, reviewed, scored_labels
from .sources import sinks as K
from .sources import tables as S
from .sources.tables import answer_records, hashed, table
from .streaming import resume as L
from .streaming.resume import missing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LEVELS = ["click", "error", "purchase", "signup", "view"]
#: Segmentations with boundaries of their own; late chunking and its control have those of the sliding window.
SEGMENTATIONS = ("sliding_window", "fixed_window", "recursive_structure", "semantic_breakpoint")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    fix = {"double": lambda c: F.round(c, digits).alias(c), "int": lambda c: F.col(c).cast("long").alias(c)}
    return df.select(*[fix.get(kinds[c], F.col)(c) for c in df.columns])


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


# Corpus and data quality


@query
def corpus_summary(spark, d):
    rows = RetrievalRun(spark, d).asked.groupBy("split")
    return rows.agg(F.count(F.lit(1)).alias("n_questions"), F.count_if("answerable").alias("n_answerable"), F.count_if(~F.col("answerable")).alias("n_unanswerable"))


@query
def questions(spark, d):
    return RetrievalRun(spark, d).asked


@query
def corpus_from_json(spark, d):
    """Documents by way of JSON maps, written by many tasks and read back in ranges of bytes."""
    path = K.scratch(spark, "corpus")
    docs = _docs(spark, d).withColumn("title", F.array_join(F.slice(F.split("text", " "), 1, 5), " "))
    K.save_map(docs, path, "doc_id")
    rows = S.corpus(spark, path, size=1 << 20)
    return rows.select("doc_id", "title", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query
def corpus_composition(spark, d):
    """Questions of each split, and documents."""
    return S.composition(RetrievalRun(spark, d).asked, _docs(spark, d))


@query
def gold_text(spark, d):
    run = RetrievalRun(spark, d)
    rows = run.asked.join(run.docs, F.col("gold_doc") == F.col("doc_id"), "left")
    return rows.select("question_id", F.coalesce(F.expr("substring(text, int(gold_start) + 1, int(gold_end - gold_start))"), F.lit("")).alias("gold_text"))


@query
def dq_gold_spans(spark, d):
    run = RetrievalRun(spark, d)
    rows = run.asked.where("answerable").join(run.docs, F.col("gold_doc") == F.col("doc_id"), "left")
    reason = F.when(F.col("text").isNull(), "no document").when(F.col("gold_end") <= F.col("gold_start"), "empty span").when(F.col("gold_end") > F.length("text"), "beyond the text")
    return rows.select("question_id", reason.alias("reason")).where("reason is not null")


@query
def candidates(spark, d):
    return RetrievalRun(spark, d).candidates


@query
def stratified_sample(spark, d):
    """Questions for generation: of each split and answerability, its share of 20, at least one, by a hash."""
    from pyspark.sql import Window

    rows = RetrievalRun(spark, d).asked
    w = Window.partitionBy("split", "answerable")
    rows = rows.withColumn("size", F.count(F.lit(1)).over(w)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    rows = rows.withColumn("nth", F.row_number().over(w.orderBy(hashed(F.col("question_id"), F.lit(42)), "question_id")))
    return rows.where(F.col("nth") <= F.greatest(F.lit(1), F.bround(20 * F.col("size") / F.col("total")))).select("question_id", "split", "answerable")


# Segmentation


@query
def word_spans(spark, d):
    return _rounded(C.word_spans(_docs(spark, d)))


@query
def fixed_chunks(spark, d):
    return _rounded(C.word_windows(_docs(spark, d), 64, 0.0))


@query
def sliding_chunks(spark, d):
    return _rounded(C.word_windows(_docs(spark, d), 64, 0.10))


@query
def sliding_chunks_512(spark, d):
    return _rounded(C.word_windows(_docs(spark, d)))


@query
def chunk_texts(spark, d):
    run = RetrievalRun(spark, d)
    return C.chunk_texts(run.chunks, run.visible).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("text").alias("text_md5"), "chunk_id", "label")


@query
def chunk_statistics(spark, d):
    docs = _docs(spark, d)
    return _rounded(C.chunk_statistics(C.word_windows(docs, 64, 0.10), docs))


@query
def segmentation_agreement(spark, d):
    docs, out = _docs(spark, d), None
    for name in SEGMENTATIONS:
        rows = METHODS[name](docs, 64, 0.10).select(F.lit(name).alias("method"), "doc_id", "char_start", "char_end")
        out = rows if out is None else out.unionByName(rows)
    return _rounded(C.agreement(out, "sliding_window"))


@query
def recursive_chunks(spark, d):
    return METHODS["recursive_structure"](_docs(spark, d), 64, 0.10)


@query
def recursive_chunks_plain(spark, d):
    return G.structural(_docs(spark, d), 64, 0.10)


@query
def semantic_chunks(spark, d):
    return G.semantic(_docs(spark, d), None, 64, 0.10)


def _firsts(spark: SparkSession, d: str) -> DataFrame:
    run = RetrievalRun(spark, d)
    rows = run.ranking("bm25").where("rnk = 1").join(run.texts, R.ROW).join(run.asked.select("question_id", "query"), "question_id")
    return rows.select("question_id", "text", "query")


@query
def query_excerpt(spark, d):
    return C.excerpts(_firsts(spark, d), 20).select("question_id", "excerpt")


@query
def token_excerpt(spark, d):
    return C.token_excerpts(_firsts(spark, d), 24).select("question_id", "excerpt")


@query
def clipped_queries(spark, d):
    return RetrievalRun(spark, d).asked.select("question_id", C.clipped(F.col("query"), 8).alias("clipped"))


@query
def late_chunk_vectors(spark, d):
    run = RetrievalRun(spark, d)
    return _rounded(M.late_vectors(run.chunks, run.visible))


# Text functions


@query
def bm25_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(X.tokens(F.col("text")), " ")).alias("tokens_md5"))


@query
def content_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.size(X.content_tokens(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(X.content_tokens(F.col("text")), " ")).alias("tokens_md5"))


@query
def sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query
def syllables(spark, d):
    words = _docs(spark, d).select(F.explode(X.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.select("word", "n", X.syllables(F.col("word")).cast("long").alias("syllables"))


@query
def readability(spark, d):
    return _rounded(_docs(spark, d).select("doc_id", X.readability(F.col("text")).alias("r")).select("doc_id", "r.*"))


@query
def abstention(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.is_abstention(F.col("text")).alias("abstained"))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns with citations and an evidence block written into them, as the tables have none."""
    rows = table(spark, d, "conversations").where("role = 'assistant'")
    n = (F.col("conv_id") + F.col("turn")) % 5
    cite = F.when(n == 0, "").when(n == 1, F.concat(F.lit(" [swg"), F.col("conv_id"), F.lit("::chunk_1]"))).when(n == 2, F.concat(F.lit(" [swg"), F.col("conv_id"), F.lit("::chunk_1] and [nas2::chunk_3]")))
    cite = cite.when(n == 3, " [a1::chunk_1] [b2::chunk_2] [c3::chunk_3]").otherwise(F.concat(F.lit("\nEvidence: [nas2::chunk_3] [swg"), F.col("conv_id")))
    return rows.select("conv_id", "turn", F.concat("text", cite).alias("answer"))


@query
def answer_body(spark, d):
    return _cited(spark, d).select("conv_id", "turn", X.answer_body(F.col("answer")).alias("body"))


@query
def citations(spark, d):
    rows = _cited(spark, d)
    return rows.select("conv_id", "turn", F.array_join(X.cited_segments(F.col("answer")), "|").alias("cited"), X.citation_count(F.col("answer")).cast("long").alias("n_cited"))


# Retrieval


@query
def bm25_scores(spark, d):
    return _rounded(RetrievalRun(spark, d).bm25)


@query
def bm25_topk(spark, d):
    return _rounded(RetrievalRun(spark, d).ranking("bm25").where("rnk <= 5"))


@query
def dense_scores(spark, d):
    return _rounded(RetrievalRun(spark, d).dense, 9)


@query
def dense_topk(spark, d):
    return _rounded(RetrievalRun(spark, d).ranking("dense").where("rnk <= 5"), 9)


@query
def zscored_scores(spark, d):
    return _rounded(R.zscored(RetrievalRun(spark, d).bm25), 5)


@query
def rrf_fusion(spark, d):
    return _rounded(RetrievalRun(spark, d).ranking("hybrid_rrf"))


@query
def weighted_fusion(spark, d):
    return _rounded(RetrievalRun(spark, d).ranking("hybrid_weighted").where("rnk <= 20"), 5)


@query
def rerank_lexical(spark, d):
    return _rounded(RetrievalRun(spark, d).ranking("dense_reranked"))


@query
def complementarity(spark, d):
    run = RetrievalRun(spark, d)
    return _rounded(R.complementarity(run.trace("bm25"), run.trace("dense"), "recall_5"))


@query
def promotion(spark, d):
    run = RetrievalRun(spark, d)
    return R.promotion(run.trace("dense"), run.trace("dense_reranked"))


@query
def nearest_vectors(spark, d):
    rows = table(spark, d, "embeddings")
    return _rounded(R.nearest(rows, rows.where("vec_id % 10 = 0")))


@query
def reproduction(spark, d):
    published = {"bm25": {"recall_20": 0.7000, "coverage": 0.5618, "mrr": 0.4736, "ndcg_5": 0.4878}, "dense": {"recall_20": 0.8067, "coverage": 0.6307, "mrr": 0.5619, "ndcg_5": 0.5736}}
    return _rounded(R.reproduction(RetrievalRun(spark, d).configurations(("bm25", "dense")), published))


@query
def sensitivity_arms(spark, d):
    run = RetrievalRun(spark, d)
    arms = {"depth 50": run.trace("dense_reranked", 50), "on hybrid": run.trace("hybrid_rrf_reranked")}
    rows = None
    for name, trace in arms.items():
        got = trace.select(F.lit(name).alias("arm"), "question_id", "in_top_5", "coverage", "mrr")
        rows = got if rows is None else rows.unionByName(got)
    return _rounded(rows)


@query
def rerank_signals(spark, d):
    return _rounded(R.rerank_signals(RetrievalRun(spark, d).ranking("dense_reranked")))


# Evidence


@query
def evidence_metrics(spark, d):
    run = RetrievalRun(spark, d)
    rows = run.asked.select("question_id", "answerable").join(run.trace("bm25"), "question_id", "left")
    return _rounded(rows)


@query
def evidence_metrics_dense(spark, d):
    return _rounded(RetrievalRun(spark, d).trace("dense"))


@query
def arm_means(spark, d):
    metrics = ("coverage", "context_precision", "mrr", "recall_5", "recall_20", "ndcg_5")
    return _rounded(RetrievalRun(spark, d).configurations().groupBy("configuration", "split").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics]))


@query
def arm_summary(spark, d):
    rows = RetrievalRun(spark, d).configurations()
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in ("coverage", "mrr", "ndcg_5")]))
    long = rows.select("configuration", "question_id", metrics.alias("s")).select("configuration", "question_id", "s.*")
    return _rounded(B.bootstrap_ci(long, ["configuration", "metric"], "question_id", "x"))


@query
def segmentation_ceiling(spark, d):
    return _rounded(RetrievalRun(spark, d).by_method(tuple(METHODS), "ceiling"))


@query
def ceiling_summary(spark, d):
    return _rounded(E.ceiling_summary(RetrievalRun(spark, d).by_method(tuple(METHODS), "ceiling"), ["method", "split"]))


# Answers


@query
def answer_scores(spark, d):
    return _rounded(A.scored_answers(records(spark, d)).drop("question", "answer", "context", "gold"))


@query
def rouge_l(spark, d):
    return _rounded(A.rouge_l(records(spark, d), "answer", "gold").select("conv_id", "turn", "rouge_l"))


@query
def generation_scores(spark, d):
    return _rounded(RetrievalRun(spark, d).generated().drop("question", "answer", "context", "gold", "split", "answerable"))


@query
def abstention_table(spark, d):
    return _rounded(A.abstention_table(RetrievalRun(spark, d).generated(), "configuration"))


@query
def first_look(spark, d):
    return _rounded(A.first_look(RetrievalRun(spark, d).generated(), "configuration"))


@query
def readability_summary(spark, d):
    return _rounded(A.readability_summary(RetrievalRun(spark, d).generated(), "configuration"))


@query
def answer_relevancy(spark, d):
    return _rounded(M.relevancy(RetrievalRun(spark, d).generated().withColumn("answer", X.answer_body(F.col("answer"))), ["configuration", "question_id"]))


@query
def prompt_lengths(spark, d):
    run = RetrievalRun(spark, d)
    top = run.ranking("bm25").where("rnk <= 5").join(run.labelled.select(*R.ROW, "label", "text"), R.ROW)
    rows = A.prompts(top)
    at = lambda p: F.percentile("n_words", F.lit(p))
    return _rounded(rows.agg(F.count(F.lit(1)).alias("n"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max("n_words").alias("longest")))


@query
def prompt_segments(spark, d):
    run = RetrievalRun(spark, d)
    top = run.ranking("bm25").where("rnk <= 5").join(run.labelled.select(*R.ROW, "label", "text"), R.ROW)
    return A.prompts(top).select("question_id", X.prompt_segments(F.col("prompt")).alias("segments"))


@query
def generated_answers(spark, d):
    run = RetrievalRun(spark, d)
    top = run.ranking("bm25").where("rnk <= 5").join(run.labelled.select(*R.ROW, "label", "text"), R.ROW)
    rows = A.prompts(top).join(run.asked.select("question_id", "query"), "question_id").select("question_id", "prompt", "query")
    return A.generate(rows).select("question_id", "answer")


@query
def batch_plan(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.length("text").alias("n"))
    return A.planned_batches(rows, "id", "n", groups=4)


@query
def resume_antijoin(spark, d):
    rows = answer_records(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "split")
    return missing(rows, rows.where(hashed(F.col("question_id")) % 2 == 0))


@query
def resumed_generation(spark, d):
    """Answers to the questions of conversations, which arrive in files; a third of the questions arrive again in a later one."""
    schema = "question_id long, split string, query string, prompt string"
    rows = answer_records(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "split", F.col("question").alias("query"), F.col("answer").alias("prompt"))
    part = F.explode(F.when(F.col("question_id") % 3 == 0, F.array(F.col("question_id") % 2, F.lit(2))).otherwise(F.array(F.col("question_id") % 2))).alias("part")
    asked, said = K.scratch(spark, "questions"), K.scratch(spark, "answers")
    rows.select("*", part).repartition("part").write.partitionBy("part").json(asked)
    source = L.question_stream(spark, f"{asked}/part=*", schema)
    answer = lambda batch: A.generate(batch).select("question_id", "split", "answer")
    L.stream_records(source, answer, said, f"{said}/_stream", "question_id long, split string, answer string").awaitTermination()
    return L.committed(spark, said, "question_id long, split string, answer string")


# Attribution


@query
def configuration_table(spark, d):
    return _rounded(RetrievalRun(spark, d).configurations().select("configuration", "question_id", "split", "in_top_20", "in_top_5", "coverage", "ceiling"))


@query
def copy_defects(spark, d):
    """Questions on which two arms that are taken for copies of one configuration differ."""
    run = RetrievalRun(spark, d)
    return P.identity_defects({"A": run.trace("dense"), "B": run.trace("dense"), "C": run.trace("dense_reranked")})


@query
def stage_attribution(spark, d):
    return P.attributed(RetrievalRun(spark, d).configurations()).select("configuration", "question_id", "stage")


@query
def stage_partition(spark, d):
    return _rounded(P.partition(RetrievalRun(spark, d).configurations()))


@query
def stage_partition_by_split(spark, d):
    return _rounded(P.partition(RetrievalRun(spark, d).configurations(), ("configuration", "split")))


@query
def stage_partition_ci(spark, d):
    return _rounded(P.partition_ci(RetrievalRun(spark, d).configurations()))


@query
def stage_transitions(spark, d):
    return P.transitions(RetrievalRun(spark, d).configurations(("bm25", "dense")), "bm25", "dense")


@query
def threshold_sweep(spark, d):
    return _rounded(P.threshold_sweep(RetrievalRun(spark, d).configurations()))


@query
def stage_decomposition(spark, d):
    return _rounded(P.decomposition(RetrievalRun(spark, d).configurations(), CENTRE))


@query
def sophistication_path(spark, d):
    return _rounded(P.sophistication_path(P.partition(RetrievalRun(spark, d).configurations()), PATH))


@query
def dq_trace_defects(spark, d):
    return P.trace_defects(RetrievalRun(spark, d).configurations())


@query
def dq_coverage_above_ceiling(spark, d):
    return P.above_ceiling(RetrievalRun(spark, d).configurations()).select("configuration", "question_id")


@query
def generation_outcomes(spark, d):
    return RetrievalRun(spark, d).outcomes()


@query
def generation_summary(spark, d):
    return _rounded(P.outcome_summary(RetrievalRun(spark, d).outcomes(), CENTRE))


@query
def outcome_contrasts(spark, d):
    return _rounded(P.outcome_contrasts(RetrievalRun(spark, d).outcomes(), CENTRE))


@query
def outcomes_by_stage(spark, d):
    return _rounded(P.outcomes_by_stage(RetrievalRun(spark, d).outcomes(), ("configuration", "stage")))


@query
def outcome_totals(spark, d):
    return _rounded(P.outcome_totals(RetrievalRun(spark, d).outcomes()))


@query
def prompt_comparison(spark, d):
    run = RetrievalRun(spark, d)
    return _rounded(P.prompt_comparison(run.outcomes(1), run.outcomes(2), CENTRE))


@query
def reviewed_outcomes(spark, d):
    run = RetrievalRun(spark, d)
    rows = reviewed(run, 1).withColumn("run", F.lit(1)).unionByName(reviewed(run, 2).withColumn("run", F.lit(2)))
    return _rounded(P.reviewed_outcomes(rows, ["run"]))


@query
def reviewed_ablation(spark, d):
    run = RetrievalRun(spark, d)
    return P.ablation(reviewed(run, 1), reviewed(run, 2))


@query
def reviewed_check(spark, d):
    return P.reviewed_check(reviewed(RetrievalRun(spark, d)))


@query
def calibrate_threshold(spark, d):
    return _rounded(P.calibrated_threshold(scored_labels(spark, d).withColumn("pos", F.col("y") == 1), "score", "pos"))


# Statistics


@query
def to_wide(spark, d):
    return _rounded(B.to_wide(levels(spark, d), LEVELS))


@query
def repeated_measures(spark, d):
    return _rounded(B.repeated_measures(levels(spark, d)))


@query
def bootstrap_ci(spark, d):
    return _rounded(B.bootstrap_ci(levels(spark, d), ["level"], "id", "x"))


@query
def pairwise_baseline(spark, d):
    return _rounded(B.against_baseline(levels(spark, d), "view"))


@query
def matched_contrast(spark, d):
    return _rounded(B.matched_contrast(levels(spark, d), "view"))


@query
def holm(spark, d):
    rows = levels(spark, d).groupBy("level").agg((hashed(F.col("level")) % 1000 / 10000.0).alias("p")).withColumn("family", F.lit(1))
    return _rounded(B.holm(rows, ["family"], "p", "level"))


@query
def average_ranks(spark, d):
    rows = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(B.average_rank(rows, ["o_orderstatus"], "n"))


def _effects(spark: SparkSession, d: str) -> DataFrame:
    return B.main_effects(factors(spark, d), FACTOR_BASELINES, FACTOR_DIRECTIONS)


@query
def main_effects(spark, d):
    return _rounded(_effects(spark, d), 5)


@query
def factor_ranking(spark, d):
    return _rounded(B.ranked_factors(_effects(spark, d)), 5)


@query
def metric_winners(spark, d):
    return _rounded(B.metric_winners(_effects(spark, d)), 5)


@query
def signed_contrasts(spark, d):
    return _rounded(B.signed_contrasts(_effects(spark, d), FACTOR_DIRECTIONS), 5)


@query
def leading_factor(spark, d):
    rows = _effects(spark, d)
    return _rounded(B.leading_answer(B.ranked_factors(rows), B.metric_winners(rows)), 5)


@query
def level_contrasts(spark, d):
    """Given pairs of levels, as a method is compared with its matched control."""
    long = factors(spark, d).where("factor = 'type'").select("metric", "level", "id", "x")
    return _rounded(B.pair_contrasts(long, [("click", "view"), ("purchase", "signup")], ["metric"]), 5)


@query
def described_contrasts(spark, d):
    rows = B.against_baseline(levels(spark, d), "view")
    return B.described(rows, 3).select("level", "resolved", "text")


@query
def normalised_heatmap(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    w = Window.partitionBy(F.lit(0))
    unit = lambda c: F.when(F.max(c).over(w) > F.min(c).over(w), (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w))).otherwise(0.5)
    return _rounded(rows.select("l_returnflag", "l_linestatus", unit("quantity").alias("quantity"), unit("discount").alias("discount")))


@query
def cost_table(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("mean_cost"), F.percentile("l_extendedprice", F.lit(0.5)).alias("median_cost"), F.count(F.lit(1)).alias("n"))
    return _rounded(rows, 4)


# Certainty


@query
def certainty_signals(spark, d):
    return _rounded(RetrievalRun(spark, d).signals, 5)


@query
def signal_audit(spark, d):
    return _rounded(Q.univariate(RetrievalRun(spark, d).signals), 5)


@query
def auroc_interval(spark, d):
    return _rounded(Q.auroc_ci(scored_labels(spark, d), ["split"], "doc_id", "score", "y"))


@query
def auroc(spark, d):
    return _rounded(Q.auroc(scored_labels(spark, d), ["split"], "score", "y"))


@query
def calibration_error(spark, d):
    return _rounded(Q.calibration_error(scored_labels(spark, d), "score", "y"))


@query
def reliability(spark, d):
    return _rounded(Q.binned(scored_labels(spark, d), "score", "y"))


@query
def certainty_bands(spark, d):
    return _rounded(Q.band_table(scored_labels(spark, d), "score", "y"))


@query
def selective_answering(spark, d):
    return _rounded(Q.selective(scored_labels(spark, d), "score", "y"))


@query
def base_rate_shift(spark, d):
    m = scored_labels(spark, d).groupBy("split").agg(F.avg("y").alias("rate"))
    a, b = m.where("split = 'train'").select(F.col("rate").alias("train_rate")), m.where("split = 'dev'").select(F.col("rate").alias("dev_rate"))
    odds = lambda c: F.ln(F.col(c) / (1 - F.col(c)))
    return _rounded(a.join(b, F.lit(True)).select("train_rate", "dev_rate", (odds("dev_rate") - odds("train_rate")).alias("shift")))


@query
def logistic_score(spark, d):
    rows = scored_labels(spark, d).join(table(spark, d, "documents").select("doc_id", F.ln("n_chars").alias("log_chars")), "doc_id")
    model = Q.Logistic(("score", "log_chars")).fit(rows.where("split = 'train'"), "y")
    return _rounded(rows.where("split = 'dev'").select("doc_id", "y", model.score().alias("certainty")))


def _two_signals(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_labels(spark, d).join(table(spark, d, "documents").select("doc_id", F.ln("n_chars").alias("log_chars")), "doc_id")
    return rows.withColumnRenamed("score", "s0")


@query
def cross_fitted_scores(spark, d):
    return _rounded(Q.cross_fitted(_two_signals(spark, d), ("s0", "log_chars"), "y").select("doc_id", "split", "y", "score", "score_shifted"))


@query
def evaluated_scores(spark, d):
    rows = _two_signals(spark, d)
    dev = Q.cross_fitted(rows, ("s0", "log_chars"), "y").where("split = 'dev'").withColumn("answerable", F.lit(True))
    rate = rows.where("split = 'train'").agg(F.avg("y").alias("m")).first()["m"]
    return _rounded(Q.evaluate(dev, "y", rate, "doc_id", "s0", "answerable"))


def _banded(spark: SparkSession, d: str) -> DataFrame:
    rows = _cited(spark, d).withColumn("top_doc", F.concat(F.lit("swg"), F.col("conv_id")))
    label = F.element_at(F.array(*map(F.lit, ("correct", "partial", "incorrect"))), (hashed(F.col("conv_id"), F.col("turn")) % 3 + 1).cast("int"))
    return rows.select("conv_id", "turn", Q.citation_band(F.col("answer"), F.col("top_doc")).alias("band"), label.alias("label"))


@query
def citation_bands(spark, d):
    return _banded(spark, d)


@query
def citation_band_table(spark, d):
    return _rounded(Q.citation_table(_banded(spark, d), "label"))


def _tested(spark: SparkSession, d: str) -> tuple[RetrievalRun, DataFrame]:
    run = RetrievalRun(spark, d)
    return run, Q.tested_answers(run.generated())


def _retrieval_scores(run: RetrievalRun) -> DataFrame:
    """The first similarity stands in for a fitted score, so that SQL has it too."""
    return run.signals.select("question_id", F.coalesce("dense_top1", F.lit(0.0)).alias("score_shifted"))


@query
def citation_answers(spark, d):
    return _rounded(_tested(spark, d)[1])


@query
def citation_correctness(spark, d):
    return _rounded(Q.band_correctness(_tested(spark, d)[1], ["configuration"]))


@query
def citation_correctness_pooled(spark, d):
    return _rounded(Q.band_correctness(_tested(spark, d)[1], []))


@query
def citation_high_minus_low(spark, d):
    return _rounded(Q.high_minus_low(_tested(spark, d)[1], ["configuration"]))


@query
def citation_high_minus_low_pooled(spark, d):
    return _rounded(Q.high_minus_low(_tested(spark, d)[1], []))


@query
def citation_auroc(spark, d):
    return _rounded(Q.band_auroc(_tested(spark, d)[1], ["configuration"]))


@query
def citation_low_band(spark, d):
    return _rounded(Q.low_band_shares(_tested(spark, d)[1]))


@query
def joint_bands(spark, d):
    run, rows = _tested(spark, d)
    return _rounded(Q.joint_bands(rows.where(F.col("configuration") == CENTRE), _retrieval_scores(run)))


@query
def joint_rule(spark, d):
    run, rows = _tested(spark, d)
    return _rounded(Q.joint_rule(rows.where(F.col("configuration") == CENTRE), _retrieval_scores(run)))


# Worked examples


@query
def chunking_example(spark, d):
    return _rounded(N.chunking_example(RetrievalRun(spark, d).by_method(tuple(METHODS))))


@query
def retrieval_example(spark, d):
    return _rounded(N.retrieval_example(RetrievalRun(spark, d).configurations(RETRIEVERS)))


@query
def reranking_example(spark, d):
    run = RetrievalRun(spark, d)
    return _rounded(N.reranking_example(run.trace(CENTRE), run.trace("dense_reranked")))


@query
def effects_example(spark, d):
    run = RetrievalRun(spark, d)
    return _rounded(N.effects_example(run.trace(CENTRE), run.trace("bm25")))


@query
def generation_example(spark, d):
    return _rounded(N.generation_example(RetrievalRun(spark, d).generated(), CENTRE))


@query
def attribution_example(spark, d):
    return _rounded(N.attribution_example(RetrievalRun(spark, d).configurations(), CENTRE))


@query
def prompt_example(spark, d):
    return N.prompt_example(RetrievalRun(spark, d).outcomes(), CENTRE)


@query
def certainty_example(spark, d):
    rows = RetrievalRun(spark, d).signals
    return _rounded(N.certainty_example(rows.withColumn("score", F.coalesce("dense_top1", F.lit(0.0)))), 5)


@query
def citation_example(spark, d):
    return _rounded(N.citation_example(_tested(spark, d)[1]))


@query
def segmentation_scenario(spark, d):
    run = RetrievalRun(spark, d)
    return _rounded(N.segmentation_scenario(run.by_method(tuple(METHODS)), run.configurations(RETRIEVERS)))


@query
def attribution_scenario(spark, d):
    return _rounded(N.attribution_scenario(RetrievalRun(spark, d).configurations(), CENTRE))


@query
def certainty_scenario(spark, d):
    return _rounded(N.certainty_scenario(RetrievalRun(spark, d).signals.withColumn("score", F.col("dense_top1"))), 5)
