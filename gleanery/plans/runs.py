"""Runs: the evaluation pipelines over a folder of tables, as lazy DataFrames that queries take what they need from."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import answers as A
from ..operators import attribution as P
from ..operators import certainty as Q
from ..operators import chunking as C
from ..operators import evidence as E
from ..operators import models as M
from ..operators import retrieval as R
from ..operators import segmentation as G
from ..sources import tables as S
from ..sources.sinks import materialised

SIZE, OVERLAP = 64, 0.10
CENTRE_METHOD, CENTRE = "sliding_window", "dense"
RETRIEVERS = ("bm25", "dense", "hybrid_rrf", "hybrid_weighted")
#: Methods that keep the centre's boundaries and encode with the encoder of long contexts: chunks alone, or whole documents.
CONTROL, LATE = "sliding_window_longctx", "late_chunking"
#: Configurations: each differs from the centre in its segmentation, its encoder, its retriever or its reranking.
ARMS = (*RETRIEVERS, "dense_reranked", "fixed_window", "recursive_structure", "semantic_breakpoint", CONTROL, LATE)
PATH = ("bm25", CENTRE, "hybrid_rrf", "dense_reranked")


#: Segmentations by name: documents, words of a chunk and overlap to chunks. Lines stand in for sections, as the tables have none.
METHODS = {
    "fixed_window": lambda docs, size, overlap: C.word_windows(docs, size, 0.0),
    "sliding_window": C.word_windows,
    CONTROL: C.word_windows,
    LATE: C.word_windows,
    "recursive_structure": lambda docs, size, overlap: G.structural(docs.withColumn("sections", G.line_sections(F.col("text"))), size, overlap, "sections"),
    "semantic_breakpoint": lambda docs, size, overlap: G.semantic(docs, None, size, overlap),
}


#: Tables of a run that are written at a time.
AT_ONCE = 4


def together(spark: SparkSession, jobs: Iterable[Callable[[], object]]) -> None:
    """Run jobs that do not need each other side by side: each is a row of small Spark jobs, whose planning and last tasks would
    otherwise add up."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]:
            done.result()


class RetrievalRun:
    """Questions, candidate chunks, rankings and traces of one segmentation.

    What several arms share - questions, candidates, chunks and the two base scores - is computed once and kept in the
    shared checkpoint folder; rankings and traces stay lazy.
    """

    def __init__(self, spark: SparkSession, folder: str, size: int = SIZE, overlap: float = OVERLAP, method: str = CENTRE_METHOD):
        self.spark, self.folder, self.size, self.overlap, self.method = spark, folder, size, overlap, method
        self._traces: dict[str, DataFrame] = {}
        self._kept: dict[tuple, DataFrame] = {}
        self._others: dict[str, RetrievalRun] = {method: self}
        self._twin: RetrievalRun | None = None

    @cached_property
    def docs(self) -> DataFrame:
        return S.table(self.spark, self.folder, "documents").select("doc_id", "text")

    @cached_property
    def asked(self) -> DataFrame:
        return materialised(S.questions(self.spark, self.folder))

    @cached_property
    def candidates(self) -> DataFrame:
        return materialised(S.candidates(self.asked, self.docs))

    def other(self, method: str) -> RetrievalRun:
        """The same questions and candidates under another segmentation."""
        if method not in self._others:
            run = RetrievalRun(self.spark, self.folder, self.size, self.overlap, method)
            run.asked, run.candidates, run.visible = self.asked, self.candidates, self.visible
            if METHODS[method] is METHODS[self.method]:  # the same boundaries
                run._twin = self
            self._others[method] = run
        return self._others[method]

    @cached_property
    def visible(self) -> DataFrame:
        """Documents that some question can see, gold documents among them; written once for all segmentations, as no later step
        needs the rest of the corpus."""
        return materialised(self.docs.join(self.candidates.select("doc_id").distinct(), "doc_id", "left_semi"))

    def segmented(self, docs: DataFrame) -> DataFrame:
        return METHODS[self.method](docs, self.size, self.overlap)

    @cached_property
    def chunks(self) -> DataFrame:
        return self._twin.chunks if self._twin else materialised(self.segmented(self.visible))

    @cached_property
    def labelled(self) -> DataFrame:
        """Chunks with their text and label; written once, as every scorer and every prompt reads it."""
        if self._twin:
            return self._twin.labelled
        # Dealt out, as one file would leave the scorers, whose work is in the task that reads, to one task.
        return materialised(C.chunk_texts(self.chunks, self.visible).repartition(*R.ROW))

    @cached_property
    def texts(self) -> DataFrame:
        return self.labelled.select("doc_id", "chunk_no", "text")

    @cached_property
    def pairs(self) -> DataFrame:
        return R.candidate_chunks(self.candidates, self.chunks)

    @cached_property
    def bm25(self) -> DataFrame:
        return materialised(R.bm25(self.asked, self.pairs, self.texts))

    @cached_property
    def dense(self) -> DataFrame:
        vectors = M.late_vectors(self.chunks, self.visible) if self.method == LATE else None
        return materialised(R.dense(self.asked, self.pairs, self.texts, vectors, M.LONG_DIMENSIONS if self.method in (CONTROL, LATE) else R.DIMENSIONS))

    def ranking(self, arm: str, depth: int = R.DEPTH) -> DataFrame:
        if arm == "bm25":
            return R.ranked(self.bm25)
        if arm == "dense":
            return R.ranked(self.dense)
        if arm == "hybrid_rrf":
            return R.rrf(self.ranking("bm25"), self.ranking("dense"))
        if arm == "hybrid_weighted":
            return R.weighted(self.dense, self.bm25)
        if arm.endswith("_reranked"):
            return R.rerank(self.asked, self.texts, self.ranking(arm.removesuffix("_reranked")), depth)
        if arm in METHODS:
            return self.other(arm).ranking(CENTRE)
        raise ValueError(f"no such arm: {arm}")

    def trace(self, arm: str, depth: int = R.DEPTH) -> DataFrame:
        """One row for each answerable question, kept like the base scores: it is what every later analysis reads."""
        if arm in METHODS and arm != self.method:
            return self.other(arm).trace(CENTRE)
        name = f"{arm}/{depth}"
        if name not in self._traces:
            self._traces[name] = materialised(E.evidence_metrics(self.asked, self.ranking(arm, depth), self.chunks))
        return self._traces[name]

    @cached_property
    def ceiling(self) -> DataFrame:
        if self._twin:
            return self._twin.ceiling
        gold = self.asked.where("answerable").select(F.col("gold_doc").alias("doc_id")).distinct()
        return materialised(E.segmentation_ceiling(self.asked, self.chunks.join(gold, "doc_id", "left_semi")))  # gold documents are candidates

    def prepared(self, arms: tuple[str, ...], traces: bool = True) -> None:
        """Write what the arms read: the tables that all share first, then those of each segmentation and, where asked for, the
        traces side by side."""
        runs = [self.other(m) for m in dict.fromkeys(a if a in METHODS else self.method for a in arms)]
        if self in runs or any(r._twin for r in runs):
            self.labelled  # noqa: B018

        def base(run: RetrievalRun) -> None:
            run.labelled, run.dense  # noqa: B018
            if traces and not run._twin:
                run.ceiling  # noqa: B018

        jobs = [partial(base, r) for r in runs]
        if any(a.startswith(("bm25", "hybrid")) for a in arms):
            jobs.append(lambda: self.bm25)
        together(self.spark, jobs)
        if traces:
            together(self.spark, [partial(self.trace, a) for a in arms])

    def by_method(self, methods: tuple[str, ...], what: str = "trace") -> DataFrame:
        """Traces of the centre's retriever (or ceilings) of several segmentations, with ``method``."""
        out = None
        for method in methods:
            run = self.other(method)
            rows = (run.trace(CENTRE) if what == "trace" else run.ceiling).withColumn("method", F.lit(method))
            out = rows if out is None else out.unionByName(rows)
        return out

    def configurations(self, arms: tuple[str, ...] = ARMS) -> DataFrame:
        """Traces of several arms with the ceiling of their segmentation, one row for each configuration and question."""
        self.prepared(arms)
        out = None
        for arm in arms:
            method = arm if arm in METHODS else self.method
            rows = self.trace(arm).withColumns({"configuration": F.lit(arm), "method": F.lit(method)})
            out = rows if out is None else out.unionByName(rows)
        methods = tuple(dict.fromkeys(a if a in METHODS else self.method for a in arms))
        return out.join(self.by_method(methods, "ceiling").select("method", "question_id", "ceiling"), ["method", "question_id"], "left").drop("method")

    @cached_property
    def signals(self) -> DataFrame:
        return Q.signals(self.asked, self.dense, self.bm25, self.trace("dense"))

    def answers(self, arm: str, version: int = 2) -> DataFrame:
        """Answers of the stand-in generator at one arm: configuration, question_id, split, answerable, question, answer, context,
        segment_ids, gold.

        The answer is the beginning of the first segment (the second version's is twice as long), and an evidence line
        that cites none to three of the segments, or the second only, as a hash says. It declines where another hash
        says so, the first version three times as often. The gold text is the gold span.
        """
        run = self.other(arm) if arm in METHODS else self
        top = self.ranking(arm).where(F.col("rnk") <= R.CONTEXT).join(run.labelled.select("doc_id", "chunk_no", "label", "text"), R.ROW)
        found = A.segments_of(top.select("question_id", "rnk", "label", "text")).join(top.where("rnk = 1").select("question_id", F.col("text").alias("first")), "question_id")
        gold = self.asked.where("answerable").join(self.visible, F.col("gold_doc") == F.col("doc_id")).select("question_id", F.expr("substring(text, int(gold_start) + 1, int(gold_end - gold_start))").alias("gold"))
        rows = self.asked.select("question_id", "split", "answerable", F.col("query").alias("question")).join(found, "question_id").join(gold, "question_id", "left")
        declines = S.hashed(F.col("question_id"), F.lit(arm), F.lit("declines")) % 10 < (3 if version == 1 else 1)
        cites = (S.hashed(F.col("question_id"), F.lit(arm), F.lit("cites")) % 5).cast("int")
        ids = F.split("segment_ids", r"\|")
        cited = F.when(cites == 4, F.slice(ids, 2, 1)).otherwise(F.slice(ids, F.lit(1), F.greatest(F.lit(0), cites)))
        said = F.concat(F.array_join(F.slice(words(F.col("first")), 1, 20 * version), " "), F.lit("\nEvidence: "), F.array_join(F.transform(cited, lambda c: F.concat(F.lit("["), c, F.lit("]"))), " "))
        return rows.select(F.lit(arm).alias("configuration"), "question_id", "split", "answerable", "question", F.when(declines, A.ABSTAIN).otherwise(said).alias("answer"), "context", "segment_ids", "gold")

    def generated(self, version: int = 2, arms: tuple[str, ...] = ARMS) -> DataFrame:
        """Scored answers at several arms, kept."""
        name = ("generated", version, arms)
        if name not in self._kept:
            self.prepared(arms, traces=False)
            out = None
            for arm in arms:
                rows = self.answers(arm, version)
                out = rows if out is None else out.unionByName(rows)
            self._kept[name] = materialised(A.scored_answers(out))
        return self._kept[name]

    def outcomes(self, version: int = 2, arms: tuple[str, ...] = ARMS) -> DataFrame:
        name = ("outcomes", version, arms)
        if name not in self._kept:
            stages = P.attributed(self.configurations(arms)).select("configuration", "question_id", "stage")
            self._kept[name] = materialised(P.outcomes(self.generated(version, arms).where("answerable"), stages))
        return self._kept[name]


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Answer records of conversations with a gold text: what the last assistant turn says; every third conversation has none."""
    rows = S.answer_records(spark, folder)
    last = S.table(spark, folder, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"))
    gold = F.when(F.col("conv_id") % 3 != 0, F.col("last"))
    return rows.join(last, "conv_id").select("conv_id", "turn", "split", "question", "answer", "context", gold.alias("gold"))


def reviewed(run: RetrievalRun, version: int = 2) -> DataFrame:
    """Answers at the centre to answerable questions with trace, ceiling and a label, which a hash stands in for."""
    rows = run.generated(version, (CENTRE,)).where("answerable").select("question_id", "answer", "segment_ids", "token_f1")
    traces = run.configurations((CENTRE,)).select("question_id", "in_top_20", "in_top_5", "coverage", "ceiling")
    label = F.element_at(F.array(*map(F.lit, ("correct", "partial", "incorrect"))), (S.hashed(F.col("question_id"), F.lit(version)) % 3 + 1).cast("int"))
    return rows.join(traces, "question_id").withColumn("label", label)


def levels(spark: SparkSession, folder: str) -> DataFrame:
    """(id, level, x): mean value of each user's events of each type."""
    rows = S.table(spark, folder, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("level"))
    return rows.agg(F.round(F.avg("value"), 9).alias("x"))


def factors(spark: SparkSession, folder: str) -> DataFrame:
    """(factor, metric, level, id, x): two factors over each user's events, type of event and a third of the events by hash of
    their id, and two metrics, the mean value and the largest."""
    rows = S.table(spark, folder, "events").select("user_id", "event_type", "value", F.concat(F.lit("part"), S.hashed(F.col("event_id")) % 3).alias("part"))
    long = rows.select(F.col("user_id").alias("id"), "value", F.explode(F.array(F.struct(F.lit("type").alias("factor"), F.col("event_type").alias("level")), F.struct(F.lit("part").alias("factor"), F.col("part").alias("level")))).alias("f"))
    sums = long.groupBy("f.factor", "f.level", "id").agg(F.round(F.avg("value"), 9).alias("mean"), F.max("value").alias("largest"))
    return sums.select("factor", "level", "id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in ("mean", "largest")])).alias("m")).select("factor", "m.metric", "level", "id", "m.x")


FACTOR_BASELINES = {"type": "view", "part": "part0"}
FACTOR_DIRECTIONS = {"mean": 1, "largest": -1}


def scored_labels(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, y and a fixed score in [0, 1): a stand-in certainty for calibration measures."""
    rows = S.table(spark, folder, "labels").join(S.table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    noise = S.hashed(F.col("doc_id")) % 1000 / 1000.0
    return rows.select("doc_id", F.col("quality").alias("y"), F.round(0.6 * F.least(F.lit(1.0), F.col("n_chars") / 4000.0) + 0.4 * noise, 9).alias("score"), F.when(F.col("doc_id") % 2 == 0, "train").otherwise("dev").alias("split"))


def run_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The attribution study: partition, decomposition, sweep, transitions, path, defects and generation of all configurations,
    and partition and decomposition again for each split."""
    run = RetrievalRun(spark, folder)
    rows = materialised(run.configurations())
    outcomes = run.outcomes()
    parts = P.partition(rows)
    out = {
        "partition": parts, "by_split": P.partition(rows, ("configuration", "split")), "decomposition": P.decomposition(rows, CENTRE), "sweep": P.threshold_sweep(rows),
        "path": P.sophistication_path(parts, PATH), "defects": P.trace_defects(rows), "generation": P.outcome_summary(outcomes, CENTRE), "contrasts": P.outcome_contrasts(outcomes, CENTRE),
        "prompts": P.prompt_comparison(run.outcomes(1), outcomes, CENTRE), "ablation": P.ablation(reviewed(run, 1), reviewed(run, 2)), "reviewed_check": P.reviewed_check(reviewed(run)),
    }
    out |= {f"transitions {a}": P.transitions(rows, a, CENTRE) for a in ARMS if a != CENTRE}
    return out | {f"decomposition {s}": P.decomposition(rows.where(F.col("split") == s), CENTRE) for s in ("train", "dev")}
