from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as X
from gleanery.operators import answers as A
from gleanery.operators import attribution as P
from gleanery.operators import certainty as Q
from gleanery.operators import chunking as C
from gleanery.operators import evidence as E
from gleanery.operators import models as M
from gleanery.operators import retrieval as R
from gleanery.operators import statistics as B
from gleanery.sources import sinks as K
from gleanery.sources import tables as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("word", "n"), [("table", 1), ("", 0), ("the", 1), ("idea", 2), ("123", 0)])
def test_syllables(spark, word, n):
    assert value(spark, X.syllables(F.lit(word))) == n


@pytest.mark.parametrize(("answer", "yes"), [("", True), (None, True), ("INSUFFICIENT EVIDENCE", True), ("Restart the server.", False)])
def test_abstention(spark, answer, yes):
    assert value(spark, X.is_abstention(F.lit(answer).cast("string"))) is yes


def test_citations_and_bodies(spark):
    assert value(spark, X.cited_segments(F.lit("see [swg1::chunk_0] and [swg2"))) == ["swg1::chunk_0", "swg2::truncated"]
    assert value(spark, X.answer_body(F.lit("Do  it [a1::chunk_2].\n**Evidence**: all\nmore"))) == "Do it ."


def test_token_f1(spark):
    assert value(spark, A.token_f1(F.lit("restart the server"), F.lit("restart server now"))) == 1.0
    assert value(spark, A.token_f1(F.lit(""), F.lit("x"))) == 0.0


@pytest.mark.parametrize(("n", "size", "overlap", "want"), [(10, 4, 0.25, [(0, 4), (3, 7), (6, 10)]), (8, 4, 0.0, [(0, 4), (4, 8)]), (1, 4, 0.0, [(0, 1)])])
def test_windows(spark, n, size, overlap, want):
    docs = spark.createDataFrame([(1, " " + " ".join("ab" for _ in range(n)))], "doc_id long, text string")
    got = C.word_windows(docs, size, overlap).orderBy("chunk_no").collect()
    assert [(r.char_start, r.char_end) for r in got] == [(1 + 3 * a, 3 * b) for a, b in want]


def test_windows_of_nothing(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "  \n")], "doc_id long, text string")
    assert C.word_windows(docs).count() == 0


def test_windows_of_a_long_text(spark):
    rng = random.Random(5)
    text = "".join(rng.choice(["a", "bcd"]) + rng.choice([" ", "\n\n", "   "]) for _ in range(140_000))
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    rows = C.word_windows(spark.createDataFrame([(1, text)], "doc_id long, text string"), 7, 0.4).orderBy("chunk_no").collect()
    want = [(spans[k][0], spans[min(k + 7, len(spans)) - 1][1]) for k in range(0, len(spans) - 3 + (-(len(spans) - 7)) % 4 * 0, 4)]
    assert [(r.char_start, r.char_end) for r in rows] == want[: len(rows)] and rows[-1].char_end == spans[-1][1]
    assert len(rows) == 1 + -(-(len(spans) - 7) // 4)


@pytest.mark.parametrize(("spans", "lo", "hi", "want"), [([(0, 10), (5, 12), (20, 30)], 4, 25, 13 / 21), ([(0, 5), (5, 10)], 0, 10, 1.0)])
def test_union_coverage(spark, spans, lo, hi, want):
    rows = spark.createDataFrame([(1, lo, hi, a, b) for a, b in spans], "q long, lo int, hi int, a int, b int")
    assert E.union_coverage(rows, ["q"]).first()["coverage"] == pytest.approx(want)


@pytest.mark.parametrize(("n", "k"), [(0, 5), (1, 5), (3, 2), (6, 5), (12, 1), (18, 5), (19, 5)])
def test_ceiling_equals_every_choice(spark, n, k):
    rng = random.Random(n)
    spans = [(a, a + rng.randrange(1, 30)) for a in (rng.randrange(100) for _ in range(n))]
    asked = spark.createDataFrame([(1, "dev", True, 7, 10, 90), (2, "dev", True, 8, 0, 5), (3, "dev", False, None, None, None)], "question_id long, split string, answerable boolean, gold_doc long, gold_start long, gold_end long")
    chunks = spark.createDataFrame([(7, i, a, b) for i, (a, b) in enumerate(spans)], "doc_id long, chunk_no int, char_start int, char_end int")
    got = {r.question_id: r for r in E.segmentation_ceiling(asked, chunks, k).collect()}
    covered = lambda chosen: len({x for a, b in chosen for x in range(max(a, 10), min(b, 90))})
    assert got[1].ceiling == pytest.approx(max((covered(c) for c in combinations(spans, min(k, n))), default=0) / 80)
    assert got[1].n_gold_chunks == n and got[2].ceiling == 0 and set(got) == {1, 2}


def test_holm(spark):
    rows = spark.createDataFrame([("a", 0.01, 1), ("b", 0.04, 1), ("c", 0.03, 1)], "k string, p double, f int")
    got = {r.k: r.p_holm for r in B.holm(rows, ["f"], "p", "k").collect()}
    assert got == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06})


def test_rrf_of_twice_first(spark):
    one = R.ranked(spark.createDataFrame([(1, 7, 0, 0.9)], "question_id long, doc_id long, chunk_no int, score double"))
    assert R.rrf(one, one).first()["score"] == pytest.approx(2 / 61)


def test_auroc_and_edges(spark):
    rows = spark.createDataFrame([(1, 0.1, 0), (1, 0.4, 0), (1, 0.4, 1), (1, 0.8, 1)], "g int, s double, y int")
    assert Q.auroc(rows, ["g"], "s", "y").first()["auroc"] == pytest.approx(0.875)
    edge = spark.createDataFrame([(0.3, 1)], "s double, y int")
    assert Q.binned(edge, "s", "y").where("n = 1").first()["bin"] == 2
    assert [value(spark, Q.band(F.lit(x))) for x in (0.35, 0.349, 0.6, 0.85)] == ["low", "insufficient", "probable", "certain"]


@pytest.mark.parametrize(("row", "want"), [((0.79, True, True, 1.0), "S1"), ((0.9, False, False, 0.0), "S2"), ((0.9, True, True, 0.79), "S3"), ((None, True, True, 0.8), "R")])
def test_stage(spark, row, want):
    rows = spark.createDataFrame([row], "ceiling double, in_top_20 boolean, in_top_5 boolean, coverage double")
    assert P.attributed(rows).first()["stage"] == want


def test_f_tail():
    assert B.f_p_value(3.0, 2, 20) == pytest.approx(0.0725382, abs=1e-6)
    assert B.f_p_value(1.0, 4, 40) == pytest.approx(0.4189048, abs=1e-6)


def test_logistic_separates(spark):
    rows = spark.createDataFrame([(float(i), int(i > 10)) for i in range(20)], "x double, y int")
    model = Q.Logistic(("x",)).fit(rows, "y")
    got = rows.select("y", model.score().alias("p")).collect()
    assert all((r.p >= 0.5) == bool(r.y) for r in got)


def test_citation_bands(spark):
    band = lambda a: value(spark, Q.citation_band(F.lit(a), F.lit("swg1")))
    assert [band("x [swg1::chunk_0]"), band("x [a::chunk_1] [b::chunk_2] [c::chunk_3]"), band("x [b2::chunk_2]"), band("")] == ["high", "low", "medium", "low"]


def test_auroc_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40) / 7, rng.randrange(2)) for _ in range(500)]
    want = sum((a > b) + (a == b) / 2 for a, y in rows for b, z in rows if y and not z) / (sum(y for _, y in rows) * sum(1 - y for _, y in rows))
    for parts in (1, 5, 64):
        assert Q.auroc(spark.createDataFrame(rows, "s double, y int"), [], "s", "y", parts).first()["auroc"] == pytest.approx(want)


def test_items_are_located_in_every_document(spark):
    texts = {1: "the quick brown fox jumps over it", 2: "xthe quick brown foxy", 3: None, 4: "", 5: "a  b", 6: "no quick"}
    items = {1: "the quick brown fox", 2: "quick", 3: "brown fox", 4: "a  b", 5: "fox jumps over", 6: "missing words in all of them", 7: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.item_id, r.doc_id, r.at) for r in S.located(spark.createDataFrame(list(items.items()), "item_id long, text string"), docs).collect()}
    assert got == {(i, d, t.index(x) + 1) for i, x in items.items() if x for d, t in texts.items() if t and x in t}


def test_items_are_located_without_dealing_out_texts(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("ab\u00e9\u65e5") for _ in range(rng.randrange(1, 4)))
    texts = {i: "".join(word() + rng.choice([" ", "  ", "\t", "\n"]) for _ in range(rng.randrange(60))) for i in range(80)}
    items = {}
    for i in range(120):  # of every length, from a text or from none
        text = texts[rng.randrange(80)] if i % 4 else "".join(word() + " " for _ in range(20))
        at = rng.randrange(len(text) + 1)
        items[i] = text[at : at + 1 + i % 60]
    items = {i: x for i, x in items.items() if x}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = S.located(spark.createDataFrame(list(items.items()), "item_id long, text string"), docs)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.item_id, r.doc_id, r.at, r.n) for r in got.collect()} == {(i, d, t.index(x) + 1, len(x)) for i, x in items.items() for d, t in texts.items() if x in t}


def test_candidates_without_losses(spark):
    docs = spark.createDataFrame([(10**12 + 7 * i,) for i in range(60)], "doc_id long")
    asked = spark.createDataFrame([(1, 10**12), (2, None)], "question_id long, gold_doc long")
    got = S.candidates(asked, docs, 49).collect()
    assert len(got) == len(set(got)) == 50 + 49 and (1, 10**12) in got
    assert S.candidates(asked, docs, 500).count() == 60 + 60


def test_planted_defects(spark):
    cols = "configuration string, question_id long, in_top_20 boolean, in_top_5 boolean, coverage double, mrr double, ceiling double"
    rows = [("a", 1, False, True, 0.5, 0.0, 1.0), ("a", 2, True, False, 0.5, 0.1, 1.0), ("a", 3, True, True, 1.2, 1.0, 1.0), ("a", 4, False, False, 0.0, 0.5, 1.0), ("a", 5, True, True, 0.9, 1.0, 0.8)]
    traces = spark.createDataFrame(rows, cols)
    assert P.trace_defects(traces).first().asDict() == {"in_5_not_20": 1, "covered_not_in_5": 1, "coverage_range": 1, "mrr_not_in_20": 1}
    assert [r.question_id for r in P.above_ceiling(traces).orderBy("question_id").collect()] == [3, 5]
    other = traces.withColumn("coverage", F.when(F.col("question_id") == 2, 0.4).otherwise(F.col("coverage"))).where("question_id <> 4")
    assert {r.question_id for r in P.identity_defects({"a": traces, "b": other}).collect()} == {2, 4}


def test_lost_reach_is_counted_against_the_centre(spark):
    rows = [("c", 1, "R", "OK"), ("c", 2, "R", "S4"), ("c", 3, "S2", "S2"), ("x", 1, "S3", "S3"), ("x", 2, "S2", "S2"), ("x", 3, "R", "S4")]
    table = spark.createDataFrame([(c, q, s, False, o == "OK", o) for c, q, s, o in rows], "configuration string, question_id long, stage string, abstained boolean, correct boolean, outcome string")
    got = {r.configuration: (r.lost_reach, r.lost_reach_s4) for r in P.outcome_summary(table, "c").collect()}
    assert got == {"c": (0, 0), "x": (2, 1)}


def test_best_answer_of_several_counts(spark):
    answers = spark.createDataFrame([("c", 1, 0.1, False), ("c", 1, 0.9, True), ("c", 2, None, None)], "configuration string, question_id long, token_f1 double, abstained boolean")
    stages = spark.createDataFrame([("c", 1, "R"), ("c", 2, "R")], "configuration string, question_id long, stage string")
    assert {r.question_id: r.outcome for r in P.outcomes(answers, stages).collect()} == {1: "OK", 2: "S4"}


def test_shift_of_a_score(spark):
    assert Q.log_odds_shift(0.2, 1.0) == Q.log_odds_shift(None, 0.5) == 0
    shift = Q.log_odds_shift(0.5, 0.8)
    assert value(spark, Q.shifted(F.lit(0.5), shift)) == pytest.approx(0.8)


def test_a_body_that_declines_is_low(spark):
    said = "[swg1::chunk_0] [swg1::chunk_1]"
    assert value(spark, Q.citation_band(F.lit(said), F.lit("swg1"))) == "low"


def test_excerpts(spark):
    rows = spark.createDataFrame([("a b target c d target target e", "Target now")], "text string, query string")
    assert C.excerpts(rows, 3).first()["excerpt"] == "d target target"
    assert C.token_excerpts(rows, 2).first()["excerpt"] == "target target"
    assert value(spark, C.clipped(F.lit("one two-three four"), 3)) == "one two- [...]" and value(spark, C.clipped(F.lit("one two"), 3)) == "one two"


def test_prompts_shrink_until_they_fit(spark):
    rows = spark.createDataFrame([(1, r, f"d::chunk_{r}", "w " * 300) for r in range(3)], "question_id long, rnk int, label string, text string")
    got = A.prompts(rows, 400).first()
    assert got["share"] == 106 and got.n_words == 3 * 107
    assert A.prompts(rows, 100).first()["share"] == 64 and got.prompt.startswith("[d::chunk_0]\nw w")


def test_batches_are_halved():
    calls = []

    def run(prompts):
        calls.append(len(prompts))
        if len(prompts) > 2:
            raise RuntimeError("CUDA out of memory")
        return [p.upper() for p in prompts]

    assert A.halving(run, list("abcde")) == list("ABCDE") and calls == [5, 2, 3, 1, 2]
    with pytest.raises(MemoryError):
        A.halving(lambda p: (_ for _ in ()).throw(MemoryError()), ["x"])


def test_encoders(spark):
    rows = spark.createDataFrame([(1, "bb"), (2, None), (3, "a")], "id long, text string")
    load = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])
    got = {r.id: r.vector for r in M.encode_texts(rows, ["id"], "text", load, "q").collect()}
    assert got[1] == pytest.approx([3 / 10**0.5, 1 / 10**0.5], abs=1e-6) and got[2] == pytest.approx([0.5**0.5] * 2, abs=1e-6)
    docs = spark.createDataFrame([(1, "aa bb cc")], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 6, 8)], "doc_id long, chunk_no int, char_start int, char_end int")
    tokens = lambda: lambda texts: [(np.array([[0, 2], [3, 5]]), np.array([[1.0, 0.0], [0.0, 1.0]])) for _ in texts]
    got = {r.chunk_no: (r.vector, r.beyond) for r in M.late_chunk_embeddings(chunks, docs, tokens).collect()}
    assert got[0][0] == pytest.approx([0.5**0.5] * 2, abs=1e-6) and got[1][1] and not got[0][1]


def test_results_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([("m", 1, 0.5, float("nan"))], "method string, question_id long, ceiling double, x double")
    K.save_table(rows, f"{tmp_path}/c.csv")
    assert S.ceiling_table(spark, f"{tmp_path}/c.csv").first()["ceiling"] == 0.5
    assert S.result_table(spark, f"{tmp_path}/none.csv") is None and S.result_records(spark, f"{tmp_path}/none.csv").count() == 0
    assert '"ceiling":0.5' in S.result_records(spark, f"{tmp_path}/c.csv").first()["record"]
    with pytest.raises(ValueError, match="ceiling"):
        S.required(rows.drop("ceiling"), {"ceiling"}, "c")
    with pytest.raises(FileNotFoundError):
        S.factor_traces(spark, str(tmp_path))
    K.save_json(rows, f"{tmp_path}/c.json")
    assert S.result_json(spark, f"{tmp_path}/c.json").first()["x"] is None
    K.save_markdown(rows, f"{tmp_path}/c.md")
    assert [r.value for r in spark.read.text(f"{tmp_path}/c.md").collect()][0] == "| method | question_id | ceiling | x |"
    made = lambda: spark.range(3)
    assert K.read_through(spark, f"{tmp_path}/t", made).count() == 3 and K.read_through(spark, f"{tmp_path}/t", None).count() == 3
    assert K.read_through(spark, f"{tmp_path}/t", lambda: spark.range(5), 5).count() == 5
    with pytest.raises(FileNotFoundError):
        K.read_through(spark, f"{tmp_path}/u", None)


def test_nearest_vectors(spark):
    rng = random.Random(5)
    rows = [(n, n % 3, [rng.choice((-0.5, 0.25, 1 / 3)) for _ in range(3)]) for n in range(60)]
    rows += [(60, 1, None), (61, None, [1.0, None, 1.0]), (70, 1, [1.0, 1.0]), (71, 1, [2.0, 1.0]), (80, 2, []), (None, 1, [1.0] * 3)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = R.nearest(vectors, vectors.where("vec_id % 10 = 0"), 4)
    held = {r["vec_id"]: r for r in vectors.where("vec_id is not null").collect()}

    def score(a, b):
        a, b = a["embedding"], b["embedding"]
        if a is None or b is None or len(a) != len(b) or None in a + b:
            return None
        return round(sum(x * y for x, y in zip(a, b)), 9)

    want = set()
    for q in [i for i in held if i % 10 == 0]:
        found = sorted(((score(held[q], r), i) for i, r in held.items() if i != q), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
        want |= {(q, i, s, n, held[q]["label"] == held[i]["label"]) for n, (s, i) in enumerate(found[:4], 1)}
    rows = got.collect()
    assert len(rows) == len(want) and {(r["query_id"], r["vec_id"], r["score"], r["rnk"], r["same_label"]) for r in rows} == want
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()  # queries once for each part outgrew the driver


def test_documents_in_sight_are_written_once(spark):
    from gleanery.plans.runs import RetrievalRun

    run = RetrievalRun(spark, "/root/testdata/sf0.001")
    other = run.other("recursive_structure")
    assert other.visible is run.visible
    assert run.visible.inputFiles() and not any("documents.parquet" in f for f in run.visible.inputFiles())
    gold = run.asked.where("answerable").select(F.col("gold_doc").alias("doc_id"))
    assert gold.count() and gold.join(run.visible, "doc_id", "left_anti").isEmpty()
    assert {r[0] for r in run.visible.select("doc_id").collect()} == {r[0] for r in run.candidates.select("doc_id").collect()}
