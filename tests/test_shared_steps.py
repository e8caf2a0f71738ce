"""The steps that all configurations share: what they do not do twice, and that they run side by side."""

import hashlib
import math
import re

from gleanery.operators import models as M
from gleanery.operators import retrieval as R
from gleanery.operators import segmentation as G
from gleanery.plans import runs


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packing_walks_along_sorted_pieces(spark):
    rows = [(d, k, 1 + (7 * k + d) % 5, 10 * k, 10 * k + 9) for d in range(3) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, k int, units int, char_start int, char_end int")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups reach over batches
    try:
        got = G.packed(df, ["doc_id"], 12, 3)
        assert "Window" not in _plan(got)
        found = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    want = []
    for d in range(3):
        units, at, c = [r[2] for r in rows if r[0] == d], 0, 0
        while at < 40:
            begin = at
            while at and begin > 0 and sum(units[begin - 1 : at]) <= 3 and sum(units[begin - 1 : at + 1]) <= 12:
                begin -= 1
            end = begin
            while end < 40 and (end <= at or sum(units[begin : end + 1]) <= 12):
                end += 1
            want.append((d, c, sum(units[begin:end]), 10 * begin, 10 * (end - 1) + 9))
            at, c = end, c + 1
    assert found == sorted(want)


def test_late_vectors_take_one_pass(spark):
    text = "Ärger ab cd ab, ef. Gh"
    docs = spark.createDataFrame([(1, text), (2, "…"), (3, None)], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, 0, 0, 11), (1, 1, 11, len(text)), (1, 2, 5, 6), (2, 0, 0, 1)], "doc_id long, chunk_no int, char_start int, char_end int")
    rows = M.late_vectors(chunks, docs)
    assert "Window" not in _plan(rows)
    dim = lambda t: int(hashlib.md5(t.lower().encode()).hexdigest()[:8], 16) % M.LONG_DIMENSIONS
    tokens = [(m.start(), m.end(), dim(m.group())) for m in re.finditer("[A-Za-z0-9_./+-]+", text)]
    for chunk, (a, b) in enumerate([(0, 11), (11, len(text)), (5, 6)]):
        x = dict.fromkeys([d for *_, d in tokens], 0.0)
        own = [d for s, e, d in tokens if s < b and e > a]
        for d in own:
            x[d] += 1 / len(own)
        for *_, d in tokens:
            x[d] += 0.5 / len(tokens)
        size = math.sqrt(sum(v * v for v in x.values()))
        got = {r.dim: r.x for r in rows.where(f"doc_id = 1 and chunk_no = {chunk}").collect()}
        assert got.keys() == x.keys() and all(abs(got[d] - x[d] / size) < 1e-12 for d in x)
    assert rows.where("doc_id <> 1").count() == 0


def test_terms_are_hashed_once(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, "")], "id long, text string")
    made = R.encoded(rows, ["id"], "text")
    assert _plan(made).count("Generate explode") == 1
    assert abs(sum(r.x**2 for r in made.collect()) - 1) < 1e-12


def test_tables_of_a_run_are_written_side_by_side(spark):
    from threading import Barrier

    meet = Barrier(2, timeout=30)
    seen = []
    runs.together(spark, [lambda: seen.append((meet.wait(), spark.range(3).count())[1]) for _ in range(2)])
    assert seen == [3, 3]
