"""Structural and semantic chunks and late chunking: the DataFrame operators against plain Python, and plain Python by its rules."""

from __future__ import annotations

import hashlib
import random
import re
import sys

import chunk_reference as T
import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleanery.operators import models as M
from gleanery.operators import segmentation as G
from gleanery.operators.chunking import agreement

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module


def test_structural_chunks_hold_every_word():
    text = "One two. Three four five.\nSix seven eight nine ten.\n\nEleven twelve"
    spans = T.structural(text, [(0, 25), (26, 51)], 4, 0.0)
    assert " ".join(text[a:b] for a, b in spans).split() == text.split()
    assert all(len(text[a:b].split()) <= 4 for a, b in spans)


def test_pieces_take_the_coarsest_break_that_fits():
    text = "a b c. d e\nf g\n\nh i j k l m n"
    cut = lambda size: [text[a:b] for a, b in T.structural(text, None, size, 0.0)]
    assert cut(20) == [text]
    assert cut(7) == ["a b c. d e\nf g", "h i j k l m n"]
    assert cut(5) == ["a b c. d e", "f g", "h i j k l", "m n"]  # lines of the first paragraph, runs of the last
    assert cut(3) == ["a b c.", "d e", "f g", "h i j", "k l m", "n"]


def test_chunks_repeat_a_tail_that_leaves_room():
    text = "a b. c d. e f. g h."
    assert [text[a:b] for a, b in T.structural(text, None, 4, 0.5)] == ["a b. c d.", "c d. e f.", "e f. g h."]
    assert [text[a:b] for a, b in T.structural(text, None, 4, 0.25)] == ["a b. c d.", "e f. g h."]


def test_a_split_section_stands_alone():
    text = "a b\nc d. e f. g h.\ni j\n"
    sections = [(0, 4), (4, 19), (19, 23)]
    assert [text[a:b] for a, b in T.structural(text, sections, 4, 0.0)] == ["a b", "c d. e f.", "g h.", "i j"]
    assert [text[a:b] for a, b in T.structural(text, [(0, 4), (4, 13)], 20, 0.0)] == [text.strip()]


@pytest.mark.parametrize("seed", range(40))
def test_chunks_of_random_texts(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "bb", "c.", "d!", "\n", "\n\n", " \n", "e;"]) + rng.choice([" ", "  ", ""]) for _ in range(120))
    size = rng.choice([1, 3, 9])
    words = [m.span() for m in re.finditer(r"\S+", text)]
    spans = T.structural(text, None, size, 0.0)
    assert [w for a, b in spans for w in words if a <= w[0] < b] == words
    assert all(len(text[a:b].split()) <= size and text[a:b] == text[a:b].strip() for a, b in spans)
    for (a, b), (_, d) in zip(spans, spans[1:]):  # no chunk could have been joined with the whole next one
        assert len(text[a:d].split()) > size
    vectors = lambda texts: np.eye(8)[[len(t) % 8 for t in texts]]
    cut = T.semantic(text, vectors, size, 0.0, 50, 2, 2)
    assert [w for a, b in cut for w in words if a <= w[0] < b] == words


def test_semantic_cuts_where_sentences_differ():
    text = "x x. x x. x x. y y. y y. y y."
    vectors = lambda texts: np.array([[1.0, 0.0] if t.count("x") >= t.count("y") else [0.0, 1.0] for t in texts])
    assert [text[a:b] for a, b in T.semantic(text, vectors, 20, 0.0, 80, 1, 2)] == ["x x. x x. x x.", "y y. y y. y y."]


def random_text(rng, n):
    return rng.choice(["", "\n", " ", "\n\n "]) + "".join(rng.choice(["a", "bb", "c.", "d!", "\n", "\n\n", " \n", "e;", "été", "\t"]) + rng.choice([" ", "  ", ""]) for _ in range(n))


def random_sections(rng, text):
    """Ranges in order, some touching, some overlapping the one before, some empty, some with text before or behind them."""
    out, at = [], rng.randrange(0, 1 + len(text) // 3)
    while at < len(text) and rng.random() < 0.9:
        end = min(len(text), at + rng.randrange(1, 60))
        out.append((at, end))
        at = max(0, end + rng.choice([0, 0, 0, 1, 7, -3]))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return [random_text(rng, rng.choice([0, 1, 5, 60, 200])) for _ in range(50)] + ["", " \n ", "one", "w " * 400]


def spans(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r.chunk_no)):
        assert r.chunk_no == len(out.setdefault(r.doc_id, []))
        out[r.doc_id].append((r.char_start, r.char_end))
    return out


@pytest.mark.parametrize(("size", "overlap"), [(1, 0.0), (4, 0.5), (9, 0.25), (50, 0.1)])
def test_structural_chunks_equal_the_reference(spark, texts, size, overlap):
    rng = random.Random(size)
    given = [None if rng.random() < 0.1 else random_sections(rng, t) for t in texts]
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, given))] + [(999, None, [])], "doc_id long, text string, sections array<struct<start:int,end:int>>").repartition(3)
    want = lambda sections: {i: x for i, t in enumerate(texts) if (x := T.structural(t, sections(i, t), size, overlap))}
    assert spans(G.structural(docs, size, overlap)) == want(lambda i, t: None)
    assert spans(G.structural(docs, size, overlap, "sections")) == want(lambda i, t: given[i])
    lines = lambda t: [m.span() for m in re.finditer(r"[^\n]*\n|[^\n]+", t)]
    by_line = docs.withColumn("sections", G.line_sections(F.col("text")))
    assert {r.doc_id: [tuple(x) for x in r.sections] for r in by_line.collect()} == {**{i: lines(t) for i, t in enumerate(texts)}, 999: []}
    assert spans(G.structural(by_line, size, overlap, "sections")) == want(lambda i, t: lines(t))


def hashed_vectors(pieces):
    out = np.zeros((len(pieces), 64))
    for i, t in enumerate(pieces):
        for w in re.findall(r"[a-z0-9_./+-]+", t.lower()):
            out[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def lengths_encoder():
    return lambda texts: np.eye(8)[[len(t) % 8 for t in texts]] + 0.1


@pytest.mark.parametrize(("size", "overlap", "percentile", "least", "piece"), [(20, 0.0, 50, 2, 2), (6, 0.5, 95, 4, 3)])
def test_semantic_chunks_equal_the_reference(spark, texts, size, overlap, percentile, least, piece):
    docs = spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string").repartition(3)
    unit = lambda texts: M.unit(lengths_encoder()(texts))
    for load, encode in ((None, hashed_vectors), (lengths_encoder, unit)):
        want = {i: x for i, t in enumerate(texts) if (x := T.semantic(t, encode, size, overlap, percentile, least, piece))}
        assert spans(G.semantic(docs, load, size, overlap, percentile / 100, least, piece)) == want


def test_segmentation_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert G.structural(none).count() == G.semantic(none).count() == 0


def executed(df):
    """The plan of ``df`` as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_do_not_become_rows(spark):
    docs = spark.createDataFrame([(1, "a b. c d\n\n" * 500), (2, "été. " * 300)], "doc_id long, text string")
    rows = G._in_order(G.packed(G.pieces(docs, 20), ["doc_id"], 20, 2), ["c"])
    assert "Generate posexplode" not in executed(G.structural(docs, 20, 0.1)).split("MapInArrow")[-1]
    assert executed(rows).count("MapInArrow") == 1 == executed(G.structural(docs, 20, 0.1)).count("MapInArrow")
    assert [tuple(r) for r in G.pieces(docs, 20).where("doc_id = 2 and k < 2").select("held", "k", "n", "units", "char_start", "char_end").orderBy("k").collect()] == [(300, 0, 300, 1, 0, 4), (300, 1, 300, 1, 5, 9)]


def test_agreement_cuts_each_method_once(spark):
    rows = [("a", 1, 0, 5), ("a", 2, 0, 3), ("a", 2, 3, 9), ("b", 1, 0, 5), ("b", 3, 0, 1), ("c", 3, 0, 1), ("d", 2, 0, 4), ("d", 2, 3, 9)]
    got = agreement(spark.createDataFrame(rows, "method string, doc_id long, char_start int, char_end int"), "a")
    assert {tuple(r) for r in got.collect()} == {("a", 2, 1.0, 0.5, 0.5), ("b", 2, 0.5, 0.5, 0.0), ("c", 2, 0.0, 0.0, 0.0), ("d", 2, 0.0, 0.0, 0.5)}
    assert executed(got).split("== Initial Plan ==")[0].count("Scan ExistingRDD") == 1
    assert agreement(spark.createDataFrame(rows, "method string, doc_id long, char_start int, char_end int"), "z").count() == 0


def word_encoder():
    """Two components for each word: its length, and its place; blind beyond 40 characters."""

    def encode(texts):
        out = []
        for t in texts:
            at = np.array([m.span() for m in re.finditer(r"\S+", t) if m.end() <= 40], np.int64).reshape(-1, 2)
            out.append((np.vstack([at, [[0, 0]]]), np.vstack([np.stack([at[:, 1] - at[:, 0], at[:, 0]], 1).astype(float), [[9.0, 9.0]]])))
        return out

    return encode


def test_late_chunks_are_means_of_the_tokens_that_they_overlap(spark):
    rng = random.Random(1)
    docs = [(i, " ".join("x" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 15)))) for i in range(30)]
    chunks = [(i, c, a, a + 12) for i, t in docs for c, a in enumerate(range(0, max(1, len(t)), 7))]
    made = {i: word_encoder()([t])[0] for i, t in docs}
    got = {(r.doc_id, r.chunk_no): r for r in M.late_chunk_embeddings(spark.createDataFrame(chunks, "doc_id long, chunk_no int, char_start int, char_end int"), spark.createDataFrame(docs, "doc_id long, text string"), word_encoder).collect()}
    assert len(got) == len(chunks)
    for i, c, a, b in chunks:
        at, v = made[i][0][:-1], made[i][1][:-1]
        inside = (at[:, 1] > a) & (at[:, 0] < b)
        r = got[i, c]
        assert r.beyond == (not inside.any())
        if len(v):
            assert r.vector == pytest.approx(M.unit(v[inside].mean(0) if inside.any() else v.mean(0)).tolist(), abs=1e-6)
        else:
            assert r.vector is None


def test_tokens_meet_chunks_across_bins(spark):
    rng = random.Random(4)
    intervals = lambda n, most: [(rng.randrange(2), k, a := rng.randrange(300), a + rng.randrange(1, most)) for k in range(n)]
    tokens, chunks = intervals(60, 90), intervals(25, 200)
    left = spark.createDataFrame(tokens, "doc_id long, token_no int, char_start int, char_end int")
    right = spark.createDataFrame(chunks, "doc_id long, chunk_no int, char_start int, char_end int")
    want = sorted((k, c) for d, k, a, b in tokens for e, c, x, y in chunks if d == e and a < y and b > x)
    for width in (1, 16, 1000):
        assert sorted((r.token_no, r.chunk_no) for r in M.overlapping(left, right, width).collect()) == want
