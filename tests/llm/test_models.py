"""Hard negatives, clusters and language-model scores against brute force, on odd rows and on the smallest tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import centroids as C
from gleanery.llm import hard_negatives as H
from gleanery.llm import lm_scoring as L
from gleanery.llm.packs import pack, unpack

VECTORS = "vec_id long, embedding array<double>, label int, score string, `Rank` int"


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint64), np.zeros(5, np.uint64), rng.integers(0, 1 << 64, 50, np.uint64), rng.integers(0, 300, 70), np.array([(1 << 64) - 1], np.uint64)):
        assert (unpack(pack(x)) == x.astype(np.uint64)).all()


def some_vectors(n=260, dims=6, seed=3):
    """Few different components, so that scores and distances tie; copies, odd rows, and ids that repeat."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) / 4 for v in rng.integers(-3, 4, dims)], int(rng.integers(0, 3)), "s", 1) for i in range(n)]
    rows += [(n + i, rows[100][1], i % 3, "s", 1) for i in range(40)]  # copies of an anchor's vector
    rows += [(900, None, 1, "s", 1), (901, [1.0, None], 1, "s", 1), (902, [float("nan")] * dims, 1, "s", 1), (903, [float("inf")] * dims, 0, "s", 1), (904, rows[0][1], None, "s", 1), (None, rows[0][1], 1, "s", 1), (905, [], 0, "s", 1)]
    return rows + [rows[100], rows[101], rows[101]]


def brute_negatives(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    fine = [(i, [math.floor(scale * x) for x in v], k) for i, v, k, *_ in rows if i is not None and v is not None and k is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out, anchors = [], {}
    for i, v, k in fine:
        if i % every == 0 and (i not in anchors or (str(k), v) < (str(anchors[i][1]), anchors[i][0])):
            anchors[i] = (v, k)
    for a, (v, k) in anchors.items():
        best = sorted((-dot(v, w), i) for i, w, m in fine if m == k and i != a)[:positives]
        for s, p in best:
            found = sorted((-dot(v, w), i) for i, w, m in fine if m != k and -low * s <= 100 * dot(v, w) <= -high * s)[:negatives]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(found)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(H, "SHARD", 64)
    monkeypatch.setattr(H, "BLOCK", 2)
    rows = some_vectors()
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = sorted(tuple(r) for r in H.hard_negatives(table, F.col("vec_id") % 50 == 0).collect())
    assert got == brute_negatives(rows, 50)
    assert got


def test_anchors_of_hard_negatives_travel_once(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 2)
    run, plans = H._pass, []

    def spied(*args):
        plans.append((out := run(*args))._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(H, "_pass", spied)
    rows = some_vectors(120)
    table = spark.createDataFrame(rows, VECTORS)
    assert sorted(tuple(r) for r in H.hard_negatives(table, F.col("vec_id") % 50 == 0).collect()) == brute_negatives(rows, 50)
    assert plans and not any("Generate explode" in p for p in plans)  # once for each partition outgrew the broadcast
    monkeypatch.setattr(H, "SLICE", 1)
    assert sorted(tuple(r) for r in H.hard_negatives(table, F.col("vec_id") % 50 == 0).collect()) == brute_negatives(rows, 50)
    assert any("Union" in p for p in plans)


def test_hard_negatives_of_wide_vectors_and_empty_tables(spark):
    rows = [(100, [3e9, 2.0, 1.0], 0, "s", 1), (1, [1e9, 5.0], 0, "s", 1), (2, [5e8, -7.0, 3.0], 1, "s", 1), (3, [5e8, -7.0, 3.0], 1, "s", 1), (4, [-1e9], 1, "s", 1)]
    table = spark.createDataFrame(rows, VECTORS)
    got = sorted(tuple(r) for r in H.hard_negatives(table, F.col("vec_id") % 100 == 0, scale=1).collect())
    assert [r[:4] for r in got] == [(100, 1, 1, 2), (100, 1, 2, 3)]
    assert got == brute_negatives([(i, [*v, 0.0, 0.0][:3], *r) for i, v, *r in rows], scale=1)
    assert H.hard_negatives(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert H.hard_negatives(table.where("vec_id < 100"), F.col("vec_id") % 100 == 0).count() == 0


def brute_clusters(rows, k, rounds, dims, scale=256):
    x = [(i, [math.floor(scale * c) for c in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in x if i is not None)
    cents = [v for _, v in order[:k]]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda v: min((square(v, c), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        to = [nearest(v)[1] for _, v in x]
        for n in range(len(cents)):
            own = [v for (_, v), t in zip(x, to) if t == n]
            if own:
                cents[n] = [sum(col) // len(own) for col in zip(*own)]
    last = [(i, *nearest(v)) for i, v in x]
    inertia = Counter()
    for _, d, n in last:
        inertia[n] += d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((str(i), n, d, inertia[n], sum(inertia.values()), shas[n]) for i, d, n in last)


@pytest.mark.parametrize(("k", "scale"), [(7, 256), (1, 256), (400, 256), (5, 1 << 40)])
def test_clusters(spark, monkeypatch, k, scale):
    monkeypatch.setattr(C, "SHARD", 50)
    monkeypatch.setattr(C, "AT_ONCE", 64)
    rows = some_vectors()
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = sorted((str(r[0]), *r[1:]) for r in C.clusters(table, k, 3, 6, scale=scale).collect())
    want = [r if max(r[2:5]) < C.LARGEST else (*r[:2], *(min(v, C.LARGEST) for v in r[2:5]), r[5]) for r in brute_clusters(rows, k, 3, 6, scale)]
    assert got == want
    assert C.clusters(table.limit(0), k).count() == C.clusters(table, k, dims=9).count() == 0


def test_cover_tree():
    rng = np.random.default_rng(8)
    x = np.vstack([rng.integers(-9, 9, (120, 3)), rng.integers(-900, 900, (80, 3)), np.zeros((20, 3))]).astype(float)
    tree = C.Tree.over(x)
    assert sorted(tree.order) == list(range(len(x)))
    for n in range(len(tree.center)):
        points = x[tree.order[tree.lo[n] : tree.hi[n]]]
        assert np.sqrt(((points - x[tree.center[n]]) ** 2).sum(1)).max() == tree.radius[n]
        kids = range(tree.child[n], tree.child[n] + tree.children[n])
        assert [tree.lo[k] for k in kids][1:] == [tree.hi[k] for k in kids][:-1]
        for a in kids:
            assert tree.radius[a] <= tree.radius[n] / 2
            assert all(np.linalg.norm(x[tree.center[a]] - x[tree.center[b]]) > tree.radius[n] / 2 for b in kids if b != a)
    assert all(tree.children[n] > 0 or tree.radius[n] == 0 for n in range(len(tree.center)))


def brute_scores(rows, parts, order, rounds):
    """Deleted interpolation over dictionaries of word tuples. ``parts``: the part of each row, as the operator deals them."""
    texts = [re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for _, t in rows]
    pad = lambda words: [""] * (order - 1) + words  # noqa: E731  (no word is empty)

    def counts(which):
        grams, contexts = Counter(), Counter()
        for words, p in zip(texts, parts):
            if p in which:
                w = pad(words)
                for i in range(order - 1, len(w)):
                    for n in range(1, order + 1):
                        grams[tuple(w[i - n + 1 : i + 1])] += 1
                        contexts[tuple(w[i - n + 1 : i])] += 1
        return grams, contexts

    every, kept = counts({1, 2}), counts({1})
    types = sum(len(g) == 1 for g in every[0])

    def estimates(words, of):
        w = pad(words)
        for i in range(order - 1, len(w)):
            out, bucket = [1 / (types + 1)], (0, 0)
            for n in range(1, order + 1):
                context = of[1][tuple(w[i - n + 1 : i])]
                out.append(of[0][tuple(w[i - n + 1 : i + 1])] / context if context else 0.0)
                if n > 1 and context:
                    bucket = (n - 1, context.bit_length() - 1)
            yield bucket, out

    total = every[1][()]
    start = lambda b: [1 / (b[0] + 2)] * (b[0] + 2) + [0.0] * (order - 1 - b[0]) if total else [1.0] + [0.0] * order
    held = [e for words, p in zip(texts, parts) if p == 2 for e in estimates(words, kept)]
    weights = {}
    for _ in range(rounds if total else 0):
        sums = {}
        for b, e in held:
            share = [a * x for a, x in zip(weights.get(b, start(b)), e)]
            own = sums.setdefault(b, start(b))
            sums[b] = [s + x / sum(share) for s, x in zip(own, share)]
        weights = {b: [x / sum(s) for x in s] for b, s in sums.items()}
    out = []
    for (key, _), words in zip(rows, texts):
        base = sum(math.log10((every[0][(w,)] + 1) / (total + types + 1)) for w in words)
        score = sum(math.log10(sum(a * x for a, x in zip(weights.get(b, start(b)), e))) for b, e in estimates(words, every))
        out.append((str(key), len(words), sum(every[0][(w,)] > 0 for w in words), total, round(base, 6), round(score, 6)))
    return sorted(out)


SCHEMA = "doc_id string, text string, score int, `Block` string, part int"


def lm_rows():
    rng = random.Random(4)
    vocabulary = "alpha beta gamma delta epsilon zeta eta theta iota kappa été 日本語 x".split()
    line = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "S"]) for _ in range(n))
    rows = [(f"d{i}", line(rng.randrange(1, 60)) + rng.choice(["", "\n", " \t "]) + line(3)) for i in range(150)]
    rows += [("e", ""), ("n", None), ("w", " \n "), (None, "nobody's alpha beta"), (None, None), rows[3], rows[3], ("long", "long " * 3000 + "y" * 9000)]
    return rows + [(f"c{i}", rows[5][1]) for i in range(60)]


@pytest.mark.parametrize(("order", "deleted"), [(3, 4), (2, 3), (1, 3), (4, 1)])
def test_lm_scores(spark, monkeypatch, order, deleted):
    monkeypatch.setattr(L, "BLOCK", 700)
    monkeypatch.setattr(L, "FRAGMENT", 1500)
    rows = lm_rows()
    docs = spark.createDataFrame([(*r, 1, "b", 0) for r in rows], SCHEMA).repartition(3)
    learn = L.fold(F.col("doc_id"), 7) != 2
    got = sorted((str(r[0]), *r[1:4], round(r[4], 6), round(r[5], 6)) for r in L.lm_scores(docs, learn, order=order, deleted=deleted, rounds=4).collect())
    left = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(""))), F.lit(deleted)) == 0
    part = {r[0]: r[1] for r in docs.select("doc_id", F.when(~learn, 0).when(left, 2).otherwise(1)).collect()}
    assert all((part[k] == 0) == (zlib.crc32((k or "").encode()) % 7 == 2) for k in part)
    assert got == brute_scores(rows, [part[k] for k, _ in rows], order, 4)


def test_lm_scores_of_long_texts(spark):
    rng = random.Random(6)
    text = " ".join(rng.choice(["a", "bb", "ccc" * 700]) for _ in range(4000))
    assert len(text) > L.LONG
    rows = [(1, text), (2, text.replace(" ", "\n")), (3, "a bb")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r for r in L.lm_scores(docs, F.col("doc_id") < 3).collect()}
    assert [got[i].n_tokens for i in (1, 2, 3)] == [4001, 4001, 3] and got[1].n_known == 4001 and got[1].train_tokens == 8002
    assert got[1].score == pytest.approx(got[2].score)


def test_words_of_long_texts_in_runs(monkeypatch):
    monkeypatch.setattr(L, "LONG", 50)
    data = b"one two " * 9 + b"z" * 300 + b" three\n" * 30 + b"y" * 70
    whole = L.Words().shingler.word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
    [(_, _, tokens, size)] = L.Words().tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert tokens.tolist() == [*whole.tolist(), int(L.END)] and size.tolist() == [len(whole) + 1]


def test_lm_scores_without_training_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in L.lm_scores(docs, F.lit(False)).collect()) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert sorted(tuple(r)[:4] for r in L.lm_scores(docs, F.lit(None).cast("boolean")).collect()) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert L.lm_scores(docs.limit(0), F.lit(True)).count() == 0


def test_probabilities_add_up():
    """Of every context the probabilities of all words, the end, and one unknown token add up to 1."""
    rng = random.Random(2)
    weights = L.starting_weights(3, 10)
    for b in range(len(weights)):
        free = np.array([rng.random() if w else 0 for w in weights[b]])
        weights[b] = free / free.sum()
    words = Counter(rng.choice("abcde") for _ in range(100))
    total, types = sum(words.values()), len(words)
    follow = {w: Counter(rng.choice("abc") for _ in range(9)) for w in words}
    for context in follow:
        bucket = L.BUCKETS + 3  # nine tokens follow it
        p = [weights[bucket, 0] / (types + 1) + weights[bucket, 1] * words[w] / total + weights[bucket, 2] * follow[context][w] / 9 for w in words]
        assert sum(p) + weights[bucket, 0] / (types + 1) == pytest.approx(1)


def test_lm_beats_single_words_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = L.fold(F.col("doc_id"), 7) == 2
    sums = L.lm_scores(docs, ~held).where(held).agg(F.sum("score").alias("model"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert sums.model > sums.base + 0.3 * sums.n  # a third of a decimal digit for each token, and more
