"""Toxicity by weak supervision.

1. Voters. A short fixed lexicon, and words and word beginnings that labelled rows suggest, each vote "toxic" where they
   occur. Candidates come from a bounded sample of labelled rows (``SAMPLE``), chosen by a hash of the key.
2. Votes. One pass over all whole texts notes which voters and other features each document has.
3. Label model. Over all documents, second moments of the votes show which voters agree more often than their accuracies
   explain; such correlated voters form a block (the words of one language, say), of which only the number of votes
   counts. A document is clean, or toxic in the manner of one of the blocks. An EM over the counts of vote patterns -
   all documents, with the labelled training rows as anchors - estimates how often each block votes in each case, and
   gives each pattern's posterior.
4. Classifier. A logistic regression on the features learns the posteriors of a bounded sample (``SAMPLE``) of training
   rows, labelled or not, and scores every document.

What the driver holds is bounded: voters and features, pairs of voters, patterns of at most ``BLOCKS`` blocks, and the
two samples' feature lists. Only rows outside the held-out fold give labels or posteriors to learn from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, col, in_batches, released, tidy
from .language_id import held_out

#: Words that vote without any label.
LEXICON = (
    "asshole", "bastard", "bitch", "clown", "cretin", "disgusting", "dumb", "fool", "hate", "idiot", "imbecile", "jerk",
    "kill", "loser", "moron", "pathetic", "scum", "shit", "stupid", "trash", "ugly", "vermin", "worthless",
)
#: Labelled rows that suggest voters, and training rows that the classifier is fitted on; an argument of the operators.
SAMPLE = 20_000
#: Sampled toxic texts that a word or beginning must occur in to be a candidate.
SUPPORT = 5
#: Lengths of word beginnings that can be features.
HEADS = (4, 5, 6, 7, 8)
VOTERS = 256
FEATURES = 2048
BLOCKS = 8
#: A block's votes beyond this count alike.
VOTES = 3
LONGEST_WORD = 40

_words = re.compile(r"[^\W\d_]+").findall


def features(text: str) -> set[str]:
    """A text's distinct words, and their beginnings marked with a star."""
    found = {w[:LONGEST_WORD] for w in _words(text.lower())}
    return found | {w[:n] + "*" for n in HEADS for w in found if len(w) >= n}


def _counted(rows: DataFrame, wanted: list[str] | None) -> DataFrame:
    """In how many texts each feature (of ``wanted``) occurs."""
    among = None if wanted is None else frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                found = features(t.as_py() or "")
                n.update(found if among is None else found & among)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["feature", "n"])

    return in_batches(rows).mapInArrow(tidy(run), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def sampled(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """``size`` rows, or all if there are fewer, by a hash of the key.

    A share of the hashes that holds some more than ``size`` rows is cut out first, so that a task offers its part of
    the sample and not ``size`` rows of its own.
    """
    n = rows.count()
    share = min(1.0, (size + 8 * size**0.5) / max(1, n))
    picked = rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40)))
    return picked.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(size)


class Model:
    """What was learned: the vocabulary, and the classifier's weights and intercept."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, bias: float):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias

    def score(self, found: list[list[int]]) -> np.ndarray:
        """Scores of texts with these features."""
        at = np.repeat(np.arange(len(found)), [len(f) for f in found])
        of = np.array([i for f in found for i in f], int)
        s = self.bias + np.bincount(at, self.weights[of], len(found))
        return 1 / (1 + np.exp(-np.clip(s, -35, 35)))


class Vocabulary:
    """Features by number; the first ``voters`` of them vote."""

    def __init__(self, names: list[str], voters: int):
        self.names, self.voters = names, voters
        self.words = {n: i for i, n in enumerate(names) if not n.endswith("*")}
        self.starts = {n[: HEADS[0]].rstrip("*") for n in names}
        self.heads = [(k, {n[:-1]: i for i, n in enumerate(names) if n.endswith("*") and len(n) == k + 1}) for k in HEADS]

    def found(self, text: str) -> list[int]:
        out: set[int] = set()
        for w in set(_words(text.lower())):
            if w[: HEADS[0]] not in self.starts:
                continue
            if w in self.words:
                out.add(self.words[w])
            for k, heads in self.heads:
                if (h := w[:k]) in heads and len(w) >= k:
                    out.add(heads[h])
        return sorted(out)


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> Vocabulary:
    """Voters and features from how many labelled texts of either kind have each candidate.

    A voter's share of toxic texts, as if it had occurred in one more text of either kind, is at least three quarters
    of what the base rate allows; a longer beginning or word says nothing new beside a voter that it begins with.
    """
    base = (n_toxic + 1) / (n_toxic + n_clean + 2)
    odds = {f: np.log((t + 0.5) / (n_toxic + 1)) - np.log((clean.get(f, 0) + 0.5) / (n_clean + 1)) for f, t in toxic.items()}
    sure = [f for f, t in toxic.items() if t >= SUPPORT and (t + base) / (t + clean.get(f, 0) + 1) >= 0.75]
    voters: list[str] = [w for w in LEXICON if clean.get(w, 0) <= 3 * toxic.get(w, 0) + 1]
    has = set(voters)
    for f in sorted(sure, key=lambda f: (-toxic[f], len(f), f)):
        if len(voters) >= VOTERS:
            break
        stem = f.rstrip("*")
        if f not in has and not any(stem[:k] + "*" in has for k in HEADS if k < len(stem) or (k == len(stem) and not f.endswith("*"))):
            voters.append(f)
            has.add(f)
    strength = sorted((f for f in odds if f not in has and toxic[f] >= SUPPORT), key=lambda f: (-abs(odds[f]) * toxic[f] ** 0.5, f))
    return Vocabulary(voters + strength[: FEATURES - len(voters)], len(voters))


def blocks_of(n: int, single: np.ndarray, pairs: dict[tuple[int, int], int], accuracy: np.ndarray, prior: float, voters: int) -> np.ndarray:
    """The block of each voter: voters that agree more often than ``accuracy`` (voters x 2 labels) explains are together.

    The largest blocks have numbers from 0, all others share the last one of ``BLOCKS``.
    """
    root = list(range(voters))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for (i, j), both in pairs.items():
        expected = n * float(prior * accuracy[i, 1] * accuracy[j, 1] + (1 - prior) * accuracy[i, 0] * accuracy[j, 0])
        spread = np.sqrt(max(1.0, single[i] * single[j]))
        if both >= 5 and (both - expected) / spread > 0.05:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    of = np.array([find(i) for i in range(voters)])
    weight = Counter()
    for i, r in enumerate(of):
        weight[int(r)] += int(single[i])
    order = [r for r, _ in sorted(weight.items(), key=lambda x: (-x[1], x[0]))]
    number = {r: min(k, BLOCKS - 1) for k, r in enumerate(order)}
    return np.array([number[int(r)] for r in of], int)


def posteriors(patterns: np.ndarray, n: np.ndarray, anchors: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """P(toxic | pattern) for each pattern (patterns x blocks of vote counts), and the prior.

    ``n``: documents without a training label; ``anchors``: (patterns x 2) documents with either training label. A
    document is clean, toxic in the manner of one block, or toxic in a manner that no voter knows; given that, blocks
    vote independently of each other. Labelled documents stay on their side, the others are spread by EM.
    """
    k, blocks = len(patterns), patterns.shape[1]
    kinds = blocks + 2  # 0: clean, 1 to blocks: toxic by that block, last: toxic otherwise
    base = float((anchors[:, 1].sum() + 1) / (anchors.sum() + 2))
    toxic = (anchors[:, 1] + base) / (anchors.sum(1) + 1)
    likely = np.full((k, kinds), 1e-3)
    top = patterns.argmax(1) + 1
    likely[np.arange(k), np.where(patterns.max(1, initial=0) > 0, top, kinds - 1)] = 1
    likely[:, 1:] *= (toxic / likely[:, 1:].sum(1))[:, None]
    likely[:, 0] = 1 - toxic
    everyone = anchors.sum(1) + n
    for _ in range(rounds):
        bad = likely[:, 1:] / likely[:, 1:].sum(1, keepdims=True)
        weight = n[:, None] * likely
        weight[:, 0] += anchors[:, 0]
        weight[:, 1:] += anchors[:, 1:2] * bad
        logs = np.log((weight.sum(0) + 0.1) / (weight.sum() + 0.1 * kinds)) + np.zeros((k, kinds))
        for b in range(blocks):
            usual = np.bincount(patterns[:, b], everyone, VOTES + 1) / max(1.0, float(everyone.sum()))
            for z in range(kinds):
                table = np.bincount(patterns[:, b], weight[:, z], VOTES + 1) + 0.5 * usual + 1e-3
                logs[:, z] += np.log(table / table.sum())[patterns[:, b]]
        likely = np.exp(logs - logs.max(1, keepdims=True, initial=-np.inf))
        likely /= likely.sum(1, keepdims=True)
    share = likely[:, 1:].sum(1)
    return share, float((share * everyone).sum() / max(1.0, float(everyone.sum())))


def logistic(rows: list[list[int]], target: np.ndarray, size: int, l2: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on sets of features with soft targets (Adam on the whole batch)."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    of = np.array([i for r in rows for i in r], int)
    w, b = np.zeros(size), float(np.log((target.sum() + 0.5) / (len(target) - target.sum() + 0.5))) if len(target) else 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1 if len(target) else 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(at, w[of], len(rows)), -35, 35)))
        g = np.append(np.bincount(of, (p - target)[at], size) / len(rows) + l2 * w, (p - target).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fitted(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> tuple[Model, DataFrame]:
    """The model, and doc_id and found, the features of each row of ``docs``."""
    given = labels.select(col(key).cast("long").alias("l_id"), col(label).cast("int").alias("y")).where("l_id is not null and y in (0, 1)")
    given = given.where(~held_out(F.col("l_id"))).groupBy("l_id").agg(F.max("y").alias("y"))
    rows = docs.select(col(key).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    seen = checkpointed(rows.join(F.broadcast(sampled(given, "l_id", sample, 11)), F.col("doc_id") == F.col("l_id")).select("text", "y"))
    n = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = _counted(seen.where("y = 1").select("text"), None).where(F.col("n") >= SUPPORT).collect()
    toxic = {r["feature"]: r["n"] for r in found}
    clean = {r["feature"]: r["n"] for r in _counted(seen.where("y = 0").select("text"), [*toxic, *LEXICON]).collect()}
    vocabulary = choose(toxic, clean, n.get(1, 0), n.get(0, 0))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [vocabulary.found(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "found"])

    noted = checkpointed(in_batches(rows).mapInArrow(tidy(look), "doc_id long, found array<int>"))
    voters = vocabulary.voters
    votes = noted.select("doc_id", F.filter("found", lambda i: i < voters).alias("v")).join(given, F.col("doc_id") == F.col("l_id"), "left").select("doc_id", "y", "v")

    total = noted.count()
    labelled = votes.where("y is not null").select("y", F.explode("v").alias("i")).groupBy("i", "y").count().collect()
    accuracy = np.full((voters, 2), 0.5)
    for r in labelled:
        accuracy[r["i"], r["y"]] += r["count"]
    sizes = votes.where("y is not null").groupBy("y").count().collect()
    have = np.array([next((r["count"] for r in sizes if r["y"] == y), 0) for y in range(2)], float)
    accuracy /= have + 1
    couples = votes.where(F.size("v") > 0).select(F.explode("v").alias("i"), "v").select("i", F.explode("v").alias("j")).where("i <= j").groupBy("i", "j").count().collect()
    single = np.zeros(voters)
    pairs = {}
    for r in couples:
        if r["i"] == r["j"]:
            single[r["i"]] = r["count"]
        else:
            pairs[r["i"], r["j"]] = r["count"]
    block = blocks_of(total, single, pairs, accuracy, float((have[1] + 1) / (have.sum() + 2)), voters)
    members = [[F.lit(int(i)) for i in np.flatnonzero(block == b)] for b in range(BLOCKS)]
    per = [F.least(F.size(F.array_intersect("v", F.array(*m))), F.lit(VOTES)) if m else F.lit(0) for m in members]
    marked = votes.select("doc_id", "y", F.array(*per).alias("pattern"))
    counted = marked.groupBy("pattern", "y").count().collect()
    patterns = sorted({tuple(r["pattern"]) for r in counted})
    number = {p: k for k, p in enumerate(patterns)}
    free, anchors = np.zeros(len(patterns)), np.zeros((len(patterns), 2))
    for r in counted:
        if r["y"] is None:
            free[number[tuple(r["pattern"])]] += r["count"]
        else:
            anchors[number[tuple(r["pattern"])], r["y"]] += r["count"]
    share, prior = posteriors(np.array(patterns, int).reshape(-1, BLOCKS), free, anchors)

    learn = sampled(noted.where("doc_id is not null").where(~held_out(F.col("doc_id"))), "doc_id", sample, 12).collect()
    target = []
    for r in learn:
        c = np.bincount([block[i] for i in r["found"] if i < voters], minlength=BLOCKS)[:BLOCKS] if r["found"] else np.zeros(BLOCKS, int)
        target.append(share[number[tuple(int(x) for x in np.minimum(c, VOTES))]])
    weights, bias = logistic([list(r["found"]) for r in learn], np.array(target), len(vocabulary.names))
    return Model(vocabulary, weights, bias), noted


def toxicity_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) for each row of ``docs``.

    Null and empty texts get the score of a text without any feature. Labels that are null, or other than 0 and 1, teach
    nothing; of several labels of a key the largest counts. Without labels the lexicon alone votes. A row with a null key
    is in the held-out fold. Repeated rows are scored alike; an empty table gives no rows. ``sample``: how many labelled
    rows suggest voters, and how many training rows the classifier is fitted on, at most.
    """
    model, noted = fitted(docs, labels, text, key, label, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1).to_pylist()))], ["doc_id", "score"])

    scored = noted.mapInArrow(tidy(score), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Each row is judged by its own text, whatever its key: rows with a null or repeated key too. Null and empty texts are
    judged like a text without any feature.
    """
    model, noted = fitted(docs, labels, text, key, label, sample)
    released(noted)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score([model.vocabulary.found(t or "") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["_row", "_score"])

    marked = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_row"), col(text).cast("string").alias("_text"))
    marked = in_batches(marked).mapInArrow(tidy(judge), T.StructType([marked.schema.fields[0], T.StructField("_score", T.DoubleType())]))
    return marked.where("_score < 0.5").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
