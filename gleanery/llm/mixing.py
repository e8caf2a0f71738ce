"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Only (key, source, size, hash) of each document takes part until a mix is written; texts stay where they are.

1. Targets. Sources by code point, null last, have the weights 5, 2, 1, repeating; they share ``volume`` times all
   words; a target stops at ``repeat`` times its source's words and the excess is shared again by weight.
2. Draws. A target of e times its source is floor(e) whole passes over the source's documents and a rest. For the
   rest, documents are drawn in the order of a seeded hash: first those with over a thousandth of the source's words
   (fewer than 1,000 for each source, whatever its size), each taken if it still fits their share; then the others up
   to the word count that is left. So a source's words miss the target by less than half of such a small document
   wherever the source has small documents enough. A document is never taken more than ``repeat`` times.
3. Blocks. What a source gives is one sequence of draws, cut into blocks of ``block_words`` words: its exact quota.
4. Tree. The quotas of all sources are split among the output shards by halves: each node draws how many blocks of
   each source go left from the multivariate hypergeometric distribution, with a generator keyed by seed and node.
5. Each source's blocks are numbered anew by a seeded bijection; shard k takes the next run of them, as many as its
   leaf says, so shards draw disjoint blocks. Within its shard a draw's place comes from a hash.

The driver holds one row for each source, and one number for each source and shard.
A source with most of the rows is cut into buckets of the hash for the running sums, so that no task holds a source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, col, free_name, partitions, words

WEIGHTS = (5, 2, 1)
#: Documents with more than this share of their source's words are drawn one by one.
LARGE = 1000
#: Words of one output shard where the mix does not set their number.
SHARD_WORDS = 64_000_000
#: Rows of one bucket of the running sums.
BUCKET_ROWS = 20_000


@dataclass(frozen=True)
class Mix:
    """What a mix asks for. ``volume``: words of the mix as a share of all words; ``repeat``: most uses of a document;
    ``shards``: by default as many as hold ``SHARD_WORDS`` words each."""

    weights: Sequence[float] = WEIGHTS
    volume: float = 1.5
    repeat: int = 2
    shards: int | None = None
    block_words: int = 4096
    seed: int = 42


def targets(sizes: Sequence[int], mix: Mix = Mix()) -> list[float]:
    """Target words of sources of these sizes, in their order."""
    cap = [float(mix.repeat * s) for s in sizes]
    weight = [float(mix.weights[i % len(mix.weights)]) for i in range(len(sizes))]
    left, open_, out = mix.volume * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weight[i] for i in open_)
        for i in open_:
            out[i] = left * weight[i] / total
        over = [i for i in open_ if out[i] > cap[i]]
        if not over:
            break
        for i in over:
            out[i] = cap[i]
            left -= cap[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def hypergeometric(rng: np.random.Generator, have: np.ndarray, take: int) -> np.ndarray:
    """How many of ``take`` blocks come from each source; beyond numpy's range, blocks are drawn in groups of equal size."""
    unit = 1 + int(have.sum()) // 900_000_000
    if unit == 1:
        return rng.multivariate_hypergeometric(have, take, method="marginals")
    whole = have // unit
    out = rng.multivariate_hypergeometric(whole, min(take // unit, int(whole.sum())), method="marginals") * unit
    for i in range(len(have)):  # what groups leave over: fewer blocks than a group for each source
        out[i] += min(int(have[i] - out[i]), take - int(out.sum()))
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each shard (shards x sources), from the quotas of all sources."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def part(node: int, lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid, total = (lo + hi) // 2, int(have.sum())
        rng = np.random.Generator(np.random.Philox(key=[seed, node]))
        left = hypergeometric(rng, have, total * (mid - lo) // (hi - lo))
        part(2 * node, lo, mid, left)
        part(2 * node + 1, mid, hi, have - left)

    if len(quotas):
        part(1, 0, shards, np.asarray(quotas, np.int64))
    return out


def _fits(pdf: pd.DataFrame) -> pd.DataFrame:
    """The large documents of one source, in the order of their hashes: which of them the rest takes."""
    left, taken = float(pdf["share"].iloc[0]), []
    pdf = pdf.sort_values(["hash", "doc_id", "size"], na_position="last", ignore_index=True)
    for size in pdf["size"]:
        taken.append(bool(size <= left))
        left -= size if taken[-1] else 0
    if left > pdf["small"].iloc[0] and not all(taken):  # more than small documents can fill up: one more, or one for another
        sizes, has = pdf["size"].to_numpy(), np.array(taken)
        out, ins = [-1, *np.flatnonzero(has)], np.flatnonzero(~has)
        gain = sizes[ins][:, None] - np.concatenate([[0], sizes[has]])[None, :]
        gain = np.where((gain <= left) & (gain > 0), gain, -1)
        a, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[a, b] > 0:
            taken[ins[a]] = True
            if b:
                taken[out[b]] = False
    place = list(np.cumsum(pdf["size"].to_numpy() * taken) - pdf["size"].to_numpy() * taken)
    pdf["extra"], pdf["extra_at"] = taken, place
    pdf["at"] = pdf["size"].cumsum() - pdf["size"]
    return pdf[["nr", "doc_id", "source", "size", "hash", "at", "extra", "extra_at"]]


def draws(docs: DataFrame, mix: Mix = Mix(), text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, hash, source_size, target, copies and shards.

    ``copies`` says how often the mix takes the document, ``shards`` lists the shard of each copy. Null text has size 0;
    a document without words belongs to as many passes as its source makes in full. Null is a source of its own, the
    last. Rows that are the same in key, source and text are drawn like any others. An empty table gives no rows.
    """
    meta = docs.select(col(key).cast("long").alias("doc_id"), col(source).cast("string").alias("source"), words(col(text).cast("string")).alias("size"), F.xxhash64(F.lit(mix.seed), col(key), col(source), col(text)).alias("hash"))
    meta = checkpointed(meta)
    spark = meta.sparkSession
    by = meta.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.max("size").alias("most"), F.min("size").alias("least"))
    found = sorted(by.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    goal = targets([r["words"] for r in found], mix)
    rows, n = [], sum(r["n"] for r in found)
    for i, (r, t) in enumerate(zip(found, goal)):
        passes = min(mix.repeat, int(t // r["words"])) if r["words"] else 0
        rest = t - passes * r["words"] if passes < mix.repeat else 0.0
        rows.append((i, r["source"], r["words"], t, passes, rest))
    of = spark.createDataFrame(rows, "nr int, of string, source_size long, target double, passes int, rest double")
    meta = meta.join(of, meta.source.eqNullSafe(of.of)).drop("of")

    bits = max(0, math.ceil(math.log2(max(1, n / BUCKET_ROWS))))
    large = F.col("size") * LARGE > F.col("source_size")
    high = meta.where(large)
    low = meta.where(~large).withColumn("bucket", F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long"))
    totals = low.groupBy("nr", "bucket").agg(F.sum("size").alias("w"))
    before = Window.partitionBy("nr").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("nr").alias("t_nr"), F.col("bucket").alias("t_bucket"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base"))

    ask = meta.groupBy("nr").agg(F.max("rest").alias("r"), F.sum(F.when(large, F.col("size")).otherwise(0)).alias("hw"), F.max("source_size").alias("sw"))
    ask = ask.select(F.col("nr").alias("a_nr"), F.when(F.col("sw") > 0, F.col("r") * F.col("hw") / F.col("sw")).otherwise(0.0).alias("share"), (F.col("sw") - F.col("hw")).alias("small"))
    high = high.join(ask, F.col("nr") == F.col("a_nr")).select("doc_id", "source", "size", "hash", "share", "small", "nr")
    high = checkpointed(high.groupBy("nr").applyInPandas(_fits, "nr int, doc_id long, source string, size long, hash long, at long, extra boolean, extra_at long"))
    got = high.groupBy("nr").agg(F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0)).alias("got"), F.sum("size").alias("large_words"))
    got = of.join(got, "nr", "left").select(F.col("nr").alias("g_nr"), F.coalesce("got", F.lit(0)).alias("got"), F.coalesce("large_words", F.lit(0)).alias("large_words"))

    within = Window.partitionBy("nr", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    low = low.withColumn("in_bucket", F.coalesce(F.sum("size").over(within), F.lit(0)))
    low = low.join(totals, (F.col("nr") == F.col("t_nr")) & (F.col("bucket") == F.col("t_bucket"))).join(got, F.col("nr") == F.col("g_nr"))
    at = F.col("base") + F.col("in_bucket")
    low = low.select(
        "nr", "doc_id", "source", "size", "hash", (F.col("large_words") + at).alias("at"),
        ((F.col("size") > 0) & (at + F.col("size") / 2 <= F.col("rest") - F.col("got"))).alias("extra"), (F.col("got") + at).alias("extra_at"),
    )
    every = low.unionByName(high.select(*low.columns)).join(of.drop("of"), "nr")
    copy = lambda c: F.floor((F.col("source_size") * c + F.when(c < F.col("passes"), F.col("at")).otherwise(F.col("extra_at"))) / mix.block_words)
    copies = F.col("passes") + F.col("extra").cast("int")
    every = checkpointed(every.withColumn("copies", copies).withColumn("blocks", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), copy)).otherwise(F.array().cast("array<bigint>"))))

    last = every.groupBy("nr").agg(F.max(F.array_max("blocks")).alias("last")).collect()
    quota = np.zeros(len(rows), np.int64)
    for r in last:
        quota[r["nr"]] = 0 if r["last"] is None else r["last"] + 1
    shards = mix.shards or max(1, math.ceil(int(quota.sum()) * mix.block_words / SHARD_WORDS))
    ends = np.cumsum(split_tree(quota, shards, mix.seed), axis=0).T if len(rows) else []
    leaf = []
    for i, q in enumerate(quota):
        rng = np.random.Generator(np.random.Philox(key=[mix.seed, (1 << 32) + i]))
        step = next(a for a in map(int, rng.integers(1, max(2, int(q)), 10_000)) if math.gcd(a, max(1, int(q))) == 1)
        leaf.append((i, int(max(1, q)), step, int(rng.integers(0, max(1, int(q)))), [int(x) for x in ends[i]]))
    leaf_of = spark.createDataFrame(leaf, "nr int, quota long, step long, shift long, ends array<long>")
    number = lambda b: (b * F.col("step") + F.col("shift")) % F.col("quota")
    shard = lambda b: F.size(F.filter("ends", lambda e: e <= number(b)))
    return every.join(leaf_of, "nr").select("doc_id", "source", "size", "hash", "source_size", "target", "copies", F.transform("blocks", shard).alias("shards"))


def mix_documents(docs: DataFrame, mix: Mix = Mix(), text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix: rows of ``docs`` as often as drawn, with all their columns, and ``shard`` and ``place`` in it.

    Rows come in ranges of (shard, place): a shard of any size is spread over as many partitions as its rows fill, and
    read in order it is in its shuffled order. Rows of ``docs`` that are the same in key,
    source and text are drawn as one document each, and any of them may stand for the others.
    """
    drawn = draws(docs, mix, text, key, source).where("copies > 0")
    drawn = drawn.select(F.col("hash").alias("d_hash"), F.col("doc_id").alias("d_id"), F.explode("shards").alias("d_shard"))
    row, at, hashed = free_name(docs, "row"), free_name(docs, "at"), free_name(docs, "hash")
    keyed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias(row), col(key).cast("long").alias(at), F.xxhash64(F.lit(mix.seed), col(key), col(source), col(text)).alias(hashed))
    keyed = keyed.dropDuplicates([hashed, at])
    out = keyed.join(drawn, (F.col(hashed) == F.col("d_hash")) & F.col(at).eqNullSafe(F.col("d_id")))
    shard, place = free_name(docs, "shard"), free_name(docs, "place")
    out = out.select(*[F.col(row).getField(c).alias(c) for c in docs.columns], F.col("d_shard").alias(shard), F.xxhash64(F.lit(mix.seed + 1), "d_hash", "d_id").alias(place))
    return out.repartitionByRange(partitions(docs), shard, place).sortWithinPartitions(shard, place)


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix with the columns of ``docs`` only, for a pipeline."""
    return mix_documents(docs, mix).select(*[col(c) for c in docs.columns])
