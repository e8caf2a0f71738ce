"""Hard negatives by distributed radix selection.

For every anchor and positive there is a window of scores. The kth best row of a window is found without sorting or
gathering the rows: integer histograms over the highest digit of the scores locate the bucket that holds it, histograms
over the next digit refine that bucket, and so on, over the digits of the ids where scores tie. What is found in the end
is the exact last place that qualifies; one more pass gathers only rows up to there.

Vectors are packed into shards and anchors into blocks. A pass brings the windows of every block of the stated anchors
to every shard, and computes the scores of both as products. Of a window's histogram a shard sends what its own k best
rows need, as the kth of all cannot be behind the kth of one shard: at most k buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, col, in_batches, partitions, released, tidy
from .packs import EXACT, numbers, packed_vectors, usable, vectors_of, whole

#: Vectors of a shard, anchors of a block, and anchors that are scored together within a task.
SHARD = 8192
BLOCK = 512
AT_ONCE = 128
#: Full blocks that are broadcast together.
SLICE = 32
#: Bits of a digit.
DIGIT = 8
#: Scores end here; those beyond count as the nearest of these.
FURTHEST = (1 << 62) - 1

WINDOW = ("block", "a", "p")
#: A window (block, number of the anchor, number of the positive): scores from lo to hi, ids from id_lo to id_hi where all scores
#: are equal, rows that it still needs, and the highest score it had.
STATE = "block string, a int, p int, top long, lo long, hi long, id_lo long, id_hi long, need int, same boolean, done boolean"


def rows_of(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """vec_id, label as text, v; rows with a null id, label or vector, or a null or non-finite component are left out."""
    rows = vectors.where(col(key).isNotNull() & col(label).isNotNull() & usable(col(vector)))
    return rows.select(col(key).cast("long").alias("vec_id"), col(label).cast("string").alias("label"), whole(col(vector), scale).alias("v"))


def _scores(x: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """Inner products as integers, one row for each of ``asks``."""
    if np.abs(x).max(initial=0) * np.abs(asks).max(initial=0) * max(1, x.shape[1]) < EXACT:
        return (asks @ x.T).astype(np.int64)
    exact = numbers(asks) @ numbers(x).T if x.shape[1] else np.zeros((len(asks), len(x)), object)
    return np.clip(exact, -FURTHEST, FURTHEST).astype(np.int64)


def shift_of(lo: int, hi: int) -> int:
    """How far a place in lo..hi is shifted to get its digit."""
    return max(0, (hi - lo).bit_length() - DIGIT)


def _pass(state: DataFrame, blocks: DataFrame, shards: DataFrame, slices: int, run, schema: str) -> DataFrame:
    """``run(shard row, block row)`` on every shard and every block of windows. Shards stay where they are; blocks are broadcast, a
    slice of about ``SLICE`` at a time, each once."""
    asked = state.groupBy("block").agg(F.collect_list(F.struct(*[F.col(c) for c in state.columns if c != "block"])).alias("windows"))
    asks = blocks.select(F.col("pack").alias("block"), F.col("n").alias("n_a"), F.col("dims").alias("dims_a"), F.col("x").alias("x_a"), F.col("vec_id").alias("ids_a"), F.col("label").alias("labels_a"))
    asks = asks.join(asked.hint("merge"), "block")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from run({name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)})

    out = None
    for k in range(slices):
        few = asks.where(F.pmod(F.xxhash64("block"), F.lit(slices)) == k)
        got = in_batches(shards.crossJoin(F.broadcast(few))).mapInArrow(tidy(each), schema)
        got = got if slices == 1 else checkpointed(got)  # one slice after the other
        out = got if out is None else out.unionByName(got)
    return out


def _windows(row: dict, upto: str) -> Iterator[tuple[dict, np.ndarray, np.ndarray, int]]:
    """Each window of a pair of shard and block: its state, the rows from its lowest score to ``upto``, all scores of its anchor, and
    the anchor's id."""
    get = lambda n: row[n].as_py()
    dims = max(get("dims"), get("dims_a"))
    x = vectors_of({n: get(n) for n in ("x", "n", "dims")}, dims)
    asks = vectors_of({"x": get("x_a"), "n": get("n_a"), "dims": get("dims_a")}, dims)
    ids, own = np.asarray(row["vec_id"].values), np.asarray(row["ids_a"].values)
    names, code = np.unique(np.asarray(row["label"].values.to_numpy(zero_copy_only=False), str), return_inverse=True)
    number = {n: k for k, n in enumerate(names)}
    mine = [number.get(n, -1) for n in row["labels_a"].as_py()]
    windows = sorted(get("windows"), key=lambda w: w["a"])
    first = np.searchsorted([w["a"] for w in windows], np.arange(0, len(asks) + AT_ONCE, AT_ONCE))
    for k, lo in enumerate(range(0, len(asks), AT_ONCE)):
        if first[k + 1] > first[k]:
            scores = _scores(x, asks[lo : lo + AT_ONCE])
            for w in windows[first[k] : first[k + 1]]:
                a = w["a"]
                score = scores[a - lo]
                inside = (code == mine[a]) & (ids != own[a]) if w["same"] else code != mine[a]
                yield w, np.flatnonzero(inside & (score >= w["lo"]) & (score <= w[upto])), score, int(own[a])


def _histograms(row: dict) -> Iterator[pa.RecordBatch]:
    """Windows' histograms of the next digit, from the best bucket on, as far as this shard's own rows matter."""
    ids, block = np.asarray(row["vec_id"].values), row["block"].as_py()
    out: dict[str, list] = {"a": [], "p": [], "bucket": [], "n": []}
    for w, inside, score, _ in _windows(row, "hi"):
        if w["lo"] < w["hi"]:
            digit = (w["hi"] - score[inside]) >> shift_of(w["lo"], w["hi"])
        else:  # all scores tie: by id
            inside = inside[(ids[inside] >= w["id_lo"]) & (ids[inside] <= w["id_hi"])]
            digit = ((ids[inside].astype(np.uint64) - np.uint64(w["id_lo"] & (1 << 64) - 1)) >> np.uint64(shift_of(w["id_lo"], w["id_hi"]))).astype(np.int64)
        n = np.bincount(digit)
        most = int(np.searchsorted(np.cumsum(n), w["need"])) + 1
        for b in np.flatnonzero(n[:most]):
            for c, v in (("a", w["a"]), ("p", w["p"]), ("bucket", int(b)), ("n", int(n[b]))):
                out[c].append(v)
    cells = [pa.array([block] * len(out["a"]), pa.string()), *[pa.array(out[c], pa.int64() if c == "n" else pa.int32()) for c in out]]
    yield pa.RecordBatch.from_arrays(cells, ["block", *out])


def refined(w: dict, counts: list[tuple[int, int]]) -> dict:
    """A window after one more digit; ``counts``: (bucket, rows) in order, complete up to the bucket of the last row that it needs."""
    before = 0
    for bucket, n in counts:
        if before + n >= w["need"]:
            break
        before += n
    else:  # fewer rows than it needs: all of them qualify
        return w | {"done": True}
    w = w | {"need": w["need"] - before}
    if w["lo"] < w["hi"]:
        shift = shift_of(w["lo"], w["hi"])
        hi = w["hi"] - (bucket << shift)
        w |= {"hi": hi, "lo": max(w["lo"], hi - (1 << shift) + 1)}
        return w | {"done": n == w["need"]}
    shift = shift_of(w["id_lo"], w["id_hi"])
    lo = w["id_lo"] + (bucket << shift)
    w |= {"id_lo": lo, "id_hi": min(w["id_hi"], lo + (1 << shift) - 1)}
    return w | {"done": n == w["need"] or w["id_lo"] == w["id_hi"]}


def selected(state: DataFrame, blocks: DataFrame, shards: DataFrame, slices: int, k: int) -> DataFrame:
    """Written once: block, a, p, anchor_id, rank, vec_id, score - the k best rows of each window, by score, then smaller id.

    Digits are refined until every window's last place is known; windows that are done take no part in later passes.
    """
    ended, state = [], checkpointed(state)
    fields = [f.name for f in state.schema.fields]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [refined({c: r[c] for c in fields}, [(x["bucket"], x["n"]) for x in r["counts"] or ()]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([batch.schema.field(c) for c in fields]))

    while not state.isEmpty():
        counts = _pass(state, blocks, shards, slices, _histograms, "block string, a int, p int, bucket int, n long")
        counts = counts.groupBy(*WINDOW, "bucket").agg(F.sum("n").alias("n"))
        counts = counts.groupBy(*WINDOW).agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("counts"))
        after = checkpointed(state.join(counts, [*WINDOW], "left").select(*fields, "counts").mapInArrow(tidy(step), STATE))
        released(state)
        ended.append(after)
        state = checkpointed(after.where(~F.col("done")))
    every = state  # without rows
    for t in ended:
        every = every.unionByName(t.where("done"))

    def gather(row: dict) -> Iterator[pa.RecordBatch]:
        ids, block = np.asarray(row["vec_id"].values), row["block"].as_py()
        out: list[tuple] = []
        for w, inside, score, own in _windows(row, "top"):
            inside = inside[(score[inside] > w["lo"]) | (ids[inside] <= w["id_hi"])]
            best = inside[np.lexsort((ids[inside], -score[inside]))[:k]]
            out += [(block, w["a"], w["p"], own, int(ids[r]), int(score[r])) for r in best]
        names = ["block", "a", "p", "anchor_id", "vec_id", "score"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names)

    found = _pass(every, blocks, shards, slices, gather, "block string, a int, p int, anchor_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy(*WINDOW).orderBy(F.desc("score"), "vec_id"))
    out = checkpointed(found.withColumn("rank", rank).where(F.col("rank") <= k).select(*WINDOW, "anchor_id", "rank", "vec_id", "score"))
    released(state, *ended)
    return out


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components x count as floor(scale * x), a score is the inner product with the anchor, the better is the higher, ties go
    to the smaller id. ``anchors`` says which rows are anchors. An anchor's positives are its best ``positives`` other
    rows of the same label. For each, the best ``negatives`` rows of different labels are returned whose score is from
    ``low`` to ``high`` percent of the positive's, with their rank; all, if there are fewer.

    Rows with a null id, label or vector, or with a null or non-finite component take no part. Of anchors with one id the
    smallest (label, vector) counts, and rows with its id are not its positives. Repeated rows are returned as often as
    they occur. Vectors of unlike length are compared as if padded with zeros; components of any size take part, in
    whole numbers, and scores beyond 62 bits count as the nearest of these. Other columns are ignored. Without anchors,
    positives, or rows within the windows there are no rows.
    """
    rows = rows_of(vectors, key, vector, label, scale)
    packed = packed_vectors(rows, SHARD, ["vec_id", "label"])
    shards = checkpointed(packed.repartition(partitions(vectors)))  # a file for each few of them, however few tasks packed them
    released(packed)
    asks = rows_of(vectors.where(F.coalesce(anchors, F.lit(False))), key, vector, label, scale)
    asks = asks.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v")
    blocks = packed_vectors(asks, BLOCK, ["vec_id", "label"])
    square = F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("square")
    facts, most = rows.agg(square, F.min("vec_id").alias("a"), F.max("vec_id").alias("b")).first(), asks.agg(square).first()["square"]
    furthest = min(FURTHEST, int(min(facts["square"] or 0, 1e300) ** 0.5 * min(most or 0, 1e300) ** 0.5 * 1.000001) + 2)  # Cauchy-Schwarz
    ids = (facts["a"] or 0, facts["b"] or 0)
    slices = max(1, math.ceil((blocks.agg(F.sum("n")).first()[0] or 0) / (SLICE * BLOCK)))
    fixed = [F.lit(ids[0]).cast("long").alias("id_lo"), F.lit(ids[1]).cast("long").alias("id_hi")]

    state = blocks.select(F.col("pack").alias("block"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("a"))
    state = state.select("block", "a", F.lit(0).alias("p"), F.lit(furthest).cast("long").alias("top"), F.lit(-furthest).cast("long").alias("lo"), F.lit(furthest).cast("long").alias("hi"), *fixed, F.lit(positives).alias("need"), F.lit(True).alias("same"), F.lit(False).alias("done"))
    best = selected(state, blocks, shards, slices, positives)

    share = lambda percent, up: F.expr(f"(score - pmod(score, 100)) div 100 * {percent} + (pmod(score, 100) * {percent} + {up}) div 100")
    lo, hi = share(low, 99), share(high, 0)
    state = best.select("block", "a", F.col("rank").alias("p"), hi.alias("top"), lo.alias("lo"), hi.alias("hi"), *fixed, F.lit(negatives).alias("need"), F.lit(False).alias("same"), F.lit(False).alias("done"))
    found = selected(state.where("lo <= hi"), blocks, shards, slices, negatives)
    of = best.select("block", "a", F.col("rank").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(of, [*WINDOW]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    released(shards, blocks)
    return out
