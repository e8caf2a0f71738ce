"""Centroid clustering by dual-tree Lloyd rounds, exact.

Vectors are packed into shards, and a cover tree is built over each shard once: the children of a node cover its points
within half its radius and keep more than that apart, down to points that coincide. Each round builds a tree over the
centroids and meets it with every shard's tree. Node pairs are pruned by bounds on distances: what a centroid node's
points can be nearest to, and what any of them certainly reaches. A vector node that one centroid alone is left for goes
to it as a whole; where single points meet several centroids, squared distances are compared exactly, as whole numbers.

Only sums and counts by centroid leave a round's tasks. The driver holds the centroids, whose number is a parameter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, col, in_batches, released, tidy
from .packs import EXACT, numbers, packed_vectors, usable, vectors_of, whole

#: Vectors of a shard, and node pairs whose distances are computed at once.
SHARD = 4096
AT_ONCE = 1 << 15
#: Components end here, and squared distances at the largest 64-bit number.
FURTHEST, LARGEST = EXACT, (1 << 63) - 1


class Tree:
    """A cover tree: nodes with a center (a row of ``x``), a radius, a range of ``order`` (their points) and children.

    Nodes are numbered so that the children of a node follow each other. A node of radius 0 is a leaf: its points coincide.
    """

    def __init__(self, center: np.ndarray, radius: np.ndarray, lo: np.ndarray, hi: np.ndarray, child: np.ndarray, children: np.ndarray, order: np.ndarray):
        self.center, self.radius, self.lo, self.hi, self.child, self.children, self.order = center, radius, lo, hi, child, children, order

    FIELDS = (("center", "<i4"), ("radius", "<f8"), ("lo", "<i4"), ("hi", "<i4"), ("child", "<i4"), ("children", "<i4"), ("order", "<i4"))

    def to_row(self) -> dict[str, bytes]:
        return {name: getattr(self, name).astype(kind).tobytes() for name, kind in self.FIELDS}

    @staticmethod
    def of_row(row: dict) -> Tree:
        return Tree(*[np.frombuffer(row[name], kind) for name, kind in Tree.FIELDS])

    @staticmethod
    def over(x: np.ndarray) -> Tree:
        """The cover tree over the rows of ``x``, level by level."""
        center, radius, lo, hi, child, children = ([] for _ in range(6))
        order = np.arange(len(x), dtype=np.int32)

        def add(c: int, a: int, away: np.ndarray) -> None:
            for list_, v in ((center, c), (radius, float(away.max(initial=0))), (lo, a), (hi, a + len(away)), (child, 0), (children, 0)):
                list_.append(v)

        if len(x):
            add(0, 0, np.sqrt(((x - x[0]) ** 2).sum(1)))
        node = 0
        while node < len(center):
            if radius[node] > 0:
                left, reach, at = order[lo[node] : hi[node]].copy(), radius[node] / 2, lo[node]
                child[node], c = len(center), center[node]
                while len(left):
                    away = np.sqrt(((x[left] - x[c]) ** 2).sum(1))
                    near = away <= reach
                    order[at : at + near.sum()] = left[near]
                    add(int(c), at, away[near])
                    at += int(near.sum())
                    left = left[~near]
                    c = left[0] if len(left) else 0
                children[node] = len(center) - child[node]
            node += 1
        return Tree(*[np.array(v, kind) for v, (_, kind) in zip((center, radius, lo, hi, child, children), Tree.FIELDS)], order)


def _expanded(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children first, first + 1, ... of each entry: (which entry, child)."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]


def nearest(tree: Tree, x: np.ndarray, over: Tree, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row of ``x``, the smaller number where distances tie."""
    out = np.zeros(len(x), np.int64)
    wide = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    exact = 4 * wide * wide * max(1, x.shape[1]) < EXACT
    q, r = np.zeros(min(1, len(x)), np.int64), np.zeros(min(1, len(x)), np.int64)  # pairs of nodes, by q
    while len(q):
        away = np.concatenate([np.sqrt(((x[tree.center[q[i : i + AT_ONCE]]] - centroids[over.center[r[i : i + AT_ONCE]]]) ** 2).sum(1)) for i in range(0, len(q), AT_ONCE)])
        slack = 1e-9 * (away + wide) + 1e-9
        spread = tree.radius[q] + over.radius[r]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        reached = np.repeat(np.minimum.reduceat(away + spread + slack, first), np.diff(np.append(first, len(q))))
        keep = away - spread - slack <= reached
        q, r = q[keep], r[keep]
        first, n = np.unique(q, return_index=True, return_counts=True)[1:]
        # centroid nodes that are as wide as the vector node give way to their children
        split = (over.children[r] > 0) & ((over.radius[r] >= tree.radius[q]) | (tree.children[q] == 0))
        whole_ = np.add.reduceat(split.astype(np.int64), first) == 0
        alone = whole_ & (n == 1) & (over.children[r[first]] == 0)
        for at in first[alone]:
            out[tree.order[tree.lo[q[at]] : tree.hi[q[at]]]] = over.center[r[at]]
        leaf = whole_ & ~alone & (tree.children[q[first]] == 0)
        if leaf.any():
            mine = np.repeat(leaf, n)
            _compared(out, tree, x, over, centroids, q[mine], r[mine], exact)
        rest = np.repeat(~alone & ~leaf, n)
        down = np.repeat(whole_, n)[rest]
        split, q, r = split[rest], q[rest], r[rest]
        to_r = np.flatnonzero(split)
        which, kids = _expanded(over.child[r[to_r]], over.children[r[to_r]])
        to_q = np.flatnonzero(down)
        which_q, kids_q = _expanded(tree.child[q[to_q]], tree.children[q[to_q]])
        same = ~split & ~down
        q, r = np.concatenate([q[to_r][which], kids_q, q[same]]), np.concatenate([kids, r[to_q][which_q], r[same]])
        by = np.lexsort((r, q))
        q, r = q[by], r[by]
    return out


def _compared(out: np.ndarray, tree: Tree, x: np.ndarray, over: Tree, centroids: np.ndarray, q: np.ndarray, r: np.ndarray, exact: bool) -> None:
    """Settle leaf pairs (q, r): coinciding points with single centroids, or with several that coincide."""
    which, place = _expanded(over.lo[r], over.hi[r] - over.lo[r])
    q, number = q[which], over.order[place].astype(np.int64)
    for a, b in _chunks(q):
        d = squared(x[tree.center[q[a:b]]], centroids[number[a:b]], exact)
        best = np.lexsort((number[a:b], d, q[a:b]))
        best = best[np.flatnonzero(np.diff(q[a:b][best], prepend=-1))]
        for at in a + best:
            out[tree.order[tree.lo[q[at]] : tree.hi[q[at]]]] = number[at]


def _chunks(q: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of pairs, without a cut within the pairs of one q."""
    a = 0
    while a < len(q):
        b = min(len(q), a + AT_ONCE)
        b = len(q) if b == len(q) else int(np.searchsorted(q, q[b - 1], "right"))
        yield a, b
        a = b


def squared(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Squared distances of rows, as whole numbers."""
    if exact:
        return ((a - b) ** 2).sum(1).astype(np.int64)
    return ((numbers(a) - numbers(b)) ** 2).sum(1) if a.shape[1] else np.zeros(len(a), np.int64)


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k rows with the smallest hashes of their ids, in that order; of rows with one id the smallest vector first."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.where("id is not null").select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in first], float)


def _shards(rows: DataFrame, dims: int) -> DataFrame:
    """Packed shards with their cover trees; written once."""
    packs = packed_vectors(rows, SHARD, ["id"])
    names = [name for name, _ in Tree.FIELDS]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("x", "n", "dims")}
                tree = Tree.over(vectors_of(row, dims)).to_row()
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column("id"), one.column("n"), one.column("dims"), one.column("x"), *[pa.array([tree[c]], pa.binary()) for c in names]], ["id", "n", "dims", "x", *names])

    kind = rows.schema["id"].dataType.simpleString()
    out = checkpointed(in_batches(packs).mapInArrow(tidy(build), f"id array<{kind}>, n int, dims int, x binary, {', '.join(f'`{c}` binary' for c in names)}"))
    released(packs)
    return out


def lloyd(shards: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: the componentwise floor of the mean of what is nearest; those that nothing is nearest to stay."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = Tree.over(centroids)
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            for row in batch.drop_columns(["id"]).to_pylist():
                x = vectors_of(row, dims)
                to = nearest(Tree.of_row(row), x, over, centroids)
                n += np.bincount(to, minlength=k)
                fits = np.abs(x).max(initial=0) * max(1, len(x)) < EXACT
                for c in np.unique(to):
                    part = x[to == c]
                    sums[c] += part.sum(0).astype(np.int64).astype(object) if fits else numbers(part).sum(0)
        at = np.argwhere(n > 0).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array([[str(v) for v in sums[c]] for c in at], pa.list_(pa.string()))], ["cluster", "n", "sums"])

    parts = in_batches(shards).mapInArrow(tidy(run), "cluster long, n long, sums array<string>")
    parts = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = centroids.copy()
    for r in parts.collect():
        out[r["cluster"], r["dim"]] = float(int(r["x"]) // r["n"])
    return out


def digest(centroid: np.ndarray) -> str:
    """sha256 of the components, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of each vector.

    Vectors with exactly ``dims`` components, none null or non-finite, take part, as whole numbers floor(scale * x). The
    first centroids are the ``k`` vectors whose ids have the smallest hashes; each of ``rounds`` rounds assigns every
    vector to the nearest centroid (the smaller number where distances tie) and moves centroids that have vectors to the
    componentwise floor of their mean. Then vectors are assigned once more. Inertias are sums of distances.

    With fewer than ``k`` vectors there are as many centroids. Rows with a null id take part, but do not start a cluster
    (without any other row there is no cluster and no result). Repeated rows count as often as they occur. The id has any
    type; other columns are ignored. Components of 2**53 or more after scaling count as 2**53, distances and inertias
    beyond 64 bits as the largest 64-bit number. An empty table gives no rows.
    """
    rows = vectors.where(usable(col(vector)) & (F.size(col(vector)) == dims))
    cut = lambda x: F.greatest(F.lit(-FURTHEST), F.least(F.lit(FURTHEST), x))
    rows = rows.select(col(key).alias("id"), F.transform(whole(col(vector), scale), cut).alias("v"))
    centroids = seeds(rows, k, seed)
    kind = rows.schema["id"].dataType.simpleString()
    if not len(centroids):
        rows = rows.where(F.lit(False)).limit(0)
        centroids = np.zeros((0, dims))
    shards = _shards(rows, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = lloyd(shards, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = Tree.over(centroids)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "id"}
                x = vectors_of(row, dims)
                to = nearest(Tree.of_row(row), x, over, centroids)
                exact = 4 * max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) ** 2 * max(1, dims) < EXACT
                away = [min(LARGEST, int(d)) for d in squared(x, centroids[to], exact)]
                yield pa.RecordBatch.from_arrays([batch.column("id")[i].values, pa.array(to.astype(np.int32)), pa.array(away, pa.int64())], ["vec_id", "cluster", "distance"])

    got = checkpointed(in_batches(shards).mapInArrow(tidy(run), f"vec_id {kind}, cluster int, distance long"))
    released(shards)
    each = got.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each centroid
    most = lambda s: min(LARGEST, int(s))
    total = most(sum(r["s"] for r in each))
    facts = [(r["cluster"], most(r["s"]), total, digest(centroids[r["cluster"]])) for r in each]
    table = got.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return got.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

