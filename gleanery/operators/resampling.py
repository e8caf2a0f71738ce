"""Resamples of a fixed size: multinomial weights from a deterministic splitting tree.

A resample of n units draws exactly n times, each unit with the same chance. The units of a group are dealt by hash into
ranges, and the n draws of a resample are split down a binary tree over the ranges: a node's left half gets a binomial
share of the node's draws, its right half the rest. A range then makes its own draws among its own units, so no group is
numbered, sorted or gathered, and a task holds one range and a few resamples. Binomial shares are counts of hashed coins
against the binary digits of the left half's share of the units, about two coins a draw. Draws within a range are a
polynomial of degree 3 with hashed coefficients, so any four of them are independent. Everything follows from hashes of
resample, node and place: reruns, other partitionings and other engines agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import md5
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bind
from ..sources.sinks import materialised
from ..sources.tables import hashed

#: Units of a range, on average at most, and resamples that a row holds.
RANGE, CHUNK = 512, 64
#: Binary digits that decide a draw's side; what is still undecided then goes right.
DIGITS = 32
#: The prime modulus of the draws, 2**31 - 1.
MODULUS = (1 << 31) - 1
#: Coins in a hash.
COINS = 32

_NOTHING = "array<bigint>"


def _upto(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast(_NOTHING))


def heads(n: int, key: str) -> int:
    """How many of n fair coins show heads; ``key`` names the coins. Coins are the binary digits of ``hashed(key, number)``."""
    if n <= 0:
        return 0
    start, last = f"{key}|".encode(), (n - 1) // COINS
    words = b"".join([md5(start + b"%d" % w).digest()[:4] for w in range(last + 1)])
    mask = (1 << (n - last * COINS)) - 1
    return int.from_bytes(words[:-4]).bit_count() + (int.from_bytes(words[-4:]) & mask).bit_count()


def binomial(d: int, part: int, whole: int, key: str) -> int:
    """How many of d draws fall into ``part`` of ``whole`` units."""
    if part <= 0 or part >= whole:
        return 0 if part <= 0 else d
    inside, rest = 0, part
    for i in range(1, DIGITS + 1):
        if d == 0:
            break
        h = heads(d, f"{key}|{i}")
        if rest * 2 >= whole:  # the next binary digit of part / whole; a draw whose own digit is smaller falls inside
            inside, d, rest = inside + d - h, h, rest * 2 - whole
        else:
            d, rest = d - h, rest * 2
    return inside


#: MD5: the additions and rotations of each step; the first word of the digest is settled three steps before the end.
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(61)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
#: Hashes that are made at once: what they work on stays in the cache.
AT_ONCE = 16384


def _first_words(blocks: np.ndarray) -> np.ndarray:
    """The first four bytes of the MD5 digests, as numbers, of padded messages of one block each (rows of 64 bytes)."""
    words = np.ascontiguousarray(blocks.view("<u4").T)
    used = words.any(axis=1)
    a, b, c, d = (np.full(len(blocks), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, g = np.empty_like(a), np.empty_like(a)
    for i, sine in enumerate(_SINES):
        if i < 16:  # a choice, written with one operation less: d ^ (b & (c ^ d))
            k = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += np.uint32(sine)
        if used[k]:
            f += words[k]
        turn = _TURNS[i // 16][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=g)
        f <<= np.uint32(turn)
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a  # the oldest word's memory is used again
    return (b + np.uint32(0x67452301)).byteswap()


def _heads(n: np.ndarray, keys: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``heads`` of many keys at once: rows of 64 bytes, of which ``size`` are the key and the bar behind it."""
    words = -(-n // COINS)
    ends = np.cumsum(words)
    out = np.zeros(len(n), np.int64)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
        place = np.arange(lo, min(lo + AT_ONCE, int(ends[-1])))
        of = np.searchsorted(ends, place, "right")
        w = place - (ends[of] - words[of])
        message, at, row = keys[of], size[of], np.arange(len(place))
        digits = np.ones(len(place), np.int64)
        ten = 10
        while ten <= w.max():
            digits += w >= ten
            ten *= 10
        for j in range(int(digits.max())):
            has = digits > j
            message[row[has], (at + digits - 1 - j)[has]] = 48 + w[has] // 10**j % 10
        end = at + digits
        message[row, end] = 0x80
        message[:, 56], message[:, 57] = end * 8 & 255, end * 8 >> 8
        found = _first_words(message)
        over = (w + 1) * COINS - n[of]  # coins of a key's last hash that it does not have
        found &= np.uint32(0xFFFFFFFF) >> np.maximum(over, 0).astype(np.uint32)
        first, last = int(of[0]), int(of[-1])
        out[first : last + 1] += np.bincount(of - first, np.bitwise_count(found), last - first + 1).astype(np.int64)
    return out


def binomials(d: np.ndarray, part: np.ndarray, whole: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """``binomial`` of many keys at once."""
    inside = np.where(part >= whole, d, 0)
    own = np.flatnonzero((part > 0) & (part < whole) & (d > 0))
    size = np.array([len(keys[i]) + 1 for i in own], np.int64)
    if len(own) and size.max() > 64 - 24:  # no room for both numbers and the padding
        inside[own] = [binomial(int(d[i]), int(part[i]), int(whole[i]), keys[i].decode()) for i in own]
        return inside
    start = np.array([keys[i] + b"|" for i in own], "S64").view(np.uint8).reshape(-1, 64)
    d, rest, whole = d[own].copy(), part[own].copy(), whole[own]
    for i in range(1, DIGITS + 1):
        open_ = (d > 0) & (rest > 0)  # without a rest, all other draws go right
        if not open_.all():
            own, size, start, d, rest, whole = (x[open_] for x in (own, size, start, d, rest, whole))
        if not len(own):
            break
        digit, row = b"%d|" % i, np.arange(len(own))
        message = start.copy()
        for j, byte in enumerate(digit):
            message[row, size + j] = byte
        h = _heads(d, message, size + len(digit))
        one = rest * 2 >= whole
        inside[own] += np.where(one, d - h, 0)
        d, rest = np.where(one, h, d - h), np.where(one, rest * 2 - whole, rest * 2)
    return inside


def _halved(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of nodes (node, m, left, draws) with ``low``, how many of each of their draws go to the left half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws, (m, left) = batch.column("draws"), (np.asarray(batch.column(c)) for c in ("m", "left"))
            row, node = np.asarray(draws.value_parent_indices()), batch.column("node").to_pylist()
            b, d = (np.asarray(draws.flatten().field(c)) for c in ("b", "d"))
            keys = [b"l|%d|%d|%d" % (level, node[r], k) for r, k in zip(row.tolist(), b.tolist())]
            low = binomials(d, left[row], m[row], keys)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.asarray(draws.value_lengths()))]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(low, pa.int64()))], [*batch.schema.names, "low"])

    return run


def _polynomials(node: list[int], draws: pa.ListArray) -> list[np.ndarray]:
    """For each range, the factors (rows) of the polynomials that make its draws in its resamples (columns)."""
    b, row = np.asarray(draws.flatten().field("b")), np.asarray(draws.value_parent_indices())
    keys = [b"p|%d|%d|%d" % (k, node[r], x) for k in range(4) for r, x in zip(row.tolist(), b.tolist())]
    size = np.array([len(key) for key in keys], np.int64)
    message, at = np.array(keys, "S64").view(np.uint8).reshape(-1, 64), np.arange(len(keys))
    message[at, size] = 0x80
    message[:, 56], message[:, 57] = size * 8 & 255, size * 8 >> 8
    found = [_first_words(message[k : k + AT_ONCE]) for k in range(0, len(keys), AT_ONCE)]
    factors = (np.concatenate(found or [np.zeros(0, np.uint32)]).astype(np.int64) % MODULUS).reshape(4, -1)
    return np.split(factors, np.cumsum(np.asarray(draws.value_lengths()))[:-1], axis=1)


def _times(factors: np.ndarray, units: int, d: np.ndarray) -> np.ndarray:
    """How often each of a range's units (columns) is drawn in each of some resamples (rows), which draw d times from it."""
    which = np.repeat(np.arange(len(d)), d)
    c, j = factors[:, which], np.arange(len(which)) - np.repeat(np.cumsum(d) - d, d)
    at = (((c[3] * j + c[2]) % MODULUS * j + c[1]) % MODULUS * j + c[0]) % MODULUS * units >> 31
    return np.bincount(which * units + at, minlength=len(d) * units).reshape(len(d), units)


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """For each row of ranges (node, held, draws): its batch, its place there, its resamples, and how often they draw its units."""
    for batch in batches:
        node, draws, held = batch.column("node").to_pylist(), batch.column("draws"), np.asarray(batch.column("held").value_lengths())
        for r, factors in enumerate(_polynomials(node, draws)):
            b, d = (np.asarray(draws[r].values.field(c)) for c in ("b", "d"))
            yield batch, r, b, _times(factors, int(held[r]), d)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges (node, held, draws), arrays n and s of their units in order, with both summed, place by place, over each of
    their draws."""
    for _, rows in groupby(_drawn(batches), key=lambda x: id(x[0])):
        sums: list[tuple[np.ndarray, ...]] = []
        for batch, r, b, w in rows:
            n, s = (np.asarray(batch.column("held")[r].values.field(c).flatten()).reshape(w.shape[1], -1) for c in "ns")
            w = w.astype(float)  # counts are whole numbers, so sums of n are exact
            total, bad = w @ s, ~np.isfinite(s).all(axis=0)
            if bad.any():  # a unit that is not drawn adds nothing, whatever it holds
                total[:, bad] = np.where(w[:, :, None] > 0, w[:, :, None] * s[:, bad][None], 0).sum(1)
            width = n.shape[1]
            sums.append((np.full(len(b) * width, r), np.repeat(b, width), np.tile(np.arange(width), len(b)), (w @ n.astype(float)).astype(np.int64).ravel(), total.ravel()))
        row, *out = (np.concatenate(x) for x in zip(*sums))
        own = [c for c in batch.schema.names if c not in ("node", "held", "draws")]
        columns = [batch.column(batch.schema.names.index(c)).take(pa.array(row)) for c in own]
        yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, out)], [*own, *"bins"])


def _changes(s: np.ndarray) -> np.ndarray:
    """Whether each of the sorted scores but the first differs from the one before; all that are no numbers are one score."""
    return (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges (cuts, node, held, chunk, draws), of units with arrays s and y: for each part of the scores that ``cuts``
    makes, the distinct (s, y) that fall there, and how often each of the resamples draws them, as bytes."""
    for batch, r, b, w in _drawn(batches):
        held, cuts = batch.column("held")[r].values, np.asarray(batch.column("cuts")[r].values, np.float64)
        unit = np.asarray(held.field("s").value_parent_indices())
        s, y = (np.asarray(held.field(c).flatten()) for c in "sy")
        order = np.lexsort((y, s))
        s, y, w = s[order], y[order], w[:, unit[order]]
        new = np.flatnonzero(np.r_[True, _changes(s) | (y[1:] != y[:-1])])
        s, y, w = s[new], y[new], np.add.reduceat(w, new, axis=1)
        part = np.searchsorted(cuts, s, "left")
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = np.r_[at, len(s)]
        own = [c for c in batch.schema.names if c not in ("cuts", "node", "held", "draws")]
        kinds = [np.min_scalar_type(int(w[:, i:j].max())) for i, j in zip(ends, ends[1:])]
        columns = [batch.column(batch.schema.names.index(c)).take(pa.array(np.full(len(at), r))) for c in own]
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (s, y)]
        bytes_ = pa.array([w[:, i:j].astype(kind).tobytes() for i, j, kind in zip(ends, ends[1:], kinds)], pa.binary())
        columns += [pa.array(part[at], pa.int32()), *lists, pa.array([kind.itemsize for kind in kinds], pa.int32()), bytes_]
        yield pa.RecordBatch.from_arrays(columns, [*own, "part", "s", "y", "width", "w"])


def _ranked(within: list[str], n_boot: int) -> Callable[[pa.Table], pa.Table]:
    """A part of the scores in a chunk of resamples: in each resample its draws, how many of them are positive, and the sum of the
    mean ranks of those, counted from the part's first."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        chunk = table.column("chunk")[0].as_py()
        b = np.arange(chunk * CHUNK, min((chunk + 1) * CHUNK, n_boot))
        s, y = (np.asarray(table.column(c).combine_chunks().flatten()) for c in "sy")
        w = np.concatenate([np.frombuffer(x, f"u{k}").reshape(len(b), -1).astype(np.int64) for x, k in zip(table.column("w").to_pylist(), table.column("width").to_pylist())], axis=1)
        order = np.argsort(s, kind="stable")
        s, y, w = s[order], y[order], w[:, order]
        new = np.flatnonzero(np.r_[True, _changes(s)])
        n, pos = np.add.reduceat(w, new, axis=1), np.add.reduceat(w * y, new, axis=1)
        ranks = (pos * (np.cumsum(n, axis=1) - n + (n + 1) / 2)).sum(axis=1)
        own = {c: pa.array([table.column(c)[0].as_py()] * len(b), table.schema.field(c).type) for c in (*within, "part")}
        return pa.table({**own, "b": b, "n": n.sum(axis=1), "pos": pos.sum(axis=1), "r": ranks})

    return run


def drawn_ranks(rows: DataFrame, within: list[str], unit: str, score: str, label: str, n_boot: int, cuts: DataFrame) -> DataFrame:
    """within, b, n, pos, r: the rows of each resample of each group's units, how many are positive (label 1, others have 0), and the
    sum of the mean ranks of those, by score, ties shared. Without null.

    ``cuts`` has within and ``cuts``, the ascending scores at which parts end. A range sends its draws to the parts as counts, one
    of each distinct score and label, and a task ranks one part in a chunk of resamples.
    """
    units = rows.groupBy(*within, F.col(unit).alias("_u")).agg(F.collect_list(F.struct(F.col(score).cast("double").alias("s"), F.col(label).cast("long").alias("y"))).alias("l"))
    units = units.select(*within, "_u", F.col("l.s").alias("s"), F.col("l.y").alias("y"), hashed(F.col("_u")).alias("_h"))
    ranges = drawn_ranges(materialised(units), within, n_boot)
    held = F.transform("held", lambda u: F.struct(u["s"].alias("s"), u["y"].alias("y"))).alias("held")
    got = ranges.join(F.broadcast(cuts), within).withColumn("chunk", F.shiftright(F.col("draws")[0]["b"], CHUNK.bit_length() - 1).cast("int")).select(*within, "chunk", "cuts", "node", held, "draws")
    own = [f for f in got.schema.fields if f.name in within]
    of = T.StructType([*own, T.StructField("chunk", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("y", T.ArrayType(T.LongType())), T.StructField("width", T.IntegerType()), T.StructField("w", T.BinaryType())])
    of_parts = T.StructType([*own, T.StructField("part", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("b", "n", "pos")], T.StructField("r", T.DoubleType())])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out by number, as rows are few and short for what they cost.
    ranked = got.mapInArrow(_weighed, of).repartition(parts, *within, "part", "chunk").groupBy(*within, "part", "chunk").applyInArrow(_ranked(within, n_boot), of_parts)
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*within, "b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.withColumn("r", F.col("r") + F.col("pos") * below)
    return ranked.groupBy(*within, "b").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("r").alias("r"))


def _places(d: Column, units: Column, node: Column, b: Column) -> Column:
    """d draws with replacement from the places 0 .. units - 1."""
    factors = F.array(*[hashed(F.lit("p"), F.lit(k), node, b) % MODULUS for k in range(4)])
    at = lambda c, j: (((c[3] * j + c[2]) % MODULUS * j + c[1]) % MODULUS * j + c[0]) % MODULUS
    return bind(factors, lambda c: F.transform(_upto(d), lambda j: F.shiftright(at(c, j) * units, 31).cast("int")))


def levels_of(most: int) -> int:
    """How deep the tree is when the largest group has ``most`` units."""
    return (max(1, -(-most // RANGE)) - 1).bit_length()


def drawn_ranges(units: DataFrame, within: list[str], n_boot: int) -> DataFrame:
    """within, node, held, chunk, draws of written ``units`` (within, _h below 2**32, _u, and what they carry): every range with its
    units in order, and the draws (b, d) that it gets in a chunk of resamples.

    Draws follow from the sizes of a group's ranges alone, so groups with the same sizes share one tree.
    """
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = units.groupBy(*within).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    levels = levels_of(most)
    node = F.shiftright(F.col("_h"), COINS - levels).alias("node")
    sizes = materialised(units.groupBy(*within, node).agg(F.count(F.lit(1)).alias("m")))
    shape = ["_x", "_y"]  # 128 bits that stand for a group's sizes
    groups = sizes.groupBy(*within).agg(*[F.bit_xor(F.xxhash64(F.lit(k), "node", "m")).alias(c) for k, c in enumerate(shape)])
    groups = materialised(groups)
    key = F.struct(*within)
    one = groups.groupBy(*shape).agg(F.min(key).alias("g")).select(*shape, *[F.col("g")[c].alias(c) for c in within])
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}")) for c in within]
    leaves = materialised(sizes.alias("s").join(one.alias("o"), same).select(*shape, "node", "m"))
    up = lambda level: leaves.groupBy(*shape, F.shiftright("node", levels - level).alias("node")).agg(F.sum("m").alias("m"))
    first = lambda k: F.transform(F.sequence(k * CHUNK, F.least(k * CHUNK + (CHUNK - 1), F.lit(n_boot - 1))), lambda b: F.struct(b.cast("long").alias("b"), F.col("m").alias("d")))
    chunks = F.transform(F.sequence(F.lit(0), F.lit((n_boot - 1) // CHUNK)), lambda k: F.struct(k.alias("chunk"), first(k).alias("draws")))
    # Few and short rows that are dear to compute: dealt out by number, or adaptive execution leaves them in one task.
    state = up(0).select(*shape, "node", "m", F.explode(chunks).alias("c")).select(*shape, "node", "m", "c.*").repartition(parts, *shape, "chunk")
    for level in range(levels):
        left = up(level + 1).where(F.col("node") % 2 == 0).select(*shape, F.shiftright("node", 1).alias("node"), F.col("m").alias("left"))
        state = state.join(left, [*shape, "node"], "left").withColumn("left", F.coalesce("left", F.lit(0).cast("long"))).repartition(parts, *shape, "node", "chunk")
        state = state.mapInArrow(_halved(level), T.StructType([*state.schema.fields, T.StructField("low", T.ArrayType(T.LongType()))]))
        low = F.zip_with("draws", "low", lambda x, n: F.struct(x["b"].alias("b"), n.alias("d")))
        rest = lambda y: F.zip_with("draws", y, lambda x, z: F.struct(x["b"].alias("b"), (x["d"] - z["d"]).alias("d")))
        kid = lambda n, m, x: F.struct((F.col("node") * 2 + n).alias("node"), m.alias("m"), x.alias("draws"))
        kids = bind(low, lambda y: F.array(kid(0, F.col("left"), y), kid(1, F.col("m") - F.col("left"), rest(y))))  # noqa: B023
        state = state.select(*shape, "chunk", F.explode(kids).alias("k")).select(*shape, "chunk", "k.*").where("m > 0")
    payload = [c for c in units.columns if c not in within]
    held = units.groupBy(*within, node).agg(F.array_sort(F.collect_list(F.struct("_h", "_u", *[c for c in payload if c not in ("_h", "_u")]))).alias("held"))
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"h.{c}")) for c in within]
    held = held.alias("h").join(groups.alias("g"), same).select("h.*", *shape)
    on = [*shape, "node"]
    if 1 << levels < 4 * parts:  # few ranges, so their resamples are dealt out too; many would only travel once for each chunk
        held = held.select("*", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // CHUNK))).alias("chunk"))
        on = [*on, "chunk"]
    state = state.select(*shape, "node", "chunk", "draws")
    return held.repartition(parts, *on).join(state.repartition(parts, *on), on).drop(*shape)


def _of(x: Column, node: Column, held: Column) -> Column:
    return _places(x["d"], F.size(held).cast("long"), node, x["b"])


def vector_sums(units: DataFrame, within: list[str], n_boot: int) -> DataFrame:
    """within, b, i, n, s: the sums of the i-th of n and of s over each resample of each group's ``units`` (within, _u, and arrays
    n and s, as long as each other in all units of a group, without null)."""
    ranges = drawn_ranges(materialised(units.withColumn("_h", hashed(F.col("_u")))), within, n_boot)
    rows = ranges.select(*within, "node", F.transform("held", lambda u: F.struct(u["n"].alias("n"), u["s"].alias("s"))).alias("held"), "draws")
    of = T.StructType([*[f for f in rows.schema.fields if f.name in within], *[T.StructField(c, T.LongType()) for c in "bin"], T.StructField("s", T.DoubleType())])
    return rows.mapInArrow(_summed, of).groupBy(*within, "b", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def drawn_sums(rows: DataFrame, within: list[str], unit: str, value: str, n_boot: int) -> DataFrame:
    """within, b, n, s: number and sum of the values in each resample of each group's units; rows of one unit are drawn together."""
    units = rows.groupBy(*within, F.col(unit).alias("_u")).agg(F.array(F.sum(F.col(value).cast("double"))).alias("s"), F.array(F.count(F.lit(1))).alias("n"))
    return vector_sums(units, within, n_boot).drop("i")


def draws(rows: DataFrame, unit: str, n_boot: int, within: list[str] = [], into: str = "w") -> DataFrame:  # noqa: B006
    """``rows`` with the resample ``b`` and a weight of 1, once for each time that it draws their unit.

    Each group ``within`` has as many draws in a resample as it has units; rows of one unit are drawn together.
    """
    by = within or ["_all"]
    every = rows if within else rows.withColumn("_all", F.lit(1))
    units = every.groupBy(*by, F.col(unit).alias("_u")).agg(F.collect_list(F.struct(*[F.col(c) for c in rows.columns])).alias("rows"))
    ranges = drawn_ranges(materialised(units.withColumn("_h", hashed(F.col("_u")))), by, n_boot)
    picked = ranges.select("held", "node", F.explode("draws").alias("x")).where("x.d > 0")
    picked = picked.select(F.col("x.b").alias("b"), F.explode(F.transform(_of(F.col("x"), F.col("node"), F.col("held")), lambda i: F.get("held", i)["rows"])).alias("rows"))
    return picked.select("b", F.explode("rows").alias("r")).select("r.*", "b", F.lit(1).alias(into))
