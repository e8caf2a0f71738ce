"""Suffix-array dedup: every byte of a long string that also starts anywhere else is removed.

``length`` bytes are the shortest string that counts as repeated. All of the work is on windows of that length.

1. Segments. A window's minimizer is the smallest hash of its ``SEED``-byte substrings, the leftmost of equal ones.
   Neighbouring windows whose minimizer stands at the same place form a segment, the bytes that they cover; equal windows
   have equal minimizers at equal offsets, wherever they stand. Segments are known by a 128-bit hash of their bytes, and
   of equal ones a count is all that is kept.
2. Shards. A minimizer that occurs in one segment only has no repeated window. The segments of the other minimizers - one
   copy of each - are dealt to shards by minimizer, so that equal windows meet.
3. Suffix arrays. Each shard joins its segments, sorts all suffixes by induced sorting, and computes permuted common
   prefixes; a window is repeated if it shares ``length`` bytes with a neighbour in the array, or if its segment has a
   copy. Shards are bounded: where a minimizer has more than ``HOT`` distinct segments (a passage in very many
   documents), its windows are parted by the offset of the minimizer in them, and regrouped by the bytes that all
   windows of a part share. A part of one offset is the window itself, so every group comes down to the bound.
4. Removal. Repeated runs go back to every place where their segment stands, meet in their document, and are cut out.

Texts are read twice and shuffled twice: to fetch the bytes of the segments in (2), and to cut in (4).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import Rolling, checkpointed, col, in_batches, partitions, pieces, tidy, tidy_group, utf8
from .suffix_array import permuted_prefixes, suffix_array

LENGTH = 400
SEED = 64
#: Distinct segments of one group from which it is parted.
HOT = 1000
#: Parts of a range of offsets.
WAYS = 4
#: Bytes of segments for each shard.
SHARD_BYTES = 1 << 20
#: Bytes of a long text that are looked at together.
STRIDE = 1 << 20


@lru_cache(1)
def _rolling() -> Rolling:
    return Rolling(3)


def _minima(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbouring numbers, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    block = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


_PLACE = np.uint64(21)


def segments(data: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of each segment of one text's bytes: minimizer, first window, number of windows, where the minimizer stands in the first."""
    n = len(data) - length + 1
    found: list[tuple] = []
    for lo in range(0, max(n, 0), STRIDE):  # a long text is cut into overlapping parts; a segment may be cut there too
        part = data[lo : min(len(data), lo + STRIDE + length - 1)]
        prefix, at = _rolling().prefix(part), np.arange(len(part) - seed + 1)
        hashes = _rolling().between(prefix, at, at + seed)
        placed = hashes >> _PLACE << _PLACE | at.astype(np.uint64)  # the leftmost of equal hashes is the smallest
        least = _minima(placed, length - seed + 1)
        start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        place = (least[start] & np.uint64((1 << 21) - 1)).astype(np.int64)
        found.append((hashes[place], start + lo, np.diff(np.append(start, len(least))), place - start))
    if not found:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _digests(parts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of byte strings as two columns of numbers."""
    both = np.frombuffer(b"".join(map(xxh3_128_digest, parts)), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _name(raw: Column) -> Column:
    return F.xxhash64(raw)


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """id and hash, which name a document, and raw, its text; documents that are the same in both are one."""
    raw = F.coalesce(col(text).cast("string"), F.lit(""))
    return docs.select(col(key).cast("long").alias("id"), _name(raw).alias("hash"), raw.alias("raw"))


def _found(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """Segments of all documents: minimizer, d1 and d2 (the digest), id, hash, start, windows, off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            for i, j in pieces(at, 1 << 23):
                parts = [(r, *segments(data[at[r] : at[r + 1]], length, seed)) for r in range(i, j) if at[r + 1] - at[r] >= length]
                if not parts:
                    continue
                row = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
                m, s, w, o = (np.concatenate([p[k] for p in parts]) for k in range(1, 5))
                first = (at[row] + s).tolist()
                raw = memoryview(data)
                d1, d2 = _digests(raw[x : x + n + length - 1] for x, n in zip(first, w.tolist()))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int64)), pa.array(d1), pa.array(d2), batch.column(0).take(take), batch.column(1).take(take), pa.array(s), *(pa.array(x.astype(np.int32)) for x in (w, o))], _FOUND)

    return in_batches(rows).mapInArrow(tidy(run), "minimizer long, d1 long, d2 long, id long, hash long, start long, windows int, off int")


_FOUND = ["minimizer", "d1", "d2", "id", "hash", "start", "windows", "off"]
_PIECE = ["k1", "k2", "d1", "d2", "copies", "off", "data"]
_PIECE_SQL = "k1 long, k2 long, d1 long, d2 long, copies long, off int, data binary"


def _bytes_of(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of segments (minimizer, d1, d2, copies, id, hash, start, windows, off), grouped by minimizer (k1)."""
    lists = wanted.groupBy("id", "hash").agg(F.collect_list(F.struct("minimizer", "d1", "d2", "copies", "off", "start", "windows")).alias("want"))
    lists = lists.select(F.col("id").alias("w_id"), F.col("hash").alias("w_hash"), "want")
    one = rows.join(lists, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("hash") == F.col("w_hash"))).select("raw", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, want in zip(batch.column(0), batch.column(1)):
                data = raw.as_py().encode()
                ask = want.as_py()
                m, d1, d2, c, o = ([a[k] for a in ask] for k in ("minimizer", "d1", "d2", "copies", "off"))
                cut = [data[a["start"] : a["start"] + a["windows"] + length - 1] for a in ask]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((m, [0] * len(m), d1, d2, c, o, cut), kinds)], _PIECE)

    return one.mapInArrow(tidy(run), _PIECE_SQL)


def parted(off: int, windows: int, low: int, high: int, ways: int = WAYS) -> list[tuple[int, int, int, int]]:
    """A piece's windows in ``ways`` parts, as (first window, windows, lowest offset, highest offset).

    Window i has its minimizer at ``off - i``, and all offsets lie in [low, high], which is cut evenly.
    """
    edges = sorted({low + (high - low + 1) * k // ways for k in range(ways + 1)}, reverse=True)
    out = []
    for top, bottom in zip(edges, edges[1:]):  # offsets [bottom, top)
        first, past = max(0, off - top + 1), min(windows, off - bottom + 1)
        if past > first:
            out.append((first, past - first, bottom, top - 1))
    return out


def _regrouped(hot: DataFrame, length: int) -> DataFrame:
    """Parts of hot pieces: a piece by the bytes that all windows of its part share, of which piece (o1, o2) it is from which
    window (shift), with the part's range of offsets (low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k1, d1, d2, copies, off, data, low, high in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7, 8))):
                for first, n, lo, hi in parted(off, len(data) - length + 1, low, high):
                    cut, at = data[first : first + n + length - 1], off - first  # the minimizer stands at ``at`` in the part
                    shared = cut[at - lo : at + length - hi]
                    head = b"%d %d %d " % (k1, lo, hi)
                    key, name = (np.frombuffer(xxh3_128_digest(head + x), "<i8").tolist() for x in (shared, b"piece " + cut))
                    out.append((*key, *name, copies, at, cut, lo, hi, d1, d2, first))
            kinds = (*[pa.int64()] * 5, pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            cols = list(zip(*out)) if out else [()] * 12
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], [*_PIECE, "low", "high", "o1", "o2", "shift"])

    return hot.select(*_PIECE, "low", "high").mapInArrow(tidy(run), f"{_PIECE_SQL}, low int, high int, o1 long, o2 long, shift int")


def _resolved(hot: DataFrame, length: int, seed: int, shards: int, most: int) -> DataFrame:
    """Runs (d1, d2, lo, hi) of repeated windows of hot pieces, through the suffix arrays of groups that are small enough.

    Each round parts what the one before it left too large; a range of 337 offsets is down to single ones after five.
    """
    levels: list[tuple[DataFrame, DataFrame]] = []
    hot = hot.withColumns({"low": F.lit(0), "high": F.lit(length - seed)})
    while True:
        parts = checkpointed(_regrouped(hot, length))
        one = parts.groupBy("k1", "k2", "d1", "d2").agg(F.sum("copies").alias("all"), F.min(F.struct("o1", "o2", "shift")).alias("of"))
        group = one.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.sum("all").alias("total")).where("total > 1")  # others repeat nothing
        kept = checkpointed(one.join(group, ["k1", "k2"]).select("d1", "d2", "all", "of.*", (F.col("n") > most).alias("big")))
        whole = parts.join(kept, ["d1", "d2", "o1", "o2", "shift"]).drop("copies").withColumnRenamed("all", "copies")
        levels.append((parts, _runs(whole.where("not big").select(*_PIECE), length, shards)))
        if kept.where("big").isEmpty():
            break
        hot = checkpointed(whole.where("big").select(*_PIECE, "low", "high"))
    parts, runs = levels.pop()
    runs = _placed(runs, parts)
    while levels:
        parts, found = levels.pop()
        runs = _placed(found.unionByName(runs), parts)
    return runs


def _placed(runs: DataFrame, parts: DataFrame) -> DataFrame:
    """Runs of parts as runs of the pieces that they are parts of."""
    back = runs.join(parts.select("d1", "d2", "o1", "o2", "shift"), ["d1", "d2"])
    return back.select(F.col("o1").alias("d1"), F.col("o2").alias("d2"), (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi"))


def _runs(taken: DataFrame, length: int, shards: int) -> DataFrame:
    """Runs (d1, d2, lo, hi) of repeated windows, by shards of whole groups."""
    dealt = taken.withColumn("shard", F.pmod(F.xxhash64("k1", "k2"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(tidy_group(_shard(length)), "d1 long, d2 long, lo long, hi long")


def _shard(length: int):
    """For a shard: runs [lo, hi) of repeated windows of its pieces."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("k1", "ascending"), ("k2", "ascending"), ("d1", "ascending"), ("d2", "ascending")])
        k1, k2, d1, d2, copies = (np.asarray(table.column(c)) for c in ("k1", "k2", "d1", "d2", "copies"))
        opens = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) if len(k1) else np.zeros(0, bool)
        parts = [x.as_py() for x in table.column("data")]
        kept: list[tuple[int, np.ndarray]] = []
        group: list[int] = []

        def flush() -> None:
            flags = repeated_windows([parts[g] for g in group], length)
            kept.extend((g, f | (copies[g] > 1)) for g, f in zip(group, flags))
            group.clear()

        size = 0
        for g in range(len(parts)):
            if size > SHARD_BYTES and opens[g]:
                flush()
                size = 0
            group.append(g)
            size += len(parts[g])
        if group:
            flush()
        out: list[tuple[int, int, int, int]] = []
        for g, flag in kept:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
            out += [(d1[g], d2[g], lo, hi) for lo, hi in zip(edge[::2], edge[1::2])]
        return pa.table({n: pa.array([int(o[k]) for o in out], pa.int64()) for k, n in enumerate(("d1", "d2", "lo", "hi"))})

    return run


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each byte string, which of its windows occur more than once among all of them."""
    sizes = [len(p) for p in parts]
    text = np.full(sum(sizes) + len(parts) + 1, 1, np.int64)
    starts = np.cumsum([0, *(s + 1 for s in sizes)])
    for p, at in zip(parts, starts):
        text[at : at + len(p)] = np.frombuffer(p, np.uint8).astype(np.int64) + 2
    text[-1] = 0
    array = suffix_array(text)
    shared = permuted_prefixes(text, array)
    long = shared >= length
    long[array[:-1][shared[array[1:]] >= length]] = True
    return [long[at : at + max(0, s - length + 1)] for s, at in zip(sizes, starts)]


def repeated_runs(docs: DataFrame, length: int = LENGTH, seed: int = SEED, text: str = "text", key: str = "doc_id", hot: int = HOT) -> DataFrame:
    """id, hash (which name a document) and spans: its bytes [lo, hi) under repeated windows, by segment, unmerged."""
    rows = _rows(docs, text, key)
    found = checkpointed(_found(rows, length, seed))
    one = found.groupBy("minimizer", "d1", "d2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "hash", "start", "windows", "off")).alias("p"))
    group = one.groupBy("minimizer").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("all")).where(F.col("all") > 1)
    wanted = checkpointed(one.join(group, "minimizer").select("minimizer", "d1", "d2", "copies", (F.col("n") > hot).alias("hot"), "p.*"))
    size = wanted.agg(F.coalesce(F.sum(F.col("windows") + (length - 1)), F.lit(0)).alias("n")).first()["n"]
    shards = max(partitions(docs), -(-size // (4 * SHARD_BYTES)))
    runs = _runs(_bytes_of(rows, wanted.where("not hot"), length), length, shards)
    many = wanted.where("hot")
    if not many.isEmpty():
        runs = runs.unionByName(_resolved(_bytes_of(rows, many, length), length, seed, shards, hot))
    runs = runs.groupBy("d1", "d2").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    place = found.join(runs, ["d1", "d2"])
    spans = F.transform("runs", lambda r: F.struct((r["lo"] + F.col("start")).alias("lo"), (r["hi"] + F.col("start") + (length - 1)).alias("hi")))
    return place.select("id", "hash", spans.alias("s")).groupBy("id", "hash").agg(F.flatten(F.collect_list("s")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, text: str = "text", key: str = "doc_id", hot: int = HOT) -> DataFrame:
    """doc_id, spans (maximal removed byte runs [lo, hi)), n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256.

    Null text counts as empty. Strings are judged on the input and do not cross documents. Rows that are the same in key
    and text are different documents, whose whole text is repeated; a row with a null key is a document like others.
    What is left need not be valid UTF-8, as strings start at any byte. Texts shorter than ``length`` stay whole.
    ``hot``: distinct segments of a group from which it is parted; it changes nothing in the result.
    """
    runs = repeated_runs(docs, length, seed, text, key, hot).select(F.col("id").alias("r_id"), F.col("hash").alias("r_hash"), "spans")
    rows = _rows(docs, text, key)
    rows = rows.join(runs, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("hash") == F.col("r_hash")), "left").select("id", "raw", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for raw, spans in zip(batch.column(1), batch.column(2)):
                data, cut = raw.as_py().encode(), merged([(s["lo"], s["hi"]) for s in spans.as_py() or ()])
                left = b"".join(data[a:b] for a, b in zip([0, *(hi for _, hi in cut)], [*(lo for lo, _ in cut), len(data)]))
                out.append(([{"lo": lo, "hi": hi} for lo, hi in cut], len(data), len(data) - len(left), len(cut), left, hashlib.sha256(left).hexdigest()))
            spans, *rest = zip(*out) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), *(pa.array(x, k) for x, k in zip(rest, kinds))], ["doc_id", "spans", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return rows.mapInArrow(tidy(run), "doc_id long, spans array<struct<lo:long,hi:long>>, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
