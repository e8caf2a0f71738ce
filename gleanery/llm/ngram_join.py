"""N-gram Jaccard join by vertical partitioning, exact at its threshold.

Words are lower-cased (A-Z) and split at white space; a document's set is its distinct n-word shingles, as 64-bit hashes.

1. Classes. Documents with the same set are one class, known by a hash of the set. Each task sends a class once.
2. Vertical fragments. The order of all shingles is cut into fragments; a class's set falls into one segment for each.
   A fragment sees every occurrence of its shingles: those of a single class are dropped (they can be part of no
   overlap), the others are sent back to their classes with the number of classes that have them.
3. Order and prefix. A class orders its shingles by that number, rarest first. Of n shingles, all but the last
   ceil(threshold * n) - 1 are its prefix, and two classes that link share a shingle of both prefixes. A class whose
   prefix holds only shingles of its own links with nothing; most documents end here.
4. Overlaps. Pairs are verified in fragments: partial overlaps of their segments are counted apart and summed for each
   pair. First each class meets a centre that it shares a MinHash with - the class with the fewest shingles of its own,
   such as the original of its copies. Only links between different components matter for the components, so after
   that only pairs of different components that share a prefix shingle, and whose sizes and positions allow it, remain;
   all of them are verified, with no cap. A group of n near copies so takes about n verifications, not n squared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_BYTES, Rolling, checkpointed, col, in_batches, mix, partitions, pieces, tidy, tidy_group, utf8
from .components import components

WORDS = 5
#: Threshold as a share of the union, in percent.
PERCENT = 75
#: MinHashes by which classes find a centre.
SKETCH = 8
#: Vertical fragments in which overlaps of pairs are counted.
OVERLAP_FRAGMENTS = 4
#: Shingles that a task gathers before it sends them, and text bytes for each fragment.
GATHER = 1_000_000
FRAGMENT_BYTES = 16_000_000
#: Bytes of a long text that are hashed at once.
LONG = 1 << 21

_LOW = np.uint64((1 << 48) - 1)


class Shingler:
    """Hashes of the distinct n-word shingles of texts in UTF-8."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.rolling = Rolling(20_241, fold=True)
        rng = np.random.Generator(np.random.Philox(5))
        self.factors = rng.integers(0, 1 << 63, max(64, words), np.uint64) * np.uint64(2) + np.uint64(1)

    def word_hashes(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each word, and where each row's words begin; ``at``: row offsets into ``data``."""
        blank = SPACE_BYTES[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = blank[1:] | blank[:-1]
        inner = at[(at > 0) & (at < len(data))]
        edge[inner] = True
        spot = np.flatnonzero(edge)
        start, end = spot[:-1], spot[1:]
        keep = ~blank[start] if len(data) else np.zeros(0, bool)
        start, end = start[keep], end[keep]
        return self.rolling.between(self.rolling.prefix(data), start, end), np.searchsorted(start, at)

    def sets(self, data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """The sorted set of each row."""
        w = self.words
        for i, j in pieces(at):
            part, offsets = data[at[i] : at[j]], at[i : j + 1] - at[i]
            if len(part) > LONG:  # one long row, in runs that end at white space
                found, lo = [], 0
                while lo < len(part):
                    hi = min(len(part), lo + LONG)
                    while hi < len(part) and not SPACE_BYTES[part[hi]]:
                        hi += 1
                    found.append(self.word_hashes(part[lo:hi], np.array([0, hi - lo]))[0])
                    lo = hi
                hashes, first = np.concatenate(found), np.array([0, sum(map(len, found))])
            else:
                hashes, first = self.word_hashes(part, offsets)
            grams = np.zeros(max(0, len(hashes) - w + 1), np.uint64)
            for k in range(w):
                grams += hashes[k : k + len(grams)] * self.factors[k]
            grams = mix(grams)
            for a, b in zip(first[:-1], first[1:]):
                if b - a >= w:
                    yield np.unique(grams[a : b - w + 1])
                elif b > a:
                    yield mix(np.array([(hashes[a:b] * self.factors[: b - a]).sum() + np.uint64(b - a)]))
                else:
                    yield grams[:0]


def set_hash(grams: np.ndarray) -> int:
    """A hash of a set, as a signed number."""
    return int(mix(np.array([mix(grams + np.uint64(0x9E3779B97F4A7C15)).sum() + np.uint64(len(grams))]))[0].astype(np.int64))


def shingle_sets(docs: DataFrame, words: int = WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, and the class of each row (null where the set is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            n, classes = [], []
            for grams in shingler.sets(*utf8(batch.column(1))):
                n.append(len(grams))
                classes.append(set_hash(grams) if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(classes, pa.int64())], ["doc_id", "n_shingles", "class"])

    rows = docs.select(col(key).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    return in_batches(rows).mapInArrow(tidy(run), "doc_id long, n_shingles long, class long")


def _six(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _segments(docs: DataFrame, words: int, text: str, fragments: int) -> DataFrame:
    """Packed segments of classes for each fragment: class hashes, set sizes, segment lengths and shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sent = Shingler(words), set()
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            size = np.array([len(g) for _, g in held])
            grams = np.concatenate([g for _, g in held])
            part = ((grams >> np.uint64(48)) * np.uint64(fragments)) >> np.uint64(16)
            owner = np.repeat(np.arange(len(held)), size)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(fragments + 1).astype(np.uint64))
            ids = np.array([c for c, _ in held], np.int64)
            out: dict[str, list] = {n: [] for n in ("fragment", "classes", "sizes", "counts", "grams")}
            for f, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
                if hi > lo:
                    own = owner[order[lo:hi]]
                    first = np.flatnonzero(np.diff(own, prepend=-1))
                    for n, v in (("fragment", f), ("classes", ids[own[first]].tobytes()), ("sizes", size[own[first]].astype("<u4").tobytes()), ("counts", np.diff(np.append(first, hi - lo)).astype("<u4").tobytes()), ("grams", _six(grams[order[lo:hi]]))):
                        out[n].append(v)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out["fragment"], pa.int32()), *(pa.array(out[n], pa.binary()) for n in ("classes", "sizes", "counts", "grams"))], list(out))

        total = 0
        for batch in batches:
            for grams in shingler.sets(*utf8(batch.column(0))):
                if len(grams) and (c := set_hash(grams)) not in sent:
                    if len(sent) >= 200_000:
                        sent.clear()
                    sent.add(c)
                    held.append((c, grams))
                    total += len(grams)
                    if total >= GATHER:
                        yield flush()
                        total = 0
        if held:
            yield flush()

    return in_batches(docs).select(col(text).cast("string").alias("text")).mapInArrow(tidy(run), "fragment int, classes binary, sizes binary, counts binary, grams binary")


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes, sizes, counts and shingles of packed rows, each class's first segment only."""
    take = lambda n, kind: np.frombuffer(b"".join(x.as_py() for x in table.column(n)), kind)
    classes, sizes, counts = take("classes", "<i8"), take("sizes", "<u4"), take("counts", "<u4").astype(np.int64)
    grams = np.concatenate([_from_six(x.as_py()) for x in table.column("grams")])
    _, first = np.unique(classes, return_index=True)
    keep = np.zeros(len(classes), bool)
    keep[first] = True
    return classes[keep], sizes[keep].astype(np.int64), counts[keep], grams[np.repeat(keep, counts)]


def _shared(buckets: int):
    """For a fragment: the shingles that several classes have, packed for buckets of classes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        classes, sizes, counts, grams = _unpacked(table)
        order = np.argsort(grams)
        starts = np.flatnonzero(np.diff(grams[order], prepend=grams[order[:1]] ^ np.uint64(1)))
        n = np.diff(np.append(starts, len(grams)))
        found = np.zeros(len(grams), np.int64)
        found[order] = np.repeat(n, n)
        owner = np.repeat(np.arange(len(classes)), counts)
        keep = found > 1
        owner, grams, found = owner[keep], grams[keep], np.minimum(found[keep], 65_535)
        bucket = (mix(classes.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)[owner]
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out: dict[str, list] = {c: [] for c in ("bucket", "fragment", "classes", "sizes", "counts", "grams", "found")}
        for b, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
            if hi > lo:
                at = order[lo:hi]
                first = np.flatnonzero(np.diff(owner[at], prepend=-1))
                own = owner[at[first]]
                for c, v in (("bucket", b), ("fragment", key[0].as_py()), ("classes", classes[own].tobytes()), ("sizes", sizes[own].astype("<u4").tobytes()), ("counts", np.diff(np.append(first, hi - lo)).astype("<u4").tobytes()), ("grams", _six(grams[at])), ("found", found[at].astype("<u2").tobytes())):
                    out[c].append(v)
        return pa.table([pa.array(out[c], pa.int32() if c in ("bucket", "fragment") else pa.binary()) for c in out], list(out))

    return run


def _active(percent: int):
    """For a bucket: the classes that may link, with their shared shingles in order."""

    def run(table: pa.Table) -> pa.Table:
        cls, size, gram, found = [], [], [], []
        for r in range(table.num_rows):
            get = lambda n, kind: np.frombuffer(table.column(n)[r].as_py(), kind)  # noqa: B023, E731
            counts = get("counts", "<u4")
            cls.append(np.repeat(get("classes", "<i8"), counts))
            size.append(np.repeat(get("sizes", "<u4"), counts))
            gram.append(_from_six(table.column("grams")[r].as_py()) & _LOW | np.uint64(table.column("fragment")[r].as_py()) << np.uint64(48))
            found.append(get("found", "<u2"))
        cls, size, gram, found = map(np.concatenate, (cls, size, gram, found))
        _, first, inverse, have = np.unique(cls, return_index=True, return_inverse=True, return_counts=True)
        n = size[first].astype(np.int64)
        least = -(-percent * n // 100)  # an overlap of fewer than this links with nothing
        keep = (have >= least)[inverse]
        if not keep.any():
            return _ACTIVE.empty_table()
        cls, gram, found = cls[keep], gram[keep], found[keep]
        order = np.lexsort((gram, found, cls))
        cls, gram = cls[order], gram[order]
        ids, at, have = np.unique(cls, return_index=True, return_counts=True)
        n = size[keep][order][at].astype(np.int64)
        least = -(-percent * n // 100)
        keys = [np.minimum.reduceat(mix(gram ^ np.uint64(0xA24BAED4963EE407 * (k + 1) & (1 << 64) - 1)), at).astype(np.int64) for k in range(SKETCH)]
        ends = np.append(at, len(gram)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(gram.astype(np.int64)))
        sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * SKETCH), pa.array(np.stack(keys, 1).ravel()))
        return pa.table([pa.array(ids), pa.array(n), pa.array(n - have), pa.array(have - least + 1), sketch, lists], schema=_ACTIVE)

    return run


_ACTIVE = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("prefix", pa.int64()), ("keys", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64()))])
_ACTIVE_SQL = "class long, n long, own long, prefix long, keys array<long>, grams array<long>"


def _verified(pairs: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those that link; partial overlaps are counted by fragment and summed."""
    part = lambda f: F.filter("grams", lambda g: F.pmod(g, F.lit(OVERLAP_FRAGMENTS)) == f)
    pieces_ = active.select("class", "n", F.posexplode(F.array(*[part(f) for f in range(OVERLAP_FRAGMENTS)])).alias("f", "part"))
    left = pieces_.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("f"), F.col("part").alias("part_a"))
    right = pieces_.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("f"), F.col("part").alias("part_b"))
    both = pairs.join(left, "a").join(right, ["b", "f"])
    both = both.groupBy("a", "b", "n_a", "n_b").agg(F.sum(F.size(F.array_intersect("part_a", "part_b"))).alias("common"))
    return both.where(F.col("common") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def class_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """node and root: components of the classes that link with another; a class is a hash of a shingle set.

    Links of equal sets are no links here, as they share a class. Texts without words, and classes that link with no
    other, are left out.
    """
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(col(text).cast("string"))), F.lit(0)).alias("n")).first()["n"]
    fragments = min(65_536, max(partitions(docs), math.ceil(n_bytes / FRAGMENT_BYTES)))
    shared = _segments(docs, words, text, fragments).groupBy("fragment").applyInArrow(tidy_group(_shared(fragments)), "bucket int, fragment int, classes binary, sizes binary, counts binary, grams binary, found binary")
    active = checkpointed(shared.groupBy("bucket").applyInArrow(tidy_group(_active(percent)), _ACTIVE_SQL))

    sketch = active.select("class", "own", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(SKETCH - 1)).alias("k"), F.col("keys").alias("v"))).alias("at"))
    centre = sketch.groupBy("at").agg(F.min(F.struct("own", "class")).alias("c"), F.count(F.lit(1)).alias("many")).where("many > 1").select("at", F.col("c.class").alias("b"))
    votes = sketch.select(F.col("class").alias("a"), "at").join(centre, "at").where("a <> b").groupBy("a", "b").count()
    first = votes.groupBy("a").agg(F.max(F.struct("count", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    links = checkpointed(_verified(first, active, percent))
    trees = components(links)

    rank = F.posexplode(F.slice("grams", F.lit(1), F.col("prefix").cast("int"))).alias("i", "gram")
    posts = active.join(trees, F.col("class") == F.col("node"), "left")
    posts = posts.select("class", "n", F.coalesce("root", "class").alias("root"), "own", rank)
    posts = posts.select("gram", "class", "n", "root", (F.col("own") + F.col("i")).alias("i"))
    mixed = posts.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gram")
    posts = posts.join(mixed, "gram", "left_semi")
    x = posts.select("gram", F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"), F.col("i").alias("i_a"))
    y = posts.select("gram", F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"), F.col("i").alias("i_b"))
    # Where the first shared shingle stands bounds the overlap; every pair that links has one that passes.
    reach = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    fits = (F.col("n_a") * 100 >= percent * F.col("n_b")) & (F.col("n_b") * 100 >= percent * F.col("n_a")) & (reach * 100 >= percent * (F.col("n_a") + F.col("n_b") - reach))
    rest = x.join(y, "gram").where((F.col("root_a") < F.col("root_b")) & fits).select("a", "b").distinct()
    more = checkpointed(_verified(rest, active, percent))
    return components(links.unionByName(more)) if not more.isEmpty() else trees


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the smallest doc_id that links reach, itself included.

    Two rows link when 100 * intersection >= percent * union of their sets; fewer words than a shingle has make one
    shingle of the whole sequence; rows without words link with nothing, and are components of their own. A null key is
    never a component's name unless all of its rows have none. Repeated rows link like any others.
    """
    sets = shingle_sets(docs, words, text, key)
    trees = class_links(docs, words, percent, text)
    named = sets.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    named = named.join(trees, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(roots, "root").select(F.col("class").alias("of"), "component_id")
    out = sets.join(named, F.col("class") == F.col("of"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def without_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the smallest key, and every row without words.

    Of rows that share the smallest key of a component, one stays (that with the smallest class). Rows with a null key
    stay only where their component has no other rows, one for each class.
    """
    sets = shingle_sets(docs, words, text, key)
    trees = class_links(docs, words, percent, text)
    rows = sets.where("class is not null").join(trees, F.col("class") == F.col("node"), "left").select("doc_id", "class", F.coalesce("root", "class").alias("root"))
    stays = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.class").alias("_class"))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            found = [set_hash(g) if len(g) else None for g in shingler.sets(*utf8(batch.column(batch.num_columns - 1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], [*batch.schema.names[:-1], "_class_of"])

    marked = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_row"), col(key).cast("long").alias("_key"), col(text).cast("string").alias("_text"))
    marked = in_batches(marked).mapInArrow(tidy(classes), T.StructType([*marked.schema.fields[:-1], T.StructField("_class_of", T.LongType())]))
    empty = marked.where("_class_of is null")
    kept = marked.join(stays, F.col("_class_of").eqNullSafe(F.col("_class")) & F.col("_key").eqNullSafe(F.col("_id")), "left_semi").where("_class_of is not null")
    one = F.row_number().over(Window.partitionBy("_class_of", "_key").orderBy("_key"))
    kept = kept.withColumn("_nth", one).where("_nth = 1")
    return kept.select("_row").unionByName(empty.select("_row")).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
