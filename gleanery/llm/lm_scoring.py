"""Language-model scores of texts by deleted interpolation.

The probability of a token is a mixture of maximum-likelihood estimates of all orders: one in V + 1, its share of all
tokens, its share of what follows the last word, the last two words, and so on. The weights of the mixture depend on how
often the longest known context occurs, in buckets of powers of two, and are learned by expectation-maximisation on a
deleted part of the training documents, whose n-grams are estimated from the counts of the other part.

1. Blocks. Each task packs its documents, as numbers of words, into blocks of a bounded number of tokens and of one part.
2. Counts. A block sends each of its distinct n-grams once, with its count, to the fragment of the hash range that the
   n-gram is in. A fragment sums, and sends each block the totals of the block's own n-grams, in the block's order: a
   word that a third of all documents hold is one row for each block, and no table of n-grams is joined or collected.
3. Weights. Blocks of the deleted part become estimates by order; each round of the EM is one pass over them, of which a
   row for each bucket and order comes to the driver, at most 64 buckets for each length of context.
4. Scores. Every block is scored with its totals, in logarithms, document by document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, checkpointed, col, in_batches, mix, pieces, released, tidy, tidy_group, utf8
from .ngram_join import LONG, Shingler
from .packs import pack, unpack

ORDER = 3
#: One in so many training documents is deleted from the counts and learns the weights.
DELETED = 20
#: Rounds of expectation-maximisation.
ROUNDS = 15
#: Tokens of a block (a longer text is a block of its own), and n-grams of a fragment.
BLOCK = 1 << 20
FRAGMENT = 1 << 21
#: Parts: documents that nothing is learned from, that are counted, and that are deleted from the counts.
UNSEEN, COUNTED, LEFT_OUT = 0, 1, 2
#: Bits by which hashes of two words and more are shorter than 64; those of single words are whole, as their counts are returned.
SHORT = 8
#: Buckets of context counts for each length of context.
BUCKETS = 64
#: Stand for the end of a text and for what comes before its beginning; no word has these hashes but by chance.
END, BEGIN = np.uint64(0x5BD1E995A3B1C6D7), np.uint64(0xC2B2AE3D27D4EB4F)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


class Words:
    """Hashes of the words of texts in UTF-8, with an end behind each text."""

    def __init__(self):
        self.shingler = Shingler(1)

    def tokens(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of rows: first row, behind the last row, tokens of all, and how many each row has."""
        for i, j in pieces(at):
            part, first = data[at[i] : at[j]], None
            if len(part) > LONG:  # one long row, in runs that end at white space
                found, lo = [], 0
                while lo < len(part):
                    hi = min(len(part), lo + LONG)
                    blank = np.flatnonzero(SPACE_BYTES[part[hi : hi + LONG]]) if hi < len(part) else np.zeros(1, int)
                    while hi < len(part) and not len(blank):  # a word longer than a run
                        hi = min(len(part), hi + LONG)
                        blank = np.flatnonzero(SPACE_BYTES[part[hi : hi + LONG]]) if hi < len(part) else np.zeros(1, int)
                    hi += int(blank[0]) if hi < len(part) else 0
                    found.append(self.shingler.word_hashes(part[lo:hi], np.array([0, hi - lo]))[0])
                    lo = hi
                hashes, first = np.concatenate(found), np.array([0, sum(map(len, found))])
            else:
                hashes, first = self.shingler.word_hashes(part, at[i : j + 1] - at[i])
            size = np.diff(first) + 1
            out = np.full(int(size.sum()), END, np.uint64)
            inner = np.ones(len(out), bool)
            inner[np.cumsum(size) - 1] = False
            out[inner] = hashes
            yield i, j, out, size


def _blocks(docs: DataFrame, text: str, key: str, part: Column) -> DataFrame:
    """Written once: block, part, n_tokens, n_docs, the keys, tokens of each document, word hashes, and tokens as numbers of words."""
    rows = docs.select(col(key).alias("doc_id"), col(text).cast("string").alias("text"), part.cast("int").alias("part"))
    names = ["block", "part", "n_tokens", "n_docs", "keys", "sizes", "words", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = Words(), {p: [] for p in (UNSEEN, COUNTED, LEFT_OUT)}

        def flush(p: int) -> pa.RecordBatch:
            keys, sizes, tokens = zip(*held[p])
            held[p] = []
            keys, sizes, tokens = pa.concat_arrays(keys), np.concatenate(sizes), np.concatenate(tokens)
            words, inverse, n = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            cells = [pa.array([uuid.uuid4().hex]), pa.array([p], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([len(sizes)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)]
            cells += [pa.array([x], pa.binary()) for x in (pack(sizes), words[order].astype("<u8").tobytes(), pack(rank[inverse]))]
            return pa.RecordBatch.from_arrays(cells, names)

        for batch in batches:
            parts = np.asarray(batch.column(2))
            for i, j, tokens, size in hashes.tokens(*utf8(batch.column(1))):
                of = np.repeat(parts[i:j], size)
                for p in np.unique(parts[i:j]):
                    rows_ = np.flatnonzero(parts[i:j] == p)
                    held[p].append((batch.column(0).slice(i, j - i).take(pa.array(rows_)), size[rows_], tokens[of == p]))
                    if sum(len(t) for *_, t in held[p]) >= BLOCK:
                        yield flush(p)
        for p in held:
            if held[p]:
                yield flush(p)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return checkpointed(in_batches(rows).mapInArrow(tidy(run), f"block string, part int, n_tokens long, n_docs long, keys array<{kind}>, sizes binary, words binary, tokens binary"))


def _factors(order: int) -> np.ndarray:
    rng = np.random.Generator(np.random.Philox(31))
    return rng.integers(0, 1 << 63, max(16, order), np.uint64) * np.uint64(2) + np.uint64(1)


class Block:
    """Tokens of some documents, and their n-grams."""

    def __init__(self, row: dict, order: int):
        self.sizes, number, words = unpack(row["sizes"]).astype(np.int64), unpack(row["tokens"]).astype(np.int64), np.frombuffer(row["words"], "<u8")
        self.order, self.hash = order, words[number]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(number)) - np.repeat(self.starts, self.sizes)

    def grams(self, n: int) -> np.ndarray:
        """A hash for the n-gram that ends at each token."""
        if n == 1:
            return self.hash
        factors = _factors(self.order)
        out = self.hash * factors[0]
        for back in range(1, n):
            before = np.full(len(self.hash), BEGIN, np.uint64)
            before[back:] = np.where(self.place[back:] >= back, self.hash[:-back], BEGIN)
            out += before * factors[back]
        return mix(out) >> np.uint64(SHORT)

    def estimates(self, totals: list[np.ndarray], tokens: int, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket of each token's context, its estimates of order 1, 2, ... as rows, and how often it occurs itself.

        ``totals``: for each order, the counts of the distinct n-grams in the order of their hashes.
        """
        out = np.zeros((self.order, len(self.hash)))
        bucket = np.zeros(len(self.hash), np.int64)
        seen = before = None
        for n in range(1, self.order + 1):
            count = totals[n - 1][np.unique(self.grams(n), return_inverse=True)[1]].astype(np.float64)
            if n == 1:
                seen, context = count, np.full(len(count), float(tokens))
            else:
                context = np.empty(len(count))
                context[1:], context[self.starts] = before[:-1], docs
                known = context > 0
                bucket[known] = (n - 1) * BUCKETS + np.frexp(context[known])[1] - 1
            np.divide(count, context, out=out[n - 1], where=context > 0)
            before = count
        return bucket, out, seen


def _ranges(hashes: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Which of ``n`` equal ranges each hash of so many bits is in."""
    return ((hashes >> np.uint64(bits - 32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _totals(blocks: DataFrame, order: int, fragments: int) -> DataFrame:
    """Written once: block, part, fragment, and the counts of the block's n-grams there, in all training documents and, for blocks
    of the deleted part, without that part; types: on one row of each fragment, the distinct tokens that training documents have there."""
    sent = ["fragment", "block", "part", "grams", "counts"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, order)
                for n in range(1, order + 1):
                    grams, counts = np.unique(block.grams(n), return_counts=True)
                    own = _ranges(grams, 64 if n == 1 else 64 - SHORT, fragments)
                    first = np.flatnonzero(np.diff(own, prepend=-1))
                    ends = np.append(first[1:], len(own))
                    gaps = np.diff(grams, prepend=np.uint64(0))
                    gaps[first] = grams[first]
                    for lo in range(0, len(first), 256):
                        at = list(zip(first[lo : lo + 256], ends[lo : lo + 256]))
                        cells = [pa.array([(n - 1) * fragments + int(own[a]) for a, _ in at], pa.int64()), pa.array([row["block"]] * len(at)), pa.array([row["part"]] * len(at), pa.int32())]
                        yield pa.RecordBatch.from_arrays([*cells, pa.array([pack(gaps[a:b]) for a, b in at], pa.binary()), pa.array([pack(counts[a:b]) for a, b in at], pa.binary())], sent)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        grams = [np.cumsum(unpack(x.as_py()), dtype=np.uint64) for x in table.column("grams")]
        ends = np.cumsum([len(g) for g in grams])
        parts = np.repeat(np.asarray(table.column("part")), np.diff(ends, prepend=0))
        counts = np.concatenate([unpack(x.as_py()) for x in table.column("counts")]).astype(np.float64)
        distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        kept = np.bincount(inverse, counts * (parts == COUNTED), len(distinct)).astype(np.uint64)
        every = kept + np.bincount(inverse, counts * (parts == LEFT_OUT), len(distinct)).astype(np.uint64)
        types = [0] * table.num_rows
        types[0] = int((every > 0).sum()) if key[0].as_py() < fragments else 0
        spans = list(zip(np.append(0, ends[:-1]), ends))
        deleted = [p == LEFT_OUT for p in table.column("part").to_pylist()]
        cells = [table.column("block"), table.column("part"), table.column("fragment"), pa.array([pack(every[inverse[a:b]]) for a, b in spans], pa.binary())]
        cells += [pa.array([pack(kept[inverse[a:b]]) if d else None for (a, b), d in zip(spans, deleted)], pa.binary()), pa.array(types, pa.int64())]
        return pa.table(cells, ["block", "part", "fragment", "every", "kept", "types"])

    rows = blocks.select("block", "part", "sizes", "words", "tokens").mapInArrow(tidy(send), "fragment long, block string, part int, grams binary, counts binary")
    return checkpointed(rows.groupBy("fragment").applyInArrow(tidy_group(add), "block string, part int, fragment long, every binary, kept binary, types long"))


def _with_totals(blocks: DataFrame, totals: DataFrame, column: str, order: int, fragments: int, run, schema: str) -> DataFrame:
    """``run`` on every block's row and its totals by order."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        row, by = left.drop_columns(["keys"]).to_pylist()[0], right.select(["fragment", column]).to_pylist()
        row["keys"] = left.column("keys").combine_chunks().flatten()
        by.sort(key=lambda r: r["fragment"])
        found = [[unpack(r[column]) for r in by if r["fragment"] // fragments == n] for n in range(order)]
        return run(row, [np.concatenate(f) for f in found])

    return blocks.groupBy("block").cogroup(totals.select("block", "fragment", column).groupBy("block")).applyInArrow(tidy_group(both), schema)


def starting_weights(order: int, tokens: int) -> np.ndarray:
    """For each bucket, equal weights of the estimates that its contexts have; without any training token, of 1 in V + 1 only."""
    out = np.zeros((order * BUCKETS, order + 1))
    for b in range(len(out)):
        out[b, : b // BUCKETS + 2] = 1 / (b // BUCKETS + 2)
    return out if tokens else np.eye(1, order + 1).repeat(len(out), 0)


def learned_weights(deleted: DataFrame, order: int, types: int, tokens: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by bucket and order (0: one in V + 1) from rows (bucket, order 1, 2, ...) of packed estimates.

    Each round shares every deleted token out over the estimates in proportion to what they add to its probability. A
    bucket's shares and one more token, shared by the starting weights, are its new weights.
    """
    start = weights = starting_weights(order, tokens)
    if not tokens:
        return start

    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(weights)
            for batch in batches:
                for row in batch.to_pylist():
                    bucket = np.frombuffer(row["bucket"], "<u2").astype(np.int64)
                    parts = weights[bucket].T.copy()
                    parts[0] /= types + 1
                    parts[1:] *= np.frombuffer(row["estimates"], "<f8").reshape(order, -1)
                    parts /= parts.sum(0)
                    for n in range(order + 1):
                        total[:, n] += np.bincount(bucket, parts[n], len(total))
            at = np.argwhere(total > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(total[tuple(at.T)])], ["bucket", "n", "x"])

        got = deleted.mapInArrow(tidy(expect), "bucket long, n long, x double").groupBy("bucket", "n").agg(F.sum("x").alias("x")).collect()
        new = start.copy()
        for r in got:
            new[r["bucket"], r["n"]] += r["x"]
        weights = new / new.sum(1, keepdims=True)
    return weights


def lm_scores(docs: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", order: int = ORDER, deleted: int = DELETED, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``.

    Tokens are the words of the whole text (A-Z lower-cased, split at white space) and an end. ``learn``: which rows are
    learned from (null: not). n_known: tokens that training documents have; train_tokens: N, all tokens of training
    documents; base_score: sum of log10((c + 1) / (N + V + 1)) with a token's count c and V distinct training tokens;
    score: log10 of the text's probability under the model.

    Null and empty texts are an end alone. Repeated rows are counted and scored as often as they occur, null keys too (of
    the key as text, one in ``deleted`` training documents learns the weights). A key of any type is returned as it is,
    other columns are ignored, whatever their names. Long texts are hashed in runs of 2 MiB. Without training documents
    every token has probability 1 in V + 1 = 1. An empty table gives no rows. Words are told apart by 64-bit hashes, so
    at 10**10 distinct words a few share their counts; n-grams of two and more by 56 bits, so at 10**13 distinct ones one in
    some 7,000 does.
    """
    learn = F.coalesce(learn, F.lit(False))
    part = F.when(~learn, UNSEEN).when(F.pmod(F.xxhash64(F.coalesce(col(key).cast("string"), F.lit(""))), F.lit(deleted)) == 0, LEFT_OUT).otherwise(COUNTED)
    blocks = _blocks(docs, text, key, part)
    facts = {r["part"]: r for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.sum("n_docs").alias("docs")).collect()}
    get = lambda name, *of: sum(facts[p][name] for p in of if p in facts)
    tokens, held, documents = get("tokens", COUNTED, LEFT_OUT), get("tokens", COUNTED), get("docs", COUNTED, LEFT_OUT)
    counted = get("docs", COUNTED)
    fragments = max(1, -(-get("tokens", UNSEEN, COUNTED, LEFT_OUT) // FRAGMENT))
    totals = _totals(blocks, order, fragments)
    types = totals.agg(F.coalesce(F.sum("types"), F.lit(0)).cast("long")).first()[0]

    def estimated(row: dict, by: list[np.ndarray]) -> pa.Table:
        bucket, estimates, _ = Block(row, order).estimates(by, held, counted)
        return pa.table([pa.array([bucket.astype("<u2").tobytes()], pa.binary()), pa.array([estimates.astype("<f8").tobytes()], pa.binary())], ["bucket", "estimates"])

    of = lambda df: df.where(F.col("part") == LEFT_OUT)
    learns = checkpointed(_with_totals(of(blocks), of(totals), "kept", order, fragments, estimated, "bucket binary, estimates binary"))
    weights = learned_weights(learns, order, types, tokens, rounds)

    def scored(row: dict, by: list[np.ndarray]) -> pa.Table:
        block = Block(row, order)
        bucket, estimates, seen = block.estimates(by, tokens, documents)
        p = weights[bucket, 0] / (types + 1)
        for n in range(order):
            p += weights[bucket, n + 1] * estimates[n]
        total = lambda x: np.add.reduceat(x, block.starts)
        n = len(block.sizes)
        cells = [pa.array(block.sizes), pa.array(total((seen > 0).astype(np.int64))), pa.array(np.full(n, tokens, np.int64)), pa.array(total(np.log10((seen + 1) / (tokens + types + 1)))), pa.array(total(np.log10(p)))]
        return pa.table([row["keys"], *cells], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    of_key = docs.select(col(key)).schema[0].dataType
    schema = f"doc_id {of_key.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = checkpointed(_with_totals(blocks, totals, "every", order, fragments, scored, schema))
    released(blocks, totals, learns)
    return out
