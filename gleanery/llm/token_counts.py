"""Token counts: an exact length histogram, and suffix sums that answer for every context limit.

Every whole text is encoded once; from then on only (length, documents) pairs are left, combined on the map side.
Suffix sums over the histogram give the totals, quantiles and truncated totals of every limit. They are made in two
levels, blocks of lengths and lengths within a block, so that no task holds more than a block or one row for each block.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, col, in_batches, tidy

#: Lengths in one block of the suffix sums.
BLOCK = 1024
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(2)
def _encoding(path: str | None):
    import tiktoken
    from public_tokenizers import PATTERN
    from public_tokenizers import path as find

    with open(path or find(VOCABULARY), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of each row; null and empty texts have 0 tokens. ``path``: a tiktoken vocabulary file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            n = [len(encode(x)) if x else 0 for x in map(pa.StringScalar.as_py, batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    rows = docs.select(col(key).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    return in_batches(rows).mapInArrow(tidy(count), "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens and docs, the number of documents of that length; written once, as every answer reads it more than once."""
    return checkpointed(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")))


def limit_table(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit: what holds at that limit.

    Columns: n_tokens (the limit), docs (of exactly that length), docs_within, docs_over, tokens_within (tokens of
    documents within the limit), tokens_over (of longer ones, untruncated), tokens_truncated (all tokens that are left
    when every document is cut at the limit), total_tokens, share_within (the quantile that the limit is). Between two
    lengths, tokens_truncated is linear with slope docs_over. Empty histogram: no rows.
    """
    rows = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    sums = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    sums = sums.select(
        "block", F.coalesce(F.sum("d").over(after), zero).alias("later_docs"), F.coalesce(F.sum("t").over(after), zero).alias("later_tokens"),
        F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"),
    )
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, "block").select(
        "n_tokens", "docs", "all_docs", "all_tokens",
        (F.col("later_docs") + F.coalesce(F.sum("docs").over(longer), zero)).alias("docs_over"),
        (F.col("later_tokens") + F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")).over(longer), zero)).alias("tokens_over"),
    )
    return rows.select(
        "n_tokens", "docs", (F.col("all_docs") - F.col("docs_over")).alias("docs_within"), "docs_over",
        (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_within"), "tokens_over",
        (F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("tokens_truncated"),
        F.col("all_tokens").alias("total_tokens"), ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("share_within"),
    )


def truncated_totals(limits: DataFrame, context: list[int]) -> DataFrame:
    """limit, tokens_truncated and docs_over of any context limits, from ``limit_table``, in one aggregation."""
    last = F.struct("n_tokens", "docs_over", "tokens_within")
    row = limits.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.array(*[F.struct(F.lit(int(c)).cast("long").alias("limit"), F.max(F.when(F.col("n_tokens") <= int(c), last)).alias("at")) for c in context]).alias("asked"))
    row = row.select("n", F.explode("asked").alias("a"))
    over = F.coalesce(F.col("a.at.docs_over"), F.col("n"))
    return row.select(F.col("a.limit").alias("limit"), (F.coalesce(F.col("a.at.tokens_within"), F.lit(0)) + over * F.col("a.limit")).alias("tokens_truncated"), over.alias("docs_over"))


def length_quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """share and the smallest length that at least this share of the documents stays within."""
    row = limits.agg(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.min(F.when(F.col("share_within") >= float(s), F.col("n_tokens"))).alias("n_tokens")) for s in shares]).alias("asked"))
    return row.select(F.explode("asked").alias("a")).select("a.*")
