"""Exact dedup by content sort, in DataFrame functions only.

Texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``.

* Sampled splitters range-partition the rows by a bounded head of the normalised bytes and, behind it, a hash of
  all of them: equal texts meet in one partition, texts that merely share a long beginning do not have to, and
  what the sampling brings to the driver is bounded for each row whatever the length of its text.
* Within a partition an external sort by the whole normalised text places equals side by side, and a window over
  the sorted run compares neighbours in full.
* A text with very many copies would still fill one partition. Hashes with more than ``hot`` rows are found by an
  aggregation that combines on the map side; at most rows / hot of them exist. Their rows never enter the sort: each
  task collapses its copies of a text (compared in full) before the shuffle, so that one row for each task and text
  travels, and the rows take the result back by the SHA-256 of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, col, partitions

#: Characters of the normalised text that go into the sampled splitters.
HEAD = 32


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", hot: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the one with the smallest key.
    Null text counts as empty, and empty texts are equal to each other. A null key is larger than any other. Of
    repeated rows (same key, same text) exactly one is ``kept``; all of them count in ``group_size``. An empty
    table gives an empty result; other columns of ``docs`` are ignored.
    ``hot``: copies from which a text is aggregated rather than sorted; by default an eighth of a partition's rows.
    """
    raw = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = docs.select(col(key).alias("doc_id"), F.length(raw).cast("long").alias("chars"), F.regexp_replace(raw, f"[{SPACE}]+", "").alias("norm"))
    rows = rows.withColumn("hash", F.xxhash64("norm"))
    if hot is None:
        hot = max(64, docs.count() // (8 * partitions(docs)))
    many = rows.groupBy("hash").count().where(F.col("count") > hot).select("hash")

    many = F.broadcast(many)  # at most rows / hot numbers: eight for each partition by default
    cold = rows.join(many, "hash", "left_anti")
    cold = cold.withColumn("head", F.substring("norm", 1, HEAD)).repartitionByRange(partitions(docs), "head", "hash")
    same = Window.partitionBy("head", "hash", "norm")
    best = same.orderBy(F.desc("chars"), F.col("doc_id").asc_nulls_last())
    cold = cold.select(
        "doc_id", F.first("doc_id").over(best).alias("keep_id"), F.count(F.lit(1)).over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("group_size"),
        (F.row_number().over(best) == 1).alias("kept"), F.sha2("norm", 256).alias("text_sha256"),
    )

    # Each task sends one row for each hot text of its own; the result has one for each hot text, eight for a partition at most.
    warm = rows.join(many, "hash", "left_semi")
    first = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    of = warm.groupBy("norm").agg(first.alias("best"), F.count(F.lit(1)).alias("group_size"))
    of = checkpointed(of.select(F.sha2("norm", 256).alias("text_sha256"), F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("most"), "group_size"))
    if of.isEmpty():
        return cold
    # Rows that repeat the leader are told apart by a number that is written before it is compared.
    warm = checkpointed(warm.select("doc_id", "chars", F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("place")))
    leads = warm.join(F.broadcast(of), "text_sha256").where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("most")))
    one = leads.groupBy("text_sha256").agg(F.min("place").alias("stays"))
    of = of.join(F.broadcast(one), "text_sha256").select("text_sha256", "keep_id", "group_size", "stays")
    warm = warm.join(F.broadcast(of), "text_sha256").select("doc_id", "keep_id", "group_size", (F.col("place") == F.col("stays")).alias("kept"), "text_sha256")
    return cold.unionByName(warm)


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Repeated rows and nulls as in ``exact_groups``."""
    name = lambda k, digest: F.concat_ws("|", F.coalesce(k.cast("string"), F.lit("-")), digest)
    groups = exact_groups(docs, text, key).where("kept").select(name(F.col("doc_id"), F.col("text_sha256")).alias("stays"))
    row, raw = "row", F.coalesce(col(text).cast("string"), F.lit(""))
    digest = F.sha2(F.regexp_replace(raw, f"[{SPACE}]+", ""), 256)
    keyed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias(row), name(col(key), digest).alias("name"), F.length(raw).alias("chars"))
    keyed = keyed.join(groups, F.col("name") == F.col("stays"), "left_semi")
    # Repeated rows of the one that stays, and rows of its key whose text has other white space: the longest stays. The
    # rows are already dealt by name, so this moves nothing.
    keyed = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("chars")))).where("nth = 1")
    return keyed.select(*[F.col(row).getField(c).alias(c) for c in docs.columns])
