"""Segmentation: documents into character intervals.

Windows over words are built-in expressions on each row, without a shuffle. The structural and semantic methods are in
``segmentation``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind, tokens

UNITS, OVERLAP = 512, 0.10
#: Sums of this many neighbouring entries are kept beside an array, so that a prefix sum adds few numbers.
STEP = 256


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def _block_sums(x: Column, size: int) -> Column:
    """Sums of runs of ``size`` entries of an array variable, the last run maybe shorter."""
    blocks = F.ceil(F.size(x) / size).cast("int")
    return F.transform(F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>")), lambda k: _sum(F.slice(x, k * size + 1, F.lit(size))))


def prefix_sums(x: Column, f: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``f`` of a function that sums the first n entries of the array ``x``, by sums of ``STEP`` and ``STEP`` squared entries."""

    def upto(v: Column, n: Column) -> Column:
        high, low = F.floor(n / (STEP * STEP)).cast("int"), F.floor(n / STEP).cast("int")
        parts = _sum(F.slice(v["far"], F.lit(1), high)) + _sum(F.slice(v["near"], high * STEP + 1, low - high * STEP))
        return parts + _sum(F.slice(v["x"], low * STEP + 1, n - low * STEP))

    near = bind(x, lambda y: F.struct(y.alias("x"), _block_sums(y, STEP).alias("near")))
    whole = bind(near, lambda v: F.struct(v["x"].alias("x"), v["near"].alias("near"), _block_sums(v["near"], STEP).alias("far")))
    return bind(whole, lambda v: f(lambda n: upto(v, n)))


def word_windows(docs: DataFrame, size: int = UNITS, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, chunk_no, char_start, char_end, n_words: windows of ``size`` words, the last one ending with the text.

    Offsets are code points. A window's length is the sum of its own words and of what stands between them; its beginning
    is a prefix sum over strides, so the work grows in proportion to the text. Only windows leave the row.
    """
    stride = max(1, round(size * (1 - overlap)))

    def windows(v: Column) -> Column:
        words = F.floor((F.size(v["len"]) - v["lead"] + 1) / 2).cast("int")
        strides = F.transform(F.sequence(F.lit(0), F.floor(words / stride).cast("int")), lambda k: _sum(F.slice(v["len"], v["lead"] + k * (2 * stride) + 1, F.lit(2 * stride))))
        last = F.when(words <= size, 0).otherwise(F.ceil((words - size) / stride)).cast("int")
        before = F.when(v["lead"] > 0, v["len"][0]).otherwise(0)

        def window(start: Column, k: Column, n: Column) -> Column:
            held = F.least(F.lit(size), n - k * stride)
            end = start + _sum(F.slice(v["len"], v["lead"] + k * (2 * stride) + 1, 2 * held - 1))
            return F.struct(k.alias("chunk_no"), start.alias("char_start"), end.alias("char_end"), held.alias("n_words"))

        every = lambda n: prefix_sums(strides, lambda upto: F.transform(F.sequence(F.lit(0), last), lambda k: bind(before + upto(k), lambda start: window(start, k, n))))
        return F.when(words > 0, bind(words, every)).otherwise(F.array().cast("array<struct<chunk_no:int,char_start:int,char_end:int,n_words:int>>"))

    lengths = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+|\s+"), F.lit(0)), F.length)
    row = F.struct(lengths.alias("len"), F.coalesce(F.regexp_like("text", F.lit(r"^\s")), F.lit(False)).cast("int").alias("lead"))
    return docs.select("doc_id", F.explode(bind(row, windows)).alias("w")).select("doc_id", "w.*")


def word_spans(docs: DataFrame) -> DataFrame:
    """doc_id, word_no, char_start, char_end of every word."""
    parts = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+|\s+"), F.lit(0))).alias("i", "part"))
    w = Window.partitionBy("doc_id").orderBy("i")
    parts = parts.select("doc_id", "i", "part", F.sum(F.length("part")).over(w).cast("int").alias("char_end")).where(~F.col("part").rlike(r"^\s"))
    return parts.select("doc_id", (F.row_number().over(w) - 1).alias("word_no"), (F.col("char_end") - F.length("part")).alias("char_start"), "char_end")


def chunk_texts(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with their text, and the two forms of their label."""
    rows = chunks.join(docs.select("doc_id", "text"), "doc_id")
    label = lambda mark: F.concat(F.col("doc_id"), F.lit(mark), F.col("chunk_no"))
    return rows.select(*chunks.columns, F.expr("substring(text, char_start + 1, char_end - char_start)").alias("text"), label("::").alias("chunk_id"), label("::chunk_").alias("label"))


def chunk_statistics(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: number of chunks, per document, words of a chunk (mean, percentiles), and characters kept per character."""
    share = lambda p: F.percentile("n_words", F.lit(p))
    one = chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.avg("n_words").alias("mean_words"), share(0.5).alias("median_words"),
        share(0.1).alias("p10_words"), share(0.9).alias("p90_words"), F.sum(F.col("char_end") - F.col("char_start")).alias("kept"),
    )
    total = docs.agg(F.sum(F.length("text")).alias("chars"))
    return one.join(total, F.lit(True)).select("n_chunks", (F.col("n_chunks") / F.col("n_docs")).alias("chunks_per_doc"), "mean_words", "median_words", "p10_words", "p90_words", (F.col("kept") / F.col("chars")).alias("redundancy"))


def agreement(chunks: DataFrame, centre: str) -> DataFrame:
    """method, n_docs, identical, single, several of chunks (method, doc_id, char_start, char_end): for each method, over the
    documents that the ``centre`` method cuts, the share that it cuts alike, into one chunk, and into several."""
    spans = chunks.groupBy("method", "doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end"))).alias("x"))
    centred = F.col("method") == centre
    # The centre's chunks meet the others' within their document, so that each method is cut once.
    rows = spans.withColumn("y", F.max(F.when(centred, F.col("x"))).over(Window.partitionBy("doc_id")))
    kinds = {"identical": F.col("x") == F.col("y"), "single": F.size("x") == 1, "several": F.size("x") > 1}
    found = rows.groupBy("method").agg(F.sum(centred.cast("long")).alias("n_docs"), *[F.count(F.when(F.isnotnull("y") & c, 1)).alias(n) for n, c in kinds.items()])
    found = found.withColumn("n_docs", F.sum("n_docs").over(Window.partitionBy())).where("n_docs > 0")
    return found.select("method", "n_docs", *[(F.col(n) / F.col("n_docs")).alias(n) for n in kinds])


def _best_run(hits: Column, width: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of the first place, from 1, of ``width`` entries of the array ``hits`` with the largest sum."""

    def places(upto: Callable[[Column], Column]) -> Column:
        sums = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(hits) - width + 1)), lambda i: F.struct((upto(F.least(i + width - 1, F.size(hits))) - upto(i - 1)).alias("n"), (-i).alias("i")))
        return F.array_max(sums)

    return bind(prefix_sums(hits, places), lambda best: f(-best["i"]))


def excerpts(chunks: DataFrame, budget: int) -> DataFrame:
    """Rows (key columns, text, query) with the ``excerpt`` of ``budget`` words that holds most words with a query term, the first such."""
    terms = F.filter(F.array_distinct(tokens(F.col("query"))), lambda t: F.length(t) > 2)

    def cut(v: Column) -> Column:
        hits = F.transform(v["w"], lambda w: F.exists(v["t"], lambda t: F.contains(F.lower(w), t)).cast("int"))
        best = lambda h: _best_run(h, F.lit(budget), lambda i: F.array_join(F.slice(v["w"], i, F.lit(budget)), " "))
        return F.when(F.size(v["w"]) <= budget, F.array_join(v["w"], " ")).otherwise(bind(hits, best))

    once = F.struct(F.regexp_extract_all(F.trim("text"), F.lit(r"\S+"), F.lit(0)).alias("w"), terms.alias("t"))
    return chunks.withColumn("excerpt", bind(once, cut))


def token_excerpts(chunks: DataFrame, budget: int, token: str = r"\w+|[^\w\s]") -> DataFrame:
    """Rows (key columns, text, query) with the ``excerpt`` of ``budget`` tokens with most tokens of words that hold a query
    term, the first such, cut from the text as it stands. ``token``: a pattern; a token never reaches over white space.
    """
    terms = F.filter(F.array_distinct(tokens(F.col("query"))), lambda t: F.length(t) > 2)

    def cut(v: Column) -> Column:
        inner = lambda w: F.regexp_extract_all(w, F.lit(token), F.lit(0))
        hit = lambda w: F.exists(v["t"], lambda t: F.contains(F.lower(w), t)).cast("int")
        marks = F.flatten(F.transform(v["w"], lambda w: bind(F.struct(hit(w).alias("h"), F.size(inner(w)).alias("n")), lambda x: F.array_repeat(x["h"], x["n"]))))
        # Tokens with the white space before each, so that joining them gives the text between the first and the last.
        spaced = F.regexp_extract_all(v["x"], F.lit(rf"\s*(?:{token})"), F.lit(0))
        piece = lambda s: lambda h: _best_run(h, F.lit(budget), lambda i: F.trim(F.array_join(F.slice(s, i, F.lit(budget)), "")))
        return bind(spaced, lambda s: F.when(F.size(s) <= budget, v["x"]).otherwise(bind(marks, piece(s))))

    text = F.trim("text")
    once = F.struct(text.alias("x"), F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)).alias("w"), terms.alias("t"))
    return chunks.withColumn("excerpt", bind(once, cut))


def clipped(text: Column, most: int, token: str = r"\w+|[^\w\s]") -> Column:
    """The first ``most`` tokens of a text and `` [...]``; the text itself where it has no more."""
    parts = F.regexp_extract_all(text, F.lit(rf"\s*(?:{token})"), F.lit(0))
    return bind(parts, lambda p: F.when(F.size(p) <= most, text).otherwise(F.concat(F.array_join(F.slice(p, F.lit(1), F.lit(most)), ""), F.lit(" [...]"))))
