"""Readers: the tables of a folder, corpora in JSON, and the evaluation inputs derived from the tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_map import RANGE, read_map
from .sinks import finite, materialised

#: Candidate documents that are drawn for each question, beside its gold document.
DRAWN = 49


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hashed(*parts) -> F.Column:
    """A number below 2**32 from the MD5 of parts joined by bars; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


#: Bytes of the windows by which items are found in texts; an item has the longest one that fits.
WINDOWS = (32, 16, 8, 4, 2, 1)
#: White space, after which windows begin, among bytes of UTF-8.
_SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
#: Bytes of text whose windows are in arrays at once; a longer text stands alone.
SLICE = 1 << 20


def _window_keys(raw: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k bytes from each start on; behind the last window stand at least 8 other bytes."""
    eight = np.ndarray(max(0, len(raw) - 7), "<u8", raw, strides=(1,))  # the 8 bytes from every place on
    keys = np.full(len(starts), k, np.uint64)
    for j in range(0, k, 8):
        keys = (keys ^ (eight[starts + j] & np.uint64((1 << 8 * min(k, 8)) - 1))) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return (keys * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _item_keys(items: DataFrame) -> DataFrame:
    """item_id, item, k, key: the window of each item behind its first white space; k is 0 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for text in batch.column("text").to_pylist():
                raw = np.frombuffer(text.encode() + bytes(8), np.uint8)
                start = int(np.argmax(np.r_[_SPACES[raw], True])) + 1
                k = max((k for k in WINDOWS if start + k <= len(raw) - 8), default=0)
                sizes.append(k)
                keys.append(int(_window_keys(raw, np.array([start]), k)[0]) if k else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(keys, pa.int64())], ["item_id", "item", "k", "key"])

    rows = items.where("text is not null").select("item_id", "text")
    return rows.mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, item string, k int, key bigint")


def _text_keys(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, keys: the windows of these sizes behind every white space of each text."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        _, offsets, data = text.buffers()
        at = np.frombuffer(offsets, np.int64, len(text) + 1, text.offset * 8)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        raw, at = np.r_[raw, np.zeros(8, np.uint8)], at - at[0]
        spaces = np.flatnonzero(_SPACES[raw])
        room = np.repeat(at[1:], np.diff(np.searchsorted(spaces, at))) - spaces - 1  # bytes of the text that follow
        for k in sizes:
            starts = spaces[room >= k] + 1
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(starts - 1, at), pa.int32()), pa.array(_window_keys(raw, starts, k)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, i = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)), 0
            while i < len(ends):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE, "right")))
                yield from cut(batch.slice(i, j - i))
                i = j

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, keys array<bigint>")


def located(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id, at, n: where each item's text stands in each document that holds it, its first place only.

    The bytes behind an item's first white space stand behind white space in any document that holds it: an equi-join on hashes of
    windows. Only pairs that it leaves are compared; they are written once, so that Spark knows how few they are and texts need
    not be dealt out. Items without a byte behind white space, if there are any, alone meet all documents.
    """
    keyed = materialised(_item_keys(items))
    sizes = sorted(r["k"] for r in keyed.select("k").distinct().collect())  # at most as many as there are windows, and one
    texts = docs.select("doc_id", "text")
    out = None
    if any(sizes):
        every = _text_keys(docs, [k for k in sizes if k]).select("doc_id", F.explode("keys").alias("key"))
        shared = materialised(every.join(keyed.where("k > 0"), "key").select("item_id", "doc_id").distinct())
        out = texts.join(shared, "doc_id").join(keyed.select("item_id", "item"), "item_id").where(F.contains("text", "item"))
    if 0 in sizes:
        few = texts.join(keyed.where("k = 0").select("item_id", "item"), F.contains("text", "item"))
        out = few if out is None else out.select(*few.columns).unionByName(few)
    if out is None:
        return items.sparkSession.createDataFrame([], "item_id long, doc_id long, at int, n int")
    return out.select("item_id", "doc_id", F.instr("text", F.col("item")).alias("at"), F.length("item").alias("n"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """question_id, query, split, answerable, gold_doc, gold_start, gold_end: one row for each benchmark item.

    The query is the item's first 12 words; its gold span is where the item stands in the smallest document that holds it.
    """
    items, docs = table(spark, folder, "benchmark"), table(spark, folder, "documents")
    found = located(items, docs).groupBy("item_id").agg(F.min(F.struct("doc_id", "at", "n")).alias("hit"))
    first = F.array_join(F.slice(F.split("text", " "), 1, 12), " ")
    rows = items.join(found, "item_id", "left")
    return rows.select(
        F.col("item_id").alias("question_id"), first.alias("query"), F.when(F.col("item_id") % 2 == 0, "train").otherwise("dev").alias("split"),
        F.col("hit").isNotNull().alias("answerable"), F.col("hit.doc_id").alias("gold_doc"), (F.col("hit.at") - 1).cast("long").alias("gold_start"),
        (F.col("hit.at") - 1 + F.col("hit.n")).cast("long").alias("gold_end"),
    )


def ring(docs: DataFrame, digits: int = 3) -> DataFrame:
    """doc_id and place: documents numbered from 0 in the order of the MD5 of their id, in two levels by its first digits."""
    from pyspark.sql import Window

    rows = docs.select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h")).withColumn("part", F.substring("h", 1, digits))
    sums = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("part").orderBy("h", "doc_id"))
    return rows.join(sums.select("part", before.alias("before")), "part").select("doc_id", (F.col("before") + within - 1).alias("place"))


def candidates(asked: DataFrame, docs: DataFrame, drawn: int = DRAWN) -> DataFrame:
    """question_id, doc_id: the gold document and ``drawn`` others, or all others if there are fewer.

    Documents stand in a ring by a hash of their id; a question takes those that follow its own hash. So no draw is lost or
    repeated, whatever the ids are, and no question meets the whole corpus.
    """
    from pyspark.sql import Window

    total = docs.agg(F.count(F.lit(1)).alias("n"))
    asks = asked.select("question_id", "gold_doc").join(total, F.lit(True)).where("n > 0")
    asks = asks.select("question_id", "gold_doc", "n", F.explode(F.sequence(F.lit(0), F.least(F.lit(drawn), F.col("n") - 1).cast("int"))).alias("j"))
    asks = asks.select("question_id", "gold_doc", "j", ((hashed(F.col("question_id")) + F.col("j")) % F.col("n")).alias("place"))
    got = ring(docs).join(asks, "place").where(~F.col("doc_id").eqNullSafe(F.col("gold_doc")))
    nth = F.row_number().over(Window.partitionBy("question_id").orderBy("j"))
    got = got.withColumn("nth", nth).where(F.col("nth") <= drawn).select("question_id", "doc_id")
    return got.unionByName(asked.where("gold_doc is not null").select("question_id", F.col("gold_doc").alias("doc_id")))


def answer_records(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, turn, question, answer, context, split: each user turn with the next assistant turn and all turns before."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"),
        F.array_join(F.collect_list("text").over(w.rowsBetween(Window.unboundedPreceding, 0)), " ").alias("context"),
    )
    rows = rows.where("role = 'user' and next_role = 'assistant'")
    return rows.select("conv_id", "turn", F.col("text").alias("question"), "answer", "context", F.when(F.col("conv_id") % 2 == 0, "train").otherwise("dev").alias("split"))


def corpus(spark: SparkSession, path: str, sections: str | None = None, size: int = RANGE) -> DataFrame:
    """doc_id, title, text, sections of JSON maps id -> {title, text}, read in ranges of ``size`` bytes.

    Missing titles and texts are empty. Sections come from another map, id -> {sections: [{start, end}]}, in order; those
    that do not lie within the text are left out.
    """
    d = F.from_json("value", "struct<title:string,text:string>")
    rows = read_map(spark, path, size).select(F.col("key").alias("doc_id"), d.alias("d"))
    rows = rows.select("doc_id", F.coalesce("d.title", F.lit("")).alias("title"), F.coalesce("d.text", F.lit("")).alias("text"))
    if sections is None:
        return rows.withColumn("sections", F.lit(None).cast("array<struct<start:int,end:int>>"))
    spans = read_map(spark, sections, size).select(F.col("key").alias("doc_id"), F.from_json("value", "struct<sections:array<struct<start:int,end:int>>>").alias("s"))
    rows = rows.join(spans, "doc_id", "left")
    inside = F.filter("s.sections", lambda x: (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length("text")))
    return rows.select("doc_id", "title", "text", F.array_sort(inside).alias("sections"))


def composition(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """part, n: questions of each split, and documents."""
    splits = asked.groupBy(F.col("split").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return splits.unionByName(docs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("documents").alias("part"), "n"))


def composed(asked: DataFrame, docs: DataFrame, expected: dict[str, int]) -> None:
    """An error that says which parts do not have the expected size, other parts included."""
    found = {r["part"]: r["n"] for r in composition(asked, docs).collect()}
    if wrong := {p: (found.get(p, 0), expected.get(p, 0)) for p in sorted(found.keys() | expected.keys()) if found.get(p, 0) != expected.get(p, 0)}:
        raise ValueError(f"unlike the expected composition (found, expected): {wrong}")


def question_files(spark: SparkSession, train: str, dev: str) -> DataFrame:
    """Questions of two JSON lists, with their split, the query (title and text) and offsets where they are numbers."""
    schema = "QUESTION_ID string, QUESTION_TITLE string, QUESTION_TEXT string, ANSWERABLE string, DOCUMENT string, START_OFFSET string, END_OFFSET string, DOC_IDS array<string>"
    both = [spark.read.schema(schema).json(p, multiLine=True).withColumn("split", F.lit(s)) for p, s in ((train, "train"), (dev, "dev"))]
    rows = both[0].unionByName(both[1])
    parts = [F.when(F.trim(c) != "", F.trim(c)) for c in ("QUESTION_TITLE", "QUESTION_TEXT")]
    return rows.select(
        F.col("QUESTION_ID").alias("question_id"), F.concat_ws(" ", *parts).alias("query"), "split", (F.upper(F.coalesce("ANSWERABLE", F.lit(""))) == "Y").alias("answerable"),
        F.col("DOCUMENT").alias("gold_doc"), F.expr("try_cast(START_OFFSET as long)").alias("gold_start"), F.expr("try_cast(END_OFFSET as long)").alias("gold_end"), F.col("DOC_IDS").alias("doc_ids"),
    )


def checkpoint_records(spark: SparkSession, path: str, schema: str, key: str = "question_id", order: str = "seconds") -> DataFrame:
    """A JSON-lines checkpoint without broken lines; the last record of each key counts."""
    from pyspark.sql import Window

    rows = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_nth", last).where("_nth = 1").drop("_nth")


def result_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A CSV result with a header, or None where there is none yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def result_json(spark: SparkSession, path: str) -> DataFrame | None:
    """A JSON result, or None where there is none yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.json(path) if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where) else None


def result_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of a CSV result as strict JSON, one string each; no rows where there is none yet."""
    rows = result_table(spark, path, schema)
    empty = spark.createDataFrame([], "record string")
    return empty if rows is None else finite(rows).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def required(rows: DataFrame | None, columns: set[str], name: str) -> DataFrame:
    """``rows``, or an error that says what is missing."""
    if rows is None:
        raise FileNotFoundError(f"{name} is missing")
    if gone := columns - set(rows.columns):
        raise ValueError(f"{name} lacks {sorted(gone)}")
    return rows


def ceiling_table(spark: SparkSession, path: str) -> DataFrame:
    """Ceilings by method and question from a CSV file; missing columns are an error."""
    return required(result_table(spark, path), {"method", "question_id", "ceiling"}, path)


def factor_traces(spark: SparkSession, folder: str, names: tuple[str, ...] = ("A", "B", "C")) -> dict[str, DataFrame]:
    """The traces of each factor from CSV files ``factor<name>.csv``; a missing one is an error."""
    return {n: required(result_table(spark, f"{folder}/factor{n}.csv"), {"question_id"}, f"factor{n}.csv") for n in names}


def number(column: F.Column, missing: float) -> F.Column:
    """A number from text; what is none counts as ``missing``."""
    return F.coalesce(column.try_cast("double"), F.lit(missing))


def method_chunks(spark: SparkSession, pattern: str) -> DataFrame:
    """Chunk tables of several files, the method taken from each file's name."""
    return spark.read.parquet(pattern).withColumn("method", F.regexp_extract(F.input_file_name(), r"chunks_([^/]+?)(?:\.parquet)?/[^/]*$|chunks_([^/]+)\.parquet$", 1))


def flag(column: F.Column) -> F.Column:
    """A flag written as a number, a word or a boolean."""
    return F.lower(F.trim(column.cast("string"))).isin("1", "1.0", "true", "yes")
