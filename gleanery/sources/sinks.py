"""Sinks: tables, strict JSON, append-only records and provenance."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(df: DataFrame) -> DataFrame:
    """Doubles that are not finite become null, as strict JSON asks."""
    fix = lambda f: F.when(F.abs(F.col(f.name)) < float("inf"), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
    return df.select(*map(fix, df.schema.fields))


def save_table(df: DataFrame, path: str, digits: int = 4) -> None:
    """CSV with doubles rounded."""
    kinds = dict(df.dtypes)
    df.select(*[F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def save_json(df: DataFrame, path: str) -> None:
    finite(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_records(df: DataFrame, path: str) -> None:
    """Append generation records; readers take the last one of a key."""
    finite(df).write.mode("append").json(path)


def stamped(df: DataFrame, **facts: str) -> DataFrame:
    """Rows with a provenance struct."""
    return df.withColumn("provenance", F.struct(*[F.lit(str(v)).alias(k) for k, v in sorted(facts.items())], F.current_timestamp().alias("at")))


def save_markdown(df: DataFrame, path: str, digits: int = 4) -> None:
    """A Markdown table as text, in the order of the rows; for small result tables, written by one task."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.coalesce(F.format_string(f"%.{digits}f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit(""))
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    spark = df.sparkSession
    head = spark.range(1).select(F.lit(-2).cast("long").alias("n"), line([F.lit(c) for c in df.columns]).alias("value"))
    rule = spark.range(1).select(F.lit(-1).cast("long").alias("n"), line([F.lit("---") for _ in df.columns]).alias("value"))
    rows = df.coalesce(1).select(F.monotonically_increasing_id().alias("n"), line([cell(c) for c in df.columns]).alias("value"))
    head.unionByName(rule).unionByName(rows).coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def save_contexts(ranking: DataFrame, path: str, depth: int = 5) -> None:
    """The first chunks of each question in rank order, one JSON row for each question."""
    rows = ranking.where(F.col("rnk") <= depth).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rnk", "doc_id", "chunk_no"))).alias("context"))
    rows.write.mode("overwrite").json(path)


def read_through(spark: SparkSession, path: str, build, rows: int | None = None) -> DataFrame:
    """A Parquet table that is there (with ``rows`` rows, where given), else what ``build`` gives, written there first."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        held = spark.read.parquet(path)
        if rows is None or held.count() == rows:
            return held
    if build is None:
        raise FileNotFoundError(f"nothing usable is kept at {path}")
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_map(df: DataFrame, path: str, key: str) -> None:
    """Each part file a JSON map from ``key`` to the other columns. Rows with a null key are left out; repeated keys stay."""
    rest = [c for c in df.columns if c != key]
    rows = df.where(F.col(key).isNotNull()).select(F.to_json(F.array(F.col(key).cast("string"))).alias("k"), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("v"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opens = "{"
        for batch in batches:
            found = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.append(f"{opens}{k[1:-1]}: {v}")
                opens = ", "
            yield pa.RecordBatch.from_pydict({"value": pa.array(found, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["{}" if opens == "{" else "}"]})

    rows.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


_kept: dict[str, set[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where that setting is unset, only a local master gets a folder of its own,
    below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


def scratch(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder, deleted when the interpreter ends or by ``released``."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    if not _kept:
        atexit.register(_clear)
    _kept.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def released(spark: SparkSession, path: str) -> None:
    """Delete what a path of ``scratch`` holds."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _kept.get(spark.sparkContext.applicationId, set()).discard(path)


def _clear() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in list(_kept.get(spark.sparkContext.applicationId, ())):
            released(spark, path)


def materialised(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared folder, compressed, and read from there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
