"""Resumable generation, exactly once: records are kept by micro-batch, so that a batch that runs again replaces itself.

A stream remembers in its checkpoint which files of questions belong to which batch, and whether the batch has ended. When
a run dies between the two - records written, batch not yet committed - the next run repeats the batch under the same
number, into the same folder. A batch leaves out what earlier batches have answered and answers a question once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import finite

_DONE = "_SUCCESS"


def missing(asked: DataFrame, done: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions without a record."""
    return asked.join(done.select(key).distinct(), key, "left_anti")


def question_stream(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of the JSON-lines files that a folder has and gets, ``files`` of them to a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def batches(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and folder of each batch that was written to its end."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    found = [x.getPath() for x in files.listStatus(where) if x.getPath().getName().startswith("batch-")]
    inner = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted((int(p.getName().removeprefix("batch-")), p.toString()) for p in found if files.exists(inner(p, _DONE)))


def committed(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The records of ended batches (with numbers under ``before``, where given), without lines that are no records."""
    paths = [p for n, p in batches(spark, path) if before is None or n < before]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(paths, mode="DROPMALFORMED")


def stream_records(source: DataFrame, generate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, schema: str, key: str = "question_id") -> StreamingQuery:
    """Generate records for the questions of a stream until it is read to its end; a later call goes on where this one ended.

    ``generate`` gets the questions of a micro-batch that no earlier batch has answered, each once, and gives records of
    ``schema``, which go to ``path``/batch-number. Questions with a null key are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        once = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        finite(generate(missing(once, committed(spark, path, schema, number), key))).write.mode("overwrite").json(f"{path}/batch-{number:09d}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

