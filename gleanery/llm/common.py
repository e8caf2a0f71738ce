"""Helpers shared by the operators: checkpoints, free names, and UTF-8 bytes of Arrow text columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import inspect
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here, as a regular expression class: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Which bytes are white space.
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True


_written: dict[str, set[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, only a local master gets one, below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows of ``df`` as a Parquet table in the shared folder, compressed and with statistics.

    Tables are deleted by ``released`` as soon as nothing needs them, and the rest when the interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(path, compression="zstd")
    if not _written:
        atexit.register(_clear)
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is written meanwhile are deleted at its end, not when the driver next collects garbage: the table
    takes their place, and the disk holds those of one step only."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, held)


def released(*tables: DataFrame) -> None:
    """Delete tables that ``checkpointed`` wrote; no frame that reads them may be used any more."""
    for df in tables:
        path, spark = getattr(df, "_table", None), df.sparkSession
        if path:
            _delete(spark, path)
            _written.get(spark.sparkContext.applicationId, set()).discard(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clear() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in _written.pop(spark.sparkContext.applicationId, ()):
            _delete(spark, path)


#: Rows and bytes of the batches in which texts go to Python workers; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends Python workers batches of bounded size, so that long texts do not add up."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = str(conf.get(name)).removesuffix("b")
        if not held.isdecimal() or not 0 < int(held) <= most:
            conf.set(name, str(most))
    return df


def give_back() -> None:
    """Return freed memory to the system: a worker that is kept for later tasks should hold no more than it uses."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """``run`` on batches, giving memory back when the task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def tidy_group(run):
    """``run`` on one group, giving memory back behind it; group functions have one or two arguments."""
    if len(inspect.signature(run).parameters) == 1:

        def one(table: pa.Table) -> pa.Table:
            try:
                return run(table)
            finally:
                give_back()

        return one

    def two(key: tuple, table: pa.Table) -> pa.Table:
        try:
            return run(key, table)
        finally:
            give_back()

    return two


def partitions(df: DataFrame) -> int:
    """The number of shuffle partitions that the session asks for."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def pieces(at: np.ndarray, most: int = 1 << 20):
    """Runs of rows [i, j) whose bytes stay under ``most``; a longer row is a run of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes: shifts and odd multipliers, a bijection."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Polynomial prefix hashes of bytes, modulo 2**64: any substring's hash in a few steps.

    Each byte value stands for a random 64-bit number, ``fold`` gives A-Z those of a-z.
    """

    def __init__(self, seed: int, fold: bool = False):
        rng = np.random.Generator(np.random.Philox(seed))
        self.table = rng.integers(0, 1 << 64, 256, np.uint64)
        if fold:
            self.table[65:91] = self.table[97:123]
        self.base = int(rng.integers(0, 1 << 62)) * 4 + 3
        self.powers = self.inverse = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Hashes of the prefixes of length 0, 1, ... of ``data``."""
        if len(self.powers) <= len(data):
            n = 1 << int(len(data)).bit_length()
            self.powers, self.inverse = _powers(self.base, n), _powers(pow(self.base, -1, 1 << 64), n)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of the substrings [start, end) of what ``prefix`` was made from."""
        return mix((prefix[end] - prefix[start]) * self.inverse[start])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out
