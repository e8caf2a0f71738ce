"""Packed rows: whole numbers as compressed byte planes, and tables of vectors as rows that hold many vectors each.

A task packs what it reads, in the order it reads it, so packing needs no shuffle and no key can gather in one place.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, col, tidy

_CODEC = pa.Codec("zstd", compression_level=1)
#: Products of two vectors whose components, after scaling, stay below this in all are exact in 64-bit floating point.
EXACT = float(1 << 53)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on as compressed byte planes; planes of zeros in front are left out."""
    wide = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T
    return struct.pack("<QB", len(x), wide) + _CODEC.compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    """The numbers that ``pack`` was given, as unsigned 64-bit numbers."""
    n, wide = struct.unpack_from("<QB", data)
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :wide] = np.frombuffer(_CODEC.decompress(data[9:], n * wide, asbytes=True), np.uint8).reshape(wide, n).T
    return out.view("<u8").ravel()


def usable(vector: Column) -> Column:
    """Whether a vector is not null and holds no null and no component that is not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x, as doubles; those of 2**53 or more have no fraction, and what overflows is the largest double."""
    at = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(F.greatest(F.lit(-1.7e308), F.least(F.lit(1.7e308), y)))
    return F.transform(vector, lambda x: at(F.lit(float(scale)) * x.cast("double")))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of a list column as one matrix, short rows padded with zeros."""
    at, flat = np.asarray(column.offsets), np.asarray(column.values, np.float64)
    size = np.diff(at)
    out = np.zeros((len(column), int(size.max(initial=0))))
    rows = np.repeat(np.arange(len(column)), size)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)] = flat[at[0] : at[-1]] if len(column) else flat[:0]
    return out


def packed_vectors(rows: DataFrame, most: int, keep: list[str], vector: str = "v") -> DataFrame:
    """Written once: pack (a name), n, dims, x (n * dims doubles) and a list for each column of ``keep``, ``most`` rows at a time."""
    kinds = dict((f.name, f.dataType.simpleString()) for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            x = matrix(table.column(len(keep)).chunk(0))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), table.column(i).chunk(0)) for i in range(len(keep))]
            head = [pa.array([uuid.uuid4().hex]), pa.array([len(x)], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([x.astype("<f8").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(head + lists, ["pack", "n", "dims", "x", *keep])

        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, most - sum(b.num_rows for b in held))
                held.append(batch.slice(0, take))
                batch = batch.slice(take)
                if sum(b.num_rows for b in held) == most:
                    yield flush()
        if held:
            yield flush()

    kept = "".join(f", `{c}` array<{kinds[c]}>" for c in keep)
    return checkpointed(rows.select(*map(col, keep), col(vector)).mapInArrow(tidy(run), f"pack string, n int, dims int, x binary{kept}"))


def vectors_of(row: dict, dims: int) -> np.ndarray:
    """The matrix of a packed row, ``dims`` wide or as wide as it is."""
    x = np.frombuffer(row["x"], "<f8").reshape(row["n"], row["dims"])
    return x if x.shape[1] >= dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def numbers(x: np.ndarray) -> np.ndarray:
    """A matrix of whole doubles as Python integers of any size."""
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
