"""A data source for large JSON maps ``{"id": value, ...}``, read in byte ranges by many tasks.

Whether a byte stands inside a string, and how deep, depends on all bytes before it. So a file is read twice. The scan
tells of each range what it does to any state that it may begin in: inside a string or not, behind an odd backslash or
not, and how many levels it opens. These few numbers for each range, put together in order, give the exact state at the
beginning of every range. Then each range reads the entries whose separator - the first brace, or a comma between
entries - lies in it, the last one to its end beyond the range. Tasks hold a block of bytes and one entry at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and of what is looked at together.
RANGE, BLOCK = 32 << 20, 1 << 20
QUOTE, BACKSLASH, COMMA = ord('"'), ord("\\"), ord(",")
_LEVEL = np.zeros(256, np.int8)
_LEVEL[[ord("{"), ord("[")]], _LEVEL[[ord("}"), ord("]")]] = 1, -1


def quotes(data: np.ndarray, odd: bool) -> tuple[np.ndarray, bool]:
    """Where strings begin or end, and whether an odd run of backslashes ends the bytes. ``odd``: one stands before them."""
    at = np.flatnonzero(data == QUOTE)
    slashes = np.flatnonzero(data == BACKSLASH)
    if not len(slashes):
        return (at[1:] if odd and len(at) and at[0] == 0 else at), odd and not len(data)
    head = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)  # the first of each run
    first, end = slashes[head], np.append(slashes[head[1:] - 1], slashes[-1]) + 1
    length = end - first + (odd & (first == 0))
    escaped = end[length % 2 == 1]
    if odd and first[0] != 0:
        escaped = np.append(escaped, 0)
    at = at[~np.isin(at, escaped)]
    return at, bool(end[-1] == len(data) and length[-1] % 2)


def outside(data: np.ndarray, at: np.ndarray, inside: bool) -> np.ndarray:
    """For each byte, whether it stands outside strings; ``at``: where strings begin or end."""
    turn = np.zeros(len(data), np.int8)
    turn[at] = 1
    return (np.cumsum(turn, dtype=np.int64) + inside) % 2 == 0


@dataclass
class Effect:
    """What bytes do to a state: whether a backslash is pending, whether a string is open, and levels opened."""

    odd: bool
    inside: bool
    levels: int = 0

    def then(self, data: np.ndarray) -> None:
        at, odd = quotes(data, self.odd)
        self.levels += int(_LEVEL[data][outside(data, at, self.inside)].sum())
        self.odd, self.inside = odd, bool((len(at) + self.inside) % 2)


@dataclass
class Range(InputPartition):
    """Bytes [start, end) of a file; where entries are read, the state in which they begin."""

    path: str
    start: int
    end: int
    odd: bool = False
    inside: bool = False
    depth: int = 0


def _open(path: str) -> pa.NativeFile:
    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where.open_input_file(name)


def files(path: str) -> list[tuple[str, int]]:
    """Name and size of a file, or of the files of a folder but those whose names begin with a dot or an underscore."""
    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else f"{path.split(':')[0]}://"
    [info] = where.get_file_info([name])
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [x for x in where.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
    return sorted((prefix + x.path, x.size) for x in found)


def ranges(path: str, size: int) -> list[Range]:
    return [Range(name, a, min(a + size, total)) for name, total in files(path) for a in range(0, total, size)]


def blocks(part: Range, beyond: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """Place and bytes of the blocks of a range, or up to the end of the file."""
    with _open(part.path) as file:
        last, at = (file.size() if beyond else part.end), part.start
        while at < last:
            data = np.frombuffer(file.read_at(min(BLOCK, last - at), at), np.uint8)
            if not len(data):
                return
            yield at, data
            at += len(data)


def scanned(part: Range) -> list[Effect]:
    """The effect of a range on each state: no backslash, outside and inside; a backslash pending, outside and inside."""
    out = [Effect(odd, inside) for odd in (False, True) for inside in (False, True)]
    for _, data in blocks(part):
        for effect in out:
            effect.then(data)
    return out


def entries(part: Range) -> Iterator[tuple[str, str]]:
    """Key and value, as JSON text, of the entries whose separator lies in the range."""
    state, depth = Effect(part.odd, part.inside), part.depth
    held: list[bytes] | None = None
    for at, data in blocks(part, beyond=True):
        marks, odd = quotes(data, state.odd)
        plain = outside(data, marks, state.inside)
        level = depth + np.cumsum(np.where(plain, _LEVEL[data], 0), dtype=np.int64)
        opens = plain & (level == 1) & (_LEVEL[data] == 1)
        cut = np.flatnonzero(opens | plain & (level == 1) & (data == COMMA) | plain & (level == 0) & (_LEVEL[data] == -1))
        raw, begin = data.tobytes(), 0
        for c in cut.tolist():
            if held is not None:
                yield from _entry(b"".join([*held, raw[begin:c]]))
            if at + c >= part.end:
                return
            held, begin = ([], c + 1) if level[c] == 1 else (None, c + 1)
        if held is not None:
            held.append(raw[begin:])
        elif at + len(data) >= part.end:
            return
        state.odd, state.inside, depth = odd, bool((len(marks) + state.inside) % 2), int(level[-1])


def _entry(raw: bytes) -> Iterator[tuple[str, str]]:
    text = raw.decode("utf-8").strip()
    if text:
        key, end = json.JSONDecoder().raw_decode(text)
        yield str(key), text[end:].lstrip().removeprefix(":").strip()


class JsonMapReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size, self.states = options["path"], int(options.get("range", RANGE)), options.get("states")

    def partitions(self) -> list[Range]:
        return [Range(*x) for x in json.loads(self.states)] if self.states else ranges(self.path, self.size)

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a folder without files
            return
        if not self.states:
            found = [(e.odd, e.inside, e.levels) for e in scanned(part)]
            yield pa.RecordBatch.from_pydict({"path": [part.path], "start": [part.start], "end": [part.end], "effects": [json.dumps(found)]})
            return
        keys, values, size = [], [], 0
        for key, value in entries(part):
            keys.append(key)
            values.append(value)
            size += len(value)
            if size > BLOCK:
                yield pa.RecordBatch.from_pydict({"key": keys, "value": values})
                keys, values, size = [], [], 0
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "value": pa.array(values, pa.string())})


class JsonMap(DataSource):
    """``json_map``: with the option ``states`` the entries, without it the scan."""

    @classmethod
    def name(cls) -> str:
        return "json_map"

    def schema(self) -> str:
        return "key string, value string" if self.options.get("states") else "path string, start long, end long, effects string"

    def reader(self, schema) -> DataSourceReader:
        return JsonMapReader(dict(self.options))


def starts(found: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, bool, bool, int]]:
    """The state at the beginning of each range, from (path, start, end, effects) of all ranges."""
    out, state, of = [], (False, False, 0), None
    for path, start, end, effects in sorted(found):
        if path != of:
            of, state = path, (False, False, 0)
        out.append((path, start, end, *state))
        odd, inside, levels = json.loads(effects)[2 * state[0] + state[1]]
        state = (bool(odd), bool(inside), state[2] + levels)
    return out


def read_map(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """key, value (JSON text) of the entries of a JSON map, or of all maps of a folder. A key that occurs twice is two rows.

    The driver holds a state of some bytes for each range of ``size`` bytes.
    """
    spark.dataSource.register(JsonMap)
    scan = spark.read.format("json_map").option("range", size).load(path)
    states = starts([tuple(r) for r in scan.collect()])
    if not states:
        return spark.createDataFrame([], "key string, value string")
    return spark.read.format("json_map").option("states", json.dumps(states)).load(path)
