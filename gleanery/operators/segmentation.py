"""Structural and semantic segmentation.

How strongly a text breaks before each word - a blank line, a line end, the end of a sentence - decides its pieces: a word
belongs to the coarsest stretch around it that is short enough. Pieces are found within the text, so that only they become
rows. Stretches of pieces are window functions. Packing is one walk along a document's sorted pieces, from end to end of its
chunks; how far a chunk that begins at a piece reaches, and where the next one begins when a chunk ends there, is searched in
the sums of words, for all pieces of a batch at once. All of it is within documents; a long document is one task's work, as
its chunks are in order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LEXICAL
from ..sources.sinks import materialised
from .chunking import OVERLAP, UNITS, prefix_sums
from .models import Encoder, encode_texts, hash_of
from .retrieval import DIMENSIONS, dot

# What breaks a text between two words, by falling strength - a blank line, a line end, the end of a sentence.
BLANK_LINE = r"\n[ \t]*\n"
LINE_END = "\n"
SENTENCE_MARKS = ".!?;:"
#: Strengths of breaks; WHOLE stands for a stretch that is not broken at all.
NONE, SENTENCE, LINE, BLANK, WHOLE = range(5)


def strength(gap: Column, mark: Column) -> Column:
    """How strongly white space and the character before it break a text."""
    marked = (F.length(mark) > 0) & F.contains(F.lit(SENTENCE_MARKS), mark)
    return F.when(F.regexp_like(gap, F.lit(BLANK_LINE)), BLANK).when(F.contains(gap, F.lit(LINE_END)), LINE).when(marked, SENTENCE).otherwise(NONE)


def by_document(rows: DataFrame) -> DataFrame:
    """Rows dealt out by document once, before they become many; the windows and groups within documents that follow need no other
    exchange. Without a number of partitions, small tables are dealt to few tasks."""
    return rows.repartition("doc_id")


#: White space, as words are parted by it, and characters that end a sentence, among bytes of UTF-8.
_SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_MARKS = np.isin(np.arange(256), np.frombuffer(SENTENCE_MARKS.encode(), np.uint8))
#: Bytes of text whose words are in arrays at once; a longer text stands alone.
SLICE = 1 << 20


def _words(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Of every word of texts that lie one behind the other: its text (doc), bytes (a, b), characters, the byte where the white
    space before it begins, whether it is its text's first, and its strength."""
    space, edges = _SPACES[raw], np.zeros(len(raw) + 1, bool)
    edges[at] = True
    a = np.flatnonzero(~space & (edges[:-1] | np.r_[True, space[:-1]]))
    b = np.flatnonzero(~space & (edges[1:] | np.r_[space[1:], True])) + 1
    doc = np.searchsorted(at, a, "right") - 1
    head = np.r_[True, doc[1:] != doc[:-1]][: len(a)]
    gap = np.where(head, at[doc], np.r_[0, b[:-1]][: len(a)])
    lines = np.flatnonzero(raw == 10)
    other = np.r_[0, np.cumsum(~np.isin(raw, (9, 10, 32)))]
    row = np.searchsorted(at, lines, "right")
    blank = lines[1:][(other[lines[1:]] == other[lines[:-1]]) & (row[1:] == row[:-1])]
    some = lambda places: np.searchsorted(places, a) > np.searchsorted(places, gap)
    marked = ~head & _MARKS[raw[np.maximum(gap - 1, 0)]]
    kind = np.where(some(blank), BLANK, np.where(some(lines), LINE, np.where(marked, SENTENCE, NONE)))
    chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return {"doc": doc, "a": a, "b": b, "gap": gap, "head": head, "strength": kind, "char_start": chars[a] - chars[at[doc]], "char_end": chars[b] - chars[at[doc]]}


def _parts(w: dict[str, np.ndarray], sections: pa.Array) -> np.ndarray:
    """The part of each word: odd ones are sections, even ones what lies behind them, 0 what lies before, -1 a text without sections."""
    n = pc.fill_null(pc.list_value_length(sections), 0).to_numpy(zero_copy_only=False)
    doc, flat, far = np.repeat(np.arange(len(n)), n), sections.flatten(), 1 << 40
    j = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start, end = (pc.fill_null(pc.struct_field(flat, i).cast(pa.int64()), -1).to_numpy(zero_copy_only=False) for i in (0, 1))
    ended = np.maximum.accumulate(doc * far + np.maximum(end, 0)) if len(doc) else doc
    start = np.maximum(start, np.where(j > 0, np.r_[0, ended[:-1]][: len(doc)] - doc * far, 0))
    live = start < end
    key, doc_of, j, end = (doc * far + start)[live], doc[live], j[live], end[live]
    i = np.searchsorted(key, w["doc"] * far + w["char_start"], "right") - 1
    if not len(key):
        part = np.zeros(len(i), np.int64)
    else:
        within = (i >= 0) & (doc_of[i] == w["doc"])
        part = np.where(within, 2 * j[i] + np.where(w["char_start"] < end[i], 1, 2), 0)
    return np.where(n[w["doc"]] > 0, part, -1)


def _begins(head: np.ndarray, strength: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words begin a piece of their range, whose first word is a ``head``, and the level of each word.

    A word belongs to the coarsest stretch around it that has at most ``size`` words: its whole range, a paragraph, a line, a
    sentence; in a longer sentence pieces are runs of ``size`` words.
    """
    level, nth = np.full(len(head), NONE), np.arange(len(head))
    begins = head.copy()
    for kind in (SENTENCE, LINE, BLANK, WHOLE):  # coarser ones take precedence
        opens = head | (strength >= kind)
        first = np.flatnonzero(opens)
        stretch = np.cumsum(opens) - 1
        fits = np.diff(np.r_[first, len(head)])[stretch] <= size
        if kind == SENTENCE:
            begins |= (nth - first[stretch]) % size == 0
        level[fits], begins[fits] = kind, opens[fits]
    return begins, level


def _cosines(tokens_: list[list[int]], head: np.ndarray) -> np.ndarray:
    """The cosine of hashed terms of each piece, with its neighbours, and the piece before it, likewise; nan where there is none."""
    n = np.array([len(t) for t in tokens_])
    flat = np.repeat(np.arange(len(n)), n) * DIMENSIONS + np.fromiter((x for t in tokens_ for x in t), np.int64, int(n.sum()))
    own = np.bincount(flat, minlength=len(n) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.float64)
    around = own.copy()
    around[1:] += np.where(head[1:, None], 0, own[:-1])
    around[:-1] += np.where(head[1:, None], 0, own[1:])
    norm = np.sqrt((around * around).sum(1, keepdims=True))
    x = around / np.where(norm > 0, norm, 1)
    return np.r_[np.nan, np.where(head[1:], np.nan, (x[1:] * x[:-1]).sum(1))]


def pieces(docs: DataFrame, size: int, sections: str | None = None, cosines: bool = False) -> DataFrame:
    """doc_id, part, held (words of the part), k, n (pieces of the part), units, char_start, char_end, level, and of the first word of
    a part gap (the white space before it) and before (the word before that): the pieces of each part, in order; ``cosine``, where
    asked for.

    A text is cut where it is, so that no table of words is needed: a task works on the arrays of a slice of its texts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ints = ("part", "held", "k", "n", "units", "char_start", "char_end", "level")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        _, offsets, data = text.buffers()
        at = np.frombuffer(offsets, np.int64, len(text) + 1, text.offset * 8)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        w = _words(raw, at - at[0])
        part = np.full(len(w["a"]), -1) if sections is None else _parts(w, batch.column("sections"))
        head = w["head"] | np.r_[True, part[1:] != part[:-1]][: len(part)]
        begins, level = _begins(head, w["strength"], size)
        first = np.flatnonzero(begins)
        last = np.r_[first[1:], len(head)][: len(first)] - 1
        opens = np.flatnonzero(head[first])  # pieces that are the first of their part
        nth, n = np.cumsum(head[first]) - 1, np.diff(np.r_[opens, len(first)])
        held = np.diff(np.r_[first[opens], len(head)])
        out = {"part": part[first], "held": held[nth], "k": np.arange(len(first)) - opens[nth], "n": n[nth], "units": last - first + 1, "char_start": w["char_start"][first], "char_end": w["char_end"][last], "level": level[first]}
        whole = raw.tobytes()
        ahead = [(w["gap"][i], w["a"][i], w["a"][i] if w["head"][i] else w["a"][i - 1]) if out["k"][p] == 0 and part[i] > 0 else (0, 0, 0) for p, i in enumerate(first)] if sections else [(0, 0, 0)] * len(first)
        cols = [batch.column("doc_id").take(pa.array(w["doc"][first])), *[pa.array(out[c], pa.int32()) for c in ints]]
        cols += [pa.array([whole[g:a].decode() for g, a, _ in ahead], pa.string()), pa.array([whole[b:g].decode() for g, _, b in ahead], pa.string())]
        if cosines:
            said = [[hash_of(t) % DIMENSIONS for t in re.findall(LEXICAL, whole[a:b].decode().lower())] for a, b in zip(w["a"][first].tolist(), w["b"][last].tolist())]
            cols.append(pa.array(_cosines(said, head[first]) if said else [], pa.float64(), from_pandas=True))
        return pa.RecordBatch.from_arrays(cols, ["doc_id", *ints, "gap", "before", *["cosine"] * cosines])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, i = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)), 0
            while i < len(ends):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE, "right")))
                yield cut(batch.slice(i, j - i))
                i = j

    rows = by_document(docs.select("doc_id", "text", *[F.col(c).alias("sections") for c in [sections] if c]))
    return rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} int' for c in ints)}, gap string, before string{', cosine double' * cosines}")


def _walk(table: pa.Table, by: list[str], size: int, tail: int) -> pa.Table:
    """Chunks of the pieces of whole groups, in their order; a group begins with its piece 0."""
    k, units = (np.asarray(table.column(c), np.int64) for c in ("k", "units"))
    heads = np.flatnonzero(k == 0)
    n = np.diff(np.r_[heads, len(k)])
    g = np.repeat(np.arange(len(n)), n + 1)  # a place for each piece, and one behind the last of each group
    place = np.arange(len(g))
    first, behind = heads + np.arange(len(n)), heads + np.arange(len(n)) + n
    inner = np.ones(len(g), bool)
    inner[behind] = False
    total = np.zeros(len(g), np.int64)
    total[1:][inner[:-1]] = np.cumsum(units)
    total[behind] = np.cumsum(units)[heads + n - 1]
    total -= np.repeat(np.r_[0, np.cumsum(units)][heads], n + 1)
    total[first] = 0
    stops = ~inner
    stops[inner] = np.asarray(table.column("stops"), bool)
    key = total + g * (int(total.max(initial=0)) + size + tail + 1)
    full, kept, room = np.searchsorted(key, key + size, "right") - 1, np.searchsorted(key, key - tail), np.searchsorted(key, key - size)
    begin = np.where(stops, place, np.minimum(place, np.maximum(kept, np.r_[room[1:], len(g)])))
    begin[first] = first
    held = np.flatnonzero(stops)
    stop = np.r_[held, len(g)][np.searchsorted(held, place, "right")]
    end = np.minimum(np.maximum(full[begin], place + 1), stop)
    # From piece to piece: only where the last chunk ended does the next one begin.
    out, at, ends, last = [], 0, end.tolist(), (~inner).tolist()
    while at < len(ends):
        if last[at]:
            at += 1
        else:
            out.append(at)
            at = ends[at]
    at = np.array(out, np.int64)
    a, b, of = begin[at], end[at], g[at]
    c = np.arange(len(at)) - np.searchsorted(of, of)
    pieces_ = table.select(by).take(pa.array(a - of))
    ints = {"c": pa.array(c, pa.int32()), "units": pa.array(total[b] - total[a], pa.int64()), "char_start": table.column("char_start").take(pa.array(a - of)), "char_end": table.column("char_end").take(pa.array(b - 1 - of))}
    return pa.table({**{x: pieces_.column(x) for x in by}, **ints})


def packed(rows: DataFrame, by: list[str], size: int, tail: int, forced: str | None = None) -> DataFrame:
    """by, c, units, char_start, char_end: chunks of neighbouring pieces (by, k from 0, units, char_start, char_end) of up to ``size``
    words, in order.

    A piece opens the next chunk when it does not fit, or where ``forced`` says so. Then the chunk also repeats the last
    pieces before it that have at most ``tail`` words and leave room for it; a forced one repeats none. Pieces are dealt out
    by document and sorted; a task walks along them in batches and holds one group that is not complete.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    stops = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    rows = by_document(rows.select(*by, "k", "units", "char_start", "char_end", stops.alias("stops"))).sortWithinPartitions(*by, "k")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # frames of whole numbers have no nulls
    schema = pa.schema([*[(c, pa.string() if c == "doc_id" else pa.int64()) for c in [*by, "k", "units", "char_start", "char_end"]], ("stops", pa.bool_())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pa.RecordBatch] = []
        for frame in frames:
            batch = pa.RecordBatch.from_pandas(frame, schema, preserve_index=False)
            heads = np.flatnonzero(frame["k"].to_numpy() == 0)
            if len(heads) and (held or heads[-1]):
                last = int(heads[-1])
                yield _walk(pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks(), by, size, tail).to_pandas()
                batch, held = batch.slice(last), []
            held.append(batch)
        if sum(map(len, held)):
            yield _walk(pa.Table.from_batches(held).combine_chunks(), by, size, tail).to_pandas()

    out = rows.mapInPandas(run, f"{', '.join(f'{c} string' if c == 'doc_id' else f'{c} {kinds[c]}' for c in by)}, c int, units bigint, char_start {kinds['char_start']}, char_end {kinds['char_end']}")
    return out.withColumn("doc_id", F.col("doc_id").cast(kinds["doc_id"]))


def _in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """Chunks numbered in their order, repeated ones once."""
    once = rows.groupBy("doc_id", "char_start", "char_end").agg(F.min(F.struct(*order)).alias("_o"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("_o")) - 1
    return once.select("doc_id", nth.alias("chunk_no"), "char_start", "char_end")


def line_sections(text: Column) -> Column:
    """The lines of a text as sections."""
    lengths = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0)), F.length)
    none = F.array().cast("array<struct<start:int,end:int>>")
    span = lambda upto: lambda i: F.struct(upto(i).alias("start"), upto(i + 1).alias("end"))
    return F.when(F.size(lengths) > 0, prefix_sums(lengths, lambda upto: F.transform(F.sequence(F.lit(0), F.size(lengths) - 1), span(upto)))).otherwise(none)


def structural(docs: DataFrame, size: int = UNITS, overlap: float = OVERLAP, sections: str | None = None) -> DataFrame:
    """doc_id, chunk_no, char_start, char_end: chunks along sections, paragraphs, lines and sentences; overlap only within a section
    that had to be split.

    ``sections`` names a column of character ranges (start, end) in order; one begins no earlier than those before it end.
    What lies between them is cut into pieces too. A section that fits is one piece. One that does not is cut into chunks
    of its own, each of which begins a chunk, and so does a piece that stands right behind it. Documents without words
    have no chunks, null sections are none.
    """
    tail, by = round(size * overlap), ["doc_id", "part"]
    if sections is None:
        return _in_order(packed(pieces(docs, size), ["doc_id"], size, tail), ["c"])
    parts = materialised(pieces(docs, size, sections))
    split = (F.col("part") % 2 == 1) & (F.col("held") > size)
    plain = _in_order(packed(parts.where("part < 0"), ["doc_id"], size, tail), ["c"])
    parts = parts.where("part >= 0")
    cut = packed(parts.where(split), by, size, tail).select(*by, F.col("c").alias("k"), "units", "char_start", "char_end", F.lit(True).alias("forced"))
    # Where the last section that was split ends, before each section and up to it.
    order = Window.partitionBy("doc_id").orderBy("j")
    long = parts.where(split & (F.col("k") == 0)).select("doc_id", ((F.col("part") - 1) / 2).cast("int").alias("j"), F.lit(True).alias("long"))
    spans = by_document(docs.join(long.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col(sections).alias("sections")))
    spans = spans.select("doc_id", F.posexplode("sections").alias("j", "s")).select("doc_id", "j", F.col("s.start").alias("a"), F.col("s.end").alias("b"))
    ended = F.coalesce(F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("doc_id", "j", F.greatest("a", ended).alias("a"), "b", F.max("b").over(order).alias("at"))
    known = spans.join(long, ["doc_id", "j"], "left")
    behind = F.last(F.when(F.col("long"), F.col("b")), ignorenulls=True)
    known = known.select("doc_id", "j", "a", "at", behind.over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before_"), behind.over(order).alias("upto"))
    ends = known.select("doc_id", (2 * F.col("j") + 1).alias("part"), F.col("a").alias("from"), F.col("before_").alias("behind")).unionByName(known.select("doc_id", (2 * F.col("j") + 2).alias("part"), F.col("at").alias("from"), F.col("upto").alias("behind")))
    free = parts.where(~split).join(ends.where("behind is not null"), by, "left")
    # White space between that end and the first word, and whether it breaks the text where the piece's own level would.
    gap = F.right("gap", F.least(F.length("gap"), F.col("char_start") - F.col("from")))
    mark = F.substr(F.concat("before", "gap"), F.length("before") + F.length("gap") - (F.col("char_start") - F.col("from")), F.lit(1))
    opens = (F.col("level") == WHOLE) | (F.col("char_start") <= F.col("from")) | (strength(gap, F.coalesce(mark, F.lit(""))) < F.col("level"))
    forced = (F.col("k") == 0) & F.col("from").isNotNull() & (F.col("from") == F.col("behind")) & ((F.col("part") % 2 == 1) | opens)
    free = free.select(*by, "k", "units", "char_start", "char_end", F.coalesce(forced, F.lit(False)).alias("forced"))
    nth = (F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "k")) - 1).alias("k")
    every = free.unionByName(cut).select("doc_id", nth, "units", "char_start", "char_end", "forced")
    return plain.unionByName(_in_order(packed(every, ["doc_id"], size, 0, "forced"), ["c"]))


def distances(rows: DataFrame, docs: DataFrame, load: Callable[[], Encoder]) -> DataFrame:
    """``rows`` with ``cosine`` of each piece, with its neighbours, and the piece before it, likewise.

    ``load`` makes a batch encoder: pieces of all documents go to it together, in batches, longest first.
    """
    w = Window.partitionBy("doc_id").orderBy("k")
    around = rows.select("doc_id", "k", F.coalesce(F.lag("char_start").over(w), "char_start").alias("a"), F.coalesce(F.lead("char_end").over(w), "char_end").alias("b"))
    texts = around.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "k", F.expr("substring(text, a + 1, b - a)").alias("text"))
    v = materialised(encode_texts(texts, ["doc_id", "k"], "text", load))
    ahead = v.select("doc_id", (F.col("k") + 1).alias("k"), F.col("vector").alias("before"))
    return rows.join(v.join(ahead, ["doc_id", "k"]).select("doc_id", "k", dot(F.col("vector"), F.col("before")).alias("cosine")), ["doc_id", "k"], "left")


def semantic(docs: DataFrame, load: Callable[[], Encoder] | None = None, size: int = UNITS, overlap: float = OVERLAP, percentile: float = 0.95, least: int = 16, piece: int = 64) -> DataFrame:
    """doc_id, chunk_no, char_start, char_end: chunks cut where neighbouring sentences, each encoded with its neighbours, are further
    apart than ``percentile`` of their document's.

    A stretch of fewer than ``least`` words stays with the one before it; one of more than ``size`` is cut by structure.
    Documents of one or two pieces are packed.
    """
    tail, by = round(size * overlap), ["doc_id", "part"]
    rows = materialised(pieces(docs, piece, cosines=load is None))
    few = packed(rows.where("n <= 2"), ["doc_id"], size, tail).select("doc_id", "char_start", "char_end")
    many = by_document(rows.where("n > 2"))
    many = many if load is None else distances(many, docs, load)
    # The first piece has none before it, and percentiles leave nulls out.
    many = many.withColumn("apart", F.when(F.col("k") > 0, F.round(1 - F.coalesce("cosine", F.lit(0.0)), 9)))
    limit = F.round(F.percentile("apart", F.lit(percentile)).over(Window.partitionBy("doc_id")), 9)
    w = Window.partitionBy("doc_id").orderBy("k")
    opens = many.withColumn("opens", F.col("apart") > limit)
    group = F.sum(F.coalesce(F.col("opens"), F.lit(False)).cast("int")).over(w)
    stretches = opens.withColumn("g", group).groupBy("doc_id", "g").agg(F.sum("units").alias("units"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
    heads = F.sum(((F.col("units") >= least) | (F.col("g") == 0)).cast("int")).over(Window.partitionBy("doc_id").orderBy("g"))
    parts = stretches.withColumn("part", heads).groupBy(*by).agg(F.sum("units").alias("held"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
    parts = materialised(parts)
    short = parts.where(F.col("held") <= size).select("doc_id", "char_start", "char_end")
    ranges = parts.where(F.col("held") > size).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("char_start").alias("start"), F.col("char_end").alias("end")))).alias("sections"))
    again = pieces(docs.select("doc_id", "text").join(ranges, "doc_id"), size, "sections").where("part % 2 = 1")
    long = packed(again, by, size, tail).select("doc_id", "char_start", "char_end")
    return _in_order(few.unionByName(short).unionByName(long), ["char_start"])
