"""The model boundary: batch encoders of texts and of tokens, and what is done with their vectors.

An encoder is made by a function that a worker calls once; it takes a list of texts and gives one vector each. Stand-ins
without a model are DataFrame functions over hashed tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind
from .retrieval import encoded

#: Components of the stand-in for an encoder of long contexts.
LONG_DIMENSIONS = 128

Encoder = Callable[[list[str]], np.ndarray]
#: For each text, where its tokens start and end, and one vector for each token.
TokenEncoder = Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]]

#: What ``token_spans`` takes for a token, too.
TOKEN = re.compile("[A-Za-z0-9_./+-]+")


@lru_cache(1 << 17)
def hash_of(token: str) -> int:
    """What ``hashed`` gives for a token."""
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16)


_loaded: dict[object, object] = {}


def once(load: Callable[[], object]) -> object:
    """What ``load`` makes, made once in each worker process."""
    if load not in _loaded:
        _loaded[load] = load()
    return _loaded[load]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(size > 0, size, 1)


def encode_texts(rows: DataFrame, key: list[str], text: str, load: Callable[[], Encoder], prefix: str = "") -> DataFrame:
    """key and vector (unit length, 32 bits) of each row. Within a batch texts are encoded longest first, as batches of a model
    are padded to their longest, and put back in order. Null counts as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = once(load)
        for pdf in frames:
            texts = [prefix + (t or "") for t in pdf[text]]
            order = np.argsort([-len(t) for t in texts], kind="stable")
            made = unit(np.asarray(encode([texts[i] for i in order]), np.float64))
            vectors = np.empty_like(made)
            vectors[order] = made
            yield pdf[key].assign(vector=list(vectors.astype(np.float32)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema.fields)
    return rows.select(*key, text).mapInPandas(run, f"{schema}, vector array<float>")


def relevancy(answers: DataFrame, key: list[str]) -> DataFrame:
    """key and relevancy, the cosine of hashed vectors of question and answer; null where the answer is blank or abstains.

    Rows: key, question, answer, abstained.
    """
    live = answers.where(~F.col("abstained") & (F.trim(F.coalesce("answer", F.lit(""))) != ""))
    q = encoded(live, key, "question").withColumnRenamed("x", "q")
    a = encoded(live, key, "answer").withColumnRenamed("x", "a")
    got = q.join(a, [*key, "dim"]).groupBy(*key).agg(F.sum(F.col("q") * F.col("a")).alias("cosine"))
    kept = live.select(*key).withColumn("_live", F.lit(True))
    out = answers.select(*key).join(kept, key, "left").join(got, key, "left")
    return out.select(*key, F.when(F.col("_live"), F.coalesce("cosine", F.lit(0.0))).alias("relevancy"))


def token_vectors(docs: DataFrame, load: Callable[[], TokenEncoder]) -> DataFrame:
    """doc_id, token_no, char_start, char_end, vector of every token that an encoder gives for whole documents, in batches of texts.
    Tokens without characters are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = once(load)
        for pdf in frames:
            made = encode([t or "" for t in pdf["text"]])
            for doc, (at, v) in zip(pdf["doc_id"], made):
                at = np.asarray(at, np.int64).reshape(-1, 2)
                live = np.flatnonzero(at[:, 1] > at[:, 0])
                if len(live):
                    yield pd.DataFrame({"doc_id": doc, "token_no": live, "char_start": at[live, 0], "char_end": at[live, 1], "vector": list(np.asarray(v, np.float64)[live])})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, token_no int, char_start int, char_end int, vector array<double>")


def token_spans(docs: DataFrame, token: str = "[A-Za-z0-9_./+-]+") -> DataFrame:
    """doc_id, token_no, char_start, char_end, token of what a character class matches in each text."""
    inner = token.removeprefix("[").removesuffix("]+")
    dealt = docs.select("doc_id", "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    parts = dealt.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"[{inner}]+|[^{inner}]+"), F.lit(0))).alias("token_no", "token"))
    end = F.sum(F.length("token")).over(Window.partitionBy("doc_id").orderBy("token_no")).cast("int")
    return parts.withColumn("char_end", end).where(F.regexp_like("token", F.lit(f"^[{inner}]"))).select("doc_id", "token_no", (F.col("char_end") - F.length("token")).alias("char_start"), "char_end", "token")


def overlapping(tokens_: DataFrame, chunks: DataFrame, width: int = 1024) -> DataFrame:
    """Tokens with the ``chunk_no`` of each chunk of their document that they overlap: an equi-join on bins of ``width`` characters.

    A pair that shares several bins is kept in the first one that both have.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(F.greatest(a, b - 1) / width)))
    left = tokens_.withColumn("bin", bins(F.col("char_start"), F.col("char_end")))
    right = chunks.select("doc_id", "chunk_no", F.col("char_start").alias("_a"), F.col("char_end").alias("_b"), bins(F.col("char_start"), F.col("char_end")).alias("bin"))
    both = left.join(right, ["doc_id", "bin"]).where((F.col("char_start") < F.col("_b")) & (F.col("char_end") > F.col("_a")))
    first = F.greatest(F.floor(F.col("char_start") / width), F.floor(F.col("_a") / width))
    return both.where(F.col("bin") == first).drop("bin", "_a", "_b")


def _unit(v: Column) -> Column:
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return bind(size, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x).cast("float")))


def _mean(vectors: Column) -> Column:
    """The mean of an array of vectors."""
    add = F.aggregate(F.slice(vectors, F.lit(2), F.size(vectors)), vectors[0], lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(add, lambda x: x / F.size(vectors))


def late_chunk_embeddings(chunks: DataFrame, docs: DataFrame, load: Callable[[], TokenEncoder]) -> DataFrame:
    """doc_id, chunk_no, vector, beyond: each document is encoded whole and once; a chunk's vector is the mean of the vectors of
    the tokens that overlap it, at unit length. A chunk beyond what the encoder reached gets the mean of all its document's
    tokens, and null where there is none.

    Tokens meet chunks as intervals. A chunk's tokens, which its size bounds, are added in their order; the means of whole
    documents are made by component, and only for documents that need one.
    """
    from ..sources.sinks import materialised

    vectors = materialised(token_vectors(docs.join(chunks.select("doc_id").distinct(), "doc_id", "left_semi"), load))
    pooled = overlapping(vectors, chunks).groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("token_no", "vector"))).alias("t"))
    pooled = pooled.select("doc_id", "chunk_no", _mean(F.col("t.vector")).alias("own"))
    rows = chunks.select("doc_id", "chunk_no").join(pooled, ["doc_id", "chunk_no"], "left")
    needs = rows.where("own is null").select("doc_id").distinct()
    parts = vectors.join(needs, "doc_id", "left_semi").select("doc_id", F.posexplode("vector").alias("at", "x")).groupBy("doc_id", "at").agg(F.avg("x").alias("x"))
    whole = parts.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("whole"))
    return rows.join(whole, "doc_id", "left").select("doc_id", "chunk_no", _unit(F.coalesce("own", "whole")).alias("vector"), F.isnull("own").alias("beyond"))


def late_vectors(chunks: DataFrame, docs: DataFrame, weight: float = 0.5, dimensions: int = LONG_DIMENSIONS) -> DataFrame:
    """doc_id, chunk_no, dim, x: the stand-in for late chunking, in one pass over texts that have met their chunks.

    A token's vector is its hashed dimension plus ``weight`` times the mean over its document; a chunk's is the mean over the
    tokens that overlap it, at unit length. Chunks without a token get the document's mean. Tokens are in order, so those
    that overlap a chunk are a run of them.
    """
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    held = chunks.groupBy("doc_id").agg(F.collect_list(F.struct("chunk_no", "char_start", "char_end")).alias("c"))
    rows = held.join(docs.where("text is not null").select("doc_id", "text"), "doc_id").repartition("doc_id")

    def vectors(text: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        spans = [(m.start(), m.end(), hash_of(m.group().lower()) % dimensions) for m in TOKEN.finditer(text)]
        if not spans:
            return np.zeros((len(a), dimensions))
        start, end, dim = np.array(spans, np.int64).T
        i, j = np.searchsorted(end, a, "right"), np.searchsorted(start, b)
        own = np.stack([np.bincount(dim[x:y], minlength=dimensions) / max(1, y - x) for x, y in zip(i.tolist(), j.tolist())])
        x = own + np.bincount(dim, minlength=dimensions) / len(dim) * weight
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                spans = batch.column("c")[row].values
                at = {c: spans.field(c) for c in ("chunk_no", "char_start", "char_end")}
                x = vectors(batch.column("text")[row].as_py(), np.asarray(at["char_start"], np.int64), np.asarray(at["char_end"], np.int64))
                chunk, dim = np.nonzero(x)
                if len(chunk):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.full(len(chunk), row))), at["chunk_no"].take(pa.array(chunk)), pa.array(dim, pa.int64()), pa.array(x[chunk, dim])], ["doc_id", "chunk_no", "dim", "x"])

    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, chunk_no {kinds['chunk_no']}, dim bigint, x double")


def query_text(query: Column, prefix: str = "Represent this sentence for searching relevant passages: ") -> Column:
    """A query as asymmetric encoders want it (the prefix is a fixed value)."""
    return F.concat(F.lit(prefix), query)
