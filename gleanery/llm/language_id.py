"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector binds its letters' vectors,
each permuted by its place (rotated by one more for each letter that follows): their element-wise product. A text's
profile bundles, that is adds, the vectors of all its n-grams; a language's prototype bundles those of its training
texts. A text has the language whose prototype has the largest cosine with its profile.

Letters are those of the lower-cased text; any run of other characters is one boundary, which has a vector too.
Prototypes are added up in tasks and by position, so that the driver sees one vector for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, in_batches, tidy

DIMENSIONS = 1024
GRAM = 3
#: N-gram vectors that a worker remembers.
REMEMBERED = 1 << 16
#: The language of texts without letters.
NONE = "und"


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a row is in the fold that nothing is learnt from; a null key counts as the empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Profiles:
    """N-gram vectors and profiles of texts."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = 7):
        self.dimensions, self.gram, self.seed = dimensions, gram, seed
        self.letters: dict[int, np.ndarray] = {}
        self.grams = np.zeros(0, np.uint64)
        self.rows = np.zeros((0, dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if (v := self.letters.get(code)) is None:
            rng = np.random.Generator(np.random.Philox(key=[self.seed, code]))
            v = self.letters[code] = rng.integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return v

    def bound(self, gram: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for place in range(self.gram):
            out = out * np.roll(self.letter(gram >> 21 * place & 0x1FFFFF), place)
        return out

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of a text as packed code points, and how often each occurs; none without letters."""
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[code]
        if not letter.any():
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        run = np.zeros(int(keep.sum()) + self.gram, np.uint64)
        run[self.gram - 1 : -1] = np.where(letter, code, 0)[keep]
        packed = np.zeros(len(run) - self.gram + 1, np.uint64)
        for k in range(self.gram):
            packed |= run[k : k + len(packed)] << np.uint64(21 * (self.gram - 1 - k))
        return np.unique(packed, return_counts=True)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of sorted distinct n-grams, one a row."""
        at = np.searchsorted(self.grams, grams)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == grams[known]
        if known.all():
            return self.rows[at]
        fresh = np.stack([self.bound(int(g)) for g in grams[~known]])
        if len(self.grams) + len(fresh) <= REMEMBERED:
            every = np.concatenate([self.grams, grams[~known]])
            order = np.argsort(every)
            self.grams, self.rows = every[order], np.concatenate([self.rows, fresh])[order]
            return self.rows[np.searchsorted(self.grams, grams)]
        out = np.empty((len(grams), self.dimensions), np.int8)
        out[known], out[~known] = self.rows[at[known]], fresh
        return out

    def profile(self, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The bundle of n-grams that occur n times."""
        out = np.zeros(self.dimensions)
        for lo in range(0, len(grams), 4096):
            out += n[lo : lo + 4096].astype(np.float32) @ self.vectors(grams[lo : lo + 4096]).astype(np.float32)
        return out


@lru_cache(1)
def _profiles(dimensions: int, gram: int, seed: int) -> Profiles:
    return Profiles(dimensions, gram, seed)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = 7) -> dict[str, np.ndarray]:
    """The prototype of each language of ``docs``; rows without text, letters or language teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = _profiles(dimensions, gram, seed), {}
        for batch in batches:
            held: dict[str, list] = {}
            for t, name in zip(batch.column(0), batch.column(1)):
                grams, n = profiles.counts(t.as_py())
                if len(grams):
                    held.setdefault(name.as_py(), []).append((grams, n))
                if len(held.get(name.as_py(), ())) >= 200:
                    _bundle(profiles, sums, name.as_py(), held.pop(name.as_py()))
            for name, parts in held.items():
                _bundle(profiles, sums, name, parts)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.round().astype(np.int64).tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    rows = docs.select(col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    parts = in_batches(rows).mapInArrow(tidy(run), "lang string, v array<long>").select("lang", F.posexplode("v").alias("at", "x"))
    sums = parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    return {r["lang"]: np.array([x["x"] for x in r["v"]], float) for r in sums.collect()}


def _bundle(profiles: Profiles, sums: dict[str, np.ndarray], name: str, parts: list) -> None:
    grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    n = np.bincount(inverse, np.concatenate([n for _, n in parts]).astype(float))
    sums[name] = sums.get(name, 0) + profiles.profile(grams, n)


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", key: str = "doc_id", dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = 7) -> DataFrame:
    """doc_id, lang_pred and score of each row: the nearest prototype and its cosine, at least 0.

    ``und`` and 0.0 where text is null or has no letters, and where there is no prototype. Ties go to the language that
    comes first by code point.
    """
    names = sorted(prototypes)
    unit = np.stack([prototypes[n] / max(1e-12, float(np.linalg.norm(prototypes[n]))) for n in names], 1) if names else np.zeros((dimensions, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = _profiles(dimensions, gram, seed)
        for batch in batches:
            best, score = [], []
            for t in batch.column(1):
                grams, n = profiles.counts(t.as_py() or "")
                if not len(grams) or not names:
                    best.append(NONE)
                    score.append(0.0)
                    continue
                v = profiles.profile(grams, n)
                cosines = v @ unit / max(1e-12, float(np.linalg.norm(v)))
                k = int(cosines.argmax())
                best.append(names[k])
                score.append(min(1.0, max(0.0, float(cosines[k]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(col(key).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    return in_batches(rows).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def identify_languages(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score: prototypes learnt from rows that are not held out, applied to all.

    Repeated rows are predicted alike. An empty table gives no rows.
    """
    prototypes = learn(docs.where(~held_out(col(key))), text, lang)
    out = predict(docs, prototypes, text, key)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
