"""BPE encoding and decoding with forced boundaries.

A pair of adjacent bytes that occurs inside no vocabulary token can never be merged over, so the text may be cut there
for certain: what stands left and right is encoded independently, and the ids are concatenated. A word's pieces between
such cuts recur far more often than words do. Pieces and words are remembered in bounded tables for each Python worker.

The model is that of a tokenizers file with BPE and an end-of-word suffix: added tokens are taken from the raw text
first; then NFC, white space as one space, lower case; then words by the file's pattern, as UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, in_batches, tidy

VOCABULARY = "word_bpe_49k.json"
#: Entries that a worker's tables of words and of pieces hold before they start anew. A word that is one piece, as most
#: are, stands in the table of words only.
REMEMBERED = 130_000
PIECES = 20_000
#: Longer words and pieces are encoded but not remembered.
LONGEST = 64
#: White space as Unicode has it.
BLANK = r"\t-\r \x85\xa0  -     　"
#: Beyond these letters and marks, Unicode tables of different ages disagree; such texts are normalised and split into
#: words by the library's own tables.
PLAIN = "\x00-ʯ‐-‧₠-₿"
BEYOND = re.compile(f"[^{PLAIN}]").search
#: The pattern of words that has a faster form for plain texts, and the contractions in it.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = "'(?:s|t|re|ve|m|ll|d)"


def _plain_words():
    """``KNOWN`` with its classes spelt out for plain letters, and the likeliest alternative first: no two begin alike."""
    plain = [c for c in map(chr, range(0x20C0)) if not BEYOND(c)]
    kind = lambda k: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == k)
    letters, numbers = kind("L"), kind("N")
    blank = "\\t-\\r \x85\xa0 "
    return re.compile(f"[{letters}]+|[{numbers}]|{CONTRACTIONS}|[^{blank}{letters}{numbers}]+").findall


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    rest = (b for b in range(256) if b not in letters)
    return [c for _, c in sorted((letters | {b: chr(256 + i) for i, b in enumerate(rest)}).items())]


class _Words(dict):
    """What ``word`` gives for each word, remembered while there is room."""

    def __init__(self, word):
        super().__init__()
        self.word = word

    def __missing__(self, key: str) -> tuple[str, int, str]:
        got = self.word(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = got
        return got


class ForcedBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.letters = _byte_letters()
        self.inside: set[tuple[str, str]] = set()
        for token in self.ids:
            units = self.units(token.removesuffix(self.end)) if self.end and token.endswith(self.end) else list(token)
            self.inside.update(zip(units, units[1:]))
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pattern.replace(r"\s", BLANK)).findall
        self.quick = _plain_words() if pattern == KNOWN else self.find
        self.path, self.library = path, None
        self.pieces: dict[tuple[str, ...], tuple[int, ...]] = {}
        self.words = _Words(self.word)

    def units(self, letters: str) -> list[str]:
        """A word's letters, the last one with the end-of-word suffix."""
        return [*letters[:-1], letters[-1] + self.end] if letters else []

    def fragments(self, units: list[str]) -> Iterator[tuple[str, ...]]:
        """A word cut at every pair that no token has inside."""
        start = 0
        for i in range(1, len(units)):
            if (units[i - 1], units[i]) not in self.inside:
                yield tuple(units[start:i])
                start = i
        if units:
            yield tuple(units[start:])

    def merged(self, piece: tuple[str, ...]) -> tuple[int, ...]:
        """Ids of one fragment: the pair of least rank is merged, the leftmost first, until none has a rank."""
        if len(piece) > LONGEST:
            return self.merged_long(piece)
        parts, rank, none = list(piece), self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return tuple(self.ids[p] for p in parts if p in self.ids)

    def merged_long(self, piece: tuple[str, ...]) -> tuple[int, ...]:
        """As ``merged``, with a heap of pairs and links between neighbours: n log n steps for n bytes."""
        parts: list[str] = list(piece)
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        alive = [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (m := after[k]) >= 0 and (r := self.rank.get((parts[k], parts[m]))) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[m]))
        return tuple(self.ids[p] for p, a in zip(parts, alive) if a and p in self.ids)

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word of the normalised text."""
        ids: list[int] = []
        pieces = list(self.fragments(self.units("".join(map(self.letters.__getitem__, word.encode())))))
        if len(pieces) == 1:
            return list(self.merged(pieces[0]))
        for piece in pieces:
            if (got := self.pieces.get(piece)) is None:
                got = self.merged(piece)
                if len(piece) <= LONGEST:
                    if len(self.pieces) >= PIECES:
                        self.pieces.clear()
                    self.pieces[piece] = got
            ids += got
        return ids

    def word(self, word: str) -> tuple[str, int, str]:
        """Of one word: its ids as decimals joined by a space, how many, and its tokens joined by a space."""
        ids = self.word_ids(word)
        return " ".join(map(str, ids)), len(ids), " ".join([self.tokens[i] for i in ids])

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens: NFC, white space as one space, lower case, the file's pattern.

        No word holds white space, so its squeezing needs no step of its own.
        """
        if text.isascii():
            return self.quick(text.lower())
        if not BEYOND(text):
            return self.quick(unicodedata.normalize("NFC", text).lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.byte = {c: b for b, c in enumerate(self.letters)}
        got = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, w)).decode() for w, _ in got]

    def encoded(self, text: str) -> tuple[str, int, str]:
        """As ``word``, of a whole text."""
        got: list[tuple[str, int, str]] = []
        for k, part in enumerate(self.added.split(text) if self.added else [text]):
            if k % 2:
                got.append((str(self.special[part]), 1, part))
            elif part:
                got += map(self.words.__getitem__, self.split(part))
        if not got:
            return "", 0, ""
        ids, counts, tokens = zip(*got)
        if 0 in counts:
            return " ".join(filter(None, ids)), sum(counts), " ".join(filter(None, tokens))
        return " ".join(ids), sum(counts), " ".join(tokens)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, special tokens in it included, none added."""
        return [int(i) for i in self.encoded(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The text of ids as a file without a decoder has it: tokens joined by a space; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(2)
def encoder(path: str | None = None) -> ForcedBpe:
    """The encoder of a vocabulary file, once for each worker."""
    if path is None:
        from public_tokenizers import path as find

        path = find(VOCABULARY)
    return ForcedBpe(path)


def bpe_round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: digests of what encoding and decoding give.

    Null and empty texts have no tokens, and the digests of the empty string. Repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            n, a, b = [], [], []
            for x in batch.column(1):
                ids, count, decoded = bpe.encoded(x.as_py() or "")
                n.append(count)
                a.append(digest(ids))
                b.append(digest(decoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(col(key).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    return in_batches(rows).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, text: str = "text", into: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with a column of token ids (replacing one of that name); null and empty texts have an empty list."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        bpe = encoder(path)
        return texts.map(lambda t: bpe.encode(t or ""))

    return docs.withColumn(into, ids(col(text).cast("string")))


def bpe_decode(rows: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` with the text of their token ids; null ids give an empty text."""

    @F.pandas_udf("string")
    def decoded(lists):
        bpe = encoder(path)
        return lists.map(lambda x: bpe.decode([] if x is None else [int(i) for i in x if i is not None]))

    return rows.withColumn(into, decoded(col(ids)))
