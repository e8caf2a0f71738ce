"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, edge marks and phrases that decide the metrics' results.
STOP_WORDS = (
    "a an and are as at be by for from has have in is it its of on or that the to was were will with this these those there their "
    "they you your we our not no can could should would may might do does did been being if then than when where which who whom "
    "what how why all any some such only own same so too very s t just don now"
).split()
EDGE_MARKS = "./-+_"
ABSTENTION_MARK = "insufficient evidence"
ABSTENTION_PHRASES = ("insufficient evidence", "not contain", "does not provide", "cannot answer", "no information", "unable to answer")
LEXICAL = r"[a-z0-9_./+-]+"
SENTENCE_END = r"(?<=[.!?])\s+|\n+"
EVIDENCE_BLOCK = r"(?ims)^[ \t]*\**evidence\**[ \t]*:.*\z"
CITATION = r"\[?\b[A-Za-z0-9]+::chunk_\d+\b\]?"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is evaluated once however often ``f`` uses it, inside other lambdas too."""
    return F.transform(F.array(value), f)[0]


def bare(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokens(text: Column) -> Column:
    """Lexical tokens of the lower-cased text."""
    return _all(F.lower(F.coalesce(text, F.lit(""))), LEXICAL)


def content_tokens(text: Column) -> Column:
    """Tokens without marks at their edges, longer than one character, and no stop words."""
    stop = F.array(*map(F.lit, sorted(set(STOP_WORDS))))
    bare = F.transform(tokens(text), lambda t: F.btrim(t, F.lit(EDGE_MARKS)))
    return F.filter(bare, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def words(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return _all(F.coalesce(text, F.lit("")), r"\S+")


def sentences(text: Column) -> Column:
    """Sentences with more than white space in them."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda s: F.trim(F.regexp_replace(s, r"\s", " ")) != "")


def is_abstention(answer: Column) -> Column:
    """Whether an answer declines: empty, or the mark or a phrase near its beginning."""
    a = F.lower(bare(F.coalesce(answer, F.lit(""))))
    said = F.contains(F.substring(a, 1, len(ABSTENTION_MARK) + 40), F.lit(ABSTENTION_MARK))
    for phrase in ABSTENTION_PHRASES:
        said = said | F.contains(F.substring(a, 1, 90), F.lit(phrase))
    return (a == "") | said


def answer_body(answer: Column) -> Column:
    """An answer without its evidence block and citations, white space squeezed."""
    a = F.regexp_replace(F.coalesce(answer, F.lit("")), EVIDENCE_BLOCK, "")
    return bare(F.regexp_replace(F.regexp_replace(a, CITATION, ""), r"\s{2,}", " "))


def cited_segments(answer: Column) -> Column:
    """Distinct cited segments, and a citation that the end of the answer cuts off."""
    a = F.coalesce(answer, F.lit(""))
    whole = F.array_distinct(_all(a, r"[A-Za-z0-9]+::chunk_\d+"))
    cut = F.regexp_extract(a, r"\[([A-Za-z]+[0-9A-Za-z]*)\s*\z", 1)
    return F.when(F.length(cut) > 3, F.array_union(whole, F.array(F.concat(cut, F.lit("::truncated"))))).otherwise(whole)


def citation_count(answer: Column) -> Column:
    """How many distinct segments are cited in full."""
    return F.size(F.array_distinct(F.transform(_all(F.coalesce(answer, F.lit("")), CITATION), lambda c: F.btrim(c, F.lit("[]")))))


def prompt_segments(prompt: Column) -> Column:
    """Segment ids in the headers of a prompt, joined by a bar."""
    return F.array_join(_all(F.coalesce(prompt, F.lit("")), r"(?m)^\[([^\]]+::chunk_\d+)\]", 1), "|")


def syllables(word: Column) -> Column:
    """Vowel groups, a final e not counted beside others; at least 1 if there is a letter a-z, else 0."""

    def count(w: Column) -> Column:
        return bind(F.size(_all(w, "[aeiouy]+")), lambda n: F.when(w == "", 0).otherwise(F.greatest(F.lit(1), n - (w.endswith("e") & (n > 1)).cast("int"))))

    return bind(F.regexp_replace(F.lower(word), "[^a-z]", ""), count)


def technical(word: Column) -> Column:
    """Whether a word has a digit, an inner capital, a slash, an underscore, or a point inside."""
    return word.rlike("[0-9]|[a-z][A-Z]|/|_") | F.contains(F.btrim(word, F.lit(".")), F.lit("."))


def readability(text: Column) -> Column:
    """Struct of reading ease, grade, fog, share of technical terms (null without words) and number of characters.

    Words are found once and each is looked at once.
    """

    def measures(v: Column) -> Column:
        n_w, n_s = v["n_w"].cast("double"), v["n_s"].cast("double")
        some = (v["n_w"] > 0) & (v["n_s"] > 0)
        per = lambda x: F.when(some, x)
        return F.struct(
            per(206.835 - 1.015 * n_w / n_s - 84.6 * v["all"] / n_w).alias("reading_ease"), per(0.39 * n_w / n_s + 11.8 * v["all"] / n_w - 15.59).alias("grade"),
            per(0.4 * (n_w / n_s + 100 * v["hard"] / n_w)).alias("fog"), per(v["odd"] / n_w).alias("technical_share"), v["chars"].alias("chars"),
        )

    def counts(w: Column) -> Column:
        start = F.struct(F.lit(0).alias("all"), F.lit(0).alias("hard"), F.lit(0).alias("odd"))
        step = lambda a, t: bind(syllables(t), lambda n: F.struct((a["all"] + n).alias("all"), (a["hard"] + (n >= 3).cast("int")).alias("hard"), (a["odd"] + technical(t).cast("int")).alias("odd")))
        sums = F.aggregate(w, start, step)
        return bind(sums, lambda a: F.struct(F.size(w).alias("n_w"), F.size(sentences(text)).alias("n_s"), a["all"].alias("all"), a["hard"].alias("hard"), a["odd"].alias("odd"), F.length(F.coalesce(text, F.lit(""))).alias("chars")))

    return bind(bind(words(text), counts), measures)
