"""Answer metrics: support by the context, agreement with a gold text, abstention; prompts, batches and generation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_body, bind, citation_count, content_tokens, is_abstention, readability, sentences, tokens

SUPPORTED = 0.6
#: What a prompt says when nothing can be answered, and its fixed parts (fixed values).
ABSTAIN = "INSUFFICIENT EVIDENCE"
PROMPT_WORDS, LEAST_WORDS, SHRINK = 3200, 64, 0.8


def _within(found: Column, among: Column) -> Column:
    """Share of tokens, repeats included, that are in the array ``among``; null without tokens. Arguments are variables."""
    known = lambda k: F.size(F.filter(found, lambda t: F.array_contains(k, t))) / F.size(found)
    return F.when(F.size(found) > 0, bind(F.array_intersect(found, among), known))


def groundedness(answer: Column, context: Column) -> Column:
    """Share of the answer's content tokens that the context has; null without tokens."""
    return bind(F.struct(content_tokens(answer).alias("a"), content_tokens(context).alias("c")), lambda v: _within(v["a"], v["c"]))


def _faithful(parts: Column, among: Column, threshold: float) -> Column:
    shares = F.filter(F.transform(parts, lambda s: _within(s, among)), lambda x: x.isNotNull())
    return bind(shares, lambda x: F.when(F.size(x) > 0, F.size(F.filter(x, lambda y: y >= threshold)) / F.size(x)))


def faithfulness(answer: Column, context: Column, threshold: float = SUPPORTED) -> Column:
    """Share of sentences with content of which at least ``threshold`` is supported; null without such sentences."""
    parts = F.transform(sentences(answer), content_tokens)
    return bind(F.struct(parts.alias("p"), F.array_distinct(content_tokens(context)).alias("c")), lambda v: _faithful(v["p"], v["c"], threshold))


def _overlap_f1(a: Column, g: Column) -> Column:
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    common = F.aggregate(F.array_intersect(a, g), F.lit(0), lambda n, t: n + F.least(count(a, t), count(g, t)))
    return bind(common, lambda c: F.when(c > 0, 2.0 * c / (F.size(a) + F.size(g))).otherwise(0.0))


def token_f1(answer: Column, gold: Column) -> Column:
    """Harmonic mean of precision and recall of content tokens as multisets; 0 if either has none."""
    return bind(F.struct(content_tokens(answer).alias("a"), content_tokens(gold).alias("g")), lambda v: _overlap_f1(v["a"], v["g"]))


def exact_match(answer: Column, gold: Column) -> Column:
    """1 if the lexical tokens are the same and there are some."""
    a, g = F.array_join(tokens(answer), " "), F.array_join(tokens(gold), " ")
    return ((a == g) & (g != "")).cast("double")


def _subsequence(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge_l(rows: DataFrame, answer: str, gold: str, into: str = "rouge_l") -> DataFrame:
    """``rows`` with the F measure of the longest common subsequence of content tokens.

    Where the product of the lengths is over four million, both sides count up to 2,000 tokens.
    """

    @F.pandas_udf("double")
    def score(a: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, g):
            x, y = list(x), list(y)
            if len(x) * len(y) > 4_000_000:
                x, y = x[:2000], y[:2000]
            n = _subsequence(x, y) if x and y else 0
            out.append(2 * n / (len(x) + len(y)) if n else 0.0)
        return pd.Series(out)

    return rows.withColumn(into, score(content_tokens(F.col(answer)), content_tokens(F.col(gold))))


def scored_answers(records: DataFrame) -> DataFrame:
    """Records (keys, answer, context, gold or null) with all built-in answer metrics; support is null for abstentions.

    Body, context and gold are cut into tokens once for each record; an explode of one element keeps it so, as the
    optimiser does not repeat what stands below a generator.
    """
    body = answer_body(F.col("answer"))
    once = F.struct(body.alias("body"), (F.coalesce("gold", F.lit("")) != "").alias("answerable"))
    rows = records.withColumn("_once", F.explode(F.array(once)))
    text = F.col("_once.body")
    parts = F.struct(
        content_tokens(text).alias("a"), F.array_distinct(content_tokens(F.col("context"))).alias("c"), content_tokens(F.col("gold")).alias("g"),
        F.transform(sentences(text), content_tokens).alias("s"), readability(text).alias("read"), (is_abstention(F.col("answer")) | is_abstention(text)).alias("abstained"),
    )
    rows = rows.withColumn("_t", F.explode(F.array(parts)))
    given = lambda c: F.when(~F.col("_t.abstained"), c)
    against = lambda c: F.when(F.col("_once.answerable"), c)
    rows = rows.withColumn("_ground", F.explode(F.array(given(_within(F.col("_t.a"), F.col("_t.c"))))))
    abstained = F.col("_t.abstained").cast("int")
    return rows.select(
        *records.columns, F.col("_t.abstained").alias("abstained"), citation_count(F.col("answer")).alias("n_cited"), F.col("_ground").alias("groundedness"),
        (1 - F.col("_ground")).alias("hallucination"), given(_faithful(F.col("_t.s"), F.col("_t.c"), SUPPORTED)).alias("faithfulness"),
        against(exact_match(text, F.col("gold"))).alias("exact_match"), against(_overlap_f1(F.col("_t.a"), F.col("_t.g"))).alias("token_f1"),
        *[F.col("_t.read")[n].alias(n) for n in ("reading_ease", "grade", "fog", "technical_share", "chars")],
        F.when(F.col("_once.answerable"), 1 - abstained).otherwise(abstained).alias("abstention_accuracy"), F.when(~F.col("_once.answerable"), 1 - abstained).alias("false_answer"),
    )


def abstention_table(scored: DataFrame, by: str) -> DataFrame:
    """For each group: abstention on questions without and with a gold text, false answers, accuracy, and both counts."""
    gold, said = F.coalesce("gold", F.lit("")) != "", F.col("abstained").cast("double")
    share = F.avg(F.when(~gold, said))
    return scored.groupBy(by).agg(
        share.alias("abstention_on_unanswerable"), (1 - share).alias("false_answer_rate"), F.avg(F.when(gold, said)).alias("abstention_on_answerable"),
        F.avg("abstention_accuracy").alias("abstention_accuracy"), F.count_if(~gold).alias("n_unanswerable"), F.count_if(gold).alias("n_answerable"),
    )


def first_look(scored: DataFrame, by: str, threshold: float = 0.15) -> DataFrame:
    """Of answerable questions, by group: share answered, share whose token F1 passes, and mean groundedness."""
    rows = scored.where(F.coalesce("gold", F.lit("")) != "")
    return rows.groupBy(by).agg(F.avg(1 - F.col("abstained").cast("int")).alias("answered"), F.avg(F.coalesce(F.col("token_f1") >= threshold, F.lit(False)).cast("double")).alias("passes"), F.avg("groundedness").alias("groundedness"))


def readability_summary(scored: DataFrame, by: str) -> DataFrame:
    """Mean readability of the answers of each group."""
    return scored.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in ("reading_ease", "grade", "fog", "technical_share", "chars")])


def detected(scored: DataFrame, detector: Callable[[list[str], list[str], list[str]], list[float]]) -> DataFrame:
    """Rows (question, context, answer, abstained) with ``detector_rate``, a batch detector's share of unsupported characters.

    ``detector`` gives the number of unsupported characters of each answer; the share is at most 1, and null for
    abstentions.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            bad = detector(list(pdf["question"]), list(pdf["context"]), list(pdf["answer"]))
            rate = [None if out else min(1.0, n / max(1, len(a or ""))) for n, a, out in zip(bad, pdf["answer"], pdf["abstained"])]
            yield pdf.assign(detector_rate=pd.Series(rate, index=pdf.index, dtype="float64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema.fields)
    return scored.mapInPandas(run, f"{schema}, detector_rate double")


def prompt_version(strict: bool, budget: int) -> str:
    """The tag of a prompt form."""
    return f"{'strict' if strict else 'answer-first'}-{budget}"


def prompts(chunks: DataFrame, budget: int = PROMPT_WORDS) -> DataFrame:
    """question_id, prompt, n_words and share: a question's labelled segments in rank order.

    Rows (question_id, rnk, label, text, and title if there is one). Each segment may give a share of the budget; where
    the whole is too long, the share shrinks by a fifth until it fits or is ``LEAST_WORDS``, and the first words of each
    segment are kept. How much each share would take is counted from the segments' lengths, so texts are joined once.
    """
    titled = F.col("title") if "title" in chunks.columns else F.lit("")
    head = F.concat(F.lit("["), F.col("label"), F.lit("]"), F.when(F.coalesce(titled, F.lit("")) != "", F.concat(F.lit(" - "), titled)).otherwise(""))
    rows = chunks.select("question_id", F.struct(F.col("rnk"), head.alias("head"), F.split(F.trim("text"), r"\s+").alias("w")).alias("part"))
    rows = rows.groupBy("question_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    first = F.greatest(F.lit(LEAST_WORDS), F.floor(F.lit(budget) / F.size("parts")).cast("int"))
    rows = rows.withColumn("first", first)
    steps = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.greatest(F.lit(LEAST_WORDS), F.floor(F.col("first") * F.pow(F.lit(SHRINK), i)).cast("int")))
    needs = lambda s: F.aggregate("parts", F.lit(0), lambda n, p: n + F.least(s, F.size(p["w"])) + 1)
    fits = F.filter(steps, lambda s: (s <= LEAST_WORDS) | (needs(s) <= budget))
    rows = rows.withColumn("share", fits[0])
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], F.lit("\n"), F.array_join(F.slice(p["w"], F.lit(1), F.col("share")), " "))), "\n\n")
    return rows.select("question_id", text.alias("prompt"), "share").select("question_id", "prompt", F.size(F.split("prompt", r"\s+")).alias("n_words"), "share")


def planned_batches(rows: DataFrame, key: str, length: str, most: int = 12, budget: float = 4.5e7, groups: int = 1) -> DataFrame:
    """key, length, batch: shortest first, a batch ends where it would have over ``most`` rows or rows x longest squared over
    ``budget``. Rows are planned in ``groups`` ranges of the key's hash, each by one task."""

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "id"], ignore_index=True)
        batch, held, out = 0, 0, []
        for n in pdf["n"]:
            if held and (held >= most or (held + 1) * n * n > budget):
                batch, held = batch + 1, 0
            held += 1
            out.append(batch)
        return pdf.assign(batch=out)[["part", "id", "n", "batch"]]

    parts = rows.select(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("part"), F.col(key).cast("long").alias("id"), F.col(length).cast("long").alias("n"))
    return parts.groupBy("part").applyInPandas(plan, "part int, id long, n long, batch long")


def halving(run: Callable[[list[str]], list[str]], prompts: list[str]) -> list[str]:
    """Answers in order; a batch that runs out of memory is done in two halves, and a single prompt that does raises."""
    try:
        return run(prompts)
    except Exception as problem:
        if len(prompts) < 2 or not (isinstance(problem, MemoryError) or "out of memory" in str(problem).lower()):
            raise
    half = len(prompts) // 2
    return halving(run, prompts[:half]) + halving(run, prompts[half:])


def extracted(prompt: Column, query: Column) -> Column:
    """The stand-in for a model's answer: the prompt's first sentence with a query word of over three letters."""
    of = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"\S+"), F.lit(0))
    sentences = F.transform(F.split(F.replace(prompt, F.lit("\n"), F.lit(" ")), r"\. "), F.trim)
    return bind(F.filter(of(query), lambda w: F.length(w) > 3), lambda terms: F.coalesce(F.get(F.filter(sentences, lambda s: F.arrays_overlap(of(s), terms)), F.lit(0)), F.lit(ABSTAIN)))


def generate(rows: DataFrame, generator: Callable[[list[str], list[str]], list[str]] | None = None) -> DataFrame:
    """Rows (prompt, query) with an ``answer`` from a batch generator of prompts and queries, else from ``extracted``."""
    if generator is None:
        return rows.withColumn("answer", extracted(F.col("prompt"), F.col("query")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = lambda part: generator([p for p, _ in part], [q for _, q in part])
            yield pdf.assign(answer=halving(made, list(zip(pdf["prompt"], pdf["query"]))))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, answer string")


def segments_of(chunks: DataFrame) -> DataFrame:
    """question_id, segment_ids and context: labels and texts of a question's segments in rank order."""
    rows = chunks.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rnk", "label", "text"))).alias("s"))
    return rows.select("question_id", F.array_join(F.transform("s", lambda x: x["label"]), "|").alias("segment_ids"), F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("context"))


def last_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first by ``order``; what ``dropDuplicates`` leaves open."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
