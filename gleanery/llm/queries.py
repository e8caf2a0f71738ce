"""Queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .centroids import clusters
from .exact_dedup import exact_groups
from .hard_negatives import hard_negatives
from .language_id import identify_languages
from .line_dedup import dedup_lines
from .lm_scoring import fold, lm_scores
from .mixing import draws
from .ngram_join import near_duplicates
from .suffix_dedup import remove_repeats
from .token_counts import length_histogram, limit_table, token_lengths
from .topk import top_k
from .toxicity import toxicity_scores


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = draws(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "shards")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_table(length_histogram(token_lengths(_read(spark, sf_dir, "documents"))))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(_read(spark, sf_dir, "embeddings"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = lm_scores(docs, fold(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_join": op6_ngram_join,
    "op7_bpe": op7_bpe,
    "op8_mixing": op8_mixing,
    "op9_topk": op9_topk,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_centroids": op12_centroids,
    "op13_lm_scoring": op13_lm_scoring,
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": r"""
        with n as (select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)
        select doc_id, first_value(doc_id) over best as keep_id, count(*) over (partition by norm) as group_size,
               row_number() over best = 1 as kept, sha256(norm) as text_sha256
        from n window best as (partition by norm order by chars desc, doc_id nulls last)""",
    "op9_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
        r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
        select * from r where rank <= 20""",
    "op6_ngram_join": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        g as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
        n as (select doc_id, count(*) as n from g group by doc_id),
        p as (select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y on x.g = y.g and x.doc_id <> y.doc_id group by all),
        l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
        r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
        m as (select a, min(b) as least from r group by a)
        select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) as component_id
        from w left join n using (doc_id) left join m on m.a = w.doc_id""",
}

ORACLES["op11_hard_negatives"] = """
        with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
                   where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as anchor_id, c.vec_id, q.label = c.label as same, cast(list_dot_product(q.v, c.v) as bigint) as score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
        p as (select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as n from s where same),
        r as (select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, n order by score desc, vec_id) as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
              from p join s using (anchor_id) where n <= 5 and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
        select * from r where rank <= 10"""


def _lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds as common table expressions: c0, c1, ... the centroids, a0, a1, ... the assignments to them."""
    square = "list_dot_product(list_transform(list_zip(v.v, c.v), lambda z: z[1] - z[2]), list_transform(list_zip(v.v, c.v), lambda z: z[1] - z[2]))"
    parts = [
        "v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as (select row_number() over (order by h) - 1 as c, v from (select sha256('2:' || vec_id) as h, v from v order by h limit {k}))",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} as (select vec_id, v.v, c.c, cast({square} as bigint) as d from v cross join c{n} c)")
        parts.append(f"a{n} as (select vec_id, any_value(v) as v, arg_min(c, d * 64 + c) as c, min(d) as d from d{n} group by vec_id)")
        if n < rounds:
            mean = "select c, list(m order by i) as v from (select c, i, floor(sum(v[i]::bigint)::double / count(*)) as m from (select c, v, unnest(range(1, 65)) as i from a%d) group by c, i) group by c" % n
            parts.append(f"c{n + 1} as (select c{n}.c, coalesce(m.v, c{n}.v) as v from c{n} left join ({mean}) m using (c))")
    return f"""with {", ".join(parts)}
        select vec_id, cast(c as integer) as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
               sha256(array_to_string(list_transform(c{rounds}.v, lambda x: x::bigint), ',')) as centroid_sha256
        from a{rounds} join c{rounds} using (c)"""


ORACLES["op12_centroids"] = _lloyd_sql()
