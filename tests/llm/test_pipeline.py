"""The pipeline's stages on the smallest tables: what each promises, and columns that the next one can read."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
from gleanery.llm.common import checkpointed
from gleanery.llm.ngram_join import near_duplicates

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = checkpointed(stage(spark, docs, FOLDER))
        kept[name] = docs
        if name != "BPE":
            assert docs.columns == columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id").union(before.select("doc_id"))).isEmpty()
    texts = [re.sub(r"[ \t-\r]", "", r.text or "") for r in kept["exact dedup"].collect()]
    assert len(texts) == len(set(texts))
    near = kept["n-gram Jaccard join"]
    assert near.count() == near_duplicates(kept["exact dedup"]).select("component_id").distinct().count()
    assert kept["BPE"].count() == kept["mixing"].count() >= near.count() * 0.5


def test_pipeline_on_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(60)) for _ in range(n))
    base = [words(60) for _ in range(60)]
    near = [t.replace(t.split()[30], "swapped", 1) for t in base[:15]]
    texts = [*base, *near, *[base[3]] * 40, *[" " + t + "  " for t in base[:10]], None, "", "  ", "one two", words(4000)]
    rows = [(i if i % 17 else None, t, None if i % 5 == 0 else f"s{i % 2}", "x") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, source string, `Shard` string"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/full/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("full", "none"):
        spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/full/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = checkpointed(stage(spark, docs, f"{tmp_path}/full"))
        kept.append([(r.doc_id, r.text or "") for r in docs.collect()])
        assert docs.columns == ["doc_id", "text", "source", "Shard"], name
    squeezed = lambda t: re.sub(r"[ \t-\r]", "", t)
    best = {}
    for i, t in kept[0]:
        key = (-len(t), i is None, i or 0)
        best[squeezed(t)] = min(best.get(squeezed(t), key), key)
    assert Counter((squeezed(t), -len(t), i is None, i or 0) for i, t in kept[1]) == Counter((k, *v) for k, v in best.items())
    sets = lambda t: {tuple(w[j : j + 5]) for w in [t.split()] for j in range(max(1, len(w) - 4))} if t.split() else set()
    links = lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b)
    shingled = [(i, sets(t)) for i, t in kept[1]]
    roots = list(range(len(shingled)))
    for a in range(len(shingled)):
        for b in range(a):
            if links(shingled[a][1], shingled[b][1]):
                roots = [roots[b] if r == roots[a] else r for r in roots]
    assert len(kept[2]) == len(set(roots)) and max(map(len, kept[2])) == 2
    assert corpus_pipeline.run(spark, f"{tmp_path}/full").count() > 0 == corpus_pipeline.run(spark, f"{tmp_path}/none").count()
