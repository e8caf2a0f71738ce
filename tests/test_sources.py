"""Readers and sinks: JSON maps in byte ranges, question files, results, generation that is interrupted."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from gleanery.operators import answers as A
from gleanery.sources import json_map as J
from gleanery.sources import sinks as K
from gleanery.sources import tables as S
from gleanery.streaming import resume as L

ODD = ['quotes " and \\ and \\\\" }, "x": {', "}, ", "\\", '"', "", "brackets ]}[{ ,:", "tab\tline\nnull\u0000 été 日本語 \U0001f600", "\\\\\\", 'ends with \\"']


def some_map(n, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(ODD) if rng.random() < 0.4 else "w" * rng.randrange(60)
    return {f"{i}{word()}": rng.choice([{"title": word(), "text": word() + word()}, {"text": None}, {"title": word(), "more": [{"a": [word(), {}]}, 1.5e3, True]}, word(), 7, None, [], {}]) for i in range(n)}


@pytest.mark.parametrize("form", [{}, {"indent": 2}, {"ensure_ascii": False}, {"separators": (",", ":")}])
def test_entries_of_any_ranges(tmp_path, monkeypatch, form):
    made = some_map(60, len(form))
    path = str(tmp_path / "map.json")
    with open(path, "w", encoding="utf-8") as file:
        file.write(" \n" + json.dumps(made, **form) + "\n ")
    size = (tmp_path / "map.json").stat().st_size
    for step, block in ((1 << 20, 1 << 20), (97, 1 << 20), (97, 13), (1000, 7), (11, 64)):
        monkeypatch.setattr(J, "BLOCK", block)
        parts = J.ranges(path, step)
        assert len(parts) == -(-size // step)
        found = [(p.path, p.start, p.end, json.dumps([(e.odd, e.inside, e.levels) for e in J.scanned(p)])) for p in parts]
        random.Random(step).shuffle(found)
        got = [x for state in J.starts(found) for x in J.entries(J.Range(*state))]
        assert [(k, json.loads(v)) for k, v in got] == list(made.items())


def test_escapes_across_blocks():
    rng = np.random.default_rng(3)
    for _ in range(300):
        data = rng.choice(np.frombuffer(b'\\"a', np.uint8), rng.integers(0, 12))
        for odd in (False, True):
            escaped, at = odd, []
            for i, c in enumerate(data.tolist()):
                if c == J.QUOTE and not escaped:
                    at.append(i)
                escaped = c == J.BACKSLASH and not escaped
            got, end = J.quotes(data, odd)
            assert (got.tolist(), end) == (at, escaped)


def test_corpus_and_sections(spark, tmp_path):
    texts = {"a": {"title": "A", "text": "one two three"}, "b": {"text": "x"}, "c": {"title": None, "text": None}, "d": {"title": "D", "text": "no sections here"}}
    spans = {"a": {"sections": [{"start": 4, "end": 7}, {"start": 0, "end": 3}, {"start": 5, "end": 99}, {"start": 3, "end": 3}]}, "b": {}, "z": {"sections": []}}
    (tmp_path / "t.json").write_text(json.dumps(texts, indent=1))
    (tmp_path / "s.json").write_text(json.dumps(spans))
    for size in (16, 1 << 20):
        got = {r.doc_id: r for r in S.corpus(spark, str(tmp_path / "t.json"), str(tmp_path / "s.json"), size).collect()}
        assert {k: (r.title, r.text) for k, r in got.items()} == {"a": ("A", "one two three"), "b": ("", "x"), "c": ("", ""), "d": ("D", "no sections here")}
        assert [(s.start, s.end) for s in got["a"].sections] == [(0, 3), (4, 7)] and not got["d"].sections
    assert S.corpus(spark, str(tmp_path / "t.json")).where("sections is null").count() == 4
    with pytest.raises(FileNotFoundError):
        J.files(str(tmp_path / "none.json"))


def test_maps_written_and_read(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([*ODD, None])] + [(None, "nobody")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    K.save_map(docs, str(tmp_path / "maps"), "doc_id")
    for file in (tmp_path / "maps").glob("part-*"):
        json.loads(file.read_text())
    read = S.corpus(spark, str(tmp_path / "maps"), size=40)
    assert read.rdd.getNumPartitions() > 5
    assert {(r.doc_id, r.text) for r in read.collect()} == {(str(i), t or "") for i, t in rows if i is not None}
    K.save_map(docs.limit(0), str(tmp_path / "empty"), "doc_id")
    assert S.corpus(spark, str(tmp_path / "empty")).count() == 0


def test_composition(spark):
    asked = spark.createDataFrame([(1, "train"), (2, "dev"), (3, "train")], "question_id int, split string")
    S.composed(asked, spark.range(4), {"train": 2, "dev": 1, "documents": 4})
    with pytest.raises(ValueError, match="train"):
        S.composed(asked, spark.range(4), {"train": 3, "dev": 1, "documents": 4})
    with pytest.raises(ValueError, match="documents"):
        S.composed(asked, spark.range(4), {"train": 2, "dev": 1})


def test_question_files(spark, tmp_path):
    train = [{"QUESTION_ID": "q1", "QUESTION_TITLE": " How ", "QUESTION_TEXT": "why", "ANSWERABLE": "y", "DOCUMENT": "d1", "START_OFFSET": "3", "END_OFFSET": 9, "DOC_IDS": ["d1", "d2"]}]
    dev = [{"QUESTION_ID": "q2", "QUESTION_TITLE": " ", "QUESTION_TEXT": None, "ANSWERABLE": "N", "DOCUMENT": "-", "START_OFFSET": "-", "END_OFFSET": "-", "DOC_IDS": []}]
    (tmp_path / "train.json").write_text(json.dumps(train))
    (tmp_path / "dev.json").write_text(json.dumps(dev))
    got = {r.question_id: r for r in S.question_files(spark, str(tmp_path / "train.json"), str(tmp_path / "dev.json")).collect()}
    assert tuple(got["q1"])[1:7] == ("How why", "train", True, "d1", 3, 9) and got["q1"].doc_ids == ["d1", "d2"]
    assert tuple(got["q2"])[1:7] == ("", "dev", False, "-", None, None)


ASKED, SAID = "question_id long, query string, prompt string", "question_id long, answer string"


def ask(spark, folder, name, ids):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps({"question_id": i, "query": f"what about topic{i}", "prompt": f"Preface. All topic{i} is here. End"}) + "\n" for i in ids))


def stream(spark, tmp_path, generate=None):
    answer = lambda batch: A.generate(batch).select("question_id", "answer")
    return L.stream_records(L.question_stream(spark, str(tmp_path / "asked"), ASKED), generate or answer, str(tmp_path / "said"), str(tmp_path / "state"), SAID)


def test_a_run_that_dies_between_write_and_commit(spark, tmp_path, monkeypatch):
    """The batch that was written but not committed runs again under its number, and no record comes twice."""
    ask(spark, tmp_path / "asked", "1", [1, 2, 3])
    ask(spark, tmp_path / "asked", "2", [3, 4, 4, 5])
    ask(spark, tmp_path / "asked", "3", [6, 1])
    calls = []

    def dies(batch):
        calls.append(sorted(r.question_id for r in batch.select("question_id").collect()))
        return A.generate(batch).select("question_id", "answer")

    json_ = DataFrameWriter.json

    def stops(self, path, *a, **b):
        json_(self, path, *a, **b)
        if path.endswith(f"{1:09d}"):
            raise RuntimeError("between write and commit")

    monkeypatch.setattr(DataFrameWriter, "json", stops)
    with pytest.raises(Exception, match="between write and commit"):
        stream(spark, tmp_path, dies).awaitTermination()
    monkeypatch.setattr(DataFrameWriter, "json", json_)
    assert len(L.batches(spark, str(tmp_path / "said"))) == 2  # the second is written, yet not committed
    stream(spark, tmp_path, dies).awaitTermination()
    got = sorted((r.question_id, r.answer) for r in L.committed(spark, str(tmp_path / "said"), SAID).collect())
    assert got == [(i, f"All topic{i} is here") for i in range(1, 7)]
    assert sorted(q for c in [calls[0], *calls[2:]] for q in c) == [1, 2, 3, 4, 5, 6] and len(calls) == 4 and calls[1] == calls[2]
    ask(spark, tmp_path / "asked", "4", [2, 7])
    stream(spark, tmp_path, dies).awaitTermination()
    assert calls[-1] == [7] and L.committed(spark, str(tmp_path / "said"), SAID).count() == 7


def test_broken_lines_and_batches_that_never_ended(spark, tmp_path):
    for n, lines, done in ((0, ['{"question_id": 1, "answer": "a"}', '{"question_id": 2, "ans', '{"question_id": 3, "answer": "c"}'], True), (1, ['{"question_id": 4, "answer": "d"}'], False)):
        folder = tmp_path / "said" / f"batch-{n:09d}"
        folder.mkdir(parents=True)
        (folder / "part-0.json").write_text("\n".join(lines) + "\n")
        if done:
            (folder / "_SUCCESS").touch()
    assert sorted(r.question_id for r in L.committed(spark, str(tmp_path / "said"), SAID).collect()) == [1, 3]
    assert L.committed(spark, str(tmp_path / "nowhere"), SAID).count() == 0


def test_last_record_of_a_question_counts(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"question_id": "q", "answer": "old", "seconds": 1.0}\n{"question_id": "q", "answer": "new", "seconds": 2.0}\n{"question_id": "r"\n')
    got = S.checkpoint_records(spark, str(tmp_path / "r.jsonl"), "question_id string, answer string, seconds double").collect()
    assert [(r.question_id, r.answer) for r in got] == [("q", "new")]


def test_results_that_are_there_or_not(spark, tmp_path):
    assert S.result_table(spark, str(tmp_path / "none.csv")) is None and S.result_json(spark, str(tmp_path / "none.json")) is None
    assert S.result_records(spark, str(tmp_path / "none.csv")).count() == 0
    K.save_table(spark.createDataFrame([("sliding_window", 1, 0.123456), ("fixed_window", 2, None)], "method string, question_id int, ceiling double"), str(tmp_path / "c.csv"))
    assert sorted(tuple(r) for r in S.ceiling_table(spark, str(tmp_path / "c.csv")).select("method", "question_id", "ceiling").collect()) == [("fixed_window", 2, None), ("sliding_window", 1, 0.1235)]
    assert sorted(json.loads(r.record)["ceiling"] is None for r in S.result_records(spark, str(tmp_path / "c.csv")).collect()) == [False, True]
    with pytest.raises(ValueError, match="ceiling"):
        S.required(spark.range(1), {"ceiling"}, "x.csv")
    for name in "AB":
        K.save_table(spark.range(2).select(F.col("id").alias("question_id")), str(tmp_path / f"factor{name}.csv"))
    assert set(S.factor_traces(spark, str(tmp_path), ("A", "B"))) == {"A", "B"}
    with pytest.raises(FileNotFoundError, match="factorC"):
        S.factor_traces(spark, str(tmp_path))
    assert [r[0] for r in spark.createDataFrame([("1.5",), ("-",), (None,)], "x string").select(S.number(F.col("x"), 1.0)).collect()] == [1.5, 1.0, 1.0]
    assert [r[0] for r in spark.createDataFrame([("True",), ("0",), ("yes",), (None,)], "x string").select(F.coalesce(S.flag(F.col("x")), F.lit(False))).collect()] == [True, False, True, False]


def test_chunk_tables_by_file_name(spark, tmp_path):
    for method in ("fixed_window", "late_chunking"):
        spark.createDataFrame([(1, 0, 5)], "doc_id int, char_start int, char_end int").write.parquet(str(tmp_path / f"chunks_{method}.parquet"))
    assert sorted(r.method for r in S.method_chunks(spark, str(tmp_path / "chunks_*.parquet")).collect()) == ["fixed_window", "late_chunking"]


def test_contexts_provenance_and_appended_records(spark, tmp_path):
    ranking = spark.createDataFrame([(1, 7, 0, 2), (1, 8, 1, 1), (1, 9, 0, 6), (2, 7, 0, 1)], "question_id int, doc_id long, chunk_no int, rnk int")
    K.save_contexts(ranking, str(tmp_path / "contexts"))
    got = {r.question_id: [(c.rnk, c.doc_id) for c in r.context] for r in spark.read.json(str(tmp_path / "contexts")).collect()}
    assert got == {1: [(1, 8), (2, 7)], 2: [(1, 7)]}
    one = K.stamped(spark.range(1), version="2", model="m").first()
    assert (one.provenance.version, one.provenance.model) == ("2", "m") and one.provenance.at is not None
    for x in (1.5, float("nan")):
        K.append_records(spark.createDataFrame([(1, x)], "question_id int, seconds double"), str(tmp_path / "log"))
    assert sorted(str(r.seconds) for r in spark.read.schema("question_id int, seconds double").json(str(tmp_path / "log")).collect()) == ["1.5", "None"]
