"""The training-data operators against brute force on small tables with nulls, empty and repeated rows, and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from gleanery.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip
from gleanery.llm.common import checkpointed
from gleanery.llm.components import components
from gleanery.llm.exact_dedup import exact_dedup, exact_groups
from gleanery.llm.language_id import identify_languages
from gleanery.llm.line_dedup import _near, _signed, _unmet, dedup_lines, line_classes
from gleanery.llm.mixing import Mix, draws, hypergeometric, mix_documents, split_tree, targets
from gleanery.llm.ngram_join import near_duplicates, without_near_duplicates
from gleanery.llm.suffix_array import permuted_prefixes, suffix_array
from gleanery.llm.suffix_dedup import parted, remove_repeats
from gleanery.llm.token_counts import length_histogram, length_quantiles, limit_table, token_lengths, truncated_totals
from gleanery.llm.topk import top_k
from gleanery.llm.toxicity import toxicity_scores, without_toxic

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash long, row string, `Size` int"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n))


BASE = words(120, 1)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
TEXTS = [BASE, BASE, NEAR, BASE + " ", None, "", " \n", "one two", "ONE  two", "été ß 日本語 <|endoftext|> it's", words(300, 2), words(300, 2) + " " + words(50, 3), "x" * 5000, words(30, 4) + "\n" + words(30, 5) + "\n\n" + words(30, 4)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 3}", 0, 1, "r", 2) for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, "nobody's text", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(text):
    return re.sub(r"[ \t-\r]", "", text or "")


@pytest.mark.parametrize("hot", [None, 0, 2])
def test_exact_groups(docs, hot):
    rows = exact_groups(docs, hot=hot).collect()
    assert len(rows) == docs.count()
    given = [(r.doc_id, r.text or "") for r in docs.collect()]
    size = Counter(plain(t) for _, t in given)
    by = {}
    for i, t in given:
        by.setdefault(hashlib.sha256(plain(t).encode()).hexdigest(), []).append((-len(t), i is None, i or 0, i))
    sizes = {hashlib.sha256(k.encode()).hexdigest(): n for k, n in size.items()}
    for r in rows:
        assert (r.keep_id, r.group_size) == (min(by[r.text_sha256])[3], sizes[r.text_sha256])
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(sizes.keys())


def test_exact_dedup_keeps_columns(docs, empty):
    out = exact_dedup(docs)
    assert out.columns == docs.columns
    assert out.count() == len({plain(r.text) for r in docs.collect()})
    assert exact_groups(empty).count() == exact_dedup(empty).count() == 0


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    return sorted((str(i), len(sets[k]), str(least.get(root[k]) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def test_near_duplicates(docs, empty):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_duplicates(docs).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert near_duplicates(empty).count() == 0
    assert without_near_duplicates(docs).columns == docs.columns


def test_near_duplicates_of_a_chain(spark):
    base = words(100, 9).split()
    rows = [(i, " ".join(["new%d" % k for k in range(i)] + base[i:])) for i in range(0, 60, 6)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (200, 200), (100, 103), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[103] == 100 and got[200] == 200


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(150):
        s = [rng.randrange(1, rng.choice([2, 3, 200])) for _ in range(rng.randrange(1, 50))] * rng.randrange(1, 4) + [0]
        array = suffix_array(np.array(s))
        assert array.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        shared = permuted_prefixes(np.array(s), array)
        for a, b in zip(array, array[1:]):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert shared[b] == n


def test_remove_repeats(docs, empty):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(b[i : i + 400] for _, b in rows for i in range(len(b) - 399))
    want = []
    for i, b in rows:
        cut = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                cut[k : k + 400] = b"\1" * 400
        left = bytes(x for x, c in zip(b, cut) if not c)
        want.append((str(i), len(b), sum(cut), len(re.findall(b"\1+", bytes(cut))), hashlib.sha256(left).hexdigest()))
    for hot in (1000, 1):
        got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, hot=hot).collect()]
        assert sorted(got) == sorted(want)
    assert remove_repeats(empty).count() == 0


def test_bpe_equals_the_library(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_round_trip(docs).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))) in got
    both = bpe_decode(bpe_encode(docs)).collect()
    assert all(library.decode(r.ids, skip_special_tokens=False) == r.decoded for r in both)
    assert bpe_round_trip(empty).count() == 0


def test_mixing(docs, empty, spark):
    assert targets([100, 10, 10]) == pytest.approx([140.0, 20.0, 20.0])
    mix = Mix(shards=3, block_words=16)
    rows = draws(docs, mix).collect()
    assert len(rows) == docs.count() and all(0 <= r.copies <= 2 and len(r.shards) == r.copies for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, draws(docs, mix).collect()))
    many = spark.createDataFrame([(i, words(1 + i % 37, i), f"s{i % 4}") for i in range(2000)], "doc_id long, text string, source string")
    taken, goal = Counter(), {}
    for r in draws(many).collect():
        taken[r.source] += r.copies * r.size
        goal[r.source] = r.target
    assert all(abs(taken[s] - goal[s]) <= 40 for s in goal)
    out = mix_documents(docs, mix)
    assert set(docs.columns) < set(out.columns) and out.count() > 0
    assert draws(empty).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v], "c") for i, v in enumerate(rng.normal(size=(300, 16)))]
    rows += [(300, None, "c"), (301, [1.0, None], "c"), (302, [float("nan")] * 16, "c"), (303, rows[0][1], "c"), (304, [], "c"), (305, [float("inf")] * 16, "c")]
    rows += [(306, [4e7] * 4, "c"), (320, [-3e8, 1.0, 2.5e6], "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    whole = {i: np.floor(64 * np.array(v)) for i, v, _ in rows if i not in (300, 301, 302, 305)}
    got = {}
    for r in top_k(table, table.where("vec_id % 20 = 0"), 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {*range(0, 300, 20), 320}
    for q, have in got.items():
        best = sorted((-sum(int(a) * int(b) for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:7]
        assert sorted(have) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert top_k(table.limit(0), table).count() == top_k(table, table.limit(0)).count() == 0


def test_token_counts(docs, empty):
    lengths = token_lengths(docs)
    n = sorted(r.n_tokens for r in lengths.collect())
    table = limit_table(length_histogram(lengths))
    for r in table.collect():
        assert r.tokens_truncated == sum(min(x, r.n_tokens) for x in n) and r.docs_over == sum(x > r.n_tokens for x in n)
    for r in truncated_totals(table, [0, 5, 100, 10**6]).collect():
        assert r.tokens_truncated == sum(min(x, r.limit) for x in n)
    assert length_quantiles(table, [0.5]).first()["n_tokens"] == n[(len(n) + 1) // 2 - 1]
    assert limit_table(length_histogram(token_lengths(empty))).count() == 0


def test_line_dedup(spark, docs, empty):
    line = words(30, 7)
    rows = [(1, line + "\nfirst\n\nsecond"), (2, "third\n" + line.replace(line.split()[0], "swapped", 1) + "\n"), (3, line.upper() + "  "), (4, None)]
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("third\n", 1), 3: ("", 1), 4: (None, 0)}
    assert dedup_lines(docs).count() == docs.count() and dedup_lines(empty).count() == 0


def test_languages(spark, docs, empty):
    letters = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(20)), k) for i in range(120) for k in [sorted(letters)[i % 3]]]
    got = identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {(r.doc_id, r.lang_pred) for r in got} == {(i, k) for i, _, k in rows} and any(r.held_out for r in got)
    assert all(0 <= r.score <= 1 for r in identify_languages(docs).collect()) and identify_languages(empty).count() == 0


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        text = words(30, i).split()
        if bad:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), "grumpf" + rng.choice(["lig", "ung", "en", "ar"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    truth = spark.createDataFrame([*labels, (9999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(table, truth).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity_scores(docs, none).count() == docs.count() and toxicity_scores(empty, none).count() == 0


def brute_lines(lines):
    """The place of the first line of each line's component, over all pairs."""
    sets = [{x[k : k + 7] for k in range(max(1, len(x) - 6))} for x in lines]
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return root


def line_roots(spark, lines):
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = {r.doc.key: r.keep_doc.key for r in line_classes(rows).collect()}
    return [got[i] for i in range(len(lines))]


def test_line_dedup_of_one_word_edits(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8)))
    lines = []
    for i in range(150):
        line = []
        while len(" ".join(line)) < 40 + i * 80 // 150:
            line.append(word())
        k = rng.randrange(len(line))
        lines += [" ".join(line), " ".join([*line[:k], word(), *line[k + 1 :]])]
    want = brute_lines(lines)
    assert sum(r != i for i, r in enumerate(want)) > 75
    assert line_roots(spark, lines) == want


def test_line_dedup_of_long_runs(spark):
    rng = random.Random(12)
    lines = []
    for n in (60, 90, 120):
        for letters in ([chr(0x4E00 + k) for k in range(3000)], list("abcdefghijklmnopqrstuvwxyz0123456789"), [chr(0x20000 + k) for k in range(3000)]):
            run = "".join(rng.choice(letters) for _ in range(n))
            lines += [run, run[:3] + rng.choice(letters) + run[3:], run[: n // 2] + run[n // 2 + 1 :]]
    want = brute_lines(lines)
    assert want == [i - i % 3 for i in range(len(lines))]
    assert line_roots(spark, lines) == want


def test_line_dedup_within_large_buckets(spark):
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    template, lines = word(400), []
    for _ in range(100):  # similarity 0.774 within a pair, 0.722 to all others; most buckets are of the template's shingles
        pair = word(16)
        lines += [template + pair + word(60), template + pair + word(60)]
    assert brute_lines(lines) == [i - i % 2 for i in range(len(lines))]
    bands = {}
    for r in _signed(spark.createDataFrame(list(enumerate(lines)), "id long, line string")).collect():
        bands.setdefault(r.id, set()).add(r.band)
    meet = [bool(bands[i] & bands[i + 1]) for i in range(0, len(lines), 2)]
    assert sum(meet) >= 97
    got = line_roots(spark, lines)
    assert all(got[i] == i - i % 2 or (got[i] == i and not meet[i // 2]) for i in range(len(lines)))


def test_short_lines_meet_in_some_bucket(spark):
    rng = random.Random(14)
    lines = []
    for _ in range(600):  # 17 shingles each, 15 of them shared by a pair: similarity 0.789
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(21))
        lines += [line + "ab", line + "yz"]
    bands = {}
    for r in _signed(spark.createDataFrame(list(enumerate(lines)), "id long, line string")).collect():
        bands.setdefault(r.id, set()).add(r.band)
    assert sum(bool(bands[i] & bands[i + 1]) for i in range(0, len(lines), 2)) >= 0.985 * 600


def test_lines_of_different_buckets_are_not_paired(spark):
    line = words(12, 15)
    lines = spark.createDataFrame([(i, line + end) for i, end in enumerate(("", " a", " bc", " def"))], "id long, line string")
    inner = spark.createDataFrame([(7, 0), (7, 1), (8, 2), (8, 3)], "band long, id long")
    near = _near(lines, inner.select("id"))
    assert {r.id: r.n for r in near.collect()} == {i: len({x[k : k + 7] for k in range(len(x) - 6)}) for i, x in lines.collect()}
    pairs = _unmet(inner, spark.createDataFrame([], "node long, root long"), near, 75)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 0), (3, 2)}


def test_a_written_table_leaves_no_shuffle_files(spark):
    def held():
        folder = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
        return {f.name for f in folder.rglob("shuffle_*")}

    before = held()
    table = checkpointed(spark.range(1000).repartition(7, "id"))
    assert held() == before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def removed_by_brute_force(texts, length=400):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        cut = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                cut[k : k + length] = b"\1" * length
        out.append(sum(cut))
    return out


def test_a_passage_in_many_contexts_is_parted(spark):
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    short, long = letters(380), letters(520)  # the first is no repeat by itself, the second is
    texts = [letters(200) + (short if i % 2 else long) + letters(150) for i in range(24)]
    texts += [texts[1][:450] + letters(90), letters(30) + texts[2][100:], "y" * 700 + letters(50), letters(10) + "y" * 450]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = removed_by_brute_force([t.encode() for t in texts])
    for hot in (3, 1000):
        got = {r.doc_id: r.n_removed for r in remove_repeats(rows, hot=hot).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert parted(5, 6, 0, 8, 2) == [(0, 2, 4, 8), (2, 4, 0, 3)] and parted(3, 2, 0, 8, 2) == [(0, 2, 0, 3)]
    for off, n in ((8, 9), (7, 3), (4, 5), (0, 1)):
        got = parted(off, n, 0, 8)
        assert [(i, off - i) for i in range(n)] == [(i, off - i) for f, k, lo, hi in got for i in range(f, f + k) if lo <= off - i <= hi]
    assert parted(5, 1, 5, 5) == [(0, 1, 5, 5)]


def test_splitting_tree_keeps_quotas():
    quotas = np.array([1000, 7, 0, 333])
    got = split_tree(quotas, 13, 5)
    assert (got.sum(axis=0) == quotas).all() and (got >= 0).all()
    sizes = got.sum(axis=1)
    assert sizes.max() - sizes.min() <= 2 and (got == split_tree(quotas, 13, 5)).all()
    share = np.mean([split_tree(quotas, 2, seed)[0, 0] for seed in range(300)])
    assert share == pytest.approx(500, abs=3)
    rng = np.random.Generator(np.random.Philox(3))
    have = np.array([4 * 10**9, 10**9, 3])
    for take in (0, 10**9, int(have.sum())):
        part = hypergeometric(rng, have, take)
        assert part.sum() == take and (part <= have).all() and (part >= 0).all()


def test_mix_is_its_draws(spark):
    rows = [(i, words(1 + 5 * (i % 9), i), f"s{i % 3}") for i in range(300)]
    rows[7] = (7, words(3000, 7), "s1")  # longer than many blocks
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = Mix(shards=5, block_words=16)
    drawn = {r.doc_id: r for r in draws(docs, mix).collect()}
    out = mix_documents(docs, mix).collect()
    assert Counter(r.doc_id for r in out) == Counter({i: r.copies for i, r in drawn.items() if r.copies})
    assert Counter((r.doc_id, r.shard) for r in out) == Counter((i, s) for i, r in drawn.items() for s in r.shards)
    by_shard = Counter()
    for r in out:
        by_shard[r.shard] += len(r.text.split())
    assert set(by_shard) <= set(range(5))
    for s in ("s0", "s1", "s2"):
        of = [r for r in drawn.values() if r.source == s]
        assert abs(sum(r.copies * r["size"] for r in of) - of[0].target) <= max(r["size"] for r in of)


def test_rows_are_judged_by_their_own_text(spark):
    rng = random.Random(8)
    bad = lambda i: words(12, i) + " grumpflig grumpfung " + words(12, i + 1)
    rows = [(i, bad(i) if i % 5 == 0 else words(24, i), "c") for i in range(400)]
    rows += [(None, bad(1000), "c"), (None, words(24, 1001), "c"), (1, bad(1002), "c"), (None, None, None), (900, "", "c")]
    truth = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    table = spark.createDataFrame(rows, "doc_id long, text string, `_Row` string").repartition(3)
    kept = sorted(without_toxic(table, truth).collect(), key=str)
    assert kept == sorted((r for r in table.collect() if "grumpf" not in (r.text or "")), key=str) and rng


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    pairs = [(a.score > b.score) + (a.score == b.score) / 2 for a in rows for b in rows if a.toxic == 1 and b.toxic == 0]
    assert len(pairs) > 5000 and sum(pairs) >= 0.85 * len(pairs)
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
