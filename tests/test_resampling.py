"""Resamples of fixed size, against brute force over the same hashes and against what chance allows."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import resampling as M
from gleanery.operators import statistics as B


def hashed(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def heads(n, *key):
    return sum((hashed(*key, w) & ((1 << min(32, n - 32 * w)) - 1)).bit_count() for w in range(-(-n // 32)))


def binomial(d, part, whole, *key):
    """Draw by draw, the binary digits of part / whole against coins."""
    if part <= 0 or part >= whole:
        return 0 if part <= 0 else d
    inside, open_, rest = 0, d, part
    for i in range(1, M.DIGITS + 1):
        one, rest = rest * 2 >= whole, rest * 2 % whole
        h = heads(open_, *key, i)
        inside, open_ = (inside + open_ - h, h) if one else (inside, open_ - h)
    return inside


def weights(units, b, most=0):
    """How often resample b draws each of a group's units; the tree is as deep as the largest group, of ``most`` units, needs."""
    levels = M.levels_of(max(most, len(units)))
    order = sorted((hashed(u), u) for u in units)
    left = [(0, 0, order, len(order))]
    out = Counter()
    while left:
        level, node, part, d = left.pop()
        if not part:
            assert d == 0
        elif level < levels:
            low = [x for x in part if x[0] >> (31 - level) == 2 * node]
            inside = binomial(d, len(low), len(part), "l", level, node, b)
            left += [(level + 1, 2 * node, low, inside), (level + 1, 2 * node + 1, part[len(low) :], d - inside)]
        else:
            c = [hashed("p", k, node, b) % M.MODULUS for k in range(4)]
            for j in range(d):
                u = (((c[3] * j + c[2]) % M.MODULUS * j + c[1]) % M.MODULUS * j + c[0]) % M.MODULUS
                out[part[u * len(part) >> 31][1]] += 1
    return out


@pytest.mark.parametrize("n", [1, 3, 512, 513, 1300])
def test_draws_follow_the_tree(spark, n):
    rows = spark.range(n).select(F.col("id"), (F.col("id") * 2).alias("x"))
    got = {}
    for r in M.draws(rows, "id", 70).groupBy("b", "id").agg(F.sum("w").alias("w"), F.max("x").alias("x")).collect():
        got.setdefault(r.b, {})[r.id] = r.w
        assert r.x == 2 * r.id
    assert sorted(got) == list(range(70))
    assert all(sum(w.values()) == n for w in got.values())
    for b in (0, 1, 63, 64, 69):
        assert got[b] == weights(list(range(n)), b)


def test_sums_of_groups_and_repeated_units(spark):
    """Each group draws as many units as it has, all rows of a unit together, whatever the partitions."""
    data = [(g, u, float(u * 3 + k)) for g, n in (("a", 5), ("b", 1200), ("c", 1)) for u in range(n) for k in range(1 + u % 2)]
    rows = spark.createDataFrame(data, "g string, u int, x double")
    for parts in (1, 7):
        got = {(r.g, r.b): (r.n, r.s) for r in M.drawn_sums(rows.repartition(parts), ["g"], "u", "x", 9).collect()}
        assert len(got) == 27
        for g in "abc":
            own = [(u, x) for h, u, x in data if h == g]
            for b in range(9):
                w = weights(sorted({u for u, _ in own}), b, 1200)
                assert sum(w.values()) == len({u for u, _ in own})
                assert got[g, b] == (sum(w[u] for u, _ in own), sum(w[u] * x for u, x in own))
    assert M.drawn_sums(rows.limit(0), ["g"], "u", "x", 9).count() == 0


def test_resamples_spread_as_chance_does(spark):
    n, n_boot = 400, 500
    rows = spark.range(n).select(F.col("id"), (F.col("id") % 7).cast("double").alias("x"), F.lit("g").alias("g"))
    each = M.draws(rows, "id", n_boot).groupBy("b", "id").agg(F.sum("w").alias("w"))
    got = each.agg(F.sum(F.col("w") * F.col("w")).alias("sq"), F.count("w").alias("seen")).first()
    assert got.sq / n_boot == pytest.approx(n * (2 - 1 / n), rel=0.02)  # the second moment of a multinomial weight
    assert got.seen / n_boot == pytest.approx(n * (1 - (1 - 1 / n) ** n), rel=0.02)  # units that are drawn at all
    halves = M.draws(rows, "id", n_boot).where("id < 100").groupBy("b").agg(F.sum("w").alias("w")).agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).first()
    assert halves.m == pytest.approx(100, abs=2) and halves.v == pytest.approx(75, rel=0.25)
    ci = B.bootstrap_ci(rows, ["g"], "id", "x").first()
    assert (ci.hi - ci.lo) / 2 == pytest.approx(1.96 * 2.0 / 20, rel=0.15) and B.RESAMPLES == 5000
    same = B.paired_bootstrap(rows.select("g", "id", F.col("x").alias("a"), F.col("x").alias("b")), ["g"], "id", 50).first()
    assert (same["diff"], same.p, same.dz) == (0, 1, None)


def test_resamples_without_spread_have_no_interval_to_speak_of(spark):
    rows = spark.createDataFrame([("g", i, 2.5) for i in range(200)] + [("h", 1, None)], "g string, id int, x double")
    [r] = B.bootstrap_ci(rows, ["g"], "id", "x", 100).collect()
    assert (r.g, r.n, r.mean, r.lo, r.hi) == ("g", 200, 2.5, 2.5, 2.5)


def test_coins_and_shares_are_counted_in_tasks():
    """The operator's coins are plain numbers in tasks of Arrow batches, not expressions for each coin; they agree with those above."""
    from gleanery.operators import resampling

    for n in (0, 1, 31, 32, 33, 64, 1000):
        assert resampling.heads(n, "l|3|17|4999|2") == heads(n, "l", 3, 17, 4999, 2)
    for d, part, whole in ((0, 3, 7), (5, 0, 7), (5, 7, 7), (900, 3, 7), (900, 1, 512), (70, 511, 512), (40, 4, 8)):
        assert resampling.binomial(d, part, whole, "l|0|0|12") == binomial(d, part, whole, "l", 0, 0, 12)


def test_areas_of_resamples_are_ranked_in_parts(spark, monkeypatch):
    """AUROC intervals come from counts of each range, ranked in parts of the scores, not from a row for each draw."""
    from gleanery.operators import certainty as Q

    monkeypatch.setattr(Q, "PART", 100)
    data = [(g, u, float(u * 7 % 40) if g == "a" else 1.0, (u * 5 + k) % 3 == 0) for g, n in (("a", 700), ("b", 30)) for u in range(n) for k in range(1 + u % 2)]
    rows = spark.createDataFrame([(g, u, s, int(y)) for g, u, s, y in data], "g string, u int, s double, y int")
    drawn = M.drawn_ranks(rows, ["g"], "u", "s", "y", 70, spark.createDataFrame([("a", [3.0, 9.0, 9.5, 30.0]), ("b", [1.0])], "g string, cuts array<double>"))
    assert "w" not in drawn.columns
    got = {(r.g, r.b): (r.n, r.pos, r.r) for r in drawn.collect()}
    assert len(got) == 140
    area = {}
    for g, n in (("a", 700), ("b", 30)):
        for b in range(70):
            w = weights(list(range(n)), b, 700)
            count, pos = Counter(), Counter()
            for h, u, s, y in data:
                if h == g:
                    count[s] += w[u]
                    pos[s] += w[u] * y
            before = ranks = 0
            for s in sorted(count):
                ranks, before = ranks + pos[s] * (before + (count[s] + 1) / 2), before + count[s]
            p = sum(pos.values())
            assert got[g, b] == (before, p, ranks)
            area[g, b] = (ranks - p * (p + 1) / 2) / (p * (before - p))
    ci = {r.g: (r.lo, r.hi) for r in Q.auroc_ci(rows, ["g"], "u", "s", "y", 70).collect()}
    assert ci["b"] == (0.5, 0.5)
    a = sorted(area["a", b] for b in range(70))
    at = lambda q: a[int(69 * q)] + (a[int(69 * q) + 1] - a[int(69 * q)]) * (69 * q % 1)
    assert ci["a"] == pytest.approx((at(0.025), at(0.975)))


def test_many_coins_are_counted_at_once():
    asked = [(d, part, whole, f"l|{k}|{k * 7}|{k * k}") for k, (d, part, whole) in enumerate([(0, 3, 7), (5, 0, 7), (5, 7, 7), (900, 3, 7), (900, 1, 512), (70, 511, 512), (40, 4, 8), (100000, 333, 1000)])]
    asked.append((50, 3, 7, "l|" + "9" * 60))
    d, part, whole = (np.array([x[k] for x in asked]) for k in range(3))
    assert M.binomials(d, part, whole, [x[3].encode() for x in asked]).tolist() == [binomial(x[0], x[1], x[2], *x[3].split("|")) for x in asked]


def test_repeated_measures_sum_levels_within_ranges(spark, monkeypatch):
    """Resampled level means come from sums of each range; no row is made for each draw, and groups with the same units share a tree."""
    monkeypatch.setattr(M, "draws", None)
    assert not hasattr(B, "draws")
    data = [(g, level, u, float(u * k % 11 + (k if g == "y" else 0))) for g in "xy" for u in range(600) for k, level in enumerate("pqr", 1)]
    long = spark.createDataFrame([*data, ("x", "p", 600, 1.0), ("x", "q", 5, None)], "g string, level string, id int, x double")
    got = {r.g: r for r in B.repeated_measures(long, ["g"], 9).collect()}
    for g in "xy":
        x = np.array([[v for h, level, u, v in data if h == g and level == k] for k in "pqr"])
        spread = []
        for b in range(9):
            w = weights(list(range(600)), b)
            means = x @ np.array([w[u] for u in range(600)]) / 600
            spread.append(means.max() - means.min())
        assert (got[g].n_ids, got[g].n_levels) == (600, 3)
        assert (got[g].range_lo, got[g].range_hi) == pytest.approx((np.quantile(spread, 0.025), np.quantile(spread, 0.975)))
