"""Tails and quantiles as columns against exact arithmetic."""

import math
import random
from fractions import Fraction

import pytest

from readloom.functions import stats


def exact_tails(n, a, b, x):
    ways = {k: math.comb(a, k) * math.comb(n - a, b - k) for k in range(max(0, a + b - n), min(a, b) + 1)}
    total = math.comb(n, b)
    return float(Fraction(sum(w for k, w in ways.items() if k <= x), total)), float(Fraction(sum(w for k, w in ways.items() if k >= x), total))


def test_hypergeometric(spark):
    rng = random.Random(1)
    rows = [(1, 0, 0, 0), (1, 1, 1, 1), (10, 5, 4, 2), (10, 10, 3, 3), (50, 25, 25, 0), (50, 25, 25, 25), (3000, 1500, 1500, 600), (3000, 1500, 1500, 750), (3000, 20, 2900, 15), (3000, 2990, 2980, 2970)]
    for _ in range(80):
        n = rng.choice([5, 30, 200, 900])
        a, b = rng.randint(0, n), rng.randint(0, n)
        rows.append((n, a, b, rng.randint(max(0, a + b - n), min(a, b))))
    found = stats.hypergeometric(spark.createDataFrame(rows, "n long, a long, b long, ab long")).collect()
    for r in found:
        low, high = exact_tails(r["n"], r["a"], r["b"], r["ab"])
        assert r["low"] == pytest.approx(low, rel=1e-8, abs=1e-13) and r["high"] == pytest.approx(high, rel=1e-8, abs=1e-13)
        np_low, np_high = stats.hypergeometric_tails([r["n"]], [r["a"]], [r["b"]], [r["ab"]])
        assert np_low[0] == pytest.approx(r["low"], rel=1e-7, abs=1e-12) and np_high[0] == pytest.approx(r["high"], rel=1e-7, abs=1e-12)


def test_hypergeometric_of_many_reads_and_of_what_cannot_be(spark):
    rows = [(10_000_000, 3_000_000, 2_000_000, 600_000), (10_000_000, 3_000_000, 2_000_000, 590_000), (10, 4, 3, 5), (10, 12, 3, 1), (10, 4, 3, None)]
    found = stats.hypergeometric(spark.createDataFrame(rows, "n long, a long, b long, ab long")).collect()
    assert found[0]["low"] == pytest.approx(0.5, abs=0.01) and found[0]["low"] + found[0]["high"] > 1
    assert 0 <= found[1]["low"] < 1e-60 and found[1]["high"] == pytest.approx(1)
    assert [(r["low"], r["high"]) for r in found[2:]] == [(None, None)] * 3


def test_log_factorials(spark):
    numbers = [0, 1, 2, 15, 16, 17, 100, 10**6, 10**9]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select(stats.log_factorials(stats.F.col("n")).alias("l")).collect()
    assert [r["l"] for r in got] == pytest.approx([math.lgamma(n + 1) for n in numbers], rel=1e-14, abs=1e-13)


def test_binomial_quantiles(spark):
    rng = random.Random(2)
    rows = [(0, 10), (10, 10), (0, 0), (1, 2), (5, 10), (None, 5), *[(rng.randint(1, n - 1), n) for n in (3, 20, 150) for _ in range(8)]]
    found = stats.with_intervals(spark.createDataFrame(rows, "k long, n long"), "k", "n", 0.9).collect()
    for r in found:
        k, n = r["k"] or 0, r["n"]
        if k in (0, n):
            assert (r["k_low"], r["k_high"]) == (k, k)
            continue
        total, ends = 0, []
        p = Fraction(k, n)
        for i in range(n + 1):
            total += math.comb(n, i) * p**i * (1 - p) ** (n - i)
            ends.append(float(total))
        assert r["k_low"] == next(i for i, c in enumerate(ends) if c >= 0.05) and r["k_high"] == next(i for i, c in enumerate(ends) if c >= 0.95)


def test_resampled_counts(spark):
    """Drawn anew, counts have the mean and variance of binomials."""
    table = spark.range(4000).selectExpr("id as pos", "30L as k", "100L as n")
    drawn = [r["k"] for r in stats.resample(table, "k", "n", ["pos"], 3).collect()]
    mean = sum(drawn) / len(drawn)
    assert mean == pytest.approx(30, abs=0.4) and sum((d - mean) ** 2 for d in drawn) / len(drawn) == pytest.approx(21, rel=0.1)
