import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.functions import codes, sequences as sq, stats
from readloom.plans import bias


def test_patterns():
    assert codes.parse("A -> G") == ("A", codes.SUB_G) and codes.parse("cd") == ("C", codes.DELETION) and codes.parse("aa") == ("A", codes.MATCH)
    yes, nos = codes.pattern()
    assert yes["A"] == 238 and nos["A"] == 1 and nos["N"] == 0
    with pytest.raises(ValueError):
        codes.counted(count=("ag",), no_count=("ag",))
    assert codes.invert((yes, nos)) == (nos, yes)


def test_fits(spark):
    rows = spark.createDataFrame([("A", 64), ("A", 1), ("A", 65), ("A", 255)], "base string, rel int")
    info, fit = codes.informative(F.col("base"), F.col("rel"), codes.pattern())
    assert [tuple(r) for r in rows.select(info, fit).collect()] == [(True, True), (True, False), (False, False), (False, False)]


def test_sequences(spark):
    row = spark.createDataFrame([("ACGTTN", "ar g\nu", "RA")], "s string, d string, i string").select(sq.revcomp(F.col("s")), sq.kmers(F.col("s"), 5), sq.clean(F.col("d")), sq.degenerate(F.col("i")), sq.locate(F.col("s"), F.lit("T")), sq.locate(F.col("s"), F.lit("GT")), sq.slice_padded(F.col("s"), -1, 2, "."), sq.slice_padded(F.col("s"), 4, 8, ".")).first()
    assert tuple(row) == ("NAACGT", ["ACGTT", "CGTTN"], "ANGT", ["AA", "GA"], None, 3, ".AC", "TN..")


def test_positions_back(spark):
    refs = spark.createDataFrame([("r", "ACGGT")], "ref string, seq string")
    index = sq.positions(refs)
    assert sq.sequence_of(index).first()["seq"] == "ACGGT"
    assert sq.sequence_of(index.where("pos <> 3")).first()["seq"] is None


def test_hypergeometric():
    low, high = stats.hypergeometric_tails([10], [5], [4], [2])
    assert low[0] == pytest.approx((5 + 50 + 100) / 210) and high[0] == pytest.approx((100 + 50 + 5) / 210)


def test_no_close_by_enumeration():
    p, gap = np.array([0.2, 0.1, 0.3, 0.25]), 2
    f = bias.no_close(p, gap)
    for a in range(4):
        for b in range(a, 4):
            total = 0.0
            for bits in range(1 << (b - a + 1)):
                at = [i for i in range(b - a + 1) if bits >> i & 1]
                if all(y - x > gap for x, y in zip(at, at[1:])):
                    total += np.prod([p[a + i] if bits >> i & 1 else 1 - p[a + i] for i in range(b - a + 1)])
            assert f[a, b + 1] == pytest.approx(total)


def test_unbias_round_trip():
    rng = np.random.default_rng(1)
    p = rng.uniform(0.01, 0.15, 20)
    ends = np.triu(rng.random((20, 20)))
    ends /= ends.sum()
    assert np.allclose(bias.unbias(bias.observed(p, ends, 3), ends, 3), p, atol=1e-5)
