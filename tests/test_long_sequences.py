"""k-mers of sequences longer than the pieces they are taken from, in time that grows with the length."""

import time

from pyspark.sql import functions as F

from readloom.functions import sequences as sq


def test_kmers(spark):
    text = "".join("ACGT\n\U0001f600"[(i * i + i // 7) % 6] for i in range(300))
    cases = [text[:n] for n in (0, 1, 2, 3, 63, 64, 65, 66, 67, 128, 129, 130, 300)]
    found = spark.createDataFrame([(t,) for t in cases], "t string").select("t", *[sq.kmers(F.col("t"), k).alias(f"k{k}") for k in (1, 3, 5)]).collect()
    for r in found:
        for k in (1, 3, 5):
            assert r[f"k{k}"] == [r["t"][i : i + k] for i in range(len(r["t"]) - k + 1)]
    none = spark.range(1).select(sq.kmers(F.lit(None).cast("string"), 3).alias("k")).first()
    assert none["k"] == []


def test_kmers_of_a_long_sequence(spark):
    """Half a million letters: by substrings of the whole they would be 10^11 steps."""
    start = time.time()
    n = spark.range(1).select(F.size(sq.kmers(F.repeat(F.lit("ACGTN"), 100_000), 3)).alias("n")).first()["n"]
    assert n == 499_998 and time.time() - start < 15
