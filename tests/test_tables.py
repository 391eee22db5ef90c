"""Keys, files and further operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.functions import codes, stats
from readloom.operators import profiles, reads, regions
from readloom.plans import filtering
from readloom.sources import tables, text


def made(spark, seed, n=150, length=30):
    """Segments, mutations and positions of random reads, some of two segments."""
    rng = random.Random(seed)
    segs, muts = [], []
    for i in range(n):
        a = rng.randint(1, 12)
        b = rng.randint(15, length)
        if rng.random() < 0.3:
            m = rng.randint(a, b)
            segs += [(i, 0, a, m), (i, 1, m - rng.randint(-2, 3), b)]
        else:
            segs.append((i, 0, a, b))
        for p in range(a, b + 1):
            if rng.random() < 0.06:
                muts.append((i, p, "ACGT"[p % 4], rng.choice([2, 8, 16, 128, 3])))
    pos = [(p, "ACGT"[p % 4]) for p in range(1, length + 1)]
    return spark.createDataFrame(segs, "read long, seg int, end5 int, end3 int"), spark.createDataFrame(muts, "read long, pos int, base string, rel int"), spark.createDataFrame(pos, "pos int, base string")


def keyed(parts):
    """Several inputs as one, told apart by a key."""
    out = None
    for name, frames in parts.items():
        marked = [f.withColumn("ref", F.lit(name)) for f in frames]
        out = marked if out is None else [x.unionByName(y) for x, y in zip(out, marked)]
    return out


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_keys(spark):
    """Every table by key is what it is for each key alone."""
    parts = {"x": made(spark, 1), "y": made(spark, 2)}
    both = keyed(parts)
    pat = codes.pattern()
    by = ["ref"]
    cases = [
        (lambda s, m, p, **k: reads.coverage(s, p, **k), ("pos", "n")),
        (lambda s, m, p, **k: reads.position_table(s, m, p, **k), ("pos", "Covered", "Matched", "Mutated", "Deleted", "Informative")),
        (lambda s, m, p, **k: reads.read_counts(s, m, p.where("base <> 'G'"), pat, **k), ("read", "cov", "info", "fit")),
        (lambda s, m, p, **k: reads.confusion(s, m, p, pat, 3, **k), ("pos_a", "pos_b", "n", "a", "b", "ab")),
        (lambda s, m, p, **k: reads.distance_histogram(m, **k), ("dist", "n")),
        (lambda s, m, p, **k: reads.collide(s, m, pat, 3, True, **k)[1], ("read", "pos", "rel")),
        (lambda s, m, p, **k: reads.mask_poly(p.withColumn("base", F.lit("A")), "A", 5, **k), ("pos", "base")),
        (lambda s, m, p, **k: reads.median_length(s, **k), ("median",)),
    ]
    for make, columns in cases:
        whole = make(*both, by=by)
        for name, frames in parts.items():
            assert rows(whole.where(F.col("ref") == name), *columns) == rows(make(*frames), *columns)


@pytest.mark.parametrize("merge", [False, True])
def test_filter_keys(spark, merge):
    """Rounds go on until nothing changes, for each reference as if it were alone."""
    parts = {"x": made(spark, 3), "y": made(spark, 4)}
    config = filtering.FilterConfig(mask_bases="G", mask_poly=0, min_cov=8, min_info_share=0.9, max_mut_share=0.25, min_gap=2, merge_close=merge, min_info_pos=60, max_mut_pos=0.06)
    whole = filtering.filter_reads(*keyed(parts), config, by=["ref"])
    rounds = []
    for name, frames in parts.items():
        alone = filtering.filter_reads(*frames, config)
        rounds.append(alone.rounds)
        for attribute, columns in (("positions", ("pos",)), ("segments", ("read", "end5", "end3")), ("muts", ("read", "pos", "rel"))):
            assert rows(getattr(whole, attribute).where(F.col("ref") == name), *columns) == rows(getattr(alone, attribute), *columns)
        again = filtering.filter_reads(alone.segments, frames[1], alone.positions, config)
        assert rows(again.positions, "pos") == rows(alone.positions, "pos")
    assert max(rounds) > 1


def test_adjusted(spark):
    """q-values with ties, whatever the buckets, against sorting all."""
    rng = random.Random(1)
    p = [round(rng.random() ** 2, 2) for _ in range(300)] + [1.0] * 40
    order = np.argsort(p)[::-1]
    expected = np.empty(len(p))
    expected[order] = np.minimum.accumulate(np.array(p)[order] * len(p) / np.arange(len(p), 0, -1))
    table = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(-1, None)], "i int, p double").repartition(5)
    for buckets in (2, 7, 256):
        got = {r["i"]: r["q"] for r in reads.benjamini_hochberg(table, buckets=buckets).collect()}
        assert got[-1] is None and [got[i] for i in range(len(p))] == pytest.approx(expected.tolist())


def test_validation(spark):
    sound = spark.createDataFrame([(1, 5, 10, 4, 3, 2)], "pos_a int, pos_b int, n long, a long, b long, ab long")
    assert reads.validate_confusion(sound).count() == 1
    for bad in ((1, 5, 3, 4, 3, 2), (1, 5, 10, 1, 3, 2)):
        with pytest.raises(Exception, match="impossible counts"):
            reads.validate_confusion(spark.createDataFrame([bad], sound.schema)).collect()


def test_table_files(spark, tmp_path):
    table = spark.createDataFrame([("r", 1, 0.12345678, None), ("s", 2, 1.0, "x")], "ref string, pos int, mu double, name string")
    tables.write_table(table, str(tmp_path / "t"), 3)
    assert rows(tables.read_table(spark, str(tmp_path / "t"), "ref string, pos int, mu double, name string"), "ref", "pos", "mu") == [("r", 1, 0.123), ("s", 2, 1.0)]
    (tmp_path / "m.csv").write_text("ref,kind,name\nr,7,y\ns,8,x\n")
    joined = tables.add_metadata(table, tables.read_metadata(spark, str(tmp_path / "m.csv")), "ref")
    assert rows(joined, "ref", "name", "kind") == [("r", "y", 7), ("s", "x", 8)]
    with pytest.raises(Exception, match="two values of name"):
        tables.add_metadata(table.withColumn("name", F.lit("z")), tables.read_metadata(spark, str(tmp_path / "m.csv")), "ref").collect()
    (tmp_path / "b.csv").write_text("name,ref,seq,end5,end3,pos\na,,ACGT,,,3\nb,r,,2,5,\n")
    codes_ = regions.barcodes(spark.createDataFrame([("r", "GGATTCCC")], "ref string, seq string"), tables.read_barcodes(spark, str(tmp_path / "b.csv")))
    assert rows(codes_, "name", "seq", "pos", "rc") == [("a", "ACGT", 3, "ACGT"), ("b", "GATT", 2, "AATC")]
    (tmp_path / "c.csv").write_text("name,ref,seq,end5,end3,pos\na,r,ACGT,1,4,3\n")
    with pytest.raises(Exception, match="a barcode needs"):
        tables.read_barcodes(spark, str(tmp_path / "c.csv")).collect()


def test_fastq_files(spark, tmp_path):
    for name in ("s_R1.fq", "s_R2.fq", "t.fastq", "u_1.fastq.gz"):
        (tmp_path / name).write_text("@r\nACGT\n+\nIIII\n")
    found = rows(text.fastq_units(spark, str(tmp_path)), "name", "kind")
    assert found == [("s", "pair"), ("t", "single"), ("u", "single")]
    records = text.read_fastq(spark, str(tmp_path / "t.fastq"))
    assert rows(text.fastq_slices(records, [(1, 3), (2, 6), (-2, 1)]), "slice", "seq", "qual") == [(0, "CG", "II"), (1, "GTNN", "II!!"), (2, "NNA", "!!I")]
    assert text.count_reads(spark, str(tmp_path / "t.fastq")) == 1


def test_regions(spark):
    refs = spark.createDataFrame([("r", "AACCGGTTAC")], "ref string, seq string")
    wanted = "ref string, reg string, end5 int, end3 int, fwd string, rev string"
    found = regions.regions(refs, spark.createDataFrame([("r", "a", 2, 8, None, None), ("r", "b", None, None, "AACC", "GTA"), ("r", None, None, None, None, None)], wanted))
    assert rows(found, "reg", "end5", "end3") == [("a", 2, 8), ("b", 5, 7), ("full", 1, 10)]
    for bad in (("r", "x", 2, 8, "AACC", None), ("r", "x", None, None, "AC", None), ("r", "x", 0, 3, None, None)):
        with pytest.raises(Exception, match="region x"):
            regions.regions(refs, spark.createDataFrame([bad], wanted)).collect()


def test_intervals(spark):
    table = spark.createDataFrame([(1, 5, 20), (2, 0, 10), (3, 7, 7), (4, 0, 0)], "pos int, k int, n int")
    got = {r["pos"]: (r["k_low"], r["k_high"]) for r in stats.with_intervals(table, "k", "n").collect()}
    assert got == {1: (2, 9), 2: (0, 0), 3: (7, 7), 4: (0, 0)}
    drawn = [rows(stats.resample(table.repartition(n), "k", "n", ["pos"], 5), "pos", "k") for n in (1, 3)]
    assert drawn[0] == drawn[1] and all(0 <= k <= n for (_, k), n in zip(drawn[0], (20, 10, 7, 0)))
    assert any(rows(stats.resample(table, "k", "n", ["pos"], seed), "pos", "k") != drawn[0] for seed in range(6, 12))


def test_complete(spark):
    p = spark.createDataFrame([("a", 1, 0.1), ("a", 2, None), ("b", 1, 0.2), ("b", 2, 0.3), ("b", 3, None)], "s string, pos int, mu double")
    assert rows(profiles.complete(p, ["pos"], "s"), "pos") == [(1,), (1,)]
    assert rows(profiles.complete(p, ["pos"], "s", every=False), "pos") == [(1,), (1,), (2,), (2,)]
