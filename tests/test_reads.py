import collections
import itertools
import math
import random

import numpy as np
import pytest

from readloom.functions import codes, stats
from readloom.operators import alignments, demult, profiles, reads, structures
from readloom.plans import bias, clustering, domains, filtering
from readloom.sources import text


@pytest.mark.parametrize(("found", "gap", "kept"), [([], 2, []), ([3], 2, [3]), ([1, 4], 2, [1, 4]), ([1, 4], 3, [4]), ([2, 4], 3, [4]), ([1, 3, 5], 3, [1, 5]), ([1, 2, 3], 0, [1, 2, 3])])
def test_merge_close(spark, found, gap, kept):
    muts = spark.createDataFrame([(1, p) for p in found], "read long, pos int")
    assert sorted(r["pos"] for r in reads.merge_close(muts, gap).collect()) == kept


def test_benjamini_hochberg(spark):
    p = spark.createDataFrame([(i, 0, x) for i, x in enumerate([0.001, 0.009, 0.020, 0.051, 0.200])], "pos_a int, pos_b int, p double")  # fixed values
    q = [r["q"] for r in reads.benjamini_hochberg(p).orderBy("pos_a").collect()]
    assert q == pytest.approx([0.005, 0.0225, 0.1 / 3, 0.06375, 0.2])


def test_roc(spark):
    rows = spark.createDataFrame([(1, p, m, x) for p, (m, x) in enumerate([(0.1, True), (0.8, False), (0.2, True), (0.9, False)], 1)], "k int, pos int, mu double, paired boolean")
    curve = profiles.roc(rows, ["k"]).orderBy("i").collect()
    assert [r["fpr"] for r in curve] == [1, 0.5, 0, 0, 0] and [r["tpr"] for r in curve] == [1, 1, 1, 0.5, 0]
    assert profiles.auc(profiles.roc(rows, ["k"]), ["k"]).first()["auc"] == 1


def test_gini(spark):
    rows = spark.createDataFrame([(1, i / 10) for i in range(11)], "k int, mu double")
    assert profiles.gini(rows, ["k"]).first()["gini"] == pytest.approx(4 / 11)


def test_brackets(spark):
    pairs = text.brackets(spark.createDataFrame([("s", ".((<).>)")], "struct string, db string"))
    assert sorted((r["pos"], r["partner"]) for r in pairs.where("pos < partner").collect()) == [(2, 8), (3, 5), (4, 7)]
    assert text.bracket_strings(pairs, 8).first()["db"] == ".((<).>)"


def test_islands_and_coverage(spark):
    segs = spark.createDataFrame([(1, 0, 1, 3), (1, 1, 3, 5), (2, 0, 1, 1), (2, 1, 4, 5)], "read long, seg int, end5 int, end3 int")
    pos = spark.createDataFrame([(p, b) for p, b in zip(range(1, 6), "ACGTA")], "pos int, base string")
    assert [r["n"] for r in reads.coverage(segs, pos).orderBy("pos").collect()] == [2, 1, 1, 2, 2]
    assert [r["read"] for r in reads.discontiguous(segs).collect()] == [2]


def test_walk():
    ref = "CGGCATATC"
    segs, rels = alignments.walk("CGC", "III", 1, "2M1D1M", ref, 0, ambiguous=False)
    assert segs == [(1, 4)] and rels == {3: codes.DELETION}
    _, rels = alignments.walk("CGC", "III", 1, "2M1D1M", ref, 0)
    assert rels == {2: codes.DELETION | codes.MATCH, 3: codes.DELETION | codes.MATCH}
    for insert3, expected in ((True, {3: codes.INSERT_3}), (False, {2: codes.INSERT_5})):
        assert alignments.walk("CGTGC", "IIIII", 1, "2M1I2M", ref, 0, insert3=insert3)[1] == expected
    segs, rels = alignments.walk("CGCA", "IIII", 1, "2M1N2M", ref, 0)
    assert segs == [(1, 2), (4, 5)] and rels == {}


def alike(ref, seq, deleted, inserted):
    """Every way to pair a read with a reference that has so many indels of one kind and no mismatch."""
    out = []

    def go(columns, r, q, d, i):
        if r > len(ref) and q == len(seq):
            if (d, i) == (deleted, inserted) and None not in columns[0] and None not in columns[-1]:
                out.append(columns)
            return
        if r <= len(ref) and q < len(seq) and ref[r - 1] == seq[q]:
            go([*columns, (r, q)], r + 1, q + 1, d, i)
        if r <= len(ref) and d < deleted:
            go([*columns, (r, None)], r + 1, q, d + 1, i)
        if q < len(seq) and i < inserted:
            go([*columns, (None, q)], r, q + 1, d, i + 1)

    go([], 1, 0, 0, 0)
    return out


def test_ambiguous_indels():
    """Whichever alignment is given, a read gets the codes of all that are alike."""
    rng, seen = random.Random(1), 0
    for _ in range(1500):
        ref = "".join(rng.choice("AC") for _ in range(rng.randint(3, 9)))
        deleted, inserted = rng.choice([(1, 0), (0, 1), (2, 0), (0, 2), (3, 0)])
        seq = "".join(rng.choice("AC") for _ in range(len(ref) - deleted + inserted))
        every = alike(ref, seq, deleted, inserted) if len(seq) > 1 else []
        for insert3 in (True, False):
            expected = {}
            for columns in every:
                for i, (r, q) in enumerate(columns):
                    if r is not None:
                        beside = columns[i - 1 if insert3 else i + 1] if 0 < i < len(columns) - 1 or (i == 0) != insert3 else (0, 0)
                        expected[r] = expected.get(r, 0) | (codes.DELETION if q is None else (codes.INSERT_3 if insert3 else codes.INSERT_5) if beside[0] is None else codes.MATCH)
            for columns in every:
                cigar = "".join(f"{len(list(g))}{k}" for k, g in itertools.groupby("I" if r is None else "D" if q is None else "M" for r, q in columns))
                assert alignments.walk(seq, "I" * len(seq), 1, cigar, ref, 0, insert3=insert3)[1] == {k: v for k, v in expected.items() if v != codes.MATCH}
                seen += 1
    assert seen > 500


def test_identify(spark, tmp_path):
    """Bad reads are left out with their reasons; proper mates meet by segments, improper ones do not."""
    lines = [
        "@SQ\tSN:ref\tLN:9",
        "r1\t0\tref\t1\t40\t4M\t*\t0\t0\tCGAC\tIIII",
        "r2\t0\tref\t2\t5\t4M\t*\t0\t0\tGGCA\tIIII",  # mapped badly
        "r3\t0\tref\t7\t40\t4M\t*\t0\t0\tATCA\tIIII",  # leaves the reference
        "r4\t0\tref\t1\t40\t1M1D1I2M\t*\t0\t0\tCGAC\tIIII",
        "r5\t0\tref\t1\t40\t4M\t*\t0\t0\tCGA\tIII",
        "r6\t0\tref\t1\t40\t2D4M\t*\t0\t0\tCGAC\tIIII",
        "r7\t0\tother\t1\t40\t4M\t*\t0\t0\tCGAC\tIIII",
        "p1\t67\tref\t1\t40\t2M3N2M\t*\t0\t0\tCGTT\tIIII",  # the intron is not covered
        "p1\t147\tref\t3\t40\t4M\t*\t0\t0\tACAT\tIIII",
        "p2\t65\tref\t1\t40\t2M\t*\t0\t0\tCT\tII",
        "p2\t129\tref\t1\t40\t2M\t*\t0\t0\tCG\tII",
        "p3\t67\tref\t1\t40\t2M\t*\t0\t0\tCT\tII",
    ]
    path = tmp_path / "x.sam"
    path.write_text("\n".join(lines) + "\n")
    refs = spark.createDataFrame([("ref", "CGGCATATC")], "ref string, seq string")
    paired = alignments.pair(alignments.identify(text.read_sam(spark, str(path)), refs))
    segs, muts = alignments.tables(paired, refs, str(tmp_path / "reads"))
    assert sorted((r["read"], r["end5"], r["end3"]) for r in segs.collect()) == [("ref/p1", 1, 2), ("ref/p1", 3, 6), ("ref/p1", 6, 7), ("ref/p2/1", 1, 2), ("ref/p2/2", 1, 2), ("ref/r1", 1, 4)]
    # at 6 both mates cover: T in one, A of the reference... in the other it is T as well
    assert sorted((r["read"], r["pos"], r["rel"], r["base"]) for r in muts.collect()) == [("ref/p1", 3, codes.SUB_A, "G"), ("ref/p1", 7, codes.SUB_T, "A"), ("ref/p2/1", 2, codes.SUB_T, "G"), ("ref/r1", 3, codes.SUB_A, "G")]
    assert sum(r["n"] for r in alignments.rejected(paired).collect()) == 6
    cut = alignments.pair(alignments.identify(text.read_sam(spark, str(path)), refs), overhangs=False)
    assert [[tuple(s) for s in r["segs"]] for r in cut.where("read = 'ref/p1'").collect()] == [[(1, 2), (6, 6), (3, 6)]]


def test_identify_alike(spark):
    """Expressions and the walk agree on reads without indels."""
    rng = random.Random(2)
    ref = "".join(rng.choice("ACGTN") for _ in range(60))
    rows = []
    for i in range(200):
        parts, n = [], 0
        if rng.random() < 0.3:
            parts.append(f"{rng.randint(1, 3)}S")
        for k in range(rng.randint(1, 3)):
            parts += [f"{rng.randint(2, 5)}N"] * (k > 0) + [f"{rng.randint(1, 6)}{rng.choice('M=X')}"]
        if rng.random() < 0.3:
            parts.append(f"{rng.randint(1, 3)}S")
        length = sum(int(p[:-1]) for p in parts if p[-1] in "MS=X")
        rows.append((str(i), 0, "r", rng.randint(1, 20), 40, "".join(parts), "".join(rng.choice("ACGTN") for _ in range(length)), "".join(rng.choice("+5?I") for _ in range(length))))
    sam = spark.createDataFrame(rows, "name string, flag int, ref string, pos int, mapq int, cigar string, seq string, qual string")
    refs = spark.createDataFrame([("r", ref)], "ref string, seq string")
    for clip in (0, 2):
        for r in alignments.identify(sam, refs, clip5=clip, clip3=clip).collect():
            _, _, _, pos, _, cig, seq, qual = rows[int(r["name"])]
            segs, rels = alignments.walk(seq, qual, pos, cig, ref, 25, clip, clip)
            assert r["error"] is None and [tuple(s) for s in r["segs"]] == segs and [tuple(m) for m in r["muts"]] == sorted(rels.items()), rows[int(r["name"])]


def test_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACG\nT\n>y\nGG\n")
    assert {r["ref"]: r["seq"] for r in text.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {"x": "ACGT", "y": "GG"}
    (tmp_path / "a.fq").write_text("@r1 z\nACG\n+\n@@I\n@r2\nT\n+\nI\n")
    assert sorted(tuple(r) for r in text.read_fastq(spark, str(tmp_path / "a.fq")).collect()) == [("r1", "ACG", "@@I"), ("r2", "T", "I")]
    (tmp_path / "a.ct").write_text("3 t\n1 A 0 2 3 1\n2 C 1 3 0 2\n3 U 2 0 1 3\n")
    assert [r["partner"] for r in text.read_ct(spark, str(tmp_path / "a.ct")).orderBy("pos").collect()] == [3, 0, 1]


def test_demultiplex(spark):
    bars = spark.createDataFrame([("a", "AACC", 2), ("b", "GGTT", 2)], "name string, seq string, pos int")
    rows = spark.createDataFrame([(1, "TAACCT"), (2, "TAATCT"), (3, "TTTTTT"), (4, "TTGGTT")], "read long, seq string")
    assert sorted(tuple(r) for r in demult.assign(rows, bars, 1, 1).collect()) == [(1, "a"), (2, "a"), (4, "b")]


def test_tiles():
    assert domains.tiles(1, 100, 200) == [(1, 100)]
    made = domains.tiles(1, 100, 40, 0.25)
    assert made[0][0] == 1 and made[-1][1] == 100 and all(b[0] <= a[1] - 9 for a, b in zip(made, made[1:]))


def planted(rng, length=80, at=((11, 30), (31, 45), (60, 75)), gap=40, rate=0.9):
    """Every pair of a band, bridged within the planted domains and hardly elsewhere."""
    rows = []
    for a in range(1, length + 1):
        for b in range(a + 3, min(length, a + gap) + 1):
            inside = any(x <= a and b <= y for x, y in at)
            rows.append((a, b, rng.random() < (rate if inside else 0.002)))
    return rows


def test_domains(spark):
    """Planted domains are found, those of each region apart; sums of blocks and cuts are as by counting."""
    rng = random.Random(4)
    rows = planted(rng)
    band = domains.Band(*(np.array(x) for x in zip(*rows)), 1, 80, 40)
    for end in range(80):
        for length in (1, 5, 22, 40):
            start = end - length + 1
            if start >= 0:
                held = [r for r in rows if r[0] - 1 >= start and r[1] - 1 <= end]
                assert (band.inside[0][end, length - 1], band.inside[1][end, length - 1]) == (len(held), sum(r[2] for r in held))
    assert band.cuts[0].tolist() == [sum(a <= m < b for a, b, _ in rows) for m in range(1, 80)]
    both = [("x", *r) for r in rows] + [("y", *r) for r in planted(rng, at=((20, 40),))]
    table = spark.createDataFrame(both, "ref string, pos_a int, pos_b int, bridge boolean")
    config = domains.ScanConfig(max_length=40, min_length=8)
    got = domains.call(table, config, 1, 80, ["ref"]).collect()
    for ref, truth in (("x", [(11, 30), (31, 45), (60, 75)]), ("y", [(20, 40)])):
        found = sorted((r["end5"], r["end3"]) for r in got if r["ref"] == ref)
        assert len(found) == len(truth) and all(abs(a - c) <= 2 and abs(b - d) <= 2 for (a, b), (c, d) in zip(found, truth)), found
    filled = domains.call(table, domains.ScanConfig(max_length=40, min_length=8, gaps="fill"), 1, 80, ["ref"]).where("ref = 'x'").collect()
    assert sorted(p for r in filled for p in range(r["end5"], r["end3"] + 1)) == list(range(1, 81))
    assert domains.widen([(5, 10), (20, 22)], 1, 30, 12) == [(1, 12), (13, 24)]
    assert domains.split_evenly(1, 10, 4) == [(1, 3), (4, 6), (7, 10)]


def test_segment_exact():
    """The segmentation is as good as the best of all ways to choose blocks."""
    rng = random.Random(6)
    for _ in range(20):
        rows = planted(rng, 9, ((2, 5), (6, 9)), 8, 0.7)
        band = domains.Band(*(np.array(x) for x in zip(*rows)), 1, 9, 9)
        gain = {(s, e): float(domains.score(band.inside[0][e, e - s], band.inside[1][e, e - s], 0.1)) for e in range(9) for s in range(e + 1)}

        def best(at):
            return max([0.0] + [gain[s, e] + best(e + 1) for s in range(at, 9) for e in range(s, 9) if gain[s, e] >= 0])

        assert sum(gain[d] for d in band.segment(0.1, 1.0)) == pytest.approx(best(0))


def test_distributions():
    """Tails against exact sums and known values."""
    for n, p in ((7, 0.3), (40, 0.02), (200, 0.6)):
        pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        for k in (0, 1, n // 3, n // 2, n):
            assert float(stats.binomial_tail(k, n, p)) == pytest.approx(math.fsum(pmf[k:]), rel=1e-9, abs=1e-12)
        for q in (0.025, 0.5, 0.975):
            assert int(stats.binomial_quantile(q, n, p)) == next(k for k in range(n + 1) if math.fsum(pmf[: k + 1]) >= q - 1e-12)
    assert stats.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05) and stats.chi_square_tail(30, 10) == pytest.approx(0.000857, rel=1e-3)
    low, high = stats.student_interval([1.0, 2.0, 3.0, 4.0], 0.95)
    assert (low, high) == pytest.approx((2.5 - 3.182446 * math.sqrt(1.25 / 4), 2.5 + 3.182446 * math.sqrt(1.25 / 4)), rel=1e-5)


def simulated(rng, rates, ends, gap, merged):
    """A read: mutations at random; lost, or its close mutations merged."""
    a, b = ends
    muts = [j for j in range(a, b + 1) if rng.random() < rates[j]]
    if merged:
        kept = []
        for m in reversed(muts):
            if not kept or kept[-1] - m > gap:
                kept.append(m)
        return kept[::-1]
    return None if any(y - x <= gap for x, y in zip(muts, muts[1:])) else muts


@pytest.mark.parametrize("merged", [False, True])
def test_bias(merged):
    """The forward model against every possible read, and back."""
    rng = np.random.default_rng(3)
    n, gap = 7, 2
    p = rng.uniform(0.05, 0.5, n)
    ends = np.triu(rng.uniform(size=(n, n)))
    ends /= ends.sum()
    hit, cover = np.zeros(n), np.zeros(n)
    for a in range(n):
        for b in range(a, n):
            for picks in itertools.product((0, 1), repeat=b - a + 1):
                chance = ends[a, b] * math.prod(p[a + i] if x else 1 - p[a + i] for i, x in enumerate(picks))
                muts = [a + i for i, x in enumerate(picks) if x]
                if merged:
                    kept = []
                    for m in reversed(muts):
                        if not kept or kept[-1] - m > gap:
                            kept.append(m)
                elif any(y - x <= gap for x, y in zip(muts, muts[1:])):
                    continue
                else:
                    kept = muts
                cover[a : b + 1] += chance
                hit[kept] += chance
    model = bias.observed_merged if merged else bias.observed
    seen = model(p, ends, gap)
    assert seen == pytest.approx(hit / cover)
    assert bias.unbias(seen, ends, gap, merged=merged) == pytest.approx(p, abs=1e-4)
    if not merged:
        rates = np.array([p, p[::-1]])
        shares = np.array([0.7, 0.3])
        survive = np.array([bias.survival(ends, r, gap) for r in rates])
        f = np.array([bias.no_close(r, gap)[:n, 1:] for r in rates])
        mixed = np.tensordot(shares, ends[None] * f, 1)
        got = bias.unbias_all(np.array([bias.observed(r, ends, gap) for r in rates]), mixed / mixed.sum(), bias.seen_shares(shares, survive), gap)
        assert got[0] == pytest.approx(rates, abs=1e-4) and got[1] == pytest.approx(ends, abs=1e-4) and got[2] == pytest.approx(shares, abs=1e-4)


def test_assign():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 6):
        for _ in range(20):
            cost = rng.uniform(size=(n, n))
            order = clustering.assign(cost)
            assert sorted(order) == list(range(n))
            assert sum(cost[i, j] for i, j in enumerate(order)) == pytest.approx(min(sum(cost[i, j] for i, j in enumerate(x)) for x in itertools.permutations(range(n))))
    base = rng.uniform(size=(3, 20))
    regions = {"a": (np.arange(1, 11), base[:, :10]), "b": (np.arange(6, 16), base[[2, 0, 1], 5:15]), "c": (np.arange(11, 21), base[[1, 0, 2], 10:])}
    assert clustering.correspond(regions) == {"a": [0, 1, 2], "b": [2, 0, 1], "c": [1, 0, 2]}


def mixture(rng, n, gap=0, merged=False, length=24):
    """Reads of two clusters, as unique reads."""
    rates = [[0.02 + 0.4 * (j % 4 == 0) for j in range(length)], [0.02 + 0.4 * (j % 4 == 2) for j in range(length)]]
    found = collections.Counter()
    for _ in range(n):
        k = 0 if rng.random() < 0.65 else 1
        ends = (rng.randint(0, 3), rng.randint(length - 4, length - 1))
        muts = simulated(rng, rates[k], ends, gap, merged)
        if muts is not None:
            found[ends[0] + 1, ends[1] + 1, tuple(m + 1 for m in muts)] += 1
    return rates, [(f"{a}-{b}-{m}", a, b, list(m), n) for (a, b, m), n in found.items()]


@pytest.mark.parametrize(("gap", "merged"), [(0, False), (2, False), (2, True)])
def test_em(spark, gap, merged):
    """Two clusters are found with their rates and shares, also where close mutations are lost or merged."""
    truth, rows = mixture(random.Random(3), 4000, gap, merged)
    uniq = spark.createDataFrame(rows, "uid string, end5 int, end3 int, muts array<int>, n long").repartition(2).cache()
    pos = spark.range(1, 25).select("id").withColumnRenamed("id", "pos")
    run = clustering.run_em(uniq, pos, 2, 0, min_iterations=85 if gap else 10, max_iterations=120, threshold=2.0, min_gap=gap, merged=merged)
    assert run.settled and all(b > a - 1e-6 for a, b in zip(run.log_likes, run.log_likes[1:])) or gap
    order = clustering.match(np.array(truth), run.params.rates)
    assert np.abs(run.params.rates[order] - np.array(truth)).mean() < 0.025
    assert run.params.shares[order] == pytest.approx([0.65, 0.35], abs=0.05)
    one = clustering.run_em(uniq, pos, 1, 0, min_iterations=1, min_gap=gap, merged=merged)
    assert one.bic > run.bic and clustering.passes(run, clustering.Limits(max_arcd=1.0))
    w = clustering.weights(uniq, run.params).groupBy("uid").sum("weight").collect()
    assert all(r[1] == pytest.approx(1) for r in w)


def test_gap(spark):
    """Sides whose clusters go together fail the test, sides that do not pass."""
    rng = random.Random(8)
    left, right = [[0.5, 0.02, 0.5, 0.02], [0.02, 0.5, 0.02, 0.5]], [[0.02, 0.02, 0.5, 0.5], [0.5, 0.5, 0.02, 0.02]]
    for coupled in (True, False):
        rows = []
        for i in range(1500):
            a = rng.randint(0, 1)
            b = a if coupled else rng.randint(0, 1)
            rows.append((str(i), 1, 10, [j + 1 for j in range(4) if rng.random() < left[a][j]] + [j + 7 for j in range(4) if rng.random() < right[b][j]], 1))
        uniq = spark.createDataFrame(rows, "uid string, end5 int, end3 int, muts array<int>, n long").repartition(2)
        params = [clustering.Params(np.arange(first, first + 4), np.array(r), np.array([0.5, 0.5]), np.eye(4) / 4) for first, r in ((1, left), (7, right))]
        assert clustering.gap_test(uniq, *params, rounds=20)["passed"] is not coupled
    fitted = []
    merged, log = clustering.validate_gaps([(1, 5), (6, 9), (10, 20)], lambda a, b: fitted.append((a, b)) or (a, b), lambda x, y: {"passed": x[1] != 5, "coupling": 1.0})
    assert merged == [(1, 9), (10, 20)] and fitted == [(1, 5), (6, 9), (10, 20), (1, 9)] and len(log) == 1


def test_filter(spark):
    segs = spark.createDataFrame([(i, 0, 1, 5) for i in range(6)], "read long, seg int, end5 int, end3 int")
    muts = spark.createDataFrame([(0, 1, "A", 64), (0, 2, "C", 16), (1, 4, "A", 64)], "read long, pos int, base string, rel int")
    pos = spark.createDataFrame([(p, b) for p, b in zip(range(1, 6), "ACGAT")], "pos int, base string")
    done = filtering.filter_reads(segs, muts, pos, filtering.FilterConfig(mask_poly=0, min_gap=2))
    assert sorted(r["read"] for r in done.segments.collect()) == [1, 2, 3, 4, 5]
    assert sorted(r["pos"] for r in done.positions.collect()) == [1, 2, 4]
