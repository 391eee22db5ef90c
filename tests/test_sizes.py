"""Queries that were too slow or too large at size: what a task holds, and how often reads are passed over."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from readloom import queries, queries_clusters, queries_tables, read_model
from readloom.functions import sequences
from readloom.operators import alignments, profiles, reads
from readloom.plans import bias, clustering, domains
from readloom.sources import tables

SF = "/root/testdata/sf0.001"


def test_unique_reads_are_dealt_to_all_cores(spark):
    uniq, _ = queries_clusters._one_domain(spark, SF)
    assert uniq.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_shares_of_cluster_pairs_settle_in_few_passes():
    rng = np.random.default_rng(0)
    true = np.array([[0.4, 0.1], [0.2, 0.3]])
    cells = rng.choice(4, 4000, p=true.ravel())
    like = np.exp(rng.normal(0, 0.6, (4000, 4)) + 0.8 * np.eye(4)[cells])

    def weights(pi):
        joint = like * pi.ravel()
        return np.log(joint.sum(axis=1)).sum(), (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0).reshape(2, 2)

    for free in (True, False):
        pi, before, plain = np.full((2, 2), 0.25), -np.inf, 0
        while True:  # plain rounds
            now, resp = weights(pi)
            plain += 1
            pi = resp if free else np.outer(resp.sum(axis=1), resp.sum(axis=0))
            if now - before < 1e-8:
                break
            before = now
        search, passes = clustering._Mixture(2, 2, free, 1e-8), 0
        while not search.settled:
            search.take(*weights(search.pi))
            passes += 1
        assert passes < plain / 2 and search.like >= now - 1e-6
        assert np.abs(search.best - pi).max() < 1e-3


def test_reasons_alone_walk_no_read(spark):
    refs = queries._reference(spark)
    identified = alignments.identify(queries._aligned(spark, SF), refs)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan(alignments.pair(identified))
    assert "ArrowEvalPython" not in plan(alignments.rejected(alignments.pair(identified)))


def test_reads_that_are_alike_are_walked_once(monkeypatch):
    seen = []
    monkeypatch.setattr(alignments, "walk", lambda *a: seen.append(a) or ([(1, 4)], {2: 2}))
    alignments._walked.cache_clear()
    run = alignments._walker(25, 0, 0, True, True).func
    columns = [pa.array(x) for x in (["ACG", "ACG", "ACG", None], ["III", "III", "I!I", None], [5, 9, 5, None], ["1M1D2M", "1M1D2M", "1M1D2M", None], ["TTTTATCGATCG"] * 3 + [None])]
    got = run(*columns).to_pylist()
    alignments._walked.cache_clear()
    assert [x[0] for x in seen] == ["ACG", "ANG"]  # a base of low quality is N; the third has one
    assert got[:2] == [{"segs": [{"end5": p, "end3": p + 3}], "muts": [{"pos": p + 1, "rel": 2}]} for p in (5, 9)] and got[3] == {"segs": [], "muts": []}


def test_rolling_gini_deals_no_row_to_other_centres(spark):
    rows = spark.createDataFrame([("a", p, m) for p, m in ((1, 0.1), (2, None), (3, 0.5), (9, None), (20, 0.0))], "key string, pos int, mu double")
    found = profiles.rolling_gini(rows, ["key"], 3)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["pos"], r["gini"] and round(r["gini"], 9)) for r in found.collect()) == [(1, 0.0), (2, 0.333333333), (3, 0.0), (20, None)]


def test_parts_of_reads_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 500)
    rows = read_model.table(spark, SF, "lineitem").count()
    assert read_model.raw(spark, SF).rdd.getNumPartitions() == -(-rows // 500)


def test_read_table_passes_over_reads_once(spark):
    table = reads.read_table(*queries.model(spark, SF))
    assert table._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1


def test_stream_has_four_batches_of_files_that_grow_with_the_table(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "scratch_path", lambda spark, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr(tables, "ROWS", 500)
    queries_tables._running(spark, SF, "position")
    batches = sorted(tmp_path.glob("running/out/reads/batch=*"))
    files = len(list(tmp_path.glob("running/in/*.parquet")))
    assert len(batches) == 4 and files == -(-read_model.table(spark, SF, "lineitem").count() // 500)
    assert sum(spark.read.parquet(f"file://{b}").count() for b in batches) == spark.read.parquet(f"file://{tmp_path}/running/in").count()


def test_runs_of_a_base_are_found_without_a_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(3)
    seqs = ["", "AA", "AAA", "AAATAAAACA", "CAAAAA", None, *("".join(rng.choice(list("AAACGTN"), n)) for n in (50, 200, 999))]
    refs = spark.createDataFrame(list(enumerate(seqs)), "ref long, seq string")
    for piece, least in ((4096, 3), (7, 3), (7, 1), (7, 5)):
        monkeypatch.setattr(sequences, "ROWS_PIECE", piece)
        found = sequences.runs(refs, "A", least)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        want = reads.mask_poly(sequences.positions(refs), "A", least, ["ref"])
        rows = lambda df: sorted(tuple(r) for r in df.select("ref", "pos", "base").collect())
        assert rows(found) == rows(want) and rows(want)


def test_mask_polya_shuffles_nothing(spark):
    assert "Exchange" not in queries.mask_polya(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_bias_of_reads_is_solved_from_counts(spark, monkeypatch):
    held = {}
    monkeypatch.setattr(bias, "unbias_tables", lambda table, ends, gap, by: held.update(table=table, ends=ends))
    queries_tables._unbiased(spark, SF)
    segs, muts, pos = queries_tables._by(spark, SF)
    segs, muts = reads.collide(segs, muts, queries.MUT, 3, merge=False, by=queries_tables.BY)
    want = reads.ratios(reads.position_table(segs, muts, pos, by=queries_tables.BY), ["Mutated"], queries_tables.BY)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(held["table"]) == rows(want) and rows(held["ends"]) == rows(reads.end_counts(segs, by=queries_tables.BY))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(pos" not in plan(held["table"]) and "lag(pos" in plan(want)  # gaps within reads are not looked for again


def test_codes_of_reads_are_merged_without_sorting(spark):
    assert "SortAggregate" not in read_model.muts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in queries_tables._by(spark, SF)[1]._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_counted_in_one_pass_over_reads(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    held = plan(reads.confusion(*queries.model(spark, SF), queries.MUT, 4, 20))
    assert held.count("parquet") == 2  # segments and mutations
    segs, muts, pos = queries_tables._by(spark, SF)
    assert "RepartitionByExpression" not in plan(pos)  # which samples and references there are is known before reads are dealt


def test_pairs_of_listed_positions_with_repeated_and_masked_mutations(spark):
    rng = np.random.default_rng(5)
    ends = {("a" if i % 2 else "b", i): (int(lo), int(lo + n)) for i, (lo, n) in enumerate(zip(rng.integers(1, 9, 40), rng.integers(0, 9, 40)))}
    hits = {k: set(rng.integers(lo, hi + 1, 4).tolist()) for k, (lo, hi) in ends.items() if k[1] % 3}
    segs = spark.createDataFrame([(*k, 0, lo, hi) for k, (lo, hi) in ends.items()], "ref string, read long, seg int, end5 int, end3 int")
    rows = [(*k, p, "A", 128) for k, v in hits.items() for p in v]
    muts = spark.createDataFrame(rows + rows[::5] + [("a", 999, 3, "A", 128)], "ref string, read long, pos int, base string, rel int")
    listed = [p for p in range(1, 18) if p not in (4, 9)]
    pos = spark.createDataFrame([(r, p, "A") for r in "abc" for p in listed], "ref string, pos int, base string")
    weights = spark.createDataFrame([(*k, 0.5 + k[1]) for k in ends if k[1] != 7], "ref string, read long, weight double")
    for given, weight in ((None, lambda k: 1), (weights, lambda k: 0.5 + k[1] if k[1] != 7 else 0)):
        got = {tuple(r)[:3]: tuple(r)[3:] for r in reads.confusion(segs, muts, pos, queries.MUT, 1, 6, given, ["ref"]).collect()}
        want = {}
        for ref in "abc":
            for a in listed:
                for b in (b for b in listed if 1 < b - a <= 6):
                    over = [k for k, (lo, hi) in ends.items() if k[0] == ref and lo <= a and b <= hi]
                    kinds = [over, *([k for k in over if s <= hits.get(k, set())] for s in ({a}, {b}, {a, b}))]
                    want[ref, a, b] = tuple(sum(map(weight, ks)) for ks in kinds)
        assert got == want


def test_tails_of_few_pairs_are_dealt_to_all_cores(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(domains, "scratch_path", lambda spark, name: f"file://{tmp_path}/{name}")
    pairs = spark.createDataFrame([(i, i + 5, 1000 + i, 90, 80, i % 20) for i in range(1, 200)], "pos_a int, pos_b int, n long, a long, b long, ab long").groupBy("pos_a", "pos_b").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "ab")])
    assert domains.bridges(pairs, 100, 0.5).count() == 199
    assert len(list(tmp_path.glob("tests/*.parquet"))) >= spark.sparkContext.defaultParallelism


def test_passes_take_batches_whole():
    """A pass sums up Arrow batches of several regions as they come, their lists as one array; slices, empty lists and reads of no
    region included."""
    rng = np.random.default_rng(4)
    pos = {0: np.arange(1, 9), 1: np.arange(3, 15, 2)}
    rows = [(None if i % 11 == 0 else i % 2, int(a), int(a) + 7, sorted(rng.choice(16, i % 4, replace=False).tolist()), i % 3 + 1) for i, a in enumerate(rng.integers(0, 8, 60))]
    names = ["dom", "end5", "end3", "muts", "n"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema([("dom", pa.int32()), ("end5", pa.int32()), ("end3", pa.int32()), ("muts", pa.list_(pa.int32())), ("n", pa.int64())]))
    even = lambda part, reads: (np.full((len(reads.n), 1), 1.0), np.full(len(reads.n), 2.0))
    found = {}
    for out in clustering._sums([batch.slice(0, 23), batch.slice(23)], pos, {g: (g, 1, even) for g in pos}, "dom"):
        found |= {(r["run"], r["kind"], r["at"]): r["value"] for r in out.to_pylist()}
    for g, places in pos.items():
        held = [(a, b, muts, n) for d, a, b, muts, n in rows if d == g and any(a <= p <= b for p in places)]
        assert found[g, 0, 0] == 2 * sum(n for *_, n in held) and found[g, 1, 0] == sum(n for *_, n in held)
        hits = {i: sum(n for _, _, muts, n in held if p in muts) for i, p in enumerate(places.tolist())}
        assert {i: found.get((g, 3, i), 0) for i in hits} == hits


def test_later_passes_read_no_ids(spark, monkeypatch):
    """Ids are texts as long as the rest of a read; only first weights need them."""
    rows = [(f"{i:032x}", 1, 8, [p for p in range(1, 9) if (i * p) % 5 == 0], 1) for i in range(40)]
    uniq = spark.createDataFrame(rows, "uid string, end5 int, end3 int, muts array<int>, n long")
    seen, own = [], clustering._pass
    monkeypatch.setattr(clustering, "_pass", lambda reads, *rest: seen.append("uid" in reads.columns) or own(reads, *rest))
    clustering.fit(uniq, {None: np.arange(1, 9)}, [clustering.Start(2)], max_iterations=3)
    assert seen[0] and len(seen) > 2 and not any(seen[1:])
