"""Clusters of every domain of every region, and domains merged where their clusters go together.

The unique reads of all regions are one table. Domains to be fitted are cut out of it in one job, and all their runs share
the passes of clustering.fit(); all gaps to be tested share those of clustering.gap_tests(). What is held on the driver
is as large as domains by clusters by positions.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reads
from ..sources import tables
from . import clustering
from .clustering import Params, Run


@dataclasses.dataclass(frozen=True)
class Fit:
    """A domain's number of clusters (0: no run passes), its runs by K, and the parameters of the best run."""

    k: int
    runs: dict[int, list[Run]]
    params: Params | None
    region: int = 0


@dataclasses.dataclass
class Scan:
    """Domains, (end5, end3, number of their region), fits by domain, the domains each is made of, and what was merged."""

    by: list[str]
    keys: list[tuple]
    domains: list[tuple[int, int, int]]
    fits: dict[tuple[int, int, int], Fit]
    members: dict[tuple[int, int, int], list[tuple[int, int]]]
    log: list[dict]

    def report(self, spark, types: str) -> DataFrame:
        """by, end5, end3, k, members (array of end5, end3): a row for each final domain. ``types``: those of the keys, as a schema."""
        rows = [(*self.keys[d[2]], d[0], d[1], self.fits[d].k, [{"end5": a, "end3": b} for a, b in self.members[d]]) for d in self.domains]
        return spark.createDataFrame(rows, ", ".join(x for x in (types, "end5 int, end3 int, k int, members array<struct<end5:int,end3:int>>") if x))

    def rates(self, spark, types: str) -> DataFrame:
        """by, end5, end3, clust, share, pos, mu of the best run of each final domain."""
        rows = []
        for d in self.domains:
            if (p := self.fits[d].params) is not None:
                rows += [(*self.keys[d[2]], d[0], d[1], c + 1, float(p.shares[c]), int(x), float(p.rates[c, i])) for c in range(p.k) for i, x in enumerate(p.pos)]
        return spark.createDataFrame(rows, ", ".join(x for x in (types, "end5 int, end3 int, clust int, share double, pos int, mu double") if x))


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written once, for the many passes to come, in files for all cores."""
    path = tables.scratch_path(df.sparkSession, name)
    tables.dealt(df, "uid").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(unique: DataFrame, domains: list[tuple[int, int, int]], least: int = 1) -> DataFrame:
    """dom, uid, end5, end3, muts, n: the unique reads (region, end5, end3, muts, n) within each domain, which is numbered as it
    comes; those of ``least`` positions there. Reads that are alike within are one."""
    cells: dict[int, list] = {}
    for i, (a, b, region) in enumerate(domains):
        cells.setdefault(region, []).append((i, a, b))
    table = unique.sparkSession.createDataFrame([(region, [{"dom": i, "a": a, "b": b} for i, a, b in ds]) for region, ds in cells.items()], "region int, cells array<struct<dom:int,a:int,b:int>>")
    met = unique.join(table, "region").select("end5", "end3", "muts", "n", F.explode(F.filter("cells", lambda c: F.least("end3", c["b"]) - F.greatest("end5", c["a"]) + 1 >= least)).alias("c"))
    inside = met.select(F.col("c.dom").alias("dom"), F.greatest("end5", "c.a").alias("end5"), F.least("end3", "c.b").alias("end3"), F.filter("muts", lambda m: m.between(F.col("c.a"), F.col("c.b"))).alias("muts"), "n")
    alike = inside.groupBy("dom", "end5", "end3", "muts").agg(F.sum("n").alias("n"))
    half = lambda salt: F.lpad(F.hex(F.xxhash64(F.lit(salt), "end5", "end3", "muts")), 16, "0")
    return alike.withColumn("uid", F.concat(half("a"), half("b")))


def clusterscan(segments: DataFrame, muts: DataFrame, positions: DataFrame, pat: tuple, domains: DataFrame, by: Sequence[str] = (), validate: bool = True, min_assoc: float = 0.1, min_cover: int = 1, limits: clustering.Limits | None = None, **options) -> Scan:
    """Clusters each domain (by, end5, end3) and, with ``validate``, merges neighbours whose clusters depend on each other
    in the reads that reach into both, and clusters these anew, until every gap that is left is genuine.

    ``positions`` are those that are not masked; mutations elsewhere do not count. A domain without reads or positions has no
    clusters and is merged with nothing. ``options``: those of clustering.cluster_all()."""
    by, limits = list(by), limits or clustering.Limits()
    spark = segments.sparkSession
    listed = sorted({tuple(r) for r in domains.select(*by, "end5", "end3").collect()})
    keys = sorted({r[: len(by)] for r in listed})
    number = {key: i for i, key in enumerate(keys)}
    start = [(a, b, number[key]) for *key_, a, b in listed for key in [tuple(key_)]]
    held: dict[int, list[int]] = {i: [] for i in number.values()}
    for r in positions.select(*by, "pos").distinct().collect():
        if tuple(r[: len(by)]) in number:
            held[number[tuple(r[: len(by)])]].append(r["pos"])
    held = {i: np.array(sorted(x), np.int64) for i, x in held.items()}

    hits = reads.positive(muts, pat).join(positions.select(*by, "pos"), [*by, "pos"], "left_semi")
    unique = clustering.prepare(reads.unique_reads(segments, hits, by), *by)
    if by:
        types = dict(segments.dtypes)
        unique = unique.join(spark.createDataFrame([(*k, i) for k, i in number.items()], ", ".join([*(f"{c} {types[c]}" for c in by), "region int"])), by).drop(*by)
    else:
        unique = unique.withColumn("region", F.lit(0))
    unique = _written(unique, "scan")

    def places(d: tuple[int, int, int]) -> np.ndarray:
        return held[d[2]][(held[d[2]] >= d[0]) & (held[d[2]] <= d[1])]

    def fit_all(new: list[tuple[int, int, int]]) -> list[Fit]:
        table = _written(cut(unique, new, min_cover), "domains")
        some = {r["dom"] for r in table.select("dom").distinct().collect()}
        found = clustering.cluster_all(table, {i: places(d) for i, d in enumerate(new) if i in some and len(places(d))}, "dom", limits=limits, **options)
        out = []
        for i in range(len(new)):
            k, runs = found.get(i, (0, {}))
            out.append(Fit(k, runs, clustering.best_run(runs[k], limits).params if k else None, new[i][2]))
        return out

    def test_all(pairs: list[tuple[Fit, Fit]]) -> list[dict]:
        known = [i for i, (a, b) in enumerate(pairs) if a.params is not None and b.params is not None]
        tests = clustering.gap_tests(unique, [(pairs[i][0].params, pairs[i][1].params) for i in known], min_assoc, column="region", groups=[pairs[i][0].region for i in known])
        out = [{"passed": True, "reason": "no clusters on a side"} for _ in pairs]
        for i, t in zip(known, tests, strict=True):
            out[i] = t
        return out

    if not validate:
        fits = dict(zip(start, fit_all(start), strict=True))
        return Scan(by, keys, start, fits, {d: [d[:2]] for d in start}, [])
    done, fits, log = clustering.settle(start, fit_all, test_all, lambda d: d[2])
    members = {d: [s[:2] for s in start if s[2] == d[2] and d[0] <= s[0] and s[1] <= d[1]] for d in done}
    return Scan(by, keys, done, fits, members, log)
