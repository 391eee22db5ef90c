"""Registered queries on the choice of clusters and of domains, over reads with planted kinds of molecules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import read_model as rm
from .operators import reads
from .plans import clustering, clusterscan, domains
from .queries import MUT, _written, query

#: Pass more readily: the planted kinds are far apart.
LIMITS = clustering.Limits(max_arcd=0.25)


def _one_domain(spark, sf):
    """Unique reads of sample 0 within the first 80 positions, which are of two kinds."""
    segs, muts, pos = rm.planted(spark, sf)
    segs, muts = reads.clip(segs.where("sample = 0").drop("sample"), muts.where("sample = 0").drop("sample"), 1, 80)
    return _written(spark, clustering.prepare(reads.unique_reads(segs, reads.positive(muts, MUT))), "planted"), pos.where("sample = 0 and pos <= 80")


def _ranked(rates):
    """Clusters numbered by falling share."""
    order = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("share")))
    return rates.select("k", "clust", "share").distinct().select("k", "clust", order.cast("int").alias("kind"))


@query("best_clusters", f"""with {rm.SQL_PLANTED}, s as (select * from planted where sample = 0 and pos <= 80), r as (select row_number() over (order by count(*) desc) as clust, kind from s group by kind),
 rates as (select cast(2 as int) as k, cast(r.clust as int) as clust, s.pos, round(avg(hit), 1) as mu from s join r using (kind) group by 1, 2, 3) select * from rates""")
def best_clusters(spark, sf):
    """K is chosen from 1 on, all runs of K and K + 1 in the same passes; rates of the best run of the best K."""
    uniq, pos = _one_domain(spark, sf)
    k, runs = clustering.cluster(uniq, pos, min_runs=2, max_runs=2, limits=LIMITS, threshold=5.0)
    rates, shares = clustering.parameters(spark, clustering.best_run(runs[k], LIMITS))
    found = rates.join(shares, "clust").withColumn("k", F.lit(k))
    return found.join(_ranked(found), ["k", "clust"]).select("k", F.col("kind").alias("clust"), "pos", F.round("mu", 1).alias("mu"))


@query("cluster_runs", """with r as (select unnest([1, 2, 2]) as k, unnest([0, 0, 1]) as seed) select cast(k as int) as k, cast(seed as int) as seed, true as settled, true as rising, (select count(*) from orders where o_custkey % 2 = 0) as reads from r""")
def cluster_runs(spark, sf):
    """Runs of K = 1 and 2 in the same passes: whether each settled, and whether its likelihood never fell."""
    uniq, pos = _one_domain(spark, sf)
    runs = clustering.fit(uniq, {None: clustering.places(pos)}, [clustering.Start(1), clustering.Start(2, 0), clustering.Start(2, 1)])
    rows = [(r.params.k, r.seed, r.settled, all(b >= a - 1e-6 * abs(a) for a, b in zip(r.log_likes, r.log_likes[1:])), int(r.n_reads)) for r in runs]
    return spark.createDataFrame(rows, "k int, seed int, settled boolean, rising boolean, reads long")


@query("weights_by_k", """with n as (select count(*) as n from orders where o_custkey % 2 = 0) select cast(k as int) as k, n as reads from n, (select unnest([1, 2]) as k)""")
def weights_by_k(spark, sf):
    """Responsibilities of the best run of every K: those of one K add up to the reads."""
    uniq, pos = _one_domain(spark, sf)
    runs = clustering.fit(uniq, {None: clustering.places(pos)}, [clustering.Start(1), clustering.Start(2)])
    weighted = clustering.weights_by_k(uniq, {r.params.k: r for r in runs})
    return weighted.groupBy("k").agg(F.round(F.sum(F.col("weight") * F.col("n"))).cast("long").alias("reads"))


@query("clusterscan", """with n as (select o_custkey % 2 as sample, count(*) as reads from orders group by 1), d as (select unnest([0, 0, 1, 1, 1]) as sample, unnest([1, 81, 1, 41, 81]) as end5, unnest([80, 120, 40, 80, 120]) as end3, unnest([2, 1, 1, 1, 1]) as parts)
 select cast(sample as int) as sample, cast(end5 as int) as end5, cast(end3 as int) as end3, cast(2 as int) as k, cast(parts as int) as parts, reads from d join n using (sample)""")
def scan_clusters(spark, sf):
    """Domains of 40 positions in both samples, clustered together; the gap at 40 is spurious in sample 0 alone."""
    segs, muts, pos = rm.planted(spark, sf)
    tiles = spark.createDataFrame([(s, a, a + 39) for s in (0, 1) for a in (1, 41, 81)], "sample int, end5 int, end3 int")
    scan = clusterscan.clusterscan(segs, muts, pos, MUT, tiles, ["sample"], limits=LIMITS, min_runs=2, max_runs=2, threshold=5.0)
    table = scan.report(spark, "sample int").select("sample", "end5", "end3", "k", F.size("members").alias("parts"))
    return table.join(segs.groupBy("sample").agg(F.count("*").alias("reads")), "sample")


@query("planted_domains", f"""with {rm.SQL_PLANTED}, s as (select *, case when pos > 80 then 3 when pos > 40 and sample = 1 then 2 else 1 end as stretch from planted where hit = 1 and pos % 2 = 0) select sample, cast(min(pos) as int) as end5, cast(max(pos) as int) as end3, 'domain' as kind from s group by sample, stretch""")
def planted_domains(spark, sf):
    """Domains of both samples, from reads to pairs to blocks: positions whose mutations exclude each other."""
    segs, muts, pos = rm.planted(spark, sf)
    config = domains.ScanConfig(max_length=100)
    return domains.scan(segs, muts, pos, MUT, 0, config, ["sample"]).select("sample", "end5", "end3", "kind")
