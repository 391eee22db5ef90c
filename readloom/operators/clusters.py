"""Reads in clusters: responsibilities, weighted counts, one step of expectation-maximisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def abundance(resps: DataFrame) -> DataFrame:
    """k, clust, n (sum of the weights), share within k."""
    sums = resps.groupBy("k", "clust").agg(F.sum("weight").alias("n"))
    return sums.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("k")))


def clustered_counts(muts: DataFrame, resps: DataFrame) -> DataFrame:
    """k, clust, pos, rel, n: codes weighted by their reads' responsibilities."""
    return muts.join(resps, "read").groupBy("k", "clust", "pos", "rel").agg(F.sum("weight").alias("n"))


def log_joint(uniq: DataFrame, rates: DataFrame, shares: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """uid, n, clust, logp of each unique read and cluster.

    ``uniq`` (uid, end5, end3, muts, n); ``rates`` (clust, pos, mu), ``shares`` (clust, p), both small; ``ends``
    (end5, end3, p). The log probability of no mutation between the ends comes from running sums at the
    ends, and each mutation adds its log odds.
    """
    w = Window.partitionBy("clust").orderBy("pos")
    cum = rates.select("clust", "pos", F.sum(F.log1p(-F.col("mu"))).over(w).alias("c"), F.log1p(-F.col("mu")).alias("no"), (F.log("mu") - F.log1p(-F.col("mu"))).alias("odds"))
    high = cum.select("clust", F.col("pos").alias("end3"), F.col("c").alias("high"))
    low = cum.select("clust", F.col("pos").alias("end5"), (F.col("c") - F.col("no")).alias("low"))
    base = uniq.join(high, "end3").join(low, ["end5", "clust"]).join(F.broadcast(shares), "clust")  # a row a cluster
    if ends is not None:
        base = base.join(ends.select("end5", "end3", F.col("p").alias("pe")), ["end5", "end3"])
    else:
        base = base.withColumn("pe", F.lit(1.0))
    odds = uniq.select("uid", F.explode("muts").alias("pos")).join(cum.select("clust", "pos", "odds"), "pos").groupBy("uid", "clust").agg(F.sum("odds").alias("odds"))
    return base.join(odds, ["uid", "clust"], "left").select("uid", "n", "clust", (F.log("p") + F.log("pe") + F.col("high") - F.col("low") + F.coalesce("odds", F.lit(0.0))).alias("logp"))


def responsibilities(joint: DataFrame) -> DataFrame:
    """uid, n, clust, weight, marginal (log-sum-exp over the clusters)."""
    w = Window.partitionBy("uid")
    top = joint.withColumn("_top", F.max("logp").over(w))
    marginal = top.withColumn("marginal", F.log(F.sum(F.exp(F.col("logp") - F.col("_top"))).over(w)) + F.col("_top"))
    return marginal.select("uid", "n", "clust", F.exp(F.col("logp") - F.col("marginal")).alias("weight"), "marginal")


def log_likelihood(resps: DataFrame) -> DataFrame:
    return resps.dropDuplicates(["uid"]).agg(F.sum(F.col("marginal") * F.col("n")).alias("log_like"))


def maximize(uniq: DataFrame, resps: DataFrame, positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observed rates (clust, pos, mu) and shares (clust, p) from weighted counts. Coverage per position
    is a running sum over counts by ends, so no read is expanded to its positions."""
    both = uniq.select("uid", "end5", "end3", "muts").join(resps.select("uid", "clust", (F.col("weight") * F.col("n")).alias("w")), "uid")
    shares = both.groupBy("clust").agg(F.sum("w").alias("w"))
    shares = shares.select("clust", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("p"))
    ends = both.groupBy("clust", "end5", "end3").agg(F.sum("w").alias("w"))
    steps = ends.select("clust", F.explode(F.array(F.struct(F.col("end5").alias("pos"), F.col("w").alias("d")), F.struct((F.col("end3") + 1).alias("pos"), (-F.col("w")).alias("d")))).alias("s")).groupBy("clust", "s.pos").agg(F.sum("s.d").alias("d"))
    grid = positions.select("pos").crossJoin(F.broadcast(shares.select("clust")))
    cover = grid.join(steps, ["clust", "pos"], "full").select("clust", "pos", F.sum(F.coalesce("d", F.lit(0.0))).over(Window.partitionBy("clust").orderBy("pos")).alias("cov"))
    hits = both.select("clust", "w", F.explode("muts").alias("pos")).groupBy("clust", "pos").agg(F.sum("w").alias("hits"))
    rates = grid.join(cover, ["clust", "pos"]).join(hits, ["clust", "pos"], "left").select("clust", "pos", F.when(F.col("cov") > 1e-9, F.coalesce("hits", F.lit(0.0)) / F.col("cov")).otherwise(0.0).alias("mu"))
    return rates, shares


def join_clusters(resps: DataFrame, regions: DataFrame) -> DataFrame:
    """Clusters of several regions as one: ``regions`` (reg, k, clust, joined) says which belong together;
    weights are summed by read and normalised within k."""
    sums = resps.join(F.broadcast(regions), ["reg", "k", "clust"]).groupBy("read", "k", "joined").agg(F.sum("weight").alias("w"))
    return sums.select("read", "k", F.col("joined").alias("clust"), (F.col("w") / F.sum("w").over(Window.partitionBy("read", "k"))).alias("weight"))


def join_regions(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Segments and mutations of two regions of the same reads as one. Raises when it runs if a position
    has different codes in both."""
    segments = a[0].select("read", "seg", "end5", "end3").unionByName(b[0].select("read", F.col("seg") + 1000, "end5", "end3").toDF("read", "seg", "end5", "end3")).distinct()
    merged = a[1].unionByName(b[1]).groupBy("read", "pos", "base").agg(F.min("rel").alias("rel"), F.max("rel").alias("_high"))
    return segments, merged.withColumn("rel", F.when(F.col("rel") == F.col("_high"), F.col("rel")).otherwise(F.raise_error(F.lit("two codes for one read and position")))).drop("_high")


def join_all(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Any number of regions of the same reads as one, each with the next."""
    out = parts[0]
    for i, part in enumerate(parts[1:], 1):
        shifted = part[0].withColumn("seg", F.col("seg") + 1000 * (i - 1))
        out = join_regions(out, (shifted, part[1]))
    return out
