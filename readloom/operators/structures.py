"""Base pairs and regions: pairs (struct, pos, partner; both directions, as in a CT table) and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio


def opening(pairs: DataFrame) -> DataFrame:
    """Each pair once: struct, end5, end3."""
    return pairs.where("partner > pos").select("struct", F.col("pos").alias("end5"), F.col("partner").alias("end3"))


def root_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that no other pair encloses: none that opens before reaches further."""
    before = Window.partitionBy("struct").orderBy("end5").rangeBetween(Window.unboundedPreceding, -1)
    reach = opening(pairs).withColumn("_reach", F.max("end3").over(before))
    return reach.where("struct is null or _reach is null or _reach <= end3").drop("_reach")


def enclosing(positions: DataFrame, pairs: DataFrame) -> DataFrame:
    """struct, pos, end5, end3 of the innermost pair strictly around each position."""
    listed = F.array_sort(F.collect_list(F.struct((F.col("end3") - F.col("end5")).alias("width"), "end5", "end3")))
    p = opening(pairs).groupBy("struct").agg(listed.alias("_pairs"), F.min("end5").alias("_low"), F.max("end3").alias("_high"))
    met = p.join(F.broadcast(positions.select("pos").distinct()), (F.col("pos") > F.col("_low")) & (F.col("pos") < F.col("_high")))
    around = F.filter("_pairs", lambda b: (b["end5"] < F.col("pos")) & (b["end3"] > F.col("pos")))
    return met.select("struct", "pos", F.explode(F.slice(around, 1, 1)).alias("p")).select("struct", "pos", "p.end5", "p.end3")


def internal(pairs: DataFrame) -> DataFrame:
    """struct, pos, partner of pairs stacked on both sides: neighbours pair with the partner's neighbours."""
    w = Window.partitionBy("struct").orderBy("pos")
    around = pairs.select("*", F.lag("pos").over(w).alias("p5"), F.lag("partner").over(w).alias("q5"), F.lead("pos").over(w).alias("p3"), F.lead("partner").over(w).alias("q3"))
    return around.where("p5 = pos - 1 and q5 = partner + 1 and p3 = pos + 1 and q3 = partner - 1").select("struct", "pos", "partner")


def stems(pairs: DataFrame) -> DataFrame:
    """Stacks of pairs: struct, end5, end3 of the outer pair, and length."""
    w = Window.partitionBy("struct", "_sum").orderBy("end5")
    marked = opening(pairs).withColumn("_sum", F.col("end5") + F.col("end3")).withColumn("_run", F.col("end5") - F.row_number().over(w))
    return marked.groupBy("struct", "_sum", "_run").agg(F.min("end5").alias("end5"), F.max("end3").alias("end3"), F.count("*").alias("length")).drop("_sum", "_run")


def wfmi(a: DataFrame, b: DataFrame, positions: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """key, wfmi: weighted Fowlkes-Mallows index of two structures over the positions (key, pos)."""
    j = positions.select(*key, "pos").join(a.select(*key, "pos", F.col("partner").alias("x")).hint("merge"), [*key, "pos"], "left").join(b.select(*key, "pos", F.col("partner").alias("y")).hint("merge"), [*key, "pos"], "left")
    s = j.groupBy(*key).agg(F.count_if(F.expr("x is null and y is null")).alias("u"), F.count_if(F.expr("x is not null or y is not null")).alias("p"), F.count("x").alias("n1"), F.count("y").alias("n2"), F.count_if(F.expr("x = y")).alias("n12"))
    fmi = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n12") / F.sqrt(F.col("n1") * F.col("n2"))).otherwise(0.0)
    share = ratio(F.col("u"), F.col("u") + F.col("p"))
    return s.select(*key, (share + (1 - share) * fmi).alias("wfmi"))


def renumber(pairs: DataFrame, offset: int) -> DataFrame:
    return pairs.withColumn("pos", F.col("pos") + offset).withColumn("partner", F.when(F.col("partner") > 0, F.col("partner") + offset).otherwise(F.col("partner")))


def intersect(regions: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, end5, end3 common to all; null where nothing is."""
    cut = regions.groupBy(*key).agg(F.max("end5").alias("a"), F.min("end3").alias("b"))
    return cut.select(*key, F.when(F.col("a") <= F.col("b"), F.col("a")).alias("end5"), F.when(F.col("a") <= F.col("b"), F.col("b")).alias("end3"))


def unite(regions: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """key, end5, end3 over all, and the positions in between that none has: key, pos."""
    hull = regions.groupBy(*key).agg(F.min("end5").alias("end5"), F.max("end3").alias("end3"))
    outer = F.array(F.col("end5") - 1, F.col("end3") + 1)  # the places beside the hull close its first and last gap
    marks = hull.where("end5 <= end3").select(*key, F.explode(outer).alias("end5")).select(*key, "end5", F.col("end5").alias("end3"))
    before = Window.partitionBy(*key).orderBy("end5").rowsBetween(Window.unboundedPreceding, -1)
    reach = regions.where("end5 <= end3").select(*key, "end5", "end3").unionByName(marks).withColumn("_reach", F.max("end3").over(before))
    gaps = reach.where("_reach + 1 < end5").select(*key, F.explode(F.sequence(F.col("_reach") + 1, F.col("end5") - 1)).alias("pos"))
    return hull, gaps


def crossing(pairs: DataFrame, positions: DataFrame) -> DataFrame:
    """pos, n: pairs (pos_a, pos_b) that a cut right after each position would sever."""
    steps = pairs.select(F.explode(F.array(F.struct(F.col("pos_a").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("pos_b").alias("pos"), F.lit(-1).alias("d")))).alias("s")).groupBy("s.pos").agg(F.sum("s.d").alias("d"))
    return positions.select("pos").join(steps, "pos", "left").select("pos", F.sum(F.coalesce("d", F.lit(0))).over(Window.orderBy("pos")).alias("n"))
