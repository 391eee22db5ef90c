"""Reads: counting, distances between mutations, unique reads, mates, filters by read and position.

Tables: ``segments`` (read, seg, end5, end3), ``muts`` (read, pos, base, rel; codes other than 1),
``positions`` (pos, base). Every operator also takes further key columns in ``by``, such as sample or ref, which then
all its tables have; reads are told apart by (by, read).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.stats import ratio


def _steps(spans: DataFrame, by: Sequence[str], weight: Column, first: Column | str = "end5", after: Column | None = None) -> DataFrame:
    """by, pos, d: what a running sum over positions turns into coverage by these spans."""
    start = F.col(first) if isinstance(first, str) else first
    after = F.col("end3") + 1 if after is None else after
    both = F.array(F.struct(start.alias("pos"), weight.alias("d")), F.struct(after.alias("pos"), (-weight).alias("d")))
    return spans.select(*by, F.explode(both).alias("s")).groupBy(*by, "s.pos").agg(F.sum("s.d").alias("d"))


def islands(segments: DataFrame, by: Sequence[str] = ("read",)) -> DataFrame:
    """Segments of a read merged where they touch or overlap: by, end5, end3. Empty ones go."""
    w = Window.partitionBy(*by).orderBy("end5", "end3")
    before = segments.where("end5 <= end3").withColumn("_reach", F.max("end3").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = before.withColumn("_island", F.sum(F.when(F.col("end5") <= F.col("_reach") + 1, 0).otherwise(1)).over(w))
    return marked.groupBy(*by, "_island").agg(F.min("end5").alias("end5"), F.max("end3").alias("end3")).drop("_island")


def discontiguous(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reads whose covered positions have a gap."""
    return islands(segments, [*by, "read"]).groupBy(*by, "read").count().where("count > 1").select(*by, "read")


def read_ends(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, read, end5, end3 over its segments."""
    return segments.where("end5 <= end3").groupBy(*by, "read").agg(F.min("end5").alias("end5"), F.max("end3").alias("end3"))


def read_lengths(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, read, length from the first to the last position."""
    return read_ends(segments, by).select(*by, "read", (F.col("end3") - F.col("end5") + 1).alias("length"))


def median_length(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, median of the reads' lengths."""
    return read_lengths(segments, by).groupBy(*by).agg(F.percentile("length", F.lit(0.5)).alias("median"))


def end_counts(segments: DataFrame, weights: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, end5, end3, n: reads by their ends, or the sums of their ``weights`` (by, read, weight)."""
    ends = read_ends(segments, by)
    if weights is None:
        return ends.groupBy(*by, "end5", "end3").agg(F.count("*").alias("n"))
    return ends.join(weights, [*by, "read"]).groupBy(*by, "end5", "end3").agg(F.sum("weight").alias("n"))


def coverage(segments: DataFrame, positions: DataFrame, by: Sequence[str] = (), weights: DataFrame | None = None) -> DataFrame:
    """by, pos, base, n: reads that cover each position, overlapping mates once (or the sum of their weights). A difference
    array: two rows an island are summed per position before one running sum over the (few) positions."""
    spans = islands(segments, [*by, "read"])
    spans = spans.withColumn("weight", F.lit(1)) if weights is None else spans.join(weights, [*by, "read"])
    return _covered(spans, F.col("weight"), positions, by)


def _covered(spans: DataFrame, weight: Column, positions: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, pos, base, n: the sum of the weights of the spans around each position."""
    joined = _steps(spans, by, weight).join(positions.select(*by, "pos", "base"), [*by, "pos"], "full")
    running = joined.withColumn("n", F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy(*by).orderBy("pos")))
    return running.where("base is not null").select(*by, "pos", "base", "n")


def codes_per_position(segments: DataFrame, muts: DataFrame, positions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, pos, base, rel, n with matches (1) and uncovered reads (255) derived."""
    return _with_derived(coverage(segments, positions, by), segments.groupBy(*by).agg(F.count_distinct("read").alias("reads")), code_counts(muts, by), by)


def code_counts(muts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, pos, base, rel, n: mutations by what they are."""
    return muts.groupBy(*by, "pos", "base", "rel").agg(F.count("*").alias("n"))


def _with_derived(covered: DataFrame, total: DataFrame, explicit: DataFrame, by: Sequence[str]) -> DataFrame:
    rest = covered.join(explicit.groupBy(*by, "pos").agg(F.sum("n").alias("m")), [*by, "pos"], "left")
    matches = rest.select(*by, "pos", "base", F.lit(1).alias("rel"), (F.col("n") - F.coalesce("m", F.lit(0))).alias("n"))
    joined = rest.join(total, list(by)) if by else rest.join(F.broadcast(total))  # one row
    missing = joined.select(*by, "pos", "base", F.lit(255).alias("rel"), (F.col("reads") - F.col("n")).alias("n"))
    return explicit.select(*by, "pos", "base", F.col("rel").cast("int").alias("rel"), "n").unionByName(matches).unionByName(missing).where("n > 0")


def _base_counts(positions: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, pos, cA ... cN: how many positions of each base there are up to this one, from one before the first to the
    last, masked ones too."""
    span = positions.groupBy(*by).agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    grid = span.select(*by, F.explode(F.sequence(F.col("_first") - 1, F.col("_last"))).alias("pos")).join(positions.select(*by, "pos", "base"), [*by, "pos"], "left")
    w = Window.partitionBy(*by).orderBy("pos")
    return grid.select(*by, "pos", *[F.sum(F.when(F.col("base") == b, 1).otherwise(0)).over(w).alias(f"c{b}") for b in codes.BASES])


def bases_per_read(segments: DataFrame, positions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, read, A ... N: covered positions of each base. Running counts per base at the ends of each island, so rows are
    per island, not per position. These counts are as many as positions, however many reads there are, and go to the reads: few
    ends that many reads have would else gather in few tasks."""
    span = F.broadcast(positions.groupBy(*by).agg(F.min("pos").alias("_first"), F.max("pos").alias("_last")))
    cum = F.broadcast(_base_counts(positions, by))
    spans = islands(segments, [*by, "read"])
    spans = spans.join(span, list(by)) if by else spans.join(span)
    cut = spans.select(*by, "read", F.greatest("end5", "_first").alias("end5"), F.least("end3", "_last").alias("end3")).where("end5 <= end3")
    high = cut.join(cum.withColumnRenamed("pos", "end3"), [*by, "end3"])
    low = F.broadcast(cum.select(*by, (F.col("pos") + 1).alias("end5"), *[F.col(f"c{b}").alias(f"l{b}") for b in codes.BASES]))
    return high.join(low, [*by, "end5"], "left").groupBy(*by, "read").agg(*[F.sum(F.col(f"c{b}") - F.coalesce(f"l{b}", F.lit(0))).alias(b) for b in codes.BASES])


def codes_per_read(segments: DataFrame, muts: DataFrame, positions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, read, base, rel, n with matches derived."""
    covered = bases_per_read(segments, positions, by).select(*by, "read", F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("cov")) for b in codes.BASES])).alias("x")).select(*by, "read", "x.*").where("cov > 0")
    explicit = muts.groupBy(*by, "read", "base", "rel").agg(F.count("*").alias("n"))
    some = explicit.groupBy(*by, "read", "base").agg(F.sum("n").alias("m"))
    matches = covered.join(some, [*by, "read", "base"], "left").select(*by, "read", "base", F.lit(1).alias("rel"), (F.col("cov") - F.coalesce("m", F.lit(0))).alias("n"))
    return explicit.select(*by, "read", "base", F.col("rel").cast("int").alias("rel"), "n").unionByName(matches).where("n > 0")


def fit_counts(counted: DataFrame, patterns: dict, key: Sequence[str]) -> DataFrame:
    """Sums of informative and fitting relationships: key, <name>_info, <name>_fit for each pattern."""
    sums = []
    for name, pat in patterns.items():
        info, fit = codes.informative(F.col("base"), F.col("rel"), pat)
        sums += [F.sum(F.when(info, F.col("n")).otherwise(0)).alias(f"{name}_info"), F.sum(F.when(fit, F.col("n")).otherwise(0)).alias(f"{name}_fit")]
    return counted.groupBy(*key).agg(*sums)


def _fitted(counted: DataFrame, every: DataFrame | None, patterns: dict | None, key: Sequence[str]) -> DataFrame:
    """By each key of ``every``, or of what is counted."""
    patterns = patterns or codes.named()
    out = fit_counts(counted, patterns, key)
    out = out if every is None else every.join(out, list(key), "left")
    columns = [F.coalesce(F.col(f"{n}_fit"), F.lit(0)).cast("long").alias(n.replace("-", "_")) for n in patterns]
    return out.select(*key, *columns).withColumn("Informative", F.col("Matched") + F.col("Mutated"))


def position_table(segments: DataFrame, muts: DataFrame, positions: DataFrame, patterns: dict | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the ten relationships by position, with Informative = Matched + Mutated."""
    key = [*by, "pos", "base"]
    return _fitted(codes_per_position(segments, muts, positions, by), positions.select(*key), patterns, key)


def position_table_of_counts(ends: DataFrame, explicit: DataFrame, positions: DataFrame, patterns: dict | None = None, by: Sequence[str] = ()) -> DataFrame:
    """position_table() of reads of one segment each, which end_counts() and code_counts() have counted; so they are not passed over again."""
    key = [*by, "pos", "base"]
    counted = _with_derived(_covered(ends, F.col("n"), positions, by), ends.groupBy(*by).agg(F.sum("n").alias("reads")), explicit, by)
    return _fitted(counted, positions.select(*key), patterns, key)


def read_table(segments: DataFrame, muts: DataFrame, positions: DataFrame, patterns: dict | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the ten relationships by read that covers a position, with Informative = Matched + Mutated."""
    key = [*by, "read"]
    kept = muts.join(positions.select(*by, "pos"), [*by, "pos"], "left_semi")
    counted = codes_per_read(segments, kept, positions, by)
    return _fitted(counted, None, patterns, key)


def ratios(table: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts as ratios: of Covered for Informative, of Informative for all others."""
    return table.select(*by, "pos", "base", *[ratio(F.col(n), F.col("Covered" if n in ("Covered", "Informative") else "Informative")).alias(n) for n in names])


def covering(segments: DataFrame, positions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, pos, read of every covered position."""
    return islands(segments, [*by, "read"]).select(*by, "read", F.explode(F.sequence("end5", "end3")).alias("pos")).join(positions.select(*by, "pos"), [*by, "pos"]).select(*by, "pos", "read")


def positive(muts: DataFrame, pat: tuple) -> DataFrame:
    """The mutations that decide the pattern and fit it."""
    info, fit = codes.informative(F.col("base"), F.col("rel"), pat)
    return muts.where(info & fit)


def mutation_distance(muts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, read, dist: least distance between two mutations of it, 0 with fewer than two."""
    w = Window.partitionBy(*by, "read").orderBy("pos")
    gaps = muts.select(*by, "read", (F.col("pos") - F.lag("pos").over(w)).alias("gap"))
    return gaps.groupBy(*by, "read").agg(F.coalesce(F.min("gap"), F.lit(0)).alias("dist"))


def distance_histogram(muts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, dist, n for every distance from 0 to the largest."""
    found = mutation_distance(muts, by).groupBy(*by, "dist").agg(F.count("*").alias("n"))
    every = found.groupBy(*by).agg(F.max("dist").alias("m")).select(*by, F.explode(F.sequence(F.lit(0), F.col("m"))).alias("dist"))
    return every.join(found, [*by, "dist"], "left").select(*by, "dist", F.coalesce("n", F.lit(0)).alias("n"))


def without_close(muts: DataFrame, min_gap: int, by: Sequence[str] = ()) -> DataFrame:
    """Reads that have two mutations within ``min_gap``."""
    return mutation_distance(muts, by).where((F.col("dist") > 0) & (F.col("dist") <= min_gap)).select(*by, "read")


def merge_close(muts: DataFrame, min_gap: int, by: Sequence[str] = ()) -> DataFrame:
    """by, read, pos of the mutations kept when, from the 3' end, each one takes in those within ``min_gap``
    of it. A fold over each read's sorted positions, as what was taken in takes in nothing."""
    if min_gap < 1:
        return muts.select(*by, "read", "pos")
    gathered = muts.groupBy(*by, "read").agg(F.reverse(F.array_sort(F.collect_set("pos"))).alias("p"))
    kept = F.aggregate("p", F.array().cast("array<int>"), lambda acc, x: F.when((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1)) - x > min_gap), F.concat(acc, F.array(x.cast("int")))).otherwise(acc))
    return gathered.select(*by, "read", F.explode(kept).alias("pos"))


def collide(segments: DataFrame, muts: DataFrame, pat: tuple, min_gap: int, merge: bool, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Segments and mutations without two mutations of a read within ``min_gap``: either such reads are dropped, or of
    each cluster only the 3'-most mutation stays. Codes that do not decide or fit the pattern stay as they are."""
    key = [*by, "read"]
    hits = positive(muts, pat)
    if min_gap < 1:
        return segments, muts
    if not merge:
        close = without_close(hits, min_gap, by)
        return segments.join(close, key, "left_anti"), muts.join(close, key, "left_anti")
    gone = hits.select(*key, "pos").join(merge_close(hits, min_gap, by), [*key, "pos"], "left_anti")
    return segments, muts.join(gone, [*key, "pos"], "left_anti")


def unique_reads(segments: DataFrame, muts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, segs, muts (sorted arrays), n: reads of the same ends and mutated positions counted once."""
    return with_content(segments, muts, by).groupBy(*by, "segs", "muts").agg(F.count("*").alias("n"))


def with_content(segments: DataFrame, muts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, read, segs, muts: what makes reads equal, by read."""
    key = [*by, "read"]
    ends = segments.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("end5", "end3"))).alias("segs"))
    found = muts.groupBy(*key).agg(F.array_sort(F.collect_set("pos")).alias("muts"))
    return ends.join(found, key, "left").select(*key, "segs", F.coalesce("muts", F.array().cast("array<int>")).alias("muts"))


def merge_mates(a: DataFrame, b: DataFrame, segments_a: DataFrame, segments_b: DataFrame) -> DataFrame:
    """Relations of two mates of one segment each as one read: read, pos, rel. Codes meet by bitwise AND; where a mate says
    nothing it is a match (1) if it covers the position, else not covered (255). Plain matches go."""
    at = a.select("read", "pos", F.col("rel").alias("rel_a")).join(b.select("read", "pos", F.col("rel").alias("rel_b")), ["read", "pos"], "full")
    ends = segments_a.select("read", F.col("end5").alias("a5"), F.col("end3").alias("a3")).join(segments_b.select("read", F.col("end5").alias("b5"), F.col("end3").alias("b3")), "read", "full")
    joined = at.join(ends, "read")
    said = lambda rel, lo, hi: F.coalesce(rel, F.when(F.col("pos").between(F.col(lo), F.col(hi)), 1).otherwise(255))
    return joined.select("read", "pos", said(F.col("rel_a"), "a5", "a3").bitwiseAND(said(F.col("rel_b"), "b5", "b3")).alias("rel")).where("rel <> 1")


def trim_overhangs(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Ends of both mates cut so that neither passes the other's start: read, f5, f3, r5, r3."""
    both = forward.select("read", F.col("end5").alias("f5"), F.col("end3").alias("f3")).join(reverse.select("read", F.col("end5").alias("r5"), F.col("end3").alias("r3")), "read")
    return both.select("read", "f5", F.least("f3", "r3").alias("f3"), F.greatest("r5", "f5").alias("r5"), "r3")


# Filters.


def mask_poly(positions: DataFrame, base: str = "A", least: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Positions in runs of ``least`` or more of a base."""
    w = Window.partitionBy(*by).orderBy("pos")
    runs = positions.where(F.col("base") == base).withColumn("_run", F.col("pos") - F.row_number().over(w))
    return runs.withColumn("_n", F.count("*").over(Window.partitionBy(*by, "_run"))).where(F.col("_n") >= least).select(*by, "pos", "base")


def mask_bases(positions: DataFrame, bases: Sequence[str]) -> DataFrame:
    """Positions of these bases; N always."""
    return positions.where(F.col("base").isin("N", *bases))


def unmask(positions: DataFrame, *masks: DataFrame, by: Sequence[str] = (), complement: bool = False) -> DataFrame:
    """The positions in none of the masks; with ``complement``, those in all of them."""
    for mask in masks:
        positions = positions.join(mask.select(*by, "pos").distinct(), [*by, "pos"], "left_semi" if complement else "left_anti")
    return positions


def drop_listed(segments: DataFrame, muts: DataFrame, listed: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Segments and mutations without the reads of a list."""
    key = [*by, "read"]
    gone = listed.select(*key).distinct()
    return segments.join(gone, key, "left_anti"), muts.join(gone, key, "left_anti")


def clip(segments: DataFrame, muts: DataFrame, end5: int, end3: int, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Segments and mutations within a region; what lies outside goes."""
    cut = segments.select(*by, "read", "seg", F.greatest("end5", F.lit(end5)).alias("end5"), F.least("end3", F.lit(end3)).alias("end3")).where("end5 <= end3")
    return cut, muts.where(F.col("pos").between(end5, end3))


def read_counts(segments: DataFrame, muts: DataFrame, positions: DataFrame, pat: tuple, by: Sequence[str] = ()) -> DataFrame:
    """by, read, cov, info, fit over unmasked positions. Mutations that do not decide the pattern are few; all other covered
    positions are informative, if the pattern tells a match."""
    cov = bases_per_read(segments, positions, by)
    info, fit = codes.informative(F.col("base"), F.col("rel"), pat)
    kept = muts.join(positions.select(*by, "pos"), [*by, "pos"], "left_semi")
    told = kept.groupBy(*by, "read").agg(F.count_if(info).alias("_info"), F.count_if(fit).alias("_fit"), *[F.count_if(F.col("base") == b).alias(f"_{b}") for b in codes.BASES])
    joined = cov.join(told, [*by, "read"], "left").na.fill(0)
    total = sum((F.col(b) for b in codes.BASES), F.lit(0))
    plain, plain_fit = F.lit(0), F.lit(0)
    for b in codes.BASES:  # matches of each base
        i, f = codes.informative(F.lit(b), F.lit(codes.MATCH), pat)
        n = F.col(b) - F.col(f"_{b}")
        plain, plain_fit = plain + F.when(i, n).otherwise(0), plain_fit + F.when(f, n).otherwise(0)
    return joined.select(*by, "read", total.cast("long").alias("cov"), (F.col("_info") + plain).cast("long").alias("info"), (F.col("_fit") + plain_fit).cast("long").alias("fit")).where("cov > 0")


def reads_passing(counts: DataFrame, min_cov: int = 1, min_cov_share: float = 0.0, n_pos: int = 1, min_info: float = 0.0, max_mut: float = 1.0) -> DataFrame:
    """Reads that pass; a ratio of 0 / 0 fails a limit that is set."""
    rule = (F.col("cov") >= min_cov) & (F.col("cov") / n_pos >= min_cov_share)
    if min_info > 0:
        rule &= F.coalesce(ratio(F.col("info"), F.col("cov")) >= min_info, F.lit(False))
    if max_mut < 1:
        rule &= F.coalesce(ratio(F.col("fit"), F.col("info")) <= max_mut, F.lit(False))
    return counts.where(rule)


def positions_passing(table: DataFrame, min_info: int, max_mut: float, by: Sequence[str] = ()) -> DataFrame:
    """Positions with enough informative reads and not too many mutated; 0 / 0 passes the latter."""
    return table.where((F.col("Informative") >= min_info) & ~F.coalesce(ratio(F.col("Mutated"), F.col("Informative")) > max_mut, F.lit(False))).select(*by, "pos", "base")


def filter_pass(segments: DataFrame, muts: DataFrame, positions: DataFrame, pat: tuple, min_cov: int, min_info_share: float, max_mut_share: float, min_gap: int, min_info_pos: int, max_mut_pos: float, merge: bool = False, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of the read filters and then the position filters: reads, their mutations and the positions that are
    left. Mutations within the gap drop their read, or are merged (last, as that changes them)."""
    key = [*by, "read"]
    some = muts.join(positions.select(*by, "pos"), [*by, "pos"], "left_semi")
    kept = reads_passing(read_counts(segments, some, positions, pat, by), min_cov, 0.0, 1, min_info_share, max_mut_share).select(*key)
    if min_gap > 0 and not merge:
        kept = kept.join(without_close(positive(some, pat), min_gap, by), key, "left_anti")
    segs, some = segments.join(kept, key, "left_semi"), some.join(kept, key, "left_semi")
    if merge:
        _, some = collide(segs, some, pat, min_gap, True, by)
    table = position_table(segs, some, positions, {"Matched": codes.invert(pat), "Mutated": pat}, by)
    return kept, some, positions_passing(table, min_info_pos, max_mut_pos, by)


# Pairs of positions.


def position_pairs(positions: DataFrame, min_gap: int, max_gap: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, pos_a, pos_b: positions further apart than ``min_gap`` and no further than ``max_gap``. Each position is dealt to
    those it may pair with, so no table meets itself whole."""
    p = positions.select(*by, "pos")
    last = p.groupBy(*by).agg(F.max("pos").alias("_last"))
    held = p.join(last, list(by)) if by else p.join(F.broadcast(last))  # one row
    end = F.col("_last") if max_gap is None else F.least("_last", F.col("pos") + max_gap)
    dealt = held.withColumn("_end", end).where(F.col("pos") + min_gap + 1 <= F.col("_end")).select(*by, F.col("pos").alias("pos_a"), F.explode(F.sequence(F.col("pos") + min_gap + 1, F.col("_end"))).alias("pos_b"))
    return dealt.join(p.withColumnRenamed("pos", "pos_b"), [*by, "pos_b"], "left_semi").select(*by, "pos_a", "pos_b")


def confusion(segments: DataFrame, muts: DataFrame, positions: DataFrame, pat: tuple, min_gap: int, max_gap: int | None = None, weights: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, pos_a, pos_b, n, a, b, ab: reads that cover both positions of a pair, and are mutated at either and at both; or
    the sums of their weights (by, read, weight).

    Reads are passed over once: each one's ends meet its mutated positions, and what it adds is counted by its ends (n), by a
    mutated position and one end (a, b) and by two mutated positions (ab). For a distance g, a read covers the pairs that
    begin from its first position to g before its last one, which is a running sum over positions. Positions that are not listed go
    at the end, when the few counts meet the pairs. Each read counts as covering from its first to its last position.
    """
    ends = read_ends(segments, by)
    ends = ends.withColumn("weight", F.lit(1)) if weights is None else ends.join(weights, [*by, "read"])
    found = positive(muts, pat).groupBy(*by, "read").agg(F.collect_set(F.col("pos").cast("int")).alias("ps"))
    hits = F.coalesce("ps", F.array().cast("array<int>")).alias("ps")
    held = ends.join(found, [*by, "read"], "left").select(*by, F.col("end5").cast("int").alias("end5"), F.col("end3").cast("int").alias("end3"), hits, "weight")
    kinds = {"n": 0, "a": 1, "b": 2, "ab": 3}
    within = lambda g: (g > min_gap) & ((g <= max_gap) if max_gap is not None else F.lit(True))
    cell = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    of_ends = F.array(cell(kinds["n"], F.col("end5"), F.col("end3")))
    of_hits = F.flatten(F.transform("ps", lambda p: F.array(cell(kinds["a"], p, F.col("end3")), cell(kinds["b"], F.col("end5"), p))))
    of_both = F.flatten(F.transform("ps", lambda p: F.transform(F.filter("ps", lambda q: within(q - p)), lambda q: cell(kinds["ab"], p, q))))
    counted = held.select(*by, "weight", F.explode(F.flatten(F.array(of_ends, of_hits, of_both))).alias("t")).groupBy(*by, "t.kind", "t.x", "t.y").agg(F.sum("weight").alias("c"))

    room = F.col("y") - F.col("x")
    last = room if max_gap is None else F.least(room, F.lit(max_gap))
    gaps = F.when(F.col("kind") == kinds["ab"], F.array(room)).when(last > min_gap, F.sequence(F.lit(min_gap + 1), last))
    step = lambda pos, d: F.struct(pos.alias("pos"), d.alias("d"))
    x, y, g, c = (F.col(i) for i in ("x", "y", "g", "c"))
    steps = F.when(F.col("kind") == kinds["n"], F.array(step(x, c), step(y - g + 1, -c))).otherwise(F.array(step(F.when(F.col("kind") == kinds["b"], y - g).otherwise(x), c)))
    dealt = counted.select(*by, "kind", "x", "y", "c", F.explode(gaps).alias("g")).select(*by, "g", "kind", F.explode(steps).alias("s"))
    place = [*by, "g", "pos"]
    sums = dealt.groupBy(*by, "g", "s.pos").agg(*[F.sum(F.when(F.col("kind") == i, F.col("s.d"))).alias(name) for name, i in kinds.items()])
    pairs = position_pairs(positions, min_gap, max_gap, by).select(*by, (F.col("pos_b") - F.col("pos_a")).alias("g"), F.col("pos_a").alias("pos"), F.lit(True).alias("_asked"))
    over = Window.partitionBy(*by, "g").orderBy("pos")
    asked = sums.join(pairs, place, "full").withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(over)).where("_asked")
    kind = "long" if weights is None else "double"
    return asked.select(*by, F.col("pos").alias("pos_a"), (F.col("pos") + F.col("g")).alias("pos_b"), *[F.coalesce(i, F.lit(0)).cast(kind).alias(i) for i in kinds])


def validate_confusion(pairs: DataFrame) -> DataFrame:
    """The pairs, none of whose counts can be impossible: it raises when it runs if one is."""
    bad = (F.col("ab") < 0) | (F.col("a") < F.col("ab")) | (F.col("b") < F.col("ab")) | (F.col("n") < F.col("a") + F.col("b") - F.col("ab"))
    return pairs.withColumn("n", F.when(bad, F.raise_error(F.concat(F.lit("impossible counts of positions "), F.col("pos_a").cast("string"), F.lit(" and "), F.col("pos_b").cast("string")))).otherwise(F.col("n")))


def benjamini_hochberg(pairs: DataFrame, p: str = "p", by: Sequence[str] = (), buckets: int = 256) -> DataFrame:
    """Adds q, the adjusted p-value, over all rows (of each ``by``). Equal p-values are counted together; these counts are
    dealt to buckets by quantiles, so running sums and minima are within buckets, and what goes between buckets is one
    row for each."""
    held = pairs.groupBy(*by, F.col(p).alias("_p")).agg(F.count("*").alias("_n")).where("_p is not null")
    edges = held.agg(F.percentile_approx("_p", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    edges = sorted(set(edges))
    counted = held.withColumn("_bucket", F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e < F.col("_p"))))
    within = Window.partitionBy(*by, "_bucket").orderBy("_p")
    counted = counted.withColumn("_rank", F.sum("_n").over(within))
    sizes = counted.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_size"))
    over = Window.partitionBy(*by).orderBy("_bucket")
    sizes = sizes.select(*by, "_bucket", (F.sum("_size").over(over) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy(*by)).alias("_m"))
    valued = counted.join(F.broadcast(sizes) if not by else sizes, [*by, "_bucket"]).withColumn("_q", F.col("_p") * F.col("_m") / (F.col("_rank") + F.col("_before")))
    least = valued.groupBy(*by, "_bucket").agg(F.min("_q").alias("_least"))
    least = least.select(*by, "_bucket", F.min("_least").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    up = within.rowsBetween(0, Window.unboundedFollowing)
    q = valued.withColumn("_own", F.min("_q").over(up)).join(F.broadcast(least) if not by else least, [*by, "_bucket"]).select(*by, "_p", F.least("_own", F.coalesce("_later", F.lit(float("inf")))).alias("q"))
    return pairs.join(q.withColumnRenamed("_p", p), [*by, p], "left").select(*pairs.columns, "q")
