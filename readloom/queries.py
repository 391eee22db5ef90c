"""Registered queries: each operator over the given tables, with DuckDB SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import read_model as rm
from .functions import codes, sequences as sq, stats
from .operators import alignments, clusters, demult, profiles as pf, reads, regions, structures as st
from .plans import bias, clustering, domains, filtering
from .sources import tables, text
from .streaming import counts as stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
R, T2, P, B, S = rm.SQL_RAW, rm.SQL_TWO, rm.SQL_PROFILES, rm.SQL_PAIRS, rm.SQL_SEQS
MUT = codes.pattern()
IS_MUT = "((rel | yes) = yes and (rel | 1) <> 1)"
FIT = "fit as (select *, case base when 'A' then 238 when 'C' then 222 when 'G' then 190 else 126 end as yes from muts)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def model(spark, sf):
    return rm.segments(spark, sf), rm.muts(spark, sf), rm.positions(spark)


# Counting.

COVER = "cover as (select p.pos, p.base, count(s.read) as n from positions p left join segs s on p.pos between s.end5 and s.end3 group by 1, 2)"
PER_POS = f"""{R}, {COVER}, explicit as (select pos, base, rel, count(*) as n from muts group by 1, 2, 3),
 per_pos as (select pos, base, rel, n from explicit union all
 select c.pos, c.base, 1, c.n - coalesce(e.m, 0) from cover c left join (select pos, sum(n) as m from explicit group by 1) e using (pos) union all
 select pos, base, 255, (select count(*) from segs) - n from cover)"""


@query("position_table", f"""with {PER_POS}, y as (select *, case base when 'A' then 238 when 'C' then 222 when 'G' then 190 else 126 end as yes,
 case base when 'A' then 16 when 'C' then 32 when 'G' then 64 else 128 end as own from per_pos where n > 0)
 select pos, base, cast(sum(n) filter ((rel | yes | 1) = (yes | 1)) as bigint) as Covered, cast(coalesce(sum(n) filter (rel = 1), 0) as bigint) as Matched,
 cast(coalesce(sum(n) filter ((rel | yes) = yes and rel <> 1), 0) as bigint) as Mutated, cast(coalesce(sum(n) filter ((rel | (240 - own)) = 240 - own), 0) as bigint) as Subbed,
 cast(coalesce(sum(n) filter (rel = 16 and base <> 'A'), 0) as bigint) as Subbed_A, cast(coalesce(sum(n) filter (rel = 32 and base <> 'C'), 0) as bigint) as Subbed_C,
 cast(coalesce(sum(n) filter (rel = 64 and base <> 'G'), 0) as bigint) as Subbed_G, cast(coalesce(sum(n) filter (rel = 128 and base <> 'T'), 0) as bigint) as Subbed_T,
 cast(coalesce(sum(n) filter (rel = 2), 0) as bigint) as Deleted, cast(coalesce(sum(n) filter ((rel | 12) = 12), 0) as bigint) as Inserted,
 cast(coalesce(sum(n) filter (rel = 1), 0) + coalesce(sum(n) filter ((rel | yes) = yes and rel <> 1), 0) as bigint) as Informative from y group by 1, 2""")
def position_table(spark, sf):
    return reads.position_table(*model(spark, sf))


@query("position_ratios", f"""with {PER_POS}, y as (select *, case base when 'A' then 238 when 'C' then 222 when 'G' then 190 else 126 end as yes from per_pos where n > 0),
 t as (select pos, base, sum(n) filter ((rel | yes | 1) = (yes | 1)) as cov, coalesce(sum(n) filter (rel = 1), 0) as mat, coalesce(sum(n) filter ((rel | yes) = yes and rel <> 1), 0) as mut from y group by 1, 2)
 select pos, base, round(1.0 * (mat + mut) / cov, 9) as Informative, round(1.0 * mut / (mat + mut), 9) as Mutated, round(1.0 * mat / (mat + mut), 9) as Matched from t""")
def position_ratios(spark, sf):
    out = reads.ratios(position_table(spark, sf), ["Informative", "Mutated", "Matched"])
    return out.select("pos", "base", *[F.round(c, 9).alias(c) for c in ("Informative", "Mutated", "Matched")])


@query("coverage", f"with {R}, {COVER} select pos, base, n from cover")
def coverage(spark, sf):
    return reads.coverage(rm.segments(spark, sf), rm.positions(spark))


@query("coverage_two_segments", f"with {R}, {T2} select p.pos, p.base, count(distinct t.read) as n from positions p left join two t on p.pos between t.end5 and t.end3 group by 1, 2")
def coverage_two(spark, sf):
    return reads.coverage(rm.two_segments(spark, sf), rm.positions(spark))


@query("rels_per_pos", f"with {PER_POS} select pos, base, rel, cast(n as bigint) as n from per_pos where n > 0")
def rels_per_pos(spark, sf):
    return reads.codes_per_position(*model(spark, sf))


PER_READ = f"""{R}, cov as (select s.read, p.base, count(*) as n from segs s join positions p on p.pos between s.end5 and s.end3 group by 1, 2),
 explicit as (select read, base, rel, count(*) as n from muts group by 1, 2, 3),
 per_read as (select * from explicit union all select c.read, c.base, 1, c.n - coalesce(e.m, 0) from cov c left join (select read, base, sum(n) as m from explicit group by 1, 2) e using (read, base))"""


@query("rels_per_read", f"with {PER_READ} select read, base, rel, cast(n as bigint) as n from per_read where n > 0")
def rels_per_read(spark, sf):
    return reads.codes_per_read(*model(spark, sf))


@query("count_per_read", f"""with {PER_READ}, y as (select *, case base when 'A' then 238 when 'C' then 222 when 'G' then 190 else 126 end as yes from per_read where n > 0)
 select read, cast(coalesce(sum(n) filter (rel = 1 or (rel | yes) = yes), 0) as bigint) as mut_info, cast(coalesce(sum(n) filter ((rel | yes) = yes), 0) as bigint) as mut_fit from y group by 1""")
def count_per_read(spark, sf):
    return reads.fit_counts(reads.codes_per_read(*model(spark, sf)), {"mut": MUT}, ["read"])


@query("count_per_pos", f"""with {PER_POS}, y as (select *, case base when 'A' then 238 when 'C' then 222 when 'G' then 190 else 126 end as yes from per_pos where n > 0)
 select pos, base, cast(coalesce(sum(n) filter (rel = 1 or (rel | yes) = yes), 0) as bigint) as mut_info, cast(coalesce(sum(n) filter ((rel | yes) = yes), 0) as bigint) as mut_fit from y group by 1, 2""")
def count_per_pos(spark, sf):
    return reads.fit_counts(reads.codes_per_position(*model(spark, sf)), {"mut": MUT}, ["pos", "base"])


@query("end_counts", f"with {R} select end5, end3, count(*) as n from segs group by 1, 2")
def end_counts(spark, sf):
    return reads.end_counts(rm.segments(spark, sf))


@query("covering_reads", f"with {R} select p.pos, count(*) as n from positions p join segs s on p.pos between s.end5 and s.end3 group by 1")
def covering_reads(spark, sf):
    return reads.covering(rm.segments(spark, sf), rm.positions(spark)).groupBy("pos").agg(F.count("*").alias("n"))


@query("positive_reads", f"with {R}, {FIT} select read, pos from fit where {IS_MUT}")
def positive_reads(spark, sf):
    return reads.positive(rm.muts(spark, sf), MUT).select("read", "pos")


@query("read_ends", f"with {T2} select read, min(end5) as end5, max(end3) as end3 from two group by 1")
def read_ends(spark, sf):
    return reads.read_ends(rm.two_segments(spark, sf))


@query("merged_segments", f"""with {T2}, w as (select *, max(end3) over (partition by read order by end5, end3 rows between unbounded preceding and 1 preceding) as reach from two),
 m as (select *, sum(case when end5 <= reach + 1 then 0 else 1 end) over (partition by read order by end5, end3) as island from w) select read, min(end5) as end5, max(end3) as end3 from m group by read, island""")
def merged_segments(spark, sf):
    return reads.islands(rm.two_segments(spark, sf))


@query("discontiguous_reads", f"""with {T2}, w as (select *, max(end3) over (partition by read order by end5, end3 rows between unbounded preceding and 1 preceding) as reach from two)
 select distinct read from w where end5 > reach + 1""")
def discontiguous(spark, sf):
    return reads.discontiguous(rm.two_segments(spark, sf))


DIST = "gaps as (select read, pos - lag(pos) over (partition by read order by pos) as gap from muts), dist as (select read, cast(coalesce(min(gap), 0) as int) as dist from gaps group by 1)"


@query("min_mut_dist", f"with {R}, {DIST} select read, dist from dist")
def min_mut_dist(spark, sf):
    return reads.mutation_distance(rm.muts(spark, sf))


@query("mutdist_hist", f"with {R}, {DIST} select cast(i as int) as dist, count(d.read) as n from range(0, (select max(dist) + 1 from dist)) t(i) left join dist d on d.dist = i group by 1")
def mutdist_hist(spark, sf):
    return reads.distance_histogram(rm.muts(spark, sf))


@query("reads_noclose", f"with {R}, {DIST} select read from dist where dist = 0 or dist > 4")
def reads_noclose(spark, sf):
    m = rm.muts(spark, sf)
    return m.select("read").distinct().join(reads.without_close(m, 4), "read", "left_anti")


@query("merge_close_muts", f"""with recursive {R}, r as (select read, pos, row_number() over (partition by read order by pos desc) as i from muts),
 walk as (select read, i, pos, pos as anchor, true as kept from r where i = 1 union all
 select r.read, r.i, r.pos, case when w.anchor - r.pos > 4 then r.pos else w.anchor end, w.anchor - r.pos > 4 from walk w join r on r.read = w.read and r.i = w.i + 1)
 select read, pos from walk where kept""")
def merge_close_muts(spark, sf):
    return reads.merge_close(rm.muts(spark, sf), 4)


@query("uniq_reads", f"""with {R}, k as (select s.read, s.end5, s.end3, coalesce(list(distinct m.pos order by m.pos) filter (m.pos is not null), []) as muts from segs s left join muts m using (read) group by 1, 2, 3)
 select end5, end3, array_to_string(muts, ',') as muts, count(*) as n from k group by 1, 2, 3""")
def uniq_reads(spark, sf):
    return reads.unique_reads(rm.segments(spark, sf), rm.muts(spark, sf)).select(F.col("segs")[0]["end5"].alias("end5"), F.col("segs")[0]["end3"].alias("end3"), F.array_join(F.col("muts").cast("array<string>"), ",").alias("muts"), "n")


@query("hist_per_read", f"""with {PER_READ}, y as (select *, case base when 'A' then 238 when 'C' then 222 when 'G' then 190 else 126 end as yes from per_read where n > 0),
 f as (select read, coalesce(sum(n) filter ((rel | yes) = yes), 0) as m from y group by 1)
 select cast(b as int) as bin, count(f.read) as n from range(0, 8) t(b) left join f on least(cast(floor(m / 1.0) as int), 7) = b and m between 0 and 8 group by 1""")
def hist_per_read(spark, sf):
    return pf.histogram(count_per_read(spark, sf), "mut_fit", 8, 0.0, 8.0)


# Mates.

MATES = f"""{R}, ends as (select l_orderkey as read, l_linenumber % 2 as mate, min(cast(l_partkey % 120 + 1 as int)) as end5, max(cast(l_partkey % 120 + 1 as int)) as end3 from lineitem group by 1, 2),
 mm as (select l_orderkey as read, l_linenumber % 2 as mate, cast(l_partkey % 120 + 1 as int) as pos, cast(bit_or(case when l_returnflag = 'R' then 32 when l_returnflag = 'N' then 65 else 3 end) as int) as rel from lineitem group by 1, 2, 3)"""


def _mates(spark, sf):
    li = rm.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read"), (F.col("l_linenumber") % 2).alias("mate"), (F.col("l_partkey") % 120 + 1).cast("int").alias("pos"), F.when(F.col("l_returnflag") == "R", 32).when(F.col("l_returnflag") == "N", 65).otherwise(3).alias("c"))
    rel = li.groupBy("read", "mate", "pos").agg(F.bit_or("c").cast("int").alias("rel"))
    ends = li.groupBy("read", "mate").agg(F.min("pos").alias("end5"), F.max("pos").alias("end3"))
    return [rel.where(F.col("mate") == k).drop("mate") for k in (1, 0)] + [ends.where(F.col("mate") == k).drop("mate") for k in (1, 0)]


@query("merge_mates", f"""with {MATES}, e as (select coalesce(a.read, b.read) as read, a.end5 as a5, a.end3 as a3, b.end5 as b5, b.end3 as b3 from (select * from ends where mate = 1) a full join (select * from ends where mate = 0) b using (read)),
 m as (select coalesce(a.read, b.read) as read, coalesce(a.pos, b.pos) as pos, a.rel as ra, b.rel as rb from (select * from mm where mate = 1) a full join (select * from mm where mate = 0) b on a.read = b.read and a.pos = b.pos),
 j as (select read, pos, coalesce(ra, case when pos between a5 and a3 then 1 else 255 end) & coalesce(rb, case when pos between b5 and b3 then 1 else 255 end) as rel from m join e using (read)) select read, pos, rel from j where rel <> 1""")
def merge_mates(spark, sf):
    return reads.merge_mates(*_mates(spark, sf))


@query("trim_overhangs", f"with {MATES} select a.read, a.end5 as f5, least(a.end3, b.end3) as f3, greatest(b.end5, a.end5) as r5, b.end3 as r3 from (select * from ends where mate = 1) a join (select * from ends where mate = 0) b using (read)")
def trim_overhangs(spark, sf):
    _, _, a, b = _mates(spark, sf)
    return reads.trim_overhangs(a, b)


# Filters.


@query("mask_bases", f"with {R} select pos, base from positions where base in ('G', 'T', 'N')")
def mask_bases(spark, sf):
    seen = rm.muts(spark, sf).select("pos").distinct()
    return reads.mask_bases(rm.positions(spark), ("G", "T")).join(seen, "pos", "left_semi")


RUNS = f"with {S}, chars as (select ref, i as pos, substr(seq, i, 1) as base from (select ref, seq, unnest(range(1, length(seq) + 1)) as i from seqs)), r as (select *, pos - row_number() over (partition by ref, base order by pos) as run from chars where base = 'A')"


@query("mask_polya", RUNS + ", g as (select ref, run, min(pos) as end5, max(pos) as end3, count(*) as n from r group by 1, 2) select r.ref, r.pos from r join g using (ref, run) where n >= 3")
def mask_polya(spark, sf):
    return sq.runs(rm.sequences(spark, sf), "A", 3).select("ref", "pos")


@query("reads_by_coverage", f"with {R} select read, cast(end3 - end5 + 1 as bigint) as cov from segs where end3 - end5 + 1 >= 40 and (end3 - end5 + 1) / 120.0 >= 0.5")
def reads_by_coverage(spark, sf):
    counts = reads.read_counts(*model(spark, sf), MUT)
    return reads.reads_passing(counts, min_cov=40, min_cov_share=0.5, n_pos=rm.LENGTH).select("read", "cov")


@query("reads_by_ratio", f"""with {PER_READ}, y as (select *, case base when 'A' then 238 when 'C' then 222 when 'G' then 190 else 126 end as yes from per_read where n > 0),
 f as (select read, cast(sum(n) as bigint) as cov, cast(coalesce(sum(n) filter (rel = 1 or (rel | yes) = yes), 0) as bigint) as info, cast(coalesce(sum(n) filter ((rel | yes) = yes), 0) as bigint) as fit from y group by 1)
 select * from f where 1.0 * info / cov >= 0.97 and info > 0 and 1.0 * fit / info <= 0.05""")
def reads_by_ratio(spark, sf):
    return reads.reads_passing(reads.read_counts(*model(spark, sf), MUT), min_info=0.97, max_mut=0.05).select("read", "cov", "info", "fit")


def _round(i: int) -> str:
    """One round of the filter in SQL, over positions p{i}."""
    return f"""
 c{i} as (select s.read, p.base, count(*) as n from segs s join p{i} p on p.pos between s.end5 and s.end3 group by 1, 2),
 f{i} as (select f.*, {IS_MUT} as hit, not {IS_MUT} as ambiguous from fit f semi join p{i} p on p.pos = f.pos),
 m{i} as (select read, count(*) filter (hit) as fit, count(*) filter (ambiguous) as amb from f{i} group by 1),
 r{i} as (select c.read, c.cov, c.cov - coalesce(m.amb, 0) as info, coalesce(m.fit, 0) as fit from (select read, sum(n) as cov from c{i} group by 1) c left join m{i} m using (read)),
 g{i} as (select read, min(pos - prev) as gap from (select read, pos, lag(pos) over (partition by read order by pos) as prev from f{i} where hit) group by 1),
 k{i} as (select r.read from r{i} r left join g{i} g using (read) where r.cov >= 10 and r.info > 0 and 1.0 * r.fit / r.info <= 0.2 and (g.gap is null or g.gap > 3)),
 t{i} as (select p.pos, p.base, count(*) as cov from p{i} p join segs s on p.pos between s.end5 and s.end3 semi join k{i} k on k.read = s.read group by 1, 2),
 u{i} as (select pos, count(*) filter (hit) as mut, count(*) filter (ambiguous) as amb from f{i} f semi join k{i} k on k.read = f.read group by 1),
 p{i + 1} as (select t.pos, t.base from t{i} t left join u{i} u using (pos) where t.cov - coalesce(u.amb, 0) >= 5 and not coalesce(1.0 * u.mut / nullif(t.cov - coalesce(u.amb, 0), 0) > 0.065, false))"""


CONFIG = filtering.FilterConfig(mask_poly=0, min_cov=10, max_mut_share=0.2, min_gap=3, min_info_pos=5, max_mut_pos=0.065)
#: Rounds of the SQL: once nothing changes, further ones do no harm.
ROUNDS = 5


@query("filter_rounds", f"with {R}, {FIT}, p0 as (select * from positions where base in ('A', 'C')),{','.join(map(_round, range(ROUNDS)))} select p.pos, p.base, (select count(*) from k{ROUNDS - 1}) as reads from p{ROUNDS} p")
def filter_rounds(spark, sf):
    done = filtering.filter_reads(*model(spark, sf), CONFIG)
    return done.positions.join(F.broadcast(done.segments.agg(F.count("*").alias("reads"))))


@query("list_positions", f"""with {PER_POS}, y as (select *, case base when 'A' then 238 when 'C' then 222 when 'G' then 190 else 126 end as yes from per_pos where n > 0),
 t as (select pos, base, coalesce(sum(n) filter (rel = 1), 0) as mat, coalesce(sum(n) filter ((rel | yes) = yes and rel <> 1), 0) as mut from y group by 1, 2)
 select pos, base from t where mat + mut < 1000 or 1.0 * mut / (mat + mut) > 0.06""")
def list_positions(spark, sf):
    table = position_table(spark, sf)
    return table.select("pos", "base").join(reads.positions_passing(table, 1000, 0.06), ["pos", "base"], "left_anti")


@query("clip_region", f"with {R} select s.read, greatest(end5, 21) as end5, least(end3, 60) as end3, m.pos, m.rel from segs s left join (select * from muts where pos between 21 and 60) m using (read) where greatest(end5, 21) <= least(end3, 60)")
def clip_region(spark, sf):
    segs, muts = reads.clip(rm.segments(spark, sf), rm.muts(spark, sf), 21, 60)
    return segs.join(muts, "read", "left").select("read", "end5", "end3", "pos", "rel")


# Pairs of positions.

HITS = f"{FIT}, hits as (select read, pos from fit where {IS_MUT})"
CONFUSION = f"""{R}, {HITS}, pp as (select a.pos as pos_a, b.pos as pos_b from positions a join positions b on b.pos - a.pos > 4 and b.pos - a.pos <= 20),
 conf as (select p.pos_a, p.pos_b, count(*) as n, count(x.pos) as a, count(y.pos) as b, count(case when x.pos is not null and y.pos is not null then 1 end) as ab
 from pp p join segs s on s.end5 <= p.pos_a and s.end3 >= p.pos_b left join hits x on x.read = s.read and x.pos = p.pos_a left join hits y on y.read = s.read and y.pos = p.pos_b group by 1, 2)"""


def _confusion(spark, sf):
    return reads.confusion(*model(spark, sf), MUT, 4, 20)


@query("confusion", f"with {CONFUSION} select * from conf")
def confusion(spark, sf):
    return _confusion(spark, sf)


PHI = "(1.0 * ab / n - (1.0 * a / n) * (1.0 * b / n))"


@query("pair_correlations", f"""with {CONFUSION}, v as (select *, a > 0 and b > 0 and a < n and b < n as ok, (1.0 * a / n) * (1.0 * b / n) * (1 - 1.0 * a / n) * (1 - 1.0 * b / n) as d from conf where n > 0)
 select pos_a, pos_b, round(case when ok then {PHI} / sqrt(d) end, 9) as phi, round(case when ok then n * {PHI} * {PHI} / d end, 7) as chi2 from v""")
def pair_correlations(spark, sf):
    c = [F.col(x) for x in ("n", "a", "b", "ab")]
    return _confusion(spark, sf).where("n > 0").select("pos_a", "pos_b", F.round(stats.phi(*c), 9).alias("phi"), F.round(stats.chi_square(*c), 7).alias("chi2"))


@query("benjamini_hochberg", """with p as (select o_orderkey as pos_a, 0 as pos_b, (o_totalprice % 1000) / 1000.0 as p from orders), r as (select *, row_number() over (order by p, pos_a, pos_b) as rank, count(*) over () as m from p)
 select pos_a, round(min(p * m / rank) over (order by rank desc rows between unbounded preceding and current row), 9) as q from r""")
def benjamini(spark, sf):
    p = rm.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos_a"), ((F.col("o_totalprice") % 1000) / 1000.0).alias("p"))
    return reads.benjamini_hochberg(p).select("pos_a", F.round("q", 9).alias("q"))


LF = "(lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - {b} + 1))"
HYPER = f"""hy as (select pos_a, pos_b, n, a, b, ab, unnest(range(greatest(0, a + b - n), least(a, b) + 1)) as k from {{source}}),
 tails as (select pos_a, pos_b, n, a, b, ab, least(1, sum(case when k <= ab then exp(l) else 0 end)) as low, least(1, sum(case when k >= ab then exp(l) else 0 end)) as high from (select *, {LF.format(a="a", b="k")} + {LF.format(a="(n - a)", b="(b - k)")} - {LF.format(a="n", b="b")} as l from hy) group by all)"""


@query("fisher_tests", f"with {CONFUSION}, {HYPER.format(source='conf')} select pos_a, pos_b, n, a, b, ab, round(low, 6) as low, round(high, 6) as high, round(least(1, 2 * least(low, high)), 6) as p from tails")
def fisher_tests(spark, sf):
    return domains.fisher(_confusion(spark, sf)).withColumns({c: F.round(c, 6) for c in ("low", "high", "p")})


@query("eligible_pairs", f"with {CONFUSION} select pos_a, pos_b, n, a, b, ab from conf where n >= 100 and 1.0 * a * b / n >= 0.5")
def eligible_pairs(spark, sf):
    return domains.eligible(_confusion(spark, sf), 100, 0.5)


@query("bridges", f"""with {CONFUSION}, e as (select * from conf where n >= 50 and 1.0 * a * b / n >= 0.2), {HYPER.format(source='e')}, o as (select *, row_number() over (order by low, pos_a, pos_b) as i, count(*) over () as m from tails),
 q as (select *, least(1, min(low * m / i) over (order by i desc rows between unbounded preceding and current row)) as q from o)
 select pos_a, pos_b, n, a, b, ab, round(q, 6) as q, q < 0.5 and ab <= 1.0 * a * b / n / 1.2 as bridge from q""")
def bridges(spark, sf):
    found = domains.bridges(_confusion(spark, sf), 50, 0.2, fdr=0.5, fold=1.2)
    return found.select("pos_a", "pos_b", "n", "a", "b", "ab", F.round("q", 6).alias("q"), "bridge")


@query("block_scores", f"""with {CONFUSION}, k as (select pos_a, count(*) as e, count(*) filter (ab = 0) as z from conf where n >= 50 group by 1)
 select pos_a, round(z * ln(greatest(1.0 * z / e, 0.1) / 0.1) + (e - z) * ln((1 - least(greatest(1.0 * z / e, 0.1), 1 - 1e-9)) / 0.9) - ln(e) / 2, 7) as score from k where z < e""")
def block_scores(spark, sf):
    k = _confusion(spark, sf).where("n >= 50").groupBy("pos_a").agg(F.count("*").alias("e"), F.count_if(F.col("ab") == 0).alias("z")).where("z < e")
    return k.select("pos_a", F.round(stats.block_score(F.col("e"), F.col("z"), 0.1), 7).alias("score"))


@query("cut_crossing", f"with {CONFUSION}, c as (select * from conf where ab > 0) select p.pos, count(c.pos_a) as n from positions p left join c on c.pos_a <= p.pos and c.pos_b > p.pos group by 1")
def cut_crossing(spark, sf):
    return st.crossing(_confusion(spark, sf).where("ab > 0"), rm.positions(spark))


# Profiles.


@query("gini", f"with {P}, r as (select vec_id, mu, row_number() over (partition by vec_id order by mu) as r, count(*) over (partition by vec_id) as n from profiles) select vec_id, round(sum((2 * r - n - 1) * mu) / (max(n) * sum(mu)), 9) as gini from r group by 1")
def gini(spark, sf):
    return pf.gini(rm.profiles(spark, sf), ["vec_id"]).select("vec_id", F.round("gini", 9).alias("gini"))


@query("snr", f"with {P} select vec_id, round(avg(mu) filter (base in ('A', 'C')) / avg(mu) filter (base not in ('A', 'C')), 9) as snr from profiles group by 1")
def snr(spark, sf):
    return pf.snr(rm.profiles(spark, sf), ["vec_id"]).select("vec_id", F.round("snr", 9).alias("snr"))


@query("quantile", f"with {P} select vec_id, round(quantile_cont(mu, 0.9), 9) as q from profiles group by 1")
def quantile(spark, sf):
    return pf.quantile(rm.profiles(spark, sf), ["vec_id"], 0.9).select("vec_id", F.round("q", 9).alias("q"))


@query("winsorize", f"with {P}, q as (select vec_id, quantile_cont(mu, 0.9) as q from profiles group by 1) select vec_id, pos, round(least(greatest(mu / q, 0), 1), 9) as mu from profiles join q using (vec_id)")
def winsorize(spark, sf):
    return pf.normalize(rm.profiles(spark, sf), ["vec_id"], 0.9).select("vec_id", "pos", F.round("mu", 9).alias("mu"))


NEXT = f"{P}, xy as (select a.vec_id, a.pos, a.base, a.mu as x, b.mu as y from profiles a join profiles b on b.vec_id = a.vec_id + 1 and b.pos = a.pos)"


def _next(spark, sf):
    p = rm.profiles(spark, sf)
    return pf.paired(p, p.withColumn("vec_id", F.col("vec_id") - 1), ["vec_id", "pos"])


@query("marcd", f"with {NEXT} select vec_id, round(avg(abs(asin(2 * x - 1) - asin(2 * y - 1)) / pi()), 9) as marcd from xy group by 1")
def marcd(spark, sf):
    return pf.compare(_next(spark, sf), ["vec_id"], "marcd").select("vec_id", F.round("marcd", 9).alias("marcd"))


@query("pearson", f"with {NEXT} select vec_id, round(corr(x, y), 9) as pcc, round(corr(x, y) ** 2, 9) as r2 from xy group by 1")
def pearson(spark, sf):
    return _next(spark, sf).groupBy("vec_id").agg(F.round(pf.METRICS["pcc"](), 9).alias("pcc"), F.round(pf.METRICS["r2"](), 9).alias("r2"))


@query("spearman", f"with {NEXT}, r as (select vec_id, row_number() over (partition by vec_id order by x, pos) as rx, row_number() over (partition by vec_id order by y, pos) as ry from xy) select vec_id, round(corr(rx, ry), 9) as scc from r group by 1")
def spearman(spark, sf):
    return pf.compare(_next(spark, sf), ["vec_id"], "scc").select("vec_id", F.round("scc", 9).alias("scc"))


@query("delta_profile", f"with {NEXT} select vec_id, pos, round(y - x, 9) as delta from xy")
def delta_profile(spark, sf):
    return _next(spark, sf).select("vec_id", "pos", F.round(F.col("y") - F.col("x"), 9).alias("delta"))


@query("rolling_corr", f"with {NEXT} select vec_id, pos, round(avg(abs(asin(2 * x - 1) - asin(2 * y - 1)) / pi()) over (partition by vec_id order by pos range between 7 preceding and 7 following), 7) as marcd from xy")
def rolling_corr(spark, sf):
    return pf.rolling_compare(_next(spark, sf), ["vec_id"], 15, "marcd").select("vec_id", "pos", F.round("marcd", 7).alias("marcd"))


@query("rolling_pearson", f"with {NEXT} select a.vec_id, a.pos, round(corr(b.x, b.y), 6) as pcc from xy a join xy b on b.vec_id = a.vec_id and b.pos between a.pos - 7 and a.pos + 7 group by 1, 2")
def rolling_pearson(spark, sf):
    return pf.rolling_compare(_next(spark, sf), ["vec_id"], 15, "pcc").select("vec_id", "pos", F.round("pcc", 6).alias("pcc"))


WIN = "w as (select a.vec_id, a.pos as center, b.pos, b.base, b.mu from profiles a join profiles b on b.vec_id = a.vec_id and b.pos between a.pos - 7 and a.pos + 7)"


@query("rolling_gini", f"with {P}, {WIN}, r as (select vec_id, center, mu, row_number() over (partition by vec_id, center order by mu) as r, count(*) over (partition by vec_id, center) as n from w) select vec_id, center as pos, round(sum((2 * r - n - 1) * mu) / (max(n) * sum(mu)), 7) as gini from r group by 1, 2")
def rolling_gini(spark, sf):
    return pf.rolling_gini(rm.profiles(spark, sf), ["vec_id"], 15).select("vec_id", "pos", F.round("gini", 7).alias("gini"))


@query("rolling_snr", f"with {P}, {WIN} select vec_id, center as pos, round(avg(mu) filter (base in ('A', 'C')) / avg(mu) filter (base not in ('A', 'C')), 7) as snr from w group by 1, 2")
def rolling_snr(spark, sf):
    return pf.rolling_snr(rm.profiles(spark, sf), ["vec_id"], 15).select("vec_id", "pos", F.round("snr", 7).alias("snr"))


ROC = """{key_rows}, o as (select *, row_number() over (partition by {k} order by mu, pos) as i, sum(pd) over (partition by {k} order by mu, pos rows unbounded preceding) as p, sum(1 - pd) over (partition by {k} order by mu, pos rows unbounded preceding) as u, sum(pd) over (partition by {k}) as np, sum(1 - pd) over (partition by {k}) as nu from z),
 c as (select {k}, i, 1 - 1.0 * p / nullif(np, 0) as fpr, 1 - 1.0 * u / nullif(nu, 0) as tpr from o union all select {k}, 0, case when np > 0 then 1.0 end, case when nu > 0 then 1.0 end from o where i = 1),
 auc as (select {k}, sum(d) as auc from (select {k}, (lag(fpr) over (partition by {k} order by i) - fpr) * tpr as d from c) group by {k})"""
Z = f"{P}, z as (select vec_id, pos, mu, cast(pos % 3 = 0 as int) as pd from profiles)"


def _paired(spark, sf):
    return rm.profiles(spark, sf).withColumn("paired", F.col("pos") % 3 == 0)


@query("roc", f"with {ROC.format(key_rows=Z, k='vec_id')} select vec_id, i, round(fpr, 9) as fpr, round(tpr, 9) as tpr from c")
def roc(spark, sf):
    return pf.roc(_paired(spark, sf), ["vec_id"]).select("vec_id", "i", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("auc", f"with {ROC.format(key_rows=Z, k='vec_id')} select vec_id, round(auc, 9) as auc from auc")
def auc(spark, sf):
    return pf.auc(pf.roc(_paired(spark, sf), ["vec_id"]), ["vec_id"]).select("vec_id", F.round("auc", 9).alias("auc"))


ZW = f"{P}, {WIN}, z as (select vec_id, center, pos, mu, cast(pos % 3 = 0 as int) as pd from w)"


@query("rolling_auc", f"with {ROC.format(key_rows=ZW, k='vec_id, center')} select vec_id, center as pos, round(auc, 7) as auc from auc")
def rolling_auc(spark, sf):
    return pf.rolling_auc(_paired(spark, sf), ["vec_id"], 15).select("vec_id", "pos", F.round("auc", 7).alias("auc"))


@query("low_rate_runs", f"with {P}, r as (select vec_id, pos, pos - row_number() over (partition by vec_id order by pos) as run from profiles where mu < 0.1) select vec_id, min(pos) as end5, max(pos) as end3 from r group by vec_id, run having count(*) >= 4")
def low_rate_runs(spark, sf):
    return pf.low_runs(rm.profiles(spark, sf), ["vec_id"], 0.1, 4)


@query("pool_check", f"""with {P}, m as (select label as sample, pos, avg(mu) as mu from profiles group by 1, 2), j as (select a.sample as sample_a, b.sample as sample_b, corr(a.mu, b.mu) as pearson, avg(abs(asin(2 * a.mu - 1) - asin(2 * b.mu - 1)) / pi()) as marcd from m a join m b on a.pos = b.pos and a.sample < b.sample group by 1, 2)
 select sample_a, sample_b, round(pearson, 7) as pearson, round(marcd, 9) as marcd, coalesce(pearson >= 0.2 and marcd <= 0.1, false) as ok from j""")
def pool_check(spark, sf):
    mean = rm.profiles(spark, sf).groupBy(F.col("label").alias("sample"), "pos").agg(F.avg("mu").alias("mu"))
    return pf.pool_check(mean, "sample", 0.2, 0.1).select("sample_a", "sample_b", F.round("pearson", 7).alias("pearson"), F.round("marcd", 9).alias("marcd"), "ok")


@query("table_pairs", "with t as (select distinct vec_id % 7 as ref, label as sample from embeddings) select a.ref, a.sample as sample_a, b.sample as sample_b from t a join t b on a.ref = b.ref and a.sample < b.sample")
def table_pairs(spark, sf):
    """Pairs of samples, of which there are few, that have a table of the same reference."""
    t = rm.table(spark, sf, "embeddings").select((F.col("vec_id") % 7).alias("ref"), F.col("label").alias("sample"))
    return pf.table_pairs(t, ["ref"], "sample")


@query("profile_histogram", f"with {P} select cast(b as int) as bin, count(p.mu) as n from range(0, 10) t(b) left join profiles p on least(cast(floor(mu / 0.1) as int), 9) = b group by 1")
def profile_histogram(spark, sf):
    return pf.histogram(rm.profiles(spark, sf), "mu", 10, 0.0, 1.0)


# Structures and regions.


@query("root_pairs", f"with {B} select struct, end5, end3 from bp p where not exists (select 1 from bp o where o.struct = p.struct and o.end5 < p.end5 and o.end3 > p.end3)")
def root_pairs(spark, sf):
    return st.root_pairs(rm.pairs(spark, sf))


@query("enclosing_pairs", f"with {R}, {B}, e as (select p.pos, b.struct, b.end5, b.end3, row_number() over (partition by b.struct, p.pos order by b.end3 - b.end5, b.end5) as i from positions p join bp b on p.pos > b.end5 and p.pos < b.end3) select struct, pos, end5, end3 from e where i = 1")
def enclosing_pairs(spark, sf):
    return st.enclosing(rm.positions(spark), rm.pairs(spark, sf))


@query("internal_pairs", f"with {B} select p.struct, p.pos, p.partner from pairs p join pairs a on a.struct = p.struct and a.pos = p.pos - 1 and a.partner = p.partner + 1 join pairs b on b.struct = p.struct and b.pos = p.pos + 1 and b.partner = p.partner - 1")
def internal_pairs(spark, sf):
    return st.internal(rm.pairs(spark, sf))


@query("stems", f"with {B}, r as (select *, end5 - row_number() over (partition by struct, end5 + end3 order by end5) as run from bp) select struct, min(end5) as end5, max(end3) as end3, count(*) as length from r group by struct, end5 + end3, run")
def stems(spark, sf):
    return st.stems(rm.pairs(spark, sf))


@query("wfmi", f"""with {R}, {B}, k as (select distinct a.struct as key from bp a join bp b on b.struct = a.struct + 1), j as (select k.key, p.pos, a.partner as x, b.partner as y from k cross join positions p left join pairs a on a.struct = k.key and a.pos = p.pos left join pairs b on b.struct = k.key + 1 and b.pos = p.pos),
 s as (select key, count(*) filter (x is null and y is null) as u, count(*) filter (x is not null or y is not null) as p, count(x) as n1, count(y) as n2, count(*) filter (x = y) as n12 from j group by 1)
 select key, round(1.0 * u / (u + p) + (1 - 1.0 * u / (u + p)) * case when n1 > 0 and n2 > 0 then n12 / sqrt(n1 * n2) else 0 end, 9) as wfmi from s""")
def wfmi(spark, sf):
    """Each structure against the next."""
    p = rm.pairs(spark, sf)
    a, b = p.withColumnRenamed("struct", "key"), p.withColumn("key", F.col("struct") - 1).drop("struct")
    keys = a.select("key").distinct().join(b.select("key").distinct().hint("merge"), "key")
    every = keys.crossJoin(F.broadcast(rm.positions(spark)))  # as many rows as structures by positions
    return st.wfmi(a, b, every, ["key"]).withColumn("wfmi", F.round("wfmi", 9))


@query("renumber_pairs", f"with {B} select struct, pos + 10 as pos, partner + 10 as partner from pairs")
def renumber_pairs(spark, sf):
    return st.renumber(rm.pairs(spark, sf), 10)


REGS = "regs as (select o_custkey as ref, cast(o_orderkey % 60 + 1 as int) as end5, cast(o_orderkey % 60 + 30 as int) as end3 from orders)"


def _regions(spark, sf):
    return rm.table(spark, sf, "orders").select(F.col("o_custkey").alias("ref"), (F.col("o_orderkey") % 60 + 1).cast("int").alias("end5"), (F.col("o_orderkey") % 60 + 30).cast("int").alias("end3"))


@query("region_intersect", f"with {REGS}, c as (select ref, max(end5) as a, min(end3) as b from regs group by 1) select ref, case when a <= b then a end as end5, case when a <= b then b end as end3 from c")
def region_intersect(spark, sf):
    return st.intersect(_regions(spark, sf), ["ref"])


@query("region_unite", f"with {REGS}, h as (select ref, min(end5) as end5, max(end3) as end3 from regs group by 1), e as (select ref, unnest(range(end5, end3 + 1)) as pos from h), g as (select e.ref, count(*) as gaps from e where not exists (select 1 from regs r where r.ref = e.ref and e.pos between r.end5 and r.end3) group by 1) select h.ref, h.end5, h.end3, coalesce(g.gaps, 0) as gaps from h left join g using (ref)")
def region_unite(spark, sf):
    hull, gaps = st.unite(_regions(spark, sf), ["ref"])
    return hull.join(gaps.groupBy("ref").agg(F.count("*").alias("gaps")).hint("merge"), "ref", "left").fillna(0, "gaps")


@query("pool_samples", """with r as (select l_orderkey as read, l_returnflag as sample, cast(l_orderkey % 4 as bigint) as batch from lineitem), s as (select sample, max(batch) + 1 as n from r group by 1), f as (select sample, sum(n) over (order by sample) - n as shift from s)
 select r.sample, batch + shift as batch, count(*) as reads from r join f using (sample) group by 1, 2""")
def pool_samples(spark, sf):
    li = rm.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read"), (F.col("l_orderkey") % 4).alias("batch"), F.col("l_returnflag").alias("sample"))
    names = sorted(r["sample"] for r in li.select("sample").distinct().collect())
    pooled = regions.pool({name: li.where(F.col("sample") == name).drop("sample") for name in names})
    return pooled.groupBy("sample", "batch").agg(F.count("*").alias("reads"))


# Clusters.

RESPS = "resps as (select read, 2 as k, 1 as clust, (read % 10) / 10.0 as weight from segs union all select read, 2, 2, 1 - (read % 10) / 10.0 from segs)"


def _resps(spark, sf):
    one = (F.col("read") % 10) / 10.0
    return rm.segments(spark, sf).select("read", F.lit(2).alias("k"), F.explode(F.array(F.struct(F.lit(1).alias("clust"), one.alias("weight")), F.struct(F.lit(2).alias("clust"), (1 - one).alias("weight")))).alias("x")).select("read", "k", "x.*")


@query("abundance", f"with {R}, {RESPS}, a as (select k, clust, sum(weight) as n from resps group by 1, 2) select k, clust, round(n, 6) as n, round(n / sum(n) over (partition by k), 9) as share from a")
def abundance(spark, sf):
    return clusters.abundance(_resps(spark, sf)).select("k", "clust", F.round("n", 6).alias("n"), F.round("share", 9).alias("share"))


@query("clustered_counts", f"with {R}, {RESPS} select k, clust, pos, rel, round(sum(weight), 6) as n from muts join resps using (read) group by 1, 2, 3, 4")
def clustered_counts(spark, sf):
    return clusters.clustered_counts(rm.muts(spark, sf), _resps(spark, sf)).withColumn("n", F.round("n", 6))


def _uniq(spark, sf):
    return clustering.prepare(reads.unique_reads(rm.segments(spark, sf), reads.positive(rm.muts(spark, sf), MUT)))


def _rates(spark):
    mu = 0.01 + 0.04 * ((F.col("pos") * F.col("clust")) % 7) / 7
    return rm.positions(spark).select("pos", F.explode(F.array(F.lit(1), F.lit(2))).alias("clust")).select("clust", "pos", mu.alias("mu"))


@query("e_step", f"""with {R}, {HITS}, rates as (select c as clust, pos, 0.01 + 0.04 * ((pos * c) % 7) / 7 as mu from positions, (select unnest([1, 2]) as c)),
 none as (select s.read, r.clust, sum(ln(1 - mu)) as l from segs s join rates r on r.pos between s.end5 and s.end3 group by 1, 2),
 odd as (select h.read, r.clust, sum(ln(mu) - ln(1 - mu)) as o from hits h join rates r using (pos) group by 1, 2),
 j as (select n.read, n.clust, ln(case n.clust when 1 then 0.6 else 0.4 end) + l + coalesce(o, 0) as logp from none n left join odd o using (read, clust)),
 m as (select *, max(logp) over (partition by read) as top from j), s as (select read, clust, logp, ln(sum(exp(logp - top)) over (partition by read)) + top as marginal from m)
 select clust, round(sum(exp(logp - marginal)), 4) as weight, round(sum(marginal), 3) as log_like from s group by 1""")
def e_step(spark, sf):
    shares = spark.createDataFrame([(1, 0.6), (2, 0.4)], "clust int, p double")
    r = clusters.responsibilities(clusters.log_joint(_uniq(spark, sf), _rates(spark), shares))
    return r.groupBy("clust").agg(F.round(F.sum(F.col("weight") * F.col("n")), 4).alias("weight"), F.round(F.sum(F.col("marginal") * F.col("n")), 3).alias("log_like"))


@query("m_step", f"""with {R}, {HITS}, {RESPS}, c as (select r.clust, p.pos, sum(r.weight) as cov from positions p join segs s on p.pos between s.end5 and s.end3 join resps r using (read) group by 1, 2),
 h as (select r.clust, h.pos, sum(r.weight) as hits from hits h join resps r using (read) group by 1, 2) select clust, pos, round(coalesce(hits, 0) / cov, 9) as mu from c left join h using (clust, pos)""")
def m_step(spark, sf):
    segs, hits = rm.segments(spark, sf), reads.positive(rm.muts(spark, sf), MUT)
    uniq = segs.join(hits.groupBy("read").agg(F.collect_set("pos").alias("muts")), "read", "left").select(F.col("read").alias("uid"), "end5", "end3", F.coalesce("muts", F.array().cast("array<int>")).alias("muts"), F.lit(1).alias("n"))
    rates, _ = clusters.maximize(uniq, _resps(spark, sf).select(F.col("read").alias("uid"), "clust", "weight", F.lit(1).alias("n")), rm.positions(spark))
    return rates.withColumn("mu", F.round("mu", 9))


def _written(spark, df, name):
    """Unique reads written once, for the many passes to come, in files for all cores."""
    path = tables.scratch_path(spark, name)
    tables.dealt(df, "uid").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@query("em_cluster")
def em_cluster(spark, sf):
    """Two clusters, from two starts that share each pass, until both settle; weights by first position of the likelier run."""
    uniq = _written(spark, _uniq(spark, sf), "uniq")
    runs = clustering.fit(uniq, {None: clustering.places(rm.positions(spark))}, [clustering.Start(2, seed) for seed in (0, 1)])
    best = clustering.by_likelihood(runs)[0]
    weighted = clustering.weights(uniq, best.params).join(uniq.select("uid", "end5"), "uid")
    return weighted.groupBy("clust", "end5").agg(F.sum(F.col("weight") * F.col("n")).alias("n"))


@query("expected_reads")
def expected_reads(spark, sf):
    """Observed and expected counts of unique reads by one cluster, and the jackpot score."""
    uniq = _written(spark, _uniq(spark, sf), "uniq")
    run = clustering.run_em(uniq, rm.positions(spark), 1)
    return stats.jackpot_score(clustering.expected_counts(uniq, run.params))


@query("join_regions", f"with {R}, two as (select read, pos, rel from muts where pos <= 60 union select read, pos, rel from muts where pos between 41 and 120) select read, cast(count(*) as bigint) as n, cast(sum(rel) as bigint) as rels from two group by 1")
def join_regions(spark, sf):
    segs, muts = rm.segments(spark, sf), rm.muts(spark, sf)
    _, joined = clusters.join_regions(reads.clip(segs, muts, 1, 60), reads.clip(segs, muts, 41, 120))
    return joined.groupBy("read").agg(F.count("*").alias("n"), F.sum("rel").alias("rels"))


@query("join_clusters", f"""with {R}, {RESPS}, two as (select 'a' as reg, * from resps union all select 'b', read, k, 3 - clust, weight from resps where read % 3 = 0),
 s as (select read, k, case when reg = 'a' then clust else 3 - clust end as j, sum(weight) as w from two group by 1, 2, 3) select j as clust, round(sum(w / t), 6) as n from (select *, sum(w) over (partition by read, k) as t from s) group by 1""")
def join_clusters(spark, sf):
    r = _resps(spark, sf)
    two = r.withColumn("reg", F.lit("a")).unionByName(r.where("read % 3 = 0").withColumn("clust", 3 - F.col("clust")).withColumn("reg", F.lit("b")))
    regions = spark.createDataFrame([("a", 2, 1, 1), ("a", 2, 2, 2), ("b", 2, 2, 1), ("b", 2, 1, 2)], "reg string, k int, clust int, joined int")
    return clusters.join_clusters(two, regions).groupBy("clust").agg(F.round(F.sum("weight"), 6).alias("n"))


# Bias.


@query("adjusted_counts", f"""with {PER_POS}, y as (select *, case base when 'A' then 238 when 'C' then 222 when 'G' then 190 else 126 end as yes from per_pos where n > 0),
 t as (select pos, base, sum(n) filter ((rel | yes | 1) = (yes | 1)) as cov, coalesce(sum(n) filter (rel = 1), 0) as mat, coalesce(sum(n) filter ((rel | yes) = yes and rel <> 1), 0) as mut, coalesce(sum(n) filter (rel = 2), 0) as del from y group by 1, 2)
 select pos, base, round(cov / 0.8, 6) as Covered, round((mat + mut) / 0.8, 6) as Informative, round((mat + mut) / 0.8 * (1 - 0.05), 6) as Matched, round((mat + mut) / 0.8 * 0.05, 6) as Mutated, round(case when mut > 0 then del * ((mat + mut) / 0.8 * 0.05) / mut else 0 end, 6) as Deleted from t""")
def adjusted_counts(spark, sf):
    rates = rm.positions(spark).select("pos", F.lit(0.05).alias("mu"))
    out = bias.adjust(position_table(spark, sf), rates, 0.8, ("Deleted",))
    return out.select("pos", "base", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


# Sequences, alignments and barcodes.


@query("revcomp", f"with {S} select ref, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) as rc, md5(replace(seq, 'T', 'U')) as rna from seqs")
def revcomp(spark, sf):
    return rm.sequences(spark, sf).select("ref", F.md5(sq.revcomp(F.col("seq"))).alias("rc"), F.md5(sq.transcribe(F.col("seq"))).alias("rna"))


@query("kmers", f"with {S}, k as (select unnest(list_transform(range(1, greatest(length(seq) - 1, 1)), lambda i: substr(seq, i, 3))) as kmer from seqs) select kmer, count(*) as n from k where length(kmer) = 3 group by 1")
def kmers(spark, sf):
    return rm.sequences(spark, sf).select(F.explode(sq.kmers(F.col("seq"), 3)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


@query("base_composition", f"with {S}, c as (select ref, substr(seq, unnest(range(1, length(seq) + 1)), 1) as base from seqs) select ref, base, count(*) as n from c group by 1, 2")
def base_composition(spark, sf):
    return sq.positions(rm.sequences(spark, sf)).groupBy("ref", "base").agg(F.count("*").alias("n"))


@query("clean_sequences", "select p_partkey as ref, case when regexp_full_match(c, '[ACGTN]*') then c end as seq from (select p_partkey, regexp_replace(translate(upper(regexp_replace(p_name, '\\s', '', 'g')), 'U', 'T'), '[RYSWKMBDHV]', 'N', 'g') as c from part)")
def clean_sequences(spark, sf):
    return rm.table(spark, sf, "part").select(F.col("p_partkey").alias("ref"), sq.clean(F.col("p_name")).alias("seq"))


@query("locate_primer", f"with {S} select ref, case when instr(seq, 'NANN') > 0 and instr(substr(seq, instr(seq, 'NANN') + 1), 'NANN') = 0 then cast(instr(seq, 'NANN') as int) end as at from seqs")
def locate_primer(spark, sf):
    return rm.sequences(spark, sf).select("ref", sq.locate(F.col("seq"), F.lit("NANN")).alias("at"))


@query("degenerate", "with recursive d as (select o_orderkey as ref, substr('ACGTRYSWKM', cast(o_orderkey % 10 + 1 as int), 1) || substr('RYKMACGTSW', cast(o_custkey % 10 + 1 as int), 1) || 'A' as seq from orders), iupac as (select unnest(['A','C','G','T','R','Y','S','W','K','M']) as k, unnest(['A','C','G','T','AG','CT','CG','AT','GT','AC']) as v) select ref, substr(a.v, x, 1) || substr(b.v, y, 1) || 'A' as seq from d join iupac a on a.k = substr(seq, 1, 1) join iupac b on b.k = substr(seq, 2, 1), (select unnest([1, 2]) as x), (select unnest([1, 2]) as y) where x <= length(a.v) and y <= length(b.v)")
def degenerate(spark, sf):
    o = rm.table(spark, sf, "orders")
    seq = F.concat(F.substring(F.lit("ACGTRYSWKM"), (F.col("o_orderkey") % 10 + 1).cast("int"), F.lit(1)), F.substring(F.lit("RYKMACGTSW"), (F.col("o_custkey") % 10 + 1).cast("int"), F.lit(1)), F.lit("A"))
    return o.select(F.col("o_orderkey").alias("ref"), F.explode(sq.degenerate(seq)).alias("seq"))


SAM = "sam as (select (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as name, cast(l_partkey % 4 * 16 + l_suppkey % 2 + l_linenumber % 3 * 128 as int) as flag, l_suppkey % 5 as ref, cast(l_partkey % 90 + 1 as int) as pos, cast(l_quantity as int) as mapq, cast(5 + l_orderkey % 7 as varchar) || 'M' || cast(1 + l_orderkey % 2 as varchar) || 'D' || cast(3 + l_partkey % 5 as varchar) || 'M2I4M3S' as cigar from lineitem)"


def _sam(spark, sf):
    key, part, supp, num = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    cig = F.concat((5 + key % 7).cast("string"), F.lit("M"), (1 + key % 2).cast("string"), F.lit("D"), (3 + part % 5).cast("string"), F.lit("M2I4M3S"))
    return rm.table(spark, sf, "lineitem").select(((key * 10 + num) * 1000000 + part).alias("name"), (part % 4 * 16 + supp % 2 + num % 3 * 128).cast("int").alias("flag"), (supp % 5).alias("ref"), (part % 90 + 1).cast("int").alias("pos"), F.col("l_quantity").cast("int").alias("mapq"), cig.alias("cigar"))


@query("sam_view", f"with {SAM} select name, flag, ref, pos from sam where flag & 1 = 1 and flag & 16 = 0 and mapq >= 25")
def sam_view(spark, sf):
    return text.view(_sam(spark, sf), 1, 16, 25).select("name", "flag", "ref", "pos")


@query("flagstat", f"with {SAM} select count(*) as total, count(*) filter (flag & 1 <> 0) as paired, count(*) filter (flag & 1 <> 0 and flag & 2 <> 0) as proper, count(*) filter (flag & 4 = 0) as mapped, count(*) filter (flag & 16 <> 0) as reverse, count(*) filter (flag & 256 <> 0) as secondary, count(*) filter (flag & 2048 <> 0) as supplementary from sam")
def flagstat(spark, sf):
    return text.flagstat(_sam(spark, sf))


@query("idxstats", f"with {SAM} select ref, count(*) as n from sam group by 1")
def idxstats(spark, sf):
    return text.idxstats(_sam(spark, sf))


@query("strands", f"with {SAM} select case when (flag & 16 <> 0) <> (flag & 1 <> 0 and flag & 128 <> 0) then 'reverse' else 'forward' end as strand, count(*) as n from sam group by 1")
def strands(spark, sf):
    return _sam(spark, sf).groupBy(text.strand(F.col("flag")).alias("strand")).agg(F.count("*").alias("n"))


@query("min_reads", f"with {SAM}, k as (select name, pos % 90 as ref from sam), g as (select ref from k group by 1 having count(*) >= (select count(*) / 90 from sam)) select ref, count(*) as n from k semi join g using (ref) group by 1")
def min_reads(spark, sf):
    sam = _sam(spark, sf).withColumn("ref", F.col("pos") % 90)
    least = sam.count() / 90
    return text.idxstats(text.min_reads(sam, least))


@query("cigar_counts", f"with {SAM}, x as (select name, cigar, list_transform(regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1), lambda v: cast(v as int)) as r, list_transform(regexp_extract_all(cigar, '(\\d+)[MIS=X]', 1), lambda v: cast(v as int)) as q, list_transform(regexp_extract_all(cigar, '(\\d+)[IDX]', 1), lambda v: cast(v as int)) as m from sam) select name, cast(list_sum(r) as int) as ref_len, cast(list_sum(q) as int) as read_len, cast(list_sum(m) as int) as muts from x")
def cigar_counts(spark, sf):
    c = F.col("cigar")
    return _sam(spark, sf).select("name", sq.cigar_total(c, sq.REF_OPS).alias("ref_len"), sq.cigar_total(c, sq.READ_OPS).alias("read_len"), sq.cigar_total(c, sq.MUT_OPS).alias("muts"))


@query("cigar_ops", f"""with {SAM}, x as (select name, pos, unnest(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]')) as t, generate_subscripts(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]'), 1) - 1 as i from sam),
 y as (select name, pos, i, right(t, 1) as op, cast(left(t, length(t) - 1) as int) as n from x)
 select name, i, op, n, cast(coalesce(sum(case when op in ('M','I','S','=','X') then n else 0 end) over w, 0) + 1 as bigint) as read_at, cast(coalesce(sum(case when op in ('M','D','N','=','X') then n else 0 end) over w, 0) + pos as bigint) as ref_at from y window w as (partition by name order by i rows between unbounded preceding and 1 preceding)""")
def cigar_ops(spark, sf):
    return sq.cigar(_sam(spark, sf)).select("name", "i", "op", "n", "read_at", "ref_at")


@query("encode_rel", """with x as (select l_orderkey, l_linenumber, substr('ACGTN', cast(l_partkey % 5 + 1 as int), 1) as r, substr('ACGTN', cast(l_suppkey % 5 + 1 as int), 1) as q, cast(l_quantity as int) as ql from lineitem),
 o as (select *, case r when 'A' then 16 when 'C' then 32 when 'G' then 64 when 'T' then 128 else 0 end as own, case q when 'A' then 16 when 'C' then 32 when 'G' then 64 when 'T' then 128 else 0 end as sub from x)
 select l_orderkey, l_linenumber, case when own = 0 then 241 when ql < 25 or sub = 0 then xor(241, own) when r = q then 1 else sub end as rel from o""")
def encode_rel(spark, sf):
    at = lambda c: F.substring(F.lit("ACGTN"), (F.col(c) % 5 + 1).cast("int"), F.lit(1))
    return rm.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", codes.encode(at("l_partkey"), at("l_suppkey"), F.col("l_quantity").cast("int"), 25).alias("rel"))


@query("rel_fits", f"with {R}, {FIT} select read, pos, ((rel | yes) = yes) <> (rel = 1) as info, (rel | yes) = yes and rel <> 1 as fit from fit")
def rel_fits(spark, sf):
    info, fit = codes.informative(F.col("base"), F.col("rel"), MUT)
    return rm.muts(spark, sf).select("read", "pos", info.alias("info"), fit.alias("fit"))


REFSEQ = "ACGTTGCAACGGTTCA" * 10


def _aligned(spark, sf):
    """An alignment for each line item: a part of the reference, then another part, with an indel between or none. The given
    table is one block of a file; alignments come in many, so they are dealt to all cores."""
    li = tables.dealt(rm.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")
    a, b = (5 + F.col("l_orderkey") % 7).cast("int"), (6 + F.col("l_partkey") % 5).cast("int")
    cut = lambda at, n: F.substring(F.lit(REFSEQ), (F.col(at) % 90 + 1).cast("int"), n)
    cigar = F.when(F.col("l_linenumber") % 3 == 0, F.concat(a.cast("string"), F.lit("M1D"), b.cast("string"), F.lit("M"))).when(F.col("l_linenumber") % 3 == 1, F.concat(a.cast("string"), F.lit("M2I"), (b - 2).cast("string"), F.lit("M"))).otherwise(F.concat((a + b).cast("string"), F.lit("M")))
    return li.select(F.concat_ws(".", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]).alias("name"), F.lit(0).alias("flag"), F.lit("r").alias("ref"), (F.col("l_partkey") % 90 + 1).cast("int").alias("pos"), F.lit(40).alias("mapq"), cigar.alias("cigar"), F.concat(cut("l_partkey", a), cut("l_suppkey", b)).alias("seq"), F.repeat(F.lit("I"), a + b).alias("qual"))


def _reference(spark):
    return spark.createDataFrame([("r", REFSEQ)], "ref string, seq string")


@query("identify_mutations")
def identify_mutations(spark, sf):
    """All alignments; those with indels are walked one by one."""
    refs = _reference(spark)
    paired = alignments.pair(alignments.identify(_aligned(spark, sf), refs))
    _, muts = alignments.tables(paired, refs)
    return muts.groupBy("pos", "base", "rel").agg(F.count("*").alias("n"))


@query("identify_plain", f"""with x as (select cast(l_partkey % 90 + 1 as int) as pos, cast(5 + l_orderkey % 7 as int) as a, cast(6 + l_partkey % 5 as int) as b, cast(l_suppkey % 90 + 1 as int) as s, '{REFSEQ}' as ref from lineitem where l_linenumber % 3 = 2),
 y as (select pos, ref, substr(ref, pos, a) || substr(ref, s, b) as seq from x), z as (select pos, ref, seq, unnest(range(length(seq))) as i from y),
 e as (select cast(pos + i as int) as pos, substr(ref, pos + i, 1) as base, substr(seq, i + 1, 1) as q from z) select pos, base, case q when 'A' then 16 when 'C' then 32 when 'G' then 64 else 128 end as rel, count(*) as n from e where q <> base group by 1, 2, 3""")
def identify_plain(spark, sf):
    """Alignments without indels, by expressions alone."""
    refs = _reference(spark)
    paired = alignments.pair(alignments.identify(_aligned(spark, sf).where(~F.col("cigar").rlike("[ID]")), refs))
    _, muts = alignments.tables(paired, refs)
    return muts.groupBy("pos", "base", "rel").agg(F.count("*").alias("n"))


@query("rejected_alignments", """select case when l_linenumber % 7 = 3 then 'a CIGAR operation comes twice in a row' when l_linenumber % 7 = 5 then 'the CIGAR string and the read differ in length' else 'the first operation is no aligned base' end as error, count(*) as n from lineitem where l_linenumber % 7 in (3, 5, 6) group by 1""")
def rejected_alignments(spark, sf):
    """Bad alignments are counted by reason, and all others go on."""
    k = F.split("name", r"\.")[1].cast("int") % 7
    bad = F.when(k == 3, F.regexp_replace("cigar", r"^(\d+)M", "$1M1M")).when(k == 5, F.concat("cigar", F.lit("1S"))).when(k == 6, F.concat(F.lit("1D"), "cigar")).otherwise(F.col("cigar"))
    return alignments.rejected(alignments.pair(alignments.identify(_aligned(spark, sf).withColumn("cigar", bad), _reference(spark))))


BAR = "bar as (select n_nationkey as k, n_name as name, substr('ACGT', n_nationkey % 4 + 1, 1) || substr('ACGT', n_nationkey // 4 % 4 + 1, 1) || substr('ACGT', n_nationkey // 16 + 1, 1) || substr('GATC', n_nationkey % 4 + 1, 1) || substr('TCGA', n_nationkey // 4 % 4 + 1, 1) as seq from nation)"
NEAR = """one as (select distinct name, substr(seq, 1, i - 1) || c || substr(seq, i + 1) as seq from bar, (select unnest(range(1, 6)) as i), (select unnest(['A', 'C', 'G', 'T']) as c))"""
BARREADS = "rd as (select o_orderkey as read, substr('ACGTACGGTCATTGCAGT', cast(o_orderkey % 9 + 1 as int), 4) || substr('TTACGCGATAGCCATGAC', cast(o_custkey % 9 + 1 as int), 6) as seq from orders)"


def _barcodes(spark, sf):
    k = F.col("n_nationkey")
    at = lambda letters, i: F.substring(F.lit(letters), i.cast("int") + 1, F.lit(1))
    seq = F.concat(at("ACGT", k % 4), at("ACGT", F.floor(k / 4) % 4), at("ACGT", F.floor(k / 16)), at("GATC", k % 4), at("TCGA", F.floor(k / 4) % 4))
    return rm.table(spark, sf, "nation").select(F.col("n_name").alias("name"), seq.alias("seq"), F.lit(2).alias("pos"))


@query("barcode_neighbors", f"with {BAR}, {NEAR} select name, seq from one")
def barcode_neighbors(spark, sf):
    return demult.neighbors(_barcodes(spark, sf), 1)


@query("demultiplex", f"with {BAR}, {NEAR}, {BARREADS}, m as (select distinct r.read, o.name from rd r, (select unnest([1, 2, 3]) as at) p, one o where substr(r.seq, p.at, 5) = o.seq) select read, min(name) as name from m group by 1 having count(*) = 1")
def demultiplex(spark, sf):
    o = rm.table(spark, sf, "orders").select(F.col("o_orderkey").alias("read"), F.concat(F.substring(F.lit("ACGTACGGTCATTGCAGT"), (F.col("o_orderkey") % 9 + 1).cast("int"), F.lit(4)), F.substring(F.lit("TTACGCGATAGCCATGAC"), (F.col("o_custkey") % 9 + 1).cast("int"), F.lit(6))).alias("seq"))
    return demult.assign(o, _barcodes(spark, sf), 1, 1)


@query("dirichlet_params", f"with {P}, m as (select vec_id, avg(mu) as m, var_pop(mu) as v from profiles group by 1) select vec_id, round(m * (m * (1 - m) / v - 1), 6) as alpha, round((1 - m) * (m * (1 - m) / v - 1), 6) as beta from m")
def dirichlet_params(spark, sf):
    m = rm.profiles(spark, sf).groupBy("vec_id").agg(F.avg("mu").alias("m"), F.var_pop("mu").alias("v"))
    a, b = stats.beta_params(F.col("m"), F.col("v"))
    return m.select("vec_id", F.round(a, 6).alias("alpha"), F.round(b, 6).alias("beta"))


@query("kumaraswamy", f"with {P} select vec_id, pos, round(2 * 3 * pow(mu, 1.0) * pow(1 - pow(mu, 2.0), 2.0), 9) as pdf from profiles")
def kumaraswamy(spark, sf):
    return rm.profiles(spark, sf).select("vec_id", "pos", F.round(stats.kumaraswamy(F.col("mu"), 2.0, 3.0), 9).alias("pdf"))


@query("pattern_rates", f"with {PER_POS}, y as (select *, case base when 'A' then 238 when 'C' then 222 when 'G' then 190 else 126 end as yes from per_pos where n > 0 and rel <> 255) select pos, base, round(1.0 * sum(n) filter ((rel | yes) = yes) / sum(n) filter (rel = 1 or (rel | yes) = yes), 9) as mu from y group by 1, 2")
def pattern_rates(spark, sf):
    rates = rels_per_pos(spark, sf).where("rel <> 255").withColumn("p", F.col("n").cast("double"))
    return stats.pattern_rate(rates, MUT).withColumn("mu", F.round("mu", 9))


@query("web_export", f"with {P} select cast(label as varchar) as sample, cast(vec_id as varchar) as ref, pos, round(mu, 3) as mu from profiles")
def web_export(spark, sf):
    t = rm.profiles(spark, sf).select(F.col("label").cast("string").alias("sample"), F.col("vec_id").cast("string").alias("ref"), F.lit("full").alias("reg"), F.lit("average").alias("clust"), "pos", F.round("mu", 3).alias("mu"))
    back = F.from_json("json", "map<string,map<string,array<double>>>")["full"]["average"]
    return text.export_json(t).select("sample", "ref", F.posexplode(back).alias("i", "mu")).select("sample", "ref", (F.col("i") + 1).alias("pos"), "mu")


# Streams.


def _stream(spark, sf, name):
    return spark.readStream.schema(rm.table(spark, sf, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _counted(spark, counts):
    path = tables.scratch_path(spark, "stream")
    stream.run_available(counts, path)
    return spark.read.schema(counts.schema).parquet(f"{path}/table")


@query("streaming_event_windows", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events group by 1, 2")
def streaming_event_windows(spark, sf):
    events = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = stream.windowed(events, "ts", "1 hour", "1 day", ["event_type"])
    return _counted(spark, out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n"))


@query("streaming_position_counts", f"with {R.split('muts as')[0].rstrip().rstrip(',')}, y as (select *, case base when 'A' then 238 when 'C' then 222 when 'G' then 190 else 126 end as yes from cod where c <> 1) select pos, base, count(*) filter ((c | yes) = yes) as Mutated_fit from y group by 1, 2")
def streaming_position_counts(spark, sf):
    rows = rm.coded(_stream(spark, sf, "lineitem")).where("c <> 1").select("pos", "base", F.col("c").alias("rel"))
    return _counted(spark, stream.position_counts(rows, {"Mutated": MUT}).select("pos", "base", "Mutated_fit"))
