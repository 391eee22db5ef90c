"""Reads, profiles, structures and sequences derived from the given tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.tables import by_key, dealt

LENGTH = 120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_at(pos):
    return F.substring(F.lit("ACGT"), pos % 4 + 1, F.lit(1))


def positions(spark: SparkSession) -> DataFrame:
    return spark.range(1, LENGTH + 1).select(F.col("id").cast("int").alias("pos")).withColumn("base", base_at(F.col("pos")))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    return by_key(coded(lineitem), lineitem, "read")


def coded(lineitem: DataFrame) -> DataFrame:
    """read, pos, base, c: one code a line item."""
    r, o = F.col("l_returnflag"), F.col("l_linestatus")
    code = F.when((r == "R") & (o == "O"), 16).when(r == "R", 32).when((r == "N") & (o == "O"), 64).when(r == "N", 128).when(o == "F", 2).otherwise(8)
    out = lineitem.select(F.col("l_orderkey").alias("read"), (F.col("l_partkey") % LENGTH + 1).cast("int").alias("pos"), code.alias("c"))
    own = F.when(F.col("base") == "A", 16).when(F.col("base") == "C", 32).when(F.col("base") == "G", 64).otherwise(128)
    return out.withColumn("base", base_at(F.col("pos"))).withColumn("c", F.when(F.col("c") == own, 1).otherwise(F.col("c")))


def muts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_codes(raw(spark, sf_dir), "read").where("rel <> 1")


def merged_codes(raw: DataFrame, *key: str) -> DataFrame:
    """key, pos, base, rel: the codes of each position of a read as one. The base follows from the position; as a key it leaves numbers
    alone to be summed, which is done by hashing, while the least of strings is found by sorting all rows."""
    return raw.groupBy(*key, "pos", "base").agg(F.bit_or("c").cast("int").alias("rel"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment a read."""
    return raw(spark, sf_dir).groupBy("read").agg(F.min("pos").alias("end5"), F.max("pos").alias("end3")).select("read", F.lit(0).alias("seg"), "end5", "end3")


def two_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segments a read: line items of odd and of even number."""
    out = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read"), (F.col("l_linenumber") % 2).alias("seg"), (F.col("l_partkey") % LENGTH + 1).cast("int").alias("pos"))
    return out.groupBy("read", "seg").agg(F.min("pos").alias("end5"), F.max("pos").alias("end3"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, pos, base, mu of every embedding."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding")).select("vec_id", "label", (F.col("pos") + 1).alias("pos"), base_at(F.col("pos") + 1).alias("base"), F.least(F.lit(1.0), F.abs(F.col("col").cast("double"))).alias("mu"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref, seq from the documents: A, C, G and T of either case, all else N."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.regexp_replace(F.translate("text", "acgt", "ACGT"), "[^ACGT]", "N").alias("seq"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base pairs by customer: nested by halving, from the account's balance; struct, pos, partner."""
    n = F.pmod(F.floor(F.abs(F.col("c_acctbal"))), F.lit(17)).cast("int") + 3
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("struct"), F.explode(F.sequence(F.lit(1), n)).alias("i"), F.col("c_nationkey").cast("int").alias("s"))
    end5, end3 = F.col("i") + F.pmod(F.col("i") * F.col("s"), F.lit(2)) * 30, 100 - F.col("i") - F.pmod(F.col("i") * F.col("s"), F.lit(2)) * 30
    both = at.select("struct", end5.alias("a"), end3.alias("b")).where("a < b")
    return both.select("struct", F.explode(F.array(F.struct(F.col("a").alias("pos"), F.col("b").alias("partner")), F.struct(F.col("b").alias("pos"), F.col("a").alias("partner")))).alias("p")).select("struct", "p.*")


def planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sample, read, pos reads of one segment over all positions, with two kinds of molecules: one has most of its mutations
    where pos % 4 = 0, the other where pos % 4 = 2. In sample 0 the positions up to 80 follow one kind and the others another
    one that is independent of it; in sample 1 those up to 40, those up to 80 and the rest all go independently."""
    draw = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 6), 16, 10).cast("int") % 1000
    kind = lambda salt: (draw(F.col("o_orderkey").cast("string"), F.lit(salt)) < 350).cast("int")
    own = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 2).cast("int").alias("sample"), F.col("o_orderkey").alias("read"), kind("a").alias("a"), kind("b").alias("b"), kind("c").alias("c"))
    own = dealt(own, "sample", "read")  # the given table is one block of a file, and each row is drawn for at every position
    at = own.select("*", F.explode(F.sequence(F.lit(1), F.lit(LENGTH))).alias("pos"))
    side = F.when(F.col("pos") <= 40, F.col("a")).when(F.col("pos") <= 80, F.when(F.col("sample") == 0, F.col("a")).otherwise(F.col("b"))).otherwise(F.col("c"))
    hit = draw(F.col("read").cast("string"), F.col("pos").cast("string")) < F.when(F.col("pos") % 4 == 2 * side, 300).otherwise(20)
    muts = at.where(hit).select("sample", "read", "pos", base_at(F.col("pos")).alias("base"), F.lit(2).alias("rel"))
    segs = own.select("sample", "read", F.lit(0).alias("seg"), F.lit(1).alias("end5"), F.lit(LENGTH).alias("end3"))
    return segs, muts, positions(spark).withColumn("sample", F.explode(F.array(F.lit(0), F.lit(1))))


#: The same read model for DuckDB.
SQL_PLANTED = """own as (select cast(o_custkey % 2 as int) as sample, o_orderkey as read, cast(('0x' || substr(md5(o_orderkey || ':a'), 1, 6))::int % 1000 < 350 as int) as a,
  cast(('0x' || substr(md5(o_orderkey || ':b'), 1, 6))::int % 1000 < 350 as int) as b, cast(('0x' || substr(md5(o_orderkey || ':c'), 1, 6))::int % 1000 < 350 as int) as c from orders),
spots as (select own.*, cast(i as int) as pos, case when i <= 40 then a when i <= 80 then case sample when 0 then a else b end else c end as kind from own, range(1, 121) t(i)),
planted as (select *, cast(('0x' || substr(md5(read || ':' || pos), 1, 6))::int % 1000 < case when pos % 4 = 2 * kind then 300 else 20 end as int) as hit from spots)"""

SQL_RAW = """raw as (
  select l_orderkey as read, cast(l_partkey % 120 + 1 as int) as pos,
         case when l_returnflag = 'R' and l_linestatus = 'O' then 16 when l_returnflag = 'R' then 32
              when l_returnflag = 'N' and l_linestatus = 'O' then 64 when l_returnflag = 'N' then 128
              when l_linestatus = 'F' then 2 else 8 end as c from lineitem),
cod as (select read, pos, substr('ACGT', pos % 4 + 1, 1) as base,
         case when c = case substr('ACGT', pos % 4 + 1, 1) when 'A' then 16 when 'C' then 32 when 'G' then 64 else 128 end then 1 else c end as c from raw),
muts as (select read, pos, min(base) as base, cast(bit_or(c) as int) as rel from cod group by read, pos having bit_or(c) <> 1),
segs as (select read, min(pos) as end5, max(pos) as end3 from raw group by read),
positions as (select cast(i as int) as pos, substr('ACGT', cast(i as int) % 4 + 1, 1) as base from range(1, 121) t(i))"""

SQL_FIT = """fitted as (select *,
  case base when 'A' then 238 when 'C' then 222 when 'G' then 190 else 126 end as yes, 1 as nos from {source}),
"""

SQL_TWO = """two as (select l_orderkey as read, l_linenumber % 2 as seg, min(cast(l_partkey % 120 + 1 as int)) as end5, max(cast(l_partkey % 120 + 1 as int)) as end3 from lineitem group by 1, 2)"""

SQL_PROFILES = """profiles as (select vec_id, label, i as pos, substr('ACGT', i % 4 + 1, 1) as base, least(1.0, abs(cast(x as double))) as mu
  from (select vec_id, label, unnest(embedding) as x, cast(generate_subscripts(embedding, 1) as int) as i from embeddings))"""

SQL_PAIRS = """halves as (select c_custkey as struct, cast(c_nationkey as int) as s, unnest(range(1, cast(floor(abs(c_acctbal)) as bigint) % 17 + 4)) as i from customer),
opened as (select struct, cast(i + (i * s % 2) * 30 as int) as a, cast(100 - i - (i * s % 2) * 30 as int) as b from halves),
bp as (select struct, a as end5, b as end3 from opened where a < b),
pairs as (select struct, end5 as pos, end3 as partner from bp union all select struct, end3, end5 from bp)"""

SQL_SEQS = """seqs as (select doc_id as ref, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') as seq from documents)"""
