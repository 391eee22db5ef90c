"""Regions of references, strands, names, and barcodes by where they lie."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import locate, revcomp


def regions(refs: DataFrame, wanted: DataFrame, primer_gap: int = 0) -> DataFrame:
    """ref, reg, end5, end3 of regions given by their ends or by primers (fwd, rev; the reverse one as it is ordered, so
    its complement lies in the reference). What is not given is the reference's own end. Primers have to lie in the
    reference exactly once, and the ends within it in order: else it raises when it runs."""
    joined = wanted.join(refs.select("ref", "seq"), "ref")
    fwd, rev = locate(F.col("seq"), F.col("fwd")), locate(F.col("seq"), revcomp(F.col("rev")))
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.lit(" in region "), F.col("reg")))
    end5 = F.when(F.col("end5").isNotNull() & F.col("fwd").isNotNull(), fail("an end and a primer")).when(F.col("fwd").isNotNull(), F.coalesce(fwd + F.length("fwd") + primer_gap, fail("a primer lies not once"))).otherwise(F.coalesce("end5", F.lit(1)))
    end3 = F.when(F.col("end3").isNotNull() & F.col("rev").isNotNull(), fail("an end and a primer")).when(F.col("rev").isNotNull(), F.coalesce(rev - 1 - primer_gap, fail("a primer lies not once"))).otherwise(F.coalesce("end3", F.length("seq")))
    out = joined.select("ref", F.coalesce("reg", F.lit("full")).alias("reg"), end5.cast("int").alias("end5"), end3.cast("int").alias("end3"), F.length("seq").alias("_n"))
    sound = (F.col("end5") >= 1) & (F.col("end3") <= F.col("_n")) & (F.col("end5") <= F.col("end3") + 1)
    return out.withColumn("end5", F.when(sound, F.col("end5")).otherwise(fail("the ends are not in order"))).drop("_n")


def positions_of(refs: DataFrame, found: DataFrame) -> DataFrame:
    """ref, reg, pos, base of every position of regions."""
    part = F.split(F.substring(F.col("seq"), F.col("end5"), F.col("end3") - F.col("end5") + 1), "")
    each = found.join(refs.select("ref", "seq"), "ref").select("ref", "reg", "end5", F.posexplode(part).alias("i", "base"))
    return each.select("ref", "reg", (F.col("end5") + F.col("i")).alias("pos"), "base")


def renumber(positions: DataFrame, first: int = 1, by: Sequence[str] = ("ref", "reg")) -> DataFrame:
    """Positions counted on from ``first`` in each region."""
    low = positions.groupBy(*by).agg(F.min("pos").alias("_low"))
    return positions.join(low, list(by)).withColumn("pos", F.col("pos") - F.col("_low") + first).drop("_low")


def intersect_masked(regions: DataFrame, positions: DataFrame, key: Sequence[str], part: str) -> DataFrame:
    """key, pos, base that every part (sample, say) of a key has unmasked, and none has another base at: it raises when
    it runs if two parts disagree. ``positions``: key, part, pos, base."""
    n = regions.groupBy(*key).agg(F.count_distinct(part).alias("_parts"))
    held = positions.groupBy(*key, "pos").agg(F.count_distinct(part).alias("_n"), F.min("base").alias("base"), F.max("base").alias("_other"))
    base = F.when(F.col("base") == F.col("_other"), F.col("base")).otherwise(F.raise_error(F.lit("two bases at one position")))
    return held.join(n, list(key)).where("_n = _parts").select(*key, "pos", base.alias("base"))


def unite_masked(positions: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, pos, base that any part has unmasked; it raises when it runs if two parts disagree on a base."""
    held = positions.groupBy(*key, "pos").agg(F.min("base").alias("base"), F.max("base").alias("_other"))
    base = F.when(F.col("base") == F.col("_other"), F.col("base")).otherwise(F.raise_error(F.lit("two bases at one position")))
    return held.select(*key, "pos", base.alias("base"))


def both_strands(refs: DataFrame, suffix: str = "-rev") -> DataFrame:
    """References and their reverse complements, the latter under a name of their own."""
    return refs.select("ref", "seq").unionByName(refs.select(F.concat(F.col("ref").cast("string"), F.lit(suffix)).alias("ref"), revcomp(F.col("seq")).alias("seq")))


def split_strands(sam: DataFrame, refs: DataFrame, strand: Column, suffix: str = "-rev") -> DataFrame:
    """Alignments of the reverse strand as alignments to the reverse complement of their reference: renamed, their positions
    counted from its other end, CIGAR, bases and qualities turned round, and their direction with them."""
    n = refs.select("ref", F.length("seq").alias("_n"))
    turned = strand == "reverse"
    ops = F.regexp_extract_all("cigar", F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    span = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0), lambda acc, x: acc + x.cast("int"))
    new = {
        "ref": F.concat(F.col("ref").cast("string"), F.lit(suffix)),
        "flag": F.col("flag").bitwiseXOR(F.lit(16)),
        "pos": F.col("_n") - F.col("pos") - span + 2,
        "cigar": F.array_join(F.reverse(ops), ""),
        "seq": revcomp(F.col("seq")),
        "qual": F.reverse("qual"),
    }
    joined = sam.join(n, "ref")
    return joined.select(*[F.when(turned, new[c]).otherwise(F.col(c).cast("string") if c == "ref" else F.col(c)).alias(c) if c in new else F.col(c) for c in sam.columns])


def split_by_reference(sam: DataFrame, path: str) -> None:
    """Alignments in a folder of their own for each reference."""
    sam.write.mode("overwrite").partitionBy("ref").parquet(path)


def sort_alignments(sam: DataFrame) -> DataFrame:
    """By reference and position, over all partitions."""
    return sam.orderBy("ref", "pos", "name")


def cluster_name(k: Column, clust: Column) -> Column:
    """``average`` for what is not clustered, else ``cluster K-C``."""
    return F.when((k == 0) & (clust == 0), "average").otherwise(F.concat(F.lit("cluster "), k.cast("string"), F.lit("-"), clust.cast("string")))


def parse_energy(title: Column) -> tuple[Column, Column]:
    """Free energy in a structure's title (``ENERGY = -1.2  name`` or ``name (-1.20)``), null if there is none, and the
    name that is left."""
    energy = F.coalesce(*[F.nullif(F.regexp_extract(title, p, 1), F.lit("")) for p in (r"ENERGY\s*=\s*(-?[0-9.]+)", r"\(\s*(-?[0-9.]+)\s*\)\s*$")])
    return energy.cast("double"), F.trim(F.regexp_replace(F.regexp_replace(title, r"ENERGY\s*=\s*-?[0-9.]+", ""), r"\(\s*-?[0-9.]+\s*\)\s*$", ""))


def barcodes(refs: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, seq, pos, rc: barcodes as they are given, or cut out of a reference by their ends, in which case they are
    looked for where they lie; and their reverse complements, for second mates."""
    joined = wanted.join(refs.select("ref", F.col("seq").alias("_ref")), "ref", "left")
    seq = F.coalesce("seq", F.substring(F.col("_ref"), F.col("end5"), F.col("end3") - F.col("end5") + 1))
    out = joined.select("name", seq.alias("seq"), F.coalesce("pos", "end5").alias("pos"))
    return out.withColumn("rc", revcomp(F.col("seq")))


def pool(samples: dict[str, DataFrame]) -> DataFrame:
    """Rows of several samples as one: batches of later samples are numbered on, so (batch, read) still names a read."""
    out, first = None, F.lit(0).cast("long")
    for name, rows in samples.items():
        part = rows.withColumn("sample", F.lit(name))
        out = part if out is None else out.unionByName(part)
    order = {name: i for i, name in enumerate(samples)}
    number = F.create_map(*[F.lit(x) for item in order.items() for x in item])
    last = out.groupBy("sample").agg((F.max("batch") + 1).alias("_n")).withColumn("_order", number[F.col("sample")])
    from pyspark.sql import Window

    shift = last.select("sample", (F.sum("_n").over(Window.orderBy("_order")) - F.col("_n") + first).alias("_shift"))  # one row a sample
    return out.join(F.broadcast(shift), "sample").withColumn("batch", F.col("batch") + F.col("_shift")).drop("_shift")
