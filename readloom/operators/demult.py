"""Assignment of reads to barcodes with mismatches and shifts: an equi-join instead of a scan of patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import revcomp


def neighbors(barcodes: DataFrame, mismatches: int, alphabet: str = "ACGT") -> DataFrame:
    """name, seq -> name, seq of all sequences within so many substitutions, the barcode itself included."""
    out = barcodes.select("name", "seq")
    letters = F.array(*map(F.lit, alphabet))
    for _ in range(mismatches):
        changed = out.select("name", "seq", F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("i")).select("name", F.explode(F.transform(letters, lambda c: F.concat(F.substring(F.col("seq"), F.lit(1), F.col("i") - 1), c, F.substring(F.col("seq"), F.col("i") + 1, F.length("seq"))))).alias("seq"))
        out = out.union(changed).distinct()
    return out


def offsets(position: Column, tolerance: int) -> Column:
    """All starts that a barcode may have."""
    return F.sequence(F.greatest(position - tolerance, F.lit(1)), position + tolerance)


def assign(reads: DataFrame, barcodes: DataFrame, mismatches: int, tolerance: int) -> DataFrame:
    """read, name of the reads that match exactly one barcode.

    ``reads`` (read, seq[, seq2]); ``barcodes`` (name, seq, pos): the barcode's start in the first mate, or in
    the reverse complement of the second. Substrings at the allowed starts meet the barcodes' neighbours, so
    cost is linear in the reads; barcodes of the same length and place share their substrings.
    """
    near = neighbors(barcodes, mismatches).join(barcodes.select("name", "pos", F.length("seq").alias("len")), "name")
    places = barcodes.select("pos", F.length("seq").alias("len")).distinct()
    seqs = [F.col("seq")] + ([revcomp(F.col("seq2"))] if "seq2" in reads.columns else [])
    cut = reads.select("read", F.explode(F.array(*seqs)).alias("s")).where("s is not null").join(F.broadcast(places)).select("read", "pos", "len", "s", F.explode(offsets(F.col("pos"), tolerance)).alias("at"))
    cut = cut.select("read", "pos", "len", F.substring("s", F.col("at"), F.col("len")).alias("seq")).where(F.length("seq") == F.col("len"))
    return cut.join(near, ["pos", "len", "seq"]).groupBy("read").agg(F.count_distinct("name").alias("n"), F.min("name").alias("name")).where("n = 1").select("read", "name")
