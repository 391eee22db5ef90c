"""Column expressions on sequences, qualities and alignment strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Degenerate base codes.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
#: CIGAR operations that use up the reference, the read, and those that are mutations.
REF_OPS, READ_OPS, MUT_OPS = "MDN=X", "MIS=X", "IDX"

#: Letters of a piece that k-mers are taken from, and of one whose letters become rows.
PIECE, ROWS_PIECE = 64, 4096
#: Stands for the letters that are looked for.
MARK = "\x01"


def revcomp(seq: Column) -> Column:
    """Reverse complement; N stays."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def transcribe(seq: Column) -> Column:
    return F.translate(seq, "T", "U")


def reverse_transcribe(seq: Column) -> Column:
    return F.translate(seq, "U", "T")


def picto(seq: Column) -> Column:
    """One symbol a base, for eyes."""
    return F.translate(seq, "ACGTN", "▲⌠▼⌡○")


def clean(seq: Column) -> Column:
    """White space dropped, upper case, U as T, other degenerate codes as N. Null if anything else is left."""
    out = F.regexp_replace(F.translate(F.upper(F.regexp_replace(seq, r"\s", "")), "U", "T"), "[RYSWKMBDHV]", "N")
    return F.when(out.rlike("^[ACGTN]*$"), out)


def kmers(seq: Column, k: int) -> Column:
    """Array of all k-mers in order; empty if the sequence is shorter. Substrings are counted off from a string's beginning, so
    they are taken from short pieces, each of which reaches k - 1 letters into the next."""
    pieces = F.filter(F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{1,{PIECE + k - 1}}})).{{1,{PIECE}}}"), F.lit(1)), lambda p: F.length(p) >= k)
    within = lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - (k - 1)), lambda i: F.substring(p, i, F.lit(k)))
    return F.coalesce(F.flatten(F.transform(pieces, within)), F.array().cast("array<string>"))


def positions(refs: DataFrame, first: int = 1) -> DataFrame:
    """ref, seq -> ref, pos, base."""
    return refs.select("ref", F.posexplode(F.split("seq", ""))).where("col <> ''").select("ref", (F.col("pos") + first).alias("pos"), F.col("col").alias("base"))


def runs(refs: DataFrame, base: str, least: int, first: int = 1) -> DataFrame:
    """ref, seq -> ref, pos, base of the letters in runs of ``least`` or more of a base, as reads.mask_poly() finds them by position. Runs
    are marked in the sequence itself: a letter that ``least`` - 1 more follow, or right after a marked one. So nothing is
    shuffled or sorted, and only pieces with a mark become rows."""
    letter = re.escape(base)
    marked = F.regexp_replace("seq", f"{letter}(?={letter}{{{max(least, 1) - 1}}})|(?!^)\\G{letter}", MARK)
    pieces = refs.where(F.contains("seq", F.lit(base * max(least, 1)))).select("ref", F.posexplode(F.regexp_extract_all(marked, F.lit(f"(?s).{{1,{ROWS_PIECE}}}"), F.lit(0))).alias("_i", "_piece"))
    letters = pieces.where(F.contains("_piece", F.lit(MARK))).select("ref", "_i", F.posexplode(F.split("_piece", "")).alias("_j", "_letter")).where(F.col("_letter") == MARK)
    return letters.select("ref", (F.col("_i") * ROWS_PIECE + F.col("_j") + first).alias("pos"), F.lit(base).alias("base"))


def sequence_of(index: DataFrame) -> DataFrame:
    """ref, pos, base -> ref, seq; null where positions have gaps or repeats."""
    gathered = index.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("p"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.count_distinct("pos").alias("n"))
    whole = (F.col("high") - F.col("low") + 1 == F.col("n")) & (F.size("p") == F.col("n"))
    return gathered.select("ref", F.when(whole, F.array_join(F.transform("p", lambda x: x["base"]), "")).alias("seq"))


def locate(seq: Column, primer: Column) -> Column:
    """1-based start of the only exact match; null if there is none or more than one (overlaps count)."""
    first = F.locate_in(seq, primer) if hasattr(F, "locate_in") else F.instr(seq, primer)
    again = F.instr(F.substring(seq, first + 1, F.length(seq)), primer)
    return F.when((first > 0) & (again == 0), first)


def degenerate(seq: Column) -> Column:
    """Array of all definite sequences a degenerate one stands for, in alphabetical order of choices."""
    table = F.create_map(*[x for k, v in IUPAC.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.aggregate(letters, F.array(F.lit("")), lambda acc, c: F.flatten(F.transform(acc, lambda s: F.transform(F.element_at(table, c), lambda b: F.concat(s, b)))))


def slice_padded(seq: Column, start: int, stop: int, pad: str) -> Column:
    """Python-like slice; places outside are filled with ``pad``."""
    left = "" if start >= 0 else pad * min(-start, stop - start)
    body = F.substring(seq, F.lit(max(start, 0) + 1), F.lit(max(stop - max(start, 0), 0)))
    return F.rpad(F.concat(F.lit(left), body), stop - start, pad)


def phred_encode(quality: Column) -> Column:
    return F.char(quality + 33)


def phred_decode(letter: Column) -> Column:
    return F.ascii(letter) - 33


def wrap(seq: Column, width: int) -> Column:
    """Lines of ``width`` for FASTA."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n") if width else seq


def cigar(reads: DataFrame, column: str = "cigar") -> DataFrame:
    """One row an operation: i (from 0), op, n, and the first position in read and reference that it
    has (``read_at``, ``ref_at``, from 1)."""
    ops = F.regexp_extract_all(F.col(column), F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    opened = reads.select("*", F.posexplode(ops).alias("i", "_op"))
    opened = opened.select("*", F.substring("_op", -1, 1).alias("op"), F.expr("cast(substring(_op, 1, length(_op) - 1) as int)").alias("n")).drop("_op")
    from pyspark.sql import Window

    w = Window.partitionBy("name").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    took = lambda kinds: F.coalesce(F.sum(F.when(F.col("op").isin(*kinds), F.col("n")).otherwise(0)).over(w), F.lit(0))
    return opened.withColumn("read_at", took(READ_OPS) + 1).withColumn("ref_at", took(REF_OPS) + F.col("pos"))


def cigar_total(column: Column, kinds: str) -> Column:
    """Sum of the lengths of these operations."""
    ops = F.regexp_extract_all(column, F.lit(rf"(\d+)[{kinds}]"), F.lit(1))
    return F.aggregate(ops, F.lit(0), lambda acc, n: acc + n.cast("int"))
