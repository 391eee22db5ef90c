"""Relationship codes of a read's base to the reference, and patterns of them.

A code is a byte of bits: several set bits are an ambiguous relationship; 255 is "not covered".
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The bits.
MATCH, DELETION, INSERT_5, INSERT_3, SUB_A, SUB_C, SUB_G, SUB_T, NO_COVERAGE = 1, 2, 4, 8, 16, 32, 64, 128, 255
SUBS = {"A": SUB_A, "C": SUB_C, "G": SUB_G, "T": SUB_T}
INSERTION = INSERT_5 | INSERT_3
BASES = "ACGTN"
ANY_N = SUB_A | SUB_C | SUB_G | SUB_T | MATCH


def parse(code: str) -> tuple[str, int]:
    """'ag' or 'A -> G' (d: deletion, i: insertion) -> reference base and bits."""
    m = re.fullmatch(r"([acgtn])(?: -> )?([acgtdi])", code.lower())
    if not m:
        raise ValueError(f"no such code: {code!r}")
    base, read = m[1].upper(), m[2].upper()
    bits = DELETION if read == "D" else INSERTION if read == "I" else MATCH if read == base else SUBS[read]
    return base, bits


def half(codes: list[str]) -> dict[str, int]:
    """Bits by reference base."""
    out = dict.fromkeys(BASES, 0)
    for base, bits in map(parse, codes):
        out[base] |= bits
    return out


def counted(ref: bool = False, sub: bool = False, deletion: bool = False, insertion: bool = False, count: tuple[str, ...] = (), no_count: tuple[str, ...] = ()) -> dict[str, int]:
    """Half a pattern from the kinds of relationships that count."""
    every = {b + r for b in "ACGT" for r in "ACGT" if (ref and b == r) or (sub and b != r)}
    every |= {b + "D" for b in BASES if deletion} | {b + "I" for b in BASES if insertion}
    chosen = {parse(c) for c in count}
    dropped = {parse(c) for c in no_count}
    if chosen & dropped:
        raise ValueError(f"counted and not counted: {chosen & dropped}")
    out = dict.fromkeys(BASES, 0)
    for base, bits in (({parse(c) for c in every} | chosen) - dropped):
        out[base] |= bits
    return out


def pattern(deletion: bool = True, insertion: bool = True, no_count: tuple[str, ...] = (), only_count: tuple[str, ...] = ()) -> tuple[dict, dict]:
    """(yes, nos) of the mutations that count."""
    nos = counted(ref=True, no_count=no_count)
    if only_count:
        return counted(count=only_count, no_count=no_count), nos
    return counted(sub=True, deletion=deletion, insertion=insertion, no_count=no_count), nos


def intersect(a: tuple[dict, dict], b: tuple[dict, dict]) -> tuple[dict, dict]:
    return tuple({k: x[k] & y[k] for k in BASES} for x, y in zip(a, b, strict=True))


def invert(a: tuple[dict, dict]) -> tuple[dict, dict]:
    return a[1], a[0]


def named(sub: tuple[dict, dict] | None = None) -> dict[str, tuple[dict, dict]]:
    """The patterns of the table's relationships. A sub-pattern narrows them (inverted for matches)."""
    refs, none = counted(ref=True), dict.fromkeys(BASES, 0)
    muts = counted(sub=True, deletion=True, insertion=True)
    out = {
        "Covered": (counted(ref=True, sub=True, deletion=True, insertion=True), none),
        "Matched": (refs, muts),
        "Mutated": (muts, refs),
        "Subbed": (counted(sub=True), refs),
        **{f"Subbed-{b}": (half([r + b for r in "ACGT" if r != b]), refs) for b in "ACGT"},
        "Deleted": (counted(deletion=True), refs),
        "Inserted": (counted(insertion=True), refs),
    }
    if sub is not None:
        out = {k: v if k == "Covered" else intersect(v, invert(sub) if k == "Matched" else sub) for k, v in out.items()}
    return out


def table(spark: SparkSession, patterns: dict[str, tuple[dict, dict]]) -> DataFrame:
    """rel_name, base, yes, nos: five rows a pattern."""
    return spark.createDataFrame([(name, b, yes[b], nos[b]) for name, (yes, nos) in patterns.items() for b in BASES], "rel_name string, base string, yes int, nos int")


def fits(rel: Column, mask: Column) -> Column:
    return rel.bitwiseOR(mask) == mask


def mask_of(base: Column, by_base: dict[str, int]) -> Column:
    out = F.lit(0)
    for b, bits in by_base.items():
        out = F.when(base == b, bits).otherwise(out)
    return out


def informative(base: Column, rel: Column, pat: tuple[dict, dict]) -> tuple[Column, Column]:
    """Whether a code decides the pattern, and whether it then is positive."""
    yes, nos = fits(rel, mask_of(base, pat[0])), fits(rel, mask_of(base, pat[1]))
    return yes != nos, yes & ~nos


def encode(ref_base: Column, read_base: Column, quality: Column, least: int) -> Column:
    """Code of an aligned base: all but the reference's own substitution if the read's base is unsure."""
    own = mask_of(ref_base, SUBS)
    unsure = F.lit(ANY_N).bitwiseXOR(own)
    return F.when(~ref_base.isin(*SUBS), ANY_N).when((quality < least) | ~read_base.isin(*SUBS), unsure).when(ref_base == read_base, MATCH).otherwise(mask_of(read_base, SUBS))
