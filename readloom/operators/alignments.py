"""From alignments (SAM rows) to segments and mutations of reads.

Reads without indels are expressions over their CIGAR operations; with indels a read's operations depend on one
another, so a small function walks one read, and Spark deals out the reads. A read that cannot be used is not an error
of the job: it keeps its reason in the column ``error``, and all others go on.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.sequences import REF_OPS, cigar

_OPS = re.compile(r"(\d+)([MIDNSHP=X])")
SEGS, MUTS = "array<struct<end5:int,end3:int>>", "array<struct<pos:int,rel:int>>"


def _encode(ref: str, read: str, qual: str, least: str) -> int:
    own = codes.SUBS.get(ref, 0)
    if not own:
        return codes.ANY_N
    if qual < least or read not in codes.SUBS:
        return codes.ANY_N ^ own
    return codes.MATCH if read == ref else codes.SUBS[read]


class _Pairing:
    """A read against the reference as columns: (reference position, read index), either of them None in an indel."""

    def __init__(self, seq: str, qual: str, ref: str, least: str, insert3: bool):
        self.seq, self.qual, self.ref, self.least, self.insert3 = seq, qual, ref, least, insert3
        self.columns: list[tuple[int | None, int | None]] = []
        self.rels: dict[int, int] = {}

    def kind(self, i: int) -> str:
        r, q = self.columns[i]
        return "I" if r is None else "D" if q is None else "M"

    def code(self, i: int) -> int:
        """What this pairing says of a reference position: an insertion lies on the base on one side of it."""
        r, q = self.columns[i]
        if q is None:
            return codes.DELETION
        out = _encode(self.ref[r - 1], self.seq[q], self.qual[q], self.least)
        beside = i - 1 if self.insert3 else i + 1
        if 0 <= beside < len(self.columns) and self.columns[beside][0] is None:
            out = (0 if out == codes.MATCH else out) | (codes.INSERT_3 if self.insert3 else codes.INSERT_5)
        return out

    def begin(self) -> None:
        """What the columns say at first: of matches nothing is noted, so only other places are looked at."""
        columns, ref, seq, qual, least, rels = self.columns, self.ref, self.seq, self.qual, self.least, self.rels
        for i, (r, q) in enumerate(columns):
            if r is None:
                flank = i + 1 if self.insert3 else i - 1
                if columns[flank][0] is not None:
                    rels[columns[flank][0]] = self.code(flank)
            elif q is None:
                rels[r] = codes.DELETION
            elif r not in rels and (ref[r - 1] != seq[q] or qual[q] < least or seq[q] == "N"):
                rels[r] = self.code(i)

    def mark(self, first: int, last: int) -> None:
        """Add what these columns say now to what they were said to be before."""
        for i in range(max(first, 0), min(last + 1, len(self.columns))):
            r = self.columns[i][0]
            if r is not None:
                self.rels[r] = self.rels.get(r, codes.MATCH) | self.code(i)

    def step(self, i: int, direction: int) -> int | None:
        """Move the indel in column i past the next aligned base, through others of its kind; the column it is in then, or
        None if it stays: at an end, beside an indel of the other kind, or where the read would fit otherwise."""
        kind, j = self.kind(i), i + direction
        while 0 <= j < len(self.columns) and self.kind(j) == kind:
            j += direction
        if not (0 < j < len(self.columns) - 1) or self.kind(j) != "M":
            return None
        beyond = j + direction
        while 0 <= beyond < len(self.columns) and self.kind(beyond) == kind:
            beyond += direction
        if 0 <= beyond < len(self.columns) and self.kind(beyond) not in ("M", kind):
            return None
        r, q = self.columns[j]
        if kind == "D":  # the base goes opposite the position that was deleted
            now, then = (self.ref[self.columns[i][0] - 1], q), (self.ref[r - 1], q)
        else:  # the base that was inserted goes opposite the position
            now, then = (self.ref[r - 1], self.columns[i][1]), (self.ref[r - 1], q)
        a, b = (_encode(x, self.seq[y], self.qual[y], self.least) for x, y in (now, then))
        subs = codes.ANY_N ^ codes.MATCH
        if not (a & b or (a & subs and b & subs)):
            return None
        low, high = min(i, j), max(i, j)
        part = self.columns[low : high + 1]
        if kind == "D":  # positions keep their order; the column of the base moves
            bases = [q if k == i else None for k in range(low, high + 1)]
            self.columns[low : high + 1] = [(c[0], b) for c, b in zip(part, bases, strict=True)]
        else:
            places = [r if k == i else None for k in range(low, high + 1)]
            self.columns[low : high + 1] = [(p, c[1]) for c, p in zip(part, places, strict=True)]
        self.mark(low - 1, high + 1)
        return j

    def pods(self) -> list[list[int]]:
        """Columns of the indels, those of one kind together that have none of the other kind between them."""
        out: list[list[int]] = []
        for i in range(len(self.columns)):
            if (kind := self.kind(i)) != "M":
                if out and self.kind(out[-1][-1]) == kind:
                    out[-1].append(i)
                else:
                    out.append([i])
        return out

    def slide(self) -> None:
        """Mark every place that each indel could have as well: all as far to the 5' side as they go, then one after
        the other all the way to the 3' side. Indels of one kind are alike, so one that has passed others is known by its
        rank among them."""
        pods = self.pods()
        for direction in (-1, 1):
            for pod in pods[::-direction]:
                k = len(pod) - 1
                while k >= 0:
                    at = self.step(pod[k], direction)
                    if at is None:
                        k -= 1
                        continue
                    pod[k] = at
                    pod.sort()
                    if direction > 0:
                        k = pod.index(at)


def walk(seq: str, qual: str, pos: int, cig: str, ref: str, min_phred: int, clip5: int = 0, clip3: int = 0, ambiguous: bool = True, insert3: bool = True) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Segments and codes other than 1 of one sound alignment. An insertion marks the base on its 3' side, or on its 5'
    side. With ``ambiguous``, a position gets the codes of all alignments that only place indels differently."""
    segments, rels, r, q, start = [], {}, pos, 0, pos
    least = chr(33 + min_phred)
    pairing = _Pairing(seq, qual, ref, least, insert3)

    def done() -> None:
        segments.append((start, r - 1))
        pairing.begin()
        if ambiguous and any(None in c for c in pairing.columns):
            pairing.slide()
        pairing.columns.clear()

    for n, op in ((int(n), op) for n, op in _OPS.findall(cig)):
        if op in "M=X":
            pairing.columns += [(r + i, q + i) for i in range(n)]
            r, q = r + n, q + n
        elif op == "D":
            pairing.columns += [(r + i, None) for i in range(n)]
            r += n
        elif op == "I":
            pairing.columns += [(None, q + i) for i in range(n)]
            q += n
        elif op == "N":
            done()
            r += n
            start = r
        elif op == "S":
            q += n
    done()
    rels = {p: c for p, c in pairing.rels.items() if c != codes.MATCH}
    first, last = segments[0][0] + clip5, segments[-1][1] - clip3
    cut = [(max(a, first), min(b, last)) for a, b in segments]
    return [(a, b) for a, b in cut if a <= b], {p: c for p, c in rels.items() if first <= p <= last}


#: Walks that a Python worker remembers.
WALKS = 1 << 17
WALKED = f"struct<segs:{SEGS},muts:{MUTS}>"


@functools.lru_cache(WALKS)
def _span(cig: str) -> int:
    return sum(int(n) for n, op in _OPS.findall(cig) if op in REF_OPS)


@functools.lru_cache(WALKS)
def _walked(seq: str, cig: str, ref: str, clip5: int, clip3: int, ambiguous: bool, insert3: bool) -> tuple[tuple, tuple, tuple, tuple]:
    """walk() of a read whose unsure bases are N along that part of the reference it lies on, as columns: first and last positions of
    segments, positions and codes, from 1. Reads of an amplicon differ in few places, and those that are alike are walked once."""
    segs, rels = walk(seq, "I" * len(seq), 1, cig, ref, 0, clip5, clip3, ambiguous, insert3)
    first, last = zip(*segs) if segs else ((), ())
    places, said = zip(*sorted(rels.items())) if rels else ((), ())
    return first, last, places, said


def _walker(min_phred: int, *options):
    """walk() as an expression of seq, qual, pos, cigar and refseq; null where seq is null. A base of low quality says what N says."""
    least = chr(33 + min_phred)

    def sure(seq: str, qual: str) -> str:
        return seq if min(qual) >= least else "".join(b if q >= least else "N" for b, q in zip(seq, qual, strict=True))

    def lists(kept: list[tuple[int, tuple]], a: int, b: int, names: tuple[str, str]) -> pa.Array:
        offsets = [0]
        for _, x in kept:
            offsets.append(offsets[-1] + len(x[a]))
        placed = lambda c: [v + before for before, x in kept for v in x[c]]
        fields = [pa.array(placed(a), pa.int32()), pa.array(placed(b) if b != 3 else [v for _, x in kept for v in x[3]], pa.int32())]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, list(names)))

    def run(seq: pa.Array, qual: pa.Array, pos: pa.Array, cig: pa.Array, ref: pa.Array) -> pa.Array:
        none = ((), (), (), ())
        found = [(0, none) if s is None else (p - 1, _walked(sure(s, q), c, r[p - 1 : p - 1 + _span(c)], *options)) for s, q, p, c, r in zip(*(x.to_pylist() for x in (seq, qual, pos, cig, ref)), strict=True)]
        return pa.StructArray.from_arrays([lists(found, 0, 1, ("end5", "end3")), lists(found, 2, 3, ("pos", "rel"))], ["segs", "muts"])

    return F.arrow_udf(run, WALKED)


def _total(ops: str) -> Column:
    return F.aggregate(F.regexp_extract_all("cigar", F.lit(rf"(\d+)[{ops}]"), F.lit(1)), F.lit(0), lambda acc, n: acc + n.cast("int"))


def problem() -> Column:
    """Why an alignment (columns of a SAM row, and ``refseq``) cannot be used; null if it can."""
    c = F.col("cigar")
    solid = F.regexp_replace(c, r"\d+[HP]", "")
    inner = F.regexp_replace(F.regexp_replace(solid, r"^\d+S", ""), r"\d+S$", "")
    return (
        F.when(F.col("refseq").isNull(), "no such reference")
        .when(c.isNull() | ~c.rlike(r"^(\d+[MIDNSHP=X])+$"), "the CIGAR string is invalid")
        .when(c.rlike(r"(^|\D)0+[MIDNSHP=X]"), "a CIGAR operation has no length")
        .when(c.rlike(r"([MIDNSHP=X])\d+\1"), "a CIGAR operation comes twice in a row")
        .when(c.rlike(r"D\d+[IN]|[IN]\d+D"), "an indel or intron lies beside a deletion")
        .when(inner.contains("S"), "a soft clip lies in the middle")
        .when(~inner.rlike(r"^\d+[M=X]"), "the first operation is no aligned base")
        .when(~inner.rlike(r"\d+[M=X]$"), "the last operation is no aligned base")
        .when(_total("MIS=X") != F.length("seq"), "the CIGAR string and the read differ in length")
        .when(F.length("seq") != F.length("qual"), "the read and its qualities differ in length")
        .when((F.col("pos") < 1) | (F.col("pos") + _total("MDN=X") - 1 > F.length("refseq")), "the alignment leaves the reference")
    )


def _plain(held: DataFrame, where: Column, min_phred: int, clip5: int, clip3: int) -> tuple[DataFrame, Column, Column]:
    """The alignments, and segs and muts of those of them ``where`` there is no indel, by expressions alone: nothing is
    shuffled, and no Python runs."""
    ops = F.regexp_extract_all("cigar", F.lit(r"\d+[MNS=X]"), F.lit(0))
    kind, n = lambda t: F.substring(t, -1, 1), lambda t: F.regexp_extract(t, r"\d+", 0).cast("int")
    block = "struct<ref:int,read:int,n:int>"
    walked = F.aggregate(
        ops,
        F.struct(F.col("pos").cast("int").alias("ref"), F.lit(1).alias("read"), F.array().cast(f"array<{block}>").alias("out")),
        lambda acc, t: F.struct(
            (acc["ref"] + F.when(kind(t) == "S", 0).otherwise(n(t))).alias("ref"),
            (acc["read"] + F.when(kind(t) == "N", 0).otherwise(n(t))).alias("read"),
            F.when(kind(t).isin("N", "S"), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(acc["ref"].alias("ref"), acc["read"].alias("read"), n(t).alias("n")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    low = "[" + "".join(re.escape(chr(c)) for c in range(33, 33 + min_phred)) + "]"
    row = held.withColumn("_blocks", F.when(where, walked))

    def mutated(b: Column) -> Column:
        refs, bases, quals = (F.substring(F.col(c), b[k], b["n"]) for c, k in (("refseq", "ref"), ("seq", "read"), ("qual", "read")))
        even = (refs == bases) & ~refs.contains("N")
        even = even & ~quals.rlike(low) if min_phred > 0 else even
        each = F.arrays_zip(F.sequence(F.lit(0), b["n"] - 1).alias("i"), F.split(refs, "").alias("r"), F.split(bases, "").alias("b"), F.split(quals, "").alias("q"))
        phred = lambda x: F.ascii(x["q"]) - 33
        other = F.filter(each, lambda x: (x["r"] != x["b"]) | ~x["r"].isin(*codes.SUBS) | (phred(x) < min_phred))  # all else are matches, and most are
        said = F.transform(other, lambda x: F.struct((b["ref"] + x["i"]).cast("int").alias("pos"), codes.encode(x["r"], x["b"], phred(x), min_phred).cast("int").alias("rel")))
        return F.when(even, F.array().cast(MUTS)).otherwise(said)

    # neighbouring blocks (runs of =, X and M) are one segment; introns part them
    def join(acc: Column, b: Column) -> Column:
        one = F.struct(b["ref"].alias("end5"), (b["ref"] + b["n"] - 1).alias("end3"))
        last = F.get(acc, F.size(acc) - 1)
        grown = F.struct(last["end5"].alias("end5"), one["end3"].alias("end3"))
        return F.when((F.size(acc) > 0) & (last["end3"] + 1 == one["end5"]), F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), grown)).otherwise(F.array_append(acc, one))

    segs = F.aggregate("_blocks", F.array().cast(SEGS), join)
    muts = F.flatten(F.transform("_blocks", mutated))
    row = row.withColumn("_segs", segs).withColumn("_muts", muts)
    first, last = F.get("_segs", F.lit(0))["end5"] + clip5, F.get("_segs", F.size("_segs") - 1)["end3"] - clip3
    cut = F.filter(F.transform("_segs", lambda s: F.struct(F.greatest(s["end5"], first).alias("end5"), F.least(s["end3"], last).alias("end3"))), lambda s: s["end5"] <= s["end3"])
    return row, cut.cast(SEGS), F.filter("_muts", lambda m: m["pos"].between(first, last)).cast(MUTS)


def identify(sam: DataFrame, refs: DataFrame, min_mapq: int = 25, min_phred: int = 25, clip5: int = 0, clip3: int = 0, ambiguous: bool = True, insert3: bool = True) -> DataFrame:
    """name, ref, flag, segs (array of end5, end3), muts (array of pos, rel), error of every alignment that is mapped well
    enough. Those with an error have neither segments nor mutations. The references, one row each, meet the alignments
    by name. All is one pass, and what of it is not asked for is not done."""
    mapped = sam.where((F.col("mapq") >= min_mapq) & (F.col("flag").bitwiseAND(F.lit(4)) == 0)).select(F.col("name").cast("string").alias("name"), "ref", "flag", "pos", "cigar", "seq", "qual")
    held = mapped.join(refs.select("ref", F.col("seq").alias("refseq")), "ref", "left").withColumn("error", problem())
    sound, indel = F.col("error").isNull(), F.col("cigar").rlike("[ID]")
    row, segs, muts = _plain(held, sound & ~indel, min_phred, clip5, clip3)
    walker = _walker(min_phred, clip5, clip3, ambiguous, insert3)
    row = row.withColumn("_walked", walker(*[F.when(sound & indel, F.col(c)) for c in ("seq", "qual", "pos", "cigar", "refseq")]))
    walked = sound & indel
    return row.select("name", "ref", "flag", *[F.when(~sound, F.array().cast(t)).when(walked, F.col(f"_walked.{c}")).otherwise(x).alias(c) for c, t, x in (("segs", SEGS, segs), ("muts", MUTS, muts))], "error")


def pair(identified: DataFrame, overhangs: bool = True) -> DataFrame:
    """One row a read: read, ref, segs, muts, error. Mates marked as a proper pair are one read, their codes met by AND:
    where a mate says nothing it is a match if one of its segments covers the position, else not covered. Improper mates and
    single reads are reads of their own. Of a proper pair whose mates do not fit together both go. Without ``overhangs``
    the forward mate ends where the reverse one does, and the reverse one begins where the forward one does."""
    bit = lambda b: F.col("flag").bitwiseAND(F.lit(b)) != 0
    proper = bit(1) & bit(2)
    mate = F.when(bit(1) & bit(128), 2).otherwise(1)
    read = F.concat_ws("/", F.col("ref").cast("string"), "name", F.when(bit(1) & ~bit(2), mate.cast("string")))
    # a read's flags, and apart from them its content: where reasons alone are asked for, no content is made or moved
    flags = F.struct(mate.alias("mate"), bit(64).alias("first"), bit(128).alias("second"), bit(16).alias("reverse"), F.col("error").isNull().alias("sound"), "error")
    each = identified.select(read.alias("read"), "ref", proper.alias("proper"), flags.alias("x"), F.struct(mate.alias("mate"), "segs", "muts").alias("c"))
    grouped = each.groupBy("read", "ref", "proper").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.array_sort(F.collect_list("c")).alias("cs"))
    a, b, n = F.col("xs")[0], F.col("xs")[F.size("xs") - 1], F.size("xs")
    reason = (
        F.when(F.coalesce(a["error"], b["error"]).isNotNull(), F.coalesce(a["error"], b["error"]))
        .when(F.col("proper") & (n != 2), "a mate of a proper pair is missing or comes again")
        .when(~F.col("proper") & (n > 1), "a read comes again")
        .when(F.col("proper") & ~(a["first"] & ~a["second"] & b["second"] & ~b["first"]), "the mates are not a first and a second one")
        .when(F.col("proper") & (a["reverse"] == b["reverse"]), "the mates have the same direction")
    )
    one, two, turned = F.col("cs")[0], F.col("cs")[F.size("cs") - 1], a["reverse"] & F.col("proper")
    out = grouped.select("read", "ref", "proper", reason.alias("error"), F.when(turned, two).otherwise(one).alias("f"), F.when(turned, one).otherwise(two).alias("r"))
    f_segs, r_segs = F.col("f.segs"), F.col("r.segs")
    if not overhangs:
        end3, end5 = F.array_max(F.transform(r_segs, lambda s: s["end3"])), F.array_min(F.transform(f_segs, lambda s: s["end5"]))
        whole = lambda s: s["end5"] <= s["end3"]
        f_segs, r_segs = (
            F.filter(F.transform(f_segs, lambda s: F.struct(s["end5"].alias("end5"), F.least(s["end3"], end3).alias("end3"))), whole),
            F.filter(F.transform(r_segs, lambda s: F.struct(F.greatest(s["end5"], end5).alias("end5"), s["end3"].alias("end3"))), whole),
        )
    out = out.select("read", "ref", "proper", "error", f_segs.alias("fs"), r_segs.alias("rs"), F.col("f.muts").alias("fm"), F.col("r.muts").alias("rm"))

    def inside(segs: str, p: Column) -> Column:
        return F.exists(segs, lambda s: p.between(s["end5"], s["end3"]))

    def said(segs: str, muts: str, p: Column) -> Column:
        own = F.get(F.filter(muts, lambda m: m["pos"] == p), F.lit(0))["rel"]
        return F.when(inside(segs, p), F.coalesce(own, F.lit(codes.MATCH))).otherwise(codes.NO_COVERAGE)

    def held(segs: str, muts: str) -> Column:
        return F.filter(F.transform(muts, lambda m: m["pos"]), lambda p: inside(segs, p))

    places = F.array_sort(F.array_union(held("fs", "fm"), held("rs", "rm")))
    met = F.filter(F.transform(places, lambda p: F.struct(p.alias("pos"), said("fs", "fm", p).bitwiseAND(said("rs", "rm", p)).alias("rel"))), lambda m: m["rel"] != codes.MATCH)
    none = F.col("error").isNotNull()
    return out.select(
        "read",
        "ref",
        F.when(none, F.array().cast(SEGS)).when(F.col("proper"), F.concat("fs", "rs")).otherwise(F.col("fs")).cast(SEGS).alias("segs"),
        F.when(none, F.array().cast(MUTS)).when(F.col("proper"), met).otherwise(F.col("fm")).cast(MUTS).alias("muts"),
        "error",
    )


def tables(paired: DataFrame, refs: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """segments (read, ref, seg, end5, end3) and muts (read, ref, pos, base, rel) of the reads without an error. With a
    ``path`` the reads are written there first and both tables read them from it, so alignments are walked once."""
    if path is not None:
        paired.write.mode("overwrite").parquet(path)
        paired = paired.sparkSession.read.schema(paired.schema).parquet(path)
    sound = paired.where("error is null")
    segments = sound.select("read", "ref", F.posexplode("segs").alias("seg", "s")).select("read", "ref", "seg", "s.*")
    muts = sound.select("read", "ref", F.explode("muts").alias("m")).select("read", "ref", "m.*")
    bases = refs.select("ref", F.posexplode(F.split("seq", ""))).select("ref", (F.col("pos") + 1).alias("pos"), F.col("col").alias("base"))
    return segments, muts.join(bases, ["ref", "pos"]).select("read", "ref", "pos", "base", "rel")


def rejected(paired: DataFrame) -> DataFrame:
    """error, n: why reads were left out, and how many."""
    return paired.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def numbered(rows: DataFrame, by: list[str], order: list[str], path: str) -> DataFrame:
    """The rows (distinct in ``by`` and ``order``) with ``number``, from 0 on in each group of ``by`` in the given order, however
    large a group is: rows are dealt by ranges and numbered where they are, and each range begins where those of its group
    before it end. What is summed up over ranges has a row for each range and each group. Ranges are written to ``path``, so
    both passes see the same ones."""
    ranged = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_id", F.monotonically_increasing_id())
    ranged.write.mode("overwrite").parquet(path)
    held = rows.sparkSession.read.schema(ranged.schema).parquet(path)
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    held = held.withColumn("_part", part).withColumn("_at", at).drop("_id")
    counts = held.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", *by, (before - F.col("_first")).alias("_shift"))
    return held.join(starts, ["_part", *by]).withColumn("number", F.col("_shift") + F.col("_at")).drop("_part", "_at", "_shift")


def batches(segments: DataFrame, path: str, size: int = 65_536) -> DataFrame:
    """ref, read, batch: reads numbered on by reference and then dealt to batches of a size, where outputs need them."""
    reads = segments.select("ref", "read").distinct()
    return numbered(reads, ["ref"], ["read"], path).select("ref", "read", F.floor(F.col("number") / size).cast("int").alias("batch"))


def aligned_bases(sam: DataFrame) -> DataFrame:
    """name, ref_pos, read_base, qual of every aligned base, by exploding the operations."""
    ops = cigar(sam).where(F.col("op").isin("M", "=", "X"))
    each = ops.select("name", "seq", "qual", "read_at", "ref_at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    at = F.col("read_at") + F.col("j")
    return each.select("name", (F.col("ref_at") + F.col("j")).alias("ref_pos"), F.substring("seq", at, F.lit(1)).alias("read_base"), (F.ascii(F.substring("qual", at, F.lit(1))) - 33).alias("qual"))


def report(paired: DataFrame) -> DataFrame:
    """One row: reads, those left out, segments and mutations."""
    ok = F.col("error").isNull()
    return paired.agg(F.count_if(ok).alias("reads"), F.count_if(~ok).alias("left_out"), F.sum(F.when(ok, F.size("segs")).otherwise(0)).alias("segments"), F.sum(F.when(ok, F.size("muts")).otherwise(0)).alias("mutations"))
