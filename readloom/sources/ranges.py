"""Python Data Sources for files whose records are no lines: partitions are byte ranges, whatever the records are.

A range that begins inside a record finds the next one by itself; the range that has a record's beginning reads on to its
end. Only where a record can be as long as a file (a chromosome, the reads of a transcript) is it cut where ranges
end, and put together again by what each range says of its last record.

Files are read through pyarrow's file systems (local, S3, GCS, HDFS), a block at a time.
"""

from __future__ import annotations

import fnmatch
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a partition and of a read; header lines of FASTA files are shorter than the latter.
SPLIT, BLOCK = 64 << 20, 1 << 20


def _system(path: str):
    from pyarrow import fs

    path = re.sub(r"^file:/*", "file:///", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class File:
    """Bytes of a file by offset."""

    def __init__(self, path: str, block: int):
        system, inner = _system(path)
        self.handle, self.block = system.open_input_file(inner), block
        self.size = self.handle.size()

    def at(self, offset: int, n: int | None = None) -> bytes:
        n = min(self.block if n is None else n, self.size - offset)
        return self.handle.read_at(n, offset) if n > 0 else b""

    def lines(self, start: int) -> Iterator[tuple[int, bytes]]:
        """Lines with their offsets, from the first one that begins at ``start`` or after it."""
        offset, held = start, b""
        if start:
            offset -= 1
            while (block := self.at(offset)) and (cut := block.find(b"\n")) < 0:
                offset += len(block)
            offset += cut + 1 if block else 0
        at = offset
        while block := self.at(at):
            at += len(block)
            *whole, held = (held + block).split(b"\n")
            for line in whole:
                yield offset, line
                offset += len(line) + 1
        if held:
            yield offset, held


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class RangeReader(DataSourceReader):
    """Plans ranges of all files at a path (a file, a folder or a pattern) and reads each with ``rows``."""

    def __init__(self, options: dict, rows):
        self.path, self.rows = options["path"], rows
        self.split, self.block = int(options.get("split", SPLIT)), int(options.get("block", BLOCK))

    def files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        system, inner = _system(self.path)
        prefix = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else "file://"
        if system.get_file_info(inner).type == fs.FileType.File:
            found = [system.get_file_info(inner)]
        else:
            folder, _, pattern = (inner.rstrip("/") + "/*").rpartition("/") if not re.search(r"[*?\[]", inner) else inner.rpartition("/")
            found = [x for x in system.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern) and x.base_name[0] not in "_."]
        if not found:
            raise FileNotFoundError(self.path)
        return sorted((prefix + x.path, x.size) for x in found)

    def partitions(self) -> list[Range]:
        return [Range(path, a, min(a + self.split, size)) for path, size in self.files() for a in range(0, size, self.split)] or [Range("", 0, 0)]

    def read(self, part: Range):
        if part.path:
            yield from self.rows(File(part.path, self.block), part)


def _fasta(file: File, part: Range) -> Iterator[tuple]:
    """Pieces of sequences; a piece before the range's first header has no name."""
    before = file.at(max(0, part.start - file.block), min(part.start, file.block))
    in_header = before[before.rfind(b"\n") + 1 :].startswith(b">")  # the range before this one reads that header
    own, header, name, n, i, at = False, b"", None, 0, 0, part.start
    while at < part.end or (in_header and own):
        block = file.at(at, file.block if in_header and at >= part.end else min(file.block, part.end - at))
        if not block:
            break
        k = 0
        while k < len(block):
            if in_header:
                stop = block.find(b"\n", k)
                header += block[k : stop if stop >= 0 else len(block)]
                k = stop + 1 if stop >= 0 else len(block)
                if stop >= 0:
                    in_header = False
                    if own:
                        name, n = header.decode().strip(), 0
                        yield part.path, part.start, i, name, 0, True, ""
                        i += 1
                    if at + k > part.end:
                        return
            else:
                stop = block.find(b">", k)
                bases = block[k : stop if stop >= 0 else len(block)].translate(None, b" \t\r\n").upper()
                if bases:
                    yield part.path, part.start, i, name, n, False, bases.decode()
                    n, i = n + len(bases), i + 1
                k = stop + 1 if stop >= 0 else len(block)
                if stop >= 0:
                    in_header, own, header = True, True, b""
        at += len(block)
    if in_header and own:
        yield part.path, part.start, i, header.decode().strip(), 0, True, ""


def _dot_bracket(file: File, part: Range) -> Iterator[tuple]:
    """Records whose header lies in the range, each to its end."""
    name, held = None, []

    def done() -> Iterator[tuple]:
        if name is not None and len(held) > 1:
            for db in held[1:]:
                yield name, held[0], db.split(" ")[0]

    for offset, line in file.lines(part.start):
        line = line.decode().strip()
        if line.startswith(">"):
            yield from done()
            if offset >= part.end:
                return
            name, held = line[1:].strip(), []
        elif line and name is not None:
            held.append(line)
        elif name is None and offset >= part.end:
            return
    yield from done()


_CT_BODY = re.compile(rb"\s*(\d+)\s+([A-Za-z])\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*$")


def _ct(file: File, part: Range) -> Iterator[tuple]:
    """Structures whose header lies in the range, each to its end. Inside of a structure, each line follows the one before it, so a
    range that begins there looks for a line that does not."""
    title, left, skipping = "", 0, part.start > 0
    for offset, line in file.lines(part.start):
        if not line.strip():
            continue
        body = _CT_BODY.match(line)
        if skipping and body and int(body[1]) == int(body[3]) + 1:
            if offset >= part.end:
                return
            continue
        skipping = False
        if left:
            if not body:
                raise ValueError(f"{part.path} at {offset}: {left} more lines of {title} should follow")
            yield title, int(body[1]), body[2].decode(), int(body[5])
            left -= 1
        else:
            if offset >= part.end:
                return
            count, *words = line.decode().split()
            title, left = " ".join(words), int(count)
    if left:
        raise ValueError(f"{part.path}: {left} more lines of {title} should follow")


# The mark at the end of a Mutation Map, and the letters of its packed sequences.
MM_END, MM_LETTERS = b"[mmeof]", "ACGTN"
#: Records in a row that make a place in a Mutation Map a record's beginning; the longest name and read that are taken for such.
MM_CHAIN, MM_NAME, MM_READ = 32, 1024, 1 << 24


class _Map:
    """Records of a Mutation Map by offset: a transcript is its header, then its reads. Each method returns what it finds and
    the offset after it, or None where there is no such record."""

    def __init__(self, file: File):
        self.file, self.base, self.data = file, 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        if not self.base <= at <= at + n <= self.base + len(self.data):
            self.base, self.data = at, self.file.at(at, max(n, self.file.block))
        return self.data[at - self.base : at - self.base + n]

    def ended(self, at: int) -> bool:
        return at >= self.file.size or self.bytes(at, len(MM_END)) == MM_END

    def read(self, at: int) -> tuple[tuple, int] | None:
        head = self.bytes(at, 12)
        if len(head) < 12:
            return None
        start, end, n = struct.unpack("<III", head)
        if not start <= end < start + MM_READ or n > end - start + 1:
            return None
        body = self.bytes(at + 12, 4 * n)
        if len(body) < 4 * n:
            return None
        muts = struct.unpack(f"<{n}I", body)
        return ((start + 1, end + 1, [m + 1 for m in muts]), at + 12 + 4 * n) if all(start <= m <= end for m in muts) else None

    def header(self, at: int) -> tuple[tuple, int] | None:
        head = self.bytes(at, 2)
        n = struct.unpack("<H", head)[0] if len(head) == 2 else 0
        name = self.bytes(at + 2, n).rstrip(b"\0")
        if not 0 < n <= MM_NAME or not name.isascii() or not name.decode().isprintable() or not name:
            return None
        at += 2 + n
        length = self.bytes(at, 4)
        if len(length) < 4:
            return None
        (length,) = struct.unpack("<I", length)
        packed = self.bytes(at + 4, (length + 1) // 2)
        at += 4 + len(packed)
        count, digits = self.bytes(at, 4), packed.hex()[:length]
        if len(digits) < length or len(count) < 4 or digits.strip("01234"):
            return None
        seq = digits.translate(str.maketrans("01234", MM_LETTERS))
        return (name.decode(), seq, struct.unpack("<I", count)[0]), at + 4

    def begins(self, at: int) -> bool:
        """Whether a chain of records begins here."""
        left = -1  # reads that are left of a transcript; unknown at first
        for _ in range(MM_CHAIN):
            if left <= 0 and self.ended(at):
                return True
            found = self.read(at) if left else None
            if found:
                left -= left > 0
            elif left > 0 or not (found := self.header(at)):
                return False
            else:
                left = found[0][2]
            at = found[1]
        return True


def _mutation_map(file: File, part: Range) -> Iterator[tuple]:
    """Transcripts and reads that begin in the range; reads before its first transcript belong to one that began before. One
    row, i = -1, says where the range's records begin and where the next range's do."""
    records = _Map(file)
    at = next((at for at in range(part.start, file.size) if records.begins(at)), file.size) if part.start else 0
    starts, left, i, n = at, -1 if part.start else 0, 0, 0
    while at < part.end and not (left <= 0 and records.ended(at)):
        found = records.read(at) if left else None
        if found:
            yield part.path, part.start, i, None, n, *found[0], None, None
            left -= left > 0
            n += 1
        elif left <= 0 and (found := records.header(at)):
            name, seq, left = found[0]
            yield part.path, part.start, i, (name, seq), 0, None, None, None, None, None
            n = 0
        else:
            raise ValueError(f"{part.path}: no record at {at}")
        i, at = i + 1, found[1]
    yield part.path, part.start, -1, None, None, None, None, None, starts, at


class MutationMapSource(DataSource):
    """Rows of Mutation Map files: file, split, i, tx (a transcript that begins here), n, end5, end3, muts, starts, stops."""

    @classmethod
    def name(cls) -> str:
        return "readloom_mutation_map"

    def schema(self) -> str:
        return "file string, split long, i long, tx struct<ref:string,seq:string>, n long, end5 int, end3 int, muts array<int>, starts long, stops long"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options, _mutation_map)


class FastaSource(DataSource):
    """Pieces of FASTA records: file, split, i, ref, first, head, bases."""

    @classmethod
    def name(cls) -> str:
        return "readloom_fasta"

    def schema(self) -> str:
        return "file string, split long, i int, ref string, first long, head boolean, bases string"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options, _fasta)


class DotBracketSource(DataSource):
    """struct, seq, db: a row for each structure of each record."""

    @classmethod
    def name(cls) -> str:
        return "readloom_dot_bracket"

    def schema(self) -> str:
        return "struct string, seq string, db string"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options, _dot_bracket)


class CtSource(DataSource):
    """struct (title), pos, base, partner (0: none)."""

    @classmethod
    def name(cls) -> str:
        return "readloom_ct"

    def schema(self) -> str:
        return "struct string, pos int, base string, partner int"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options, _ct)


def load(spark: SparkSession, source: type[DataSource], path: str, **options) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load(path)


def carried(rows: DataFrame, name: str, size) -> DataFrame:
    """file, split, _ref, _offset: of each range, the record that it begins in, and how much of that lies in ranges before.
    ``rows``: file, split, i, ``name`` (null before a range's first record); ``size``: how much of its record the range has, up
    to each row. As many rows as ranges, so what is summed over a file is small."""
    ends = rows.groupBy("file", "split").agg(F.max_by(F.struct(F.col(name).alias("name"), size.cast("long").alias("n")), "i").alias("x")).select("file", "split", "x.*")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    summed = ends.withColumn("_sum", F.coalesce(F.sum("n").over(before), F.lit(0)))
    begun = F.last(F.when(F.col("name").isNotNull(), F.col("_sum")), ignorenulls=True).over(before)
    return summed.select("file", "split", F.last("name", ignorenulls=True).over(before).alias("_ref"), (F.col("_sum") - begun).alias("_offset"))


def fasta_pieces(spark: SparkSession, path: str, **options) -> DataFrame:
    """ref, first (position from 1), bases, head: the records of FASTA files in pieces of a block at most; each record also has
    one empty piece with ``head``. Records may be longer than any partition."""
    rows = load(spark, FastaSource, path, **options)
    starts = carried(rows, "ref", F.col("first") + F.length("bases"))
    ref, first = F.coalesce("ref", "_ref"), F.when(F.col("ref").isNull(), F.col("_offset") + F.col("first")).otherwise(F.col("first")) + 1
    named = F.when(ref.isNull(), F.raise_error(F.concat(F.lit("bases before any name: "), "file"))).otherwise(ref)
    return rows.join(starts, ["file", "split"]).select(named.alias("ref"), first.alias("first"), "bases", "head")


def fasta_positions(spark: SparkSession, path: str, **options) -> DataFrame:
    """ref, pos, base of FASTA files; no row holds a sequence."""
    pieces = fasta_pieces(spark, path, **options).where("not head")
    return pieces.select("ref", "first", F.posexplode(F.split("bases", ""))).where("col <> ''").select("ref", (F.col("first") + F.col("pos")).alias("pos"), F.col("col").alias("base"))


def mutation_map(spark: SparkSession, path: str, **options) -> DataFrame:
    """ref, seq, read (from 0 in each transcript), end5, end3, muts (1-based) of Mutation Map files. Their records have no marks, so
    a range looks for a place from which a chain of records follows; that each range's records end where the next one's begin
    is checked, and where they don't it raises (larger ranges have fewer such places)."""
    rows = load(spark, MutationMapSource, path, **options)
    told = rows.withColumn("tx", F.last("tx", ignorenulls=True).over(Window.partitionBy("file", "split").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    starts = carried(told, "tx", F.coalesce(F.when(F.col("end5").isNotNull(), F.col("n") + 1), F.lit(0)))
    order = Window.partitionBy("file").orderBy("split")
    chain = rows.where("i = -1").select("file", "split", (F.col("starts") == F.coalesce(F.lag("stops").over(order), F.lit(0))).alias("_joined"))
    held = told.where("end5 is not null").join(starts.join(chain, ["file", "split"]), ["file", "split"])
    at = F.when(F.col("_joined"), F.when(F.col("tx").isNull(), F.col("_offset") + F.col("n")).otherwise(F.col("n"))).otherwise(F.raise_error(F.concat(F.lit("ranges do not meet: "), "file")))
    tx = F.coalesce("tx", "_ref")
    return held.select(tx["ref"].alias("ref"), tx["seq"].alias("seq"), at.alias("read"), "end5", "end3", "muts")
