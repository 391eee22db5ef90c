"""Line and paragraph hashing: repeated units are removed but for the earliest one.

Units are lines and, within lines of several, sentences, so that a passage set into a running paragraph
is found too; short sentences repeat together with their neighbours. Digests of the normalised units are grouped over the whole corpus, packed by bucket of
the digest; the occurrence that ranks first (by doc_id, null last, then offset) stays. Digests that a sample shows
to be very common are pre-aggregated instead: each split's first occurrence goes into a small table of
minima, and a split decides about its own occurrences by the same rank, so no task gathers them.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_LINE = re.compile(r"[^\n]+")
#: A run of marks and what closes with them, before white space. Each run is looked at once, from its first mark on.
_END = re.compile(r"(?<![.!?…])([.!?…]++)[\"')\]]*+(?=\s|\Z)")
_SOLID = re.compile(r"\S")
#: Entries in a bucket; documents in the sample that shows very common units, and how many of a unit there make it so.
ENTRIES, HOT_SAMPLE, HOT_LEAST = 1_000_000, 10_000, 40
#: The rank of documents without a doc_id: after all others, by content.
LAST = np.iinfo(np.int64).max


def sentences(line: str) -> list[tuple[int, int]]:
    """Start and end of each sentence of a line: from what is no white space to the next run of marks before white space. A
    single mark at the start ends nothing."""
    out, first = [], _SOLID.search(line)
    if not first:
        return out
    start = first.start()
    for m in _END.finditer(line):
        if m.start() == start and len(m[1]) == 1:
            continue
        out.append((start, m.end()))
        following = _SOLID.search(line, m.end())
        if not following:
            return out
        start = following.start()
    return [*out, (start, len(line.rstrip()))]


def units(text: str, min_words: int = 6) -> list[tuple[int, int, int, bytes]]:
    """(start, end, end of the unit before, digest), in code points, of lines and sentences.

    Normal form: lower case, white space as one space, no outer white space. Sentences of ``min_words`` or
    more are units. A run of shorter ones beside them is a unit too, but repeats only together with its
    neighbours in the line. A line of none but short sentences is one unit, however short. So of a repeated
    line every part repeats, and nothing goes that occurs once. "End of the unit before" is -1 for the first."""
    out = []
    before = -1
    for line in _LINE.finditer(text):
        raw = line[0]
        found = [(a, b, len(raw[a:b].split()) >= min_words) for a, b in sentences(raw)]
        if not found:
            continue
        first, last = found[0][0], found[-1][1]
        if not any(long for _, _, long in found):
            found = [(first, last, True)]
        k = 0
        while k < len(found):
            to = k + 1
            if found[k][2]:
                mark, a, b = "", *found[k][:2]
            else:
                while to < len(found) and not found[to][2]:
                    to += 1
                mark, a, b = "\n", found[max(0, k - 1)][0], found[min(to, len(found) - 1)][1]
            start, end = line.start() + found[k][0], line.start() + found[to - 1][1]
            out.append((start, end, before, xxhash.xxh3_128_digest((mark + " ".join(raw[a:b].split()).lower()).encode("utf-8", "surrogatepass"))))
            before, k = end, to
    return out


_COLUMNS = ["digest", "doc", "row", "start", "end", "before"]


def _table(frame: pd.DataFrame, min_words: int):
    """All units of a batch as arrays: digest (two columns of uint64), doc (rank), row (key), start, end, before."""
    digests, sizes, starts, ends, befores = [], [], [], [], []
    for text in frame["text"]:
        found = units(text, min_words)
        sizes.append(len(found))
        for start, end, before, digest in found:
            digests.append(digest)
            starts.append(start)
            ends.append(end)
            befores.append(before)
    doc = np.repeat(frame["rank"].to_numpy("int64"), sizes)
    row = np.repeat(frame["row"].to_numpy("int64"), sizes)
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2), doc, row, np.array(starts, np.int32), np.array(ends, np.int32), np.array(befores, np.int32)


def _pack(digest, *columns, rows: list[tuple[int, int, int]]):
    return pd.DataFrame([(key, digest[a:b].tobytes(), *(c[a:b].tobytes() for c in columns)) for key, a, b in rows], columns=["bucket", *_COLUMNS])


def _runs(key: np.ndarray) -> list[tuple[int, int, int]]:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(key)] if len(starts) else starts
    return [(int(key[a]), int(a), int(b)) for a, b in zip(starts, ends, strict=True)]


def _read(frame: pd.DataFrame):
    kinds = (np.uint64, np.int64, np.int64, np.int32, np.int32, np.int32)
    digest, *rest = (np.concatenate([np.frombuffer(b, kind) for b in frame[c]]) for c, kind in zip(_COLUMNS, kinds, strict=True))
    return digest.reshape(-1, 2), *rest


def _scan(frames, buckets: int, hot: np.ndarray, min_words: int):
    """Packed units; those of very common digests are in bucket -1 and stay with their split."""
    for frame in frames:
        digest, *columns = _table(frame, min_words)
        bucket = (digest[:, 0] % np.uint64(buckets)).astype(np.int64)
        bucket[np.isin(digest[:, 0], hot)] = -1
        order = np.argsort(bucket, kind="stable")
        yield _pack(digest[order], *(c[order] for c in columns), rows=_runs(bucket[order]))


def _removed(row, start, end, before, gone) -> pd.DataFrame:
    order = np.lexsort((start[gone], row[gone]))
    row, start, end, before = (x[gone][order] for x in (row, start, end, before))
    return pd.DataFrame([(key, start[a:b].tobytes(), end[a:b].tobytes(), before[a:b].tobytes()) for key, a, b in _runs(row)], columns=["row", "start", "end", "before"])


def _first(digest, doc, row, start):
    """Order by digest and rank; which in it is the first of its digest; which is that one, or the same unit of an
    equal row."""
    order = np.lexsort((start, row, doc, digest[:, 1], digest[:, 0]))
    if not len(order):
        return order, np.empty(0, bool), np.empty(0, bool)
    digest, row, start = digest[order], row[order], start[order]
    first = np.r_[True, (digest[1:] != digest[:-1]).any(axis=1)]
    of = np.flatnonzero(first)[np.cumsum(first) - 1]
    return order, first, (row == row[of]) & (start == start[of])


def _later(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: all occurrences but the first of each digest."""
    digest, doc, row, start, end, before = _read(frame)
    order, _, kept = _first(digest, doc, row, start)
    gone = np.zeros(len(order), bool)
    gone[order[~kept]] = True
    return _removed(row, start, end, before, gone)


def _minima(frames):
    for frame in frames:
        digest, doc, row, start, _, _ = _read(frame)
        order, first, _ = _first(digest, doc, row, start)
        at = order[first]
        yield pd.DataFrame({"high": digest[at, 0].view(np.int64), "low": digest[at, 1].view(np.int64), "doc": doc[at], "row": row[at], "start": start[at]})


def _hot_later(frames, least: dict):
    for frame in frames:
        digest, doc, row, start, end, before = _read(frame)
        keep = np.array([least[h, l] == (d, r, s) for h, l, d, r, s in zip(digest[:, 0].view(np.int64).tolist(), digest[:, 1].view(np.int64).tolist(), doc.tolist(), row.tolist(), start.tolist(), strict=True)], bool)
        yield _removed(row, start, end, before, ~keep)


def _spans(frames):
    """Removed units of each document as merged spans, with the white space between neighbours."""
    for frame in frames:
        rows = []
        for row, *parts in zip(frame["row"], frame["start"], frame["end"], frame["before"], strict=True):
            start, end, before = (np.concatenate([np.frombuffer(b, np.int32) for b in p]) for p in parts)
            order = np.argsort(start, kind="stable")
            spans: list[list[int]] = []
            for a, b, c in zip(start[order].tolist(), end[order].tolist(), before[order].tolist(), strict=True):
                if spans and (a <= spans[-1][1] or c == spans[-1][1]):
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            rows.append((row, len(order), [{"start": a, "end": b} for a, b in spans]))
        yield pd.DataFrame(rows, columns=["row", "n_units_removed", "spans"])


SPANS = "array<struct<start:int,end:int>>"


def _gone(docs: DataFrame, min_words: int) -> DataFrame:
    """row (see common.row_key), n_units_removed, spans, of the documents that lose something."""
    docs = common.with_text(docs)
    n = docs.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    buckets = 16 + int((n["chars"] or 0) / 40 / ENTRIES)
    docs = docs.select(F.coalesce("doc_id", F.lit(int(LAST))).alias("rank"), common.row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")

    def sampled(frames):
        for frame in frames:
            high, count = np.unique(_table(frame, min_words)[0][:, 0], return_counts=True)
            yield pd.DataFrame({"high": high.view(np.int64), "n": count})

    seen = docs.where(F.pmod(F.col("row"), F.lit(common.every(n["n"], HOT_SAMPLE))) == 0).mapInPandas(sampled, "high long, n long").groupBy("high").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST)
    hot = np.array([r["high"] for r in seen.collect()], np.int64).view(np.uint64)
    packed = common.materialize(docs.mapInPandas(lambda f: _scan(f, buckets, hot, min_words), "bucket long, " + ", ".join(f"{c} binary" for c in _COLUMNS)), "units")
    schema = "row long, start binary, end binary, before binary"
    gone = packed.where("bucket >= 0").groupBy("bucket").applyInPandas(_later, schema)
    if len(hot):
        own = packed.where("bucket < 0").drop("bucket")
        firsts = own.mapInPandas(_minima, "high long, low long, doc long, row long, start int").groupBy("high", "low").agg(F.min(F.struct("doc", "row", "start")).alias("first"))
        least = {(r["high"], r["low"]): tuple(r["first"]) for r in firsts.collect()}  # no more than the very common digests
        gone = gone.unionByName(own.mapInPandas(lambda f: _hot_later(f, least), schema))
    return gone.groupBy("row").agg(F.collect_list("start").alias("start"), F.collect_list("end").alias("end"), F.collect_list("before").alias("before")).mapInPandas(_spans, f"row long, n_units_removed long, spans {SPANS}")


def repeats(docs: DataFrame, min_words: int = 6) -> DataFrame:
    """Spans to remove of every row: doc_id, n_chars_in, n_units_removed, spans (code points of the original text, end
    exclusive; none removed: empty).

    Null and empty texts have no units. Rank is (doc_id, offset); rows without a doc_id rank last, by a hash of their
    text, and so do different texts that share one doc_id among themselves. Rows that agree in doc_id and text are one
    document, so they get the same spans, and none of them is a repeat of the other. An empty table gives an empty
    table; other columns, whatever their names, are ignored.
    """
    own = common.with_text(docs).select("doc_id", common.row_key(F.col("doc_id"), F.col("text")).alias("row"), F.length("text").cast("long").alias("n_chars_in"))
    return own.join(_gone(docs, min_words), "row", "left").select("doc_id", "n_chars_in", F.coalesce("n_units_removed", F.lit(0)).cast("long").alias("n_units_removed"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def remove(docs: DataFrame, min_words: int = 6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows and columns, repeated rows and null keys included, without the repeated units."""
    row, spans = common.fresh(docs, "_row"), common.fresh(docs, "_spans")
    held = _gone(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), min_words).select(F.col("row").alias(row), F.col("spans").alias(spans))
    keyed = docs.withColumn(row, common.row_key(F.col(key).cast("long"), F.col(text)))
    before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    kept = F.transform(spans, lambda s, i: F.substring(F.col(text), before(i) + 1, s["start"] - before(i)))
    step = F.concat(F.array_join(kept, ""), F.substring(F.col(text), F.get(spans, F.size(spans) - 1)["end"] + 1, F.length(F.col(text))))
    return keyed.join(held, row, "left").withColumn(text, F.when(F.size(spans) > 0, step).otherwise(F.col(text))).select(*docs.columns)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated lines and sentences of all ``documents``: per document what goes, with offsets."""
    found = repeats(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars_in", "n_units_removed", F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["end"] - s["start"]).cast("long").alias("n_chars_removed"), "spans")
