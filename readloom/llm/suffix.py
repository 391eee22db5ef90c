"""Exact duplicate byte strings by longest-previous-factor arrays.

The suffixes of a whole corpus are sorted in parts that can be sorted apart. Every window of ``length``
bytes is filed under the least hash of the ``GRAM``-byte strings in it, so equal windows are filed alike
wherever they stand. Neighbouring windows with the same file name make a *run*, and

1. runs are compared by digest first: equal ones are copies as a whole;
2. only where a file holds different runs (at the ends of matches) their bytes are fetched, and the
   suffixes that start in them are sorted by their first ``length`` bytes. Of neighbours in suffix order, the previous
   and the next one that stand earlier in the corpus give each suffix its longest previous factor, the longer
   of the two common prefixes; one of ``length`` is a copy.

Runs and windows that come twice within a batch of rows are copies for sure: they are noted there, and one of each
goes on, so no task gathers a frequent string. A file too large for one task (a passage in very many texts) is split by
the windows' own digests, which is exact too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64, mix

GRAM, LENGTH = 32, 400
#: Windows in a run; runs in a bucket; runs of a file that one task sorts; bytes sorted at once; strings compared at once.
RUN, ENTRIES, FILE, CHUNK, ROWS = 1024, 500_000, 1000, 1 << 20, 1 << 14
#: Documents in the sample that shows very large files, and how many runs of a file there make it so.
HOT_SAMPLE, HOT_LEAST = 4000, 30

_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            _POWERS[key] = np.multiply.accumulate(np.r_[U64(1), np.full(size - 1, base, U64)])
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Rolling:
    """Hashes of any substrings of a byte string from prefix sums."""

    def __init__(self, data: bytes):
        codes = _BYTES[np.frombuffer(data, np.uint8)]
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(codes * up[: len(data)], out=self.sums[1:])

    def __call__(self, at: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[at + length] - self.sums[at]) * self.down[at])

    def all(self, length: int) -> np.ndarray:
        return mix((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length])


def _sliding(a: np.ndarray, width: int, take) -> np.ndarray:
    """take (minimum or maximum) of every ``width`` neighbours, in log2(width) passes."""
    n, size = len(a) - width + 1, 1
    while size * 2 <= width:
        a = take(a[:-size], a[size:])
        size *= 2
    return take(a[:n], a[width - size : width - size + n])


def runs(data: bytes, length: int = LENGTH):
    """File name, digest, start, windows and whether the run may repeat within itself, of each run."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    rolling, gram = Rolling(data), min(GRAM, length)
    grams = rolling.all(gram)
    width = length - gram + 1
    least = _sliding(grams, width, np.minimum)
    change = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1]
    size = np.diff(np.r_[change, n])
    if size.max() > RUN:
        pieces = -(-size // RUN)
        offset = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(RUN, np.repeat(size, pieces) - offset * RUN)
        change = np.repeat(change, pieces) + offset * RUN
    own = np.zeros(len(change), bool)
    # a run repeats within itself only if its least gram comes twice, the second time beyond a window
    padded = np.concatenate([np.zeros(width - 1, U64), least, np.zeros(width - 1, U64)])
    at = np.flatnonzero(_sliding(padded, width, np.maximum) == grams)
    twice = at[:-1][grams[at[1:]] == grams[at[:-1]]]
    twice = twice[twice + 1 < n]
    twice = twice[(least[twice] == grams[twice]) & (least[twice + 1] == grams[twice])]
    own[np.searchsorted(change, twice, "right") - 1] = True
    view = memoryview(data)
    digest = np.fromiter((xxhash.xxh3_64_intdigest(view[a : a + n + length - 1]) for a, n in zip(change.tolist(), size.tolist(), strict=True)), U64, len(change))
    return least[change], digest, change, size, own


def smaller(a: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest smaller value to the left of each (-1: none), by pointer jumping, and the least of ``lcp``
    on the way (``lcp[i]`` stands between i - 1 and i)."""
    p, m = np.arange(len(a)) - 1, lcp.copy()
    bad = np.arange(len(a))
    while len(bad):
        q = p[bad]
        bad = bad[(q >= 0) & (a[q] > a[bad])]
        q = p[bad]
        m[bad], p[bad] = np.minimum(m[bad], m[q]), p[q]
    return p, m


def _same(data: np.ndarray, at: np.ndarray, to: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings at these places are equal, byte by byte. Where the pair before stands one byte to the left,
    only the last byte is new."""
    follows = np.r_[False, (at[1:] == at[:-1] + 1) & (to[1:] == to[:-1] + 1)] if len(at) else np.empty(0, bool)
    equal = data[at + length - 1] == data[to + length - 1]
    heads, offsets = np.flatnonzero(~follows), np.arange(length)
    for i in range(0, len(heads), ROWS):
        h = heads[i : i + ROWS]
        equal[h] = (data[at[h][:, None] + offsets] == data[to[h][:, None] + offsets]).all(axis=1)
    wrong = np.cumsum(~equal)
    head = heads[np.cumsum(~follows) - 1]  # of each pair's stretch
    return wrong - wrong[head] + ~equal[head] == 0


def suffix_order(data: np.ndarray, at: np.ndarray, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at these places, in the order of their first ``length`` bytes and then of their places, and the
    common prefix of each with the one before (up to ``length``). ``prints`` are hashes of these bytes: equal ones are
    compared, and what differs in spite of them is told apart."""
    _, first, cls = np.unique(prints, return_index=True, return_inverse=True)
    odd = np.flatnonzero(~_same(data, at, at[first[cls]], length))
    if len(odd):
        known: dict[bytes, int] = {}
        n = len(first)
        for i in odd.tolist():
            cls[i] = known.setdefault(data[at[i] : at[i] + length].tobytes(), n + len(known))
        _, first, cls = np.unique(cls, return_index=True, return_inverse=True)
    strings = np.lib.stride_tricks.sliding_window_view(data, length)[at[first]]
    order = np.argsort(strings.view(f"S{length}").ravel(), kind="stable")
    common_ = np.zeros(len(order), np.int64)
    for i in range(1, len(order), ROWS):
        differs = strings[order[i : i + ROWS]] != strings[order[i - 1 : i + ROWS - 1]][: len(order[i : i + ROWS])]
        common_[i : i + ROWS] = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rank = rank[cls]
    places = np.argsort(rank, kind="stable")
    rank = rank[places]
    fresh = np.r_[True, rank[1:] != rank[:-1]] if len(rank) else np.empty(0, bool)
    return places, np.where(fresh, common_[rank], length)


def longest_previous(places: np.ndarray, lcp: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """By place: the longest previous factor (up to ``length``) of each suffix, and which suffixes are such a factor's
    source. The candidates are the nearest smaller places before and after in suffix order."""
    n = len(places)
    before, left = smaller(places, lcp)
    after, right = smaller(places[::-1], np.r_[0, lcp[1:][::-1]] if n else lcp)
    after, right = n - 1 - after[::-1], right[::-1]
    lpf, source = np.zeros(n, np.int64), np.zeros(n, bool)
    for other, shared in ((before, left), (after, right)):
        ok = (other >= 0) & (other < n)
        lpf[places[ok]] = np.maximum(lpf[places[ok]], shared[ok])
        whole = ok & (shared >= length)
        source[places[other[whole]]] = True
    return lpf, source


def _cuts(key: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=False)) if len(starts) else []


_KINDS = {"file": U64, "digest": U64, "doc": np.int64, "start": np.int32, "size": np.int32, "flag": np.int8}
_PACKED = "bucket long, " + ", ".join(f"{c} binary" for c in _KINDS)


def _packed(bucket: np.ndarray, columns: list[np.ndarray]) -> pd.DataFrame:
    order = np.argsort(bucket, kind="stable")
    columns, bucket = [c[order].astype(kind) for c, kind in zip(columns, _KINDS.values(), strict=True)], bucket[order]
    return pd.DataFrame([(bucket[a], *(c[a:b].tobytes() for c in columns)) for a, b in _cuts(bucket)], columns=["bucket", *_KINDS])


def _table(frame: pd.DataFrame, length: int) -> list[np.ndarray]:
    made = [runs(text.encode("utf-8", "surrogatepass"), length) for text in frame["text"]]
    doc = np.repeat(frame["row"].to_numpy("int64"), [len(m[0]) for m in made])
    file, digest, start, size, own = (np.concatenate([m[i] for m in made]) if made else np.empty(0) for i in range(5))
    return [file, digest, doc, start, size, own.astype(np.int8)]


def _repeated(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal among these, and which are to go on: all others, and the first of equal ones."""
    order = np.lexsort(keys)
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    group = np.cumsum(fresh) - 1
    twice, on = np.zeros(len(order), bool), np.zeros(len(order), bool)
    twice[order] = np.bincount(group)[group] > 1 if len(order) else False
    on[order[fresh]] = True
    return twice, on


def _scan(frames, buckets: int, length: int, hot_file: np.ndarray):
    """Runs packed by bucket of their file name. Runs that come again in the batch are copies for sure: they are noted
    under bucket -1, and one of each goes on, flagged 2. Very large files are dealt by digest."""
    for frame in frames:
        columns = _table(frame, length)
        file, digest = columns[:2]
        bucket = ((mix(file) ^ np.where(np.isin(file, hot_file), mix(digest), U64(0))) % U64(buckets)).astype(np.int64)
        twice, on = _repeated(file, digest)
        if twice.any():
            yield _packed(np.full(int(twice.sum()), -1), [c[twice] for c in columns])
            columns[5] = np.where(twice, 2, columns[5])
            columns, bucket = [c[on] for c in columns], bucket[on]
        yield _packed(bucket, columns)


def _compare(frame: pd.DataFrame, hot_file: np.ndarray) -> pd.DataFrame:
    """Of one bucket: flag 1, runs that are copies as a whole; flag 0 and 2, runs to sort by suffix (2: a
    copy as a whole, sent as a partner)."""
    file, digest, doc, start, size, flag = (np.concatenate([np.frombuffer(b, kind) for b in frame[c]]) for c, kind in _KINDS.items())
    order = np.lexsort((start, doc, digest, file))
    file, digest, doc, start, size, flag = (x[order] for x in (file, digest, doc, start, size, flag))
    same_file = np.r_[False, file[1:] == file[:-1]]
    same = same_file & np.r_[False, digest[1:] == digest[:-1]]
    group = np.cumsum(~same) - 1
    count = np.bincount(group)[group] if len(group) else group
    whole = (count > 1) | (np.maximum.reduceat(flag, np.flatnonzero(~same))[group] == 2 if len(group) else False)
    fid = np.cumsum(~same_file) - 1
    kinds = np.bincount(fid, ~same)[fid] if len(fid) else fid
    own = np.maximum.reduceat(flag == 1, np.flatnonzero(~same_file))[fid] if len(fid) else fid
    sort = ~same & ((kinds > 1) | own | np.isin(file, hot_file))
    copied = whole & (flag != 2)
    out = []
    for chosen, mark in ((copied, np.ones(len(doc), np.int8)), (sort, np.where(whole, 2, 0))):
        at = np.flatnonzero(chosen)
        at = at[np.argsort(doc[at], kind="stable")]
        out += [(doc[at[a]], file[at[a:b]].tobytes(), start[at[a:b]].tobytes(), size[at[a:b]].tobytes(), mark[at[a:b]].astype(np.int8).tobytes()) for a, b in _cuts(doc[at])]
    return pd.DataFrame(out, columns=["row", "file", "start", "size", "flag"])


def _contexts(frames, length: int):
    """Bytes of the runs to be sorted."""
    for frame in frames:
        rows = []
        for row, text, *parts in zip(frame["row"], frame["text"], frame["file"], frame["start"], frame["size"], frame["flag"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            file, start, size, flag = (np.concatenate([np.frombuffer(b, kind) for b in p]) for p, kind in zip(parts, (np.int64, np.int32, np.int32, np.int8), strict=True))
            keep = flag != 1
            rows += [(f, row, a, n, k, data[a : a + n + length - 1]) for f, a, n, k in zip(file[keep].tolist(), start[keep].tolist(), size[keep].tolist(), flag[keep].tolist(), strict=True)]
        yield pd.DataFrame(rows, columns=["file", "row", "start", "size", "flag", "data"])


def _found(doc: np.ndarray, start: np.ndarray, gone: np.ndarray) -> list[tuple]:
    """Window starts as runs, by document."""
    doc, start = doc[gone], start[gone]
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)]) if len(doc) else np.empty(0, np.int64)
    size = start[np.r_[first[1:], len(doc)] - 1] - start[first] + 1 if len(doc) else first
    doc, start = doc[first], start[first]
    return [(doc[a], start[a:b].astype(np.int32).tobytes(), size[a:b].astype(np.int32).tobytes()) for a, b in _cuts(doc)]


def _sort(frames, length: int):
    """Rows come sorted by file; whole files are gathered up to a chunk and their suffixes sorted."""

    def done(rows: list[tuple]) -> list[tuple]:
        data = b"".join([r[4] for r in rows])
        doc, start, size, flag = (np.array([r[i] for r in rows]) for i in range(4))
        begin = np.cumsum(size + length - 1) - (size + length - 1)
        shift = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(begin - shift, size)  # in corpus order within each file
        prints = Rolling(data)(at, length)
        slot = (prints & U64((1 << 20) - 1)).astype(np.int64)
        twice = np.flatnonzero(np.bincount(slot)[slot] > 1)  # others cannot have an equal
        places, lcp = suffix_order(np.frombuffer(data, np.uint8), at[twice], prints[twice], length)
        lpf, source = longest_previous(places, lcp, length)
        row = np.repeat(np.arange(len(rows)), size)[twice]
        return _found(doc[row], at[twice] - begin[row] + start[row], ((lpf >= length) | source) & (flag[row] == 0))

    held, total, last = [], 0, None
    for frame in frames:
        out = []
        for file, *row in zip(frame["file"], frame["row"], frame["start"], frame["size"], frame["flag"], frame["data"], strict=True):
            if file != last and total >= CHUNK:
                out += done(held)
                held, total = [], 0
            last = file
            held.append(row)
            total += len(row[4])
        yield pd.DataFrame(out, columns=["row", "start", "size"])
    if held:
        yield pd.DataFrame(done(held), columns=["row", "start", "size"])


def _windows(frames, length: int, buckets: int):
    """Windows of files too large for one task, by bucket of their own 128-bit digest. Those that come again in the
    batch are noted under a negative bucket, and one of each goes on, flagged 2."""
    for frame in frames:
        digests, doc, start, flag = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int8)]
        for d, a, n, k, data in zip(frame["row"], frame["start"], frame["size"], frame["flag"], frame["data"], strict=True):
            view = memoryview(data)
            digests += [xxhash.xxh3_128_digest(view[i : i + length]) for i in range(n)]
            doc.append(np.full(n, d))
            start.append(np.arange(a, a + n))
            flag.append(np.full(n, k, np.int8))
        doc, start, flag = map(np.concatenate, (doc, start, flag))
        high, low = np.frombuffer(b"".join(digests), U64).reshape(-1, 2).T
        columns, bucket = [high, low, doc, start, np.ones(len(doc)), flag], (low % U64(buckets)).astype(np.int64)
        twice, on = _repeated(high, low)
        sure = twice & (flag == 0)
        if sure.any():
            yield _packed(-1 - bucket[sure], [c[sure] for c in columns])
        columns[5] = np.where(twice, 2, flag)
        yield _packed(bucket[on], [c[on] for c in columns])


def _equal(frame: pd.DataFrame) -> pd.DataFrame:
    file, digest, doc, start, _, flag = (np.concatenate([np.frombuffer(b, kind) for b in frame[c]]) for c, kind in _KINDS.items())
    if frame["bucket"].iloc[0] < 0:
        gone = np.ones(len(doc), bool)
    else:  # several are copies, and so is one that comes again in its batch
        gone = _repeated(file, digest)[0] & (flag == 0)
    return pd.DataFrame(_found(doc, start, gone), columns=["row", "start", "size"])


def copies(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Windows that come more than once: row (see common.row_key), start and size (packed int32 runs of window starts in
    bytes), several rows a document; only documents that have some. ``docs``: row, text (not null)."""
    n = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = 16 + int((n["bytes"] or 0) / 170 / ENTRIES)

    def sampled(frames):
        for frame in frames:
            value, count = np.unique(_table(frame, length)[0], return_counts=True)
            yield pd.DataFrame({"value": value.view(np.int64), "n": count})

    seen = docs.where(F.pmod(F.col("row"), F.lit(common.every(n["n"], HOT_SAMPLE))) == 0).mapInPandas(sampled, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST).collect()
    hot_file = np.array([r["value"] for r in seen], np.int64).view(U64)

    packed = common.materialize(docs.mapInPandas(lambda f: _scan(f, buckets, length, hot_file), _PACKED), "runs")
    schema = "row long, file binary, start binary, size binary, flag binary"
    compared = common.materialize(packed.where("bucket >= 0").groupBy("bucket").applyInPandas(lambda f: _compare(f, hot_file), schema), "compared")
    sure = packed.where("bucket < 0")

    def by_doc(frames):
        for frame in frames:
            doc, start, size = (np.concatenate([np.frombuffer(b, _KINDS[c]) for b in frame[c]]) for c in ("doc", "start", "size"))
            order = np.argsort(doc, kind="stable")
            doc, start, size = doc[order], start[order], size[order]
            yield pd.DataFrame([(doc[a], start[a:b].tobytes(), size[a:b].tobytes()) for a, b in _cuts(doc)], columns=["row", "start", "size"])

    def whole_only(frames):
        for frame in frames:
            out = frame[[b"\x01" == bytes(f[:1]) for f in frame["flag"]]]
            yield out[["row", "start", "size"]]

    found = "row long, start binary, size binary"
    wanted = compared.where(F.substring("flag", 1, 1) != F.lit(b"\x01")).groupBy("row").agg(*[F.collect_list(c).alias(c) for c in ("file", "start", "size", "flag")])
    contexts = common.materialize(docs.join(wanted, "row").mapInPandas(lambda f: _contexts(f, length), "file long, row long, start int, size int, flag int, data binary"), "contexts")
    large = contexts.groupBy("file").count().where(F.col("count") > FILE).select("file")
    small = contexts.join(large, "file", "left_anti")
    sorted_ = small.repartition("file").sortWithinPartitions("file", "row", "start").mapInPandas(lambda f: _sort(f, length), found)
    split = contexts.join(large, "file", "left_semi").mapInPandas(lambda f: _windows(f, length, buckets), _PACKED).groupBy("bucket").applyInPandas(_equal, found)
    return sure.mapInPandas(by_doc, found).unionByName(compared.mapInPandas(whole_only, found)).unionByName(sorted_).unionByName(split)


def covered(start: list[bytes], size: list[bytes], length: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by windows."""
    a, n = (np.concatenate([np.frombuffer(b, np.int32) for b in p]).astype(np.int64) for p in (start, size))
    order = np.argsort(a, kind="stable")
    a, end = a[order], np.maximum.accumulate((a + n)[order] + length - 1)
    first = np.r_[True, a[1:] > end[:-1]]
    return list(zip(a[first].tolist(), end[np.r_[np.flatnonzero(first)[1:] - 1, len(a) - 1]].tolist(), strict=True))


def dedup(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """Remove every byte that a repeated string of ``length`` bytes covers: doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256, spans (byte offsets in the original), and the kept bytes
    if asked for.

    Texts are UTF-8 bytes, null is empty, matches never cross documents, a document matches itself as well. Every row
    gives a row and is a document of its own, whatever its doc_id, null included; equal rows are copies of each other and
    lose all that ``length`` covers. An empty table gives an empty table; other columns are ignored."""
    docs = common.with_text(docs).select("doc_id", common.row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    gathered = copies(docs.select("row", "text"), length).groupBy("row").agg(F.collect_list("start").alias("start"), F.collect_list("size").alias("size"))

    def run(frames):
        for frame in frames:
            rows = []
            for doc_id, text, start, size in zip(frame["doc_id"].astype("Int64"), frame["text"], frame["start"], frame["size"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                spans = covered(start, size, length) if start is not None else []
                cuts = [0, *(x for span in spans for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                rows.append((doc_id, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans], kept if keep_text else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]).astype({"doc_id": "Int64"})[out]

    out = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * keep_text]
    return docs.join(gathered, "row", "left").mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept binary" * keep_text)


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that come again, in all ``documents``."""
    return dedup(common.table(spark, sf_dir, "documents"))
