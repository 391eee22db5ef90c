"""Near duplicates by SimHash, found through pigeonhole blocks.

Two fingerprints that differ in at most d bits agree in one of any d + 1 blocks of bits.

1. Every text's fingerprint; equal fingerprints are one from here on.
2. Each fingerprint goes into d + 1 groups, by the bits of one block. What lies in a group of more than LIMIT goes
   into d + 1 groups each by a third of the bits that are left, besides those it agrees in: the same argument holds
   for these. A group that knows all but ten bits has 1024 members at most, so this ends, and no pair is lost.
3. In each group all Hamming distances are looked at, and a spanning forest of the links is returned.
4. Links give components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .pigeonhole import refine

BITS = 64
#: Seed of the shingles' hashes.
SEED = 42
#: Fingerprints in a group.
LIMIT = 1024
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def word_pieces(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, a piece of about ``size`` bytes at a time."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield data[at:end].split()
        at = end


def shingle_hashes(data: bytes, k: int, size: int = PIECE) -> Iterator[np.ndarray]:
    """Hashes of the k-word shingles, repeats included, piece by piece; fewer words make one shingle, none makes none."""
    digest, held, some = xxhash.xxh64_intdigest, [], False
    for ws in word_pieces(data.lower(), size):
        held += ws
        if len(held) >= k:
            joined = b" ".join(held)
            ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1)
            starts = np.r_[0, ends[:-1]][: len(held) - k + 1].tolist()
            yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
            some, held = True, held[len(held) - k + 1 :]
    if held and not some:
        yield np.array([digest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: str, k: int = 3, size: int = PIECE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; zero without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text.encode("utf-8", "surrogatepass"), k, size):
        for a in range(0, len(h), 1 << 15):
            part = h[a : a + (1 << 15)]
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(frames, k: int):
    for frame in frames:
        yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64").array, "fp": np.array([fingerprint(t, k) for t in frame["text"]], np.uint64).view(np.int64)})


def blocks(mask: int, n: int) -> list[int]:
    """The mask with each of ``n`` runs of the bits that it leaves out."""
    left = [i for i in range(BITS) if not mask >> i & 1]
    cuts = [len(left) * i // n for i in range(n + 1)]
    return [mask | sum(1 << i for i in left[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of these distinct fingerprints, which link at ``distance`` differing bits at most."""
    if len(fps) == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= distance else []
    left, links = np.arange(len(fps)), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= distance
            if near.any():
                found = left[near].tolist()
                links += [(i, j) for j in found]
                todo += found
                left = left[~near]
    return links


def _links(frames, distance: int):
    """Rows come sorted by (mask, bits); a group that goes over the end of a batch waits for the rest."""
    held: list[np.ndarray] = []

    def done(rows: np.ndarray) -> tuple[list[int], list[int]]:
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]) if len(rows) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(rows)])
        a, b = [], []
        for at, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            fps = rows[at : at + n, 2]
            for i, j in forest(fps.view(np.uint64), distance):
                a.append(fps[i])
                b.append(fps[j])
        return a, b

    for frame in frames:
        rows = np.ascontiguousarray(frame[["mask", "bits", "fp"]].to_numpy(np.int64))
        if not len(rows):
            continue
        if held and (held[-1][-1, :2] != rows[0, :2]).any():
            a, b = done(np.concatenate(held))
            yield pd.DataFrame({"a": a, "b": b}).astype("int64")
            held = []
        last = int(np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))[-1]) + 1 if (rows[:, :2] != rows[-1, :2]).any() else 0
        if last:
            a, b = done(np.concatenate([*held, rows[:last]]))
            yield pd.DataFrame({"a": a, "b": b}).astype("int64")
            held = []
        held.append(rows[last:])
    if held:
        a, b = done(np.concatenate(held))
        yield pd.DataFrame({"a": a, "b": b}).astype("int64")


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """``fps``: fp (long), distinct. Returns a, b (fp): links at ``distance`` differing bits at most, enough of them that
    fingerprints are connected by these just if they are by all links."""
    parts = distance + 1
    known = [0]

    def split(rows: DataFrame) -> DataFrame:
        nonlocal known
        children = {m: blocks(m, parts) for m in known}
        known = sorted({c for cs in children.values() for c in cs})
        # at most (distance + 1) ** rounds masks
        table = rows.sparkSession.createDataFrame([(_signed(m), _signed(c)) for m, cs in children.items() for c in cs], "mask long, child long")
        longer = rows.join(F.broadcast(table), "mask").select("fp", F.col("child").alias("mask"))
        return longer.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))

    rows = refine(split(fps.select("fp", F.lit(0).cast("long").alias("mask"))), ["mask", "bits"], "fp", split, LIMIT)
    dealt = rows.repartition("mask", "bits").sortWithinPartitions("mask", "bits")
    return dealt.mapInPandas(lambda f: _links(f, distance), "a long, b long")


def link(docs: DataFrame, distance: int = 2, k: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id: the smallest doc_id reachable by links between fingerprints
    that differ in ``distance`` bits at most.

    Words are lower-cased (A-Z); a text of fewer than ``k`` words is one shingle; a null or empty text, or one of white
    space, has fingerprint zero, which links like any other. Every row gives a row: equal texts, repeated rows and rows of
    one doc_id share or have their own text's fingerprint; a null doc_id names no component (null if nothing in it has
    one). An empty table gives an empty table; other columns are ignored.
    """
    made = common.with_text(docs, key, text).mapInPandas(lambda f: _fingerprints(f, k), "doc_id long, fp long")
    made = common.materialize(made, "fingerprints")
    first = common.materialize(made.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    roots = components(links(first, distance), "simhash")
    joined = first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = joined.join(least, "root").select("fp", "component_id")
    return made.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` at two differing bits, over 3-word shingles."""
    return link(common.table(spark, sf_dir, "documents"))
