"""Benchmark decontamination: BM25 with block-max WAND over test items, then overlap checks.

The index is built from the test items, which are few beside the corpus; every passage of every document is a query. A
score is the share of the item's own BM25 score (that of its whole text), so that one threshold serves items of any
length. Document frequencies, mean length and the width of passages are those of all items, also where the index is
searched in several parts.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Text bytes of the items in one part of the index; each part is a pass over the documents of its own.
SHARD_BYTES = 8 << 20
#: Items in a block; words of documents that are searched at once.
ITEMS, CHUNK = 16, 200_000


class BlockMaxIndex:
    """Inverted lists by term, with the largest impact of each list and of each of its blocks (of ITEMS neighbouring
    items). ``df``, ``n`` and ``mean``: document frequencies, number and mean length of all items, of which these may
    be a part; their own where not given."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int] | None = None, n: int | None = None, mean: float | None = None, k1: float = 0.9, b: float = 0.4):
        self.ids = [i for i, _ in items]
        self.words = [common.words(text or "") for _, text in items]
        count = [Counter(ws) for ws in self.words]
        df = Counter(t for c in count for t in c) if df is None else df
        n = len(items) if n is None else n
        mean = sum(map(len, self.words)) / max(1, len(items)) if mean is None else mean
        self.term = {t: k for k, t in enumerate(dict.fromkeys(t for c in count for t in c))}
        term, item, impact = [], [], []
        for i, c in enumerate(count):
            norm = k1 * (1 - b + b * len(self.words[i]) / max(1.0, mean))
            values = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * m * (k1 + 1) / (m + norm) for t, m in c.items()}
            own = sum(values.values())
            for t, v in values.items():
                term.append(self.term[t])
                item.append(i)
                impact.append(v / own)
        term, item, impact = np.array(term, np.int64), np.array(item, np.int64), np.array(impact, np.float64)
        order = np.lexsort((item, term))
        #: Postings by term, then item, and where each term's begin.
        self.items, self.impacts = item[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(len(self.term) + 1))
        self.codes = term[order] * max(1, len(items)) + self.items
        self.most = np.maximum.reduceat(self.impacts, self.starts[:-1]) if len(self.term) else np.zeros(0)
        #: Block maxima by term and block.
        self.blocks = max(1, -(-len(items) // ITEMS))
        self.block_codes, at = np.unique(term[order] * self.blocks + self.items // ITEMS, return_index=True)
        self.block_most = np.maximum.reduceat(self.impacts, at) if len(at) else np.zeros(0)
        #: What searches did: postings of the queries' terms, those read to find candidates, candidates met, those
        #: whose block could reach the threshold, and postings probed for these.
        self.counters = Counter()

    def _look(self, codes: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(codes))
        at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
        return np.where(table[at] == codes, values[at], 0.0)

    def search(self, query: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, item and score of all items that score ``threshold`` or more. The distinct terms of many queries come
        as pairs, sorted by query.

        Block-max WAND for a threshold that stands from the start, all queries at once. Of the terms by largest impact,
        those whose maxima add up to less than half the threshold are only probed: an item must reach the other half by
        the rest, the lists that hold pivots. Of these lists every posting is met; the sum of an item's impacts there
        and of the maxima of the probed lists must reach the threshold, then so must the sum with the maxima of its own
        block; only then are the probed lists read at the item.
        """
        slack = threshold - 1e-9
        length = self.starts[term + 1] - self.starts[term]
        order = np.lexsort((self.most[term], query))
        query, term, length = query[order], term[order], length[order]
        total = np.cumsum(self.most[term])
        first = np.searchsorted(query, query)  # where the query's terms begin
        total = total - np.where(first > 0, total[first - 1], 0.0)
        probed = total < slack / 2
        q, t, n = query[~probed], term[~probed], length[~probed]
        at = np.repeat(self.starts[t] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        pair, inverse = np.unique(np.repeat(q, n) * max(1, len(self.ids)) + self.items[at], return_inverse=True)
        score = np.bincount(inverse, self.impacts[at], len(pair))
        q, item = pair // max(1, len(self.ids)), pair % max(1, len(self.ids))
        # what the probed lists of a query can add at most
        starts = np.searchsorted(query, q)
        n_probed = np.cumsum(np.r_[0, probed])
        n_probed = n_probed[np.searchsorted(query, q, "right")] - n_probed[starts]
        rest = np.where(n_probed > 0, total[np.maximum(starts + n_probed - 1, 0)], 0.0)
        self.counters.update({"postings": int(length.sum()), "met": len(at), "candidates": len(pair)})
        live = score + rest >= slack
        q, item, score, starts, n_probed = q[live], item[live], score[live], starts[live], n_probed[live]
        owner = np.repeat(np.arange(len(q)), n_probed)
        terms = term[np.repeat(starts - np.r_[0, np.cumsum(n_probed)[:-1]], n_probed) + np.arange(n_probed.sum())]
        bound = score + np.bincount(owner, self._look(terms * self.blocks + item[owner] // ITEMS, self.block_codes, self.block_most), len(q))
        live = bound >= slack
        self.counters.update({"blocks": int(live.sum()), "probed": int(live[owner].sum())})
        owner, terms = owner[live[owner]], terms[live[owner]]
        score = score + np.bincount(owner, self._look(terms * max(1, len(self.ids)) + item[owner], self.codes, self.impacts), len(q))
        live = score >= slack
        return q[live], item[live], score[live]


def _grams(ws: list[bytes], n: int = 3) -> set[tuple]:
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer: the answer is the last line, else the last sentence, if it
    has three words, else the last fifth of the words, three at least."""
    ws = common.words(text)
    for cut in ("\n", ". ", "? ", "! "):
        head, _, tail = text.strip().rpartition(cut)
        if common.words(head) and len(common.words(tail)) >= 3:
            return common.words(head + cut.strip()), common.words(tail)
    n = max(min(3, len(ws)), len(ws) // 5)
    return ws[: len(ws) - n], ws[len(ws) - n :]


def _scan(frames, items: list[tuple[int, str]], df: dict[bytes, int], n: int, mean: float, width: int, threshold: float, overlap: float):
    index = BlockMaxIndex(items, df, n, mean)
    parts = [tuple((min(3, len(p)), _grams(p)) for p in question_answer(text or "")) for _, text in items]
    get, step = index.term.get, width // 2

    def done(held: list[tuple]) -> list[tuple]:
        """Of some documents: each passage is two half windows, or less at the end."""
        sizes = np.array([len(ws) for _, ws in held])
        known = np.fromiter((get(w, -1) for _, ws in held for w in ws), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(held)), sizes)
        word = np.arange(len(known)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        passages = np.maximum(1, -(-(sizes - step) // step))
        before = np.cumsum(passages) - passages
        last = np.minimum(word // step, passages[doc] - 1)
        code = [before[doc] + last, before[doc] + np.maximum(word // step - 1, 0)]
        pairs = np.concatenate([c[known >= 0] for c in code]) * max(1, len(index.term)) + np.concatenate([known[known >= 0]] * 2)
        pairs = np.unique(pairs)
        out = []
        best: dict[tuple, tuple] = {}
        where = np.searchsorted(before, np.arange(int(passages.sum())), "right") - 1
        for passage, item, score in zip(*(x.tolist() for x in index.search(pairs // max(1, len(index.term)), pairs % max(1, len(index.term)), threshold)), strict=True):
            d = int(where[passage])
            start = (passage - int(before[d])) * step
            window = held[d][1][start : start + width]
            question, answer = (len(p & _grams(window, n)) / len(p) if p else 1.0 for n, p in parts[item])
            if question >= overlap and answer >= overlap and ((d, item) not in best or score > best[d, item][0] + 1e-12):
                best[d, item] = (score, start, question, answer)
        out += [(held[d][0], index.ids[i], *v) for (d, i), v in best.items()]
        return out

    for frame in frames:
        rows, held, size = [], [], 0
        for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"], strict=True):
            ws = common.words(text)
            if ws:
                held.append((doc_id, ws))
                size += len(ws)
            if size >= CHUNK:
                rows += done(held)
                held, size = [], 0
        if held:
            rows += done(held)
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "passage_start", "question_overlap", "answer_overlap"]).astype({"doc_id": "Int64", "item_id": "Int64"})


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """Pairs of document and test item that leaks into it: doc_id, item_id, score (share of the item's
    own BM25 score in the best passage, 0 to 1; of equal ones the first), passage_start (its first word),
    question_overlap and answer_overlap (shares of 3-word sequences; both at least ``overlap``).

    Passages are windows of twice the longest item, by half their width, over the whole text. Null and
    empty texts have no passages, null and empty items no terms. Rows that repeat a doc_id, or have none, give rows of
    their own; items of equal text are found alike, and an item_id may be null. Empty tables give an empty table; other
    columns are ignored. Nothing of the documents is shuffled; the items of one part, of a checked size, go to every
    task. Statistics are those of all items, so the number of parts changes no score.
    """
    return _found(common.with_text(docs), benchmark, threshold, overlap)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows and columns, without the rows that hold a test item. Each row is judged by its own text, whatever its
    doc_id, null included; columns may have any names."""
    row = common.fresh(docs, "_row")
    keyed = docs.withColumn(row, common.row_key(F.col(key).cast("long"), F.col(text)))
    found = _found(keyed.select(F.col(row).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), benchmark, threshold, overlap)
    return keyed.join(found.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(*docs.columns)


def _found(docs: DataFrame, benchmark: DataFrame, threshold: float, overlap: float) -> DataFrame:
    """What leaks() gives, of documents with a doc_id and a text that is not null."""
    schema = "doc_id long, item_id long, score double, passage_start long, question_overlap double, answer_overlap double"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = F.array_remove(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x20\\x09-\\x0D]+"), "")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("bytes"), F.count("*").alias("n"), F.coalesce(F.avg(F.size(parts)), F.lit(0.0)).alias("mean"), F.coalesce(F.max(F.size(parts)), F.lit(0)).alias("longest")).first()
    shards = max(1, -(-size["bytes"] // SHARD_BYTES))
    width = max(64, 2 * size["longest"])
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).alias("shard")
    terms = items.select(shard, F.explode(F.array_distinct(parts)).alias("term"))
    counted = terms.groupBy("term").agg(F.count("*").alias("n"))
    if shards > 1:
        counted = common.materialize(counted, "frequencies")
    out = None
    for k in range(shards):
        held = [(r["item_id"], r["text"]) for r in items.where(shard == k).orderBy("item_id", "text").collect()]
        own = counted if shards == 1 else counted.join(terms.where(F.col("shard") == k).select("term").distinct(), "term", "left_semi")
        df = {r["term"].encode("utf-8", "surrogatepass"): r["n"] for r in own.collect()}
        found = docs.mapInPandas(lambda f, held=held, df=df: _scan(f, held, df, size["n"], size["mean"], width, threshold, overlap), schema)
        if shards > 1:  # so that the driver holds one part at a time
            found = common.materialize(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return out


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Leaks of ``benchmark`` into ``documents``."""
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
