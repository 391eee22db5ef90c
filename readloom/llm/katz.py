"""Katz backoff language model of word n-grams, with Good-Turing discounts and exactly normalised weights.

P(w | u v) is the discounted share of the n-gram among those of its context if training has it, and else the backoff
weight of the context times P(w | v), down to the discounted share of w alone, where words that training lacks are one
class. Discounts are Good-Turing's: Turing's estimate for small counts, and for the rest (and where that one cannot be
used) a straight line through the logarithms of the counts of counts, so every count is discounted a little and every
context has something left for what it lacks.

Counts are kept in tables dealt by ranges of the n-gram's hash. Texts go through in batches of bounded size, order by order:
a batch asks each range for its own n-grams, once each however often they occur, and gets their counts back in the order
asked, so neither a frequent word nor a frequent n-gram gathers in one task, and no vocabulary is ever broadcast. N-grams
whose count follows from that of a shorter part are not asked for: one with a part that occurs once occurs at most
once. Of every n-gram one batch is the owner; it adds it to its context's sums, from which the weights come, for
contexts that texts outside of training have at all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64, mix

#: Words of the longest n-grams; code points of text in a batch; n-grams that a range gets, about.
ORDER, BATCH, ENTRIES = 3, 4_000_000, 1_200_000
#: Counts up to K have Turing's discount, if it can be used; the line is drawn through counts of counts up to FIT.
K, FIT = 5, 20
END = U64(0x5BD1E995A3C59AC3)
_MUL = U64(0x9E3779B97F4A7C15)
_Z = zstandard.ZstdCompressor(level=3)


def _starts(order: int) -> list[np.uint64]:
    """Keys of the contexts at the beginning of a text, by their number of words (the first is not used)."""
    start = np.array([0x2545F4914F6CDD1D], U64)
    out = [start, start]
    for _ in range(order):
        out.append(mix(out[-1] * _MUL + mix(start)))
    return [x[0] for x in out]


def pack(a: np.ndarray, ascending: bool = True) -> bytes:
    """Compressed, bytes of like weight together; sorted hashes as differences."""
    if a.dtype == U64 and ascending and len(a):
        a = np.r_[a[:1], np.diff(a)]
    return _Z.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unpack(data: bytes, kind, ascending: bool = True) -> np.ndarray:
    size = np.dtype(kind).itemsize
    a = np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(a, dtype=U64) if kind is U64 and ascending else a


def _batches(frames):
    """Texts of a split as batches: hashes of the words, local numbers of all tokens."""
    hasher = common.WordHash(150_000)
    part = TaskContext.get().partitionId()
    held: list[tuple] = []
    size = number = 0

    def done():
        hashes = [np.r_[hasher(common.words(t)), END] for _, t, _ in held]
        vocabulary, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        docs = np.array([0 if d is None else int(d) for d, _, _ in held], np.int64)
        flags = np.array([t | (d is None) << 1 for d, _, t in held], np.uint8)
        return pd.DataFrame([((part << 32) + number, pack(docs), pack(flags), pack(np.array([len(h) for h in hashes], np.int32)), pack(tokens.astype(np.int32)), pack(vocabulary), len(tokens), len(vocabulary), int((flags & 1).sum()))], columns=["batch", "docs", "flags", "lengths", "tokens", "words", "n_tokens", "n_words", "n_train"])

    for frame in frames:
        for row in zip(frame["doc_id"], frame["text"], frame["train"], strict=True):
            held.append(row)
            size += len(row[1])
            if size >= BATCH:
                yield done()
                held, size, number = [], 0, number + 1
    if held:
        yield done()


class Batch:
    """A batch's tokens and its different n-grams of each order: their keys (sorted), the number of each token's n-gram
    among them, and of each n-gram its context (-1 at the beginning of a text) and the n-gram without its first word,
    as numbers of the order below. Counts and flags are filled in order by order."""

    def __init__(self, row, order: int, n_docs: int):
        flags = unpack(row.flags, np.uint8)
        self.docs, self.train, self.null = unpack(row.docs, np.int64), (flags & 1) > 0, flags > 1
        self.lengths, self.n_docs = unpack(row.lengths, np.int32), n_docs
        tokens, words = unpack(row.tokens, np.int32), unpack(row.words, U64)
        self.doc = np.repeat(np.arange(len(self.docs), dtype=np.int32), self.lengths)
        self.trained = self.train[self.doc]
        first = np.zeros(len(tokens), bool)
        first[np.cumsum(self.lengths) - self.lengths] = True
        self.keys, self.gram, self.context, self.shorter = [None, words], [None, tokens], [None, None], [None, None]
        starts, word = _starts(order), mix(words)
        for k in range(2, order + 1):
            before = np.r_[np.int32(-1), self.gram[k - 1][:-1]]
            before[first] = -1
            key = mix(np.r_[self.keys[k - 1], starts[k - 1]][before] * _MUL + word[tokens])
            keys, at, gram = np.unique(key, return_index=True, return_inverse=True)
            self.keys.append(keys)
            self.gram.append(gram.astype(np.int32))
            self.context.append(before[at])
            self.shorter.append(self.gram[k - 1][at])
        self.counts, self.held, self.own = [None], [None], [None]
        answers = sorted(row.answers if row.answers is not None else [], key=lambda t: (t["level"], t["range"]))
        for k in range(1, order + 1):
            mine = [t for t in answers if t["level"] == k]
            if not mine:
                break
            self._fill(k, mine)

    def local(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Training counts within the batch, and which n-grams texts outside of training have."""
        n = len(self.keys[k])
        return np.bincount(self.gram[k], self.trained, n).astype(np.int64), np.bincount(self.gram[k], ~self.trained, n) > 0

    def parts(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts and flags of the contexts and of the n-grams without their first word."""
        counts, held = np.r_[self.counts[k - 1], self.n_docs], np.r_[self.held[k - 1], True]
        return counts[self.context[k]], held[self.context[k]], counts[self.shorter[k]], held[self.shorter[k]]

    def asked(self, k: int) -> np.ndarray:
        """Which n-grams another batch may have as well. With a part that training has once, the n-gram is there once
        at most; so where it is here, only texts outside of training may ask for it, and these have both parts."""
        if k == 1:
            return np.ones(len(self.keys[1]), bool)
        counts, _ = self.local(k)
        c1, h1, c2, h2 = self.parts(k)
        least = np.minimum(c1, c2)
        return np.where(counts > 0, (least > 1) | (h1 & h2), least > 0)

    def _fill(self, k: int, answers: list) -> None:
        counts, held = self.local(k)
        own, asked = counts > 0, self.asked(k)
        told = [unpack(t["told"], U64, False).astype(np.int64) for t in answers]
        counts[asked] = np.concatenate(told)
        for flags, column in ((held, "held"), (own, "own")):
            flags[asked] = np.concatenate([np.unpackbits(np.frombuffer(t[column], np.uint8), count=len(n)) > 0 for t, n in zip(answers, told, strict=True)])
        self.counts.append(counts)
        self.held.append(held)
        self.own.append(own)


def _segments(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """Sorted keys cut into equal ranges of hashes: range, begin and end of those that have any."""
    width = (1 << 64) // ranges + 1
    cuts = np.searchsorted(keys, np.array([min(i * width, (1 << 64) - 1) for i in range(1, ranges)], U64))
    return [(i, a, b) for i, (a, b) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True)) if b > a]


def _ask(frames, level: int, ranges: int, n_docs: int):
    """N-grams of each batch by range; besides, under range -1, how many it has in training that no other can have."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            batch = Batch(row, level, n_docs)
            asked = batch.asked(level)
            counts, held = batch.local(level)
            alone = np.array([int(((counts > 0) & ~asked).sum())], U64)
            keys, counts, held = batch.keys[level][asked], counts[asked].astype(U64), held[asked]
            yield pd.DataFrame([(-1, row.batch, None, pack(alone), None)] + [(i, row.batch, pack(keys[a:b]), pack(counts[a:b], False), np.packbits(held[a:b]).tobytes()) for i, a, b in _segments(keys, ranges)], columns=["range", "batch", "keys", "counts", "held"])


def _totals(frame: pd.DataFrame, level: int) -> pd.DataFrame:
    """Of one range: each batch's n-grams with their totals, which of them texts outside of training have, and which
    the batch owns; besides, in a row without batch, how many n-grams have each count up to FIT."""
    if frame["range"].iloc[0] < 0:
        alone = sum(int(unpack(b, U64)[0]) for b in frame["counts"])
        return pd.DataFrame([(level, -1, -1, None, None, None, [alone, alone, alone, *[0] * (FIT - 1)])], columns=["level", "range", "batch", "told", "held", "own", "stats"])
    frame = frame.sort_values("batch")
    parts = [unpack(b, U64) for b in frame["keys"]]
    sizes = [len(p) for p in parts]
    counts = np.concatenate([unpack(b, U64, False) for b in frame["counts"]]).astype(np.int64)
    held = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(frame["held"], sizes, strict=True)])
    _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    n = int(inverse.max()) + 1
    sums = np.zeros(n, np.int64)
    np.add.at(sums, inverse, counts)  # whole numbers throughout
    any_held = np.bincount(inverse, held, n) > 0
    trained = np.flatnonzero(counts > 0)  # the owner is the first batch that training has it in
    own = np.zeros(len(counts), bool)
    own[trained[np.unique(inverse[trained], return_index=True)[1]]] = True
    cuts = np.cumsum(sizes)[:-1]
    told, flags, owned = np.split(sums[inverse].astype(U64), cuts), np.split(any_held[inverse], cuts), np.split(own, cuts)
    key = frame["range"].iloc[0]
    rows = [(level, key, batch, pack(t, False), np.packbits(h).tobytes(), np.packbits(o).tobytes(), None) for batch, t, h, o in zip(frame["batch"], told, flags, owned, strict=True)]
    stats = [int(sums.sum()), int((sums > 0).sum()), *np.bincount(sums[(sums > 0) & (sums <= FIT)], minlength=FIT + 1)[1:].tolist()]
    return pd.DataFrame([*rows, (level, key, -1, None, None, None, stats)], columns=["level", "range", "batch", "told", "held", "own", "stats"])


def _totals_of(level: int):
    return lambda frame: _totals(frame, level)


class Discount:
    """Good-Turing discount ratios r* / r from how many n-grams have each count from 1 to FIT."""

    def __init__(self, numbers: list[int]):
        n = np.array([0, *numbers], float)
        r = np.flatnonzero(n)
        slope = np.polyfit(np.log(r), np.log(n[r]), 1)[0] if len(r) > 1 else -2.0
        self.slope = min(float(slope), -1.1)  # a flatter line would not discount
        self.small = self.line(np.arange(1, K + 1))
        for i in range(1, K + 1):
            turing = (i + 1) * n[i + 1] / (i * n[i]) if n[i] else 0.0
            if 0 < turing < 1:
                self.small[i - 1] = turing

    def line(self, r: np.ndarray) -> np.ndarray:
        return (1 + 1 / r) ** (self.slope + 1)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        r = np.maximum(counts, 1)
        return np.where(counts > 0, counts * np.where(r <= K, self.small[np.minimum(r, K) - 1], self.line(r)), 0.0)


class Model:
    """The few numbers that all tasks need: totals, and discounts by order (from 1; the first is not used)."""

    def __init__(self, tokens: int, types: int, docs: int, numbers: list[list[int]]):
        self.tokens, self.types, self.docs = tokens, types, docs
        self.discount = [None, *map(Discount, numbers)]
        self.unknown = 1.0  # the class of words that training lacks, as a whole

    def word(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discount[1](counts) / max(self.tokens, 1), self.unknown)


def _word_mass(frames, discount: Discount):
    """Discounted counts of all words, each added up by its owner."""
    for frame in frames:
        total = 0.0
        for told, own in zip(frame["told"], frame["own"], strict=True):
            counts = unpack(told, U64, False).astype(np.int64)
            total += float(discount(counts[np.unpackbits(np.frombuffer(own, np.uint8), count=len(counts)) > 0]).sum())
        yield pd.DataFrame({"mass": [total]})


_SCORED = ["kind", "level", "range", "batch", "keys", "left", "other", "rows", "times", "row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "plain"]
#: Contexts whose sums a task holds before it gives them out.
HELD = 1_000_000


class Sums:
    """Sums of contexts over the batches of a task: of each, what its followers' discounts leave, as a share of the context,
    and the share that the followers have among shorter contexts. The former is a sum of small parts, so nothing cancels; the
    latter is subtracted from one, so it is carried in double precision."""

    def __init__(self, ranges: list[int]):
        self.ranges, self.parts, self.size = ranges, {}, 0

    def add(self, level: int, keys: np.ndarray, left: np.ndarray, other: np.ndarray) -> None:
        self.parts.setdefault(level, []).append((keys, left, other))
        self.size += len(keys)

    def rows(self) -> list[tuple]:
        out = []
        for level, parts in self.parts.items():
            keys, left, other = map(np.concatenate, zip(*parts, strict=True))
            keys, inverse = np.unique(keys, return_inverse=True)
            left, other = np.bincount(inverse, left, len(keys)).astype(np.float32), np.bincount(inverse, other, len(keys))
            out += [(1, level, i, None, pack(keys[a:b]), pack(left[a:b]), pack(other[a:b]), *[None] * 9) for i, a, b in _segments(keys, self.ranges[level])]
        self.parts, self.size = {}, 0
        return out


def _score(frames, model: Model, ranges: list[int]):
    """Three kinds of rows. 1: of the n-grams that a task's batches own, their contexts' sums, by range of the context.
    2: contexts whose weights documents need, by range. 0: documents, with scores without the weights."""
    starts = _starts(ORDER)
    sums = Sums(ranges)

    def frame_of(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_SCORED).astype({c: "Int64" for c in ("kind", "level", "range", "batch", "row", "doc_id", "n_tokens", "n_known")} | {"held_out": "boolean"})

    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            batch = Batch(row, ORDER, model.docs)
            words = batch.counts[1]
            shares = model.word(words)
            plain = np.log10(shares)[batch.gram[1]]
            for k in range(2, ORDER + 1):
                counts, gram = batch.counts[k], batch.gram[k]
                context, held, _, _ = batch.parts(k)
                discounted = model.discount[k](counts)
                longer = discounted / np.maximum(context, 1)
                names = np.r_[batch.keys[k - 1], starts[k - 1]]
                own = np.flatnonzero(batch.own[k] & (counts > 0) & held)
                used, inverse = np.unique(batch.context[k][own] % len(names), return_inverse=True)
                left = np.bincount(inverse, (counts[own] - discounted[own]) / context[own], len(used))
                sums.add(k, names[used], left, np.bincount(inverse, shares[batch.shorter[k][own]], len(used)))
                seen = counts[gram] > 0
                plain = np.where(seen, np.log10(np.where(seen, longer[gram], 1.0)), plain)
                need = np.flatnonzero(~seen & (context[gram] > 0))  # only in texts outside of training
                code = (batch.context[k][gram[need]] % len(names)).astype(np.int64) * len(batch.docs) + batch.doc[need]
                code, times = np.unique(code, return_counts=True)
                name, rows = names[code // max(1, len(batch.docs))], code % max(1, len(batch.docs))
                order = np.argsort(name, kind="stable")
                name, rows, times = name[order], rows[order], times[order]
                out += [(2, k, i, row.batch, pack(name[a:b]), None, None, pack(rows[a:b].astype(np.int32)), pack(times[a:b].astype(np.int32)), *[None] * 7) for i, a, b in _segments(name, ranges[k])]
                shares = longer
            score = np.bincount(batch.doc, plain, len(batch.docs))
            base = np.bincount(batch.doc, np.log10((words[batch.gram[1]] + 1) / (model.tokens + model.types + 1)), len(batch.docs))
            known = np.bincount(batch.doc, words[batch.gram[1]] > 0, len(batch.docs))
            out += [
                (0, None, None, row.batch, *[None] * 5, i, None if batch.null[i] else d, not batch.train[i], int(batch.lengths[i]), int(known[i]), float(base[i]), float(score[i]))
                for i, d in enumerate(batch.docs.tolist())
            ]
            if sums.size >= HELD:
                out += sums.rows()
        yield frame_of(out)
    yield frame_of(sums.rows())


def _weights(key, sums: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Of one range: log weights of the contexts asked for, times how often each document needs them; a row a batch."""
    if not len(asked):
        return pd.DataFrame(columns=["batch", "rows", "values"]).astype({"batch": "int64"})
    value = np.concatenate([np.empty(0, U64), *[unpack(b, U64) for b in sums["keys"]]])
    left, other = (np.concatenate([np.empty(0, kind), *[unpack(b, kind) for b in sums[c]]]) for c, kind in (("left", np.float32), ("other", np.float64)))
    names, inverse = np.unique(value, return_inverse=True)
    left, other = np.bincount(inverse, left, len(names)), np.bincount(inverse, other, len(names))
    weight = np.log10(np.maximum(left, 1e-12) / np.maximum(1 - other, 1e-12))
    out = []
    for batch, keys, rows, times in zip(*(asked[f"a_{c}"] for c in ("batch", "keys", "rows", "times")), strict=True):
        at = np.searchsorted(names, unpack(keys, U64))  # every context that training has is there, as texts outside of it have it too
        row, where = np.unique(unpack(rows, np.int32), return_inverse=True)
        out.append((batch, row.tobytes(), np.bincount(where, weight[at] * unpack(times, np.int32), len(row)).tobytes()))
    return pd.DataFrame(out, columns=["batch", "rows", "values"])


def _backoff(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one batch: the sum of all weights of each document."""
    rows = np.concatenate([np.frombuffer(b, np.int32) for b in frame["rows"]])
    values = np.concatenate([np.frombuffer(b, np.float64) for b in frame["values"]])
    row, where = np.unique(rows, return_inverse=True)
    return pd.DataFrame({"batch": frame["batch"].iloc[0], "row": row.astype(np.int64), "backoff": np.bincount(where, values, len(row))})


def score(docs: DataFrame, train: Column) -> DataFrame:
    """Log10 probabilities of all texts: doc_id, held_out (not ``train``), n_tokens, n_known, train_tokens,
    base_score (add-one word model), score (this model).

    ``train`` picks the documents that counts come from; null is no. Null and empty texts are the end token alone. Every
    row is a document of its own, whatever its doc_id, null included, so rows that repeat count in training each. Without
    training documents all words are unknown. An empty table gives an empty table; other columns are ignored. N-grams
    go by 64-bit hashes of their words; what contexts leave is carried in single precision, so weights are exact to about 1e-7.
    """
    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    fields = "batch long, docs binary, flags binary, lengths binary, tokens binary, words binary, n_tokens long, n_words long, n_train long"
    batches = common.materialize(texts.mapInPandas(_batches, fields), "batches")
    size = batches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_words", "n_train")]).first()
    n_docs = size["n_train"]
    ranges = [0, 4 + int(size["n_words"] / ENTRIES), *[8 + int(size["n_tokens"] / ENTRIES / 2)] * (ORDER - 1)]

    answer = "level int, range long, batch long, told binary, held binary, own binary, stats array<long>"
    struct = F.struct("level", "range", "told", "held", "own")
    answers, numbers, tables = None, [], [batches]
    for k in range(1, ORDER + 1):
        if answers is None:
            known = batches.withColumn("answers", F.lit(None).cast("array<struct<level:int,range:bigint,told:binary,held:binary,own:binary>>"))
        else:
            known = batches.join(answers.where("batch >= 0").groupBy("batch").agg(F.collect_list(struct).alias("answers")), "batch", "left")
        asked = known.mapInPandas(lambda f, k=k: _ask(f, k, ranges[k], n_docs), "range long, batch long, keys binary, counts binary, held binary")
        made = common.materialize(asked.groupBy("range").applyInPandas(_totals_of(k), answer), f"counts{k}")
        stats = made.where("batch = -1").agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(f"s{i}") for i in range(FIT + 2)]).first()
        numbers.append(list(stats)[2:])
        if k == 1:
            tokens, types = stats[0], stats[1]
        answers = made if answers is None else answers.unionByName(made)
        tables.append(made)
    model = Model(tokens, types, n_docs, numbers)
    if tokens:
        mass = answers.where("level = 1 and batch >= 0").select("told", "own").mapInPandas(lambda f: _word_mass(f, model.discount[1]), "mass double").agg(F.sum("mass")).first()[0]
        model.unknown = 1 - mass / tokens

    known = batches.join(answers.where("batch >= 0").groupBy("batch").agg(F.collect_list(struct).alias("answers")), "batch", "left")
    above = [0, 0, *ranges[1:]]  # contexts are dealt as the n-grams that they are
    schema = "kind int, level int, range long, batch long, keys binary, left binary, other binary, rows binary, times binary, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, plain double"
    scored = common.materialize(known.mapInPandas(lambda f: _score(f, model, above), schema), "scored")
    del known, answers, asked, made
    common.discard(*tables)  # all that follows reads the scores alone
    sums = scored.where("kind = 1").select("level", "range", "keys", "left", "other")
    wanted = scored.where("kind = 2").select(*[F.col(c).alias(f"a_{c}") for c in ("level", "range", "batch", "keys", "rows", "times")])
    backoff = sums.groupBy("level", "range").cogroup(wanted.groupBy("a_level", "a_range")).applyInPandas(_weights, "batch long, rows binary, values binary").groupBy("batch").applyInPandas(_backoff, "batch long, row long, backoff double")
    done = scored.where("kind = 0").join(backoff, ["batch", "row"], "left")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", (F.col("plain") + F.coalesce("backoff", F.lit(0.0))).alias("score"))


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """All texts of ``documents``, learning from those whose crc32(doc_id) mod 7 is not 2."""
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
