"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: hashed character n-grams, weighted by their share of the text's n-grams times the inverse
document frequency over *all* training documents. Training: follow the regularised leader (per-
coordinate rates, L1 and L2 penalties) on a sample of stated size; a part of the sample held back
calibrates the temperature of the probabilities.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: log2 of the number of features; n-gram lengths; labelled documents per language in the sample.
BITS, ORDERS, SAMPLE = 16, (1, 2, 3), 600
#: Passes over the sample: until one lowers the mean log loss of the part held back by less than TOLERANCE; EPOCHS at most.
EPOCHS, TOLERANCE = 40, 0.001
#: Code points of a long text are read in pieces of this size, so memory is bounded.
PIECE = 1 << 18
_LETTER = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def features(text: str, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Counts of the hashed n-grams of the lower-cased text; white space counts as one space."""
    counts = np.zeros(1 << bits, np.int64)
    clean = " " + " ".join(text.lower().split()) + " "
    longest = max(orders)
    for at in range(0, len(clean), PIECE):
        points = np.frombuffer(clean[max(0, at - longest + 1) : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        kept = min(at, longest - 1)  # code points that belong to the piece before
        value = np.zeros(len(points), np.uint32)
        for n in range(1, longest + 1):
            value = value[: len(points) - n + 1] * np.uint32(0x9E3779B1) + points[n - 1 :] + np.uint32(n)
            if n in orders and len(value):
                code = value ^ (value >> np.uint32(15))
                code = (code * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)
                counts += np.bincount(code[max(0, kept - n + 1) :], minlength=1 << bits)
    return counts


def _frequencies(frames, bits: int, orders: tuple[int, ...]):
    """Document frequencies of one partition: a fixed number of rows whatever it holds."""
    df, n = np.zeros(1 << bits, np.int64), 0  # of one split
    for frame in frames:
        for text in frame["text"]:
            df += features(text, bits, orders) > 0
            n += 1
    at = np.flatnonzero(df)
    yield pd.DataFrame({"feature": np.r_[at, -1], "n": np.r_[df[at], n]})


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features that occur, and their TF-IDF values as a vector of length one."""
    at = np.flatnonzero(counts)
    x = counts[at] * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow the regularised leader, proximal, for multinomial logistic regression."""

    def __init__(self, n_features: int, n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.z, self.n = np.zeros((n_features, n_classes)), np.zeros((n_features, n_classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p[None, :]
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def loss(logits: np.ndarray, labels: np.ndarray, log_t: float = 0.0) -> float:
    """Mean log loss at a temperature."""
    return float(-np.log(softmax(logits / math.exp(log_t))[np.arange(len(labels)), labels] + 1e-12).mean())


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    low, high, ratio = -3.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(logits, labels, a) <= loss(logits, labels, b) else (a, high)
    return math.exp((low + high) / 2)


class Model:
    """Languages, weights, inverse document frequencies and temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray, t: float, bits: int, orders: tuple[int, ...]):
        self.langs, self.weights, self.idf, self.t, self.bits, self.orders = langs, weights.astype(np.float32), idf.astype(np.float32), t, bits, orders

    def predict(self, text: str | None) -> tuple[str, float]:
        # such runs also hold numerals and the like, as ½ or ②, which are no letters
        if text is None or not self.langs or not any(c.isalpha() for m in _LETTER.finditer(text) for c in m[0]):
            return UNDETERMINED, 0.0
        at, x = weighted(features(text, self.bits, self.orders), self.idf)
        p = softmax((x @ self.weights[at]).astype(np.float64) / self.t)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def train(labelled: DataFrame, sample: int = SAMPLE, bits: int = BITS, orders: tuple[int, ...] = ORDERS, epochs: int = EPOCHS) -> Model:
    """``labelled``: text, lang. Frequencies come from every row; weights from up to ``sample``
    distinct texts per language, those with the smallest hash: all of them if there are no more. Rows without text or
    lang teach nothing; repeated rows count in the frequencies and once in the sample; without rows no language is known."""
    size = 1 << bits
    labelled = labelled.where("text is not null and lang is not null").select("text", "lang")
    df = {r["feature"]: r["n"] for r in labelled.select("text").mapInPandas(lambda f: _frequencies(f, bits, orders), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    n = df.pop(-1, 0)
    idf = np.full(size, math.log(1 + n))
    for f, count in df.items():
        idf[f] = math.log((1 + n) / (1 + count)) + 1
    keyed = labelled.withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in keyed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((size, 1)), idf, 1.0, bits, orders)

    def vectors(frames):
        for frame in frames:
            rows = []
            for text, lang, h in zip(frame["text"], frame["lang"], frame["h"], strict=True):
                at, x = weighted(features(text, bits, orders), idf)
                rows.append((lang, h, at.astype(np.int32).tobytes(), x.astype(np.float32).tobytes()))
            yield pd.DataFrame(rows, columns=["lang", "h", "at", "x"])

    # a threshold of the hash per language keeps somewhat more than the sample, the smallest hashes of which are
    # taken; where it kept too few after all, it is raised
    share = {lang: min(1.0, (1.25 * sample + 32) / max(1, counts[lang])) for lang in langs}
    kept: dict[str, list] = {}
    low = langs
    while low:
        rule = F.lit(False)
        for lang in low:
            top = int(-(1 << 63) + (1 << 64) * share[lang]) - 1
            rule = rule | ((F.col("lang") == lang) & (F.col("h") <= F.lit(top)))
        rows = keyed.where(rule).dropDuplicates(["lang", "h"]).mapInPandas(vectors, "lang string, h long, at binary, x binary")
        kept |= {lang: [] for lang in low}
        for r in sorted(rows.collect(), key=lambda r: (r["h"], r["lang"])):
            if len(kept[r["lang"]]) < sample:
                kept[r["lang"]].append((np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32).astype(np.float64)))
        low = [lang for lang in low if len(kept[lang]) < sample and share[lang] < 1]
        share |= {lang: min(1.0, 4 * share[lang]) for lang in low}
    held, used = [], []
    for k, lang in enumerate(langs):
        for i, (at, x) in enumerate(kept[lang]):
            (held if i % 5 == 4 else used).append((at, x, k))
    truth = np.array([k for _, _, k in held], np.int64)
    order = np.random.default_rng(7)
    model, before = Ftrl(size, len(langs)), math.inf
    for _ in range(epochs):
        for i in order.permutation(len(used)):
            model.learn(*used[i])
        logits = np.array([x @ model.weights(at) for at, x, _ in held or used])
        now = loss(logits, truth if held else np.array([k for _, _, k in used], np.int64))
        if now > before - TOLERANCE:
            break
        before = now
    t = temperature(logits, truth) if held else 1.0
    return Model(langs, model.weights(), idf, t, bits, orders)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability). Only the text is looked at: ``und`` with score
    0 if it is null or has no letter. Rows are predicted one by one, so repeated ones agree; an empty
    table gives an empty table; other columns are ignored."""

    def run(frames):
        for frame in frames:
            made = [model.predict(text) for text in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "lang_pred": [m[0] for m in made], "score": [m[1] for m in made]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The same columns, of the rows whose language can be told with this probability or more. Rows are
    filtered where they are; nothing is shuffled."""

    def run(batches):
        for batch in batches:
            told = [model.predict(text) for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in told], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    """The documents that nothing is learnt from."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
