"""Spelling variants: words one letter apart, found with bit-sliced position indexes.

1. Words are counted in a pass over all texts.
2. For two words that differ by one letter, the shorter of m letters, either the first half of m agrees or the last
   half. So each word goes into groups by its halves, for m its own length and one less. Groups that are too large are split
   by halves of what lies between the ends that agree: when one letter is left, a group has few members. A pair that
   agrees in both halves counts in the group of first halves alone.
3. In a group, an index has a bitset over its words for each position and letter. A word is looked up by recurrences on these
   sets, a letter at a time: the words that agree so far, and those one error off, the error being a replaced letter
   (positions aligned), one too many (shifted back) or one too few (shifted on). Words are numbered by falling count, so
   the first bit of the result is the form.
4. Forms are followed to the last by doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .pigeonhole import refine

#: One run in how many has a letter deleted; letters of a word at least; occurrences at least; how many times the word's a form's are.
NOISE, LETTERS, OCCURRENCES, RATIO = 31, 7, 2, 10
#: Words in a group; a group that knows all but one letter has a word for each letter, or two letters, at most.
LIMIT = 1 << 13
#: Words that a task counts before it hands them on.
HELD = 200_000


def thinned(run: str, checksum: int) -> str:
    """The run, or in one case of NOISE without one letter."""
    if checksum % NOISE:
        return run
    i = checksum % len(run)
    return run[:i] + run[i + 1 :]


def _counts(frames):
    """Words of texts with their numbers, as far as a task has seen."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{LETTERS},}}")
    total: Counter[str] = Counter()

    def out() -> pd.DataFrame:
        frame = pd.DataFrame({"word": list(total), "n": list(total.values())}).astype({"n": "int64"})
        total.clear()
        return frame

    for frame in frames:
        for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
            lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            start = zlib.crc32(f"{doc_id}:".encode())
            for run, n in Counter(runs.findall(lower)).items():
                word = thinned(run, zlib.crc32(run.encode(), start))
                if len(word) >= LETTERS:
                    total[word] += n
            if len(total) >= HELD:
                yield out()
    if total:
        yield out()


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of all words of enough letters and occurrences."""
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    counts = rows.mapInPandas(_counts, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


class PositionIndex:
    """Bitsets over words by position and letter."""

    def __init__(self, words: list[str]):
        self.letters: list[dict[str, int]] = [{} for _ in range(max(map(len, words), default=0) + 1)]
        self.lengths: dict[int, int] = {}
        for k, word in enumerate(words):
            for sets, letter in zip(self.letters, word):  # noqa: B905 - there are as many sets as the longest word has letters, and more
                sets[letter] = sets.get(letter, 0) | 1 << k
            self.lengths[len(word)] = self.lengths.get(len(word), 0) | 1 << k
        self.everything = (1 << len(words)) - 1

    def near(self, word: str, differ: int = 0) -> tuple[int, int, int]:
        """The words that differ from this one by a letter replaced, by one of its letters deleted, and by one inserted.
        differ: leaves out words that agree with it in so many first letters (0: none)."""
        letters, none = self.letters, {}
        at = lambda i, c: (letters[i] if i < len(letters) else none).get(c, 0)
        same, replaced, shorter, longer = self.everything, 0, 0, self.everything
        agreeing = 0
        for i, c in enumerate(word):
            here = at(i, c)
            shorter = shorter & at(i - 1, c) | same if i else same
            replaced = replaced & here | same & ~here
            same &= here
            longer = longer & at(i + 1, c) | same
            if i + 1 == differ:
                agreeing = same
        n, sets = len(word), self.lengths
        keep = ~agreeing
        return replaced & sets.get(n, 0) & keep, shorter & sets.get(n - 1, 0) & keep, longer & sets.get(n + 1, 0) & keep


def _group(m: int, p: int, s: int, rows: list[tuple[str, str, int]]) -> list[tuple[str, int, str, int]]:
    """Of one group, of words that agree in p first and s last letters: word, number of near words, the commonest of these
    with its count. Only what lies between the ends is compared. Where last letters agree, pairs that agree in all m - s
    letters before them are left to a group of first letters."""
    if len(rows) < 2:
        return []
    rows.sort(key=lambda r: (-r[2], r[0]))
    short, index, out = m - p - s, PositionIndex([middle for _, middle, _ in rows]), []
    for word, middle, _ in rows:
        replaced, shorter, longer = index.near(middle, short if s else 0)
        found = replaced | longer if len(middle) == short else shorter
        if found:
            best = rows[(found & -found).bit_length() - 1]
            out.append((word, found.bit_count(), best[0], best[2]))
    return out


def _near(frames):
    """Rows come sorted by group."""
    last, held = None, []

    def done(out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["word", "near", "best", "best_n"])

    for frame in frames:
        out = []
        for m, p, s, ends, word, middle, n in zip(*(frame[c].tolist() for c in ("m", "p", "s", "ends", "word", "middle", "n")), strict=True):
            key = (m, p, s, ends)
            if key != last:
                if len(held) > 1:
                    out += _group(*last[:3], held)
                last, held = key, []
            held.append((word, middle, n))
        yield from done(out)
    if last:
        yield from done(_group(*last[:3], held))


def _halves(rows: DataFrame) -> DataFrame:
    """Rows of word, n, m, p, s (letters at either end that the group agrees in), ends (these letters): each by the first
    and by the last half of the m letters that is not among them."""
    half = F.floor((F.col("m") - F.col("p") - F.col("s")) / 2).cast("int")
    first = F.struct((F.col("p") + half).alias("p"), F.col("s").alias("s"))
    last = F.struct(F.col("p").alias("p"), (F.col("m") - F.col("p") - half).alias("s"))
    split = rows.where("m - p - s > 1").select("word", "n", "m", F.explode(F.array(first, last)).alias("_h")).select("word", "n", "m", "_h.p", "_h.s")
    ends = F.concat(F.col("word").substr(F.lit(1), F.col("p")), F.lit(" "), F.col("word").substr(F.length("word") - F.col("s") + 1, F.col("s")))
    return split.withColumn("ends", ends)


def neighbours(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``words``: word, n, distinct. Returns word, n_near, best, best_n for the words that have near ones."""
    start = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")).where("m > 1")
    start = start.select("*", F.lit(0).alias("p"), F.lit(0).alias("s"))
    key = ["m", "p", "s", "ends"]
    rows = refine(_halves(start), key, "word", _halves, limit)
    rows = rows.withColumn("middle", F.col("word").substr(F.col("p") + 1, F.length("word") - F.col("p") - F.col("s")))
    found = rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(_near, "word string, near long, best string, best_n long")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))  # strings compare by UTF-8 bytes, which is by code points
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("first")).select("word", "n_near", F.col("first.word").alias("best"), (-F.col("first.n")).alias("best_n"))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n: of every word of at least 7 letters that occurs twice, the commonest word one
    letter away if it is ten times as common, and the last word reached by following forms.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, one in 31 of them without one letter, as a
    checksum of doc_id and run says (a null doc_id is the empty string there). Ties in count go to the word first in
    code-point order. Null, empty and wordless texts have no words; repeated rows count again; an empty table gives an
    empty table; other columns are ignored.
    """
    words = common.materialize(vocabulary(docs, key, text), "words")
    near = words.join(neighbours(words, limit), "word", "left")
    formed = F.col("best_n") >= RATIO * F.col("n")
    known = near.select("word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n"))
    known = common.materialize(known, "variants")
    # a form is ten times as common as its word, so there are few steps to the last
    roots, steps, depth = known.where("form is not null").select("word", F.col("form").alias("root")), 1, len(str(words.agg(F.max("n")).first()[0] or 0))
    while steps < depth:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = common.materialize(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        steps *= 2
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Variants among the words of all ``documents``."""
    return variants(common.table(spark, sf_dir, "documents"))
