"""Quality rules with risk-controlled thresholds, all in DataFrame functions.

A few features of each text may reject it. How far the rules go is learnt per stratum (a class of length) in two steps:

1. a *path* of settings, each a little harsher than the one before: the next step is that cutoff, of all rules' next
   ones, which newly rejects most documents labelled bad for each unlabelled document that it newly rejects;
2. along the path, the documents labelled good are the holdout, as nothing of the path was learnt from them. A setting
   holds if the exact binomial (Clopper-Pearson) bound of its false rejections, by any rule, is under a stated rate. The
   first one that does not ends the search (fixed-sequence testing, which needs no correction along the path); the error
   is shared between the strata (Bonferroni). So with probability 1 - DELTA no stratum loses more than ALPHA of its good
   documents to all rules together.

Of the settings that hold, that one is taken for which the share of the bad documents caught exceeds the share of the
unlabelled ones rejected by most; the mildest of equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Upper bounds of the strata in words; the last stratum has none.
STRATA = (50, 200, 1000)
#: Cutoffs of a rule, and the mildest and the harshest; those between are spaced evenly in their logarithms. A text is
#: rejected where the feature is at the cutoff or above.
LEVELS = 10
RULES = {
    "symbol_share": (0.5, 0.002),
    "dup_line_share": (0.9, 0.05),
    "repeat_share": (0.2, 0.01),
    "upper_share": (0.9, 0.05),
    "odd_length": (6.0, 0.4),
}
#: Largest rate of false rejections in each stratum, by all rules, and error probability of all strata together.
ALPHA, DELTA = 0.05, 0.05


def cutoffs(rule: str) -> list[float]:
    """The rule's cutoffs, mildest first."""
    mild, harsh = RULES[rule]
    return [round(mild * (harsh / mild) ** (i / (LEVELS - 1)), 6) for i in range(LEVELS)]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts behind the rules, of each whole text (null: none)."""
    text = F.col("text")
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    staged = common.with_text(docs).select("doc_id", "text", words.alias("w"), lines.alias("lines"))
    n = F.size("w")
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.col("w")[i + j] for j in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    staged = staged.select("doc_id", "text", "w", "lines", windows.alias("h"))
    # most texts repeat no window; only the others are walked
    staged = staged.select("doc_id", "text", "w", "lines", "h", F.size(F.array_distinct("h")).alias("d"))
    order = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    staged = staged.select("*", F.when(F.col("d") < F.size("h"), order).alias("o"))
    one = F.col("o")

    def same(i: Column, step: int) -> Column:
        other = F.try_element_at(one, (i + 1 + step).cast("int"))
        return F.coalesce(other["x"] == one[i]["x"], F.lit(False))

    first = lambda i: F.when(i == 0, F.lit(False)).otherwise(same(i, -1))
    starts = F.array_sort(F.transform(F.filter(F.transform(one, lambda s, i: F.when(first(i) | same(i, 1), s["i"])), lambda x: x.isNotNull()), lambda x: x))
    walked = F.aggregate(starts, F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")), lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(5), s - acc["last"])).alias("n")), lambda acc: acc["n"])
    long = lambda c: c.cast("long")
    return staged.select(
        "doc_id",
        long(n).alias("n_words"),
        long(F.length(F.translate(text, WS, ""))).alias("word_chars"),
        long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.when(F.col("o").isNull(), 0).otherwise(walked)).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
    )


def _values() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / chars,
        "odd_length": F.abs(F.log(F.col("word_chars") / words / 6.0 + 1e-9)) / F.log(F.lit(2.0)),
    }


def stratum() -> Column:
    """The number of the class of length, from 0; there are len(STRATA) + 1 of them."""
    out = F.lit(len(STRATA))
    for i in reversed(range(len(STRATA))):
        out = F.when(F.col("n_words") < STRATA[i], i).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def tail_at_most(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of a binomial with n trials and this rate, summed exactly, in logarithms that are
    rescaled on the way. The Clopper-Pearson upper bound is under ``rate`` iff this is under the error. From the mean
    on, where it is about a half or more, it is given as 1."""
    odds = F.log(F.lit(rate / (1 - rate)))
    start = F.struct((n * F.log1p(F.lit(-rate))).alias("term"), (n * F.log1p(F.lit(-rate))).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(term, acc["total"]), F.least(term, acc["total"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when((k > 0) & (k < n * rate), F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * rate, 1.0).otherwise(F.exp(F.aggregate(steps, start, add, lambda acc: acc["total"])))


def path(cells: list[tuple[tuple[int, ...], int, int]]) -> list[tuple[tuple[int, ...], float]]:
    """Settings from mild to harsh, each with its gain. A setting is, for each rule, how many of its cutoffs are in
    force, up to the harshest of those; the gain is the share of bad texts that it rejects less that of texts without a
    label. ``cells``: of texts with the same cutoffs that they pass (per rule how many, from the mildest), how many are
    labelled bad and how many have no label. Ties go to the rule listed first."""
    now, left, out = [0] * len(RULES), cells, []
    totals = [max(1, sum(c[i] for c in cells)) for i in (1, 2)]
    caught = [0, 0]
    while min(now) < LEVELS:
        best = None
        for r in range(len(RULES)):
            if now[r] < LEVELS:
                hit = [c for c in left if c[0][r] <= now[r]]
                bad, free = sum(c[1] for c in hit), sum(c[2] for c in hit)
                value = (bad + 0.5) / (free + 1)
                if best is None or value > best[0]:
                    best = value, r, bad, free
        _, r, bad, free = best
        now[r] += 1
        left = [c for c in left if c[0][r] >= now[r]]
        caught = [caught[0] + bad, caught[1] + free]
        out.append((tuple(now), caught[0] / totals[0] - caught[1] / totals[1]))
    return out


def thresholds(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[int, dict]:
    """By stratum the setting that holds: ``cutoffs`` by rule, ``n_good``, ``n_rejected`` and ``error`` (of its bound).

    ``measured`` is what features() gives, ``labels`` has doc_id and quality (1 good). Labels of a doc_id that comes
    repeatedly count once, good only if all say so; rows of ``measured`` that share a doc_id count each. What comes to the
    driver is a table of counts of at most (LEVELS + 1) ** len(RULES) cells a stratum, however many documents there are.
    A stratum with too few good documents for any bound, or without bad ones, has no cutoffs.
    """
    passed = [sum(F.when(value < c, 1).otherwise(0) for c in cutoffs(rule)).alias(f"l{r}") for r, (rule, value) in enumerate(_values().items())]
    keys = [f"l{r}" for r in range(len(RULES))]
    told = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_key")).agg(F.min("quality").alias("_quality"))
    cells = (
        measured.where(~base_failed())
        .select("doc_id", stratum().alias("stratum"), *passed)
        .join(told, F.col("doc_id") == F.col("_key"), "left")
        .groupBy("stratum", *keys)
        .agg(F.count_if(F.col("_quality") >= 1).alias("good"), F.count_if(F.col("_quality") < 1).alias("bad"), F.count_if(F.col("_quality").isNull()).alias("free"))
    )
    cells = common.materialize(cells, "cells")
    by: dict[int, list] = {}
    for c in cells.where("bad > 0 or free > 0").collect():
        by.setdefault(c["stratum"], []).append((tuple(c[k] for k in keys), c["bad"], c["free"]))
    paths = {s: path(by.get(s, [])) for s in range(len(STRATA) + 1)}
    steps = len(RULES) * LEVELS

    def rejected(step: int) -> Column:
        out = F.lit(False)
        for s, settings in paths.items():
            hit = F.lit(False)
            for k, level in zip(keys, settings[step][0], strict=True):
                hit = hit | (F.col(k) < level)
            out = out | ((F.col("stratum") == s) & hit)
        return F.sum(F.when(out, F.col("good")).otherwise(0)).alias(f"k{step}")

    counted = cells.groupBy("stratum").agg(F.sum("good").alias("n_good"), *[rejected(i) for i in range(steps)])
    tried = F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"k{i}").alias("n_rejected")) for i in range(steps)])
    tried = F.transform(tried, lambda t: F.struct(t["step"].alias("step"), t["n_rejected"].alias("n_rejected"), tail_at_most(t["n_rejected"], F.col("n_good"), alpha).alias("error")))
    most = delta / (len(STRATA) + 1)
    ends = F.coalesce(F.array_min(F.transform(F.filter("tried", lambda t: t["error"] > most), lambda t: t["step"])), F.lit(steps))
    held = counted.where("n_good > 0").select("stratum", "n_good", tried.alias("tried")).select("stratum", "n_good", F.slice("tried", 1, ends).alias("held"))
    out = {}
    for r in held.collect():  # one row a stratum
        gains = [paths[r["stratum"]][t["step"]][1] for t in r["held"]]
        if gains and max(gains) > 0:
            chosen = r["held"][gains.index(max(gains))]
            setting = paths[r["stratum"]][chosen["step"]][0]
            out[r["stratum"]] = {"cutoffs": {rule: cutoffs(rule)[level - 1] for rule, level in zip(RULES, setting, strict=True) if level}, "n_good": r["n_good"], "n_rejected": chosen["n_rejected"], "error": chosen["error"]}
    return out


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rules
    (those that reject, comma-joined).

    Null or empty texts have no words and fail the base. Every row is judged by itself, so repeated rows
    agree, whatever their doc_id, null included; empty tables give an empty table; without labels only the base decides;
    other columns are ignored. Where a text's feature ties with a cutoff, it is rejected.
    """
    values = _values()
    measured = common.materialize(features(docs), "features")  # counts only: each text is read once
    found = thresholds(measured, labels, alpha, delta)
    judged = measured.withColumn("stratum", stratum())
    hits = []
    for rule, value in values.items():
        hit = F.lit(False)
        for s, held in found.items():
            if rule in held["cutoffs"]:
                hit = hit | ((F.col("stratum") == s) & (value >= held["cutoffs"][rule]))
        hits.append(F.when(hit, rule))
    judged = judged.withColumn("rules", F.concat_ws(",", *hits)).withColumn("base_failed", base_failed())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rules") == "")).alias("kept"), "rules")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` by rules that ``labels`` have set."""
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
