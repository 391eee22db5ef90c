"""Observation bias: reads with two mutations closer than a gap are never seen.

Arrays are positions long (by clusters, where there are some); what grows with the reads has been counted by
Spark before. p: underlying rates; ends[a, b]: share of reads from a to b.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .solvers import Solution, newton_krylov

#: Rates are searched for between zero and this.
HIGHEST = 1 - 1e-11


def no_mutation(p: np.ndarray) -> np.ndarray:
    """Running log probability of no mutation up to, not including, each position (one longer than p)."""
    return np.r_[0.0, np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))]


def no_close(p: np.ndarray, gap: int) -> np.ndarray:
    """f[a, b]: probability that no two mutations of a read from a to b are within ``gap``.

    Position b is either not mutated, and all before it is fine, or it is, and the ``gap`` positions
    before it are not while all before those is fine. Ones where b < a."""
    n, run = len(p), no_mutation(p)
    f = np.ones((n + 1, n + 1))  # f[a, j]: of the positions a to j - 1
    starts = np.arange(n)
    for j in range(1, n + 1):
        a = starts[:j]
        first = np.maximum(a, j - 1 - gap)
        clear = np.exp(run[j - 1] - run[np.minimum(first, j - 1)])
        f[a, j] = (1 - p[j - 1]) * f[a, j - 1] + p[j - 1] * clear * f[a, np.maximum(first, a)]
    return f


def observed(p: np.ndarray, ends: np.ndarray, gap: int) -> np.ndarray:
    """Mutation rates among the reads that are seen."""
    n = len(p)
    if gap <= 0:
        return p.copy()
    f, run = no_close(p, gap), no_mutation(p)
    seen = ends * f[:n, 1:]
    span = np.cumsum(np.cumsum(seen, axis=0)[:, ::-1], axis=1)[:, ::-1]
    out = np.zeros(n)
    for j in range(n):
        a, b = np.arange(j + 1), np.arange(j, n)
        left = np.maximum(a, j - gap)
        right = np.minimum(b, j + gap)
        before = np.exp(run[j] - run[left]) * f[a, left]
        after = np.exp(run[right + 1] - run[j + 1]) * f[right + 1, b + 1]
        total = span[j, j]
        out[j] = p[j] * (before @ ends[: j + 1, j:] @ after) / total if total > 0 else 0.0
    return out


def observed_merged(p: np.ndarray, ends: np.ndarray, gap: int) -> np.ndarray:
    """Mutation rates where, from a read's 3' end, each mutation takes in those within ``gap`` of it: no read is lost, but
    of close mutations one is left. A mutation stays unless one that stays lies in the ``gap`` positions after it, and of
    these no two stay; so the chance that one stays follows from those after it, for reads of each 3' end."""
    n = len(p)
    if gap <= 0:
        return p.copy()
    by_end3 = np.cumsum(ends, axis=0)  # [a, b]: reads from a or before it to b
    stays = np.zeros((n, n + gap + 1))  # [b, j]
    out = np.zeros(n)
    for j in range(n - 1, -1, -1):
        b = np.arange(j, n)
        stays[b, j] = p[j] * (1 - stays[b, j + 1 : j + gap + 1].sum(axis=1))
        cover = by_end3[j, j:]
        out[j] = stays[b, j] @ cover / cover.sum() if cover.sum() > 0 else 0.0
    return out


def unbias(seen: np.ndarray, ends: np.ndarray, gap: int, tolerance: float = 1e-10, merged: bool = False) -> np.ndarray:
    """Underlying rates that give the rates seen; the best found if none do."""
    return solve(seen, ends, gap, tolerance, merged).x


def solve(seen: np.ndarray, ends: np.ndarray, gap: int, tolerance: float = 1e-10, merged: bool = False) -> Solution:
    """The rates of unbias(), what they leave of the rates seen, and whether that is within the tolerance.

    A few multiplicative corrections lead near the solution, Newton-Krylov steps to it. Where these do not arrive (no
    rates may give what is seen), corrections go on from the better of both."""
    model = observed_merged if merged else observed
    left = lambda p: model(p, ends, gap) - seen

    def corrected(p: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            made = model(p, ends, gap)
            p, before = np.clip(np.where(made > 0, p * seen / np.where(made > 0, made, 1), 0.0), 0.0, HIGHEST), p
            if np.abs(p - before).max(initial=0.0) < tolerance / 10:
                break
        return p

    found = newton_krylov(left, corrected(np.clip(seen, 0.0, HIGHEST), 5), 0.0, HIGHEST, tolerance)
    if found.settled:
        return found
    p = corrected(found.x, 500)
    worst = float(np.abs(left(p)).max(initial=0.0))
    return Solution(p, worst, worst <= tolerance, found.steps) if worst < found.residual else found


def unbias_quick(seen: np.ndarray, ends: np.ndarray, gap: int, low: float = 1e-3) -> np.ndarray:
    """The same with rates under ``low`` as they are; what lies between runs of ``gap`` such positions is
    solved piece by piece, as if reads ended there."""
    p = np.where(seen < low, seen, 0.0)
    at = 0
    quiet = np.r_[seen < low, np.ones(gap + 1, bool)]
    while at < len(seen):
        if quiet[at]:
            at += 1
            continue
        stop = at
        while stop < len(seen) and not quiet[stop : stop + max(gap, 1)].all():
            stop += 1
        part = np.zeros((stop - at, stop - at))
        a, b = np.nonzero(ends)
        inside = (a < stop) & (b >= at)
        np.add.at(part, (np.maximum(a[inside], at) - at, np.minimum(b[inside], stop - 1) - at), ends[a[inside], b[inside]])
        p[at:stop] = unbias(seen[at:stop], part / max(part.sum(), 1e-300), gap)
        at = stop
    return p


def end_shares(counts: DataFrame, n: int) -> np.ndarray:
    """Shares of the end pairs (end5, end3, n) of a region of n positions from 1."""
    out = np.zeros((n, n))
    for r in counts.groupBy("end5", "end3").agg(F.sum("n").alias("n")).collect():
        out[r["end5"] - 1, r["end3"] - 1] = r["n"]
    return out / max(out.sum(), 1e-300)


def true_ends(ends: np.ndarray, p: np.ndarray, gap: int) -> np.ndarray:
    """Shares of end pairs before unseen reads were lost."""
    f = no_close(p, gap)[: len(p), 1:]
    out = np.where(ends > 0, ends / f, 0.0)
    return out / max(out.sum(), 1e-300)


def true_shares(seen: np.ndarray, survive: np.ndarray) -> np.ndarray:
    """Shares of clusters before unseen reads were lost, given each one's chance to be seen."""
    out = seen / survive
    return out / out.sum()


def seen_shares(true: np.ndarray, survive: np.ndarray) -> np.ndarray:
    """The reverse of true_shares()."""
    out = true * survive
    return out / out.sum()


def survival(ends: np.ndarray, p: np.ndarray, gap: int) -> float:
    """The chance of a read of these ends and rates to be seen."""
    return float((ends * no_close(p, gap)[: len(p), 1:]).sum())


def seen_ends(ends: np.ndarray, p: np.ndarray, gap: int) -> np.ndarray:
    """Shares of end pairs among the reads that are seen: the reverse of true_ends()."""
    out = ends * no_close(p, gap)[: len(p), 1:]
    return out / max(out.sum(), 1e-300)


def clusters_given_ends(shares: np.ndarray, ends: np.ndarray, rates: np.ndarray, gap: int) -> np.ndarray:
    """[k, a, b]: the share of each cluster among the reads seen from a to b; equal ones where there are none."""
    f = np.array([no_close(p, gap)[: len(p), 1:] for p in rates])
    out = shares[:, None, None] * ends[None] * f
    total = out.sum(axis=0)
    return np.where(total > 0, out / np.where(total > 0, total, 1), 1 / len(shares))


def unbias_all(rates: np.ndarray, ends: np.ndarray, shares: np.ndarray, gap: int, merged: bool = False, tolerance: float = 1e-7, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Underlying rates [k, n], end shares and cluster shares from what is seen, together: each is corrected in turn by what
    the others now are, until none changes. Ends are those of all clusters."""
    if gap <= 0:
        return rates.copy(), ends.copy(), shares.copy()
    if merged:  # nothing is lost, so ends and shares are as they are seen
        return np.array([unbias(r, ends, gap, merged=True) for r in rates]), ends.copy(), shares.copy()
    p, e, s = np.clip(rates, 0.0, 0.999), ends.copy(), shares.copy()
    for _ in range(rounds):
        before = p, e, s
        made = np.array([observed(x, e, gap) for x in p])
        p = np.clip(np.where(made > 0, p * rates / np.where(made > 0, made, 1), 0.0), 0.0, 0.999)
        f = np.array([no_close(x, gap)[: p.shape[1], 1:] for x in p])
        lost = np.tensordot(s, f, 1)
        e = np.where(ends > 0, ends / np.maximum(lost, 1e-300), 0.0)
        e /= max(e.sum(), 1e-300)
        s = true_shares(shares, np.array([(e * x).sum() for x in f]))
        if all(np.abs(x - y).max(initial=0.0) < tolerance for x, y in zip((p, e, s), before, strict=True)):
            break
    return p, e, s


def adjust(table: DataFrame, rates: DataFrame, survive: float, subtypes: tuple[str, ...]) -> DataFrame:
    """A position table scaled to the reads before loss: Covered and Informative by 1 / ``survive``, Mutated
    from the underlying rate (pos, mu), its subtypes in proportion."""
    j = table.join(F.broadcast(rates.select("pos", F.col("mu").alias("_mu"))), "pos", "left")
    info = F.col("Informative") / survive
    mutated = info * F.coalesce("_mu", F.lit(0.0))
    scale = F.when(F.col("Mutated") > 0, mutated / F.col("Mutated")).otherwise(0.0)
    return j.select("pos", "base", (F.col("Covered") / survive).alias("Covered"), info.alias("Informative"), (info - mutated).alias("Matched"), mutated.alias("Mutated"), *[(F.col(s) * scale).alias(s) for s in subtypes])


def unbias_tables(table: DataFrame, ends: DataFrame, gap: int, by: list[str], merged: bool = False) -> DataFrame:
    """by, pos, observed, mu, remade, residual, settled: the rates of position tables (by, pos, Mutated) as they are, as they
    underlie, and as the latter would be seen; the region's largest difference of first and last, and whether it is within
    the tolerance. From the end counts (by, end5, end3, n). Each region is solved in a task of its own; what it holds is
    positions by positions."""
    types = dict(table.dtypes)
    schema = "".join(f"{c} {types[c]}, " for c in by) + "pos int, observed double, mu double, remade double, residual double, settled boolean"

    def run(key, rates, counts):
        rates = rates.sort_values("pos")
        pos = rates["pos"].to_numpy()
        square = np.zeros((len(pos), len(pos)))
        a, b = np.searchsorted(pos, counts["end5"]), np.searchsorted(pos, counts["end3"], "right") - 1
        inside = (a < len(pos)) & (b >= 0) & (a <= b)  # reads that cover a position
        np.add.at(square, (a[inside], b[inside]), counts["n"].to_numpy(float)[inside])
        seen = rates["Mutated"].fillna(0).to_numpy(float)
        square /= max(square.sum(), 1e-300)
        found = solve(seen, square, gap, merged=merged)
        remade = (observed_merged if merged else observed)(found.x, square, gap)
        return rates[by].assign(pos=pos, observed=seen, mu=found.x, remade=remade, residual=found.residual, settled=found.settled)

    return table.select(*by, F.col("pos").cast("int").alias("pos"), "Mutated").groupBy(*by).cogroup(ends.select(*[F.col(c).alias(f"_{c}") for c in by], "end5", "end3", "n").groupBy(*[f"_{c}" for c in by])).applyInPandas(run, schema)
