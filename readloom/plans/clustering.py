"""Clustering of reads by expectation-maximisation. Reads stay in Spark: an iteration is one pass over the unique reads that
gives back sums by run, cluster and position, and the parameters made of these go along with the next pass. All runs, of
whatever seeds, numbers of clusters and regions, share each pass; a run that has settled leaves it."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch_path
from . import bias

#: Positions of a region for which shares of end pairs are held on the driver (3.2 GB at this many).
MOST_POSITIONS = 20_000


def read_id(*by: str) -> Column:
    """The id of a read's content (segs, muts), 128 bits of hash as text."""
    half = lambda salt: F.lpad(F.hex(F.xxhash64(F.lit(salt), *by, "segs", "muts")), 16, "0")
    return F.concat(half("a"), half("b"))


def prepare(unique: DataFrame, *by: str) -> DataFrame:
    """Unique reads (by, segs, muts, n) with an id made of their content, and their ends."""
    return unique.select(*by, read_id(*by).alias("uid"), F.array_min(F.transform("segs", lambda s: s["end5"])).alias("end5"), F.array_max(F.transform("segs", lambda s: s["end3"])).alias("end3"), "muts", "n")


@dataclasses.dataclass(frozen=True)
class Params:
    """Positions of the region, underlying rates [k, position], cluster shares, end shares [position, position] and gap."""

    pos: np.ndarray
    rates: np.ndarray
    shares: np.ndarray
    ends: np.ndarray
    gap: int = 0
    merged: bool = False

    @property
    def k(self) -> int:
        return len(self.shares)


@dataclasses.dataclass(frozen=True)
class Run:
    """A run of EM: parameters, log likelihood after each iteration, and whether it settled."""

    seed: int
    params: Params
    log_likes: tuple[float, ...]
    settled: bool
    n_reads: float

    @property
    def log_like(self) -> float:
        return self.log_likes[-1]

    @property
    def n_params(self) -> int:
        """Rates and cluster shares, and the end pairs that occur but for one, which all clusters share."""
        return self.params.rates.size + int((self.params.ends > 0).sum()) - 1 + self.params.k - 1

    @property
    def bic(self) -> float:
        return self.n_params * np.log(max(self.n_reads, 1.0)) - 2 * self.log_like


class Reads:
    """A batch of unique reads as arrays. Reads that cover none of the positions count nothing. ``frame``: of pandas or, as every
    pass has it, of Arrow, whose lists are one array already and are not taken apart into one for each read."""

    def __init__(self, frame: pd.DataFrame | pa.RecordBatch, pos: np.ndarray):
        batch = frame if isinstance(frame, pa.RecordBatch) else pa.RecordBatch.from_pandas(frame[["end5", "end3", "muts", "n"]], preserve_index=False)
        end5, end3, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("end5", "end3", "n"))
        self.first = np.searchsorted(pos, end5)
        self.last = np.searchsorted(pos, end3, "right") - 1
        covers = self.first <= self.last
        self.n = np.where(covers, n.astype(float), 0.0)
        self.first, self.last = np.where(covers, self.first, 0), np.where(covers, self.last, 0)
        row, muts = _flat(batch.column("muts"))
        at = np.searchsorted(pos, muts)
        known = (at < len(pos)) & covers[row]
        known[known] = pos[at[known]] == muts[known]
        self.row, self.mut = row[known], at[known]


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a column of lists, the row of each entry, and the entries."""
    if not pa.types.is_list(lists.type) and not pa.types.is_large_list(lists.type):  # no frame's list has an entry
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    entries = lists.flatten()
    return np.repeat(np.arange(len(lists)), sizes), entries.to_numpy(zero_copy_only=False) if len(entries) else np.empty(0, np.int64)


def log_joint(reads: Reads, params: Params) -> np.ndarray:
    """[read, cluster]: log probability of a read's ends and mutations and its cluster."""
    run = np.array([bias.no_mutation(r) for r in params.rates])  # [k, position + 1]
    p = np.clip(params.rates, 1e-12, 1 - 1e-12)
    out = np.log(np.maximum(params.shares, 1e-300))[None] + (run[:, reads.last + 1] - run[:, reads.first]).T
    odds = (np.log(p) - np.log1p(-p))[:, reads.mut]
    if params.merged and params.gap:  # what a mutation may have taken in says nothing
        low = np.maximum(reads.mut - params.gap, reads.first[reads.row])
        odds = odds - (run[:, reads.mut] - run[:, low])
    for k in range(params.k):
        out[:, k] += np.bincount(reads.row, odds[k], len(out))
    out += np.log(np.maximum(params.ends[reads.first, reads.last], 1e-300))[:, None]
    if params.gap and not params.merged:
        out -= np.log(max(sum(s * bias.survival(params.ends, r, params.gap) for s, r in zip(params.shares, params.rates, strict=True)), 1e-300))
    return out


def responsibilities(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = joint.max(axis=1, keepdims=True)
    marginal = top + np.log(np.exp(joint - top).sum(axis=1, keepdims=True))
    return np.exp(joint - marginal), marginal[:, 0]


@dataclasses.dataclass(frozen=True)
class Start:
    """What tells runs apart: clusters, seed, and the region where several are fitted together."""

    k: int
    seed: int = 0
    group: int | None = None


def _parts(batch: pa.RecordBatch, column: str | None):
    """The batch's rows by the value of a column (rows without one stay out)."""
    values = [None] if column is None else [v for v in batch.column(column).unique().to_pylist() if v is not None]
    return [(v, batch if column is None or len(values) == 1 and not batch.column(column).null_count else batch.filter(pc.equal(batch.column(column), v))) for v in values]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], field.type) for i, field in enumerate(schema)], schema=schema)


#: What a pass gives back.
_SUMS = pa.schema([("run", pa.int32()), ("kind", pa.int32()), ("clust", pa.int32()), ("at", pa.int32()), ("value", pa.float64())])


def _sums(batches, pos: dict, weighers: dict[int, tuple], column: str | None):
    """Of a task's reads, for each run: log likelihood, weights, coverage steps and mutations by cluster."""
    total: dict[int, list] = {}
    for batch in batches:
        for group, part in _parts(batch, column):
            runs = [(i, k, weigh) for i, (g, k, weigh) in weighers.items() if g == group]
            if not runs:
                continue
            reads, n = Reads(part, pos[group]), len(pos[group])
            for i, k, weigh in runs:
                weights, marginal = weigh(part, reads)
                if i not in total:
                    total[i] = [0.0, np.zeros(k), np.zeros((k, n + 1)), np.zeros((k, n))]
                sums = total[i]
                sums[0] += float(reads.n @ marginal)
                for c in range(k):
                    w = weights[:, c] * reads.n
                    sums[1][c] += w.sum()
                    sums[2][c] += np.bincount(reads.first, w, n + 1) - np.bincount(reads.last + 1, w, n + 1)
                    sums[3][c] += np.bincount(reads.mut, w[reads.row], n)
    for i, (like, shares, steps, hits) in total.items():
        rows = [(i, 0, 0, 0, like)] + [(i, 1, c, 0, float(v)) for c, v in enumerate(shares)]
        rows += [(i, kind, c, at, float(v)) for kind, x in ((2, steps), (3, hits)) for c in range(len(x)) for at, v in enumerate(x[c]) if v]
        yield _table(rows, _SUMS)


def _pass(uniq: DataFrame, pos: dict, weighers: dict[int, tuple], column: str | None) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each run, observed rates and shares, and the log likelihood: one job for all, whose result is as large as
    runs by clusters by positions."""
    found = uniq.mapInArrow(lambda b: _sums(b, pos, weighers, column), "run int, kind int, clust int, at int, value double").groupBy("run", "kind", "clust", "at").agg(F.sum("value").alias("value")).collect()
    sums = {i: [np.zeros((k, len(pos[g]) + 1)) for _ in range(4)] for i, (g, k, _) in weighers.items()}
    for r in found:
        sums[r["run"]][r["kind"]][r["clust"], r["at"]] = r["value"]
    out = {}
    for i, (like, shares, steps, hits) in sums.items():
        cover = np.cumsum(steps, axis=1)[:, :-1]
        rates = np.where(cover > 1e-9, hits[:, :-1] / np.maximum(cover, 1e-9), 0.0)
        out[i] = rates, shares[:, 0] / max(shares[:, 0].sum(), 1e-300), float(like[0, 0])
    return out


def end_shares(uniq: DataFrame, pos: dict, column: str | None = None) -> dict[object, tuple[np.ndarray, float]]:
    """For each region, shares of its reads by their first and last positions, and the number of reads."""
    out = {}
    for group, places in pos.items():
        if len(places) > MOST_POSITIONS:
            raise ValueError(f"a region of {len(places)} positions is too long to be clustered; {MOST_POSITIONS} is the most")
        out[group] = np.zeros((len(places), len(places)))
    key = [] if column is None else [column]
    for r in uniq.groupBy(*key, "end5", "end3").agg(F.sum("n").alias("n")).collect():
        places = pos[r[column] if column else None]
        a, b = np.searchsorted(places, r["end5"]), np.searchsorted(places, r["end3"], "right") - 1
        if a <= b:
            out[r[column] if column else None][a, b] += r["n"]
    return {group: (x / max(x.sum(), 1e-300), float(x.sum())) for group, x in out.items()}


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of unsigned integers spread over all bits."""
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def first_weights(seed: int, k: int) -> Callable:
    """Random weights of unique reads (Dirichlet, all parameters 1) that depend on seed and content alone."""

    def weigh(batch, reads):
        content = pd.util.hash_array(batch.column("uid").to_numpy(zero_copy_only=False))
        keys = _mixed(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed + 1))
        uniform = ((_mixed(content[:, None] ^ keys[None]) >> np.uint64(11)).astype(float) + 0.5) / 2**53
        draws = -np.log(uniform)
        return draws / draws.sum(axis=1, keepdims=True), np.zeros(len(draws))

    return weigh


def fit(uniq: DataFrame, positions: dict, starts: list[Start], column: str | None = None, min_iterations: int = 10, max_iterations: int = 500, threshold: float = 0.37, min_gap: int = 0, merged: bool = False) -> list[Run]:
    """Runs from random weights, each until its log likelihood gains less than ``threshold`` (after ``min_iterations``). One
    job an iteration serves all that have not settled. ``positions``: sorted positions of each region by its number in
    ``column`` (None: one region, under None). With a gap, what is seen is corrected for reads that were lost (or
    mutations that were merged): rates, ends and shares together. ``uniq``: column, uid, end5, end3, muts, n, best written
    once, as each iteration reads it."""
    seen = end_shares(uniq, positions, column)
    weighers = {i: (s.group, s.k, first_weights(s.seed, s.k)) for i, s in enumerate(starts)}
    held = uniq.select(*([] if column is None else [column]), "end5", "end3", "muts", "n")  # ids are for first weights alone
    likes, params, out = {i: [] for i in weighers}, {}, {}
    iteration = 0
    while weighers:
        for i, (rates, shares, like) in _pass(uniq if iteration == 0 else held, positions, weighers, column).items():
            s = starts[i]
            ends, n = seen[s.group]
            if i in params:
                likes[i].append(like)
                settled = iteration > min_iterations and len(likes[i]) > 1 and likes[i][-1] - likes[i][-2] < threshold
                if settled or iteration == max_iterations:
                    out[i] = Run(s.seed, params[i], tuple(likes[i]), settled, n)
                    del weighers[i]
                    continue
            params[i] = Params(positions[s.group], *_corrected(rates, ends, shares, min_gap, merged), min_gap, merged)
            weighers[i] = (s.group, s.k, lambda batch, reads, p=params[i]: responsibilities(log_joint(reads, p)))
        iteration += 1
    return [out[i] for i in range(len(starts))]


def _corrected(rates: np.ndarray, ends: np.ndarray, shares: np.ndarray, min_gap: int, merged: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rates, ends, shares = bias.unbias_all(rates, ends, shares, min_gap, merged)
    return rates, shares, ends


def places(positions: DataFrame) -> np.ndarray:
    """Positions of a region, sorted."""
    return np.array(sorted(r["pos"] for r in positions.select("pos").collect()), np.int64)


def run_em(uniq: DataFrame, positions: DataFrame, k: int, seed: int = 0, **options) -> Run:
    """One run by itself; options are those of fit()."""
    return fit(uniq, {None: places(positions)}, [Start(k, seed)], **options)[0]


def weights(uniq: DataFrame, params: Params) -> DataFrame:
    """uid, n, clust (from 1), weight, marginal of every unique read."""

    def run(frames):
        for frame in frames:
            resp, marginal = responsibilities(log_joint(Reads(frame, params.pos), params))
            k = params.k
            yield pd.DataFrame({"uid": np.repeat(frame["uid"].to_numpy(), k), "n": np.repeat(frame["n"].to_numpy(), k), "clust": np.tile(np.arange(1, k + 1), len(frame)), "weight": resp.ravel(), "marginal": np.repeat(marginal, k)})

    return uniq.mapInPandas(run, "uid string, n long, clust int, weight double, marginal double")


def weights_by_k(uniq: DataFrame, runs: dict[int, Run]) -> DataFrame:
    """uid, n, k, clust (from 1), weight of every unique read by one run of each number of clusters, in one pass."""

    def run(frames):
        for frame in frames:
            for k, found in sorted(runs.items()):
                resp, _ = responsibilities(log_joint(Reads(frame, found.params.pos), found.params))
                yield pd.DataFrame({"uid": np.repeat(frame["uid"].to_numpy(), k), "n": np.repeat(frame["n"].to_numpy(), k), "k": k, "clust": np.tile(np.arange(1, k + 1), len(frame)), "weight": resp.ravel()})

    return uniq.mapInPandas(run, "uid string, n long, k int, clust int, weight double")


def read_weights(reads: DataFrame, resps: DataFrame) -> DataFrame:
    """read, clust, weight: what reads with the same content (segs, muts) have been given."""
    return reads.withColumn("uid", read_id()).select("read", "uid").join(resps.select("uid", "clust", "weight"), "uid").select("read", "clust", "weight")


def expected_counts(uniq: DataFrame, params: Params) -> DataFrame:
    """uid, n, log_exp: observed and log expected number of each unique read."""
    total = uniq.agg(F.sum("n").alias("_t"))
    per = weights(uniq, params).select("uid", "n", "marginal").dropDuplicates(["uid"])
    return per.join(F.broadcast(total)).select("uid", "n", (F.col("marginal") + F.log("_t")).alias("log_exp"))


# Comparison and choice of runs. Arrays are clusters by positions.


def arcsine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(np.arcsin(2 * np.clip(x, 0, 1) - 1) - np.arcsin(2 * np.clip(y, 0, 1) - 1)) / np.pi


def correlation(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x - x.mean(), y - y.mean()
    scale = np.sqrt((x @ x) * (y @ y))
    return float(x @ y / scale) if scale > 0 else 0.0


def gini(x: np.ndarray) -> float:
    x = np.sort(x)
    return float((2 * np.arange(1, len(x) + 1) - len(x) - 1) @ x / (len(x) * x.sum())) if x.sum() > 0 else 0.0


def assign(cost: np.ndarray) -> list[int]:
    """The column of each row in the assignment of least total cost, by shortest augmenting paths."""
    n = len(cost)
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)  # column 0 stands for the row to be placed
    for row in range(1, n + 1):
        owner[0], column = row, 0
        least, came, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while owner[column]:
            used[column] = True
            free = np.flatnonzero(~used)
            slack = cost[owner[column] - 1, free - 1] - u[owner[column]] - v[free]
            better = slack < least[free]
            least[free[better]], came[free[better]] = slack[better], column
            nearest = free[least[free].argmin()]
            step = least[nearest]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            column = nearest
        while column:
            owner[column] = owner[came[column]]
            column = came[column]
    out = [0] * n
    for column in range(1, n + 1):
        out[owner[column] - 1] = column - 1
    return out


def match(a: np.ndarray, b: np.ndarray) -> list[int]:
    """For each cluster of a, the one of b it corresponds to: least total arcsine distance."""
    return assign(np.array([[arcsine(x, y).sum() for y in b] for x in a]))


def compare_runs(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Mean arcsine distance and correlation of matched clusters of two runs, averaged."""
    order = match(a, b)
    return float(np.mean([arcsine(a[i], b[j]).mean() for i, j in enumerate(order)])), float(np.mean([correlation(a[i], b[j]) for i, j in enumerate(order)]))


def _least(cost: np.ndarray) -> float:
    return float(cost[np.arange(len(cost)), assign(cost)].sum())


def _orders(cost: np.ndarray, room: Callable[[], float]):
    """Assignments (columns of the rows) that cost less than ``room`` says when they are found, with their costs: depth first, cheap
    columns first, each branch as long as the least assignment of the rest leaves room."""

    def go(row: int, free: list[int], spent: float, chosen: list[int]):
        if row == len(cost):
            yield spent, chosen
            return
        for column in sorted(free, key=lambda c: cost[row, c]):
            rest = [c for c in free if c != column]
            now = spent + cost[row, column]
            if now + (_least(cost[row + 1 :][:, rest]) if rest else 0.0) < room():
                yield from go(row + 1, rest, now, [*chosen, column])

    yield from go(0, list(range(len(cost))), 0.0, [])


def correspond(regions: dict[str, tuple]) -> dict[str, list[int]]:
    """For clusters of several regions, (positions, rates [k, position]) and perhaps shares [k], which belong together: the joined
    number (from 0) of each region's clusters; those of the first region keep theirs.

    The cost of a joint numbering is the arcsine distance, over positions that two regions share (and their shares), of
    all clusters of one number, summed over all pairs of regions. The numbering of least cost is found by branch and
    bound: regions are numbered one after the other, and a branch goes on as long as what it has cost, the least
    assignment of each further region to those that are numbered, and the least one of each pair of further regions are
    less together than the best numbering so far. Every numbering is looked at or ruled out so; ties go to the first found."""
    names = list(regions)
    k = len(regions[names[0]][1]) if names else 0
    if any(len(r[1]) != k for r in regions.values()):
        raise ValueError("regions to be joined have the same number of clusters")

    def distance(one: tuple, two: tuple) -> np.ndarray:
        _, i, j = np.intersect1d(one[0], two[0], return_indices=True)
        x, y = one[1][:, i], two[1][:, j]
        if len(one) > 2 and len(two) > 2:
            x, y = np.column_stack([one[2], x]), np.column_stack([two[2], y])
        return np.array([[arcsine(u, v).sum() for v in y] for u in x]).reshape(k, k)

    cost = {(p, q): distance(regions[p], regions[q]) for p in names for q in names if p != q}
    apart = {pair: _least(c) for pair, c in cost.items()}
    best: dict = {"cost": np.inf, "orders": {}}

    def go(orders: dict[str, list[int]], spent: float) -> None:
        """orders[name][joined number]: the region's cluster."""
        left = [name for name in names if name not in orders]
        if not left:
            if spent < best["cost"] - 1e-12:
                best.update(cost=spent, orders=dict(orders))
            return
        to_placed = {name: sum(cost[p, name][order] for p, order in orders.items()) for name in left}
        least = {name: _least(c) for name, c in to_placed.items()}
        among = sum(apart[p, q] for i, p in enumerate(left) for q in left[i + 1 :])
        following = max(left, key=lambda name: least[name])  # the dearest one rules out most
        rest = spent + sum(least.values()) - least[following] + among
        for c, order in _orders(to_placed[following], lambda: best["cost"] - 1e-12 - rest):
            go({**orders, following: order}, spent + c)

    if names:
        go({names[0]: list(range(k))}, 0.0)
    return {name: [int(i) for i in np.argsort(best["orders"][name])] for name in names}


@dataclasses.dataclass(frozen=True)
class Limits:
    """What a run has to keep to. Fixed values are the defaults."""

    max_pearson: float = 0.9
    min_marcd: float = 0.016
    max_arcd: float = 0.2
    max_gini: float = 0.667
    max_jackpot: float = 1.1
    max_loglike_vs_best: float = 0.0
    min_pearson_vs_best: float = 0.97
    max_marcd_vs_best: float = 0.008


def run_statistics(run: Run, ensemble: np.ndarray | None = None) -> dict[str, float]:
    """How alike the clusters of a run are, and how far they lie from the average of all reads."""
    r, k = run.params.rates, run.params.k
    pairs = [(i, j) for i in range(k) for j in range(i)]
    mean = run.params.shares @ r if ensemble is None else ensemble
    return {
        "min_marcd": min((float(arcsine(r[i], r[j]).mean()) for i, j in pairs), default=np.inf),
        "max_pearson": max((correlation(r[i], r[j]) for i, j in pairs), default=-np.inf),
        "max_arcd": max((float(arcsine(x, mean).max()) for x in r), default=0.0) if k > 1 else 0.0,
        "max_gini": max(gini(x) for x in r),
    }


def passes(run: Run, limits: Limits, ensemble: np.ndarray | None = None, jackpot: float | None = None) -> bool:
    """Whether a run settled and its clusters are distinct, even and no freaks."""
    s = run_statistics(run, ensemble)
    return run.settled and s["min_marcd"] >= limits.min_marcd and s["max_pearson"] <= limits.max_pearson and s["max_arcd"] <= limits.max_arcd and s["max_gini"] <= limits.max_gini and (jackpot is None or jackpot <= limits.max_jackpot)


def by_likelihood(runs: list[Run]) -> list[Run]:
    return sorted(runs, key=lambda r: (-r.log_like, r.seed))


def best_run(runs: list[Run], limits: Limits) -> Run | None:
    """The most likely of the runs that pass."""
    return next((r for r in by_likelihood(runs) if passes(r, limits)), None)


def agrees(runs: list[Run], limits: Limits) -> bool:
    """Whether another run of the same K found the same clusters as the best one."""
    best, *rest = by_likelihood(runs)
    for other in rest:
        marcd, pearson = compare_runs(best.params.rates, other.params.rates)
        if (not limits.max_loglike_vs_best or best.log_like - other.log_like <= limits.max_loglike_vs_best) and pearson >= limits.min_pearson_vs_best and marcd <= limits.max_marcd_vs_best:
            return True
    return best.params.k == 1


def best_k(runs: dict[int, list[Run]], limits: Limits) -> int:
    """The number of clusters of least BIC, of those with a run that passes; 0 if there is none."""
    found = {k: best_run(rs, limits) for k, rs in runs.items()}
    return min((k for k, r in found.items() if r is not None), key=lambda k: found[k].bic, default=0)


class _Schedule:
    """Which runs a region needs: K from 1 on, each with runs until ``min_runs`` are done and another agrees with the best one
    (at most ``max_runs``); it ends at the first K that is worse than the one before, or after ``max_k``. As that one is
    needed in any case, K + 1 starts along with K."""

    def __init__(self, group: int | None, max_k: int, min_runs: int, max_runs: int, limits: Limits):
        self.group, self.max_k, self.min_runs, self.max_runs, self.limits = group, max_k, min_runs, max_runs, limits
        self.runs: dict[int, list[Run]] = {}
        self.k, self.done = 1, False

    def _most(self, k: int) -> int:
        return 1 if k == 1 else self.max_runs  # a single cluster starts alike whatever the seed

    def _enough(self, k: int) -> int:
        """After how many runs K was through; 0 if it is not."""
        runs, most = self.runs.get(k, []), self._most(k)
        return next((n for n in range(min(self.min_runs, most), len(runs) + 1) if agrees(runs[:n], self.limits)), most if len(runs) >= most else 0)

    def wanted(self) -> list[Start]:
        out = []
        for k in (self.k, self.k + 1):
            have = len(self.runs.get(k, []))
            if not self.done and not (self.max_k and k > self.max_k) and not self._enough(k):
                out += [Start(k, seed, self.group) for seed in range(have, min(self._most(k), have + self.min_runs))]
        return out

    def take(self, found: list[tuple[Start, Run]]) -> None:
        for start, run in found:
            self.runs.setdefault(start.k, []).append(run)
        while not self.done and (n := self._enough(self.k)):
            k = self.k
            self.runs[k] = self.runs[k][:n]
            chosen, before = best_run(self.runs[k], self.limits), best_run(self.runs[k - 1], self.limits) if k > 1 else None
            self.done = k == self.max_k or chosen is None or (before is not None and chosen.bic >= before.bic)
            self.k += not self.done
        if self.done:
            self.runs = {k: runs for k, runs in self.runs.items() if k <= self.k}


def cluster_all(uniq: DataFrame, positions: dict, column: str | None = None, max_k: int = 0, min_runs: int = 6, max_runs: int = 30, limits: Limits | None = None, **em) -> dict[object, tuple[int, dict[int, list[Run]]]]:
    """The whole step for several regions at once, whose runs share every pass: for each, the best K (0: none passes) and all
    runs by K. ``positions`` and ``column`` as in fit()."""
    plans = {group: _Schedule(group, max_k, min_runs, max_runs, limits or Limits()) for group in positions}
    while starts := [s for plan in plans.values() for s in plan.wanted()]:
        found = list(zip(starts, fit(uniq, positions, starts, column, **em)))
        for group, plan in plans.items():
            plan.take([x for x in found if x[0].group == group])
    return {group: (best_k(plan.runs, plan.limits), plan.runs) for group, plan in plans.items()}


def cluster(uniq: DataFrame, positions: DataFrame, **options) -> tuple[int, dict[int, list[Run]]]:
    """The whole step for one region: the best K (0: none passes) and all runs by K; options are those of cluster_all()."""
    return cluster_all(uniq, {None: places(positions)}, **options)[None]


def summary(spark, runs: dict[int, list[Run]]) -> DataFrame:
    """A row for each run: k, seed, log likelihood, BIC, iterations, whether it settled, and its statistics."""
    rows = [(k, r.seed, r.log_like, float(r.bic), len(r.log_likes), r.settled, *run_statistics(r).values()) for k, rs in runs.items() for r in rs]
    return spark.createDataFrame(rows, "k int, seed int, log_like double, bic double, iterations int, settled boolean, min_marcd double, max_pearson double, max_arcd double, max_gini double")


def parameters(spark, run: Run) -> tuple[DataFrame, DataFrame]:
    """clust, pos, mu and clust, share of a run."""
    p = run.params
    rates = spark.createDataFrame([(c + 1, int(x), float(p.rates[c, i])) for c in range(p.k) for i, x in enumerate(p.pos)], "clust int, pos int, mu double")
    return rates, spark.createDataFrame([(c + 1, float(s)) for c, s in enumerate(p.shares)], "clust int, share double")


# Gaps between neighbouring domains.


def _side(batch: pa.RecordBatch, params: Params) -> np.ndarray:
    """[read, cluster]: log likelihood of a read's mutations within one domain."""
    reads = Reads(batch, params.pos)
    run, p = np.array([bias.no_mutation(r) for r in params.rates]), np.clip(params.rates, 1e-9, 1 - 1e-9)
    out = (run[:, reads.last + 1] - run[:, reads.first]).T.copy()
    for k in range(params.k):
        out[:, k] += np.bincount(reads.row, (np.log(p[k]) - np.log1p(-p[k]))[reads.mut], len(out))
    return out


class _Mixture:
    """The search for the shares of cluster pairs, free ones or products of both sides', that make the likelihoods given likeliest. A
    round of EM is a pass over the reads; after every second one the shares go on as far as the last two rounds say (SQUAREM), and back
    to the best ones if that was too far. It has settled when a plain round gains less than the tolerance."""

    def __init__(self, k: int, other: int, free: bool, tolerance: float):
        self.free, self.tolerance = free, tolerance
        self.pi = self.best = np.full((k, other), 1 / (k * other))
        self.like, self.settled = -np.inf, False
        self._steps, self._ahead = [self.pi], False

    def take(self, like: float, resp: np.ndarray) -> None:
        """The log likelihood of the shares that were tried, and the reads' mean weights by them."""
        if self.settled:
            return
        if like < self.like and self._ahead:  # gone too far
            self.pi, self._ahead = self._after, False
            self._steps = [self.pi]
            return
        self.settled = not self._ahead and like - self.like < self.tolerance
        shares = resp if self.free else np.outer(resp.sum(axis=1), resp.sum(axis=0))
        self.like, self.best = like, shares
        self.pi, self._after, self._ahead = shares, shares, False
        self._steps.append(shares)
        if len(self._steps) == 3:
            a, b, c = self._steps
            r, v = b - a, (c - b) - (b - a)
            far = np.linalg.norm(r) / max(np.linalg.norm(v), 1e-300)
            if 1 < far < 1e6 and not self.settled:
                ahead = np.maximum(a + 2 * far * r + far**2 * v, 1e-12)
                ahead /= ahead.sum()
                self.pi = ahead if self.free else np.outer(ahead.sum(axis=1), ahead.sum(axis=0))
                self._ahead = True
            self._steps = [self.pi]


def _written_sides(uniq: DataFrame, gaps: list[tuple[Params, Params]], tested: list[int], across: Callable[[int], Column]) -> DataFrame:
    """gap, joint: for each gap and each unique read that reaches across it, the log likelihoods of its mutations by the pair of
    clusters. They are the same in every round, so they are written once."""

    def run(batches):
        for batch in batches:
            for i, part in _parts(batch, "gap"):
                left, right = gaps[i]
                joint = _side(part, left)[:, :, None] + _side(part, right)[:, None, :]
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * (left.k * right.k)), pa.array(joint.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("gap"), cells], names=["gap", "joint"])

    met = uniq.select("end5", "end3", "muts", "n", F.explode(F.array_compact(F.array(*[F.when(across(i), F.lit(i)) for i in tested]))).alias("gap"))
    path = scratch_path(uniq.sparkSession, "sides")
    met.mapInArrow(run, "gap int, joint array<double>").write.parquet(path)
    return uniq.sparkSession.read.schema("gap int, joint array<double>").parquet(path)


#: What a round of gap_tests() gives back.
_CELLS = pa.schema([("gap", pa.int32()), ("model", pa.int32()), ("cell", pa.int32()), ("value", pa.float64())])


def gap_tests(uniq: DataFrame, gaps: list[tuple[Params, Params]], min_assoc: float = 0.1, rounds: int = 500, tolerance: float = 1e-4, column: str | None = None, groups: list | None = None) -> list[dict]:
    """Whether the clusters on both sides of each gap go independently. Each unique read that reaches into both domains has the
    likelihoods of its mutations there; mixtures of independent and of free shares of cluster pairs are fitted to these,
    one pass a round for all gaps over the likelihoods, which are written once. A gap is spurious (``passed`` false) if the
    free mixture has the lower BIC and its shares lie further than ``min_assoc`` from independent ones. ``uniq``: unique
    reads over everything; with several regions, ``groups`` names each gap's one in ``column``."""
    groups = groups or [None] * len(gaps)
    out: list[dict] = [{"passed": True, "reason": "one cluster on a side"} for _ in gaps]
    tested = [i for i, (left, right) in enumerate(gaps) if min(left.k, right.k) > 1]
    own = lambda i: F.lit(True) if column is None else F.col(column) == groups[i]
    across = lambda i: own(i) & (F.col("end5") <= int(gaps[i][0].pos[-1])) & (F.col("end3") >= int(gaps[i][1].pos[0]))
    if tested:
        n = uniq.agg(*(F.count_if(across(i)).alias(f"n{i}") for i in tested)).first()
        for i in tested:
            out[i] = {"passed": True, "reason": "too few reads reach across", "n": n[f"n{i}"]}
        tested = [i for i in tested if n[f"n{i}"] >= gaps[i][0].k * gaps[i][1].k]
    if not tested:
        return out
    sides = _written_sides(uniq, gaps, tested, across)

    def sums(batches, models: dict[int, list[np.ndarray]]):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, part in _parts(batch, "gap"):
                if i in models:
                    joint = part.column("joint").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                    for m, pi in enumerate(models[i]):
                        resp, marginal = responsibilities(joint + np.log(np.maximum(pi, 1e-300)).ravel())
                        total[i, m] = total.get((i, m), 0) + np.r_[marginal.sum(), resp.sum(axis=0)]
        yield _table([(i, m, cell, float(v)) for (i, m), x in total.items() for cell, v in enumerate(x)], _CELLS)

    searches = {i: [_Mixture(gaps[i][0].k, gaps[i][1].k, free, tolerance) for free in (False, True)] for i in tested}
    for _ in range(rounds):
        if not searches:
            break
        models = {i: [x.pi for x in both] for i, both in searches.items()}
        found = {(r["gap"], r["model"], r["cell"]): r["value"] for r in sides.mapInArrow(lambda b, now=models: sums(b, now), "gap int, model int, cell int, value double").groupBy("gap", "model", "cell").agg(F.sum("value").alias("value")).collect()}
        for i, both in list(searches.items()):
            (left, right), n = gaps[i], out[i]["n"]
            for m, search in enumerate(both):
                search.take(found[i, m, 0], np.array([found[i, m, c + 1] for c in range(left.k * right.k)]).reshape(left.k, right.k) / n)
            product, free = both[0].best, both[1].best
            bic = [-2 * both[0].like + (left.k + right.k - 2) * np.log(n), -2 * both[1].like + (left.k * right.k - 1) * np.log(n)]
            assoc = float(np.abs(free - product).max())
            out[i] = {"passed": not (bic[1] < bic[0] and assoc > min_assoc), "n": n, "coupling": float(bic[0] - bic[1]), "assoc": assoc}
            if all(x.settled for x in both):
                del searches[i]
    return out


def gap_test(uniq: DataFrame, left: Params, right: Params, **options) -> dict:
    """gap_tests() of one gap."""
    return gap_tests(uniq, [(left, right)], **options)[0]


def settle(domains: list[tuple], fit_all: Callable[[list[tuple]], list], test_all: Callable[[list[tuple]], list[dict]], region: Callable[[tuple], object] = lambda d: None) -> tuple[list[tuple], dict, list[dict]]:
    """Domains, (first, last, ...), whose gaps are all genuine. Of each region, the most strongly coupled pair of neighbours that
    fails its test is merged, until none fails. What is new is fitted in one call and tested in one call a round, for all
    regions; fits and tests of what stays are kept. Returns the domains, their fits, and what was merged and why."""
    found: dict = {}
    for d in sorted(domains):
        found.setdefault(region(d), []).append(d)
    fits, tests, log = {}, {}, []
    while True:
        new = [d for ds in found.values() for d in ds if d not in fits]
        fits.update(zip(new, fit_all(new) if new else [], strict=True))
        pairs = [p for ds in found.values() for p in zip(ds, ds[1:])]
        fresh = [p for p in pairs if p not in tests]
        tests.update(zip(fresh, test_all([(fits[a], fits[b]) for a, b in fresh]) if fresh else [], strict=True))
        merged = False
        for ds in found.values():
            failed = [(tests[p]["coupling"], i) for i, p in enumerate(zip(ds, ds[1:])) if not tests[p]["passed"]]
            if failed:
                i, merged = max(failed)[1], True
                left, right = ds[i : i + 2]
                log.append({"left": left, "right": right, **tests[left, right]})
                ds[i : i + 2] = [(left[0], right[1], *left[2:])]
        if not merged:
            return [d for ds in found.values() for d in ds], fits, log


def validate_gaps(domains: list[tuple[int, int]], fit: Callable[[int, int], Params], test: Callable[[Params, Params], dict]) -> tuple[list[tuple[int, int]], list[dict]]:
    """settle() of one region, domain by domain: the domains, and what was merged."""
    settled, _, log = settle(domains, lambda ds: [fit(*d) for d in ds], lambda pairs: [test(*p) for p in pairs])
    return settled, log
