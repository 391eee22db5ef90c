"""Statistics as column expressions, and the distributions that Spark has not, in NumPy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def log_factorial(n: int) -> np.ndarray:
    """ln 0! to ln n!."""
    return np.r_[0.0, np.cumsum(np.log(np.arange(1, n + 1)))]


def hypergeometric_tails(n, a, b, ab) -> tuple[np.ndarray, np.ndarray]:
    """P(X <= ab) and P(X >= ab) for the overlap of a and b drawn from n."""
    n, a, b, ab = (np.asarray(x, np.int64) for x in (n, a, b, ab))
    lf = log_factorial(int(n.max(initial=0)))
    low, high = np.empty(len(n)), np.empty(len(n))
    for i, (N, A, B, x) in enumerate(zip(n, a, b, ab, strict=True)):
        k = np.arange(max(0, A + B - N), min(A, B) + 1)
        logp = lf[A] - lf[k] - lf[A - k] + lf[N - A] - lf[B - k] - lf[N - A - B + k] - (lf[N] - lf[B] - lf[N - B])
        p = np.exp(logp)
        low[i], high[i] = min(1.0, p[k <= x].sum()), min(1.0, p[k >= x].sum())
    return low, high


# Tails and quantiles as column expressions. A tail is a sum of terms that fall from its first on, each made from the one
# before it; ten standard deviations of them, and some for skewed cases, hold all that double precision can tell.

#: ln k! is listed up to here; beyond, Stirling's series is exact to double precision.
LISTED = 16


def log_factorials(n: Column) -> Column:
    """ln n! of a whole number."""
    x = n.cast("double")
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    listed = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(LISTED)])
    return F.when(n < LISTED, F.get(listed, n.cast("int"))).otherwise((x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorials(n) - log_factorials(k) - log_factorials(n - k)


def _terms(sd: Column) -> Column:
    return F.ceil(10 * sd).cast("int") + 60


def _falling(steps: Column, ratio_at) -> Column:
    """1 + r(0) + r(0) r(1) + ... of so many ratios."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] * ratio_at(j)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(steps, F.lit(1)) - 1), start, add, lambda acc: acc["sum"])).otherwise(1.0)


def hypergeometric(table, n: str = "n", a: str = "a", b: str = "b", ab: str = "ab", low: str = "low", high: str = "high"):
    """The table with P(X <= ab) and P(X >= ab) for the overlap of a and b drawn from n. Counts that cannot be have null."""
    N, A, B, x = (F.col(c).cast("double") for c in (n, a, b, ab))
    least, most = F.greatest(F.lit(0.0), A + B - N), F.least(A, B)
    mode = F.floor((A + 1) * (B + 1) / (N + 2)).cast("double")
    sd = F.sqrt(F.greatest(A * B / N * (1 - A / N) * (N - B) / F.greatest(N - 1, F.lit(1.0)), F.lit(0.0)))
    below = x <= mode
    steps = F.least(F.when(below, x - least).otherwise(most - x).cast("int"), _terms(F.coalesce(sd, F.lit(0.0))))
    fact = {c: F.col(c) for c in (n, a, b, ab)}
    at = F.exp(log_choose(fact[a], fact[ab]) + log_choose(fact[n] - fact[a], fact[b] - fact[ab]) - log_choose(fact[n], fact[b]))
    held = table.withColumns({"_x": x, "_at": at, "_below": below, "_steps": steps, "_sound": (x >= least) & (x <= most) & (A <= N) & (B <= N)})

    def further(j: Column) -> Column:
        down, up = F.col("_x") - j, F.col("_x") + j
        return F.when(F.col("_below"), down * (N - A - B + down) / ((A - down + 1) * (B - down + 1))).otherwise((A - up) * (B - up) / ((up + 1) * (N - A - B + up + 1)))

    held = held.withColumn("_tail", F.least(F.lit(1.0), F.when(F.col("_sound"), F.col("_at") * _falling(F.col("_steps"), further))))
    rest = F.least(F.lit(1.0), F.greatest(1 - F.col("_tail") + F.col("_at"), F.lit(0.0)))
    tails = {low: F.when(F.col("_below"), F.col("_tail")).otherwise(rest), high: F.when(F.col("_below"), rest).otherwise(F.col("_tail"))}
    return held.withColumns({c: F.when(F.col("_sound"), v) for c, v in tails.items()}).drop("_x", "_at", "_below", "_steps", "_sound", "_tail")


def binomial_quantiles(k: Column, n: Column, *shares: Column) -> Column:
    """Array of the least numbers, for each share, of which a binomial with the rate k / n has that share at or below: its
    distribution is summed up once, from ten standard deviations below its mean to ten above. k where k is 0 or n."""
    size, hits = n.cast("double"), k.cast("double")
    p = hits / size
    reach = _terms(F.sqrt(size * p * (1 - p)))
    first = F.greatest(F.floor(size * p).cast("long") - reach, F.lit(0).cast("long"))
    last = F.least(F.ceil(size * p).cast("long") + reach, n.cast("long"))
    start = F.exp(log_choose(n, first) + first * F.log(p) + (size - first) * F.log1p(-p))
    none = F.lit(None).cast("long")
    zero = F.struct(start.alias("term"), F.lit(0.0).alias("sum"), F.array(*[none for _ in shares]).alias("found"))

    def add(acc: Column, i: Column) -> Column:
        total = acc["sum"] + acc["term"]
        found = [F.coalesce(F.get(acc["found"], F.lit(j)), F.when(total >= share, i)) for j, share in enumerate(shares)]
        return F.struct((acc["term"] * (size - i) / (i + 1) * p / (1 - p)).alias("term"), total.alias("sum"), F.array(*found).alias("found"))

    found = F.aggregate(F.sequence(first, last), zero, add, lambda acc: acc["found"])
    # what rounding leaves of the last share belongs to the last number
    inner = F.array(*[F.coalesce(F.get(found, F.lit(j)), last) for j in range(len(shares))])
    return F.when((hits <= 0) | (hits >= size) | (size <= 0), F.array(*[k.cast("long") for _ in shares])).otherwise(inner)


def chance(*keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys alone: 48 bits of the MD5 digest of their texts, joined by colons."""
    text = F.concat_ws(":", *[(F.col(x) if isinstance(x, str) else x).cast("string") for x in keys])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gamma = np.vectorize(math.lgamma, otypes=[float])
    return gamma(a) + gamma(b) - gamma(a + b)


def beta_cdf(x, a, b) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction."""
    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    turn = x > (a + 1) / (a + b + 2)
    z, p, q = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    inside = (z > 0) & (z < 1)
    y = np.where(inside, z, 0.5)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    value = np.exp(p * np.log(y) + q * np.log1p(-y) - log_beta(p, q)) * h / p
    value = np.where(inside, value, np.where(z <= 0, 0.0, 1.0))
    return np.where(turn, 1 - value, value)


def binomial_tail(k, n, p) -> np.ndarray:
    """P(X >= k)."""
    k, n, p = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.asarray(p, float))
    inside = (k > 0) & (k <= n)
    value = beta_cdf(p, np.where(inside, k, 1.0), np.where(inside, n - k + 1, 1.0))
    return np.where(k <= 0, 1.0, np.where(inside, value, 0.0))


def binomial_quantile(q, n, p) -> np.ndarray:
    """The least k with P(X <= k) >= q, by halving."""
    q, n, p = np.broadcast_arrays(np.asarray(q, float), np.asarray(n, float), np.asarray(p, float))
    low, high = np.full(n.shape, -1.0), n.copy()
    while np.any(high - low > 1):
        middle = np.floor((low + high) / 2)
        enough = 1 - binomial_tail(middle + 1, n, p) >= q
        high, low = np.where(enough, middle, high), np.where(enough, low, middle)
    return high


def chi_square_tail(x: float, dof: int) -> float:
    """P(X > x) of a chi-square distribution, by the series or the continued fraction of the incomplete gamma function."""
    a, x = dof / 2, x / 2
    if x <= 0 or a <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for i in range(1, 10_000):
            term *= x / (a + i)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        top = -i * (i - a)
        b += 2
        d = 1 / (top * d + b)
        c = b + top / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def student_interval(values: list[float], confidence: float) -> tuple[float, float]:
    """Interval of the mean by Student's distribution, with the variance over n; NaN for fewer than two values."""
    n = len(values)
    if n < 2:
        return math.nan, math.nan
    goal, low, high = (1 + confidence) / 2, 0.0, 1e6
    cdf = lambda t: float(1 - 0.5 * beta_cdf((n - 1) / (n - 1 + t * t), (n - 1) / 2, 0.5))
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < goal else (low, middle)
    mean = sum(values) / n
    half = low * math.sqrt(sum((v - mean) ** 2 for v in values) / n / n)
    return mean - half, mean + half


def binomial_interval(k: int, n: int, confidence: float) -> tuple[int, int]:
    """Central interval of a binomial with the observed rate."""
    low, high = binomial_intervals(np.array([k]), np.array([n]), confidence)
    return int(low[0]), int(high[0])


def binomial_intervals(k: np.ndarray, n: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Central intervals of binomials with the observed rates."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    p = np.where(n > 0, k / np.maximum(n, 1), 0.0)
    tail = (1 - confidence) / 2
    sure = (p <= 0) | (p >= 1)
    low, high = (binomial_quantile(q, n, np.where(sure, 0.5, p)) for q in (tail, 1 - tail))
    return np.where(sure, k, low), np.where(sure, k, high)


def with_intervals(table, count: str, total: str, confidence: float = 0.95):
    """A table with <count>_low and <count>_high: the interval of a count, of which there were ``total`` trials, as column
    expressions."""
    tail = (1 - confidence) / 2
    k, n = F.coalesce(F.col(count), F.lit(0)), F.coalesce(F.col(total), F.lit(0))
    held = table.withColumn("_ends", binomial_quantiles(k, n, F.lit(tail), F.lit(1 - tail)))
    return held.withColumns({f"{count}_low": F.col("_ends")[0].cast("double"), f"{count}_high": F.col("_ends")[1].cast("double")}).drop("_ends")


def resample(table, count: str, total: str, key: list[str], seed: int):
    """A table whose counts are drawn anew, each from a binomial with the observed rate: the number at a share that depends
    on the row's key and the seed alone, so it is the same whatever the partitions."""
    k, n = F.coalesce(F.col(count), F.lit(0)), F.coalesce(F.col(total), F.lit(0))
    kind = dict(table.dtypes)[count]
    return table.withColumn(count, binomial_quantiles(k, n, chance(*key, F.lit(seed)))[0].cast(kind)).select(*table.columns)


def phi(n: Column, a: Column, b: Column, ab: Column, least: int = 1) -> Column:
    """Phi coefficient of a 2 x 2 table, in [-1, 1]; null under the least coverage or without variation."""
    n, a, b, ab = (x.cast("double") for x in (n, a, b, ab))
    varies = (a > 0) & (b > 0) & (a < n) & (b < n) & (n >= least)
    root = F.sqrt(a / n * (b / n) * (1 - a / n) * (1 - b / n))
    return F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ab / n - a / n * (b / n)) / root)))


def chi_square(n: Column, a: Column, b: Column, ab: Column, least: int = 1) -> Column:
    n, a, b, ab = (x.cast("double") for x in (n, a, b, ab))
    varies = (a > 0) & (b > 0) & (a < n) & (b < n) & (n >= least)
    gap = ab / n - a / n * (b / n)
    return F.when(varies, n * gap * gap / (a / n * (1 - a / n) * (b / n) * (1 - b / n)))


def arcsine_distance(x: Column, y: Column) -> Column:
    return F.abs(F.asin(2 * x - 1) - F.asin(2 * y - 1)) / math.pi


def bic(n_params: Column, n_data: Column, log_like: Column) -> Column:
    return n_params * F.log(n_data) - 2 * log_like


def beta_params(mean: Column, variance: Column) -> tuple[Column, Column]:
    """alpha and beta from the mean and the variance."""
    nu = mean * (1 - mean) / variance - 1
    return mean * nu, (1 - mean) * nu


def beta_moments(alpha: Column, beta: Column) -> tuple[Column, Column]:
    total = alpha + beta
    return alpha / total, alpha * beta / (total * total * (total + 1))


def kumaraswamy(x: Column, a: float, b: float) -> Column:
    return a * b * F.pow(x, F.lit(a - 1)) * F.pow(1 - F.pow(x, F.lit(a)), F.lit(b - 1))


def double_kumaraswamy(x: Column, w: float, a1: float, b1: float, a2: float, b2: float) -> Column:
    """A mixture of two, the first of weight w."""
    return w * kumaraswamy(x, a1, b1) + (1 - w) * kumaraswamy(x, a2, b2)


def dirichlet_params(means: Column, variances: Column) -> Column:
    """Parameters (an array) of any number of categories from arrays of their means and variances; null if these do not
    go together in one distribution."""
    each = F.zip_with(means, variances, lambda m, v: m * (1 - m) / v - 1)
    total = F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x, lambda acc: acc / F.size(each))
    alike = F.forall(each, lambda x: F.abs(x - total) <= 1e-8 + 1e-5 * F.abs(total))
    return F.when(alike & (total > 0), F.transform(means, lambda m: m * total))


def dirichlet_moments(alphas: Column) -> tuple[Column, Column]:
    """Arrays of means and variances from an array of parameters."""
    total = F.aggregate(alphas, F.lit(0.0), lambda acc, x: acc + x)
    means = F.transform(alphas, lambda a: a / total)
    return means, F.transform(means, lambda m: m * (1 - m) / (total + 1))


def semi_g_anomaly(n: Column, log_expected: Column) -> Column:
    """Half of a read's part in the G statistic."""
    return F.when(n > 0, n * (F.log(n) - log_expected)).otherwise(0.0)


def jackpot_score(uniq, key: tuple[str, ...] = ()):
    """key, score: mean log ratio of observed (n) to expected (log_exp) counts of unique reads; 0 without reads."""
    total = F.sum("n")
    return uniq.groupBy(*key).agg(F.when(total > 0, F.sum(semi_g_anomaly(F.col("n"), F.col("log_exp"))) / total).otherwise(0.0).alias("score"))


def jackpot_quotient(real: Column, null: Column) -> Column:
    return F.exp(real - null)


def block_score(eligible: Column, bridges: Column, null_rate: float, least: float = 1e-9) -> Column:
    """Binomial log-likelihood ratio against the null rate, less half the logarithm of the pairs."""
    n, k = eligible.cast("double"), bridges.cast("double")
    rate = F.least(F.greatest(k / n, F.lit(null_rate)), F.lit(1 - least))
    gain = k * F.log(rate / null_rate) + (n - k) * F.log((1 - rate) / (1 - null_rate))
    return F.when(n > 0, gain - F.log(n) / 2)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for 0 / 0 and the like."""
    return F.when(b != 0, a / b)


def triangular(n: Column) -> Column:
    return (n * (n + 1) / 2).cast("long")


def celsius(t: Column) -> Column:
    """A temperature in °C, if it was in K."""
    return F.when(t >= 200, t - 273.15).otherwise(t)


def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys alone, whatever the partitions."""
    return (F.xxhash64(*keys).bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)


def stochastic_round(x: Column, *keys: Column | str) -> Column:
    """Up or down at random, by the keys, so that the mean is kept."""
    return F.floor(x + uniform(*keys))


def round_preserving(x: Column, over, start: Column | float = 0.5) -> Column:
    """Whole numbers with the sum (rounded) of the numbers themselves, along a window's order: the steps of the running
    sum's whole part, which begins at ``start`` in [0, 1) (a random one, for a random rounding)."""
    start = F.lit(start) if isinstance(start, float) else start
    total = F.sum(x).over(over)
    return (F.floor(total + start) - F.floor(total - x + start)).cast("long")


def pattern_rate(rates, pat: tuple, by: tuple[str, ...] = ()):
    """pos, base, mu: total rate of the codes (pos, base, rel, p) that fit a pattern, of those that decide it."""
    from .codes import informative

    info, fit = informative(F.col("base"), F.col("rel"), pat)
    return rates.groupBy(*by, "pos", "base").agg((F.sum(F.when(fit, F.col("p")).otherwise(0.0)) / F.sum(F.when(info, F.col("p")).otherwise(0.0))).alias("mu"))
