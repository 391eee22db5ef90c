"""Clusters of several regions joined at the least cost, against the enumeration of all joint numberings."""

import itertools

import numpy as np
import pytest

from readloom.plans import clustering


def cost_of(regions, orders):
    """orders[name][cluster]: joined number."""
    total = 0.0
    for (p, one), (q, two) in itertools.combinations(regions.items(), 2):
        _, i, j = np.intersect1d(one[0], two[0], return_indices=True)
        for a, b in itertools.product(range(len(one[1])), repeat=2):
            if orders[p][a] == orders[q][b]:
                total += clustering.arcsine(one[1][a, i], two[1][b, j]).sum()
                if len(one) > 2:
                    total += clustering.arcsine(np.array([one[2][a]]), np.array([two[2][b]])).sum()
    return total


@pytest.mark.parametrize(("n", "k"), [(1, 3), (2, 1), (2, 4), (3, 3), (4, 3), (3, 4), (5, 2)])
def test_least_cost(n, k):
    rng = np.random.default_rng(n * 10 + k)
    worse = 0
    for case in range(12):
        base = rng.uniform(0, 0.6, size=(k, 60))
        regions = {}
        for r in range(n):
            pos = np.arange(5 * r, 5 * r + rng.integers(4, 16))
            noise = rng.uniform(0, 0.6, size=(k, len(pos)))
            rates = base[rng.permutation(k)][:, pos] * 0.4 + noise * 0.6
            regions[f"r{r}"] = (pos, rates, rng.dirichlet(np.ones(k))) if case % 2 else (pos, rates)
        got = clustering.correspond(regions)
        assert got["r0"] == list(range(k)) and all(sorted(x) == list(range(k)) for x in got.values())
        names = list(regions)
        every = [cost_of(regions, dict(zip(names, [tuple(range(k)), *orders]))) for orders in itertools.product(itertools.permutations(range(k)), repeat=n - 1)]
        assert cost_of(regions, got) == pytest.approx(min(every))
        # what one gets by matching each region with the first alone costs more in some cases
        alone = {"r0": list(range(k))}
        for name in names[1:]:
            _, i, j = np.intersect1d(regions["r0"][0], regions[name][0], return_indices=True)
            order = clustering.match(regions["r0"][1][:, i], regions[name][1][:, j])
            alone[name] = [int(x) for x in np.argsort(order)]
        worse += cost_of(regions, alone) > min(every) + 1e-9
    assert n < 3 or worse > 0


def test_regions_of_different_clusters():
    with pytest.raises(ValueError, match="same number"):
        clustering.correspond({"a": (np.arange(2), np.zeros((1, 2))), "b": (np.arange(2), np.zeros((2, 2)))})
    assert clustering.correspond({}) == {}


def test_many_regions():
    """A dozen regions that agree well are joined at once."""
    rng = np.random.default_rng(1)
    base = rng.uniform(0, 0.6, size=(3, 70))
    truth = {f"r{r}": rng.permutation(3) if r else np.arange(3) for r in range(12)}
    regions = {name: (np.arange(5 * r, 5 * r + 12), base[order][:, 5 * r : 5 * r + 12] + rng.normal(0, 0.01, (3, 12))) for r, (name, order) in enumerate(truth.items())}
    assert clustering.correspond(regions) == {name: order.tolist() for name, order in truth.items()}
