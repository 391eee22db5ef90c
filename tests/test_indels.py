"""Ambiguous indels of both kinds against the enumeration of all alignments of short references."""

import collections
import itertools
import random

import pytest

from readloom.functions import codes
from readloom.operators import alignments


def alignments_of(ref, seq, inserted):
    """Every way to pair the read with the whole reference, with so many inserted bases at most: columns of (position, index), aligned
    at both ends, no deletion beside an insertion."""
    out = []

    def go(columns, r, q, i):
        if r == len(ref) and q == len(seq):
            out.append(tuple(columns))
            return
        inside = 0 < len(columns)
        last = columns[-1] if columns else (0, 0)
        if r < len(ref) and q < len(seq):
            go([*columns, (r + 1, q)], r + 1, q + 1, i)
        if r < len(ref) - 1 and inside and last[0] is not None:
            go([*columns, (r + 1, None)], r + 1, q, i)
        if q < len(seq) - 1 and inside and i < inserted and last[1] is not None:
            go([*columns, (None, q)], r, q + 1, i + 1)

    go([], 0, 0, 0)
    return out


def said(ref, seq, qual, columns, insert3, least="?"):
    """The codes of one alignment."""
    rels = {}
    for i, (r, q) in enumerate(columns):
        if r is None:
            continue
        if q is None:
            rels[r] = codes.DELETION
            continue
        own = codes.SUBS[ref[r - 1]]
        code = codes.ANY_N ^ own if qual[q] < least or seq[q] == "N" else codes.MATCH if seq[q] == ref[r - 1] else codes.SUBS[seq[q]]
        beside = columns[i - 1] if insert3 and i else columns[i + 1] if not insert3 and i + 1 < len(columns) else (0, 0)
        if beside[0] is None:
            code = (0 if code == codes.MATCH else code) | (codes.INSERT_3 if insert3 else codes.INSERT_5)
        rels[r] = code
    return rels


def kinds(columns):
    """The order of deletions and insertions, which no move of one indel changes."""
    return tuple("I" if r is None else "D" for r, q in columns if r is None or q is None)


def alike(columns):
    """Sets of these alignments that single steps of single indels lead through."""
    places = [(kinds(c), tuple(r for r, q in c if q is None), tuple(q for r, q in c if r is None)) for c in columns]
    near = lambda a, b: all(abs(x - y) <= 1 for x, y in zip(a, b, strict=True))
    left, out = set(range(len(columns))), []
    while left:
        group, todo = [], [left.pop()]
        while todo:
            i = todo.pop()
            group.append(i)
            found = [j for j in left if places[j][0] == places[i][0] and ((places[j][1] == places[i][1] and near(places[j][2], places[i][2])) or (places[j][2] == places[i][2] and near(places[j][1], places[i][1])))]
            todo += found
            left -= set(found)
        out.append(group)
    return out


def cigar_of(columns):
    return "".join(f"{len(list(g))}{k}" for k, g in itertools.groupby("I" if r is None else "D" if q is None else "M" for r, q in columns))


def check(ref, seq, qual, group, insert3):
    """Each of these alignments gives what all of them say together."""
    expected = collections.defaultdict(int)
    for columns in group:
        for r, code in said(ref, seq, qual, columns, insert3).items():
            expected[r] |= code
    for columns in group:
        got = alignments.walk(seq, qual, 1, cigar_of(columns), ref, 30, insert3=insert3)[1]
        assert got == {r: c for r, c in expected.items() if c != codes.MATCH}, (ref, seq, qual, cigar_of(columns), insert3, got, dict(expected))
    return True


def hold(ref, seq, qual, insert3, inserted=2):
    """How many alignments were looked at; of those with fewest mutations, each has to give what all alike to it say together."""
    every = alignments_of(ref, seq, inserted)
    cost = [sum(r is None or q is None or (seq[q] != ref[r - 1] and qual[q] >= "?") for r, q in c) for c in every]
    best = [c for c, n in zip(every, cost, strict=True) if n == min(cost)]
    for group in alike(best):
        check(ref, seq, qual, [best[i] for i in group], insert3)
    return len(best)


@pytest.mark.parametrize("ref", ["AGCT", "CTTTG"])
def test_every_read(ref):
    """All reads of short references, with deletions and up to two inserted bases."""
    seen = 0
    for n in range(2, len(ref) + 2):
        for seq in map("".join, itertools.product("ACGT", repeat=n)):
            for insert3 in (True, False):
                seen += hold(ref, seq, "I" * n, insert3) if alignments_of(ref, seq, 2) else 0
    assert seen > 5000


@pytest.mark.parametrize("mismatches", [0, 1])
def test_deletion_and_insertion(mismatches):
    """A deletion and an insertion each go as far as the other lets them; they keep their order."""
    rng, seen = random.Random(7), 0
    for _ in range(400):
        ref = "".join(rng.choice("AC") for _ in range(rng.randint(6, 9)))
        seq = list(ref)
        del seq[rng.randint(1, len(seq) - 2)]
        seq.insert(rng.randint(1, len(seq) - 1), rng.choice("AC"))
        seq = "".join(seq)
        every = [c for c in alignments_of(ref, seq, 1) if sorted(kinds(c)) == ["D", "I"]]
        every = [c for c in every if sum(r is not None and q is not None and seq[q] != ref[r - 1] for r, q in c) == mismatches]
        for insert3 in (True, False):
            for group in alike(every):
                seen += len(group) > 2 and check(ref, seq, "I" * len(seq), [every[i] for i in group], insert3)
    assert seen > 300


def test_low_quality():
    """Bases of low quality may stand for any other, so a deletion among them may be anywhere but at the ends."""
    rng = random.Random(4)
    for n in range(3, 10):
        ref = "".join(rng.choice("ACGT") for _ in range(n))
        expected = {r: (codes.DELETION if 1 < r < n else 0) | (0 if n == 3 and r == 2 else codes.ANY_N ^ codes.SUBS[ref[r - 1]]) for r in range(1, n + 1)}
        for r in range(2, n):
            for insert3 in (True, False):
                assert alignments.walk(ref[: r - 1] + ref[r:], "!" * (n - 1), 1, f"{r - 1}M1D{n - r}M", ref, 30, insert3=insert3) == ([(1, n)], expected)
