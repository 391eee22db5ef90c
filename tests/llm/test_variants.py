"""Spelling variants, SimHash and whitening against brute-force versions, and on awkward tables."""

import collections
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from readloom.llm import pigeonhole, queries, simhash, spelling, whitening

from .test_operators import AWKWARD, DOCS, made


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) == len(a):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_variants(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            i = h % len(run)
            n[run[:i] + run[i + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and one_apart(v, w)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def misspelt(seed=1, documents=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdé") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    weights = [1 / (k + 1) ** 2 for k in range(len(stems))]

    def word():
        w = rng.choices(stems, weights)[0]
        for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
            i, c = rng.randrange(len(w)), rng.choice("abcdéÉZ")
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
        return w

    return [(i, " ".join(word() + rng.choice(["", ",", "1"]) for _ in range(200))) for i in range(documents)]


@pytest.mark.parametrize("limit", [20, spelling.LIMIT])
def test_variants(spark, limit):
    rows = [*misspelt(), (None, "Tribute tribute tribute"), (None, None), (7, ""), (7, "tribut3 tribute"), (7, "tribute"), (9, "x" * 5000 + " " + "x" * 5000), (10, "x" * 5000), (11, "x" * 4999 + "y " + "x" * 4999 + "y")]
    docs = spark.createDataFrame([(*r, 1, "own") for r in rows], "doc_id long, text string, n long, word string").repartition(3)
    # a group that knows all but one letter can hold 90 * 91 words, more than the small limit: split by hand only as far as it goes
    if limit < spelling.LIMIT:
        words = spelling.vocabulary(docs)
        expected = {(w, k) for w, _, _, _, k, _ in expected_variants(rows) if k}
        start = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m"), F.lit(0).alias("p"), F.lit(0).alias("s"))
        deep = spelling._halves(spelling._halves(start)).where("m - p - s >= 1")
        assert deep.groupBy("m", "p", "s", "ends").count().count() > 100
        assert {(r["word"], r["n_near"]) for r in spelling.neighbours(words, 60).collect()} == expected
    else:
        got = spelling.variants(docs, limit=limit).collect()
        assert {tuple(r) for r in got} == expected_variants(rows) and len(got) == len({r["word"] for r in got})
        assert any(r["form"] != r["root"] for r in got if r["form"])


def test_variants_of_nothing(spark):
    for rows in ([], [(1, None), (2, "too short it is"), (3, "different words only")]):
        assert spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


def test_position_index():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    index = spelling.PositionIndex(words)
    for w in [*words, "ababab", "b"]:
        replaced, shorter, longer = index.near(w)
        found = replaced | shorter | longer
        assert [words[k] for k in range(len(words)) if found >> k & 1] == [v for v in words if one_apart(v, w)]
        assert replaced & shorter == replaced & longer == shorter & longer == 0
        away = sum(index.near(w, 2))
        assert [words[k] for k in range(len(words)) if away >> k & 1] == [v for v in words if one_apart(v, w) and v[:2] != w[:2]]


def simple_fingerprint(text, k=3):
    ws = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + k]), 42) for i in range(max(1, len(ws) - k + 1))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def expected_components(rows, fps, distance=2):
    found = list(set(fps))
    root = {f: f for f in found}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(found):
        for b in found[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[top(a)] = top(b)
    least = {}
    for (doc_id, _), f in zip(rows, fps, strict=True):
        if doc_id is not None:
            least[top(f)] = min(doc_id, least.get(top(f), doc_id))
    return [(doc_id, f"{f:016x}", least.get(top(f))) for (doc_id, _), f in zip(rows, fps, strict=True)]


def test_simhash(spark):
    base = [(r[0], r[1]) for r in made(80)]
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [*base, *[(500 + k, t) for k, (_, t) in enumerate(AWKWARD)], (None, base[3][1]), (None, "nothing like it anywhere else"), (3, base[4][1]), (3, base[4][1]), (700, long), (701, long + " more"), (702, base[2][1].upper())]
    docs = spark.createDataFrame([(*r, "own", 5) for r in rows], "doc_id long, text string, fingerprint string, fp int").repartition(4)
    fps = [simple_fingerprint(t) for _, t in rows]
    got = sorted((tuple(r) for r in simhash.link(docs).collect()), key=str)
    assert got == sorted(expected_components(rows, fps), key=str)
    assert simhash.link(docs.limit(0)).collect() == []
    assert simhash.fingerprint(long, size=1000) == simple_fingerprint(long)


def test_simhash_of_one_large_group(spark, monkeypatch):
    """Thousands of fingerprints that agree in most blocks are split until groups are small, and no link is lost."""
    monkeypatch.setattr(simhash, "LIMIT", 40)
    rng = random.Random(8)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 4)) + rng.sample(range(64), rng.randint(0, 2))) for s in seeds for _ in range(400)})
    table = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    calls = []
    monkeypatch.setattr(pigeonhole.common, "materialize", lambda df, name, f=pigeonhole.common.materialize: calls.append(name) or f(df, name))
    links = [tuple(r) for r in simhash.links(table).collect()]
    assert calls.count("split") >= 2
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
    rows = [(i, None) for i in range(len(fps))]
    root = {simhash._signed(f): simhash._signed(f) for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in links:
        root[top(a)] = top(b)
    groups = collections.defaultdict(list)
    for i, f in enumerate(fps):
        groups[top(simhash._signed(f))].append(i)
    least = {i: g[0] for g in groups.values() for i in g}
    assert [least[i] for i in range(len(fps))] == [c for _, _, c in expected_components(rows, fps)]


def integers(vector):
    return [math.floor(1024 * c) + 100_000 for c in vector]


def check_whitening(got, vectors, most=8):
    xs = [integers(v) for v in vectors]
    n, d = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(d)]
    v = np.array([[float(Fraction(n * sum(x[i] * x[j] for x in xs) - sums[i] * sums[j], n * n)) for j in range(d)] for i in range(d)])
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    assert len(got) == n * min(most, d)
    by_row = collections.defaultdict(list)
    for r in got:
        by_row[r["vec_id"]].append(r)
    for k, x in enumerate(xs):
        rows = sorted(by_row[k], key=lambda r: r["component"])
        assert [r["component"] for r in rows] == list(range(1, min(most, d) + 1)) and all(r["n"] == n for r in rows)
        exact = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        assert all(r["deviation_digits"] == str(exact) and r["deviation"] == (exact if exact < 2**63 else None) for r in rows)
    signs = {}
    for r in got:
        i = r["component"] - 1
        if e[i] > 1e-9 * e[0] and (i == 0 or e[i - 1] / e[i] > 1.001) and (i + 1 == d or e[i] > 1.001 * max(e[i + 1], 0)):
            want = float(np.dot([float(Fraction(n * a - s, n)) for a, s in zip(xs[r["vec_id"]], sums, strict=True)], w[:, i]) / math.sqrt(e[i]))
            sign = signs.setdefault(i, math.copysign(1, want * r["whitened"]) if abs(want) > 1e-3 else None)
            if sign is None:
                del signs[i]
            else:
                assert abs(r["whitened"] - sign * want) < 1e-5
            assert abs(r["explained"] - e[i] / np.trace(v)) < 1e-6 * r["explained"]
        assert r["identity_error"] < 1e-6


def test_whitening(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.2).astype(np.float32).tolist()
    spoilt = [(None, None), (901, [1.0] * 11 + [None]), (902, [1.0] * 11 + [math.nan]), (903, [math.inf] + [0.0] * 11), (904, []), (905, [1.0, 2.0]), (906, [1.0] * 13), (907, [1e38] + [0.0] * 11)]
    table = spark.createDataFrame([(*r, 1, "own") for r in [*enumerate(vectors), *spoilt]], "vec_id long, embedding array<float>, component int, x string").repartition(5)
    check_whitening(whitening.whiten(table).collect(), vectors)
    assert whitening.whiten(table.limit(0)).collect() == []
    assert whitening.whiten(table.where("vec_id > 900 and vec_id < 905")).collect() == []


def test_whitening_of_wide_ranges_and_few_dimensions(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(100, 5)) * np.array([1e13, 1.0, 1e-2, 1e6, 0])
    table = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>").repartition(3)
    got = whitening.whiten(table).collect()
    assert len(got) == 500 and all(r["whitened"] is None and r["explained"] == 0 for r in got if r["component"] == 5)
    assert all(r["identity_error"] < 1e-6 for r in got)
    xs = [integers(v) for v in vectors.tolist()]
    sums = [sum(c) for c in zip(*xs, strict=True)]
    assert {(r["vec_id"], r["deviation_digits"]) for r in got} == {(k, str(sum((100 * a - s) ** 2 for a, s in zip(x, sums, strict=True)))) for k, x in enumerate(xs)}
    whitened = np.array([[r["whitened"] for r in sorted(got, key=lambda r: (r["vec_id"], r["component"])) if r["component"] < 5]]).reshape(100, 4)
    assert np.abs(whitened.T @ whitened / 100 - np.eye(4)).max() < 1e-6


def test_whitening_of_rows_that_do_not_vary(spark):
    table = spark.createDataFrame([(None, [0.5, 0.25])] * 3 + [(1, [0.5, 0.25])], "vec_id long, embedding array<float>")
    got = whitening.whiten(table).collect()
    assert len(got) == 8 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(4, 0, None, None, None)}


def test_cross_products():
    rng = np.random.default_rng(6)
    for low, high in ((0, 1), (-5, 5), (-(2**61), 2**61), (99_000, 101_000)):
        x = rng.integers(low, high, size=(131, 4))
        full = np.column_stack([np.ones(131, object), x.astype(object)])
        assert (np.triu(whitening.cross_products(x)) == np.triu(full.T @ full)).all()
        assert whitening._squares(x // 2) == [sum(int(v) ** 2 for v in row) for row in x // 2]


def test_queries(spark, tmp_path):
    spark.createDataFrame(made(40), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, [float(i % 7), float(i % 3) / 4]) for i in range(50)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = [(r[0], r[1]) for r in made(40)]
    assert {tuple(r) for r in queries.QUERIES["op11_spelling_variants"](spark, str(tmp_path)).collect()} == expected_variants(rows)
    got = {tuple(r) for r in queries.QUERIES["op12_simhash_near_dedup"](spark, str(tmp_path)).collect()}
    assert got == set(expected_components(rows, [simple_fingerprint(t) for _, t in rows]))
    check_whitening(queries.QUERIES["op13_embedding_whitening"](spark, str(tmp_path)).collect(), [(float(i % 7), float(i % 3) / 4) for i in range(50)])
