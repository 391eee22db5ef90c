"""Structures and regions against plain Python, and joins that no table of pairs may be broadcast in."""

import random

from pyspark.sql import functions as F

from readloom.operators import profiles, regions, structures as st
from readloom.sources import text


def made(spark, seed, n=12, length=30):
    """Pairs of random structures, crossing ones too."""
    rng, rows = random.Random(seed), []
    for s in range(n):
        at = rng.sample(range(1, length + 1), 2 * rng.randint(0, length // 3))
        for a, b in zip(at[::2], at[1::2]):
            rows += [(s, a, b), (s, b, a)]
    return rows, spark.createDataFrame(rows, "struct long, pos int, partner int")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_root_pairs(spark):
    """As by comparing all pairs, without meeting a table of all pairs at once."""
    held, pairs = made(spark, 1)
    each = [(s, a, b) for s, a, b in held if a < b]
    want = sorted((s, a, b) for s, a, b in each if not any(t == s and x < a and y > b for t, x, y in each))
    found = st.root_pairs(pairs)
    assert rows(found, "struct", "end5", "end3") == want
    assert "Join" not in plan(found)


def test_unite(spark):
    """Gaps by position, also of empty regions, without a row for each position that is held."""
    rng = random.Random(2)
    held = [(k, a, a + rng.randint(-1, 5)) for k in range(20) for a in (rng.randint(1, 30) for _ in range(rng.randint(1, 5)))]
    hull, gaps = st.unite(spark.createDataFrame(held, "ref long, end5 int, end3 int"), ["ref"])
    ends = {k: (min(a for x, a, _ in held if x == k), max(b for x, _, b in held if x == k)) for k, _, _ in held}
    assert rows(hull, "ref", "end5", "end3") == sorted((k, *v) for k, v in ends.items())
    want = [(k, p) for k, (a, b) in ends.items() for p in range(a, b + 1) if not any(x == k and c <= p <= d for x, c, d in held)]
    assert rows(gaps, "ref", "pos") == sorted(want)
    assert "Join" not in plan(gaps)


def test_enclosing(spark):
    """The narrowest pair around each position; positions by pairs are not joined."""
    held, pairs = made(spark, 3)
    pos = [(p,) for p in range(1, 31)] * 2
    want = []
    for s in {s for s, _, _ in held}:
        for p in range(1, 31):
            around = [(b - a, a, b) for t, a, b in held if t == s and a < p < b]
            want += [(s, p, *min(around)[1:])] if around else []
    found = st.enclosing(spark.createDataFrame(pos, "pos int"), pairs)
    assert rows(found, "struct", "pos", "end5", "end3") == sorted(want)
    assert "min_by" not in plan(found)


def test_wfmi_without_broadcast(spark):
    """Tables of pairs are merged by key and position, however small Spark takes them for."""
    held, pairs = made(spark, 4)
    a, b = pairs.withColumnRenamed("struct", "key"), pairs.select((F.col("struct") - 1).alias("key"), "pos", "partner")
    every = spark.range(12).crossJoin(spark.range(1, 31).toDF("pos")).select(F.col("id").alias("key"), F.col("pos").cast("int").alias("pos"))
    found = st.wfmi(a, b, every, ["key"])
    assert "BroadcastHashJoin" not in plan(found)
    own = {s: {(p, q) for t, p, q in held if t == s} for s in range(14)}
    for key, x in rows(found, "key", "wfmi"):
        m, n = own[key], own[key + 1]
        share = 1 - len({p for p, _ in m | n}) / 30
        assert abs(x - (share + (1 - share) * (len(m & n) / (len(m) * len(n)) ** 0.5 if m and n else 0))) < 1e-12


def test_profiles_with_structure_without_broadcast(spark):
    """Neither structures nor their pairs go whole to the driver."""
    held, pairs = made(spark, 5)
    mus = [(v, p, "A", 0.1) for v in range(5) for p in range(1, 31)]
    own = pairs.withColumn("vec_id", F.floor(F.col("struct") / 3))
    found = profiles.with_structure(spark.createDataFrame(mus, "vec_id long, pos int, base string, mu double"), own, ["vec_id"])
    assert "BroadcastHashJoin" not in plan(found)
    at = {(s, p) for s, p, _ in held}
    want = sorted((v, s, p, (s, p) in at) for v in range(5) for s in {s for s, _ in at if s // 3 == v} for p in range(1, 31))
    assert rows(found, "vec_id", "struct", "pos", "paired") == want


def test_brackets_without_broadcast(spark):
    """From CT rows to brackets in one grouping, and back, with crossing pairs; no structure goes to the driver."""
    held, pairs = made(spark, 6, length=12)
    some = {(s, p): q for s, p, q in held}
    table = spark.createDataFrame([(str(s), p, "ACGU"[p % 4], some.get((s, p), 0)) for s in {s for s, _ in some} for p in range(1, 13)], "struct string, pos int, base string, partner int")
    strings = text.ct_to_brackets(table)
    assert "Join" not in plan(strings)
    assert {(s, len(d)) for s, d in rows(strings, "struct", "seq")} == {(str(s), 12) for s, _ in some}
    again = text.brackets_to_ct(strings)
    assert "BroadcastHashJoin" not in plan(again)
    assert rows(again, "struct", "pos", "base", "partner") == rows(table, "struct", "pos", "base", "partner")
    assert rows(text.bracket_strings(pairs, 12), "struct", "db") == rows(strings, "struct", "db")
    lines = text.ct_text(table)
    assert not {"Union", "BroadcastHashJoin"} & set(plan(lines).replace("(", " ").split())
    assert sorted(r["value"] for r in lines.where("i = 0").collect()) == sorted(f"12\t{s}" for s in {s for s, _ in some})
