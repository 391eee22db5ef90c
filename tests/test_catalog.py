"""Running tables that count each batch once, and datasets put together from a catalogue of steps."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import codes
from readloom.operators import reads
from readloom.sources import catalog
from readloom.streaming import tables as running_tables

READ = "read long, segs array<struct<end5:int,end3:int>>, muts array<struct<pos:int,base:string,rel:int>>"


def made(spark, first, n):
    rng = random.Random(first)
    rows = []
    for i in range(first, first + n):
        a, b = rng.randint(1, 4), rng.randint(6, 12)
        rows.append((i, [(a, b)], [(p, "ACGT"[p % 4], rng.choice([2, 8, 128])) for p in range(a, b + 1) if rng.random() < 0.2]))
    return spark.createDataFrame(rows, READ)


def counted(tables):
    return {name: sorted(tuple(r[c] for c in sorted(r.asDict())) for r in tables.table(name).collect()) for name in running_tables.KEYS}


def test_running_tables(spark, tmp_path):
    pos = spark.createDataFrame([(p, "ACGT"[p % 4]) for p in range(1, 13)], "pos int, base string")
    pat = codes.pattern()
    batches = [made(spark, 100 * k, 30) for k in range(4)]
    whole = running_tables.Tables(f"file://{tmp_path}/whole", pos, pat, 1, 6)
    whole.add(batches[0].union(batches[1]).union(batches[2]).union(batches[3]), 0)
    expected = counted(whole)
    split = running_tables.Tables(f"file://{tmp_path}/split", pos, pat, 1, 6)
    with pytest.raises(FileNotFoundError):
        split.table("pair")
    split.add(batches[0], 0)
    split.add(batches[1], 1)
    split.add(batches[1], 1)  # it comes again
    split.merge()
    assert all(len(split.parts(name)) == 1 for name in running_tables.KEYS)
    split.merge()
    split.add(batches[1], 1)  # and again, after it has been merged
    split.add(batches[3], 2)
    split.add(batches[2], 3)
    assert counted(split) == expected and len(split.parts("pair")) == 3
    split.merge()
    assert counted(split) == expected
    segs = batches[0].select("read", F.posexplode("segs").alias("seg", "s")).select("read", "seg", "s.*")
    muts = batches[0].select("read", F.explode("muts").alias("m")).select("read", "m.*")
    one = running_tables.Tables(f"file://{tmp_path}/one", pos, pat, 1, 6)
    one.add(batches[0], 5)
    key = lambda t: sorted(map(str, t.collect()))
    plain = reads.position_table(segs, muts, pos)
    assert key(one.position_table().select(*plain.columns)) == key(plain)


def test_stream_goes_on(spark, tmp_path):
    """What a stream has counted is not counted again when it starts anew."""
    pos = spark.createDataFrame([(p, "ACGT"[p % 4]) for p in range(1, 13)], "pos int, base string")
    tables = running_tables.Tables(f"file://{tmp_path}/out", pos, codes.pattern(), 1, 6)
    total = 0
    for k in range(3):
        made(spark, 100 * k, 10).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        total += 10
        tables.run(spark.readStream.schema(READ).parquet(f"file://{tmp_path}/in"))
        assert tables.table("ends").agg(F.sum("n")).first()[0] == total


def test_catalog(spark, tmp_path):
    store = catalog.Catalog(spark, f"file://{tmp_path}/steps")
    assert store.entries().count() == 0
    with pytest.raises(KeyError):
        store.latest("identify")
    segs = spark.createDataFrame([(1, 0, 1, 5), (2, 0, 2, 5), (3, 0, 3, 5)], "read long, seg int, end5 int, end3 int")
    muts = spark.createDataFrame([(1, 2, "A", 16), (1, 4, "C", 2), (3, 4, "C", 2)], "read long, pos int, base string, rel int")
    pos = spark.createDataFrame([(p, "ACGT"[p % 4]) for p in range(1, 6)], "pos int, base string")
    first = store.add("identify", {"segments": segs, "muts": muts, "positions": pos}, {"sample": "x", "ref": "r"})
    kept = store.add("filter", {"reads": spark.createDataFrame([(1,), (2,)], "read long"), "positions": pos.where("pos >= 3")}, {"sample": "x"}, [first], {"least": 3})
    again = store.add("filter", {"reads": spark.createDataFrame([(1,)], "read long"), "positions": pos.where("pos >= 4")}, {"sample": "x"}, [kept])
    weights = store.add("cluster", {"weights": spark.createDataFrame([(1, 1, 0.5)], "read long, clust int, weight double")}, {"sample": "x"}, [kept])
    pool = store.add("pool", {}, {"sample": "both"}, [again, kept])
    data = store.dataset(kept)
    assert sorted(r["read"] for r in data["segments"].collect()) == [1, 2]
    assert [(r["read"], r["pos"]) for r in data["muts"].collect()] == [(1, 4)]
    assert {r["pos"] for r in store.dataset(again)["positions"].collect()} == {4, 5}
    assert [r["weight"] for r in store.dataset(weights)["weights"].collect()] == [0.5]
    assert sorted(r["read"] for r in store.dataset(pool)["segments"].collect()) == ["0/1", "1/1", "1/2"]
    assert {r["pos"] for r in store.dataset(pool)["positions"].collect()} == {4, 5}
    assert {r["id"] for r in store.lineage(pool).collect()} == {first, kept, again, pool}
    assert store.latest("filter", sample="x") == again and store.entries("filter").count() == 2
    with pytest.raises(ValueError, match="no such entries"):
        store.add("filter", {}, inputs=["filter-nothing"])
    with pytest.raises(ValueError, match="no such step"):
        store.add("paint", {})
    with pytest.raises(KeyError):
        store.dataset("nothing")
