"""The pipeline's stages against what each has to do on its own input."""

import hashlib

import corpus_pipeline as cp
from readloom.llm import bpe


def test_stages(spark, tmp_path):
    words = [f"{a}{b}" for a in "the ing and with her thou".split() for b in "a e i o u st nd".split()]
    text = lambda k: " ".join(words[(k * 7 + i * (k % 5 + 1) + i * i * k) % len(words)] for i in range(80))
    item = "which of these thing anda withe hersti thound ingo is asked here today? the answer anda ingu"
    rows = [(i, text(i), "en", "s") for i in range(1, 9)]
    rows += [(20, text(1), "en", "s"), (21, text(2) + " more", "en", "s"), (22, None, "en", "s"), (23, "123 456", None, "s"), (24, f"{text(11)} {item} {text(12)}", "en", "s"), (25, text(13) + " password=abcdefgh1 end", "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, ids = docs, []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, kept, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        kept = spark.read.parquet(str(tmp_path / f"stage{k}"))
        ids.append(sorted(r["doc_id"] for r in kept.select("doc_id").collect()))
        if k == 3:
            clean = {r["doc_id"]: r for r in kept.collect()}
    assert ids[0] == [*range(1, 9), 20, 21, 24, 25]
    assert ids[1] == [*range(1, 9), 24, 25]
    assert ids[2] == ids[3] == ids[4] == [*range(1, 9), 25]
    assert clean[25]["text"].endswith("[assign] end") and clean[25]["n_chars"] == len(clean[25]["text"]) and clean[1]["text"] == rows[0][1]
    codec = bpe.codec(*bpe.public_vocabulary())
    for r in kept.collect():
        assert codec.decode(r["ids"]) == clean[r["doc_id"]]["text"] and r["decoded_sha256"] == hashlib.sha256(clean[r["doc_id"]]["text"].encode()).hexdigest()
    assert sorted(r["doc_id"] for r in cp.run(spark, str(tmp_path)).select("doc_id").collect()) == ids[4]


def test_awkward_rows(spark, tmp_path):
    """Repeated rows and null ids: of rows that agree in id and text one goes on; columns of any names come along."""
    words = [f"{a}{b}" for a in "the ing and with her thou".split() for b in "a e i o u st nd".split()]
    text = lambda k: " ".join(words[(k * 7 + i * (k % 5 + 1) + i * i * k) % len(words)] for i in range(80))
    item = "which of these thing anda withe hersti thound ingo is asked here today? the answer anda ingu"
    rows = [(i, text(i), "en") for i in range(1, 7)] + [(1, text(1), "en"), (1, text(31), "en"), (None, text(32), None), (None, text(33), "en"), (None, None, None), (8, "", "en"), (9, " \n", "en"), (10, text(34) + " token: abcdefgh12", "en")]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), k, "c", [k]) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row int, class string, _spans array<int>")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for k, (_, stage) in enumerate(cp.STAGES[:4]):
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        kept = spark.read.parquet(str(tmp_path / f"stage{k}"))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    expected = [(i, text(i)) for i in range(1, 7)] + [(1, text(31)), (None, text(32)), (None, text(33)), (10, text(34) + " [assign]")]
    assert got == sorted(expected, key=str)
    assert all(r["_spans"] == [r["row"]] and r["class"] == "c" and r["n_chars"] == len(r["text"]) for r in kept.collect())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "one item is here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert out.collect() == [] and {"doc_id", "ids"} <= set(out.columns)
