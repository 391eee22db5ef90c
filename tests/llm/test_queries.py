"""The registered queries over small tables that hold all that is awkward: their columns, and what the contract fixes."""

import hashlib
import random
import zlib

import pytest

import __spark_entry__
from readloom.llm import bpe

from .test_operators import AWKWARD, base_spans, leaky, made, many_pages, shingles

OPS = {
    "op1_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op2_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op3_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op4_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_substring_dedup": ["doc_id", "spans"],
    "op7_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op8_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_benchmark_decontamination": ["doc_id", "item_id"],
    "op10_secret_scans": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    long = " ".join(rng.choice(["alpha", "beta", "gämma", "δέλτα"]) + str(rng.randint(0, 5000)) for _ in range(20_000))
    secret = "password = hunter2hunter2 " + "0a" * 20 + " AKIA" + "Z7" * 8
    return [*[(i, t, lang) for i, t, lang, *_ in made(40)], *[(i, t, "en") for i, t in AWKWARD], (900, long, "de"), (901, long + " end", "de"), (902, "x" * 200_000, None), (903, secret, "en")]


@pytest.fixture(scope="module")
def sf_dir(spark, texts, tmp_path_factory):
    """Tables with columns besides those known, under names that operators use inside."""
    path = str(tmp_path_factory.mktemp("sf"))
    items, leaked = leaky(random.Random(2))
    docs = [(i, t, lang, "s", len(t or ""), 1, "k", [0]) for i, t, lang in [*texts, *[(i + 2000 if i is not None else None, t, "en") for i, t in leaked]]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, _key string, _spans array<int>"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 3 > 0, 0) for i, *_ in docs if i is not None], "doc_id long, quality boolean, toxic int").selectExpr("doc_id", "cast(quality as int) quality", "toxic").write.parquet(f"{path}/labels.parquet")
    tangled = "<div>" * 3000 + "".join(f"<p>line {i % 700}" for i in range(4000))
    pages = [r[:3] for r in many_pages()] + [(5000, "http://h0.com/long", tangled), (5001, "http://h0.com/long2", tangled + "<p>more")]
    spark.createDataFrame([(*p, 1, "own") for p in pages], "page_id long, url string, html string, range int, own string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", OPS)
def test_query(spark, sf_dir, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    assert df.columns[: len(OPS[name])] == OPS[name] or set(OPS[name]) <= set(df.columns)
    got = df.collect()
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    by = sorted(((r["doc_id"], *[r[c] for c in OPS[name][1:]]) for r in got if "doc_id" in OPS[name]), key=str)
    if name == "op1_html_extraction":
        assert len(got) == spark.read.parquet(f"{sf_dir}/pages.parquet").count() and all(r["n_chars"] == len(r["text"]) for r in got)
    elif name == "op9_benchmark_decontamination":
        assert {r["doc_id"] for r in got if r["doc_id"] is not None and r["item_id"] is not None} and all(r["doc_id"] is None or r["doc_id"] >= 2000 for r in got)
    else:
        assert sorted((str(r[0]) for r in by)) == sorted(str(i) for i, _ in docs)
    if name == "op2_suffix_array_dedup":
        assert sorted(r["n_bytes"] for r in got) == sorted(len(t.encode()) for _, t in docs)
    elif name == "op3_ngram_jaccard_join":
        assert sorted((str(r["doc_id"]), r["n_shingles"]) for r in got) == sorted((str(i), len(shingles(t))) for i, t in docs)
        assert {r["component_id"] for r in got if r["doc_id"] in (900, 901)} == {900}
    elif name == "op5_language_id":
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
        assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for r in got)
    elif name == "op7_lm_scoring":
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in got if r["doc_id"] is not None)
        assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(i), len(t.encode().split()) + 1) for i, t in docs)
    elif name == "op8_byte_bpe":
        tiktoken = pytest.importorskip("tiktoken")
        path, pattern = bpe.public_vocabulary()
        reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
        expected = [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs if len(t) < 100_000 for ids in [reference.encode_ordinary(t)]]
        assert set(expected) <= set(by)
    elif name == "op10_secret_scans":
        shown = lambda t: ",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(t))
        assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == sorted((str(i), hashlib.sha256(shown(t).encode()).hexdigest()) for i, t in docs)
