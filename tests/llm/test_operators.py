"""Each operator against a brute-force version on a small fixture, and on awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import bpe, components, html, jaccard, katz, language, leaks, quality, secrets, substring, suffix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made(n=60, seed=5):
    """Texts with exact and near copies, shared passages, repeated lines, nulls, empty ones, other scripts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeiourstlnéß") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70)) + "."
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 5, 60, 150]))]
        lines = [" ".join(words[j : j + 15]).capitalize() + "." for j in range(0, len(words), 15)]
        if i % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), "And so. " + passage)
        text = "\n".join(lines)
        if i % 7 == 3 and out and out[-1]:
            text = out[-1]
        elif i % 7 == 5 and out and out[-1]:
            ws = out[-1].split(" ")
            ws[rng.randrange(len(ws))] = "changed"
            text = " ".join(ws)
        out.append(text)
    out += [None, "", " \n\t ", "one", "a b c d", "漢字 🙂 text", "a" * 1500, "x y " * 300, "A" * 399, "1234 !!"]
    return [(i, t, ["en", "de"][i % 2], "s", 0) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, k=5):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute_links(rows, percent=75):
    """Component of each row by comparing all pairs of different texts."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if v == high else v for v in root]
    least = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    return sorted(((rows[k][0], len(s), least[root[k]]) for k, s in enumerate(sets)), key=str)


@pytest.mark.parametrize("hot", [False, True])
def test_jaccard(spark, rows, hot, monkeypatch):
    """Null and repeated doc_ids included; with blocks of two, nearly every neighbourhood is a large one."""
    if hot:
        monkeypatch.setattr(jaccard, "HOT_LEAST", 2)
    table = [*rows, (None, rows[8][1], "en", "s", 0), (0, rows[9][1], "en", "s", 0), (None, None, "en", "s", 0), rows[6]]
    docs = spark.createDataFrame(table, DOCS).repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(docs, block=2 if hot else 500).collect()), key=str)
    assert got == brute_links(table)
    assert len({r[2] for r in got}) < len(got) - 5


def test_jaccard_keep(spark, rows):
    """One document of each class stays, with all its columns; null ids and equal rows included."""
    table = [(None, rows[8][1]), *[r[:2] for r in rows], (7, "a text under an id that another has"), rows[6][:2], (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in table], "doc_id long, text string, _row int, class string").repartition(3)
    got = jaccard.keep(docs)
    assert got.columns == docs.columns
    distinct = sorted(set(table), key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))
    component = {}
    for k, (i, t) in enumerate(distinct):
        s = shingles(t)
        linked = {component[j] for j, (_, u) in enumerate(distinct[:k]) if s and shingles(u) and 100 * len(s & shingles(u)) >= 75 * len(s | shingles(u))}
        component[k] = min(linked, default=k)
        component = {j: component[k] if c in linked else c for j, c in component.items()}
    expected = [distinct[k] for k, c in component.items() if c == k]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(expected, key=str)


def test_jaccard_large(spark):
    """A large group of near copies with a tail of texts that only some of them link to."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(70):
        ws = list(base)
        if i < 50:
            ws[rng.randrange(60)] = "x"
        else:
            ws[: i - 45] = [rng.choice(words) for _ in range(i - 45)]
        rows.append((i, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(docs, block=6).collect()), key=str)
    assert got == brute_links(rows) and len({r[2] for r in got}) > 3


def test_jaccard_common_passage(spark, monkeypatch):
    """Short texts around one passage are no large neighbourhood: what is shuffled for them does not grow with their square."""
    monkeypatch.setattr(jaccard, "FILTER_LEAST", 0)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    passage = [rng.choice(words) for _ in range(20)]
    rows = [(i, " ".join([*passage, *(rng.choice(words) for _ in range(12))])) for i in range(240)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 240, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    before = {x.stageId() for x in (stages().apply(i) for i in range(stages().size()))}
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(docs, block=10).collect()), key=str)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    after = stages()
    most = max(x.shuffleWriteRecords() for x in (after.apply(i) for i in range(after.size())) if x.stageId() not in before)
    assert got == brute_links(rows) and len({r[2] for r in got}) == 240
    assert most < 15 * len(rows)


def test_links_between_components():
    """Windows of one text, searched in any order: chains of links stay whole."""
    rng = random.Random(3)
    for n in [5] * 300 + [12] * 100 + [50] * 20:
        starts, at = [], 0
        for _ in range(n):
            at += rng.randint(8, 16)
            starts.append((at, at + rng.randint(95, 110)))
        rng.shuffle(starts)
        sets = [np.arange(a, b, dtype=np.uint64) for a, b in starts]
        root = list(range(n))
        for i, (a, b) in enumerate(starts):
            for j, (c, d) in enumerate(starts[:i]):
                common = max(0, min(b, d) - max(a, c))
                if 100 * common >= 75 * (b - a + d - c - common):
                    root = [root[j] if r == root[i] else r for r in root]
        got = list(range(n))
        for a, b in jaccard._links(np.arange(n), sets, 75):
            got = [got[a] if r == got[b] else r for r in got]
        assert len(set(zip(root, got, strict=True))) == len(set(root)) == len(set(got))
    five = [(0, 108), (14, 120), (40, 144), (28, 131), (54, 156)]
    assert len(jaccard._links(np.arange(5), [np.arange(a, b, dtype=np.uint64) for a, b in five], 75)) == 4


def test_occurrences_hold():
    """The number of common leading shingles is never under T, over random pairs of linked sets."""
    rng = random.Random(1)
    for _ in range(3000):
        o = rng.randint(1, 60)
        n = rng.randint(o, max(o, int(o / 0.75)))
        m = rng.randint(o, max(o, int(o / 0.75)))
        if 100 * o < 75 * (n + m - o):
            continue
        values = rng.sample(range(10**6), n + m - o)
        common, rest = values[:o], values[o:]
        a, b = sorted(common + rest[: n - o]), sorted(common + rest[n - o :])
        lead = set(a[: jaccard._share(n, 40)]) & set(b[: jaccard._share(m, 40)])
        assert len(lead) >= max(jaccard.occurrences(n, 75), jaccard.occurrences(m, 75))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98}


@pytest.mark.parametrize("split", [False, True])
def test_suffix(spark, rows, split, monkeypatch):
    if split:
        monkeypatch.setattr(suffix, "FILE", 2)
        monkeypatch.setattr(suffix, "HOT_LEAST", 3)
    length = 120
    table = [*rows, (0, rows[5][1], "en", "s", 0), (None, rows[10][1], "en", "s", 0), (None, None, "en", "s", 0), rows[12]]
    docs = spark.createDataFrame(table, DOCS).repartition(3)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup(docs, length).collect()]
    data = [(i, (t or "").encode()) for i, t, *_ in table]
    seen = collections.Counter(d[i : i + length] for _, d in data for i in range(len(d) - length + 1))
    expected = []
    for i, d in data:
        gone = [False] * len(d)
        for j in range(len(d) - length + 1):
            if seen[d[j : j + length]] > 1:
                gone[j : j + length] = [True] * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        expected.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted(got, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("collide", [False, True])
def test_longest_previous(collide, monkeypatch):
    """Suffix order and LPF array against all pairs, also where hashes say that different strings are equal."""
    monkeypatch.setattr(suffix, "ROWS", 3)
    rng = random.Random(5)
    for _ in range(60):
        data = bytes(rng.choice(b"ab\0") for _ in range(rng.randint(12, 70)))
        length = rng.randint(2, 9)
        at = np.array(sorted(rng.sample(range(len(data) - length), rng.randint(1, len(data) - length))))
        prints = np.array([hash(data[i : i + length]) % (3 if collide else 1 << 60) for i in at], np.uint64)
        places, lcp = suffix.suffix_order(np.frombuffer(data, np.uint8), at, prints, length)
        lpf, source = suffix.longest_previous(places, lcp, length)
        strings = [data[i : i + length] for i in at]
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), length)
        assert lpf.tolist() == [max((common(strings[j], strings[i]) for j in range(i)), default=0) for i in range(len(at))]
        assert [(v >= length) | bool(s) for v, s in zip(lpf, source)] == [strings.count(s) > 1 for s in strings]
        assert [strings[i].rstrip(b"\0") for i in places] == sorted(s.rstrip(b"\0") for s in strings)


@pytest.mark.parametrize("hot", [False, True])
def test_substring(rows, docs, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(substring, "HOT_LEAST", 2)
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in substring.repeats(docs).collect()}
    seen, expected = set(), {}
    for i, t, *_ in rows:
        spans = expected[i] = []
        for a, b, before, digest in substring.units(t or ""):
            if digest in seen:
                if spans and (a <= spans[-1][1] or before == spans[-1][1]):
                    spans[-1] = (spans[-1][0], b)
                else:
                    spans.append((a, b))
            seen.add(digest)
    assert got == expected and sum(map(bool, expected.values())) > 5
    cut = {r["doc_id"]: r["text"] for r in substring.remove(docs).collect()}
    for i, t, *_ in rows:
        left, at = "", 0
        for a, b in expected[i]:
            left, at = left + t[at:a], b
        assert cut[i] == (None if t is None else left + t[at:])


def test_substring_lines(spark):
    """Brute force that does not use the operator's units: texts of lines of one sentence each."""
    rng = random.Random(9)
    lines = [" ".join(rng.choice("abcdef") * rng.randint(1, 4) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    texts = ["\n".join(rng.choice([str.upper, str.lower, lambda x: f"  {x} "])(rng.choice(lines)) for _ in range(rng.randint(0, 8))) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(5)
    got = {r["doc_id"]: r["text"] for r in substring.remove(docs).collect()}
    seen = set()
    for i, t in enumerate(texts):
        left = []
        for line in t.split("\n"):
            key = " ".join(line.lower().split())
            if key and key not in seen:
                left.append(key)
            seen.add(key)
        assert [" ".join(x.lower().split()) for x in got[i].split("\n") if x.strip()] == left


def test_substring_short_sentences(spark):
    """Short sentences go with their line or with their neighbours, and never if they occur once."""
    one, two = "The first of the long sentences here.", "The second of the long sentences follows."
    texts = [
        f"(c) X. All rights reserved.\n{one} Short tail.\nSo. {two}\n{one} Only here. {two}",
        "New.\n(c) x.  All rights reserved. ",  # a line of short ones alone
        f"Ahem. So it was.\n{one} Short tail.",  # a tail, with its line
        f"{one} Nowhere else. {two}",  # between two that repeat
        f"Some words of another running paragraph. {one} Only here. {two} And on.",  # a passage in a paragraph
        "没有空格的文字也有重复的行所以按字符数来算",
        "没有空格的文字也有重复的行所以按字符数来算",
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    cut = {r["doc_id"]: r["text"].strip() for r in substring.remove(docs).collect()}
    assert [" ".join(cut[i].split()) for i in range(1, 7)] == ["New.", "Ahem. So it was.", "Nowhere else.", "Some words of another running paragraph. And on.", texts[5], ""]
    assert cut[0].endswith("Only here.") and cut[0].startswith(texts[0].rsplit("\n", 1)[0])


AWKWARD = [(1, "One line of seven words stands here.\nIt has another line of words."), (1, "One line of seven words stands here.\nIt has another line of words."), (1, "Under the same id quite another text."), (None, "One line of seven words stands here.\nNo id."), (None, None), (2, "It has another line of words."), (3, "")]


def awkward(spark):
    """Null and repeated ids, and columns with the names that operators use inside."""
    return spark.createDataFrame([(i, t, "k", [0], 1, "b") for i, t in AWKWARD], "doc_id long, text string, _key string, _spans array<int>, row int, bucket string").repartition(3)


def test_substring_awkward(spark):
    docs = awkward(spark)
    cut = substring.remove(docs)
    assert cut.columns == docs.columns
    both = AWKWARD[0][1]
    assert sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=str) == sorted([(1, both), (1, both), (1, AWKWARD[2][1]), (None, "\nNo id."), (None, None), (2, ""), (3, "")], key=str)
    assert substring.repeats(docs).count() == len(AWKWARD)


def brute_katz(texts, used):
    """Probabilities by dictionaries of tuples: prob(context, word), and the vocabulary."""
    starts = ("<s>",) * (katz.ORDER - 1)
    grams = [collections.Counter() for _ in range(katz.ORDER + 1)]
    contexts = [collections.Counter() for _ in range(katz.ORDER + 1)]
    for i in used:
        whole = (*starts, *texts[i])
        for at in range(len(starts), len(whole)):
            for k in range(1, katz.ORDER + 1):
                grams[k][whole[at - k + 1 : at + 1]] += 1
                contexts[k][whole[at - k + 1 : at]] += 1
    discount = [None] + [katz.Discount([sum(c == r for c in g.values()) for r in range(1, katz.FIT + 1)]) for g in grams[1:]]
    seen = [None] + [{g: float(discount[k](np.array([c]))[0]) / contexts[k][g[:-1]] for g, c in grams[k].items()} for k in range(1, katz.ORDER + 1)]
    unknown = 1 - sum(seen[1].values())
    mass, other = collections.Counter(), collections.Counter()
    for k in range(2, katz.ORDER + 1):
        for g, p in seen[k].items():
            mass[g[:-1]] += p
            other[g[:-1]] += seen[k - 1][g[1:]]

    def prob(context, word):
        k = len(context) + 1
        if (*context, word) in seen[k]:
            return seen[k][*context, word]
        if k == 1:
            return unknown
        weight = (1 - mass[context]) / (1 - other[context]) if contexts[k][context] else 1
        return weight * prob(context[1:], word)

    return prob, grams[1], contexts


@pytest.mark.parametrize("batch", [None, 700])
def test_katz(spark, rows, batch, monkeypatch):
    """As by dictionaries, in one batch and range or in many; repeated and missing ids are documents of their own."""
    if batch:
        monkeypatch.setattr(katz, "BATCH", batch)
        monkeypatch.setattr(katz, "ENTRIES", 300)
    table = [*rows, (rows[3][0], rows[4][1], "en", "s", 0), (None, rows[6][1], "en", "s", 0), (rows[8][0], rows[8][1], "en", "s", 0)]
    docs = spark.createDataFrame(table, DOCS).repartition(3)
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = [tuple(r) for r in katz.score(docs, train).collect()]
    texts = [[*(t or "").encode().lower().split(), None] for _, t, *_ in table]
    used = [k for k, (i, *_) in enumerate(table) if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    prob, one, contexts = brute_katz(texts, used)
    n, v = sum(one.values()), len(one)
    expected = []
    for k, ws in enumerate(texts):
        whole = [*["<s>"] * (katz.ORDER - 1), *ws]
        value = sum(math.log10(prob(tuple(whole[at : at + katz.ORDER - 1]), w)) for at, w in enumerate(ws))
        expected.append((table[k][0], k not in used, len(ws), sum((w,) in one for w in ws), n, sum(math.log10((one[w,] + 1) / (n + v + 1)) for w in ws), value))
    assert sum(r[1] for r in expected) > 5
    order = lambda r: (str(r[0]), *r[1:4], round(r[5], 6), round(r[6], 6))
    for a, b in zip(sorted(got, key=order), sorted(expected, key=order), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
    for k in range(2, katz.ORDER + 1):  # exactly normalised over the vocabulary and the unknown class, in each order
        for context in [c for c in contexts[k] if None not in c][:5] + [("no", "where")[: k - 1]]:
            assert math.isclose(sum(prob(context, w) for (w,) in [*one, (object(),)]), 1, rel_tol=1e-9)


def test_katz_counts():
    """Counts beyond 32 bits go through whole."""
    keys = katz.pack(np.array([5, 9], np.uint64))
    frame = katz.pd.DataFrame({"range": [0, 0], "batch": [1, 2], "keys": [keys, keys], "counts": [katz.pack(np.array([3 << 40, 1], np.uint64), False)] * 2, "held": [np.packbits([0, 1]).tobytes()] * 2})
    out = katz._totals(frame, 1)
    assert katz.unpack(out["told"][0], katz.U64, False).tolist() == [3 << 41, 2] and out["stats"].iloc[-1][:4] == [(3 << 41) + 2, 2, 0, 1]


def test_bpe(rows, docs):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.public_vocabulary()
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for r in bpe.encode(docs, path, pattern).collect():
        text = rows[r["doc_id"]][1] or ""
        ids = reference.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_utf8_stream():
    rng = random.Random(3)
    parts = [*"aé漢🙂", b"\xff", b"\xc3", b"\xe6\xbc", b"\xf0\x9f", b"\x80", b"\xed\xa0\x80", "plain text"]
    for _ in range(3000):
        data = b"".join(p.encode() if isinstance(p, str) else p for p in rng.choices(parts, k=rng.randint(0, 8)))
        cuts = sorted(rng.choices(range(len(data) + 1), k=rng.randint(0, len(data) + 1)))
        machine = bpe.Utf8()
        got = [machine.feed(data[i:j]) for i, j in zip([0, *cuts], [*cuts, len(data)])]
        assert "".join(got) + machine.close() == data.decode("utf-8", "replace")


def test_bpe_bounded():
    """States are dropped inside a piece, and what is encoded stays the same."""
    path, pattern = bpe.public_vocabulary()
    ranks = bpe.load_ranks(path)
    small, large = bpe.Transducer(ranks, 50), bpe.Transducer(ranks)
    rng = random.Random(4)
    piece = "".join(rng.choice("aeinrstläöé漢") for _ in range(3000)).encode()
    assert small.encode(piece) == large.encode(piece) and len(small.states) <= 60


def test_bpe_random():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.public_vocabulary()
    mine, rng = bpe.codec(path, pattern), random.Random(3)
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=mine.transducer.ranks, special_tokens={})
    for _ in range(300):
        text = "".join(rng.choice("abeinrstheé漢🙂 \n12.'") for _ in range(rng.randint(0, 80)))
        assert mine.encode(text) == reference.encode_ordinary(text)


def leaky(rng, n_items=20):
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary[: 300 if rng.random() < 0.7 else 30]) for _ in range(n))
    items = [(i, f"{text(rng.randint(8, 16))}? {text(4)}") for i in range(n_items)]
    items += [(n_items, None), (n_items + 1, ""), (n_items + 2, items[0][1])]
    docs = []
    for i in range(40):
        words = text(rng.randint(5, 400)).split()
        if i % 2:
            item = items[i % n_items][1].split()
            at = rng.randint(0, len(words))
            words[at:at] = item if i % 4 == 1 else item[: len(item) * 2 // 3]
        docs.append((i, " ".join(words)))
    return items, docs + [(40, None), (41, ""), (5, docs[5][1]), (None, docs[5][1])]


def brute_leaks(items, docs, threshold=0.5, overlap=0.5):
    """Every passage against every item."""
    split = {k: (t or "").encode().lower().split() for k, (_, t) in enumerate(items)}
    df = collections.Counter(t for ws in split.values() for t in set(ws))
    mean = max(1, sum(map(len, split.values())) / len(items))
    grams = lambda ws, n: {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))}
    width = max(64, 2 * max(map(len, split.values())))
    out = []
    for doc, text in docs:
        ws = (text or "").encode().lower().split()
        best = {}
        for start in range(0, max(1, len(ws) - width // 2), width // 2):
            window = ws[start : start + width]
            for k, item in split.items():
                impact = {t: math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * n * 1.9 / (n + 0.9 * (0.6 + 0.4 * len(item) / mean)) for t, n in collections.Counter(item).items()}
                score = sum(v for t, v in impact.items() if t in window) / sum(impact.values()) if impact else 0
                if score >= threshold - 1e-9:
                    shares = [len(grams(p, min(3, len(p))) & grams(window, min(3, len(p)))) / len(grams(p, min(3, len(p)))) for p in leaks.question_answer(items[k][1])]
                    if min(shares) >= overlap and (k not in best or score > best[k][0] + 1e-12):
                        best[k] = (score, start)
        out += [(doc, items[k][0], round(v, 9), start) for k, (v, start) in best.items()]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [None, 300])
def test_leaks(spark, shard, monkeypatch):
    """As by brute force, ties and repeated rows included, in however many parts the index is."""
    if shard:
        monkeypatch.setattr(leaks, "SHARD_BYTES", shard)
    monkeypatch.setattr(leaks, "CHUNK", 500)
    items, docs = leaky(random.Random(2))
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = brute_leaks(items, docs)
    assert sorted(((r["doc_id"], r["item_id"], round(r["score"], 9), r["passage_start"]) for r in got), key=str) == expected
    assert len(expected) > 8 and any(d is None for d, *_ in expected)


def test_leaks_clean(spark):
    """Rows go by their own text, whatever their ids; names clash with nothing."""
    items, docs = leaky(random.Random(2))
    frame = spark.createDataFrame([(i, t, 5) for i, t in docs] + [(5, "not what the other five says", 5)], "doc_id long, text string, _row int")
    got = leaks.clean(frame, spark.createDataFrame(items, "item_id long, text string"))
    bad = {i for i, *_ in brute_leaks(items, docs)}
    assert got.columns == frame.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(i, t) for i, t in docs if i not in bad] + [(5, "not what the other five says")], key=str)


def test_block_max_wand():
    """The search gives what scoring everything gives, and leaves postings unread."""
    rng = random.Random(5)
    items, _ = leaky(rng, 400)
    index = leaks.BlockMaxIndex(items)
    asked = [sorted(rng.sample(range(len(index.term)), rng.randint(1, 120))) for _ in range(100)]
    query = np.repeat(np.arange(100), [len(a) for a in asked])
    for threshold in (0.1, 0.3, 0.5, 0.9):
        index.counters.clear()
        got = {(q, i): v for q, i, v in zip(*(x.tolist() for x in index.search(query, np.concatenate(asked), threshold)), strict=True)}
        expected = {}
        for q, terms in enumerate(asked):
            scores = collections.Counter()
            for t in terms:
                for i, v in zip(index.items[index.starts[t] : index.starts[t + 1]].tolist(), index.impacts[index.starts[t] : index.starts[t + 1]].tolist(), strict=True):
                    scores[i] += v
            expected |= {(q, i): v for i, v in scores.items() if v >= threshold - 1e-9}
        assert got == pytest.approx(expected)
        c = index.counters
        if threshold >= 0.3:  # lower, the largest impact of every list is half of it
            assert c["met"] < c["postings"] and c["blocks"] < c["candidates"]
        if threshold > 0.5:
            assert c["met"] + c["probed"] < c["postings"]


def test_language(spark):
    rng = random.Random(4)
    words = {"aa": ["the", "thing", "with", "other", "wheat"], "bb": ["der", "schön", "über", "nicht", "und"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i in range(80) for lang in [["aa", "bb"][i % 2]]] + [(90, None, "aa"), (91, "123 !!", None), (92, "", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.where("doc_id % 4 < 2"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    assert all(got[i][0] == lang and 0.5 < got[i][1] <= 1 for i, _, lang in rows[:80])
    assert all(got[i] == ("und", 0.0) for i in (90, 91, 92))
    assert sorted(r["doc_id"] for r in language.keep(docs, model, 0.3).collect()) == list(range(80))
    assert language.train(docs.limit(0)).predict("text") == ("und", 0.0)


def test_language_copies(spark, monkeypatch):
    """Copies of a text do not shrink the sample of its language."""
    rng = random.Random(4)
    texts = [(" ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(8)), lang) for lang, letters in (("aa", "abcde"), ("bb", "vwxyz")) for _ in range(40)]
    few = [("".join(rng.choice("klmno") for _ in range(20)), "cc") for _ in range(7)]
    table = spark.createDataFrame(texts + few, "text string, lang string").withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("_")
    learnt = collections.Counter()
    learn = language.Ftrl.learn
    monkeypatch.setattr(language.Ftrl, "learn", lambda self, at, x, label: (learnt.update([label]), learn(self, at, x, label)))
    model = language.train(table, sample=20, epochs=1)
    assert model.langs == ["aa", "bb", "cc"]
    assert learnt == {0: 16, 1: 16, 2: 6}  # every fifth text is held back


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate((("assign", secrets.ASSIGN), ("access", secrets.ACCESS), ("hex", "[0-9a-f]+"))):
        for m in re.finditer(pattern, text):
            if (rank == 0 and len(m[2]) >= 8) or (rank and len(m[0]) >= (16, 32)[rank - 1]):
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def test_secrets(spark):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
    texts = ["é🙂 password=abcdefgh1 x", 'token = "' + "0a" * 20 + '"', "AKIA" + "A" * 12 + " AKIAB", "token: api_key: abcdefghij", f"AKIA{'B' * 16} {key} https://s3.example.com/x", key, "https://s3.example.com/x", None, "", f"AKIA{'B' * 16} " + "z " * 400 + key, "SECRET:12345678;Passwd='qwertyuiop'"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.find(docs).collect()}
    for i, text in enumerate(texts):
        assert [tuple(s) for s in got[i]["base"]] == base_spans(text or ""), i
    added = {i: [s["kind"] for s in r["spans"] if s["rank"] >= 3] for i, r in got.items()}
    assert added == {**{i: [] for i in got}, 4: ["key", "endpoint"]}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean[0] == "é🙂 [assign] x" and clean[4] == "[access] [key] [endpoint]" and clean[7] is None and clean[5] == key


def test_secrets_awkward(spark):
    """Rows that repeat a doc_id keep their own spans and their number; names clash with nothing."""
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
    rows = [(1, f"AKIA{'B' * 16} {key}"), (1, f"AKIA{'B' * 16} {key}"), (1, "x " * 4 + key), (None, f"AKIA{'B' * 16} {key * 5}"), (None, None)]
    docs = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id long, text string, _key string, row int, _row int")
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted([(1, "[access] [key]")] * 2 + [(1, "x " * 4 + key), (None, "[access] [key]"), (None, None)], key=str)


def linked_spans(text, scope):
    """Every pair of parts, looked at one by one."""
    base = base_spans(text)
    weak = [(m.start(), 3 + k, m.end(), kind) for k, (kind, pattern) in enumerate((("id", secrets.WEAK_ID), ("key", secrets.WEAK_KEY), ("endpoint", secrets.ENDPOINT))) for m in re.finditer(pattern, text)]
    role = {"access": "id", "id": "id", "endpoint": "endpoint"}
    out = []
    for s in weak:
        others = [(o, role.get(o[3], "secret")) for o in base + weak if o is not s and abs(o[0] - s[0]) <= scope and (o[0] >= s[2] or o[2] <= s[0])]
        need = {"id": {"secret"}, "key": {"id"}, "endpoint": {"id", "secret"}}[s[3]]
        if need <= {r for _, r in others} and not any(o[0] < s[2] and o[2] > s[0] and abs(o[0] - s[0]) <= scope for o in base):
            out.append(s)
    return sorted(base + out)


def test_secrets_linking(spark):
    rng = random.Random(8)
    parts = ["AKIA" + "Q7" * 8, "ASIA" + "Z9" * 8, "wJalrXUtnFEMIK7MDENGbPxRfiCY12", "0f" * 20, "https://s3.example.com/x", "password=abcdefgh1", "lorem ipsum", "z " * 30, "A" * 3]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 60).collect()}
    expected = {i: linked_spans(t, 60) for i, t in enumerate(texts)}
    assert got == expected and sum(any(s[1] >= 3 for s in v) for v in expected.values()) > 10


def test_quality(rows, docs, spark):
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in rows] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    word = re.compile("[^\x20\x09-\x0d]+")
    for i, t, *_ in rows:
        t = t or ""
        ws, lines = word.findall(t), [x for x in t.split("\n") if word.search(x)]
        windows = collections.Counter(tuple(ws[j : j + 5]) for j in range(len(ws) - 4))
        repeated = {k for j in range(len(ws) - 4) if windows[tuple(ws[j : j + 5])] > 1 for k in range(j, j + 5)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)), i
        assert r["base_failed"] == (len(ws) < 10 or 100 * len(repeated) > 20 * len(ws)) and not (r["kept"] and r["base_failed"])
    none = quality.judge(docs, labels.limit(0)).where(F.col("kept") == F.col("base_failed")).count()
    assert none == 0


def at_most(k, n, rate):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log(1 - rate)) for i in range(k + 1))


def test_binomial_tail(spark):
    cases = [(0, 10), (3, 500), (20, 5000), (7, 7), (300, 20000)]
    frame = spark.createDataFrame(cases, "k long, n long")
    got = {(r[0], r[1]): r[2] for r in frame.select("k", "n", quality.tail_at_most(F.col("k"), F.col("n"), 0.02)).collect()}
    for k, n in cases:
        assert got[k, n] == (pytest.approx(at_most(k, n, 0.02), rel=1e-6) if k < 0.02 * n else 1.0)


def test_quality_risk(spark):
    """Cutoffs are chosen, hold by the exact bound for all rules together, and the next step would not."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    rows, told = [], []
    for i in range(1200):
        good = i % 3 > 0
        ws = [rng.choice(words) for _ in range(rng.randint(60, 120))]
        if not good and i % 2 or rng.random() < 0.01:
            ws = [w + "###" for w in ws]
        elif not good:
            ws = [w.upper() for w in ws]
        rows.append((i if i else None, " ".join(ws)))
        if i % 4:
            told.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(told, "doc_id long, quality int")
    measured = quality.features(docs)
    found = quality.thresholds(measured, labels)
    assert set(found) == {1} and found[1]["error"] <= quality.DELTA / 4
    values = {r["doc_id"]: r for r in measured.where(~quality.base_failed()).select("doc_id", *[v.alias(k) for k, v in quality._values().items()]).collect()}
    good = [values[i] for i, q in told if q]
    lost = sum(any(v[rule] >= cut for rule, cut in found[1]["cutoffs"].items()) for v in good)
    assert (len(good), lost) == (found[1]["n_good"], found[1]["n_rejected"])
    assert found[1]["error"] == pytest.approx(at_most(lost, len(good), quality.ALPHA), rel=1e-6)
    # the path by brute force
    grid = {r: quality.cutoffs(r) for r in quality.RULES}
    bad, free = [values[i] for i, q in told if not q], [v for i, v in values.items() if i not in dict(told)]
    now, held = dict.fromkeys(grid, 0), []
    gone = lambda vs, setting: [v for v in vs if any(v[r] >= c for r, n in setting.items() for c in grid[r][:n])]
    while any(n < quality.LEVELS for n in now.values()):
        options = [(r, {**now, r: now[r] + 1}) for r in grid if now[r] < quality.LEVELS]
        gain = lambda s: (len(gone(bad, s)) - len(gone(bad, now)) + 0.5) / (len(gone(free, s)) - len(gone(free, now)) + 1)
        now = max(options, key=lambda o: gain(o[1]))[1]
        if at_most(len(gone(good, now)), len(good), quality.ALPHA) > quality.DELTA / 4:
            break
        held.append(now)
    best = max(held, key=lambda s: len(gone(bad, s)) / len(bad) - len(gone(free, s)) / len(free))
    assert found[1]["cutoffs"] == {r: grid[r][n - 1] for r, n in best.items() if n}
    judged = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert sum(not judged[i]["kept"] for i, q in told if not q) > 0.4 * len(bad)


PAGES = "page_id long, url string, html string"


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav>Menu</nav>{notice}<article><h1>A &amp; B</h1><p>One<br>two  <b>three</b></p><div class='comments'><p>Nice!</p></div><p>Four</p></article><footer>F</footer></body></html>"
    bare = "<body><div>Top line</div><p>{}</p><p>{}</p><div>Bottom line</div></body>"
    rows = [(1, "http://a.com/x/1", page.format(notice="")), (2, "http://a.com/x/2", page.format(notice="<p>Seen before</p>")), (3, "http://b.com/p/1", bare.format("First own text of some length.", "More of it.")), (4, "http://b.com/p/2", bare.format("Second text, which is another.", "And its end.")), (5, None, None), (6, "::bad", ""), (7, "http://c.com/", "<p>Cut &am")]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1]["text"] == got[2]["text"] == "A & B\n\nOne two three\n\nFour"
    assert got[3]["text"] == "First own text of some length.\n\nMore of it." and got[4]["text"] == "Second text, which is another.\n\nAnd its end."
    assert got[5]["text"] == "" and got[6]["n_chars"] == 0 and got[7]["text"] == "Cut &am"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p style='overflow: hidden'>a</p><p title='a hidden gem'>b</p><p class='search-engine-review'>c</p><p hidden>d</p><p style='display: none'>e</p>", "a b c"),
        ("<p>a<svg viewBox='0'/>b</p><svg><text>x</text></svg><p>c</p>", "a b c"),
        ("<div><p>a</p><svg><text>x</div><p>b</p><noscript>no", "a b"),
        ("<p>&am<b>p;</b></p>", "&amp;"),
        ("<p>&lt;b&gt; &#8364;&eacute;</p>", "<b> €é"),
        ("<div class='site-footer'>x</div><div id='ad_slot_2'>y</div><div class='header-image-caption'>z</div>", "z"),
        ("<article><header><h1>t</h1></header><p>a</p></article><header>x</header>", "t a"),
    ],
)
def test_html_markup(page, text):
    kept = html.Page(0, "", "", "", [t for t, _, _ in html.lines(page)], [c | f << 1 for _, c, f in html.lines(page)]).text([])[0]
    assert " ".join(kept.split()) == text


def many_pages(n=90):
    """Pages of three hosts: templates in and outside of articles, copies, quoted lines, menus that differ."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda: " ".join(word() for _ in range(rng.randint(6, 12)))
    quote, rows = text(), []
    for i in range(n):
        host = i % 3
        own = [text() for _ in range(rng.randint(2, 4))]
        if i % 9 == 4:
            own.insert(1, quote)
        if i % 10 == 7 and i > 30:
            own = rows[-30 + 0][3]
        body = "".join(f"<p>{t}</p>" for t in own)
        template = f"Subscribe to host {host} today, it is free of charge"
        if host == 0:
            page = f"<nav>{word()}</nav><article>{body}<p>{template}</p></article>"
        elif host == 1:
            page = f"<div>{template}</div>{body}<div>Imprint {host}</div>"
        else:
            page = f"<div>{template}</div><main>{body}</main>"
        rows.append((i, f"http://h{host}.com/{i // 10}/{i}", page, own))
    rows += [(1000, rows[4][1], rows[4][2], rows[4][3]), (1001, None, rows[1][2], None), (None, rows[7][1], rows[7][2], rows[7][3])]
    return rows


def test_html_differencing(spark):
    """Against every page compared with its neighbours in one list; however many ranges and partitions there are."""
    rows = many_pages()
    pages = spark.createDataFrame([r[:3] for r in rows], PAGES)
    found = [sorted(((r["page_id"], r["text"]) for r in html.extract(pages.repartition(p), n).collect()), key=str) for p, n in ((1, 1), (3, 4), (7, 40))]
    assert found[0] == found[1] == found[2]
    parsed, expected = {}, []
    for i, url, page, _ in rows:
        parsed.setdefault((*html.address(url), page), (html.lines(page), []))[1].append(i)
    digests = {(r["url"], r["html"]): r["d"] for r in pages.select("url", "html", F.xxhash64(F.coalesce("url", F.lit("")), "html").alias("d")).collect()}
    order = sorted(parsed, key=lambda k: (k[0], k[1], digests[next((u, h) for _, u, h, _ in rows if (*html.address(u), h) == k)]))
    kept = lambda ls: [(t, c) for t, c, f in ls if not f and (c or not any(c and not f for _, c, f in ls))]
    for at, key in enumerate(order):
        ls, ids = parsed[key]
        near = [(k, abs(k - at)) for k in range(len(order)) if k != at and abs(k - at) <= html.NEAR and key[0] and order[k][0] == key[0]]
        near.sort(key=lambda x: (-len(__import__("os").path.commonprefix([order[x[0]][1], key[1]])), x[1]))
        own = {t for t, _ in kept(ls)}
        voters = []
        for k, _ in near:
            other = parsed[order[k]][0]
            if sum(len(t) for t in own & {t for t, _ in kept(other)}) <= html.COPY * sum(map(len, own)) and len(voters) < html.VOTERS:
                voters.append({ls[i][0] for i, _ in html.lcs([t for t, _, _ in ls], [t for t, _, _ in other])})
        out = []
        for t, c in kept(ls):
            n = sum(t in v for v in voters)
            if not voters or not (n >= max(3, len(voters) / 2) if c else t in voters[0]):
                out.append(t)
        expected += [(i, "\n\n".join(out)) for i in ids]
    assert found[0] == sorted(expected, key=str)
    texts = dict(found[0])
    clean = [i for i, _, _, own in rows if own and i not in (None, 1000) and i % 10 != 7]
    assert all(texts[i] == "\n\n".join(rows[i][3]) for i in clean)
    off = {r["page_id"]: r["text"] for r in html.extract(pages, differencing=False).collect()}
    assert sum(off[i] != texts[i] for i in texts) > 50


@pytest.mark.parametrize("cells", [1 << 27, 20])
def test_lcs(cells, monkeypatch):
    monkeypatch.setattr(html, "CELLS", cells)
    rng = random.Random(6)
    for _ in range(500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        pairs = html.lcs(a, b)
        assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    train = F.col("doc_id") > 0
    for frame in (jaccard.link(empty), suffix.dedup(empty), substring.repeats(empty), katz.score(empty, train), bpe.encode(empty, *bpe.public_vocabulary()), leaks.leaks(empty, items), secrets.find(empty), secrets.redact(empty), quality.judge(empty, labels), html.extract(pages), language.predict(empty, language.train(empty))):
        assert frame.collect() == []
