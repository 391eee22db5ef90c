"""Files read in ranges of any size give the rows of one range."""

import random
import struct

import pytest

from readloom.sources import ranges, text


def fasta_file(path, seed=1):
    rng = random.Random(seed)
    refs = {f"ref{i}": "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 5, 70, 500]))) for i in range(12)}
    width = lambda: rng.choice([7, 60, 10_000])
    out = ""
    for name, seq in refs.items():
        w = width()
        out += f">{name}\n" + "".join(seq[a : a + w].lower() + "\n" for a in range(0, len(seq), w)) + rng.choice(["", "\n"])
    path.write_text(out.rstrip("\n") + rng.choice(["", "\n"]))
    return refs


@pytest.mark.parametrize("split", [17, 200, 100_000])
def test_fasta(spark, tmp_path, split):
    refs = fasta_file(tmp_path / "x.fa")
    got = text.read_fasta(spark, str(tmp_path / "x.fa"), split=split, block=40)
    assert {r["ref"]: r["seq"] for r in got.collect()} == refs
    assert {r["ref"] for r in text.read_fasta(spark, str(tmp_path / "x.fa"), ["ref3", "ref5"], split=split).collect()} == {"ref3", "ref5"}
    at = ranges.fasta_positions(spark, "file://" + str(tmp_path / "*.fa"), split=split, block=40).collect()
    assert sorted((r["ref"], r["pos"], r["base"]) for r in at) == sorted((name, i + 1, b) for name, seq in refs.items() for i, b in enumerate(seq))
    pieces = ranges.fasta_pieces(spark, str(tmp_path / "x.fa"), split=split, block=40).collect()
    assert max(len(r["bases"]) for r in pieces) <= 40


def test_fasta_of_several_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a\nAC\n>b\nGG")
    (tmp_path / "b.fa").write_text(">c\nTT\n")
    (tmp_path / "c.fa").write_text("")
    got = text.read_fasta(spark, str(tmp_path), split=4)
    assert {r["ref"]: r["seq"] for r in got.collect()} == {"a": "AC", "b": "GG", "c": "TT"}
    (tmp_path / "d.fa").write_text(">c\nA")
    with pytest.raises(Exception, match="sequence occurs twice"):
        text.read_fasta(spark, str(tmp_path)).collect()
    (tmp_path / "e.txt").write_text("ACGT\n>x\nA")
    with pytest.raises(Exception, match="bases before any name"):
        text.read_fasta(spark, str(tmp_path / "e.txt")).collect()
    with pytest.raises(Exception, match="nothing"):
        text.read_fasta(spark, str(tmp_path / "nothing*")).collect()


def structures(seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(15):
        n = rng.choice([1, 4, 9, 40])
        pairs = {}
        a, b = 1, n
        while a < b:
            if rng.random() < 0.6:
                pairs[a], pairs[b] = b, a
            a, b = a + 1, b - 1
        out.append((f"s{i} of {n}", "".join(rng.choice("ACGU") for _ in range(n)), pairs))
    return out


@pytest.mark.parametrize("split", [33, 100_000])
def test_ct(spark, tmp_path, split):
    made = structures()
    lines = []
    for title, seq, pairs in made:
        n = len(seq)
        lines += [f" {n}\t{title}"] + [f"{i}\t{c}\t{i - 1}\t{i + 1 if i < n else 0}\t{pairs.get(i, 0)}\t{i}" for i, c in enumerate(seq, 1)] + [""]
    (tmp_path / "x.ct").write_text("\n".join(lines))
    got = text.read_ct(spark, str(tmp_path / "x.ct"), split=split, block=50)
    assert sorted(tuple(r) for r in got.collect()) == sorted((title, i, c, pairs.get(i, 0)) for title, seq, pairs in made for i, c in enumerate(seq, 1))


def test_short_ct(spark, tmp_path):
    (tmp_path / "x.ct").write_text("3 a\n1 A 0 2 0 1\n2 A 1 3 0 2\n")
    with pytest.raises(Exception, match="1 more lines of a"):
        text.read_ct(spark, str(tmp_path / "x.ct")).collect()


@pytest.mark.parametrize("split", [33, 100_000])
def test_dot_bracket(spark, tmp_path, split):
    made = structures()
    string = lambda n, pairs, kind: "".join("." if i not in pairs else kind[pairs[i] < i] for i in range(1, n + 1))
    (tmp_path / "x.db").write_text("".join(f">{title}\n{seq}\n{string(len(seq), pairs, '<>')} (-1.0)\n{string(len(seq), {}, '()')}\n" for title, seq, pairs in made))
    got = text.read_dot_bracket(spark, str(tmp_path / "x.db"), split=split, block=50)
    assert sorted(tuple(r) for r in got.collect()) == sorted((title, i, j) for title, _, pairs in made for i, j in pairs.items())
    rows = ranges.load(spark, ranges.DotBracketSource, str(tmp_path / "x.db"), split=split).collect()
    assert len(rows) == 30 and {(r["struct"], r["seq"]) for r in rows} == {(title, seq) for title, seq, _ in made}


def mutation_map(rng, transcripts):
    out, rows = b"", []
    for k in range(transcripts):
        name, n = f"tx{k}", rng.randint(1, 90)
        seq = "".join(rng.choice("ACGTN") for _ in range(n))
        packed = "".join(str("ACGTN".index(c)) for c in seq) + "0" * (n % 2)
        out += struct.pack("<H", len(name) + 1) + name.encode() + b"\0" + struct.pack("<I", n) + bytes.fromhex(packed)
        reads = []
        for _ in range(rng.choice([0, 1, 30, 200])):
            a = rng.randrange(n)
            b = rng.randint(a, n - 1)
            reads.append((a, b, sorted(rng.sample(range(a, b + 1), rng.randint(0, min(4, b - a + 1))))))
        out += struct.pack("<I", len(reads)) + b"".join(struct.pack(f"<III{len(m)}I", a, b, len(m), *m) for a, b, m in reads)
        rows += [(name, seq, i, a + 1, b + 1, [x + 1 for x in m]) for i, (a, b, m) in enumerate(reads)]
    return out, rows


@pytest.mark.parametrize("split", [300, 3000, 1_000_000])
@pytest.mark.parametrize("end", [b"", b"[mmeof]"])
def test_mutation_map(spark, tmp_path, split, end):
    rng = random.Random(split)
    data, rows = mutation_map(rng, 12)
    other, more = mutation_map(rng, 2)
    (tmp_path / "a.mm").write_bytes(data + end)
    (tmp_path / "b.mm").write_bytes(other.replace(b"tx", b"ty") + end)
    got = text.read_mm(spark, str(tmp_path), split=split, block=64).collect()
    assert sorted(tuple(r) for r in got) == sorted([*rows, *[(r[0].replace("tx", "ty"), *r[1:]) for r in more]])


def test_bad_mutation_map(spark, tmp_path):
    data, _ = mutation_map(random.Random(1), 3)
    (tmp_path / "a.mm").write_bytes(data[:-3] + b"\xff" * 40)
    with pytest.raises(Exception, match="no record at|ranges do not meet"):
        text.read_mm(spark, str(tmp_path / "a.mm")).collect()
