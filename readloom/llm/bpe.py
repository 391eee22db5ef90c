"""Byte-level BPE as a finite-state transducer, and streaming decoding.

Encoding. After any prefix of a piece, its BPE tokens can still change only where a longer token
may yet begin. A state of the transducer holds just that: the *open* positions (those from which
the bytes read so far are a proper prefix of some token) with the tokens that lead to each,
without what all of them share. Reading a byte gives the next state and emits the tokens on which
all open positions now agree, so output lags the input by no more than the longest token. States
and their arcs are made when first used (lazy determinisation) and kept in a table of bounded
size. Which token ends the encoding of a prefix follows from the merges: it is the token t, ending
there, for which the merges leave the pair (last token before t, t) alone.

Decoding. An incremental UTF-8 state machine (states: bytes still expected, and their bounds) reads
token bytes as they come and gives out text at character borders only.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from . import common


#: Rows whose results are held at once; ids decoded at once.
CHUNK, STREAM = 500, 4096
#: States, pairs and pieces that a worker remembers, each; some 450 MB in all.
LIMIT = 350_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: base64 bytes and rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Transducer:
    """Encoder of single pieces. ``limit`` bounds the states and pairs that are kept in memory."""

    def __init__(self, ranks: dict[bytes, int], limit: int = LIMIT):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.limit = limit
        #: A tree of the tokens: node and byte give the next node; root 1, none 0.
        self.tree: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        for token, rank in ranks.items():
            node = 1
            for b in token:
                node = self.tree.setdefault(node << 8 | b, len(self.tree) + 2)
            self.ends[node] = rank
        self.inner = {key >> 8 for key in self.tree}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Start over with the first state alone. A state, flat: the last token emitted (-1: none), then
        for every open position, the one at the end of what was read first, the number of tokens that
        lead to it, these, and its node."""
        start = (-1, 0, 1)
        self.numbers: dict[tuple, int] = {start: 0}
        self.states: list[tuple] = [start]
        #: By state and byte: twice the next state's number, and one more if tokens are emitted.
        self.arcs: dict[int, int] = {}
        self.emitted: dict[int, tuple] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The merges themselves: join the adjacent pair of lowest rank until none is left. Used to
        compile arcs (on two adjacent tokens), never on whole texts."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def reached(self, rank: int) -> bool:
        """Whether the merges build this token at all."""
        if (known := self.whole.get(rank)) is None:
            known = self.whole[rank] = self.merged(self.bytes_of[rank]) == [rank]
        return known

    def stands(self, left: int, right: int) -> bool:
        """Whether the merges leave the pair of tokens as it is."""
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def _make(self, number: int, b: int) -> int:
        """The arc of a state for a byte."""
        state, tree, ends, inner = self.states[number], self.tree, self.ends, self.inner
        last, at, n = state[0], 1, len(state)
        ended, still = None, []
        while at < n:
            stop = at + 1 + state[at]
            node = tree.get(state[stop] << 8 | b)
            if node is not None:
                if ended is None and (rank := ends.get(node)) is not None and self.reached(rank):
                    before = state[stop - 1] if stop > at + 1 else last
                    if before < 0 or self.stands(before, rank):
                        ended = (*state[at + 1 : stop], rank)
                if node in inner:
                    still.append((state[at + 1 : stop], node))
            at = stop + 1
        if ended is None:
            raise ValueError("the ranks lack a single byte")
        shared = 0
        while shared < len(ended):
            token = ended[shared]
            for path, _ in still:
                if len(path) <= shared or path[shared] != token:
                    break
            else:
                shared += 1
                continue
            break
        flat = [ended[shared - 1] if shared else last, len(ended) - shared, *ended[shared:], 1]
        for path, node in still:
            flat += (len(path) - shared, *path[shared:], node)
        target = tuple(flat)
        if (known := self.numbers.get(target)) is None:
            known = self.numbers[target] = len(self.states)
            self.states.append(target)
        key = number << 8 | b
        arc = self.arcs[key] = known << 1 | (shared > 0)
        if shared:
            self.emitted[key] = ended[:shared]
        return arc

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        state, out, get, make = 0, [], self.arcs.get, self._make
        for b in piece:
            arc = get(state << 8 | b)
            if arc is None:
                if len(self.states) > self.limit:  # start over, from where the piece stands
                    here = self.states[state]
                    self.forget()
                    state = self.numbers.setdefault(here, len(self.states))
                    if state == len(self.states):
                        self.states.append(here)
                    get = self.arcs.get
                arc = make(state, b)
            if arc & 1:
                out += self.emitted[state << 8 | b]
            state = arc >> 1
        left = self.states[state]
        return [*out, *left[2 : 2 + left[1]]]


class Utf8:
    """Incremental UTF-8 machine: ``feed`` gives the text completed so far, bad bytes as U+FFFD. What a chunk of bytes
    leaves open at its end is at most three bytes; only these and bad ones are stepped through one by one."""

    def __init__(self):
        self.held, self.need, self.low, self.high = b"", 0, 0x80, 0xBF

    def _step(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.held, self.need, self.low, self.high = self.held + bytes((b,)), self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(self.held.decode("utf-8"))
                        self.held = b""
                    continue
                out.append("�")
                self.held, self.need, self.low, self.high = b"", 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.held, self.need = bytes((b,)), 1 + (b >= 0xE0) + (b >= 0xF0)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def feed(self, data: bytes) -> str:
        at = 0
        while self.need and at < len(data) and data[at] & 0xC0 == 0x80 and at < 3:
            at += 1  # what the last chunk left open ends here
        start = self._step(data[:at]) if at else ""
        if self.need:
            return start + self._step(data[at:])
        end = len(data)
        for back in range(1, min(3, end - at) + 1):  # a character that this chunk begins and does not end
            b = data[end - back]
            if b >= 0xC0:
                if back < 2 + (b >= 0xE0) + (b >= 0xF0):
                    end -= back
                break
            if b < 0x80:
                break
        try:
            middle = data[at:end].decode("utf-8")
        except UnicodeDecodeError:
            return start + self._step(data[at:])
        return start + middle + self._step(data[end:])

    def close(self) -> str:
        left, self.held, self.need = ("�" if self.held else ""), b"", 0
        return left


class Codec:
    """Whole texts: the pattern's pieces one by one through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = LIMIT):
        self.transducer = Transducer(ranks, limit)
        self.pieces = regex.compile(pattern).findall
        self.limit = limit
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}
        #: Bytes of each id, by the id as it is written.
        self.bytes_of = {str(i): t for i, t in self.transducer.bytes_of.items()}

    def piece(self, piece: str) -> str:
        """The ids of a piece, joined by commas."""
        if (ids := self.older.get(piece)) is None:
            ids = ",".join(map(str, self.transducer.encode(piece.encode("utf-8", "surrogatepass"))))
            if len(piece) > 64:
                return ids  # long ones rarely come again
        if len(self.memo) >= self.limit:
            self.older, self.memo = self.memo, {}
        self.memo[piece] = ids
        return ids

    def ids(self, text: str) -> list[str]:
        """The ids of a text, as they are written."""
        get, make = self.memo.get, self.piece
        joined = ",".join([get(p) or make(p) for p in self.pieces(text)])
        return joined.split(",") if joined else []

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.ids(text)))

    def stream(self, ids: Iterable) -> Iterator[str]:
        """Text as it becomes complete, STREAM ids at a time."""
        machine, bytes_of, held = Utf8(), self.bytes_of, iter(ids)
        while chunk := list(itertools.islice(held, STREAM)):
            yield machine.feed(b"".join([bytes_of[i] for i in chunk]))
        yield machine.close()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(map(str, ids)))


@functools.lru_cache(maxsize=1)
def codec(path: str, pattern: str, limit: int = LIMIT) -> Codec:
    return Codec(load_ranks(path), pattern, limit)


def encode(docs: DataFrame, vocabulary: str, pattern: str, keep_ids: bool = True, limit: int = LIMIT) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns doc_id, n_tokens, ids (array<int>, or left out), ids_sha256, decoded_sha256 (of what the ids decode to). A
    null or empty text has no tokens. Every row gives one, null and repeated doc_ids too; an empty table gives an empty
    table; other columns are ignored. Work is
    per row, so nothing is shuffled and a lost executor costs only its own splits. ``vocabulary`` is
    a path that exists on each machine, as an installed package's file does; ``limit`` bounds a worker's memory.
    """

    def run(frames):
        made = codec(vocabulary, pattern, limit)
        for whole in frames:
            for at in range(0, len(whole), CHUNK):
                frame, rows = whole[at : at + CHUNK], []
                for text in frame["text"]:
                    ids = made.ids(text)
                    back = hashlib.sha256()
                    for part in made.stream(ids):  # the document's own ids, through the streaming decoder
                        back.update(part.encode("utf-8", "surrogatepass"))
                    rows.append((len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), back.hexdigest(), np.array(ids, np.int32) if keep_ids else None))
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"])
                out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
                out = out.astype({"doc_id": "Int64"})
                yield out[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]]

    return common.with_text(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the installed multilingual vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` with the public multilingual ranks."""
    return encode(common.table(spark, sf_dir, "documents"), *public_vocabulary(), keep_ids=False)
