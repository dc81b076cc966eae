"""Byte-level BPE by backtracking over longest matches.

The bytes of a piece are mapped to Latin-1, so that an Aho-Corasick trie of strings holds the vocabulary. A token
sequence is the one that the merges give exactly if every token, and every two neighbours, come out of the merges
of their own bytes as they are. So the encoder takes the longest token at each place, goes on where it agrees with
the token before, takes the next shorter one where it doesn't, and backs up where none is left; each place from
which no way leads on is marked and never tried again, which keeps it linear. Whether two tokens agree is kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import slices, utf8

#: Neighbours and starts that a worker keeps, and characters of its pieces; beyond it starts over.
MEMO_PIECES, MEMO_CHARS = 400_000, 8_000_000
#: ASCII, Latin-1 and Latin Extended-A letters: no numbers but 0-9.
PLAIN = r"\x00-\x1b\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u017f"


class Pieces(dict):
    """The ids of pieces as bytes; a piece that is asked for the first time is encoded, and beyond MEMO_CHARS all are forgotten."""

    def __init__(self, encode_piece: Callable[[bytes], list[int]]):
        self.encode_piece, self.kept = encode_piece, 0

    def __missing__(self, piece: str) -> bytes:
        if self.kept + len(piece) > MEMO_CHARS:
            self.clear()
            self.kept = 0
        self.kept += len(piece)
        ids = self.encode_piece(piece.encode())
        self[piece] = out = pack(f"<{len(ids)}I", *ids)
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Splitter:
    """The matches of a pattern in a text."""

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        # In texts of these blocks alone, the standard library's classes are those of the pattern, and faster.
        self.odd = re.compile(f"[^{PLAIN}]").search
        self.find_plain = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")).findall

    def __call__(self, text: str) -> list[str]:
        return (self.find if self.odd(text) else self.find_plain)(text)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.ranks, self.tokens, self.pieces = ranks, {i: t for t, i in ranks.items()}, Splitter(pattern)
        trie = ahocorasick.Automaton()
        for token, i in ranks.items():
            trie.add_word(token.decode("latin-1"), (i, len(token)))
        self.trie = trie
        self.agree = lru_cache(MEMO_PIECES)(self._agree)
        self.halves = lru_cache(MEMO_PIECES)(self._halves)
        self.whole = lru_cache(MEMO_PIECES)(lambda i: self.merged(self.tokens[i]) == [i])
        self.reach = max(map(len, ranks))
        self.starts: dict[str, list[tuple[int, int]]] = {}
        self.memo = Pieces(self.encode_piece)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        return cls(read_ranks(path), pattern)

    def merged(self, data: bytes, below: int | None = None) -> list[int]:
        """The ids that merging the neighbours of lowest rank gives, step by step (below a rank); for short data."""
        parts = [data[i : i + 1] for i in range(len(data))]
        top = len(self.ranks) + 256 if below is None else below
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], top), i) for i in range(len(parts) - 1))
            if rank >= top:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte."""
        data = self.tokens[token]
        if len(data) == 1:
            return None
        made = self.merged(data, below=token)
        return (made[0], made[1]) if len(made) == 2 else None

    def _agree(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b apart.

        Their merges are undone, the latest first. At each step the tokens on either side of the border are those
        that stand there until the merge just undone; the border holds if no merge across it comes before that.
        """
        tokens, ranks, halves, until = self.tokens, self.ranks, self.halves, len(self.tokens) + 256
        if not (self.whole(a) and self.whole(b)):
            return False
        while True:
            across = ranks.get(tokens[a] + tokens[b])
            if across is not None and across < until:
                return False
            x, y = halves(a), halves(b)
            if x is None and y is None:
                return True
            # Of two merges of the same rank the left one comes first; across the border is left of b's own.
            if y is None or x is not None and a > b:
                until, a = a, x[1]
            else:
                until, b = b + 1, y[0]

    def _ways(self, text: str, at: int) -> list[tuple[int, int]]:
        """(id, length) of the tokens that start here, the longest first."""
        known = text[at : at + self.trie.longest_prefix(text[at : at + self.reach])]
        ways = self.starts.get(known)
        if ways is None:
            ways = [x for n in range(len(known), 0, -1) if (x := self.trie.get(known[:n], None))]
            if len(self.starts) >= MEMO_PIECES:
                self.starts.clear()
            self.starts[known] = ways
        return ways

    def encode_piece(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if (known := self.ranks.get(data)) is not None:
            return [known]
        text, end, agree = data.decode("latin-1"), len(data), self.agree
        dead = bytearray(end + 1)
        path: list[int] = []
        open_ = [iter(self._ways(text, 0))]  # what is left to try at each place on the path
        places = [0]
        at = 0
        while at < end:
            for token, size in open_[-1]:
                if not dead[at + size] and (agree(path[-1], token) if path else self.whole(token)):
                    path.append(token)
                    at += size
                    places.append(at)
                    if at < end:
                        open_.append(iter(self._ways(text, at)))
                    break
            else:
                dead[at] = 1
                places.pop()
                open_.pop()
                path.pop()
                at = places[-1]
        return path

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.pieces(text))), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _LOADED.get((path, pattern)) or _LOADED.setdefault((path, pattern), ByteBPE.from_file(path, pattern))
        for batch in slices(batches):
            counts, made, back = [], [], []
            for text in utf8(batch.column("text")):
                ids = bpe.encode(text.decode())
                counts.append(len(ids))
                made.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(made, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _LOADED.get((path, pattern)) or _LOADED.setdefault((path, pattern), ByteBPE.from_file(path, pattern))
        for batch in slices(batches):
            ids = [bpe.encode(t.decode()).astype(np.int32) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _texts(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _LOADED.get((path, pattern)) or _LOADED.setdefault((path, pattern), ByteBPE.from_file(path, pattern))
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], dtype=np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "data"])

    return run


def _key(df: DataFrame) -> str:
    return f"doc_id {df.schema['doc_id'].dataType.simpleString()}"


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of each row; a null or empty text has no ids, repeated rows give repeated results."""
    return docs.select("doc_id", "text").mapInArrow(_ids(path, pattern), f"{_key(docs)}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and data (the bytes) of each row of doc_id and ids; null ids give no bytes."""
    return tokens.select("doc_id", "ids").mapInArrow(_texts(path, pattern), f"{_key(tokens)}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs, encoded and decoded again.

    Null texts count as empty (no ids, hashes of nothing). Repeated rows, rows without doc_id and empty tables give
    as many rows as they have; other columns are not looked at.
    """
    return docs.select("doc_id", "text").mapInArrow(_digests(path, pattern), f"{_key(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
