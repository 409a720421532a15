"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that its encoding ends with.
The table of these last tokens is filled from left to right: token ``t`` ends prefix ``i``
when the last token of prefix ``i - len(t)`` and ``t`` can stand side by side, that is,
when no merge across their border comes before the merges that make them.  Reading the
table backwards gives the ids.  Appending bytes continues the table and changes nothing
in it; an edit keeps the table before it and refills it behind, only until it agrees
again with what stood there.

A text is split by the vocabulary's pattern, each match is a piece of its own, and pieces
repeat, so a task keeps the encodings of short ones.

Defined results: a null text is empty and gives no ids; repeated rows are encoded one by
one; an empty table gives no rows; columns other than doc_id and text are ignored.  A
special token's string in a text is ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package

#: Pieces a task remembers, and the length up to which it does.
CACHED_PIECES = 400_000
CACHED_LENGTH = 64
RUN_CHARS = 2_000_000
#: Pairs of tokens whose fit a task remembers.
CACHED_PAIRS = 400_000
NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Tokens by rank, and which of them may be neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: every end of a token: the token it is itself, or -1
        self.ends = {token[i:]: -1 for token in ranks for i in range(1, len(token))} | ranks
        self._splits: dict[int, tuple[int, int] | None] = {}
        self._ends: dict[int, list[tuple[bytes, int]]] = {}
        self._starts: dict[int, list[tuple[bytes, int]]] = {}
        self.fit: dict[tuple[int, int], bool] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge into this one; itself twice for a byte; None if merging never makes it."""
        if token not in self._splits:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                ranks = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
                least = min(ranks)
                if least == NEVER:
                    break
                at = ranks.index(least)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            made = [self.ranks[p] for p in parts]
            self._splits[token] = (token, token) if len(made) == 1 else (made[0], made[1]) if len(made) == 2 else None
        return self._splits[token]

    def _edge(self, token: int, side: int, known: dict) -> list[tuple[bytes, int]]:
        """What stands at one edge of a token while it is made, in that order: (bytes, rank that absorbs them)."""
        if token not in known:
            found, absorbed, at = [], NEVER, token
            while True:
                found.append((self.tokens[at], absorbed))
                part = self.split(at)[side]
                if part == at:
                    break
                absorbed, at = at, part
            known[token] = found[::-1]
        return known[token]

    def fits(self, left: int, right: int) -> bool:
        """True when the encoding of both tokens' bytes together is the two tokens.

        -1 at the left is the start of a piece, where any token that merging makes may stand.
        """
        pair = (left, right)
        if pair not in self.fit:
            if len(self.fit) >= CACHED_PAIRS:
                self.fit.clear()
            self.fit[pair] = self.split(right) is not None and (left < 0 or not self._crossed(left, right))
        return self.fit[pair]

    def _crossed(self, left: int, right: int) -> bool:
        """True when some merge across the border comes before both sides are absorbed."""
        ranks = self.ranks
        lefts, rights = iter(self._edge(left, 1, self._ends)), iter(self._edge(right, 0, self._starts))
        (a, a_until), (b, b_until) = next(lefts), next(rights)
        while True:
            rank = ranks.get(a + b, NEVER)
            # of equal ranks the one further left goes first
            if rank < a_until and rank <= b_until and rank != NEVER:
                return True
            if a_until <= b_until:
                if a_until == NEVER:
                    return False
                a, a_until = next(lefts)
            else:
                b, b_until = next(rights)


class PrefixTable:
    """Last token of every byte prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = [-1]
        self.append(data)

    def _fill(self, end: int) -> None:
        """Add the entries from the last one up to prefix ``end`` of the data."""
        data, last = self.data, self.last
        ends, fit, add = self.vocabulary.ends.get, self.vocabulary.fit.get, last.append
        for at in range(len(last), end + 1):
            # only one token can end a prefix, so the order does not matter; short ones
            # come first, up to a length that no token ends with
            start = at - 1
            while start >= 0:
                token = ends(data[start:at])
                if token is None:
                    raise ValueError("the vocabulary lacks a byte")
                if token >= 0:
                    fits = fit((last[start], token))
                    if fits or fits is None and self.vocabulary.fits(last[start], token):
                        add(token)
                        break
                start -= 1

    def append(self, data: bytes) -> None:
        """Continue with more bytes; entries so far stay as they are."""
        self.data += data
        self._fill(len(self.data))

    def change_to(self, data: bytes) -> None:
        """Go over to other data, keeping the entries of the prefix both share."""
        same = 0
        for x, y in zip(self.data, data, strict=False):
            if x != y:
                break
            same += 1
        del self.last[same + 1 :]
        self.data = data
        self._fill(len(data))

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put ``data`` for the bytes from start to end; returns how many entries were made anew."""
        before, old_data = self.last, self.data
        shift = len(data) - (end - start)
        self.data = old_data[:start] + data + old_data[end:]
        self.last = before[: start + 1]
        agreed = 0
        for at in range(start + 1, len(self.data) + 1):
            self._fill(at)
            settled = at - shift > end and self.last[at] == before[at - shift]
            agreed = agreed + 1 if settled else 0
            if agreed > self.vocabulary.longest:
                self.last += before[at - shift + 1 :]
                return at - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        if whole is not None:
            return [whole]
        found, at = [], len(self.data)
        while at:
            found.append(self.last[at])
            at -= len(self.vocabulary.tokens[found[-1]])
        return found[::-1]


class Pieces(dict):
    """Encodings of pieces of text, as little-endian unsigned 32-bit ids."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.packed = {i: i.to_bytes(4, "little") for i in vocabulary.tokens}

    def _pack(self, table: PrefixTable) -> bytes:
        return b"".join(map(self.packed.__getitem__, table.ids()))

    def __missing__(self, piece: str) -> bytes:
        return self._pack(PrefixTable(self.vocabulary, piece.encode()))

    def learn(self, pieces: set[str]) -> None:
        """Encode those not known: in order, so that each continues the table of the prefix it shares with the last."""
        if len(self) + len(pieces) > CACHED_PIECES:
            self.clear()
        table = PrefixTable(self.vocabulary)
        for data in sorted(p.encode() for p in pieces if p not in self and len(p) <= CACHED_LENGTH):
            table.change_to(data)
            self[data.decode()] = self._pack(table)

    def encode(self, texts: list[str], find) -> list[bytes]:
        split = [find(text) for text in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.__getitem__, pieces)) for pieces in split]


def _runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of bounded length, each with the place of its first; nulls are empty."""
    first, run, chars = 0, [], 0
    for i, text in enumerate(column):
        run.append(text.as_py() or "")
        chars += len(run[-1])
        if chars > RUN_CHARS:
            yield first, run
            first, run, chars = i + 1, [], 0
    if run:
        yield first, run


@lru_cache(maxsize=4)
def _pieces(path: str) -> Pieces:
    return Pieces(Vocabulary(read_ranks(path)))


@lru_cache(maxsize=4)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def _decoded(ids: bytes, token) -> bytes:
    import numpy as np

    return b"".join(map(token, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): every text's ids, packed as little-endian unsigned 32-bit integers.

    ``path`` is a rank file all executors have.  With ``decoded``, the bytes the ids stand for
    come with them, so that a round trip needs one pass.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pieces, find = _pieces(path), regex.compile(pattern).findall
        token = pieces.vocabulary.tokens.__getitem__
        for batch in rows:
            for first, texts in _runs(batch.column(1)):
                ids = pieces.encode(texts, find)
                columns = [batch.column(0).slice(first, len(texts)), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([_decoded(i, token) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    ship_package(docs.sparkSession)
    read = docs.select("doc_id", "text")
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(batches, f"doc_id {kind}, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with ``decoded``, the bytes the ids stand for."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tokens(path).__getitem__
        for batch in rows:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = [_decoded(ids.as_py(), token) for ids in part.column("ids")]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"]
                )

    ship_package(encoded.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(batches, f"{schema}, decoded binary")
