"""Packing texts into training sequences: bounded-space online best fit.

Each partition reads its rows once and keeps a fixed number of windows open.  Whole
sequences are cut off a long text; what is left of it goes into the open window that it
fills best.  Where none has room, the fullest window leaves: as it is if hardly any room is
left in it, else filled up by a piece of the text.  The few windows open at the end of each
partition are merged afterwards in groups of bounded size, where only the last window of a
group stays short.

Every token of a text lies in exactly one piece, and pieces follow each other in a sequence
without a gap.  The packing of a partition depends on its rows and their order only, so a
lost task gives the same rows again.

Defined results: a null or empty text is its end token alone; repeated rows are packed one
by one; a text of any length is cut; an empty table gives no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship_package

SEQUENCE_TOKENS = 1024
OPEN_WINDOWS = 32
#: Room a window may leave with.
SPARE_TOKENS = 8
#: Windows merged together at the end.
MERGED_WINDOWS = 2048
END_TOKEN = 0


class Encoder:
    """Ids of a tokenizer file.

    A byte-level vocabulary whose ids follow its merges has a twin in a faster library.
    It is used for texts of Latin letters, on which the character classes of both agree;
    all others, and texts that hold a special token, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.twin = self._twin(spec)
        self.other = re.compile("[^\x00-ɏ]")

    @staticmethod
    def _twin(spec: dict):
        import public_tokenizers
        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        model, split = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and split == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True,
        }
        if not plain or spec["normalizer"] or model["ignore_merges"] or model["dropout"]:
            return None
        # the characters this format writes for bytes: printable ones are themselves
        shown = sorted(ByteLevel.alphabet())
        kept = [b for b in range(256) if chr(b) in shown]
        code = {chr(b): b for b in kept} | dict(
            zip([c for c in shown if ord(c) > 255], [b for b in range(256) if b not in kept], strict=True)
        )
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(code[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"].get("".join(m)) != 256 + i for i, m in enumerate(merges)):
            return None
        return tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.twin is None or self.other.search(text) or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.twin.encode_ordinary(text)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Open windows of one task; a window is [room, pieces], a piece (doc, start, ids, doc_tokens)."""

    def __init__(self, size: int, open_windows: int, spare: int):
        self.size, self.limit, self.spare = size, open_windows, spare
        self.open: list[list] = []
        self.full: list[list] = []

    def add(self, doc, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        while len(ids) >= self.size:
            self.full.append([(doc, start, ids[: self.size], doc_tokens)])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            room = [w[0] for w in self.open]
            fitting = [r for r in room if r >= len(ids)]
            if fitting:
                self._put(room.index(min(fitting)), doc, start, ids, doc_tokens)
                return
            if len(self.open) < self.limit:
                self.open.append([self.size - len(ids), [(doc, start, ids, doc_tokens)]])
                return
            fullest = room.index(min(room))
            if room[fullest] <= self.spare:
                self.full.append(self.open.pop(fullest)[1])
            else:
                cut = room[fullest]
                self._put(fullest, doc, start, ids[:cut], doc_tokens)
                start, ids = start + cut, ids[cut:]

    def _put(self, at: int, doc, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        window = self.open[at]
        window[0] -= len(ids)
        window[1].append((doc, start, ids, doc_tokens))
        if not window[0]:
            self.full.append(self.open.pop(at)[1])

    def take_full(self) -> list[list]:
        done, self.full = self.full, []
        return done


def _rows(sequences: list[list], numbers: Iterator[int], left: bool, keep_ids: bool) -> list[tuple]:
    rows = []
    for pieces in sequences:
        number, offset = next(numbers), 0
        for doc, start, ids, doc_tokens in pieces:
            raw = ids.tobytes()
            rows.append((doc, start, len(ids), zlib.crc32(raw), doc_tokens, number, offset, left, raw if keep_ids or left else None))
            offset += len(ids)
    return rows


def _piece_batch(rows: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    types = [doc_type, *[pa.int64()] * 6, pa.bool_(), pa.binary()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "left", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _numbers(high: int) -> Iterator[int]:
    at = high << 32
    while True:
        yield at
        at += 1


PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(
    docs: DataFrame,
    path: str,
    size: int = SEQUENCE_TOKENS,
    open_windows: int = OPEN_WINDOWS,
    spare: int = SPARE_TOKENS,
    keep_ids: bool = True,
) -> DataFrame:
    """Pieces of all sequences, with their ids if wanted.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): ``ids`` are
    little-endian unsigned 32-bit integers.  ``path`` is a tokenizer file all executors have.
    """
    ship_package(docs.sparkSession)
    read = docs.select("doc_id", "text")
    kind = read.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {PIECE}, left boolean, ids binary"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _encoder(path), Packer(size, open_windows, spare)
        numbers = _numbers(TaskContext.get().partitionId())
        doc_type = pa.int64()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return _piece_batch(rows, doc_type)

        for batch in batches:
            doc_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encoder.ids(text.as_py() or ""), END_TOKEN], dtype="<u4")
                packer.add(doc, 0, ids, len(ids))
                if len(packer.full) >= 1000:
                    yield out(_rows(packer.take_full(), numbers, False, keep_ids))
        if packer.full:
            yield out(_rows(packer.take_full(), numbers, False, keep_ids))
        if packer.open:
            yield out(_rows([w[1] for w in packer.open], numbers, True, keep_ids))

    placed = materialise(read.mapInArrow(packed, schema))
    left = placed.filter("left")
    groups = max(1, -(-left.select("sequence_id").distinct().count() // MERGED_WINDOWS))

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        packer = Packer(size, MERGED_WINDOWS * 4, spare)
        for row in sorted(table.to_pylist(), key=lambda r: (-r["length"], r["sequence_id"], r["offset"])):
            packer.add(row["doc_id"], row["start"], np.frombuffer(row["ids"], "<u4"), row["doc_tokens"])
        # what is still open is joined by cutting, the emptiest windows into the fullest
        still = sorted(packer.open, key=lambda w: w[0])
        packer.open, loose = [w for w in still if w[0] <= spare], [p for w in still if w[0] > spare for p in w[1]]
        packer.full += [w[1] for w in packer.open]
        packer.open, packer.limit = [], 1
        for piece in loose:
            packer.add(*piece)
        sequences = packer.take_full() + [w[1] for w in packer.open]
        rows = _rows(sequences, _numbers((1 << 30) + key[0].as_py()), False, keep_ids)
        return pa.Table.from_batches([_piece_batch(rows, table.schema.field("doc_id").type)])

    joined = (
        left.withColumn("group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
        .groupBy("group")
        .applyInArrow(merged, schema)
    )
    done = placed.filter("not left").unionByName(joined).drop("left")
    return done if keep_ids else done.drop("ids")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
