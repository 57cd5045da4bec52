"""Packing of tokenised documents into sequences of fixed length by best-fit decreasing.

A document's ids (its text's ids, then an end id) are first cut into full windows; what is left
over goes, longest first, into the tightest open window that still has room.  Open windows are
found with a segment tree indexed by remaining capacity.  Pieces are dealt at random to shards
of some thousands, and each shard is packed by itself: best fit over thousands of pieces leaves
next to no room, and no task sees more than one shard, however long a document is.

A null text is an empty one and consists of the end id.  Rows are packed one by one, so repeated
rows and null ids are packed too; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haloflux.llm.scratch import arrow_settings, slots
from haloflux.llm.text import pieces as text_pieces

CAPACITY = 1024
END_ID = 0
#: Pieces of a shard, on average.
SHARD_PIECES = 8192
#: Word pieces whose ids a worker remembers.
REMEMBERED = 300_000
#: The splitting pattern of byte-level vocabularies (a fixed value of the public format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class _Whole(Exception):
    """The text has to be encoded as a whole."""


class _Remembered(dict):
    """Ids, as little-endian 32-bit integers, of a word piece preceded by one space."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Whole
        found = self[part] = np.array(self.encode(" " + part), dtype="<u4").tobytes()
        return found


class Encoder:
    """Ids of a text as the library of the tokenizer file gives them; a special token written in a text is its id.

    Byte-level BPE files whose ids follow the order of merges are encoded by rank, piece by
    piece: a single space between two other characters always starts a new piece, so pieces
    can be encoded once and remembered.  Any other file, and any text with a special token, goes
    through the library itself.
    """

    def __init__(self, path: str):
        ranks = _byte_ranks(path)
        self.path, self.library, self.parts = path, None, None
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file).get("added_tokens") or ()]
        if ranks is None:
            self.encode = self._by_library
        else:
            import tiktoken

            coder = tiktoken.Encoding("by_rank", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = coder.encode_ordinary
            self.parts = _Remembered(self.encode)

    def _by_library(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library.encode(text, add_special_tokens=False).ids

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if any(s in text for s in self.special):
            return np.array(self._by_library(text), dtype="<u4").tobytes()
        if self.parts is not None and text:
            if len(self.parts) > REMEMBERED:
                self.parts.clear()
            first, *rest = text.split(" ")
            try:
                if not first or first[-1].isspace():
                    raise _Whole
                return np.array(self.encode(first), dtype="<u4").tobytes() + b"".join(map(self.parts.__getitem__, rest))
            except _Whole:
                pass
        return np.array(self.encode(text), dtype="<u4").tobytes()


def _byte_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes to ids of a plain byte-level BPE file, or None for another kind of file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in spec.get("added_tokens", ())}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    merged = [model["vocab"][m] for m in merges]
    if merged != sorted(merged) or len(merged) + 256 != len(model["vocab"].keys() - special):
        return None
    return {bytes(letters[c] for c in token): rank for token, rank in model["vocab"].items() if token not in special}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def document_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Full windows and the rest of each document, with a CRC of their ids and, if asked for, the ids."""
    schema = PIECE_SCHEMA + (", ids array<int>" if keep_ids else "")
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        for batch in batches:
            for part in text_pieces(batch):
                rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
                kept = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = coder.ids(text) + end
                    for at in range(0, len(ids), 4 * capacity):
                        some = ids[at : at + 4 * capacity]
                        for column, value in zip(rows.values(), (doc_id, at // 4, len(some) // 4, zlib.crc32(some), len(ids) // 4), strict=True):
                            column.append(value)
                        if keep_ids:
                            kept.append(np.frombuffer(some, "<i4"))
                arrays = [pa.array(column, pa.int64()) for column in rows.values()]
                names = list(rows)
                if keep_ids:
                    arrays.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


class OpenWindows:
    """Windows by remaining capacity: a segment tree counts them, so the tightest fit takes O(log capacity)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window) -> None:
        if room:
            self.windows[room].append(window)
            self._add(room, 1)

    def take(self, need: int):
        """Removes a window with the least room that suffices; returns (room, window) or None."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not self.count[node]:
                    node += 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.windows[room].pop()

    def _add(self, room: int, n: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += n
            node >>= 1


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Window and offset of each length; ``lengths`` must not increase."""
    open_windows = OpenWindows(capacity)
    windows, offsets, n = [], [], 0
    for length in lengths:
        found = open_windows.take(length)
        if found is None:
            found, n = (capacity, n), n + 1
        room, window = found
        windows.append(window)
        offsets.append(capacity - room)
        open_windows.put(room - length, window)
    return windows, offsets


def pack(pieces: DataFrame, shards: int, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``doc_id``, ``start`` and ``length`` (at most ``capacity``)."""
    schema = T.StructType([f for f in pieces.schema.fields] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        shard = table.column("_shard")[0].as_py()
        windows, offsets = best_fit_decreasing(table.column("length").to_pylist(), capacity)
        ids = pa.array(np.array(windows, dtype=np.int64) + (shard << 32))
        return table.drop_columns(["_shard"]).append_column("sequence_id", ids).append_column("offset", pa.array(offsets, pa.int64()))

    # the row's place in its partition spreads repeated rows, which no other column tells apart
    shard: Column = F.pmod(F.xxhash64("doc_id", "start", "length", F.monotonically_increasing_id()), F.lit(shards)).cast("long")
    return pieces.withColumn("_shard", shard).groupBy("_shard").applyInArrow(fit, schema)


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: its document, its place in it, and its sequence and offset there."""
    arrow_settings(docs.sparkSession)
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes")).first()
    shards = slots(docs.sparkSession, size["rows"] + size["bytes"] // (2 * capacity), SHARD_PIECES)
    return pack(document_pieces(docs, tokenizer_path, id_col, text_col, capacity, keep_ids=keep_ids), shards, capacity)
