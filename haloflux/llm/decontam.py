"""Benchmark decontamination: size-partitioned min-hash containment search, exactly verified.

An item (a short test text) is contained in a document if at least ``threshold`` of the item's
distinct five-word shingles occur anywhere in the document.  A min-hash of a long document says
next to nothing about a short passage, so domains of comparable size are compared: items are
partitioned by size into classes of powers of two, and for each class u every document is cut
into overlapping windows of 2u shingles (each passage of u shingles lies wholly in one).  An item
fills between a quarter and half of its window, so one of ``SAMPLES`` minima agrees with a
probability of over 1 - 1e-6 for a whole copy and about 1 - 3e-4 for scattered parts of 0.8.

Windows meet items in a join on the minima.  Before the shuffle, two fixed-size bitmaps of the
item minima drop windows that cannot match; they are built from at most ``SLOTS`` distinct slot
numbers each, whatever the number of items, and a full bitmap only prunes less.  The same is
done for item shingles, so that a document carries to the exact check only shingles that some
item may have.  The check intersects full sets; nothing is sampled or capped.

Null and empty texts match nothing.  An item of one to four words has one shingle, the whole,
and so matches only a document of just these words.  Items with equal shingle sets are searched
once and all reported.  Rows that repeat a doc_id count as one document, null ids match nothing,
extra columns are ignored, and an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haloflux.llm.neardup import sets_of
from haloflux.llm.scratch import arrow_settings, written
from haloflux.llm.text import SHINGLE, distinct, pieces, shingles, words

SAMPLES = 48
THRESHOLD = 0.8
SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS

_rng = np.random.default_rng(19990701)
_FACTORS = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_PROBES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _key(sample: int, level: int, least: np.ndarray) -> np.ndarray:
    """Key of a minimum: which sample, which size class, which value."""
    return least.astype(np.uint64) | np.uint64(sample << 40 | level << 32)


def _low(values: np.ndarray) -> np.ndarray:
    return (values ^ (values >> np.uint64(32))).astype(np.uint32)


def size_class(n: int) -> int:
    """Level whose windows of 2 * 2**level shingles hold n consecutive shingles wherever they start."""
    return max(n - 1, 0).bit_length()


def item_sketches(items: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(item_id, shingles, minima, level) of (doc_id, text) rows that have a shingle."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            minima, levels = [], []
            for i in range(len(lists)):
                low = _low(np.asarray(lists[i].values).view(np.uint64))
                level = size_class(len(low))
                levels.append(level)
                minima.append(np.array([int(_key(p, level, (low * f + s).min())) for p, (f, s) in enumerate(zip(_FACTORS, _SHIFTS, strict=True))], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(minima, pa.list_(pa.int64())), pa.array(levels, pa.int32())], ["item_id", "shingles", "minima", "level"])

    return sets_of(items, size).where(F.size("shingles") > 0).mapInArrow(sketch, "item_id long, shingles array<long>, minima array<long>, level int")


def _slot(keys: np.ndarray, probe: int) -> np.ndarray:
    return ((keys * _PROBES[probe]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def bitmaps(keys: DataFrame) -> tuple[bytes, bytes]:
    """Occupied slots of a column of keys by either probe: at most SLOTS distinct numbers each reach the driver."""

    def number(batches: Iterator[pa.RecordBatch], probe: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(keys, probe)), pa.int64())], ["slot"])

    packed = []
    for probe in range(2):
        slots = keys.mapInArrow(lambda batches, probe=probe: number(batches, probe), "slot long").distinct()
        table = np.zeros(SLOTS, dtype=np.uint8)
        table[slots.toPandas()["slot"].to_numpy(dtype=np.int64)] = 1
        packed.append(np.packbits(table).tobytes())
    return tuple(packed)


class _Bitmaps:
    """Whether a key may be among the known ones; a known key always is."""

    def __init__(self, packed: tuple[bytes, bytes]):
        self.tables = [np.unpackbits(np.frombuffer(p, np.uint8)).astype(bool) for p in packed]

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys that may be known."""
        at = np.flatnonzero(self.tables[0][_slot(keys, 0)])
        return at[self.tables[1][_slot(keys[at], 1)]]


def hits(docs: DataFrame, minima: tuple[bytes, bytes], known: tuple[bytes, bytes], levels: list[int], size: int = SHINGLE) -> DataFrame:
    """(doc_id, keys, shingles): window minima and shingles that some item may have, of documents with such minima."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((minima, known))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_minima, item_shingles = (_Bitmaps(p) for p in shipped.value)
        for batch in batches:
            for part in pieces(batch):
                values, before = shingles(*words(part.column("text")), size)
                counts = np.diff(before)
                found_at, found_keys = [], []
                for p in range(SAMPLES if len(values) else 0):
                    least = _low(values) * _FACTORS[p]
                    least += _SHIFTS[p]
                    blocks, level = counts, 0
                    for wanted in levels:
                        while level < wanted:
                            least, blocks = _halved(least, blocks)
                            level += 1
                        windows = least.copy()
                        inner = np.ones(len(least), dtype=bool)
                        inner[np.cumsum(blocks)[blocks > 0] - 1] = False
                        at = np.flatnonzero(inner)
                        windows[at] = np.minimum(least[at], least[at + 1])
                        keys = _key(p, wanted, windows)
                        hit = item_minima.may_hold(keys)
                        if len(hit):
                            found_at.append(np.searchsorted(np.cumsum(blocks), hit, side="right"))
                            found_keys.append(keys[hit])
                if not found_at:
                    continue
                at, keys = np.concatenate(found_at), np.concatenate(found_keys)
                order = np.argsort(at, kind="stable")
                rows, starts = np.unique(at[order], return_index=True)
                ids, key_lists, shingle_lists = [], [], []
                for i, own_keys in zip(rows, np.split(keys[order], starts[1:]), strict=True):
                    own = values[before[i] : before[i + 1]]
                    ids.append(part.column("doc_id")[int(i)].as_py())
                    key_lists.append(distinct(own_keys).view(np.int64))
                    shingle_lists.append(distinct(own[item_shingles.may_hold(own)]).view(np.int64))
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(key_lists, lists), pa.array(shingle_lists, lists)], ["doc_id", "keys", "shingles"])

    return docs.mapInArrow(search, "doc_id long, keys array<long>, shingles array<long>")


def _halved(least: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima of pairs of neighbouring blocks of one document; a last odd block stays."""
    if not len(least):
        return least, blocks
    fewer = (blocks + 1) // 2
    begin = np.cumsum(blocks) - blocks
    first = np.cumsum(fewer) - fewer
    at = np.repeat(begin - 2 * first, fewer) + 2 * np.arange(fewer.sum())
    last = np.repeat(begin + blocks - 1, fewer)
    return np.minimum(least[at], least[np.minimum(at + 1, last)]), fewer


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item_shingles, containment) of each pair at or above the threshold."""
    arrow_settings(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_id_col).cast("long").alias("doc_id"), F.col(item_text_col).alias("text"))
    every = written(item_sketches(items, size))
    sets = written(every.groupBy("shingles", "minima", "level").agg(F.min("item_id").alias("rep")))

    minima = sets.select("rep", F.explode("minima").alias("key"))
    levels = sorted(r["level"] for r in sets.select("level").distinct().collect())  # at most 32 classes
    found = hits(docs, bitmaps(minima.select("key")), bitmaps(sets.select(F.explode("shingles"))), levels, size)
    found = written(found.where("doc_id IS NOT NULL"))

    candidates = found.select("doc_id", F.explode("keys").alias("key")).join(minima, "key").select("doc_id", "rep").distinct()
    carried = found.select("doc_id", F.col("shingles").alias("_own"))
    of_item = sets.select("rep", F.col("shingles").alias("_item"))
    shared = F.size(F.array_intersect("_own", "_item")).cast("long")
    checked = candidates.join(of_item, "rep").join(carried, "doc_id").select("doc_id", "rep", shared.alias("n_shared"), F.size("_item").cast("long").alias("n_item_shingles"))
    checked = checked.groupBy("doc_id", "rep").agg(F.max("n_shared").alias("n_shared"), F.max("n_item_shingles").alias("n_item_shingles"))
    checked = checked.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles")).where(F.col("containment") >= threshold)
    copies = every.join(sets.select("rep", "shingles"), "shingles").select("rep", "item_id")
    return checked.join(copies, "rep").select("doc_id", "item_id", "n_shared", "n_item_shingles", "containment").distinct()
