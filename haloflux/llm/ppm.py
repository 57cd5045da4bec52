"""Language-model scoring by prediction by partial matching over bytes, pretrained on the corpus.

The model predicts each byte of a text, and its end, from the ``ORDER`` bytes before it.  A symbol seen
after that context in training gets its share of the counts there; otherwise the model escapes to
the context shortened by one byte, with the symbols of the longer context excluded (method D: every
symbol gives half a count to the escape).  Contexts are nested, so what a
longer context excludes is a property of that context, and each (context, symbol) has one fixed
probability.  The trie is therefore a table, and scoring is a join:

1. Documents are dealt to blocks of about ``BLOCK_BYTES`` bytes.  A block's distinct (context, symbol)
   grams with their training counts, and its distinct words with theirs, leave it in packets dealt by
   a hash of the gram or word.
2. Counts are summed per gram, brought together by the two latest context bytes, and turned into
   probabilities.  Contexts of at most one byte need at most 257 * 256 counts from elsewhere; these are shipped.
3. Probabilities go back to the packets, packets to their blocks, and blocks score their documents.

Nothing that grows with the corpus is broadcast or collected: a task holds one block, one share of
the packets, or the distinct grams after some two-byte contexts, whose number grows ever more slowly than
the corpus.  What is exchanged follows the number of blocks.  Word counts for the unigram base travel the same way.  Words are counted
by a 64-bit hash.

A null text is an empty one, which consists of its end.  Rows are scored one by one (repeated rows and
null ids too); extra columns are ignored; an empty training part leaves the uniform model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haloflux.llm.scratch import arrow_settings, slots
from haloflux.llm.text import lowered, mix, pieces, raw, span_hashes, word_bounds

ORDER = 5
BLOCK_BYTES = 8 << 20
#: Blocks whose packets, on average, meet in one task.
BLOCKS_PER_SHARE = 4
#: Groups in which the byte-pair tables of scan tasks meet before they are summed.
PAIR_GROUPS = 1024
SYMBOLS = 257
_BEFORE, _END = 0xFE, 0xFF  # neither occurs in UTF-8
_END_WORD = np.uint64(0x5851F42D4C957F2D)
_FACTOR = 0x9E3779B97F4B


_GRAM_BITS = 8 * (ORDER + 1)
_WORD_BITS = 63
#: Bytes of text whose grams are built at once, so that they stay in a core's cache.
_PIECE = 1 << 19


def scattered(keys: np.ndarray) -> np.ndarray:
    """A bijection of ``_GRAM_BITS``-bit numbers that spreads grams evenly."""
    mask = np.uint64((1 << _GRAM_BITS) - 1)
    half = np.uint64(_GRAM_BITS // 2)
    keys = keys ^ (keys >> half)
    keys = (keys * np.uint64(_FACTOR)) & mask
    return keys ^ (keys >> half)


def gathered(keys: np.ndarray) -> np.ndarray:
    """The inverse of :func:`scattered`."""
    mask = np.uint64((1 << _GRAM_BITS) - 1)
    half = np.uint64(_GRAM_BITS // 2)
    keys = keys ^ (keys >> half)
    keys = (keys * np.uint64(pow(_FACTOR, -1, 1 << _GRAM_BITS))) & mask
    return keys ^ (keys >> half)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams (latest context byte first, symbol last) of all texts with their ends, and the number before each text."""
    data, offsets = raw(column)
    n, size = len(offsets) - 1, np.diff(offsets)
    padded = np.full(len(data) + n * (ORDER + 1), _BEFORE, dtype=np.uint8)
    shift = np.arange(n) * (ORDER + 1) + ORDER
    padded[np.arange(len(data)) + np.repeat(shift, size)] = data
    padded[offsets[1:] + shift] = _END
    packed = padded[ORDER:].astype(np.uint64)
    for k in range(1, ORDER + 1):
        packed |= padded[ORDER - k : len(padded) - k].astype(np.uint64) << np.uint64(8 * (ORDER + 1 - k))
    return packed[padded[ORDER:] != _BEFORE], offsets + np.arange(n + 1)


def gram_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    packed, before = grams(column)
    return scattered(packed), before


def word_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all words, each text followed by the end word, and the number before each text."""
    low, offsets = lowered(column)
    starts, ends, before = word_bounds(low, offsets)
    n = len(offsets) - 1
    keys = np.full(len(starts) + n, _END_WORD, dtype=np.uint64)
    keys[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(before))] = span_hashes(low, starts, ends) >> np.uint64(1)
    return keys, before + np.arange(n + 1)


#: Of either kind of key: how to get it from texts, its bits, and the bytes it takes in a packet.
_KINDS = ((gram_keys, _GRAM_BITS, ORDER + 1), (word_keys, _WORD_BITS, 8))


def _marked(keys: np.ndarray, before: np.ndarray, learns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs in texts that are learned from."""
    both = np.sort(keys << np.uint64(1) | np.repeat(learns.astype(np.uint64), np.diff(before)))
    keys = both >> np.uint64(1)
    first = _firsts(keys)
    return keys[first], np.add.reduceat((both & np.uint64(1)).astype(np.int64), first) if len(first) else np.empty(0, np.int64)


def _firsts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(ordered)])


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several sets, sorted, and their summed counts."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    every, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(every)
    every = every[order]
    first = _firsts(every)
    return every[first], np.add.reduceat(n[order], first) if len(first) else n


def _cuts(ordered: np.ndarray, bits: int, shares: int) -> np.ndarray:
    """Ends of the shares of sorted keys: a share is a range of keys."""
    share = (ordered >> np.uint64(bits - 32)) * np.uint64(shares) >> np.uint64(32)
    return np.searchsorted(share, np.arange(shares + 1, dtype=np.uint64))


def _bytes(keys: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _keys(packet: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(packet) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(packet, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


class _Index:
    """Places of keys in a sorted array of evenly spread keys, all of which it holds."""

    def __init__(self, ordered: np.ndarray, bits: int):
        self.ordered, self.shift = ordered, np.uint64(bits - 18)
        self.begin = np.searchsorted(ordered >> self.shift, np.arange(1 << 18, dtype=np.uint64))

    def places(self, keys: np.ndarray) -> np.ndarray:
        at = self.begin[(keys >> self.shift).astype(np.int64)]
        open_ = np.flatnonzero(self.ordered[at] != keys)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.ordered[at[open_]] != keys[open_]]
        return at


def log_probabilities(keys: np.ndarray, counts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """log10 of each gram's probability.

    ``keys`` are sorted distinct grams, complete for every context of two bytes among them, ``counts`` their
    training counts (0: only scored); ``low`` counts (byte, symbol) pairs of the whole training part.
    """
    levels = []
    symbol = keys & np.uint64(0xFF)
    for k in range(ORDER, 1, -1):
        context = keys >> np.uint64(8 * (ORDER - k + 1))
        pairs, at = np.unique(context << np.uint64(8) | symbol, return_inverse=True)
        n = np.bincount(at, weights=counts, minlength=len(pairs))
        contexts, of_pair = np.unique(pairs >> np.uint64(8), return_inverse=True)
        total = np.bincount(of_pair, weights=n, minlength=len(contexts))
        kinds = np.bincount(of_pair, weights=n > 0, minlength=len(contexts))
        levels.append((pairs, n, of_pair, total, kinds, at, of_pair[at]))
    byte = (keys >> np.uint64(8 * ORDER)).astype(np.int64)
    flat = symbol.astype(np.int64)
    zero = low.sum(axis=0)
    levels.append((None, low.ravel(), None, low.sum(axis=1), (low > 0).sum(axis=1), byte * 256 + flat, byte))
    levels.append((None, zero, None, np.array([zero.sum()]), np.array([(zero > 0).sum()]), flat, np.zeros(len(keys), np.int64)))

    found = np.zeros(len(keys))
    going, escaped = np.ones(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    excluded, out = np.zeros(len(keys)), np.zeros(len(keys))
    for level, (pairs, n, of_pair, total, kinds, at, context) in enumerate(levels):
        left, open_kinds = total[context] - excluded, kinds[context] - out
        live = going & (open_kinds > 0)
        hit = live & (n[at] > 0)
        miss = live & ~hit
        found[hit] += np.log10((n[at][hit] - 0.5) / left[hit])
        found[miss] += np.log10(0.5 * open_kinds[miss] / left[miss])
        going &= ~hit
        escaped |= total[context] > 0
        # what the context just left excludes one level below
        if level + 1 < len(levels):
            below = levels[level + 1]
            if pairs is not None:
                part, sym = pairs >> np.uint64(8), (pairs & np.uint64(0xFF)).astype(np.int64)
                if below[0] is not None:
                    place = np.searchsorted(below[0], part >> np.uint64(8) << np.uint64(8) | (pairs & np.uint64(0xFF)))
                else:
                    place = (part >> np.uint64(8)).astype(np.int64) * 256 + sym
                sums = np.bincount(of_pair, weights=np.where(n > 0, below[1][place], 0), minlength=len(total))
            else:
                sums = ((low > 0) * zero).sum(axis=1)
            excluded = np.where(escaped, sums[context], 0)
            out = np.where(escaped, kinds[context], 0)
    rest = SYMBOLS - np.count_nonzero(zero)
    found[going] -= np.log10(max(rest, 1))
    return found


def _survey(docs: DataFrame, shares: int) -> tuple[np.ndarray, int, int]:
    """(byte, symbol) counts, number of words and number of distinct words of the training part."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, held, n, size = np.zeros(1 << 16, dtype=np.int64), [], 0, 0
        for batch in batches:
            for part in pieces(batch, size=_PIECE):
                data, offsets = raw(part.column("text"))
                rows = len(offsets) - 1
                padded = np.full(len(data) + 2 * rows, _END, dtype=np.int64)
                shift = np.arange(rows) * 2 + 1
                padded[offsets[:-1] + shift - 1] = _BEFORE
                padded[np.arange(len(data)) + np.repeat(shift, np.diff(offsets))] = data
                after = padded[1:]
                low += np.bincount((padded[:-1] * 256 + after)[after != _BEFORE], minlength=1 << 16)
                known, _ = word_keys(part.column("text"))
                n += len(known)
                known = np.sort(known)
                held.append(known[_firsts(known)])
                size += len(held[-1])
                if size > 2_000_000:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)
        at = np.flatnonzero(low)
        yield pa.RecordBatch.from_arrays([pa.array([-3 - TaskContext.get().partitionId() % PAIR_GROUPS, -2], pa.int32()), pa.array([at.astype("<i8").tobytes() + low[at].astype("<i8").tobytes(), np.array([n], "<i8").tobytes()], pa.binary())], ["share", "keys"])

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        known = np.sort(np.concatenate(held))
        known = known[_firsts(known)]
        cuts = _cuts(known, _WORD_BITS, shares)
        packets = [(k, known[a:b].astype("<u8").tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in packets], pa.int32()), pa.array([p for _, p in packets], pa.binary())], ["share", "keys"])

    def gather(table: pa.Table) -> pa.Table:
        share, packets = table.column("share")[0].as_py(), table.column("keys").to_pylist()
        pair, n = np.full(1, share, np.int64), np.zeros(1, np.int64)
        if share <= -3:
            low = np.zeros(1 << 16, dtype=np.int64)
            for packet in packets:
                at, own = np.frombuffer(packet, "<i8").reshape(2, -1)
                low[at] += own
            pair, n = np.flatnonzero(low), low[np.flatnonzero(low)]
        elif share == -2:
            n[0] = sum(int(np.frombuffer(p, "<i8")[0]) for p in packets)
        else:
            known = np.empty(0, np.uint64)
            for at in range(0, len(packets), 64):
                known = np.unique(np.concatenate([known, *(np.frombuffer(p, "<u8") for p in packets[at : at + 64])]))
            pair[0], n[0] = -1, len(known)
        return pa.table({"pair": pa.array(pair, pa.int64()), "n": pa.array(n, pa.int64())})

    rows = docs.select("text").mapInArrow(scan, "share int, keys binary").groupBy("share").applyInArrow(gather, "pair long, n long")
    # tables of pairs met in PAIR_GROUPS groups; Spark sums what these found
    rows = rows.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most 2**16 + 2 rows
    low = np.zeros(1 << 16, dtype=np.int64)
    real = rows["pair"] >= 0
    low[rows["pair"][real]] = rows["n"][real]
    other = dict(zip(rows["pair"][~real], rows["n"][~real], strict=True))
    return low.reshape(256, 256), int(other.get(-2, 0)), int(other.get(-1, 0))


def scored(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row; rows where ``learns`` holds train the model."""
    arrow_settings(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    blocks = slots(docs.sparkSession, size["bytes"] + size["rows"], BLOCK_BYTES)
    shares = -(-blocks // BLOCKS_PER_SHARE)
    low, words, distinct_words = _survey(docs.where("learns"), shares)
    shipped = docs.sparkSession.sparkContext.broadcast(low)  # 2**16 counts

    blocked = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def count(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        shown: dict[str, list] = {"share": [], "keys": [], "counts": []}
        for kind, (keys_of, bits, width) in enumerate(_KINDS):
            sets, counts = [], []
            for batch in table.to_batches():
                for part in pieces(batch, size=_PIECE):
                    learned = part.column("learns").to_numpy(zero_copy_only=False)
                    keys, n = _marked(*keys_of(part.column("text")), learned)
                    sets.append(keys)
                    counts.append(n)
            keys, n = _merged(sets, counts)
            cuts = _cuts(keys, bits, shares)
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a == b:
                    continue
                shown["share"].append(kind * shares + k)
                shown["keys"].append(_bytes(keys[a:b], width))
                shown["counts"].append(n[a:b].astype("<u4").tobytes())
        blocks_ = pa.array([block] * len(shown["share"]), pa.int32())
        return pa.table([pa.array(shown["share"], pa.int32()), blocks_, pa.array(shown["keys"], pa.binary()), pa.array(shown["counts"], pa.binary())], ["share", "block", "keys", "counts"])

    packets = blocked.groupBy("block").applyInArrow(count, "share int, block int, keys binary, counts binary")

    def summed(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of all packets of a share and their summed counts."""
        known, total = np.empty(0, np.uint64), np.empty(0, np.int64)
        sets, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
        for at in range(0, len(sets), 64):
            known, total = _merged([known, *(_keys(p, width) for p in sets[at : at + 64])], [total, *(np.frombuffer(p, "<u4") for p in counts[at : at + 64])])
        return known, total

    def merge(table: pa.Table) -> pa.Table:
        """Grams of a share with their counts, one packet for each group of two-byte contexts."""
        share = table.column("share")[0].as_py()
        out: dict[str, list] = {"deal": [], "share": [], "keys": [], "counts": []}
        if share < shares:
            known, total = summed(table, ORDER + 1)
            known = gathered(known)
            deal = (mix(known >> np.uint64(8 * (ORDER - 1))) % np.uint64(shares)).astype(np.int64)
            order = np.argsort(deal, kind="stable")
            ends = np.cumsum(np.bincount(deal, minlength=shares))[:-1]
            for k, own in enumerate(np.split(order, ends)):
                if not len(own):
                    continue
                out["deal"].append(k)
                out["share"].append(share)
                out["keys"].append(known[own].astype("<u8").tobytes())
                out["counts"].append(total[own].astype("<i8").tobytes())
        return pa.table([pa.array(out["deal"], pa.int32()), pa.array(out["share"], pa.int32()), pa.array(out["keys"], pa.binary()), pa.array(out["counts"], pa.binary())], ["deal", "share", "keys", "counts"])

    def estimate(table: pa.Table) -> pa.Table:
        """Probabilities of all grams after some two-byte contexts, sent back to their shares."""
        sets = [np.frombuffer(p, "<u8") for p in table.column("keys").to_pylist()]
        keys, counts = np.concatenate(sets), np.concatenate([np.frombuffer(p, "<i8") for p in table.column("counts").to_pylist()])
        order = np.argsort(keys)
        values = np.empty(len(keys))
        values[order] = log_probabilities(keys[order], counts[order], shipped.value)
        parts = np.split(values.astype("<f4"), np.cumsum([len(s) for s in sets])[:-1])
        return pa.table([table.column("share"), table.column("keys"), pa.array([p.tobytes() for p in parts], pa.binary())], ["share", "keys", "values"])

    merged = packets.groupBy("share").applyInArrow(merge, "deal int, share int, keys binary, counts binary")
    model = merged.groupBy("deal").applyInArrow(estimate, "share int, keys binary, values binary")

    def answer(table: pa.Table, known: pa.Table) -> pa.Table:
        """For each packet the log-probabilities of its grams, or the corpus counts of its words, in its order."""
        asked = table.column("keys").to_pylist()
        if not asked:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["block", "share", "values"])
        if table.column("share")[0].as_py() < shares:
            width = ORDER + 1
            keys = scattered(np.concatenate([np.frombuffer(p, "<u8") for p in known.column("keys").to_pylist()]))
            values = np.concatenate([np.frombuffer(p, "<f4") for p in known.column("values").to_pylist()])
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
        else:
            width = 8
            keys, values = summed(table, width)
        told = [values[np.searchsorted(keys, _keys(p, width))].tobytes() for p in asked]
        return pa.table([table.column("block"), table.column("share"), pa.array(told, pa.binary())], ["block", "share", "values"])

    answers = packets.groupBy("share").cogroup(model.groupBy("share")).applyInArrow(answer, "block int, share int, values binary")

    def total(table: pa.Table, told: pa.Table) -> pa.Table:
        """Sums of a block's documents."""
        by_share = dict(zip(told.column("share").to_pylist(), told.column("values").to_pylist(), strict=True))
        parts = [part for batch in table.to_batches() for part in pieces(batch, size=_PIECE)]
        sums: list[list[np.ndarray]] = [[], [], [], []]
        for kind, (keys_of, bits, _) in enumerate(_KINDS):
            found = [keys_of(part.column("text")) for part in parts]
            own = np.empty(0, np.uint64)
            for at in range(0, len(found), 8):
                own = np.sort(np.concatenate([own, *(np.sort(keys) for keys, _ in found[at : at + 8])]))
                own = own[_firsts(own)]
            # packets were cut from the same sorted keys, so their answers line up with them
            values = np.concatenate([np.frombuffer(by_share.get(kind * shares + k, b""), "<i8" if kind else "<f4") for k in range(shares)]).astype(np.float64)
            index = _Index(own, bits)
            for keys, before in found:
                each = values[index.places(keys)]
                if kind:
                    sums[1].append(np.add.reduceat(np.log10(each + 0.5), before[:-1]))
                    sums[2].append(np.add.reduceat((each > 0).astype(np.int64), before[:-1]))
                    sums[3].append(np.diff(before))
                else:
                    sums[0].append(np.add.reduceat(each, before[:-1]))
        return pa.table([table.column("doc_id"), *(pa.array(np.concatenate(x)) for x in sums)], ["doc_id", "score", "base", "n_known", "n_tokens"])

    found = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total, "doc_id long, score double, base double, n_known long, n_tokens long")
    unit = float(np.log10(words + 0.5 * (distinct_words + 1)))
    return found.select("doc_id", "n_tokens", "n_known", F.lit(words).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(unit)).alias("base_score"), "score")
