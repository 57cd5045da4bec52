"""Near-duplicate documents by min-hash banding, odd sketches and exact confirmation.

A document is the set of its distinct five-word shingles.  Two documents are linked if their
sets' Jaccard similarity is at least ``percent`` / 100; documents connected by links form one
component.  Steps, all of them joins and aggregates on Spark:

1. Each set gets a min-hash sample, banded into keys, and an *odd sketch*: a bitmap in which each
   sampled minimum flips one bit.  The XOR of two bitmaps has few bits set exactly if the
   samples differ little, which estimates high similarities sharply at 128 bytes a document.  A second
   such bitmap of the whole set bounds the difference of two sets from below.
2. Equal sets collapse into a class, represented by its smallest id, before anything is compared.
3. Each document is held against one center, the document of its band buckets that meets most others.
   Pairs whose sketches agree are confirmed on the full sets; that keeps a group of n close copies
   at n pairs.
4. Pairs of one bucket that are still in different components are compared as well: members
   outside the bucket's largest component against all others, sketches first.  Where more than ``CROWDED``
   are outside, members only meet if they share one of their rarest shingles, as all that are similar do.
5. Components come from alternating large-star and small-star contractions.

A pair at the threshold shares no bucket, or has sketches too far apart, with a probability of about
2e-5 (0.80) or 1e-5 (0.85), and much less above; apart from that no link between different texts is
missed.  No bucket, group or
partner list has a cap.

Null and empty texts, and texts of white space, have no shingles and are linked with nothing; a text
of one to four words is one shingle.  Rows that repeat an id count as one document having all their
links.  Rows with a null id are in no component.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haloflux.llm.scratch import arrow_settings, written
from haloflux.llm.text import SHINGLE, mix, pieces, shingle_sets

BANDS = 30
ROWS = 5
#: Min-hash samples; the first BANDS * ROWS of them are banded, all are sketched.
SAMPLES = 512
SKETCH_WORDS = 16
SKETCH_BITS = 64 * SKETCH_WORDS
PERCENT = 85
#: Members outside a bucket's largest component up to which each is compared with the whole bucket: so many pairs a member at most.
CROWDED = 1000
#: By how much the sketch estimate may lie below the threshold before a pair is dropped (over four deviations).
SLACK = 0.10

_rng = np.random.default_rng(20240607)
_FACTORS = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_SKETCH_COLUMNS = [f"s{k}" for k in range(SKETCH_WORDS)]
_WHOLE_COLUMNS = [f"t{k}" for k in range(SKETCH_WORDS)]


def minima(values: np.ndarray) -> np.ndarray:
    """Min-hash sample of a set of 64-bit hashes."""
    low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    found = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 1024):
        part = low[at : at + 1024, None] * _FACTORS
        part += _SHIFTS
        np.minimum(found, part.min(axis=0), out=found)
    return found


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(sets, samples) to (sets, bands) keys; a key also tells its band."""
    rows = samples[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + rows[:, :, k])
    return keys


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(sets, samples) to (sets, words) bitmaps: a bit is set if an odd number of samples hit it."""
    place = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
    bits = mix(samples.astype(np.uint64) + place) % np.uint64(SKETCH_BITS)
    return _folded(bits.ravel(), np.repeat(np.arange(len(samples)), SAMPLES), len(samples))


def whole_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The same fold of all elements of each set: two of these never differ in more bits than the sets in elements."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return _folded(mix(np.concatenate([*sets, np.empty(0, np.uint64)])) % np.uint64(SKETCH_BITS), owner, len(sets))


def _folded(bits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    odd = np.bincount(bits.astype(np.int64) + owner * SKETCH_BITS, minlength=n * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, SKETCH_BITS), axis=1, bitorder="little").view(np.uint64)


def most_flips(percent: int) -> int:
    """Differing sketch bits up to which a pair may have the similarity."""
    drawn = 2 * SAMPLES * (1 - percent / 100 + SLACK)
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** drawn))


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Set size, two sums that identify the set, sketch and band keys of each row of (doc_id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(part.column("text"), size)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                sums = np.array([(np.sum(mix(s), dtype=np.uint64), np.sum(mix(~s), dtype=np.uint64)) for s in sets], dtype=np.uint64).reshape(-1, 2)
                samples = np.array([minima(s) for s in sets], dtype=np.uint32).reshape(-1, SAMPLES)
                sketch, whole, keys = odd_sketches(samples), whole_sketches(sets), band_keys(samples)
                offsets = np.arange(len(sets) + 1, dtype=np.int32) * BANDS
                columns = [part.column("doc_id"), pa.array(n)]
                columns += [pa.array(np.ascontiguousarray(sums[:, k]).view(np.int64), pa.int64()) for k in range(2)]
                columns += [pa.array(np.ascontiguousarray(bits[:, k]).view(np.int64), pa.int64()) for bits in (sketch, whole) for k in range(SKETCH_WORDS)]
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64), pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "k1", "k2", *_SKETCH_COLUMNS, *_WHOLE_COLUMNS, "bands"])

    schema = "doc_id long, n_shingles long, k1 long, k2 long, " + ", ".join(f"{c} long" for c in _SKETCH_COLUMNS + _WHOLE_COLUMNS) + ", bands array<long>"
    return docs.mapInArrow(sign, schema)


def sets_of(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, shingles): the full set of each row of (doc_id, text)."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(part.column("text"), size)
                offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                values = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "shingles"])

    return docs.mapInArrow(collect, "doc_id long, shingles array<long>")


def _flips(a: str, b: str, columns: list[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return total


def _may_reach(a: str, b: str, percent: int) -> Column:
    """Whether the sketches of two aliased rows may belong to sets of the similarity.

    The sketch of samples estimates it at any size; the sketch of the whole sets bounds their
    difference, which is sharp for sets of up to some thousand elements.
    """
    sizes = F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles")
    return (_flips(a, b, _SKETCH_COLUMNS) <= most_flips(percent)) & ((100 + percent) * _flips(a, b, _WHOLE_COLUMNS) <= (100 - percent) * sizes)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_right"))
    both = F.size(F.array_intersect("_left", "_right"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(100 * both >= percent * (F.size("_left") + F.size("_right") - both))
        .select("a", "b")
        .distinct()
    )


def prefix_pairs(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of (id, component, shingles) of different components that may reach the similarity, none that does left out.

    Two sets that reach it share one of their rarest shingles: the first n - ceil(percent * n / 100) + 1 of
    each, counted from the rarest among all members.  Texts that have a template in common meet only if what is
    their own leaves some of the template among these, so such texts cost a row a shingle, not a row a pair.
    """
    own = F.xxhash64("shingles").alias("own")  # an id that is repeated has several sets
    flat = members.select("id", "component", own, F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    common = flat.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    # a shingle that no other member has comes first and meets no other
    ranked = flat.join(common, "shingle", "left").withColumn("times", F.coalesce("times", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("id", "own").orderBy("times", "shingle"))
    kept = ranked.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    kept = kept.where("times > 1").select("id", "component", "n", "shingle")
    x, y = kept.alias("x"), kept.alias("y")
    sized = (100 * F.col("x.n") >= percent * F.col("y.n")) & (100 * F.col("y.n") >= percent * F.col("x.n"))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & sized)
    pairs = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().alias("p")
    near = pairs.join(sketches.alias("u"), F.col("p.a") == F.col("u.doc_id")).join(sketches.alias("v"), F.col("p.b") == F.col("v.doc_id"))
    return near.where(_may_reach("u", "v", percent)).select("p.a", "p.b")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest reachable id of each node of the edges (a, b)."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    size = edges.count()
    while size:
        before, known = edges, size
        # large star: each larger neighbour of u is tied to the smallest neighbour of u
        ways = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = edges.join(least, "a")
        edges = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = written(edges.where("a <> b").distinct())
        size = edges.count()
        # done when not a single edge has changed
        if size == known and edges.join(before, ["a", "b"], "left_anti").isEmpty():
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and kept (it is its component's smallest id)."""
    arrow_settings(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(docs, size))
    key = ["n_shingles", "k1", "k2"]
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(known.groupBy(*key).agg(F.min("doc_id").alias("rep")))
    reps = known.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")

    banded = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    members = written(banded.join(buckets.select("band", "n"), "band"))
    met = written(members.groupBy("id").agg(F.sum("n").alias("met")))
    ids = met.select(F.col("id").alias("doc_id"))
    sets = written(sets_of(docs.join(ids, "doc_id", "left_semi"), size))
    sketches = written(known.join(ids, "doc_id", "left_semi").select("doc_id", "n_shingles", *_SKETCH_COLUMNS, *_WHOLE_COLUMNS, "bands"))

    # of a bucket's members the one that meets most others is the likeliest to be linked with them
    rank = F.struct(F.col("met"), -F.col("id"))
    ranked = members.join(met, "id").select("band", "id", rank.alias("rank"))
    centers = ranked.groupBy("band").agg(F.max("rank").alias("center"))
    nearest = ranked.join(centers, "band").groupBy("id").agg(F.max("center").alias("center"))
    nearest = nearest.select((-F.col("center.col2")).alias("a"), F.col("id").alias("b")).where("a <> b")
    near = (
        nearest.alias("p")
        .join(sketches.alias("x"), F.col("p.a") == F.col("x.doc_id"))
        .join(sketches.alias("y"), F.col("p.b") == F.col("y.doc_id"))
        .where(_may_reach("x", "y", percent))
        .select("p.a", "p.b")
    )
    links = written(confirmed(near, sets, percent))
    joined = components(links)

    placed = members.join(joined, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    shares = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("band").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("size")).where("parts > 1")
    mixed = mixed.select("band", F.col("most.component").alias("main"), (F.col("size") - F.col("most.n") > CROWDED).alias("crowded"))
    apart = written(placed.join(mixed, "band").join(sketches.withColumnRenamed("doc_id", "id"), "id"))
    few = apart.where("NOT crowded")
    x, y = few.where("component <> main").alias("x"), few.alias("y")
    # a pair counts once: in the first band it shares, and in one order
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    first_shared = F.element_at(F.array_intersect("x.bands", "y.bands"), 1) == F.col("x.band")
    across = x.join(
        y,
        (F.col("x.band") == F.col("y.band")) & (F.col("x.component") != F.col("y.component")) & once & _may_reach("x", "y", percent) & first_shared,
    ).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    # a pair whose first shared bucket is crowded is found by its rarest shingles
    crowd = apart.where("crowded").select("id", "component").distinct()
    members_of = crowd.join(sets.withColumnRenamed("doc_id", "id"), "id")
    across = across.union(prefix_pairs(members_of, sketches, percent)).distinct()
    joined = components(links.union(confirmed(across, sets, percent)))

    named = classes.join(joined, classes["rep"] == joined["id"], "left").select(*key, F.coalesce("component", "rep").alias("_component"))
    found = signed.select("doc_id", *key).join(named, key, "left")
    component = F.coalesce("_component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
