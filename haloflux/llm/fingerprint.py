"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch keeps every distinct five-word shingle hash below a fixed fraction (1 / ``SCALE``) of the
hash range, so sketches of any two documents, however unequal, hold the same part of the hash space: the
sketch of a union is the union of the sketches, and containment and likeness of the texts are estimated
on them directly.  A set of which the fraction would keep fewer than ``FLOOR`` hashes keeps its ``FLOOR``
smallest (all, if it has fewer); ``bound`` tells up to which hash a sketch is complete, and two sketches
are compared below the lesser bound.

A null or empty text has an empty sketch, complete everywhere; two of these are alike (1), an empty and
another are not (0).  A text of one to four words is one shingle.  Rows are sketched one by one; extra
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 8
FLOOR = 16
SHINGLE = 5
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Documents of a bucket in which the order of ids is followed, on average.
BUCKET_ROWS = 4096
QUANTILES = 256
#: Bucket borders up to which they are broadcast; beyond it they are joined by a shuffle.
MOST_BORDERS = 100_000


def threshold(scale: int = SCALE) -> int:
    return _LEAST + (1 << 64) // scale - 1


def with_sketch(df: DataFrame, text_col: str, sketch_col: str, scale: int = SCALE, floor: int = FLOOR) -> DataFrame:
    """Adds ``sketch_col``: a struct of ``bound`` and ``hashes``, sorted."""
    words, hashes, kept = (F.col(f"_{sketch_col}_{n}") for n in ("words", "hashes", "kept"))
    names = [f"_{sketch_col}_{n}" for n in ("words", "hashes", "kept")]
    parts = F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    each = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, SHINGLE))))
    shingled = F.when(n >= SHINGLE, F.slice(each, 1, F.greatest(n - (SHINGLE - 1), F.lit(1)))).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    below = F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h <= F.lit(threshold(scale)))))
    smallest = F.slice(F.sort_array(F.array_distinct(hashes)), 1, floor)
    final = F.when(F.size(kept) >= floor, kept).otherwise(smallest)
    bound = F.when(F.size(kept) >= floor, F.lit(threshold(scale))).when(F.size(F.col(f"{sketch_col}.hashes")) < floor, F.lit(_MOST)).otherwise(F.greatest(F.element_at(F.col(f"{sketch_col}.hashes"), -1), F.lit(threshold(scale))))
    df = df.withColumn(names[0], parts).withColumn(names[1], shingled).withColumn(names[2], below)
    df = df.withColumn(sketch_col, F.struct(final.alias("hashes")))
    return df.withColumn(sketch_col, F.struct(bound.cast("long").alias("bound"), F.col(f"{sketch_col}.hashes").alias("hashes"))).drop(*names)


def _shared(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Number of hashes of a, of b and of both, below the lesser bound."""
    bound = F.least(a["bound"], b["bound"])

    def within(x: Column) -> Column:
        return F.when(x["bound"] > bound, F.filter(x["hashes"], lambda h: h <= bound)).otherwise(x["hashes"])

    return F.size(within(a)), F.size(within(b)), F.size(F.array_intersect(within(a), within(b)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketched texts."""
    n, m, both = _shared(a, b)
    return F.when(n + m == 0, F.lit(1.0)).otherwise(both / (n + m - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has; an empty text is contained in any."""
    n, _, both = _shared(a, b)
    return F.when(n == 0, F.lit(1.0)).otherwise(both / F.greatest(n, F.lit(1)))


def merged(df: DataFrame, keys: list[str], sketch_col: str) -> DataFrame:
    """Sketch of the union of all texts of a key: hashes up to the least bound of the key's sketches."""
    bounds = df.groupBy(*keys).agg(F.min(f"{sketch_col}.bound").alias("bound"))
    hashes = df.select(*keys, F.explode(f"{sketch_col}.hashes").alias("hash")).distinct()
    kept = hashes.join(bounds, keys).where("hash <= bound").groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias("hashes"))
    empty = F.array().cast("array<bigint>")
    return bounds.join(kept, keys, "left").select(*keys, F.struct("bound", F.coalesce("hashes", empty).alias("hashes")).alias(sketch_col))


def as_text(sketch: Column) -> Column:
    """Bound and hashes as 16 hexadecimal digits each."""
    digits = F.array_join(F.transform(sketch["hashes"], lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.lower(F.concat(F.lpad(F.hex(sketch["bound"]), 16, "0"), F.lit(":"), digits))


def _bucketed(df: DataFrame, rows: int) -> DataFrame:
    """Adds ``_bucket``, which never decreases with doc_id: equal widths between quantiles of the ids."""
    shares = [k / QUANTILES for k in range(QUANTILES + 1)]
    found = df.agg(F.percentile_approx("doc_id", shares, 10_000).alias("q")).first()["q"] or [0]
    borders = F.array(*(F.lit(q).cast("long") for q in sorted(set(found))))
    fine = max(1, -(-rows // (BUCKET_ROWS * QUANTILES)))
    at = F.greatest(F.size(F.filter(borders, lambda q: q <= F.col("doc_id"))), F.lit(1))
    low, high = F.get(borders, at - 1).cast("double"), F.coalesce(F.get(borders, at), F.get(borders, at - 1)).cast("double")
    inner = F.least(F.floor((F.col("doc_id").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * fine), F.lit(fine - 1))
    coarse = max(1, QUANTILES * BUCKET_ROWS // max(rows, 1))  # few rows: several quantiles share a bucket
    return df.withColumn("_bucket", F.floor(((at - 1) * fine + F.greatest(inner, F.lit(0))) / F.lit(coarse if fine == 1 else 1)).cast("long"))


def _borders(ids: DataFrame) -> DataFrame:
    """(doc_id, _target): the largest id below each bucket, which follows the bucket's last in descending order; the lowest bucket is followed by the largest id."""
    tops = ids.groupBy("_bucket").agg(F.max("doc_id").alias("top")).withColumn("_group", F.floor(F.col("_bucket") / 1024))
    inside = tops.withColumn("below", F.lag("top").over(Window.partitionBy("_group").orderBy("_bucket")))
    groups = tops.groupBy("_group").agg(F.max("top").alias("most"))
    whole = Window.orderBy("_group")  # one row per 1024 buckets
    groups = groups.select("_group", F.coalesce(F.lag("most").over(whole), F.max("most").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("under"))
    return inside.join(groups, "_group").select(F.coalesce("below", "under").alias("doc_id"), F.col("_bucket").alias("_target"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """Each document with its sketch, its successor's sketch and its edited text's sketch.

    The edited text has its last third replaced by as much of the successor's beginning; the successor is
    the document with the next smaller id (after the smallest, the largest).  Order is followed within
    buckets of ids, to which the row after their last is added, so that texts are shuffled once.  Rows
    with equal ids follow each other in order of their texts; rows without an id have no place in it, so no
    successor, edited text or sketches of these.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placeless, docs = docs.where("doc_id IS NULL"), docs.where("doc_id IS NOT NULL")
    ids = docs.select("doc_id")
    rows = ids.count()
    borders = _borders(_bucketed(ids, rows))
    if rows <= MOST_BORDERS * 16 or borders.count() <= MOST_BORDERS:
        spark = docs.sparkSession
        borders = F.broadcast(spark.createDataFrame(borders.collect(), "doc_id long, _target long"))
    placed = _bucketed(docs, rows).join(borders, "doc_id", "left")
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("extra"))
    extra = F.struct(F.col("_target").alias("bucket"), F.lit(True).alias("extra"))
    placed = with_sketch(placed, "text", "sketch", scale)
    placed = placed.withColumn("_place", F.explode(F.when(F.col("_target").isNull(), F.array(own)).otherwise(F.array(own, extra))))
    order = Window.partitionBy("_place.bucket").orderBy(F.col("_place.extra"), F.col("doc_id").desc(), F.col("text"))
    n = F.char_length("text")
    paired = placed.select(
        "doc_id", "text", "sketch", n.cast("long").alias("n_chars"), F.lead("text").over(order).alias("_next"), F.lead("sketch").over(order).alias("next_sketch"), F.col("_place.extra").alias("_extra")
    ).where("NOT _extra")
    cut = F.floor(n / 3).cast("int")
    paired = paired.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("_next", F.lit(1), cut)))
    paired = with_sketch(paired.drop("_next", "_extra"), "edited", "edited_sketch", scale)
    alone = with_sketch(placeless, "text", "sketch", scale).withColumn("n_chars", F.char_length("text").cast("long"))
    missing = {c: F.lit(None).cast(paired.schema[c].dataType) for c in ("next_sketch", "edited", "edited_sketch")}
    return paired.unionByName(alone.withColumns(missing).select(*paired.columns))
