"""Quality classifier by co-training: a text view and a metadata view teach each other.

Two logistic models see disjoint views of a document: statistics of its whole text, and its page
metadata (source, language, recorded length).  Both start from labelled rows.  In each round
either view labels the unlabelled rows it is surest about, and these go into the *other* view's
training set, in proportion to the classes.  A labelled part that neither view was fitted on
calibrates and weighs the two views; the combined probability scores every document.

Only the fit uses a sample: about ``LABELLED`` labelled and ``UNLABELLED`` other documents, drawn by
a hash of the id.  Features and scores are computed in one pass over all documents in whole;
nothing is shuffled but the sample's features.  One task fits the model on these, and the driver gets
nothing but the model.

Null and empty texts have all-zero statistics; null metadata is a value of its own.  Without
labels of both classes every document scores 1 (nothing is rejected).  Repeated rows score alike,
an id with several labels counts as good only if all say so, and extra columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haloflux.llm.scratch import arrow_settings
from haloflux.llm.scratch import drawn as drawn_by_id
from haloflux.llm.text import mix, pieces, raw, span_hashes, word_bounds

LABELLED = 20_000
UNLABELLED = 20_000
ROUNDS = 5
#: A view teaches only rows it puts above this probability of either class.
CONFIDENT = 0.98
#: Share of the unlabelled pool that a view may label in a round.
TAUGHT = 0.1
KEEP = 0.5

_CLASSES = 9
_CLASS = np.full(256, 6, dtype=np.int64)  # other punctuation
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[ord("!")] = 7
_CLASS[128:] = 8
SOURCE_BUCKETS = 64
LANG_BUCKETS = 16


def text_features(column: pa.Array) -> np.ndarray:
    """One row of statistics per text."""
    data, offsets = raw(column)
    n, size = len(offsets) - 1, np.diff(offsets)
    of = np.repeat(np.arange(n), size)
    kinds = np.bincount(of * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
    starts, ends, before = word_bounds(data, offsets)
    count = np.diff(before)
    owner = np.repeat(np.arange(n), count)
    length = ends - starts
    first, last = data[starts], data[ends - 1]

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values, minlength=n) / np.maximum(count, 1)

    hashes = span_hashes(data, starts, ends)
    again = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])))[: len(hashes)]
    _, first_at = np.unique(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)), return_index=True)
    distinct_words = np.bincount(owner[first_at], minlength=n)
    symbol = _CLASS == 6
    upper = (_CLASS[first] == 1) & (_CLASS[last] != 0)
    columns = [np.log1p(size), np.log1p(count), np.log1p(kinds[:, 4])]
    columns += [kinds[:, k] / np.maximum(size, 1) for k in range(_CLASSES)]
    columns += [
        per_word(length),
        np.sqrt(np.maximum(per_word(length.astype(float) ** 2) - per_word(length) ** 2, 0)),
        per_word(symbol[last]),
        per_word(symbol[first] & (length == 1)),
        per_word(_CLASS[last] == 7),
        per_word(_CLASS[last] == 5),
        per_word(upper),
        per_word((_CLASS[first] == 1) & (_CLASS[last] == 0)),
        per_word(length <= 3),
        per_word(length >= 12),
        np.log1p(size / (kinds[:, 4] + 1)),
        per_word(again),
        np.sqrt(per_word(again)),
        np.log((distinct_words + 1) / (count + 1)),
    ]
    return np.column_stack(columns).astype(np.float64)


def _bucket(value, buckets: int) -> int:
    return zlib.crc32(repr(value).encode()) % buckets


def metadata_features(sources: list, langs: list, sizes: list) -> np.ndarray:
    """One-hot hashed source and language, and the recorded length."""
    out = np.zeros((len(sources), SOURCE_BUCKETS + LANG_BUCKETS + 2))
    known: dict = {}
    for i, (source, lang, chars) in enumerate(zip(sources, langs, sizes, strict=True)):
        at = known.get((source, lang))
        if at is None:
            at = known[source, lang] = (_bucket(source, SOURCE_BUCKETS), SOURCE_BUCKETS + _bucket(lang, LANG_BUCKETS))
        out[i, at] = 1
        out[i, -2:] = (0, 1) if chars is None else (np.log1p(max(chars, 0)), 0)
    return out


@dataclass
class Logistic:
    """Standardised logistic regression fitted by damped Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)


@dataclass
class Model:
    text: Logistic
    metadata: Logistic
    combined: Logistic

    def score(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        views = np.column_stack((self.text.logit(text), self.metadata.logit(metadata)))
        return 1 / (1 + np.exp(-self.combined.logit(views)))


def co_train(views: tuple[np.ndarray, np.ndarray], labels: np.ndarray, rounds: int = ROUNDS) -> Model | None:
    """Fits both views; ``labels`` is 0, 1 or NaN for unlabelled rows.  None without both classes."""
    known = np.flatnonzero(~np.isnan(labels))
    calibrating = np.concatenate([known[labels[known] == c][::5] for c in (0.0, 1.0)])
    start = np.setdiff1d(known, calibrating)
    if min(len(np.unique(labels[start])), len(np.unique(labels[calibrating]))) < 2:
        return None
    pool = np.flatnonzero(np.isnan(labels))
    share = labels[start].mean()
    rows, taught = [start, start], [labels[start], labels[start]]
    free = [np.ones(len(pool), dtype=bool), np.ones(len(pool), dtype=bool)]
    for _ in range(rounds):
        models = [Logistic.fit(views[v][rows[v]], taught[v]) for v in range(2)]
        for teacher, pupil in ((0, 1), (1, 0)):
            if not len(pool):
                continue
            p = 1 / (1 + np.exp(-models[teacher].logit(views[teacher][pool])))
            for label, sure, part in ((1.0, p, share), (0.0, 1 - p, 1 - share)):
                able = np.flatnonzero(free[pupil] & (sure >= CONFIDENT))
                chosen = able[np.argsort(-sure[able], kind="stable")][: int(TAUGHT * part * len(pool))]
                free[pupil][chosen] = False
                rows[pupil] = np.concatenate((rows[pupil], pool[chosen]))
                taught[pupil] = np.concatenate((taught[pupil], np.full(len(chosen), label)))
    models = [Logistic.fit(views[v][rows[v]], taught[v]) for v in range(2)]
    held = np.column_stack([models[v].logit(views[v][calibrating]) for v in range(2)])
    return Model(models[0], models[1], Logistic.fit(held, labels[calibrating]))


def _view_columns(docs: DataFrame) -> list:
    return [F.col(c) if c in docs.columns else F.lit(None).alias(c) for c in ("text", "lang", "source")] + [
        F.col("n_chars").cast("double").alias("n_chars") if "n_chars" in docs.columns else F.lit(None).cast("double").alias("n_chars")
    ]


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = np.concatenate([text_features(p.column("text")) for p in pieces(batch)]) if batch.num_rows else np.zeros((0, 0))
    return text, metadata_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out_fold: int | None = 0) -> Model | None:
    """Model from labelled and other documents; rows with crc32(doc_id) mod 5 in the held-out fold are not used."""
    size = docs.count()
    known = labels.where(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.min(F.col(label_col).cast("double")).alias("_label"))
    marked = known.count()
    labelled_share, other_share = (min(1.0, bound / max(n, 1)) for bound, n in ((LABELLED, marked), (UNLABELLED, size)))
    drawn = docs.where(F.col("doc_id").isNotNull() & drawn_by_id(max(labelled_share, other_share), "doc_id"))
    if held_out_fold is not None:
        drawn = drawn.where(F.crc32(F.col("doc_id").cast("string")) % 5 != held_out_fold)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = [pa.array(list(v), pa.list_(pa.float64())) for v in _views(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_row"), *views], ["doc_id", "_row", "_text_view", "_metadata_view"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = [batch for batch in batches if batch.num_rows]
        if not filled:
            return
        sample = pa.Table.from_batches(filled)
        order = np.lexsort((sample["_row"].to_numpy(), sample["doc_id"].to_numpy()))
        views = tuple(np.concatenate([c.flatten().to_numpy() for c in sample[view].chunks]).reshape(len(order), -1)[order] for view in ("_text_view", "_metadata_view"))
        model = co_train(views, sample["_label"].to_numpy()[order])
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    drawn = drawn.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), *_view_columns(docs))
    drawn = drawn.mapInArrow(measure, "doc_id long, _row long, _text_view array<double>, _metadata_view array<double>").join(known, "doc_id", "left")
    taken = drawn.where(F.when(F.col("_label").isNotNull(), drawn_by_id(labelled_share, "doc_id")).otherwise(drawn_by_id(other_share, "doc_id")))
    # one task has about LABELLED + UNLABELLED rows of some hundred numbers, whatever the size of the table
    fitted = taken.repartition(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else None


def scored(docs: DataFrame, model: Model | None, score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality in ``score_col``; other columns pass through."""
    arrow_settings(docs.sparkSession)
    kept = [c for c in docs.columns if c != score_col]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(score_col, T.DoubleType())])
    n = len(kept)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view = pa.RecordBatch.from_arrays(batch.columns[n:], ["text", "lang", "source", "n_chars"])
            score = model.score(*_views(view)) if model is not None and batch.num_rows else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(score)], [*kept, score_col])

    views = [c.alias(f"_view_{i}") for i, c in enumerate(_view_columns(docs))]
    return docs.select(*kept, *views).mapInArrow(rate, schema)
