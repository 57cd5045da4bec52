"""Toxic passages: maximum-scoring segments of token log-odds, with extreme-value calibration.

Units are words (runs of letters, lower-cased) and their beginnings of four and five bytes.  In labelled
documents each unit gets the log-odds of occurring in toxic against other documents under a Dirichlet
prior proportional to its overall frequency; a unit counts if its log-odds lie ``SIGNIFICANT`` standard
errors from 0.  A word scores by its most specific unit that counts, so that unseen forms of a
known stem are recognised; any other word costs ``DRIFT``.  One linear scan finds all maximal
scoring segments of a document.  Their chance expectation follows the extreme-value law
K n exp(-lambda s), with lambda and K from clean documents that took no part in the log-odds; segments
rarer than ``CHANCE`` are passages.  A document's evidence is the sum of -ln(expectation) over
its passages, and a logistic curve fitted on the same unseen labelled documents turns it
into a probability.

Only the fit uses a sample: about ``LABELLED`` labelled documents, drawn by a hash of the id.  Scoring reads every text whole in one pass without a shuffle.  Null and
empty texts have no evidence and get the probability of that.  Without labels of both classes
every score is 0.  Repeated rows score alike, an id labelled both ways counts as toxic, extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haloflux.llm.quality import Logistic
from haloflux.llm.scratch import arrow_settings, drawn, written
from haloflux.llm.text import pieces, raw, span_hashes

LABELLED = 40_000
PRIOR = 500.0
SIGNIFICANT = 3.0
LEAST_DOCS = 3
DRIFT = 0.3
CHANCE = 0.05
STEMS = (5, 4)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[97:123] = True
_WORD[128:] = True


def units(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of each word and of its stems (most specific first), word starts in bytes, and words before each text."""
    data, offsets = raw(column)
    low = _FOLD[data]
    capital = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
    low[capital] += 32  # Latin letters with marks
    inside = _WORD[low]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(low))]
    begins[cuts], finishes[cuts - 1] = inside[cuts], inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    found = [span_hashes(low, starts, ends)]
    found += [span_hashes(low, starts, np.minimum(starts + n, ends)) ^ np.uint64(n) for n in STEMS]
    return found, starts, np.searchsorted(starts, offsets)


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    rate: float = 1.0  # lambda
    volume: float = 1.0  # K
    curve: Logistic | None = None

    def token_scores(self, hashes: list[np.ndarray]) -> np.ndarray:
        scores = np.full(len(hashes[0]), -DRIFT)
        if len(self.keys):
            open_ = np.arange(len(hashes[0]))
            for unit in hashes:
                at = np.minimum(np.searchsorted(self.keys, unit[open_]), len(self.keys) - 1)
                known = self.keys[at] == unit[open_]
                scores[open_[known]] = self.weights[at[known]]
                open_ = open_[~known]
        return scores

    def expectation(self, score: np.ndarray, n: int) -> np.ndarray:
        return self.volume * max(n, 1) * np.exp(-self.rate * score)

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, int]:
        """Evidence and number of passages."""
        if not segments:
            return 0.0, 0
        e = self.expectation(np.array([s for _, _, s in segments]), n)
        e = e[e <= CHANCE]
        return float(-np.log(np.maximum(e, 1e-300)).sum()), len(e)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-self.curve.logit(np.log1p(evidence)[:, None])))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order: each cannot grow, and none holds another.

    Only positive tokens are visited; what lies between them enters through the running sum.  Each open
    segment knows the last one before it that starts from a lower sum, so what was passed over once is
    never visited again; a segment with none before it closes all others.  Linear in the number of tokens.
    """
    positive = np.flatnonzero(scores > 0)
    total = np.cumsum(scores)
    done: list[tuple[int, int, float]] = []
    starts, ends, lefts, rights, lower = [], [], [], [], []  # open segments: ends in tokens, sums there, last lower one
    before = total[positive] - scores[positive]
    for i, left, right in zip(positive.tolist(), before.tolist(), total[positive].tolist(), strict=True):
        start, j = i, len(starts) - 1
        while True:
            while j >= 0 and lefts[j] >= left:
                j = lower[j]
            if j < 0 or rights[j] >= right:
                break
            # the two and all between them are one
            start, left, k = starts[j], lefts[j], j
            j = lower[j]
            del starts[k:], ends[k:], lefts[k:], rights[k:], lower[k:]
        if j < 0:
            done += [(s, e, r - l) for s, e, l, r in zip(starts, ends, lefts, rights, strict=True)]
            starts, ends, lefts, rights, lower = [], [], [], [], []
        starts.append(start)
        ends.append(i + 1)
        lefts.append(left)
        rights.append(right)
        lower.append(j)
    return done + [(s, e, r - l) for s, e, l, r in zip(starts, ends, lefts, rights, strict=True)]


def segments_of(column: pa.Array, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray]]:
    """Number of words, segments and token scores of each text."""
    hashes, _, before = units(column)
    scores = model.token_scores(hashes)
    for i in range(len(before) - 1):
        own = scores[before[i] : before[i + 1]]
        yield len(own), maximal_segments(own), own


def unit_weights(counts: DataFrame, toxic_docs: int, clean_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Significant units (key, toxic, clean): sorted keys and log-odds under a Dirichlet prior."""
    total = toxic_docs + clean_docs
    prior = PRIOR * (F.col("toxic") + F.col("clean")) / F.lit(float(total))

    def odds(n: str, size: int):
        return F.log((F.col(n) + prior) / (F.lit(float(size)) + PRIOR - F.col(n) - prior + 1e-9))

    weighed = counts.where(F.col("toxic") + F.col("clean") >= LEAST_DOCS).select("key", (odds("toxic", toxic_docs) - odds("clean", clean_docs)).alias("weight"), F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)).alias("error"))
    kept = weighed.where(F.abs(F.col("weight")) > SIGNIFICANT * F.col("error")).select("key", "weight").toPandas()  # units of at least LEAST_DOCS of the sampled documents
    keys = kept["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], kept["weight"].to_numpy(dtype=float)[order]


def positive_root(values: np.ndarray, shares: np.ndarray) -> float:
    """The lambda > 0 with sum(share * exp(lambda * value)) = 1; values have a negative mean."""
    if not (values > 0).any():
        return 3.0
    low, high = 1e-6, 1.0
    while np.sum(shares * np.exp(np.minimum(high * values, 600))) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if np.sum(shares * np.exp(np.minimum(middle * values, 600))) < 1 else (low, middle)
    return (low + high) / 2


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> Model:
    """Model from the labelled rows of ``docs`` (doc_id, text); half of them give log-odds, half the calibration."""
    arrow_settings(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("label"))
    share = min(1.0, LABELLED / max(known.count(), 1))
    # about LABELLED rows of an id and a label, so that no text is shuffled; the sample is read four times
    chosen = F.broadcast(known.where(drawn(share, "doc_id")))
    sample = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id"))
    first = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                hashes, _, before = units(part.column("text"))
                toxic = np.asarray(part.column("label")) > 0
                owner = np.repeat(np.arange(len(toxic)), np.diff(before))
                # each unit once per document, so that a repeated word weighs no more than one
                pairs = np.unique(np.column_stack((np.concatenate(hashes), np.tile(owner.astype(np.uint64), len(hashes)))), axis=0) if len(owner) else np.empty((0, 2), np.uint64)
                keys, at = np.unique(pairs[:, 0], return_inverse=True)
                bad = np.bincount(at, weights=toxic[pairs[:, 1].astype(np.int64)], minlength=len(keys)).astype(np.int64)
                every = np.bincount(at, minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(bad), pa.array(every - bad)], ["key", "toxic", "clean"])

    sizes = sample.where(first).agg(F.coalesce(F.sum("label"), F.lit(0)).alias("toxic"), F.count("*").alias("docs")).first()
    toxic_docs, clean_docs = int(sizes["toxic"]), int(sizes["docs"] - sizes["toxic"])
    if not toxic_docs or not clean_docs:
        return Model()
    counts = sample.where(first).select("text", "label").mapInArrow(count, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    model = Model(*unit_weights(counts, toxic_docs, clean_docs))

    rest = sample.where(~first).select("text", "label")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of token scores of clean documents (label NULL) and, of each document, its words and best segment."""
        seen: dict[float, int] = {}
        for batch in batches:
            for part in pieces(batch):
                n, tops = [], []
                labels = part.column("label").to_pylist()
                for label, (words, found, scores) in zip(labels, segments_of(part.column("text"), model), strict=True):
                    n.append(words)
                    tops.append(max((s for _, _, s in found), default=0.0))
                    if not label:
                        for value, times in zip(*(x.tolist() for x in np.unique(np.round(scores, 2), return_counts=True)), strict=True):
                            seen[value] = seen.get(value, 0) + times
                yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(n, pa.int64()), pa.array(tops, pa.float64())], ["label", "n", "value"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.int32()), pa.array(seen.values(), pa.int64()), pa.array(seen.keys(), pa.float64())], ["label", "n", "value"])

    measured = rest.mapInArrow(measure, "label int, n long, value double").groupBy("label", "value").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    rows = measured.toPandas()  # a few thousand values of scores, and at most one row for each sampled document
    tokens, clean = rows[rows["label"].isna()], rows[rows["label"] == 0].sort_values("value")
    if not len(clean) or not (rows["label"] == 1).any():
        return Model()
    if len(tokens):
        model.rate = positive_root(tokens["value"].to_numpy(), tokens["n"].to_numpy() / tokens["n"].sum())
    # K from the exceedances of a middling segment score over clean text
    tops = np.repeat(clean["value"].to_numpy(), clean["docs"].to_numpy())
    level = float(np.quantile(tops[tops > 0], 0.5)) if (tops > 0).any() else 0.0
    model.volume = float(((tops >= level) & (tops > 0)).sum() + 0.5) / float((clean["n"].sum() + 1) * np.exp(-model.rate * level))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                own = [model.evidence(segments, n)[0] for n, segments, _ in segments_of(part.column("text"), model)]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(own, pa.float64())], ["label", "evidence"])

    # in an order that doesn't depend on the run
    weighed = rest.mapInArrow(weigh, "label int, evidence double").toPandas().sort_values(["label", "evidence"])
    model.curve = Logistic.fit(np.log1p(weighed["evidence"].to_numpy(dtype=float))[:, None], weighed["label"].to_numpy(dtype=float))
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, number of toxic passages, and the passages as start:end in words."""
    arrow_settings(docs.sparkSession)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                evidence, count, passages = [], [], []
                for n, segments, _ in segments_of(part.column("text"), model):
                    value, k = model.evidence(segments, n)
                    evidence.append(value)
                    count.append(k)
                    passages.append(",".join(f"{s}:{e}" for s, e, v in segments if model.expectation(np.array(v), n) <= CHANCE) if k else "")
                score = model.probability(np.array(evidence))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(count, pa.int64()), pa.array(passages, pa.string())], ["doc_id", "score", "n_passages", "passages"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rate, "doc_id long, score double, n_passages long, passages string")
