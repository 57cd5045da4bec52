"""Language identification by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams of one to four characters, in order of frequency;
words are padded, everything but letters separates words.  A document's own most frequent n-grams
are compared to each profile: an n-gram is out of place by the difference of its ranks, one that
the profile lacks by the most possible.  The language with the least sum wins, ties going to the
first in alphabetical order.

Profiles are learned from a sample of about ``LEARNED`` documents per language (chosen by a hash of
the id, so a language that holds most rows weighs no more than another); everything else covers
all rows and whole texts in one pass without a shuffle.  A null text or one without a letter is
``und`` with score 0, as is every text if nothing could be learned; letters beyond the 16-bit plane
are in no profile.  Rows are handled one by one,
rows with null lang teach nothing, and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haloflux.llm.scratch import arrow_settings
from haloflux.llm.text import pieces

LEARNED = 2_000
PROFILE = 400
#: Most frequent n-grams of a document that are compared.
COMPARED = 300
LONGEST = 4
UNKNOWN = "und"
_PAD = 1
#: Languages up to which the sampling shares are broadcast; beyond it they are joined by a shuffle.
MOST_SHIPPED = 10_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case form of each 16-bit code that is a letter, 0 for others; higher code points share their low bits."""
    table = np.zeros(1 << 16, dtype=np.uint16)
    for code in range(2, 1 << 16):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else code
    return table


def letters(text: str) -> np.ndarray:
    """The text's letters in lower case, words padded on both sides by one mark."""
    codes = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    kept = _letters()[codes]
    kept = np.concatenate(([_PAD], np.where(kept > 0, kept, _PAD), [_PAD])).astype(np.uint64)
    return kept[np.concatenate(([True], (kept[1:] != _PAD) | (kept[:-1] != _PAD)))]


def ngrams(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, packed into 64 bits, and their counts; no n-gram spans two words."""
    found, grams = [kept[kept != _PAD]], kept
    for n in range(2, LONGEST + 1):
        if len(kept) < n:
            break
        grams = (grams[:-1] << np.uint64(16)) | kept[n - 1 :]
        inner = np.ones(len(grams), dtype=bool)
        for k in range(1, n - 1):
            inner &= kept[k : k + len(grams)] != _PAD
        found.append(grams[inner])
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams first; equal counts in order of the n-gram."""
    return grams[np.lexsort((grams, -counts.astype(np.int64)))[:most]]


@dataclass
class Profiles:
    languages: list[str]
    grams: np.ndarray  # sorted, of all profiles
    ranks: np.ndarray  # (n-gram, language); PROFILE where it lacks

    @classmethod
    def of(cls, orders: dict[str, np.ndarray]) -> Profiles:
        languages = sorted(orders)
        grams = np.unique(np.concatenate([*orders.values(), np.empty(0, np.uint64)]))
        ranks = np.full((len(grams) + 1, len(languages)), PROFILE, dtype=np.int32)
        for k, language in enumerate(languages):
            ranks[np.searchsorted(grams, orders[language]), k] = np.arange(len(orders[language]))
        return cls(languages, grams, ranks)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and a score that is 1 for a perfect and unrivalled fit, 0 if all fit alike."""
        kept = letters(text) if text else np.empty(0, np.uint64)
        if not self.languages or (len(kept) <= 1 and not any(c.isalpha() for c in text or "")):
            return UNKNOWN, 0.0
        if len(kept) <= 1:  # letters beyond 16 bits only, which no profile holds
            return self.languages[0], 0.0
        own = ranked(*ngrams(kept), COMPARED)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[at]
        out = np.where(ranks == PROFILE, PROFILE, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0) / (PROFILE * len(own))
        odds = np.exp(-40 * (out - out.min()))
        best = int(np.argmin(out))
        share = odds[best] / odds.sum()
        k = len(self.languages)
        return self.languages[best], float(max(0.0, (share - 1 / k) / (1 - 1 / k))) if k > 1 else float(1 - out[best])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from the rows of ``docs`` with a language and a text."""
    arrow_settings(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    shares = docs.groupBy("lang").agg((F.lit(float(LEARNED)) / F.count("*")).alias("share"))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    shares = shares.select("lang", "share").collect() if shares.count() <= MOST_SHIPPED else shares
    if isinstance(shares, list):
        shares = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share double"))
    drawn = docs.join(shares, "lang").where(spread < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                texts = part.column("text").to_pylist()
                for lang in sorted(set(langs)):
                    kept = np.concatenate([letters(texts[i]) for i in np.flatnonzero(langs == lang)])
                    grams, counts = ngrams(kept)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    counted = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def top(table: pa.Table) -> pa.Table:
        best = ranked(np.asarray(table.column("gram")).view(np.uint64), np.asarray(table.column("n")), PROFILE)
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(best)), "rank": pa.array(range(len(best)), pa.int32()), "gram": pa.array(best.view(np.int64))})

    orders: dict[str, np.ndarray] = {}
    rows = counted.groupBy("lang").applyInArrow(top, "lang string, rank int, gram long").toPandas()  # PROFILE rows a language
    for lang, own in rows.groupby("lang"):
        orders[lang] = own.sort_values("rank")["gram"].to_numpy().view(np.uint64)
    return Profiles.of(orders)


def predicted(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    arrow_settings(docs.sparkSession)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rate, "doc_id long, lang_pred string, score double")
