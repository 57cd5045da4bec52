"""Personal data: base patterns, and further spans that boosted trees pick from generous candidates.

Base spans are the leftmost, non-overlapping matches of one pattern per kind that pass the kind's
validity rule (octets up to 255, Luhn checksum, number of digits).  Generators with high recall
propose further, overlapping spans: written-out addresses, IPv6, digit groups of any kind, assigned
secrets, long mixed tokens.  Gradient-boosted trees rate a candidate by its format and its
context.  They learn from weak labels: base spans and publicly known secret formats are positive;
candidates that break their kind's rule are negative; all else is left to the model.  A threshold
per kind, the lowest that reaches ``PRECISION`` on the labelled candidates of all documents the trees haven't
learned from, decides which candidates become spans; they never replace or overlap base spans.  A kind with
too little evidence in the whole corpus has the threshold ``FIXED``; one with enough of it but no threshold that reaches
``PRECISION`` gets no spans besides base spans.

Only the trees use a sample, three quarters of about ``SAMPLE_DOCS`` documents (by a hash of the id) and at most
``SAMPLE_CANDIDATES`` candidates; thresholds come from counts over all other documents.  Detection reads every text whole, in one pass without a shuffle, in time linear in
its length.  Null and empty texts have no spans.  Rows are handled one by one (repeated rows and
null ids too), extra columns pass through ``redacted`` and are ignored otherwise.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haloflux.llm.boosting import Boosted
from haloflux.llm.scratch import arrow_settings, drawn

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
SAMPLE_DOCS = 20_000
SAMPLE_CANDIDATES = 60_000
PRECISION = 0.99
#: Labelled unseen candidates, half of them positive, needed before a kind's threshold is chosen from them; ``FIXED`` holds before.
LEAST_SEEN = 20
FIXED = 0.9
#: Equal bins of scores in which labelled candidates are counted.
BINS = 1000

# Base patterns (fixed by the contract); possessive repeats and the look-behind only save retries.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Generators of further candidates.
_AT_DOT = re.compile(r"(?<![\w.%+-])[\w.%+-]++ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)*+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){2,}")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?=[0-9A-Fa-f]*+:[0-9A-Fa-f]*+:)(?:[0-9A-Fa-f]++|:(?=[0-9A-Fa-f:])|(?<=:)(?<!::):)++(?:(?<=[0-9])(?:\.[0-9]++){3})?+(?![0-9A-Za-z])")
_PHONE_LIKE = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9](?:[ ().-]*+[0-9])*+")
_LAST_GROUP = re.compile(r"[ ().-]+[0-9]+\Z")
_ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b ?[=:] ?[\"']?([^\s\"']{6,}+)")
_LONG = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{16,}+(?![A-Za-z0-9_])")
_KNOWN_SECRET = re.compile(r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_]{35})\Z")
_CUES = {
    "email": {"mail", "e-mail", "email", "contact", "write", "reach"},
    "ip": {"ip", "host", "server", "address", "from", "addr"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "pay", "payment"},
    "phone": {"phone", "tel", "telephone", "call", "fax", "mobile", "cell"},
    "secret": {"password", "passwd", "pwd", "token", "secret", "key", "apikey"},
}
_LAST_WORD = re.compile(r"([A-Za-z][\w-]*)\W*\Z")
_SENSITIVE = re.compile(r"[0-9@=:]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the order of kinds, then of starts."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            found.append((0, start, last))
        at = text.find("@", max(at + 1, last))
    if not _SENSITIVE.search(text):
        return found
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def candidates(text: str) -> list[tuple[int, int, int, int | None]]:
    """(kind, start, end, weak label) of further candidates; the label is 0, 1 or None."""
    found: list[tuple[int, int, int, int | None]] = []
    if "@" in text or "(at)" in text or "[at]" in text:
        for m in _AT_DOT.finditer(text):
            plain = "@" in m[0] and " " not in m[0]
            found.append((0, m.start(), m.end(), (1 if _DOMAIN.fullmatch(m[0].partition("@")[2]) else 0) if plain else None))
    if _SENSITIVE.search(text):
        for m in _DOTTED.finditer(text):
            found.append((1, m.start(), m.end(), int(m[0].count(".") == 3 and _octets(m[0]))))
        if ":" in text:
            found += [(1, m.start(), m.end(), None) for m in _IPV6.finditer(text)]
            found += [(1, m.start(), m.end(), 0) for m in re.finditer(r"(?<!\d)\d\d?:\d\d(?::\d\d)?(?!\d)", text)]
        for m in _CARD.finditer(text):
            n = len(digits := _digits(m[0]))
            if 12 <= n <= 19:
                found.append((2, m.start(), m.end(), None if n < 16 and luhn(digits) else int(luhn(digits))))
        for m in _PHONE_LIKE.finditer(text):
            run = m[0]
            if text[m.end() : m.end() + 1].isalnum():
                # the last group of digits belongs to a word
                run = run[: last.start()] if (last := _LAST_GROUP.search(run)) else ""
            n = len(_digits(run))
            if 7 <= n <= 15:
                found.append((3, m.start(), m.start() + len(run), 0 if n == len(run) or run.count(".") == 3 else None))
        if "+" in text:
            for m in _PHONE.finditer(text):
                found.append((3, m.start(), m.end(), int(8 <= len(_digits(m[0])) <= 15)))
        if "=" in text or ":" in text:
            found += [(4, m.start(1), m.end(1), 1) for m in _ASSIGNED.finditer(text)]
    for m in _LONG.finditer(text):
        mixed = any("0" <= c <= "9" for c in m[0]) and not m[0].isdigit()
        found.append((4, m.start(), m.end(), 1 if _KNOWN_SECRET.match(m[0]) else (None if mixed else 0)))
    return found


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of the span and of its surroundings; validity rules themselves are left out."""
    span = text[start:end]
    n = len(span)
    counts = Counter(span)
    digits = sum(counts[c] for c in "0123456789")
    upper = sum(v for c, v in counts.items() if "A" <= c <= "Z")
    lower = sum(v for c, v in counts.items() if "a" <= c <= "z")
    entropy = -sum(v / n * np.log2(v / n) for v in counts.values())
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False))
    left, right = text[max(0, start - 1) : start], text[end : end + 1]
    before = text[max(0, start - 40) : start]
    cue = m[1].lower() if (m := _LAST_WORD.search(before[-24:])) else ""
    nearby = before[-20:] + text[end : end + 20]
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        n, digits, upper, lower, n - digits - upper - lower, len(counts), entropy, changes / n, digits / n,
        counts["@"], counts["."], counts["-"], counts[" "], counts["("], counts[":"], counts["_"], counts["+"],
        float(span[0].isdigit()), float(span[-1].isdigit()), float(left in ("", " ", "\n")), float(left.isalnum()), float(left in "\"'=" and left != ""),
        float(right in ("", " ", "\n")), float(right.isalnum()), float(right in "\"'" and right != ""),
        *(float(cue in words) for words in _CUES.values()), float("=" in before[-4:]),
        sum(c.isdigit() for c in nearby) / (len(nearby) + 1),
    ]


class _Covered:
    """Disjoint intervals by start; answers whether a span touches one in O(log n)."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends = [], []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touches(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start

    def add(self, start: int, end: int) -> None:
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


@dataclass
class Model:
    trees: Boosted
    thresholds: np.ndarray

    def accepted(self, rows: list[list[float]], kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        p = self.trees.probability(np.array(rows))
        return p, p >= self.thresholds[kinds]


def chosen(seen: np.ndarray) -> np.ndarray:
    """Threshold of each kind from counts [kind, label, bin] of labelled candidates by score, in ``BINS`` equal bins."""
    thresholds = np.full(len(KINDS), FIXED)
    for kind in range(len(KINDS)):
        if min(seen[kind].sum(), 2 * seen[kind, 1].sum()) < LEAST_SEEN:
            continue
        above = np.cumsum(seen[kind, :, ::-1], axis=1)[:, ::-1]  # candidates in a bin or a higher one
        right = above[1] / np.maximum(above.sum(axis=0), 1)
        good = np.flatnonzero((right >= PRECISION) & (above.sum(axis=0) > 0) & (np.arange(BINS) >= BINS // 2))
        thresholds[kind] = good[0] / BINS if len(good) else np.inf
    return thresholds


def labelled(texts: list[str | None]) -> Iterator[tuple[int, int, int, int, list[float]]]:
    """(index of the text, kind, label, start, features) of the candidates that have a weak label."""
    for i, text in enumerate(texts):
        for kind, start, end, label in candidates(text or ""):
            if label is not None:
                yield i, kind, label, start, features(text, kind, start, end)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Trees from three quarters of the sampled documents, thresholds from all other documents."""
    arrow_settings(docs.sparkSession)
    share = min(1.0, SAMPLE_DOCS / max(docs.count(), 1))
    learns = drawn(share, id_col) & (F.pmod(F.xxhash64(id_col, F.lit("unseen")), F.lit(4)) != 3)
    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), learns.alias("learns"))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, own = batch.column("doc_id").to_pylist(), list(labelled(batch.column("text").to_pylist()))
            columns = [pa.array([doc_ids[c[0]] for c in own], pa.int64()), *(pa.array([c[k] for c in own], pa.int32()) for k in (1, 2)), pa.array([c[3] for c in own], pa.int64()), pa.array([c[4] for c in own], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kind", "label", "start", "row"])

    proposed = marked.where("learns").drop("learns").mapInArrow(propose, "doc_id long, kind int, label int, start long, row array<double>")
    sample = proposed.orderBy(F.xxhash64("doc_id", "kind", "start"), "doc_id", "kind", "start", "label").limit(SAMPLE_CANDIDATES).toPandas()
    if sample["label"].nunique() < 2:
        return None
    trees = Boosted.fit(np.stack(sample["row"]), sample["label"].to_numpy(dtype=float))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(KINDS), 2, BINS), dtype=np.int64)
        for batch in batches:
            own = list(labelled(batch.column("text").to_pylist()))
            if own:
                p = trees.probability(np.array([c[4] for c in own]))
                np.add.at(seen, ([c[1] for c in own], [c[2] for c in own], np.minimum((p * BINS).astype(int), BINS - 1)), 1)
        at = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([*(pa.array(a, pa.int32()) for a in at), pa.array(seen[at], pa.int64())], ["kind", "label", "bin", "n"])

    counts = marked.where("NOT learns").select("text").mapInArrow(rate, "kind int, label int, bin int, n long").groupBy("kind", "label", "bin").agg(F.sum("n").alias("n"))
    seen = np.zeros((len(KINDS), 2, BINS), dtype=np.int64)
    for r in counts.collect():
        seen[r["kind"], r["label"], r["bin"]] = r["n"]
    return Model(trees, chosen(seen))


def find(texts: list[str | None], model: Model | None) -> list[tuple[list, list]]:
    """Base spans and all spans, (kind, start, end), of each text."""
    bases, owners, proposals, rows = [], [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text) if text else []
        bases.append(base)
        if model is None or not text:
            continue
        taken = _Covered(base)
        for kind, start, end, _ in dict.fromkeys(candidates(text)):
            if not taken.touches(start, end):
                owners.append(i)
                proposals.append((kind, start, end))
                rows.append(features(text, kind, start, end))
    spans = [list(b) for b in bases]
    if rows:
        p, ok = model.accepted(rows, [k for k, _, _ in proposals])
        owner = -1
        for k in sorted(np.flatnonzero(ok).tolist(), key=lambda k: (owners[k], -p[k], proposals[k])):
            if owners[k] != owner:
                owner, taken = owners[k], _Covered([])
            kind, start, end = proposals[k]
            if not taken.touches(start, end):
                taken.add(start, end)
                spans[owner].append((kind, start, end))
        spans = [sorted(own) for own in spans]
    return list(zip(bases, spans, strict=True))


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def detections(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, number of base spans per kind, hash of the base spans, and all spans as kind:start:end."""
    arrow_settings(docs.sparkSession)

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find(batch.column("text").to_pylist(), model)
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in range(len(BASE_KINDS))]
            hashes = pa.array([hashlib.sha256(_named(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, hashes, pa.array([_named(s) for _, s in found], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(detect, schema)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Replaces each span, overlapping ones together, by the name of its first kind."""
    out, last, until = [], 0, 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= until:
            out += [text[last:start], f"<{KINDS[kind].upper()}>"]
        last = until = max(until, end)
    return "".join(out) + text[last:]


def redacted(docs: DataFrame, model: Model | None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced, and ``length_col``, if there, recomputed where text changed."""
    arrow_settings(docs.sparkSession)
    length = length_col if length_col in docs.columns else None
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = batch.column(text_col).to_pylist()
            new = [redact(t, spans) if spans else t for t, (_, spans) in zip(texts, find(texts, model), strict=True)]
            columns[names.index(text_col)] = pa.array(new, pa.string())
            if length:
                at = names.index(length)
                sizes = [len(n) if n != t else s for n, t, s in zip(new, texts, columns[at].to_pylist(), strict=True)]
                columns[at] = pa.array(sizes, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(clean, T.StructType(list(docs.schema.fields)))
