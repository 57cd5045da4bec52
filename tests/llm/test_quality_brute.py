"""The registered quality query against a plain co-training loop over the same rows."""

import math
import re
import zlib

import numpy as np

from haloflux.llm import quality, queries

SF_DIR = "/root/testdata/sf0.001"
SPACE = b" \t\n\x0b\x0c\r"


def kind(b):
    if b >= 128:
        return 8
    c = chr(b)
    if c == "\n":
        return 4
    if b in SPACE:
        return 3
    if c == "!":
        return 7
    if c in ".,;:?'\"()-":
        return 5
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 6


def text_view(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n, size = len(words), len(data)
    mean = lambda values: sum(values) / max(n, 1)
    counts = [sum(kind(b) == k for b in data) for k in range(9)]
    lengths = [len(w) for w in words]
    first, last = [kind(w[0]) for w in words], [kind(w[-1]) for w in words]
    again = mean([float(a == b) for a, b in zip(words, words[1:])])
    spread = max(mean([x * x for x in lengths]) - mean(lengths) ** 2, 0)
    return [
        math.log1p(size), math.log1p(n), math.log1p(counts[4]), *[c / max(size, 1) for c in counts],
        mean(lengths), math.sqrt(spread), mean([k == 6 for k in last]), mean([k == 6 and x == 1 for k, x in zip(first, lengths)]),
        mean([k == 7 for k in last]), mean([k == 5 for k in last]), mean([a == 1 and b != 0 for a, b in zip(first, last)]),
        mean([a == 1 and b == 0 for a, b in zip(first, last)]), mean([x <= 3 for x in lengths]), mean([x >= 12 for x in lengths]),
        math.log1p(size / (counts[4] + 1)), again, math.sqrt(again), math.log((len(set(words)) + 1) / (n + 1)),
    ]


def page_view(source, lang, chars):
    row = [0.0] * (quality.SOURCE_BUCKETS + quality.LANG_BUCKETS + 2)
    row[zlib.crc32(repr(source).encode()) % quality.SOURCE_BUCKETS] = 1.0
    row[quality.SOURCE_BUCKETS + zlib.crc32(repr(lang).encode()) % quality.LANG_BUCKETS] = 1.0
    row[-2:] = (0.0, 1.0) if chars is None else (math.log1p(max(chars, 0)), 0.0)
    return row


class Plain:
    """Ridge logistic regression by Newton steps, each halved until the loss falls."""

    def __init__(self, rows, labels):
        x, y = np.array(rows, dtype=float), np.array(labels, dtype=float)
        self.mean, self.scale = x.mean(axis=0), np.where(x.std(axis=0) < 1e-9, 1.0, x.std(axis=0))
        z = np.column_stack(((x - self.mean) / self.scale, np.ones(len(x))))
        penalty = np.array([1.0] * x.shape[1] + [1e-6])
        loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (z @ w)).sum() + 0.5 * (penalty * w * w).sum()
        w = np.zeros(z.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-z @ w))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            size = 1.0
            while loss(w + size * step) > loss(w) and size > 1e-9:
                size /= 2
            w = w + size * step
            if abs(step).max() < 1e-9:
                break
        self.w = w

    def logit(self, row):
        return float(np.clip(((np.array(row) - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30))


def co_trained(rows):
    """Score of any (text view, page view) from rows (id, views, label or None)."""
    rows = sorted(rows, key=lambda r: r[0])
    known = [r for r in rows if r[2] is not None]
    held = [r for c in (0, 1) for r in [k for k in known if k[2] == c][::5]]
    start = [r for r in known if r not in held]
    pool = [r for r in rows if r[2] is None]
    share = sum(r[2] for r in start) / len(start)
    taught = [[(r[1][v], r[2]) for r in start] for v in range(2)]
    free = [set(r[0] for r in pool) for _ in range(2)]
    for _ in range(quality.ROUNDS):
        models = [Plain(*zip(*t, strict=True)) for t in taught]
        for teacher, pupil in ((0, 1), (1, 0)):
            sure = {r[0]: 1 / (1 + math.exp(-models[teacher].logit(r[1][teacher]))) for r in pool}
            for label, part in ((1, share), (0, 1 - share)):
                p = lambda r, label=label, sure=sure: sure[r[0]] if label else 1 - sure[r[0]]
                able = sorted((r for r in pool if r[0] in free[pupil] and p(r) >= quality.CONFIDENT), key=lambda r: -p(r))
                for r in able[: int(quality.TAUGHT * part * len(pool))]:
                    free[pupil].discard(r[0])
                    taught[pupil].append((r[1][pupil], label))
    models = [Plain(*zip(*t, strict=True)) for t in taught]
    both = Plain([[models[v].logit(r[1][v]) for v in range(2)] for r in held], [r[2] for r in held])
    return lambda views: 1 / (1 + math.exp(-both.logit([models[v].logit(views[v]) for v in range(2)])))


def test_query_equals_a_plain_co_training_loop(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    labels = {}
    for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect():
        if r.quality is not None:
            labels[r.doc_id] = min(r.quality, labels.get(r.doc_id, 1))
    views = {r.doc_id: (text_view(r.text), page_view(r.source, r.lang, None if r.n_chars is None else float(r.n_chars))) for r in docs}
    seen = [(i, v, labels.get(i)) for i, v in views.items() if zlib.crc32(str(i).encode()) % 5 != 0]
    score = co_trained(seen)
    got = {r.doc_id: r for r in queries.op10_quality(spark, SF_DIR).collect()}
    assert set(got) == set(views)
    for i, v in views.items():
        assert abs(got[i].score - score(v)) < 1e-4
        assert got[i].predicted == (got[i].score >= quality.KEEP)
