import math
from collections import Counter, defaultdict

import pytest
from brute import awkward, frame, prose, words
from pyspark.sql import functions as F

from haloflux.llm import ppm


def brute_scores(train, texts):
    seen = defaultdict(Counter)
    for t in train:
        data = [254] * ppm.ORDER + list((t or "").encode()) + [255]
        for i in range(ppm.ORDER, len(data)):
            for k in range(ppm.ORDER + 1):
                seen[tuple(data[i - k : i])][data[i]] += 1

    def symbol(context, s):
        total, excluded = 0.0, set()
        for k in range(ppm.ORDER, -1, -1):
            counts = {x: n for x, n in seen.get(tuple(context[ppm.ORDER - k :]), {}).items() if x not in excluded}
            if not counts:
                continue
            size = sum(counts.values())
            if s in counts:
                return total + math.log10((counts[s] - 0.5) / size)
            total += math.log10(0.5 * len(counts) / size)
            excluded |= counts.keys()
        return total - math.log10(257 - len(excluded))

    out = []
    for t in texts:
        data = [254] * ppm.ORDER + list((t or "").encode()) + [255]
        out.append(sum(symbol(data[i - ppm.ORDER : i], data[i]) for i in range(ppm.ORDER, len(data))))
    return out, symbol


def test_probabilities_sum_to_one():
    _, symbol = brute_scores(["abracadabra", "abrakadabra cadabra"], [])
    for context in ([254] * 5, list(b"dabra"), list(b"xxxxa"), list(b"zzzzz")):
        assert sum(10 ** symbol(context, s) for s in range(257)) == pytest.approx(1)


@pytest.mark.parametrize("blocks", [1 << 30, 400])
def test_scores_match_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", blocks)
    rows = [(k, prose(k, 3 + 4 * k)) for k in range(25)] + [(30, "étrange ÀÉ"), (31, "zq#@!\x01\x02"), (32, None), (33, ""), (34, prose(3, 15)), (34, prose(3, 15)), (None, "no id")]
    learns = F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False))
    got = ppm.scored(frame(spark, rows), learns).collect()
    train = [t for i, t in rows if i is not None and i % 3 != 1]
    vocabulary = Counter(w for t in train for w in [*words(t), None])
    n = sum(vocabulary.values())
    want, _ = brute_scores(train, [t for _, t in rows])
    assert len(got) == len(rows)
    shown = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    plain = []
    for (i, t), score in zip(rows, want, strict=True):
        own = [*words(t), None]
        base = sum(math.log10((vocabulary[w] + 0.5) / (n + 0.5 * (len(vocabulary) + 1))) for w in own)
        plain.append((str(i), len(own), sum(w in vocabulary for w in own), n, base, score))
    for a, b in zip(shown, sorted(plain), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-5)


def test_awkward_rows_nothing_to_learn_from_and_no_rows(spark):
    got = ppm.scored(frame(spark, awkward()), F.lit(True)).collect()
    assert len(got) == len(awkward()) and all(r.score < 0 for r in got)
    got = ppm.scored(frame(spark, [(1, "ab"), (2, None)]), F.lit(False)).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx({1: -3 * math.log10(257), 2: -math.log10(257)})
    assert ppm.scored(frame(spark, []), F.lit(True)).count() == 0
