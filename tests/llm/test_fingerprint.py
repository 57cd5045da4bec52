import hashlib

import pytest
from brute import awkward, frame, prose, shingle_set
from pyspark.sql import functions as F

from haloflux.llm import fingerprint as fp
from haloflux.llm import queries


def brute_sketch(text):
    import xxhash

    hashes = set()
    for s in shingle_set(text.lower() if text else text):
        h = 42
        for w in s:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        hashes.add(h - (1 << 64) if h >> 63 else h)
    kept = sorted(h for h in hashes if h <= fp.threshold())
    if len(kept) >= fp.FLOOR:
        return fp.threshold(), kept
    least = sorted(hashes)[: fp.FLOOR]
    return ((1 << 63) - 1 if len(least) < fp.FLOOR else max(least[-1], fp.threshold())), least


def brute_likeness(a, b):
    bound = min(a[0], b[0])
    x, y = ({h for h in s[1] if h <= bound} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_pairs_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 4)
    rows = [(i * i - 40, prose(i, 3 + 23 * (i % 9))) for i in range(60)] + [(10**12, None), (-(10**12), "")] + [(5000 + i, t) for i, (_, t, *_) in enumerate(awkward())]
    got = {r.doc_id: r for r in queries.fingerprints(frame(spark, rows)).collect()}
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, changed, following = brute_sketch(t), brute_sketch(edited), brute_sketch(after)
        assert r.fingerprint == f"{own[0] & (2**64 - 1):016x}:" + "".join(f"{h & (2**64 - 1):016x}" for h in own[1])
        assert r.near_edited == pytest.approx(brute_likeness(own, changed)) and r.near_next == pytest.approx(brute_likeness(own, following))


def test_ties_nulls_single_and_no_rows(spark):
    assert queries.fingerprints(frame(spark, awkward())).where("doc_id = 5").count() == 3
    one = queries.fingerprints(frame(spark, [(3, prose(1, 30))])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert queries.fingerprints(frame(spark, [])).count() == 0 
    rows = {r.n_chars: r for r in queries.fingerprints(frame(spark, [(None, "x"), (None, None), (3, "one two")])).collect()}
    assert len(rows) == 3 and all(rows[n].doc_id is None and rows[n].fingerprint and rows[n].edited_sha256 is None and rows[n].near_next is None for n in (0, 1))


def test_containment_of_a_part_and_union(spark):
    whole = prose(8, 6000)
    part = " ".join(whole.split()[1000:1600])
    df = spark.createDataFrame([("k", whole, part), ("k", part, prose(9, 50)), ("j", None, "")], "key string, a string, b string")
    df = fp.with_sketch(fp.with_sketch(df, "a", "sa"), "b", "sb")
    rows = df.select(fp.containment(F.col("sb"), F.col("sa")).alias("c"), fp.likeness(F.col("sa"), F.col("sb")).alias("l")).collect()
    assert rows[0].c == 1.0 and rows[0].l < 0.7 and rows[2].c == 1.0 and rows[2].l == 1.0
    union = {r.key: r.sa for r in fp.merged(df, ["key"], "sa").collect()}
    sketches = {r.a: r.sa for r in df.collect()}
    bound = union["k"].bound
    assert set(union["k"].hashes) == {h for t in (whole, part) for h in sketches[t].hashes if h <= bound} and union["j"].hashes == []
