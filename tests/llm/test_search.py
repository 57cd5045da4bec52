"""Near duplicates and decontamination against brute force."""

import random

import pytest
from brute import awkward, frame, prose, shingle_set

from haloflux.llm import decontam, neardup


def components(rows, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            sets.setdefault(doc_id, []).append(shingle_set(text))
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            linked = any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])
            if a < b and linked and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def variants(seed, n, copies, every):
    base = prose(seed, n).split()
    rng = random.Random(seed)
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(every):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_components_match_brute_force(spark, percent):
    texts = variants(11, 200, 25, 2) + variants(12, 300, 25, 4) + variants(13, 80, 10, 1) + [prose(k, 90) for k in range(20, 50)] + [prose(20, 90)] * 40
    rows = [(100 + 3 * i, t) for i, t in enumerate(texts)] + awkward()
    random.Random(5).shuffle(rows)
    got = neardup.near_duplicates(frame(spark, rows), percent=percent).collect()
    assert len(got) == len(rows)
    want = components(rows, percent)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(len(shingle_set(r[1])))
    for r in got:
        assert r.n_shingles in texts[r.doc_id]
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id)


def test_chains_join_and_no_rows(spark):
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(12):  # each close to the next, the ends far apart
        base = base[8:] + [f"n{k}_{j}" for j in range(8)]
        rows.append((k, " ".join(base)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert set(got.values()) == {0}
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_contained_items_match_brute_force(spark):
    items = [(k, prose(60 + k, 12 + 5 * k)) for k in range(12)] + [(90, "just three words"), (91, None), (92, ""), (93, prose(61, 17))]
    docs = awkward()
    for k in range(40):
        body = prose(200 + k, 50 + 90 * (k % 7)).split()
        item = items[k % 12][1].split()
        if k % 3 == 0:
            body[len(body) // 2 : len(body) // 2] = item
        elif k % 3 == 1:
            body[10:10] = item[: len(item) * (7 + k % 3) // 9]
        docs.append((1000 + k, " ".join(body)))
    docs += [(2000, "just three words"), (2001, "and just three words more"), (2002, prose(5, 30000) + " " + items[3][1].upper() + " " + prose(6, 30000))]
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item_shingles, round(r.containment, 9)) for r in decontam.contaminated(frame(spark, docs), frame(spark, items), item_id_col="doc_id").collect()}
    want = {}
    for d, text, *_ in docs:
        own = shingle_set(text)
        for i, item in items:
            s = shingle_set(item)
            if d is not None and s and len(s & own) / len(s) >= 0.8:
                want[d, i] = (len(s & own), len(s), round(len(s & own) / len(s), 9))
    assert got == want and (2002, 3) in want and (2000, 90) in want
    assert decontam.contaminated(frame(spark, docs), frame(spark, []), item_id_col="doc_id").count() == 0
    assert decontam.contaminated(frame(spark, []), frame(spark, items), item_id_col="doc_id").count() == 0


def templated(n, own=26, shared=150):
    """Texts of one template with words of their own at its end: Jaccard similarity about 0.7."""
    template = prose(77, shared)
    return [template + " " + " ".join(f"t{k}w{m}" for m in range(own)) for k in range(n)]


@pytest.mark.parametrize("crowded", [2, 10])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, crowded):
    monkeypatch.setattr(neardup, "CROWDED", crowded)
    texts = templated(30) + variants(11, 200, 25, 2) + variants(14, 200, 25, 5) + [prose(20, 90)] * 20 + variants(15, 60, 20, 1)
    rows = [(7 * i, t) for i, t in enumerate(texts)] + awkward() + [(0, templated(40)[33]), (7, variants(11, 200, 25, 2)[3])]
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(frame(spark, rows)).collect() if r.doc_id is not None}
    assert got == set(components(rows, 85).items())


def test_texts_of_one_template_meet_in_linear_number(spark):
    from pyspark.sql import functions as F

    for n in (200, 400):
        docs = frame(spark, list(enumerate(templated(n)))).select("doc_id", "text")
        sets = neardup.sets_of(docs)
        sketches = neardup.signatures(docs)
        members = sets.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component"), "shingles")
        assert neardup.prefix_pairs(members, sketches, 85).count() == 0
        got = neardup.near_duplicates(docs).collect()
        assert len(got) == n and all(r.kept for r in got)
