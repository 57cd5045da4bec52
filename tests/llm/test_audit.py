"""Filter interactions against application of the filters one by one."""

import re
from itertools import permutations

from brute import awkward, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from haloflux.llm import audit

LABELS = "doc_id long, quality int, toxic int, mask string"


def failed(docs):
    """The set of failed filters of each row (doc_id, text, lang)."""
    texts = [t or "" for _, t, _ in docs]
    for (i, _, _), t in zip(docs, texts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(o[0] is not None and o[0] < i and s == t for o, s in zip(docs, texts, strict=True)),
        }
        yield {k for k, bad in tests.items() if bad}


def brute(docs, labels):
    sets = list(failed(docs))
    good = {i for i, q, _, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    rows = {}
    for part in {p or "" for *_, p in docs}:
        own = [(i, s) for (i, _, p), s in zip(docs, sets, strict=True) if (p or "") == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                fails = sum(f in s for _, s in own)
                shares[f] += len(gone)
                rows[part, order, k + 1] = [len(left), len(gone), fails - len(gone), sum(s == {f} for _, s in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(shares[order[step - 1]])
    return rows


def got(spark, rows, labels):
    found = audit.interactions(audit.failure_counts(frame(spark, rows), spark.createDataFrame(labels, LABELS))).collect()
    assert len({tuple(r)[:3] for r in found}) == len(found)
    return {tuple(r)[:3]: list(r)[3:] for r in found}


def test_equal_to_the_filters_one_by_one(spark):
    rows = awkward() + [(60 + k, prose(k % 7, 90 + 5 * k), "de" if k % 3 else "en", "s", 1) for k in range(30)]
    rows += [(200 + k, f"COSTS ARE {k % 3} $ " * (k % 4) + prose(9, 110), "", "s", 1) for k in range(12)]
    rows += [(-5, prose(1, 40), "fr", "s", 1)] * 2
    labels = [(k, k % 2, k % 3 == 0, "x") for k in range(0, 260)] + [(62, 1, None, "x"), (62, 0, 1, "x"), (None, 1, 1, "x")]
    labels = [(i, q, None if t is None else int(t), m) for i, q, t, m in labels]
    full = [(r[0], r[1], r[2]) for r in rows]
    assert got(spark, rows, labels) == brute(full, labels)


def test_no_rows_and_no_labels(spark):
    assert got(spark, [], []) == {}
    assert got(spark, [(1, None)], []) == brute([(1, None, None)], [])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.tuples(*[st.integers(0, 3)] * 3)))
def test_swapped_diagrams_equal_diagrams_built_in_that_order(counts):
    orders = audit.all_orders("ABCDE", counts)
    assert len(orders) == 120
    for order, steps in orders.items():
        place = {letter: k for k, letter in enumerate(order)}
        moved = {sum(1 << place["ABCDE"[k]] for k in range(5) if m >> k & 1): w for m, w in counts.items()}
        fresh = audit.Diagram(order, moved)
        assert fresh.steps() == steps


def test_equal_nodes_are_shared():
    diagram = audit.Diagram("ABCDE", {m: (1, 0, 0) for m in range(32)})
    assert [len(level) for level in diagram.levels] == [1] * 5
    diagram.swap(2)
    assert [len(level) for level in diagram.levels] == [1] * 5 and diagram.weights[diagram.root] == (32, 0, 0)
