"""Conversation repair against an exhaustive search over edits."""

import hashlib
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from haloflux.llm import queries, repair

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, gone string, same string, nth string, fault string, copy string"
SOUND_ROLES = re.compile("(s?(ua)+)?")


def damage(rows):
    """Damaged rows by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def fault(rows, k):
    _, role, text = rows[k]
    seen = re.findall(r"[^\x20\x09-\x0D]", text)
    if not seen:
        return "blank"
    if any(r[1:] == (role, text) for r in rows[:k]):
        return "duplicate"
    return "truncated" if seen[-1] not in ".!?" else ""


def cheapest(rows):
    """Best (cost, audit, repaired) over all edit sequences, by trying each edit of each row and up to two inserts before it."""
    faults = [fault(rows, k) for k in range(len(rows))]
    best = {"": (0, "", ())}

    def viable(initials):
        return any(SOUND_ROLES.fullmatch(initials + more) for more in ("", "a", "ua"))

    # prefixes with equal last role and emptiness go on alike: keep the best of each
    def merged(ways):
        found = {}
        for initials, way in ways:
            key = initials[-1:]
            if viable(initials) and (key not in found or way[:2] < found[key][1][:2]):
                found[key] = (initials if len(initials) < 3 else ("ua" if key == "a" else "uau"), way)
        return dict(found.values())

    def inserted(ways):
        out = list(ways.items())
        for _ in range(2):
            out += [(i + r, (c + 2, a + "I", t + ((name, ""),))) for i, (c, a, t) in out for r, name in (("u", "user"), ("a", "assistant")) if viable(i + r)]
        return merged(out)

    for k, (_, role, text) in enumerate(rows):
        ways = []
        late = 1 if faults[k] == "truncated" else 0
        for initials, (c, a, t) in inserted(best).items():
            ways.append((initials, (c + 3, a + "D", t)))
            if faults[k] in ("", "truncated"):
                if role:
                    ways.append((initials + role[0], (c + late, a + "K", t + ((role, text),))))
                for r, name in (("u", "user"), ("a", "assistant")):
                    ways.append((initials + r, (c + 2 + late, a + "R", t + ((name, text),))))
        best = merged(ways)
    return min((w for i, w in inserted(best).items() if SOUND_ROLES.fullmatch(i)), key=lambda w: w[:2])


def expected(rows):
    faults = [fault(rows, k) for k in range(len(rows))]
    turns = {t for t, *_ in rows if t is not None}
    pairs = [(a[1][:1], b[1][:1]) for a, b in zip(rows, rows[1:])]
    cost, audit, out = cheapest(rows)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit, digest)


def checked(spark, rows):
    full = [r + ("x",) * 5 for r in rows]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired(queries.damaged(spark.createDataFrame(full, SCHEMA))).collect()}
    want = {c: expected(r) for c, r in damage(rows).items()}
    assert got == want
    return got


def test_supplied_conversations(spark):
    checked(spark, [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()])


def test_awkward_conversations(spark):
    rows = [(1, None, None, None), (1, 3, "user", "Hi."), (1, 3, "user", "Hi."), (1, 9, "", "no role"), (None, 1, "user", "A."), (None, 2, "tool", "B!\n"), (None, None, "assistant", "C")]
    rows += [(2, t, "user", "Same.") for t in range(9)] + [(3, 5, "system", "x" * 300_000 + "."), (3, 6, "system", " "), (4, 1, "a", "é?"), (4, 2, "User", "?")]
    # conversations of which all rows are dropped
    lost = [c for c in range(10, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows += [(c, 0, "user", "Hi.") for c in lost] + [(-(2**60), 2**61, "assistant", "End."), (-(2**60), -5, "user", "End.")]
    got = checked(spark, rows)
    assert lost and got[lost[0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    kept = repair.repaired(spark.createDataFrame([r + ("x",) * 5 for r in rows], SCHEMA).drop("gone"), keep_turns=True).where("conv_id = 2").first()
    assert [t.role for t in kept.repaired] == ["user", "assistant"] and kept.audit == "K" + "D" * 8 + "I"
    assert repair.repaired(spark.createDataFrame([], SCHEMA).drop("gone")).count() == 0


def test_long_conversations_are_taken_in_segments(spark):
    kinds = ["user", "assistant", "system", "user", "user", "tool", "assistant"]
    rows = [(c, t, kinds[(t * t // (c + 3) + t % (c + 2)) % 7], f"{t % (200 + c)} ok{'.?! '[t % 4]}") for c in range(4) for t in range(1500 + 256 * c)]
    rows += [(9, t, "user", f"{t}.") for t in range(2000)]
    checked(spark, rows)


row = st.tuples(st.sampled_from(["user", "assistant", "system", "tool"]), st.sampled_from(["a.", "b!", "c", " ", "d?"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(row, max_size=9), st.integers(1, 4))
def test_segments_do_not_change_the_result(rows, size):
    rows = [(k, *r) for k, r in enumerate(rows)]
    kinds = ["", "blank", "duplicate", "truncated"]
    before, repair.SEGMENT = repair.SEGMENT, size
    try:
        one = repair.Repair(keep_turns=True)
        for k, (t, role, text) in enumerate(rows):
            one.row(t, role, text, kinds.index(fault(rows, k)))
        cost, audit, out = one.finish()
    finally:
        repair.SEGMENT = before
    want = cheapest(rows)
    assert (cost, audit, tuple((t["role"], t["text"]) for t in out.turns)) == want


def exhaustive(rows):
    """All edit sequences with at most two inserts in a row."""
    faults = [fault(rows, k) for k in range(len(rows))]

    def more(k, initials, inserts):
        if SOUND_ROLES.fullmatch(initials) and k == len(rows):
            yield 0, ""
        if inserts < 2:
            for r in "ua":
                yield from ((c + 2, "I" + a) for c, a in more(k, initials + r, inserts + 1))
        if k < len(rows):
            yield from ((c + 3, "D" + a) for c, a in more(k + 1, initials, 0))
            if faults[k] in ("", "truncated"):
                late = faults[k] == "truncated"
                yield from ((c + late, "K" + a) for c, a in more(k + 1, initials + rows[k][1][:1], 0))
                for r in "ua":
                    yield from ((c + 2 + late, "R" + a) for c, a in more(k + 1, initials + r, 0))

    return min(more(0, "", 0))


@settings(max_examples=40, deadline=None)
@given(st.lists(row, max_size=3))
def test_search_by_last_role_equals_all_sequences(rows):
    rows = [(k, *r) for k, r in enumerate(rows)]
    assert cheapest(rows)[:2] == exhaustive(rows)
