"""Plain Python versions of the shared definitions, and rows that every operator has to cope with."""

import re

from pyspark.sql import types as T

#: Columns named like those that operators use inside.
CLASHING = ["score", "label", "block", "share", "sketch", "component", "_label", "_bucket", "_shard", "_own"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix potions under grey skies".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * (seed % 5 + 1) + i // 3) % len(WORDS)] + (str((seed + i) % 7) if i % 4 == 0 else "") for i in range(n))


def awkward() -> list[tuple]:
    """Nulls, empty and blank texts, a long one, one long word, ties, repeated rows and ids."""
    texts = [None, "", " \n\t ", "one", "Two words", prose(1, 40), prose(1, 40), prose(2, 60000), "x" * 200_000, "été ÀÉ 漢字 😀 mail a.b@c.de", prose(3, 41)]
    rows = [(i, t, ["en", None][i % 2], "src0", None if i % 3 else len(t or "")) for i, t in enumerate(texts)]
    rows += [(5, prose(1, 40), "en", None, 3), (5, prose(1, 40), "en", None, 3), (None, prose(4, 30), "en", "src1", 1), (None, None, None, None, None)]
    return [r + ("1",) * len(CLASHING) for r in rows]


def frame(spark, rows):
    """Documents from (doc_id, text) or full rows, with clashing extra columns."""
    full = [r if len(r) == len(SCHEMA) else (r[0], r[1], *(tuple(r[2:5]) + (None,) * (5 - len(r)))) + ("1",) * len(CLASHING) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, size=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
