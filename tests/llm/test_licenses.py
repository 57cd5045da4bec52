import math
import re
from collections import Counter

import pytest
from brute import awkward, frame, prose
from pyspark.sql import functions as F

from haloflux.llm import licenses, queries

FILES = [
    ("a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("a/b/x.py", prose(1, 50)),
    ("a/b/c/y.py", prose(2, 50) + "\nReleased under the MIT License.\n" + prose(3, 20)),
    ("a/d/COPYING", "This work is licensed under the GNU General Public License, version 3.\n" + prose(5, 90)),
    ("a/d/e/z.py", None),
    ("a/d/w.py", "# Licensed under the Apache License, Version 2.0."),
    ("f/g.py", prose(4, 60)),
    ("top.py", "the and of"),
    ("f/h.py", "Driving licence of the fox, version 3 under grey skies while seven wizards mix potions and this work goes on"),
]


def brute(files):
    n = len(files)
    df = Counter(w for _, t in files for w in set(re.findall(licenses._WORD, (t or "").lower())))
    vocabulary = {w for _, t in licenses.TEMPLATES for w in re.findall(licenses._WORD, t.lower())}

    def vector(text):
        return {w: c * (math.log((1 + n) / (1 + (df[w] if w in vocabulary else 0))) + 1) for w, c in Counter(re.findall(licenses._WORD, text.lower())).items()}

    def cosine(a, b):
        dot = sum(v * b.get(w, 0) for w, v in a.items())
        return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) if dot else 0.0

    templates = [(licence, vector(t)) for licence, t in licenses.TEMPLATES]
    own, whole_file = {}, set()
    for path, text in files:
        best, said = {}, 0
        for whole, passage in [(False, p) for p in (text or "").split("\n")] + [(True, text or "")]:
            v = vector(passage)
            found = {licence: max(cosine(v, t) for k, t in templates if k == licence) for licence, _ in templates}
            found = {k: c for k, c in found.items() if c >= licenses.STATES}
            for k, c in found.items():
                best[k] = max(best.get(k, 0), c)
            if found:
                if whole:
                    whole_file.add(path)
                else:
                    said += len(re.findall(licenses._WORD, passage.lower()))
        if best:
            own[path] = min((-c, k) for k, c in best.items())
            if said >= licenses.LICENSE_SHARE * len(re.findall(licenses._WORD, text.lower())):
                whole_file.add(path)
    held = {}
    for path, (c, licence) in own.items():
        directory, _, name = path.rpartition("/")
        if path in whole_file or re.match(licenses._FILE_NAME, name):
            held.setdefault(directory, []).append((not re.match(licenses._FILE_NAME, name), c, licence))
    out = {}
    for path, _ in files:
        up = path.rpartition("/")[0]
        if path in own:
            out[path] = (own[path][1], "stated", None)
            continue
        while up and up not in held:
            up = up.rpartition("/")[0]
        out[path] = (min(held[up])[2], "inherited", up) if up in held else (None, "none", None)
    return out, own


def test_scan_matches_brute_force(spark):
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(FILES, "path string, text string")).collect()}
    want, own = brute(FILES)
    assert {p: (r.licence, r.origin, r.inherited_from) for p, r in got.items()} == want
    for p, (c, *_rest) in own.items():
        assert got[p].cosine == pytest.approx(-c)
    assert want["a/b/x.py"] == ("MIT", "inherited", "a") and want["a/d/e/z.py"] == ("GPL-3.0", "inherited", "a/d") and want["f/h.py"][0] is None


def test_awkward_and_no_rows(spark):
    docs = frame(spark, awkward()).withColumn("path", F.when(F.col("doc_id") != 3, F.concat(F.lit("d/"), F.col("doc_id"))))
    got = licenses.scan(docs).collect()
    assert len(got) == len({r.path for r in got}) and all(r.origin == "none" for r in got)
    assert licenses.scan(frame(spark, []).withColumn("path", F.lit("x"))).count() == 0


GPL3_HEADER = """
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""
MIT_GRANT = """
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
"""


def test_wrapped_and_embedded_notices_and_whole_texts(spark):
    texts = dict(t for t in licenses.TEMPLATES if len(t[1]) > 500)
    agpl = GPL3_HEADER.replace("GNU General", "GNU Affero General")
    files = [
        ("w/gpl.py", "GPL-3.0", prose(1, 150) + GPL3_HEADER + prose(2, 150)),
        ("w/agpl.py", "AGPL-3.0", prose(3, 150) + agpl + prose(4, 150)),
        ("w/mit.c", "MIT", prose(5, 150) + MIT_GRANT + prose(6, 150)),
        ("w/inside.md", "GPL-3.0", prose(7, 60) + " This work is licensed under the GNU General Public License, version 3. " + prose(8, 60)),
        *((f"{name}/x/LICENSE", name, "Copyright 2020 fox\n\n" + text) for name, text in sorted(texts.items())),
        *((f"{name}/y.txt", name, prose(9, 400) + "\n" + texts[name] + "\n" + prose(2, 400)) for name in ("GPL-2.0", "BSD-2-Clause", "ISC")),
        ("none.txt", None, prose(4, 300)),
    ]
    files += [(f"many/{k}.txt", None, prose(k, 120)) for k in range(60)]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame([(p, t) for p, _, t in files], "path string, text string")).collect()}
    assert {p: got[p].licence for p, _, _ in files} == {p: licence for p, licence, _ in files}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "MIT", "BSD-2-Clause", "ISC", "CC0-1.0", "Unlicense"} <= set(texts)


def test_documents_without_an_id_are_answered(spark, tmp_path):
    rows = [(None, "Released under the MIT License.", "en"), (None, "something else", "en"), (None, None, None), (7, "plain", "de")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_licenses(spark, str(tmp_path)).collect()
    assert len(got) == 4 and sorted(str(r.doc_id) for r in got) == ["7", "None", "None", "None"]
    assert sum(r.origin == "stated" for r in got) <= 1
