"""Where the quality model is fitted, and from which rows."""

import os

import numpy as np

from haloflux.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n):
    texts = ["Some plain sentence of words, number %03d.", "click $$ here || %03d || now !!"]
    return [(k, texts[k % 2] % k * (1 + k % 3), ("en", "de")[k % 2], "web", None if k % 7 == 0 else 10 * k) for k in range(n)]


def labels(spark, n):
    return spark.createDataFrame([(k, 1 - k % 2) for k in range(0, n, 3)], "doc_id long, quality int")


def test_the_sample_stays_off_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame(rows(300), DOCS).repartition(4)
    monkeypatch.setattr(quality, "co_train", lambda views, known: (os.getpid(), [v.shape for v in views], known.shape))
    frame, sent = type(docs), []
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(frame, name, lambda self, f=getattr(frame, name): sent.append(out := f(self)) or out)
    pid, shapes, known = quality.fit(docs, labels(spark, 300), held_out_fold=None)
    assert pid != os.getpid()
    assert [s[0] for s in shapes] == [300, 300] and known == (300,)
    assert all(len(out) <= 1 for out in sent)


def test_the_model_is_that_of_the_rows_in_order_of_ids(spark):
    given = rows(300) + [(5, "another text with the id of an earlier row", "en", None, 3)] + [(None, "no id", "en", "web", 5)]
    docs = spark.createDataFrame(given, DOCS).repartition(5)
    placed = [tuple(r) for r in docs.collect()]
    model = quality.fit(docs, labels(spark, 300), held_out_fold=None)
    used = sorted((r for r in placed if r[0] is not None), key=lambda r: r[0])
    texts = quality.text_features(quality.pa.array([r[1] for r in used], quality.pa.string()))
    pages = quality.metadata_features([r[3] for r in used], [r[2] for r in used], [r[4] for r in used])
    known = np.array([1.0 - r[0] % 2 if r[0] % 3 == 0 else np.nan for r in used])
    expected = quality.co_train((texts, pages), known)
    for view in ("text", "metadata", "combined"):
        assert np.allclose(getattr(model, view).weights, getattr(expected, view).weights, rtol=1e-9, atol=1e-9)
