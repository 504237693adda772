from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from assayer.llm import langid
from tests.llm import corpus


def test_mixture_reaches_the_maximum():
    rng = np.random.default_rng(0)
    for _ in range(20):
        probs = rng.dirichlet(np.ones(50), 3)
        counts = rng.integers(0, 9, 50).astype(float)
        shares, likelihood = langid.fit_mixture(probs, counts, 5000, 1e-4)
        grid = [
            counts @ np.log(np.array([a, b, 1 - a - b]) @ probs)
            for a in np.linspace(0, 1, 41)
            for b in np.linspace(0, 1 - a, 41)
        ]
        assert abs(shares.sum() - 1) < 1e-9
        assert likelihood >= max(grid) - 1e-3


def test_set_of_languages():
    rng = np.random.default_rng(1)
    probs = rng.dirichlet(np.full(langid.CELLS, 0.01), 4) + 1e-9
    probs /= probs.sum(axis=1, keepdims=True)
    draw = lambda lang, n: rng.choice(langid.CELLS, n, p=probs[lang])
    best, score, shares = langid.select_languages(np.log(probs), probs, draw(2, 400))
    assert best == 2 and score == 1.0
    cells = np.concatenate((draw(0, 600), draw(3, 300)))
    best, score, shares = langid.select_languages(np.log(probs), probs, cells)
    assert best == 0 and set(np.flatnonzero(shares)) == {0, 3} and abs(shares[0] - 2 / 3) < 0.05


def test_held_out_accuracy(spark):
    docs = corpus.documents(spark, "/root/testdata/sf0.1")
    found = langid.identify(docs, keep=["doc_id", "lang", "text"])
    rows = found.where("held_out").select(
        F.length("row.text").alias("n"), (F.col("row.lang") == F.col("lang_pred")).alias("right"), "score"
    ).collect()
    assert len(rows) > 3000
    assert np.mean([r["right"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_folds_and_edges(spark):
    data = corpus.rows()
    found = langid.identify(corpus.frame(spark, data)).select("row.doc_id", "row.text", "held_out", "lang_pred", "score")
    for r in found.collect():
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert r["held_out"] == held
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert letters or r["score"] == 0


def test_nothing_to_learn(spark):
    found = langid.identify(corpus.frame(spark, [(5, "some text", None, "a")])).collect()
    assert [r["lang_pred"] for r in found] == ["und"]
    assert langid.identify(corpus.frame(spark, [])).count() == 0


def test_sample_is_bounded(spark):
    docs = corpus.documents(spark)
    sample = langid.training_sample(docs, "doc_id", "text", "lang", 20)
    assert {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()} == dict.fromkeys(["de", "en", "es", "fr"], 20)
