"""Each stage of the pipeline against the brute-force version on its own input."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline as pipeline
from tests.llm import corpus, test_decontamination, test_line_dedup, test_simhash
from tests.llm.test_bpe import ENC


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What every stage returned, the documents first."""
    out = [corpus.documents(spark)]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name.split()[0]))
        stage(spark, out[-1], corpus.SF_DIR).write.mode("overwrite").parquet(path)
        out.append(spark.read.parquet(path))
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_languages_keeps_documents_with_words(steps):
    before, after = dict(pairs(steps[0])), dict(pairs(steps[1]))
    assert set(after.items()) <= set(before.items())
    gone = [t for i, t in before.items() if i not in after]
    assert not [t for t in gone if sum(c.isalpha() for c in t) > 100] and len(gone) < len(before) / 50


def test_lines(steps):
    found = [tuple(r) for r in steps[2].select("doc_id", "text", "n_chars").collect()]
    expected = [(i, t, len(t)) for i, t, *_ in test_line_dedup.brute(pairs(steps[1]))]
    assert corpus.bag(found) == corpus.bag(expected)


def test_near_copies(steps):
    least = {c for _, _, c in test_simhash.brute(pairs(steps[2]))}
    assert corpus.bag(pairs(steps[3])) == corpus.bag(p for p in pairs(steps[2]) if p[0] in least)


def test_benchmark(spark, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{corpus.SF_DIR}/benchmark.parquet").collect()]
    before = pairs(steps[3])
    clean = {i for i, _, hits, _ in test_decontamination.brute(before, items) if not hits}
    assert corpus.bag(pairs(steps[4])) == corpus.bag(p for p in before if p[0] in clean)


def test_tokens(steps):
    expected = []
    for i, t in pairs(steps[4]):
        ids = ENC.encode_ordinary(t)
        listed = " ".join(map(str, ids)).encode()
        expected.append((i, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert corpus.bag(steps[5].collect()) == corpus.bag(expected)


def test_run_gives_the_last_stage(spark, steps):
    assert corpus.bag(pipeline.run(spark, corpus.SF_DIR).collect()) == corpus.bag(steps[-1].collect())
