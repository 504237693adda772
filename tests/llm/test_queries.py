"""Registered queries: SQL twins, and what the others return over the given tables."""

from __future__ import annotations

import hashlib

import pytest

from assayer.llm import bpe, queries
from assayer.llm.oracles import ORACLES
from tests.agreement import SF_DIR, database, difference
from tests.llm import corpus, test_bpe, test_quality, test_sharding


@pytest.mark.parametrize("name", list(ORACLES))
def test_agreement(spark, name):
    assert difference(queries.QUERIES[name](spark, SF_DIR), database(SF_DIR), ORACLES[name]) is None


def test_bpe_query(spark):
    expected = []
    for i, t in corpus.texts(spark):
        ids = test_bpe.ENC.encode_ordinary(t)
        listed = " ".join(map(str, ids)).encode()
        back = hashlib.sha256(t.encode()).hexdigest()
        expected.append((i, len(ids), hashlib.sha256(listed).hexdigest(), back))
    assert corpus.bag(queries.QUERIES["op2_byte_bpe"](spark, SF_DIR).collect()) == corpus.bag(expected)


def test_quality_query(spark):
    found = queries.QUERIES["op4_mcd_quality"](spark, SF_DIR).drop("kept", "distance").collect()
    expected = []
    for i, t in corpus.texts(spark):
        c = test_quality.brute(t)
        expected.append((i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert corpus.bag(found) == corpus.bag(expected)


def test_quality_verdicts(spark):
    rows = corpus.documents(spark, SF_DIR).select("doc_id", "text", "lang", "source").collect()
    found = queries.QUERIES["op4_mcd_quality"](spark, SF_DIR).select("doc_id", "distance", "base_failed", "kept")
    found = [(r[0], None if r[2] else r[1], r[3]) for r in found.collect()]
    test_quality.agrees(found, test_quality.slow_judge([tuple(r) for r in rows]))


def test_sharding_query(spark):
    found = queries.QUERIES["op7_bounded_ring"](spark, SF_DIR).collect()
    rows = [(r["doc_id"], r["size"], r["text_crc32"], r["home"], r["shard"], r["slot"]) for r in found]
    test_sharding.check(rows, corpus.texts(spark), 16)
    assert {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)}


def test_rank_file_is_not_in_the_repository():
    assert bpe.encoding(queries.RANKS, queries.PATTERN).n_vocab > 50_000 and "/repo/" not in queries.RANKS
