from __future__ import annotations

import random

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import bpe
from assayer.llm.queries import PATTERN, RANKS
from tests.llm import corpus

ENC: tiktoken.Encoding = bpe.encoding(RANKS, PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab É'sdt  \n\t12.!漢字 \U0001f600"), max_size=200), st.integers(1, 30))
def test_cutting_changes_nothing(text, length):
    assert "".join(bpe.pieces(text, length)) == text
    assert bpe.encode_text(text, ENC, length).tolist() == ENC.encode_ordinary(text)


def test_long_text_in_pieces():
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdeéü'\n 1,") for _ in range(rng.randint(1, 9))) for _ in range(60_000))
    assert len(list(bpe.pieces(text, 10_000))) > 10
    assert bpe.encode_text(text, ENC, 10_000).tolist() == ENC.encode_ordinary(text)


def test_encode_and_decode(spark):
    data = corpus.rows()
    docs = corpus.frame(spark, data)
    both = bpe.encode(docs, RANKS, PATTERN, piece_chars=50, decode_back=True, keep=["doc_id", "text"])
    found = both.select("row.doc_id", "row.text", "ids", "decoded").collect()
    assert len(found) == len(data)
    for r in found:
        assert r["ids"] == ENC.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    again = bpe.decode(both.select("ids"), RANKS, PATTERN).select("decoded").collect()
    assert sorted(bytes(r[0]) for r in again) == sorted(bytes(r["decoded"]) for r in found)


def test_ids_that_split_a_character(spark):
    ids = ENC.encode_ordinary("漢")
    assert len(ids) > 1
    frame = spark.createDataFrame([([i],) for i in ids] + [(None,)], "ids array<int>")
    found = [bytes(r["decoded"]) for r in bpe.decode(frame, RANKS, PATTERN).collect()]
    assert sorted(found) == sorted([ENC.decode_bytes([i]) for i in ids] + [b""])


def test_empty_table(spark):
    assert bpe.encode(corpus.frame(spark, []), RANKS, PATTERN).count() == 0


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([("ab", 1, 2)], "struct<`te``xt`:string,`a.b`:int,ids:int>")
    both = bpe.encode(docs, RANKS, PATTERN, text_col="te`xt")
    assert both.select("row.*").columns == ["te`xt", "a.b", "ids"]
    again = bpe.decode(both.select(both["ids"].alias("i`ds")), RANKS, PATTERN, ids_col="i`ds")
    assert bytes(again.first()["decoded"]) == b"ab"
