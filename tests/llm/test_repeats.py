from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from assayer.llm import queries, repeats
from assayer.llm.common import text_key
from tests.llm import corpus


def brute(texts, length):
    """Bytes covered by windows that start at two places or more."""
    seen = Counter()
    for t in texts:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((int(gone.sum()), runs, kept))
    return out


def awkward(seed, n=50):
    """Texts with passages of about the threshold, periods, copies and overlaps."""
    rng = random.Random(seed)
    some = lambda k, abc="abcdeé \n": "".join(rng.choice(abc) for _ in range(k))
    passages = [some(rng.randint(30, 120)) for _ in range(5)] + ["ab" * 60, "x" * 90, some(45, "ab")]
    out = []
    for _ in range(n):
        parts = [some(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            parts += [p[a : len(p) - rng.randint(0, 20)], some(rng.randint(0, 40))]
        out.append("".join(parts))
    return out + out[:3] + ["", None, "y" * 39, "y" * 40, "z" * 41, "short", out[5], "q" * 200]


@pytest.mark.parametrize("seed,gram,crowd", [(0, 8, 20_000), (1, 1, 20_000), (2, 39, 20_000), (3, 8, 0), (4, 16, 3)])
def test_against_brute_force(spark, seed, gram, crowd):
    texts = awkward(seed)
    docs = corpus.frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    found = repeats.repeated_spans(docs, length=40, gram=gram, crowd=crowd).collect()
    keys = {(r["k1"], r["k2"]): r for r in found}
    assert len(keys) == len(found)
    k1, k2 = text_key(queries.whole_text("text"))
    by_id = {r["doc_id"]: keys.get((r["k1"], r["k2"])) for r in docs.select("doc_id", k1.alias("k1"), k2.alias("k2")).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (n, runs, kept) in enumerate(brute(raw, 40)):
        r = by_id[i]
        got = (r["n_removed"], len(r["spans"]), bytes(r["kept"])) if r else (0, 0, raw[i])
        assert got == (n, runs, kept), i


def test_parts_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 100)
    data = np.frombuffer(("abc" * 200 + "unlike " * 10).encode(), np.uint8).tobytes()
    parts = list(repeats._parts(data, 40))
    starts = [at + i for at, p in parts for i in range(len(p) - 39)]
    assert starts == list(range(len(data) - 39))


def test_first_digit_decides_equal_windows():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 600, dtype=np.uint8)
    data[300:380] = data[100:180]
    digit, low, n, _ = repeats.first_digits(data, 40, 8)
    of = np.repeat(digit, n)
    assert len(of) == 600 - 39 and (of[100:141] == of[300:341]).all()


def test_given_documents(spark):
    found = queries.QUERIES["op10_repeated_bytes"](spark, corpus.SF_DIR).collect()
    given = corpus.texts(spark)
    raw = [(t or "").encode() for _, t in given]
    expected = [
        (i, len(b), n, runs, hashlib.sha256(kept).hexdigest())
        for (i, _), b, (n, runs, kept) in zip(given, raw, brute(raw, 400), strict=True)
    ]
    assert corpus.bag(found) == corpus.bag(expected)


def test_many_long_constant_runs(spark, monkeypatch):
    sizes = {False: [], True: []}
    slices = repeats._slices

    def seen(texts, length):
        out = slices(texts, length)
        for r in out.groupBy("crowded", "digit").agg({"bytes": "count", "n": "sum"}).collect():
            sizes[r["crowded"]].append(r["sum(n)"] + r["count(bytes)"] * (length - 1))
        return out

    monkeypatch.setattr(repeats, "_slices", seen)
    rng = random.Random(0)
    some = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    texts = [some(60) + "=" * rng.randint(1000, 3000) + some(60) + "-+" * 100 for _ in range(20)]
    texts.append(some(50) + "=" * 41 + some(50))
    docs = corpus.frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    found = repeats.repeated_spans(docs, length=40, gram=8, crowd_bytes=10_000).collect()
    assert sizes[True] and max(sizes[False], default=0) <= 10_000
    expected = [x for x in brute([t.encode() for t in texts], 40) if x[0]]
    got = [(r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in found]
    assert sorted(got) == sorted(expected)


def test_empty_table(spark):
    assert repeats.repeated_spans(corpus.frame(spark, [])).count() == 0
