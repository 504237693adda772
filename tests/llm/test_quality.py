from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import quality
from tests.llm import corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {p for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts(spark):
    data = corpus.rows() + [(2000, "a b c d e f g h a b c d e f g h", "en", "a"), (2001, "x y " * 9, "en", "a")]
    found = quality.judge_quality(corpus.frame(spark, data), keep=["doc_id"])
    got = corpus.bag(found.select("row.doc_id", *quality.COUNTS, "base_failed").collect())
    expected = []
    for i, t, *_ in data:
        c = brute(t)
        expected.append((i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert got == corpus.bag(expected)


@pytest.mark.parametrize("seed", range(20))
def test_repeated_words(seed):
    rng = random.Random(seed)
    words = [rng.choice("ab").encode() for _ in range(rng.randint(0, 60))]
    assert quality.repeated_words(words) == brute(b" ".join(words).decode())[4]


def reference_mcd(x, least, support=0.75, steps=6):
    """The same steps over an array, with exact order statistics of the distances."""
    floor = np.diag(np.square(least))

    def fit(part):
        return part.mean(axis=0), np.cov(part.T, bias=True) + floor

    def distance(mean, scatter):
        d = x - mean
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(scatter), d)

    def nearest(d, share):
        return x[np.argsort(d, kind="stable")[: int(np.ceil(len(x) * share))]]

    starts = [fit(x)]
    starts.append(fit(nearest((((x - x.mean(axis=0)) / least) ** 2).sum(axis=1), 0.5)))
    ends = []
    for mean, scatter in starts:
        for _ in range(steps):
            mean, scatter = fit(nearest(distance(mean, scatter), support))
        ends.append((np.linalg.slogdet(scatter)[1], mean, scatter))
    return min(ends, key=lambda e: e[0])


def test_estimates_against_array_version(spark):
    rng = np.random.default_rng(3)
    clean = rng.normal([1.0, 2.0], [0.5, 0.1], (3000, 2))
    far = rng.normal([4.0, 0.0], [0.2, 0.2], (600, 2))
    x = np.concatenate((clean, far))
    points = spark.createDataFrame([("g", float(a), float(b)) for a, b in x], "key string, u double, v double")
    row = quality.mcd(points, "key", ["u", "v"], [0.01, 0.01]).first()
    _, mean, scatter = reference_mcd(x, np.array([0.01, 0.01]))
    assert row["rows"] == len(x)
    assert np.allclose(row["mean"], mean, atol=0.02)
    assert np.allclose(np.linalg.inv(np.array(row["inverse"]).reshape(2, 2)), scatter, rtol=0.1, atol=1e-3)
    assert np.allclose(mean, [1, 2], atol=0.05)  # the far points do not pull


def test_a_third_of_equal_far_rows_is_rejected(spark):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "blmnrst" for b in "aeiou" for c in ["", "n", "rt", "ndel"]]
    clean = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(80, 200))), "en", "a") for i in range(400)]
    template = " ".join(f"||##{a}{i}" for i in range(50) for a in "xyz")
    junk = [(1000 + i, template, "en", "a") for i in range(200)]
    found = quality.judge_quality(corpus.frame(spark, clean + junk), keep=["doc_id"])
    rows = found.select("row.doc_id", "base_failed", "kept").collect()
    assert not any(r["base_failed"] for r in rows)
    assert not [r for r in rows if r["doc_id"] >= 1000 and r["kept"]]
    assert sum(r["kept"] for r in rows if r["doc_id"] < 1000) > 0.97 * 400


def test_outliers_are_rejected_and_clean_rows_kept(spark):
    docs = corpus.documents(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = quality.judge_quality(docs, keep=["doc_id"]).select("row.doc_id", "kept", "base_failed")
    got = found.join(labels, "doc_id").groupBy("quality").agg(
        F.avg(F.col("kept").cast("double")).alias("kept"),
        F.avg((F.col("kept") | F.col("base_failed")).cast("double")).alias("by_distance"),
    )
    got = {r["quality"]: r for r in got.collect()}
    assert got[1]["by_distance"] > 0.97  # good documents, but for those the base rules refuse
    assert got[0]["kept"] < 0.4


def in_order(sizes, part):
    """What is needed of each of some ordered counts to have `part` of them all."""
    need = np.ceil(sizes.sum() * part) - np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return np.clip(need, 0, sizes)


def middle(bins, part=0.5):
    values, sizes = np.unique(bins, return_counts=True)
    return values[in_order(sizes, part) > 0][-1]


def slow_fit(x, least, support=0.5, steps=6):
    """An MCD estimate by its definition, over an array: mean, scatter, unit."""
    least, p = np.array(least), x.shape[1]

    def distance_bins(mean, scatter):
        d = x - mean
        found = np.maximum(np.einsum("ij,jk,ik->i", d, np.linalg.inv(scatter), d), 0)
        return np.floor(np.log(found + np.exp(-20)) * 64)

    def fit(bins, part):
        values, at, sizes = np.unique(bins, return_inverse=True, return_counts=True)
        w = (in_order(sizes, part) / sizes)[at]
        mean = w @ x / w.sum()
        return mean, (x * w[:, None]).T @ x / w.sum() - np.outer(mean, mean) + np.diag(least**2)

    cells = np.floor(x * 8 / least)
    mid = np.array([middle(cells[:, j]) for j in range(p)])
    off = np.array([middle(abs(cells[:, j] - mid[j])) for j in range(p)])
    start, ends = (mid + 0.5) * least / 8, []
    for scale in (np.maximum(1.4826 * off * least / 8, least), least):
        mean, scatter = fit(distance_bins(start, np.diag(scale**2)), 0.5)
        for _ in range(steps):
            mean, scatter = fit(distance_bins(mean, scatter), support)
        ends.append((np.linalg.slogdet(scatter)[1], mean, scatter))
    _, mean, scatter = min(ends, key=lambda e: e[0])
    median = np.exp((middle(distance_bins(mean, scatter)) + 1) / 64) - np.exp(-20)
    return mean, scatter, max(median / (p * (1 - 2 / (9 * p)) ** 3), 1.0)


def slow_judge(data, shrink_words=100, shrink_rows=200):
    """(id, distance or None, kept) of each row, by the rule of the query."""
    least = np.array(quality.LEAST_SPREAD)
    counts = [brute(t) for _, t, *_ in data]
    passed = [c[0] >= 20 and 100 * c[4] <= 30 * c[0] for c in counts]
    vectors = {}
    for lang in {r[2] for r in data}:
        of = [c for r, c, ok in zip(data, counts, passed, strict=True) if ok and r[2] == lang]
        rate = [sum(c[j] for c in of) / max(sum(c[0] for c in of), 1) for j in range(1, 5)]
        for at, (r, c) in enumerate(zip(data, counts, strict=True)):
            if r[2] == lang and passed[at]:
                shares = [(c[j] + shrink_words * rate[j - 1]) / (c[0] + shrink_words) for j in range(1, 5)]
                vectors[at] = [np.log(max(shares[0], 1e-9)), *np.sqrt(shares[1:])]
    fits = {}

    def fitted(*key):
        if key not in fits:
            x = np.array([v for at, v in vectors.items() if data[at][2 : 2 + len(key)] == key])
            fits[key] = (len(x), *slow_fit(x, least))
        return fits[key]

    cut = quality.chi_square_cut(4, 4.0)
    out = []
    for at, r in enumerate(data):
        if not passed[at]:
            out.append((r[0], None, False))
            continue
        levels = [fitted(), fitted(r[2]), fitted(r[2], r[3])]
        mean, scatter, unit, added = levels[0][1], np.diag((10 * least) ** 2), 1.0, 20
        for n, own_mean, own, own_unit in levels:
            rest = added / (n + added)
            gap = own_mean - mean
            mean, unit = own_mean - rest * gap, own_unit + rest * (unit - own_unit)
            scatter = own + rest * (scatter - own) + rest * (1 - rest) * np.outer(gap, gap)
            added = shrink_rows
        d = np.array(vectors[at]) - mean
        found = d @ np.linalg.inv(scatter) @ d / unit
        out.append((r[0], found, found <= cut))
    return out


def agrees(found, expected):
    """(id, distance, kept) rows; distances to a millionth, so that kept can differ on the cut only."""
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)
    cut = quality.chi_square_cut(4, 4.0)
    assert len(found) == len(expected)
    for a, b in zip(sorted(found, key=order), sorted(expected, key=order), strict=True):
        assert a[0] == b[0] and (b[1] is None or a[1] == pytest.approx(b[1], rel=1e-6, abs=1e-9))
        assert a[2] == b[2] or b[1] == pytest.approx(cut, rel=1e-6)


def test_kept_against_definition(spark):
    rng = random.Random(11)
    data = []
    for i in range(900):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", None])
        stem = "lorem ipsum dolor" if lang == "en" else "zwischenzeitlich angenommen ob"
        words = [rng.choice(stem.split()) + rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(rng.randint(10, 90))]
        if i % 11 == 0:
            words = [w + "##||" for w in words]
        data.append((i, " ".join(words), lang, source))
    data += [(2000, "a lone source of some words " + " ".join(map(str, range(30))), "fr", "z")]
    found = quality.judge_quality(corpus.frame(spark, data), keep=["doc_id"]).select("row.doc_id", "distance", "base_failed", "kept")
    expected = slow_judge(data)
    agrees([(r[0], None if r[2] else r[1], r[3]) for r in found.collect()], expected)
    kept = {i: k for i, _, k in expected}
    assert kept[2000] and 0 < sum(not k for k in kept.values()) < len(kept) / 2


def test_few_rows_and_empty_table(spark):
    few = [(i, "one two three " * 3 + f"word{i} " * 12, None, None) for i in range(5)]
    found = quality.judge_quality(corpus.frame(spark, few))
    assert [r["group_rows"] for r in found.where("NOT base_failed").collect() if not r["kept"]] == []
    assert quality.judge_quality(corpus.frame(spark, [])).count() == 0
