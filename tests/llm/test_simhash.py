from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import simhash
from assayer.llm.components import components
from tests.llm import corpus
from tests.llm.test_line_dedup import lower


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, pairs):
    """Least value reachable, by repeated lookup."""
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {v: top(v) for v in values}


def near_pairs(fps, distance):
    fps = sorted(fps)
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= distance]


def brute(data):
    prints = [slow_fingerprint(t) for _, t, *_ in data]
    of = roots(set(prints), near_pairs(set(prints), 4))
    least = {}
    for (i, *_), fp in zip(data, prints, strict=True):
        if i is not None:
            least[of[fp]] = min(i, least.get(of[fp], i))
    return [(i, f"{fp:016x}", least.get(of[fp])) for (i, *_), fp in zip(data, prints, strict=True)]


@pytest.mark.parametrize("text", ["", " ", "One", "one TWO three", "a b c d", "É é ß Ss x", "x " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    row = spark.createDataFrame([("one two three four",)], "t string").selectExpr("xxhash64(t) AS h").first()
    assert simhash.fingerprint("one two three four") == row["h"] % (1 << 64)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_near_fingerprints_share_a_variant(fp, flips):
    parts = simhash.segments(4)
    other = fp ^ sum(1 << b for b in flips)
    variants = lambda x: {(b, x & simhash._mask(p) & ~(1 << b)) for p in parts for b in p}
    assert len(parts) == 3 and variants(fp) & variants(other)


def clusters(seed, n):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 40])):
            out.add(at)
            for _ in range(rng.randint(0, 5)):
                at ^= 1 << rng.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("block", [20_000, 6])
def test_links_keep_every_connection(spark, block):
    fps = clusters(block, 60) + [0, 1, 3, (1 << 64) - 1]
    frame = spark.createDataFrame([(simhash._signed(f),) for f in sorted(set(fps))], "fp long")
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(frame, 4, block).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    expected = roots(set(fps), near_pairs(set(fps), 4))
    assert roots(set(fps), pairs) == expected


def test_forest_is_short():
    fps = np.unique(np.array([sum(1 << b for b in {i % 8, j % 8}) for i in range(8) for j in range(8)], np.uint64))
    found = simhash.forest(fps, 4)
    assert sum(len(b) for _, b in found) == len(fps) - 1


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 999), (5000, 5000), (7000, 7001), (7001, 7000)]
    found = components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
    got = {r["node"]: r["root"] for r in found}
    assert got == {**{i: 0 for i in range(1, 201)}, 1000: 999, 7001: 7000}


def test_against_brute_force(spark):
    for seed in range(2):
        data = corpus.rows(seed)
        found = simhash.near_copies(corpus.frame(spark, data))
        got = found.select("id", simhash.hex_digits(found["fp"]), "component_id").collect()
        assert corpus.bag(got) == corpus.bag(brute(data))


def test_given_documents(spark):
    found = simhash.near_copies(corpus.documents(spark))
    got = found.select("id", simhash.hex_digits(found["fp"]), "component_id").collect()
    assert corpus.bag(got) == corpus.bag(brute(corpus.texts(spark)))


def test_one_stays(spark):
    data = [r for r in corpus.rows() if r[0] is not None]
    docs = corpus.frame(spark, data)
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {c for _, _, c in brute(data)}


def test_exactly_one_row_of_each_component_stays(spark):
    data = corpus.rows()
    near = data[3][1].replace("\n", "  ")
    data += [data[3], data[3], (None, near, "en", "a"), (None, "only null ids " * 9, "en", "a")]
    data += [(None, "only null ids " * 9, "en", "b"), (3, "some other text of a taken id " * 3, "en", "a")]
    prints = [slow_fingerprint(t) for _, t, *_ in data]
    of = roots(set(prints), near_pairs(set(prints), 4))
    rows = {}
    for (i, t, *_), fp in zip(data, prints, strict=True):
        rows.setdefault(of[fp], []).append((i, t or ""))
    left = simhash.one_of_each(corpus.frame(spark, data)).collect()
    got = {}
    for r in left:
        got.setdefault(of[slow_fingerprint(r["text"])], []).append((r["doc_id"], r["text"] or ""))
    assert got.keys() == rows.keys() and all(len(g) == 1 for g in got.values())
    for root, (kept,) in got.items():
        ids = [i for i, _ in rows[root] if i is not None]
        assert kept in rows[root] and kept[0] == min(ids, default=None)


def test_empty_table(spark):
    assert simhash.near_copies(corpus.frame(spark, [])).count() == 0


def test_columns_of_any_name(spark):
    names = ["keeper_id", "id", "row", "t1", "__keeper_n", "a`b", "a.b"]
    data = [(i, f"some words of text number {i // 2} and more of it", *names) for i in range(6)]
    columns = ["doc_id", "text", *names]
    docs = spark.createDataFrame([tuple(r) for r in data], "struct<" + ",".join(f"`{c.replace('`', '``')}`:{'long' if c == 'doc_id' else 'string'}" for c in columns) + ">")
    left = simhash.one_of_each(docs, max_distance=0)
    assert left.columns == columns and sorted(r["doc_id"] for r in left.collect()) == [0, 2, 4]
