from __future__ import annotations

import random
import re

from assayer.llm.decontamination import find_benchmark, without_contaminated
from tests.llm import corpus
from tests.llm.test_line_dedup import lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "item_id long, text string, words string, minimum long"


def words(text):
    return WORD.findall(lower(text or ""))


def brute(data, items, length=10):
    windows = {}
    for i, t, *_ in items:
        w = words(t)
        n = min(length, len(w))
        for s in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add("null" if i is None else str(i))
    out = []
    for i, t, *_ in data:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def benchmark(data, seed):
    rng = random.Random(seed)
    items = []
    for k in range(25):
        w = words(data[rng.randrange(60)][1])
        at = rng.randrange(max(1, len(w) - 14))
        taken = w[at : at + rng.choice([3, 9, 10, 11, 14, 40])]
        items.append((k, "; ".join(x.upper() for x in taken)))
    items += [(90, None), (91, ""), (92, "..."), (93, "word " * 12), (94, "a" * 5000), (None, items[0][1]), (3, items[1][1])]
    items += [(95, "nothing of this occurs anywhere in the documents of the test at all")]
    return items


def test_against_brute_force(spark):
    for seed in range(3):
        data = corpus.rows(seed)
        items = benchmark(data, seed)
        bench = spark.createDataFrame([(*r, None, None) for r in items], ITEM)
        for limit in (200_000, 0):
            found = find_benchmark(corpus.frame(spark, data), bench, broadcast_rows=limit)
            found = found.select("row.doc_id", "n_words", "n_hit", "items")
            assert corpus.bag(found.collect()) == corpus.bag(brute(data, items))


def test_items_of_every_length(spark):
    data = corpus.rows(5)
    rng = random.Random(5)
    items = []
    for n in range(1, 13):
        long = [w for w in (words(t) for _, t, *_ in data[:60]) if len(w) >= n]
        w = rng.choice(long)
        at = rng.randrange(len(w) - n + 1)
        items.append((n, " ".join(w[at : at + n])))
    bench = spark.createDataFrame([(*r, None, None) for r in items], ITEM)
    found = find_benchmark(corpus.frame(spark, data), bench).select("row.doc_id", "n_words", "n_hit", "items")
    expected = brute(data, items)
    assert {i for r in expected for i in r[3]} == {str(n) for n in range(1, 13)}
    assert corpus.bag(found.collect()) == corpus.bag(expected)


def test_long_items_only(spark):
    data = corpus.rows(4)
    items = [(i, t) for i, t in benchmark(data, 4) if len(words(t)) >= 10]
    bench = spark.createDataFrame([(*r, None, None) for r in items], ITEM)
    found = find_benchmark(corpus.frame(spark, data), bench).select("row.doc_id", "n_words", "n_hit", "items")
    expected = brute(data, items)
    assert any(r[2] for r in expected) and corpus.bag(found.collect()) == corpus.bag(expected)
    clean = without_contaminated(corpus.frame(spark, data), bench)
    assert clean.columns == corpus.frame(spark, data).columns
    assert clean.count() == sum(r[2] == 0 for r in expected)


def test_empty_tables(spark):
    docs, none = corpus.frame(spark, corpus.rows()), spark.createDataFrame([], ITEM)
    assert find_benchmark(docs, none).where("n_hit > 0").count() == 0
    some = spark.createDataFrame([(1, "alpha Beta", None, None)], ITEM)
    assert find_benchmark(corpus.frame(spark, []), some).count() == 0
