from __future__ import annotations

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from assayer.llm import katz, queries
from assayer.llm.common import ARROW_BYTES, TIDY, written
from tests.llm import corpus
from tests.llm.test_line_dedup import lower


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text or "")), None]  # None ends a document


def held(i, folds=10):
    return i is not None and zlib.crc32(str(i).encode()) % folds == 0


class Slow:
    """The model by its definition, with dictionaries."""

    def __init__(self, data, order, kmax=5):
        self.order = order
        self.counts = [Counter() for _ in range(order)]
        self.after = [defaultdict(Counter) for _ in range(order)]
        for i, t, *_ in data:
            if not held(i):
                for m, context, w in self.grams(tokens(t)):
                    self.after[m][context][w] += 1
        self.ds = []
        for m in range(order):
            sizes = Counter(c for ws in self.after[m].values() for c in ws.values())
            self.ds.append(katz.discounts([sizes[r] for r in range(1, kmax + 2)]))

    def grams(self, ws):
        padded = ["<s>"] * (self.order - 1) + ws
        for at, w in enumerate(ws):
            for m in range(self.order):
                yield m, tuple(padded[at + self.order - 1 - m : at + self.order - 1]), w

    def kept(self, m, c):
        return c * self.ds[m][c] if c < len(self.ds[m]) else c - katz.LARGE_GIVES

    def p(self, m, context, w):
        seen = self.after[m].get(context)
        if m == 0:
            if not seen:
                return 1.0
            n = sum(seen.values())
            return self.kept(0, seen[w]) / n if w in seen else 1 - sum(self.kept(0, c) for c in seen.values()) / n
        if not seen:
            return self.p(m - 1, context[1:], w)
        n = sum(seen.values())
        if w in seen:
            return self.kept(m, seen[w]) / n
        left = 1 - sum(self.kept(m, c) for c in seen.values()) / n
        below = 1 - sum(self.p(m - 1, context[1:], v) for v in seen)
        return left / below * self.p(m - 1, context[1:], w)

    def score(self, text):
        return sum(math.log10(self.p(m, c, w)) for m, c, w in self.grams(tokens(text)) if m == self.order - 1)


@pytest.mark.parametrize("order,batch_bytes", [(1, 1 << 20), (2, 1 << 20), (2, 3000), (3, 20_000)])
def test_against_definition(spark, order, batch_bytes):
    data = [(i, (t or "")[:3000] if t else t, a, b) for i, t, a, b in corpus.rows(order)]
    slow = Slow(data, order)
    train = Counter(w for i, t, *_ in data if not held(i) for w in tokens(t))
    n, v = sum(train.values()), len(train)
    expected = []
    for i, t, *_ in data:
        ws = tokens(t)
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        known = sum(w in train for w in ws)
        expected.append((i, held(i), len(ws), known, n, round(base, 6), round(slow.score(t), 6)))
    found = katz.katz_scores(corpus.frame(spark, data), order=order, batch_bytes=batch_bytes).collect()
    got = [(*r[:5], round(r[5], 6), round(r[6], 6)) for r in found]
    assert corpus.bag(got) == corpus.bag(expected)


def test_query_backs_off_twice(spark, tmp_path):
    data = [(i, t[:3000] if t else t, a, b) for i, t, a, b in corpus.rows(5)]
    corpus.frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    slow = Slow(data, 3)
    found = queries.QUERIES["op6_katz_backoff"](spark, str(tmp_path)).collect()
    got = [(r["doc_id"], round(r["score"], 6)) for r in found]
    assert corpus.bag(got) == corpus.bag((i, round(slow.score(t), 6)) for i, t, *_ in data)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_add_up(order):
    data = corpus.rows(9)
    slow = Slow(data, order)
    words = set(slow.after[0][()]) | {"<unknown>"}
    for m in range(order):
        for context in [*list(slow.after[m])[:40], ("nowhere",) * m]:
            assert abs(sum(slow.p(m, context, w) for w in words) - 1) < 1e-9


def test_discounts():
    d = katz.discounts([100, 40, 20, 12, 8, 5])
    assert (0 < d[1:]).all() and (d[1:] < 1).all()
    d = katz.discounts([0, 0, 0, 0, 0, 0])
    assert (0 < d[1:]).all() and (d[1:] < 1).all()


def test_packing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (katz.unpack_keys(katz.pack_keys(keys)) == keys).all()
        bounds = katz._part(keys, 7)
        assert bounds[0] == 0 and bounds[-1] == n and (np.diff(bounds) >= 0).all()


def test_held_out_score_beats_base(spark):
    found = katz.katz_scores(corpus.documents(spark)).where("held_out").collect()
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_what_is_moved_and_kept(spark, monkeypatch):
    """Sums only of contexts that held-out documents have, a row per part and batch of what
    documents are owed, and tables written so that their shuffle files go with them."""
    data = [(i, t[:3000] if t else t, a, b) for i, t, a, b in corpus.rows(4)]
    tables, tidied, plain, before = [], [], katz.written, spark.conf.get(TIDY, None)

    def kept(df, **kwargs):
        tidied.append(kwargs.get("tidy"))
        tables.append(plain(df, **kwargs))
        return tables[-1]

    monkeypatch.setattr(katz, "written", kept)
    found = katz.katz_scores(corpus.frame(spark, data), order=3, batch_bytes=5000)
    assert tidied == [True] * 4 and spark.conf.get(TIDY, None) == before
    weights = tables[-1]
    sums = sum(len(katz.unpack_keys(r["keys"])) for r in weights.where("batch IS NULL").collect())
    contexts = {(m, c) for i, t, *_ in data if held(i) for m, c, _ in Slow([], 3).grams(tokens(t)) if m}
    assert 0 < sums <= len(contexts)
    owed = weights.where("batch IS NOT NULL")
    assert owed.count() == owed.select("batch", "part").distinct().count() > 0
    assert found.count() == len(data)


def most_held(run):
    """Most bytes that were held at a time, of Python and numpy."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_one_length_of_a_batch_is_held_at_a_time():
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(f"w{i}" for i in rng.integers(0, 500, 300_000))])
    tokens_of = 8 * 300_001

    def grams(order):
        for m, (keys, contexts) in enumerate(katz.Batch(texts, order).grams()):
            assert len(keys) == 300_001 and (contexts is None) == (m == 0)

    assert most_held(lambda: grams(9)) < most_held(lambda: grams(3)) + tokens_of


def test_rows_of_a_group_are_no_copies():
    blob = np.random.default_rng(2).bytes(1 << 20)
    frames = [
        pa.RecordBatch.from_pydict({"part": [i // 3] * 2, "keys": [blob, None]}) for i in range(6)
    ]

    def run():
        for part, rows in katz._groups(frames):
            assert part in (0, 1) and len(rows) == 6
            assert [r["keys"] is None for r in rows] == [False, True] * 3
            assert bytes(rows[0]["keys"][:9]) == blob[:9]

    assert most_held(run) < 1 << 20


def test_packed_tables_are_written_in_small_pieces(spark):
    """Of 40 MB that a task writes no row group has over 12, and no frame that Python gets over 6."""

    def sizes(frames):
        for frame in frames:
            for _ in range(frame.num_rows):
                yield pa.RecordBatch.from_pydict({"n": [frame.nbytes], "blob": [np.random.bytes(100_000)]})

    before = spark.conf.get(ARROW_BYTES, None)
    rows = spark.range(0, 400, 1, 1).select(F.lit("x" * 100_000).alias("t"))
    found = written(rows.mapInArrow(sizes, "n long, blob binary"), packed=True)
    assert found.agg(F.max("n")).first()[0] < 6 << 20 and found.count() == 400
    for name in found.inputFiles():
        meta = pq.ParquetFile(name.removeprefix("file://")).metadata
        assert max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 12 << 20
        assert meta.row_group(0).column(1).compression == "UNCOMPRESSED"
    assert spark.conf.get(ARROW_BYTES, None) == before


def test_texts_are_dealt_in_few_payloads(spark):
    """As many payloads from many small frames as from one."""
    frames = [pa.RecordBatch.from_pydict({"a": [i]}) for i in range(50)]
    assert [len(t) for t in katz._gathered(frames)] == [50]
    assert [len(t) for t in katz._gathered(frames, rows=20)] == [20, 20, 10]
    assert all(t["a"].num_chunks == 1 for t in katz._gathered(frames, rows=20))  # take() is slow on more
    assert [len(t) for t in katz._gathered(frames, size=200)] == [25, 25]
    assert list(katz._gathered([])) == []


def test_no_training_and_empty(spark):
    one = next(i for i in range(1000) if held(i))
    found = katz.katz_scores(corpus.frame(spark, [(one, "some words", None, None)])).collect()
    assert [(r["n_tokens"], r["n_known"], r["score"]) for r in found] == [(3, 0, 0.0)]
    assert katz.katz_scores(corpus.frame(spark, [])).count() == 0
