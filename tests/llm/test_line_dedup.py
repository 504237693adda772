from __future__ import annotations

from collections import defaultdict

from assayer.llm.line_dedup import dedup_lines, without_shared_lines
from tests.llm import corpus

SPACES = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(data, min_docs=3, min_chars=20):
    """Rows are documents; a null id is below all others."""
    rank = lambda i: (i is not None, i or 0)
    keys = [[lower(x.strip(SPACES)) for x in (t or "").split("\n")] for _, t, *_ in data]
    holders = defaultdict(set)
    for at, found in enumerate(keys):
        for k in found:
            if len(k) >= min_chars:
                holders[k].add(at)
    out = []
    for at, (i, t, *_) in enumerate(data):
        kept = []
        for line, k in zip((t or "").split("\n"), keys[at], strict=True):
            shared = len(holders[k]) >= min_docs if k in holders else False
            if not shared or i == max((data[a][0] for a in holders[k]), key=rank):
                kept.append(line)
        n = len(keys[at])
        out.append((i, "\n".join(kept), n, n - len(kept)))
    return out


def test_against_brute_force(spark):
    for seed in range(3):
        data = corpus.rows(seed)
        found = dedup_lines(corpus.frame(spark, data)).select("row.doc_id", "kept", "n_lines", "n_dropped")
        assert corpus.bag(found.collect()) == corpus.bag(brute(data))


def test_columns_stay(spark):
    docs = corpus.frame(spark, corpus.rows())
    found = without_shared_lines(docs)
    assert found.columns == docs.columns and found.count() == docs.count()


def test_empty_table(spark):
    assert without_shared_lines(corpus.frame(spark, [])).count() == 0
