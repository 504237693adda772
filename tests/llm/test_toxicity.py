"""The clause grammar against its definition, and what is learned against labels held out."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from assayer.llm import queries, toxicity
from tests.agreement import SF_DIR
from tests.llm import corpus

LEXICON = {"vile$": 2.0, "rott": 1.5}
PIECES = ["vile", "rotten", "kill", "will", "you", "not", "said", '"', ".", "\n", "word", "tree", ":", "VILE", "Über"]


def brute(text: str):
    """The sums by looking, for each insult or threat, at what stands before it and in its clause."""
    tags = [toxicity.Tagger(LEXICON)[t] for t in toxicity.TOKEN.findall(text.lower())]
    symbols = [s for s, _ in tags]
    ends = (toxicity.END, toxicity.BREAK)
    sums = np.zeros(toxicity.KINDS)
    clauses: dict[int, float] = {}
    for i, (symbol, weight) in enumerate(tags):
        if symbol not in (toxicity.INSULT, toxicity.THREAT):
            continue
        line = max([j + 1 for j in range(i) if symbols[j] == toxicity.BREAK], default=0)
        first = max([j + 1 for j in range(i) if symbols[j] in ends], default=0)
        last = min([j for j in range(i, len(symbols)) if symbols[j] in ends], default=len(symbols))
        before = symbols[max(first, i - toxicity.REACH) : i]
        if symbol == toxicity.THREAT and toxicity.INTENT not in before:
            continue
        quoted = symbols[line:i].count(toxicity.QUOTE) % 2 == 1
        told = max([first, *[j + 1 for j in range(line, i) if symbols[j] == toxicity.QUOTE]])
        mark = 0
        if quoted or toxicity.REPORT in symbols[told:i]:
            mark = toxicity.REPORTED
        elif toxicity.NEGATION in before:
            mark = toxicity.NEGATED
        sums[2 * (mark + 3 * (symbol == toxicity.THREAT)) + (toxicity.TARGET in symbols[first:last])] += weight
        clauses[first] = clauses.get(first, 0.0) + weight
    return sums, max(clauses.values(), default=0.0)


@pytest.mark.parametrize("seed", range(40))
def test_grammar_against_its_definition(seed):
    rng = random.Random(seed)
    text = " ".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))
    sums, heaviest, _ = toxicity.clause_sums(text, toxicity.Tagger(LEXICON))
    expected = brute(text)
    assert np.allclose(sums, expected[0]) and heaviest == pytest.approx(expected[1])


@pytest.mark.parametrize(
    "text, kind",
    [
        ("a vile thing", 0), ("you are vile", 1), ("that is not vile", 2), ("you are not vile", 3),
        ("it said vile", 4), ("you said vile", 5), ('"so vile" you', 5), ("will kill", 6), ("will kill you", 7),
        ("will not kill you", 9), ("it said will kill you", 11),
    ],
)
def test_kinds(text, kind):
    sums = toxicity.clause_sums(text, toxicity.Tagger(LEXICON))[0]
    assert np.flatnonzero(sums).tolist() == [kind]


def test_words_alone_are_no_match():
    tagger = toxicity.Tagger(LEXICON)
    for text in ("", " \n", "kill the lights", "you will not", "vi le", "unvile"):
        assert not toxicity.clause_sums(text, tagger)[0].any()
    small = toxicity.Tagger(LEXICON, most=3)
    text = "vile rotten tree word you will kill"
    assert np.allclose(toxicity.clause_sums(text, small)[0], toxicity.clause_sums(text, tagger)[0])


def test_lexicon_keeps_the_longest_feature_that_says_as_much():
    rows = [("abc", 60, 1), ("abcd", 60, 1), ("abcde$", 30, 0), ("abcdf$", 30, 0), ("xyz", 50, 500), ("few$", 2, 0)]
    assert set(toxicity.lexicon_of(rows, 100, 1000)) == {"abcd", "abcde$", "abcdf$"}
    assert toxicity.lexicon_of(rows, 0, 10) == {} and toxicity.lexicon_of([], 1, 1) == {}


def test_logistic_fit_is_stationary():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(500), rng.normal(size=(500, len(toxicity.PRIOR) - 1))])
    y = (rng.random(500) < 1 / (1 + np.exp(-x[:, 1]))).astype(float)
    w = toxicity.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (p - y) + toxicity.FIRMNESS * (w - toxicity.PRIOR)).max() < 1e-6
    assert (toxicity.fit_logistic(x[:0], y[:0]) == toxicity.PRIOR).all()


def held(i) -> bool:
    return zlib.crc32(str(i).encode()) % 4 == 2


def made(n: int = 400):
    """Texts whose toxic ones hold made-up words of one stem, and their labels."""
    rng = random.Random(5)
    plain = ["".join(rng.choice("abeginorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(10, 60))]
        toxic = i % 5 == 0
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), "zuk" + rng.choice(plain))
        rows.append((i, " ".join(words) + ".", "en", "a"))
        labels.append((i, 0, int(toxic)))
    rows += [(10_000, None, None, None), (10_001, "", "en", "a"), (None, "zuka zukb", "en", "a"), (7, rows[7][1], "en", "a")]
    return rows, [*labels, (None, 0, 1), (10_000, 0, 1), (3, None, 5), (5, 1, None), (99_999, 0, 1)]


def scored(spark, rows, labels, **more):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.score_toxicity(corpus.frame(spark, rows), table, **more)
    return found.select("row.doc_id", "row.text", "held_out", "score", "predicted").collect()


def test_learns_words_of_toxic_texts(spark):
    rows, labels = made()
    found = scored(spark, rows, labels)
    assert corpus.bag((r["doc_id"], r["text"]) for r in found) == corpus.bag((r[0], r[1]) for r in rows)
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"]))
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["predicted"] == int("zuk" in (r["text"] or ""))


def test_tables_without_labels_or_rows(spark):
    rows, labels = made(40)
    for table in ([], [x for x in labels if x[2] == 0], [x for x in labels if x[2] == 1]):
        assert all(r["predicted"] == 0 for r in scored(spark, rows, table))
    assert scored(spark, [], labels) == [] and scored(spark, [], []) == []


def test_sample_is_bounded_and_counts_near_copies_once(spark):
    rows, labels = made(200)
    table = spark.createDataFrame([(i, 0, 1) for i in range(200)] + [(500 + i, 0, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    copies = [(500 + i, rows[0][1] + " tail", "en", "a") for i in range(50)]
    docs = corpus.frame(spark, [r for r in rows if r[0] is not None] + copies)
    whole = toxicity.labelled_sample(docs, table, toxicity.held_out("id", 4, 2), "doc_id", "text", "doc_id", "toxic", 10_000)
    by = {r["toxic"]: r["count"] for r in whole.groupBy("toxic").count().collect()}
    assert by[0] <= 2 and by[1] == len({rows[i][1] for i in range(200) if not held(i)})
    part = toxicity.labelled_sample(docs, table, toxicity.held_out("id", 4, 2), "doc_id", "text", "doc_id", "toxic", 20)
    assert 5 <= part.where("toxic = 1").count() <= 40


def test_query_on_held_out_labels(spark):
    found = {r["doc_id"]: r for r in queries.QUERIES["op12_clause_grammar_toxicity"](spark, SF_DIR).collect()}
    documents = corpus.documents(spark)
    assert len(found) == documents.count()
    english = documents.where("lang = 'en'").select("doc_id")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").join(english, "doc_id").collect()
    out = [(r["toxic"], found[r["doc_id"]]) for r in labels if held(r["doc_id"])]
    assert all(f["held_out"] for _, f in out)
    hits = sum(f["predicted"] for t, f in out if t)
    assert hits >= 0.9 * sum(t for t, _ in out) and sum(f["predicted"] for t, f in out if not t) <= 0.02 * len(out)
