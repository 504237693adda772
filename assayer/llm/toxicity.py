"""Toxicity: a weighted finite-state grammar of clauses, with weights learned from labels.

Words become symbols: insults, threats, intents, targets, negations, reporting verbs,
quotes and clause ends. Small transducers over these symbols, one each for threat,
negation, reported speech and target, are composed into a single table. It marks every
insult or threat by what it stands under, and tells at a clause's end whether the clause
has a target. The weights of the marked words, summed up per kind of clause, are what a
text is scored by.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import whole_row, whole_text, written
from assayer.llm.langid import held_out
from assayer.operators.shaping import cell

# --- words and symbols -------------------------------------------------------------

INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, QUOTE, END, BREAK, OTHER = range(10)
SYMBOLS = range(10)

#: Grammar words in English, German, French and Spanish. Insults are learned from labels.
GRAMMAR = {
    INTENT: "will shall gonna going must should werde werden wird soll vais va allons voy vamos",
    THREAT: "kill hurt shoot beat destroy burn stab töten umbringen erschießen tuer frapper matar golpear",
    TARGET: (
        "you your yours yourself he she him her they them their these those this "
        "du dich dir dein ihr euch er sie tu toi te vous ton votre ils elles tú ti usted ustedes tus ellos"
    ),
    NEGATION: "not never no neither nor nobody nicht nie kein keine niemand pas jamais ni personne nunca nadie ningún",
    REPORT: (
        "said says say wrote writes called calls claimed claims quoted quote "
        "sagte sagt schrieb nannte behauptet dit écrit appelle affirme dijo dice escribió llamó afirma"
    ),
}
SYMBOL_OF = {word: symbol for symbol, words in GRAMMAR.items() for word in words.split()}

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n\"“”„«»]")
MARKS = {".": END, "!": END, "?": END, ";": END, ":": OTHER, "\n": BREAK}

#: A word's features are the word itself and its beginnings of so many letters.
PREFIXES = range(3, 8)


def word_features(word: str) -> list[str]:
    """The word, marked by a trailing $, and its proper beginnings."""
    return [word + "$", *[word[:k] for k in PREFIXES if len(word) > k]]


class Tagger(dict):
    """Symbol and weight of a token; words are looked up once and remembered for a while."""

    def __init__(self, lexicon: dict[str, float], most: int = 500_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most
        #: How words of weight begin; few words of other texts begin so.
        self.heads = {f.rstrip("$")[:3] for f in lexicon} | {w[:3] for w in GRAMMAR[THREAT].split()}

    def worth_tagging(self, tokens: list[str]) -> bool:
        heads = self.heads
        return any(self[t][0] <= THREAT for t in {t for t in tokens if t[:3] in heads})

    def __missing__(self, token: str) -> tuple[int, float]:
        if token[0].isalpha():
            weight = max((self.lexicon.get(f, 0.0) for f in word_features(token)), default=0.0)
            symbol = SYMBOL_OF.get(token, OTHER)
            found = (INSULT, weight) if weight > 0 else (symbol, 1.0 if symbol == THREAT else 0.0)
        else:
            found = (MARKS.get(token, QUOTE), 0.0)
        if len(self) >= self.most:
            self.clear()
        self[token] = found
        return found


# --- transducers -------------------------------------------------------------------

#: What a symbol stands under. Marks 0 to 5 are insult and threat, each plain, negated, reported.
PLAIN, NEGATED, REPORTED = range(3)
REACH = 3


def near(opener: int, outputs: dict[int, dict[bool, object]]):
    """Transducer that tells whether `opener` came up to REACH words before, in the same clause.

    For the symbols in `outputs` it puts out what they name for near or not; other symbols
    pass as they are.
    """
    table = {}
    for left in range(REACH + 1):
        for s in SYMBOLS:
            to = REACH if s == opener else 0 if s in (END, BREAK) else max(left - 1, 0)
            table[left, s] = to, outputs.get(s, {}).get(left > 0, s)
    return table


def negation() -> dict:
    """Insults and threats become pairs (symbol, under a negation or plain)."""
    return near(NEGATION, {s: {True: (s, NEGATED), False: (s, PLAIN)} for s in (INSULT, THREAT)})


def threat() -> dict:
    """A threat word counts after a word of intent; without one it is any word."""
    return near(INTENT, {THREAT: {True: THREAT, False: OTHER}})


def reported_speech() -> dict:
    """What follows a reporting verb in its clause, or stands in quotes on a line, is reported."""
    kinds = [(s, u) for s in (INSULT, THREAT) for u in (PLAIN, NEGATED)]
    table = {}
    for state in ("own", "told", "quoted"):
        for s in [*SYMBOLS, *kinds]:
            to = state
            if s == QUOTE:
                to = "own" if state == "quoted" else "quoted"
            elif s == BREAK or s == END and state == "told":
                to = "own"
            elif s == REPORT and state == "own":
                to = "told"
            out = (s[0], REPORTED) if isinstance(s, tuple) and state != "own" else s
            table[state, s] = to, out
    return table


def targets() -> dict:
    """At a clause's end, whether it had a target; marks pass, other symbols are dropped."""
    marked = [(s, u) for s in (INSULT, THREAT) for u in (PLAIN, NEGATED, REPORTED)]
    table = {}
    for seen in (False, True):
        for s in [*SYMBOLS, *marked]:
            if s in (END, BREAK):
                table[seen, s] = False, ("end", seen)
            else:
                out = ("mark", (s[0] == THREAT) * 3 + s[1]) if isinstance(s, tuple) else None
                table[seen, s] = seen or s == TARGET, out
    return table


def compose(first: tuple[object, dict], second: tuple[object, dict]) -> tuple[object, dict]:
    """The transducer that feeds the outputs of the first to the second: (start, table)."""
    (a, one), (b, two) = first, second
    inputs = {s for _, s in one}
    table, todo = {}, [(a, b)]
    known = set(todo)
    while todo:
        p, q = todo.pop()
        for s in inputs:
            p_to, middle = one[p, s]
            q_to, out = two[q, middle]
            table[(p, q), s] = (p_to, q_to), out
            if (p_to, q_to) not in known:
                known.add((p_to, q_to))
                todo.append((p_to, q_to))
    return (a, b), table


def grammar() -> list[list[tuple[int, int, int]]]:
    """The composed grammar: by state and symbol the next state, the mark or -1, and the end.

    The end is -1 inside a clause, else whether the clause that ends has a target.
    """
    start, table = compose(
        compose(compose((0, threat()), (0, negation())), ("own", reported_speech())), (False, targets())
    )
    number = {start: 0}
    for state, _ in table:
        number.setdefault(state, len(number))
    out = [[(0, -1, -1)] * len(SYMBOLS) for _ in number]
    for (state, s), (to, said) in table.items():
        kind, value = said or ("", -1)
        out[number[state]][s] = number[to], value if kind == "mark" else -1, int(value) if kind == "end" else -1
    return out


GRAMMAR_TABLE = grammar()
KINDS = 12


def clause_sums(text: str, tagger: Tagger) -> tuple[np.ndarray, float, int]:
    """Weights of marked words per (mark, target) kind, the heaviest clause, and the token count."""
    tokens = TOKEN.findall(text.lower())
    sums = np.zeros(KINDS)
    heaviest = 0.0
    if tagger.worth_tagging(tokens):
        state, held = 0, {}
        for symbol, weight in [*map(tagger.__getitem__, tokens), (BREAK, 0.0)]:
            state, mark, end = GRAMMAR_TABLE[state][symbol]
            if mark >= 0:
                held[mark] = held.get(mark, 0.0) + weight
            elif end >= 0 and held:
                for m, w in held.items():
                    sums[2 * m + end] += w
                heaviest = max(heaviest, sum(held.values()))
                held = {}
    return sums, heaviest, len(tokens)


FEATURES = ["bias", "plain", "targeted", "negated", "reported", "threat", "threat_qualified", "heaviest", "all", "rate", "length"]
#: Means of the coefficients before any label is seen, and how firmly they are held.
PRIOR = np.array([-4.0, 1.0, 0.3, 0.2, 0.2, 1.0, 0.2, 0.3, 0.3, 0.2, 0.0])
FIRMNESS = np.array([0.01, *[0.5] * (len(PRIOR) - 1)])


def text_features(text: str, tagger: Tagger) -> np.ndarray:
    """The vector that a text is scored by, in the order of FEATURES."""
    s, heaviest, tokens = clause_sums(text, tagger)
    total = s.sum()
    return np.array([
        1.0,
        math.log1p(s[0] + s[1]),
        math.log1p(s[1]),
        math.log1p(s[2] + s[3]),
        math.log1p(s[4] + s[5]),
        math.log1p(s[6] + s[7]),
        math.log1p(s[8:].sum()),
        heaviest / 4,
        math.log1p(total),
        math.log1p(100 * total / max(tokens, 20)),
        math.log1p(tokens) / 4 if total else 0.0,
    ])


# --- learning ----------------------------------------------------------------------


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Coefficients of greatest posterior likelihood around PRIOR, by damped Newton steps."""
    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - z @ y + 0.5 * (FIRMNESS * (w - PRIOR) ** 2).sum()

    w = PRIOR.copy()
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (p - y) + FIRMNESS * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(FIRMNESS)
        step = np.linalg.solve(curve, slope)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w


def lexicon_of(rows: Iterable, toxic: int, clean: int, least: float = 24.0) -> dict[str, float]:
    """Features that toxic texts hold surely more often, with the log odds as weight.

    `rows` are (feature, toxic texts, clean texts). Surely: twice the log likelihood ratio
    is `least` or more, which one in a million features reaches by chance. A beginning that
    nearly always goes on in one way says no more than the longer feature and is left out.
    """
    rows = [r for r in rows if r[1]]
    longer: dict[str, int] = {}
    for feature, t, _ in rows:
        word = feature.rstrip("$")
        for k in PREFIXES:
            if k < len(word):
                longer[word[:k]] = max(longer.get(word[:k], 0), t)
    out = {}
    for feature, t, c in rows:
        if not toxic or not clean or 10 * longer.get(feature, 0) >= 9 * t:
            continue
        rate = (t + c) / (toxic + clean)
        ratio = t * math.log(t / (toxic * rate)) + (c * math.log(c / (clean * rate)) if c else 0.0)
        odds = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        if odds > 1 and 2 * ratio >= least:
            out[feature] = odds
    return out


def sketch(text: str, length: int = 4) -> int:
    """The least hash of the text's runs of words: near copies mostly share it."""
    words = text.split()
    runs = (" ".join(words[i : i + length]) for i in range(max(len(words) - length, 0) + 1))
    return min(zlib.crc32(r.encode("utf-8", "surrogatepass")) for r in runs)


def labelled_sample(docs, labels, fold_out: Column, id_col, text_col, label_id, label_col, per_class: int) -> DataFrame:
    """(toxic, half, text): about `per_class` labelled texts of each class, near copies once.

    Ids are picked by hash, with a threshold per class from the class's count, so neither
    sorting nor a window is needed; the picked ids are broadcast, so texts stay where they
    are. Of texts with the same sketch and label one stays, first in each task. `half`
    splits them for fits that must not have seen a text.
    """
    known = labels.where(cell(label_col).isin(0, 1) & cell(label_id).isNotNull())
    ids = known.groupBy(cell(label_id).cast("string").alias("id")).agg(F.max(cell(label_col)).cast("int").alias("toxic"))
    ids = ids.where(~fold_out)
    counts = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, per_class / max(counts.get(1, 0), 1)).otherwise(per_class / max(counts.get(0, 0), 1))
    place = F.pmod(F.xxhash64(F.col("id"), F.lit(23)), F.lit(1 << 40)) / float(1 << 40)
    picked = ids.where(place < share)
    texts = docs.where(cell(text_col).isNotNull()).select(
        cell(id_col).cast("string").alias("id"), cell(text_col).cast("string").alias("text")
    )

    def once(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mark = (toxic, sketch(text))
                if mark not in seen:
                    seen.add(mark)
                    rows.append((*mark, text))
            yield pa.RecordBatch.from_pylist(
                [{"toxic": a, "mark": b, "text": c} for a, b, c in rows],
                schema=pa.schema([("toxic", pa.int32()), ("mark", pa.int64()), ("text", pa.string())]),
            )

    found = texts.join(F.broadcast(picked), "id").select("toxic", "text").mapInArrow(once, "toxic int, mark long, text string")
    one = found.groupBy("toxic", "mark").agg(F.min("text").alias("text"))
    return written(one.select("toxic", (F.col("mark") % 2).cast("int").alias("half"), "text"))


def count_features(sample: DataFrame) -> DataFrame:
    """(feature, t0, t1, c0, c1): texts of each class and half that hold a feature."""

    def count(batches):
        held: Counter = Counter()

        def out():
            rows = list(held.items())
            held.clear()
            arrays = [pa.array([k[i] for k, _ in rows], kind) for i, kind in ((0, pa.string()), (1, pa.int32()), (2, pa.int32()))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([n for _, n in rows], pa.int64())], names=["feature", "toxic", "half", "n"])

        for batch in batches:
            for toxic, half, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = {t for t in TOKEN.findall(text.lower()) if t[0].isalpha()}
                held.update((f, toxic, half) for f in {f for w in words for f in word_features(w)})
                if len(held) > 300_000:
                    yield out()
        yield out()

    counted = sample.mapInArrow(count, "feature string, toxic int, half int, n long")

    def number(toxic, half):
        return F.sum(F.when((F.col("toxic") == toxic) & (F.col("half") == half), F.col("n")).otherwise(0))

    return counted.groupBy("feature").agg(
        *[number(t, h).alias(f"{'ct'[t]}{h}") for t in (1, 0) for h in (0, 1)]
    )


def totals_of(totals: dict, toxic: int) -> int:
    return sum(n for (t, _), n in totals.items() if t == toxic)


def learn(sample: DataFrame, most: int = 20_000) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon of all sampled texts, and coefficients fitted on texts it was not learned from.

    Each half of the sample is described by the lexicon of the other half, so a lexicon that
    fits its own texts too well does not make the coefficients too sure. At most `most`
    features, those with the most toxic texts, reach the driver.
    """
    totals = {(r["toxic"], r["half"]): r["count"] for r in sample.groupBy("toxic", "half").count().collect()}
    if not (totals_of(totals, 0) and totals_of(totals, 1)):
        return {}, PRIOR
    often = count_features(sample).where(F.col("t0") + F.col("t1") >= 3)
    often = often.where((F.col("t0") + F.col("t1")) * totals_of(totals, 0) > (F.col("c0") + F.col("c1")) * totals_of(totals, 1))
    rows = often.orderBy(F.desc(F.col("t0") + F.col("t1")), "feature").limit(most).collect()
    halves = []
    for h in (0, 1):
        halves.append(lexicon_of(((r["feature"], r[f"t{h}"], r[f"c{h}"]) for r in rows), totals.get((1, h), 0), totals.get((0, h), 0)))
    whole = lexicon_of(
        ((r["feature"], r["t0"] + r["t1"], r["c0"] + r["c1"]) for r in rows), totals_of(totals, 1), totals_of(totals, 0)
    )
    other = [halves[1], halves[0]]

    def describe(batches):
        taggers = [Tagger(lexicon) for lexicon in other]
        for batch in batches:
            toxic, half, text = (batch.column(i).to_pylist() for i in range(3))
            x = [text_features(t, taggers[h]) for t, h in zip(text, half, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array([list(v) for v in x], pa.list_(pa.float64()))], names=["toxic", "x"])

    described = sample.mapInArrow(describe, "toxic int, x array<double>").collect()
    x = np.array([r["x"] for r in described], np.float64).reshape(-1, len(PRIOR))
    return whole, fit_logistic(x, np.array([r["toxic"] for r in described], np.float64))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "toxic",
    threshold: float = 0.3,
    per_class: int = 10_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """Each row with `held_out`, `score`, `predicted`.

    Learned from labelled rows whose id's crc32 modulo 4 is not 2: from about `per_class`
    ids of each class, picked by hash. Insults are words, and beginnings of words, that
    toxic texts hold surely more often; a text's clauses are matched by the grammar and the
    weights of what they match give a probability by logistic regression.

    Edge cases: a null text is the empty text; texts without a match get the score of no
    match. Labels other than 0 and 1, and null ids, are not learned from; an id labelled
    both ways is toxic. Repeated rows are scored alike and learned from once, as near copies
    are. Without labels of both classes the prior weights stand and no insult is known. An
    empty table gives an empty result. Extra columns are kept in `row`. The lexicon, 20,000
    features at most, reaches the tasks as a broadcast; scoring does not shuffle.
    """
    spark = docs.sparkSession
    sample = labelled_sample(
        docs, labels, held_out("id", 4, 2), id_col, text_col, label_id, label_col, per_class
    )
    model = spark.sparkContext.broadcast(learn(sample))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, weights = model.value
        tagger = Tagger(lexicon)
        for texts in batches:
            x = np.array([text_features(t, tagger) for t in texts]).reshape(-1, len(weights))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights, -40, 40))))

    kept = docs.select(*[cell(c) for c in keep or docs.columns])
    found = docs.select(
        whole_row(kept).alias("row"), held_out(id_col, 4, 2).alias("held_out"), score(whole_text(text_col)).alias("score")
    )
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
