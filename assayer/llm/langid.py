"""Language ID: each document's mixture of languages, by expectation-maximisation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import whole_row, whole_text
from assayer.operators.shaping import cell

#: n-grams of bytes are counted in this many hashed cells.
NGRAM, CELL_BITS = 3, 16
CELLS = 1 << CELL_BITS
UNKNOWN = "und"
#: Bytes other than letters become spaces; bytes above 127 belong to letters and stay.
_LETTERS = bytes(
    c if c > 127 or chr(c).isalpha() else 32 for c in range(256)
)


def ngram_cells(text: str) -> np.ndarray:
    """Hashed cells of all byte n-grams of a text in lower case that hold a letter."""
    raw = (" " + text.lower() + " ").encode("utf-8", "surrogatepass").translate(_LETTERS)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = code[(code != 0x202020)]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - CELL_BITS)).astype(np.int32)


def fit_mixture(probs: np.ndarray, counts: np.ndarray, steps: int, slack: float):
    """Shares of the languages (rows of `probs`) that maximise the likelihood of the cells.

    Expectation-maximisation until the likelihood can gain `slack` nats at most, which the
    likelihood's gradient tells, or `steps` are done. Returns shares and log likelihood.
    """
    shares = np.full(len(probs), 1 / len(probs))
    total = counts.sum()
    mixed = shares @ probs
    for _ in range(steps):
        weight = counts / mixed
        slopes = (probs @ weight) / total
        if total * math.log(max(float(slopes.max()), 1.0)) <= slack:
            break
        shares = shares * slopes
        mixed = shares @ probs
    return shares, float(counts @ np.log(mixed))


def select_languages(logp: np.ndarray, probs: np.ndarray, cells: np.ndarray, steps: int = 60):
    """(index of the leading language, its share, shares of all) of one text.

    Language sets are compared by log likelihood less half a log of the n-gram count per
    further language (overlapping n-grams share bytes, so a third of them is counted as
    independent). All languages are fitted first; sets grow along their shares, and the
    first set that no further language improves is chosen.
    """
    distinct, counts = np.unique(cells, return_counts=True)
    counts = counts.astype(np.float64)
    table, logs = probs[:, distinct], logp[:, distinct]
    single = logs @ counts
    best = int(np.argmax(single))
    shares = np.zeros(len(probs))
    shares[best] = 1.0
    if len(probs) == 1:
        return best, 1.0, shares
    price = NGRAM * 0.5 * math.log(max(len(cells) / NGRAM, math.e))
    mixture, likelihood = fit_mixture(table, counts, steps, price / 10)
    if likelihood + price / 10 - single[best] <= price:
        return best, 1.0, shares
    order = [int(i) for i in np.argsort(-mixture, kind="stable")]
    score = float(single[best])
    for size in range(2, len(order) + 1):
        members = order[:size]
        part, likelihood = fit_mixture(table[members], counts, steps, price / 10)
        if likelihood - (size - 1) * price <= score:
            break
        score = likelihood - (size - 1) * price
        shares[:] = 0
        shares[members] = part
    best = int(np.argmax(shares))
    return best, float(shares[best]), shares


def held_out(id_col: str, folds: int = 3, fold: int = 1) -> Column:
    """Whether a document is kept from learning: by the crc32 of its id as text."""
    return F.coalesce(F.crc32(cell(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_sample(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int
) -> DataFrame:
    """At most `per_language` documents of each language: those with the least id hashes.

    Rows of one language with the same id hash count once. How many ids a language has is
    estimated by mergeable sketches; of hashes below a bound that some twice as many as
    wanted are under, the least are ranked, so no task ranks more than those, however large
    a language is. The driver sees numbers per language.
    """
    hashed = docs.where(cell(lang_col).isNotNull() & cell(text_col).isNotNull()).select(
        cell(lang_col).cast("string").alias("lang"),
        F.xxhash64(cell(id_col).cast("string"), F.lit(11)).alias("h"),
        cell(text_col).cast("string").alias("text"),
    )
    sizes = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return hashed.where(F.lit(False)).select("lang", "text")
    shares = [F.lit(x) for lang, n in sizes.items() for x in (lang, (2 * per_language + 200) / max(n, 1))]
    place = F.col("h") / float(1 << 64) + 0.5
    by_hash = Window.partitionBy("lang").orderBy("h")
    least = (
        hashed.select("lang", "h")
        .where(place < F.element_at(F.create_map(*shares), F.col("lang")))
        .distinct()
        .withColumn("n", F.row_number().over(by_hash))
        .where(F.col("n") <= per_language)
    )
    cuts = {r["lang"]: r["cut"] for r in least.groupBy("lang").agg(F.max("h").alias("cut")).collect()}
    if not cuts:
        return hashed.where(F.lit(False)).select("lang", "text")
    pairs = [F.lit(x) for pair in cuts.items() for x in pair]
    cut = F.element_at(F.create_map(*pairs), F.col("lang"))
    return hashed.where(F.col("h") <= cut).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def learn(sample: DataFrame, smoothing: float = 0.5, max_languages: int = 500):
    """Languages and the log probabilities of their cells, (languages, CELLS) as float64.

    The sample's documents are counted where they are; each task sends one row of CELLS
    counts per language, and these are added up per language and slice of cells.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = sums.setdefault(lang, np.zeros(CELLS, np.int64))
                row += np.bincount(ngram_cells(text), minlength=CELLS)
        for lang, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(row[at])],
                names=["lang", "cell", "n"],
            )

    counted = sample.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    # At most CELLS pairs a language.
    rows = counted.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells")).limit(max_languages + 1).toArrow()
    if rows.num_rows > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn")
    rows = rows.sort_by("lang")
    table = np.full((rows.num_rows, CELLS), smoothing)
    for i, cells in enumerate(rows["cells"]):
        table[i, np.asarray(cells.values.field("cell"))] += np.asarray(cells.values.field("n"))
    return rows["lang"].to_pylist(), np.log(table / table.sum(axis=1, keepdims=True))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 1500,
    keep: list[str] | None = None,
) -> DataFrame:
    """Each row with `held_out`, `lang_pred`, `score` and `languages`.

    A document's language shares are those that maximise the likelihood of its byte
    n-grams as draws from a mixture of the languages' models; the set of languages is
    chosen by penalised likelihood. `languages` is the map of chosen languages to shares,
    `lang_pred` the one with the largest share and `score` that share.

    Models are learned from the text and non-null language of rows whose id's crc32 modulo
    3 is not 1, from at most `per_language` documents of each language, those with the
    least id hashes; every document counts whole. Nothing but the text enters a prediction.

    Edge cases: a null text, or one without a letter, is `und` with score 0 and no
    languages, as is every text if nothing could be learned. A null id takes part in
    learning. Repeated rows are predicted alike and learned from once. An empty table gives
    an empty result. More than 500 languages are an error, so the model, 0.5 MB per
    language, has a bound; it reaches the tasks as a broadcast. Prediction does not shuffle.
    """
    spark = docs.sparkSession
    sample = training_sample(docs.where(~held_out(id_col)), id_col, text_col, lang_col, per_language)
    languages, logp = learn(sample)
    model = spark.sparkContext.broadcast((languages, logp.astype(np.float64)))

    @F.pandas_udf("lang_pred string, score double, languages map<string,double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, logs = model.value
        probs = np.exp(logs)
        rows = []
        for text in texts:
            cells = ngram_cells(text) if any(map(str.isalpha, text)) else ()
            if not len(cells) or not names:
                rows.append((UNKNOWN, 0.0, {}))
                continue
            best, share, shares = select_languages(logs, probs, cells)
            chosen = {names[i]: float(s) for i, s in enumerate(shares) if s > 0}
            rows.append((names[best], min(share, 1.0), chosen))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "languages"])

    kept = docs.select(*[cell(c) for c in keep or docs.columns])
    found = docs.select(
        whole_row(kept).alias("row"),
        held_out(id_col).alias("held_out"),
        predict(whole_text(text_col)).alias("p"),
    )
    return found.select("row", "held_out", "p.lang_pred", "p.score", "p.languages")
