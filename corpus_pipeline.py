"""The corpus pipeline: stages that each read what the one before has kept.

Language ID drops documents without a language, line dedup takes shared lines out of
texts, near-dedup keeps one document of each group of near copies, decontamination drops
documents in which a passage of the benchmark occurs, and byte-level BPE encodes the rest.
All stages but the last return the columns of `documents`. Repeated rows, null ids and empty
tables are no special cases; near-dedup leaves one of rows that repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import unpack, written
from assayer.llm.decontamination import without_contaminated
from assayer.llm.langid import UNKNOWN, identify
from assayer.llm.line_dedup import without_shared_lines
from assayer.llm.queries import documents, encoded
from assayer.llm.simhash import one_of_each

#: SQL that gives the rows of run(): none, as language ID and near-dedup have no SQL form.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, mixtures of several included; those without one go.

    Those are null and empty texts and texts without a letter.
    """
    found = identify(docs)
    return unpack(found.where(F.col("lang_pred") != UNKNOWN), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines go from all documents but one; n_chars follows the new text.

    A document whose lines all go stays with an empty text, as does one with a null text.
    """
    return without_shared_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group whose fingerprints link.

    Fingerprints are of four-word shingles and link at four differing bits, as in op9. Null
    and empty texts are copies of each other.
    """
    return one_of_each(docs, shingle=4, max_distance=4)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; texts without a word stay."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them."""
    return encoded(docs)


STAGES = [
    ("language ID", languages),
    ("line dedup", lines),
    ("near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
