"""Line dedup: lines that many documents share stay in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import SPACES, ascii_lower, unpack, whole_row, whole_text, written
from assayer.operators.shaping import cell


def line_key(line: Column) -> Column:
    """What makes two lines the same: white space at the ends and the case of A-Z don't count."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hashes(text: Column, min_chars: int) -> Column:
    """(h1, h2, pos) for every line of a text whose key is long enough to be judged: 128 bits
    of the key and the line's position, in their order.

    Step by step, because what a lambda names twice is computed twice.
    """
    trimmed = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)))
    keys = F.transform(trimmed, ascii_lower)
    hashed = F.transform(
        keys,
        lambda k, i: F.struct(
            F.when(F.length(k) >= min_chars, F.xxhash64(k)).alias("h1"),
            F.xxhash64(F.lit(1), k).alias("h2"),
            i.alias("pos"),
        ),
    )
    return F.array_sort(F.filter(hashed, lambda h: h["h1"].isNotNull()))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 3,
    min_chars: int = 20,
) -> DataFrame:
    """Each row with its `text` less the lines that it shares, and what was dropped.

    Texts are split at \\n. A line whose key has `min_chars` code points or more and occurs
    in at least `min_docs` rows is dropped from all rows but those with the largest id that
    holds it; there all its repeats stay. Returns `row` (the caller's columns as a struct),
    `kept` (the remaining lines joined by \\n), `n_lines`, `n_dropped`.

    Edge cases: a null or empty text is one empty line. Each row counts as a document, also
    if its id repeats; a null id is below all others. If every line is dropped `kept` is
    empty. An empty table gives an empty result.

    Lines are hashed once and written as a table of 128-bit hashes. Per hash only a count
    and the largest id are aggregated, combined before the shuffle, so a line that a third
    of all documents share is a row per task. The shared ones are a table too; the join back
    is one of hashes, without text, and its hot keys are split by the adaptive join, which
    needs both sides shuffled for it.
    Dropped positions meet their text by id and text hash: one shuffle of the text.
    """
    rows = docs.select(
        whole_row(docs).alias("row"),
        cell(id_col).alias("id"),
        F.xxhash64(whole_text(text_col)).alias("tk"),
    )
    hashed = docs.select(
        cell(id_col).alias("id"),
        F.xxhash64(whole_text(text_col)).alias("tk"),
        _hashes(whole_text(text_col), min_chars).alias("lines"),
    )

    def with_first(line, i):
        before = F.get("lines", i - 1)
        same = (before["h1"] == line["h1"]) & (before["h2"] == line["h2"])
        first = ~F.coalesce(same, F.lit(False))
        return F.struct(*[line[c].alias(c) for c in ("h1", "h2", "pos")], first.alias("first"))

    # The outer form, because a filter that Spark infers for the other hashes all lines again.
    marked = hashed.select("id", "tk", F.transform("lines", with_first).alias("lines"))
    lines = marked.select("id", "tk", F.explode_outer("lines").alias("h"))
    lines = written(lines.where("h IS NOT NULL").select("id", "tk", "h.*"))
    shared = written(
        lines.where("first")
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("docs"), F.max("id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
    )
    dropped = (
        lines.join(shared, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "tk")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    joined = rows.alias("r").join(
        dropped.alias("d"),
        F.col("r.id").eqNullSafe(F.col("d.id")) & (F.col("r.tk") == F.col("d.tk")),
        "left",
    )
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    split = F.split(text, "\n", -1)
    positions = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("dropped"))
    remaining = F.transform(positions, lambda p: F.get(split, p))
    return joined.select(
        "row",
        F.when(F.col("dropped").isNull(), text)
        .otherwise(F.array_join(remaining, "\n"))
        .alias("kept"),
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def without_shared_lines(docs: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """The same rows and columns, with the shared lines taken out of the text."""
    found = dedup_lines(docs, text_col=text_col, **rules)
    return unpack(found, docs.columns, **{text_col: F.col("kept")})
