"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import ascii_lower, text_key, whole_row, whole_text, written
from assayer.operators.bloom import block_count, build_filter, might_match
from assayer.operators.shaping import cell, union_all

#: Everything but digits, letters and characters beyond ASCII separates words. The texts are
#: in lower case by then, so A-Z need not be named.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KGRAM = 4
#: Windows are broadcast if they have on average so many bytes at most, and few rows.
WINDOW_BYTES = 100


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS, -1), "")


def _shifted(values: Column, by: int, combine) -> Column:
    """combine(values[i], values[i + by]) for every i that has both."""
    short = F.size(values) <= by
    pairs = F.zip_with(
        F.slice(values, 1, F.greatest(F.size(values) - by, F.lit(0))),
        F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0))),
        combine,
    )
    return F.when(short, F.array().cast("array<bigint>")).otherwise(pairs)


def _grown(df: DataFrame, column: str, length: int, combine) -> DataFrame:
    """`column` of single values becomes that of runs of `length`, doubling as far as it goes."""
    span = 1
    while span < length:
        step = min(span, length - span)
        df = df.withColumn(column, _shifted(F.col(column), step, combine))
        span += step
    return df


def window_minima(df: DataFrame, lengths: list[int], k: int = KGRAM) -> DataFrame:
    """Adds `minima_n` for each n of `lengths`: for every window of n words the least hash
    of its k-grams, or the hash of the window where n is less than k.

    Winnowing: equal windows have equal minima, so whatever spans n equal words in two
    texts shares a minimum, while the distinct minima of a text are few. Words are hashed
    once, and windows of all lengths of k and more share their k-grams.
    """
    df = df.withColumn("grams_1", F.transform("words", lambda w: F.xxhash64(w)))
    for size in sorted({min(k, n) for n in lengths} - {1}):
        df = _grown(df.withColumn(f"grams_{size}", F.col("grams_1")), f"grams_{size}", size, lambda a, b: F.xxhash64(a, b))
    for n in lengths:
        size = min(k, n)
        df = df.withColumn(f"minima_{n}", F.col(f"grams_{size}"))
        df = _grown(df, f"minima_{n}", n - size + 1, lambda a, b: F.least(a, b))
    return df


def benchmark_windows(
    benchmark: DataFrame, item_col: str, text_col: str, length: int
) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (`length`, `minimum`, `window`, `window_id`) and their items.

    An item of fewer words than `length`, but not none, is one window of its own length.
    """
    items = benchmark.select(
        cell(item_col).alias("item"), words(whole_text(text_col)).alias("words")
    ).where(F.size("words") > 0)
    items = items.withColumn("length", F.least(F.size("words"), F.lit(length)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    cut = items.select(
        "item",
        "length",
        F.explode(
            F.transform(starts, lambda s: F.array_join(F.slice("words", s, F.col("length")), " "))
        ).alias("window"),
    )
    cut = cut.withColumns(dict(zip(("w1", "w2"), text_key(F.col("window")), strict=True)))
    cut = written(cut.groupBy("length", "window", "w1", "w2", "item").agg(F.count("*").alias("n")))
    return cut.groupBy("length", "window", "w1", "w2").agg(F.count("*").alias("items")), cut


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    length: int = 10,
    broadcast_rows: int = 200_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """Each row with `n_words`, `n_hit`, `items` and `hits`.

    A window is `length` consecutive words of an item, or the whole of a shorter one. A
    word of a document is hit if it lies in an occurrence of any window; `hits` are the
    starts and lengths of the occurrences, `items` the distinct items whose windows occur,
    sorted as strings. Words are in ASCII lower case, without what separates them.

    Winnowing finds all of them: every window keeps the least hash of its k-grams; the
    distinct minima of each document meet those of the benchmark in an equality join, and
    where one is shared the document's windows with that minimum are compared word for
    word with the benchmark's. Windows of all lengths that items have, at most `length`,
    are done in the same pass; a minimum that meets one of another length finds no equal
    window.

    Edge cases: a null text, of a document or an item, has no words and no hits; a null
    item id is reported as the string "null"; repeated items and rows count each; an empty
    benchmark hits nothing; an empty table gives an empty result.

    The first join moves minima, not text. The benchmark's side is broadcast if it has at
    most `broadcast_rows` rows, and of windows at most WINDOW_BYTES bytes for each, else
    both are shuffled and hot minima split by the adaptive join. Texts with a shared minimum move once, to meet the minima found in them; the others are
    left out before by a Bloom filter of bounded size. Hits of a document are aggregated
    per document; they are bounded by its words.
    """
    windows, of_items = benchmark_windows(benchmark, item_col, item_text_col, length)
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    kept = docs.select(*[cell(c) for c in keep or docs.columns])
    k1, k2 = text_key(whole_text(text_col))
    rows = docs.select(
        whole_row(kept).alias("row"), cell(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"),
        F.size(words(whole_text(text_col))).cast("long").alias("n_words"),
    )
    texts = docs.select(
        k1.alias("k1"), k2.alias("k2"), cell(id_col).alias("id"), whole_text(text_col).alias("text")
    )
    if not lengths:
        none = F.array().cast("array<string>")
        return rows.select(
            "row", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"),
            F.array().cast("array<struct<start:int,length:int>>").alias("hits"),
        )
    split = windows.withColumn("words", F.split("window", " ", -1))
    wanted = written(
        union_all([
            window_minima(split.where(F.col("length") == n), [n]).select(
                F.get(f"minima_{n}", F.lit(0)).alias("minimum"), "window", "w1", "w2"
            )
            for n in lengths
        ])
    )

    # Outer forms of explode: for the others Spark infers a filter that hashes all again.
    prints = window_minima(texts.select("k1", "k2", "id", words(F.col("text")).alias("words")), lengths)
    distinct = F.array_distinct(F.concat(*[F.col(f"minima_{n}") for n in lengths]))
    shared = written(
        prints.select("k1", "k2", "id", F.explode_outer(distinct).alias("minimum"))
        .join(small(wanted.select("minimum").distinct()), "minimum", "left_semi")
        .groupBy("k1", "k2")
        .agg(F.collect_set("minimum").alias("shared"), F.min("id").alias("first"))
    )
    blocks = block_count(shared.count())
    likely = might_match(texts, F.col("k1"), build_filter(shared, "k1", blocks), blocks).alias("t")
    # One of the rows that share a text speaks for all.
    first = (F.col("t.k1") == F.col("s.k1")) & (F.col("t.k2") == F.col("s.k2"))
    first &= F.col("t.id").eqNullSafe(F.col("s.first"))
    again = likely.join(shared.alias("s"), first).select("t.k1", "t.k2", words(F.col("t.text")).alias("words"), "shared")

    def placed(n: int) -> Column:
        return F.transform(
            f"minima_{n}",
            lambda m, i: F.struct(F.lit(n).alias("length"), i.alias("start"), m.alias("minimum")),
        )

    places = F.concat(*[placed(n) for n in lengths])
    places = window_minima(again, lengths).select("k1", "k2", "shared", "words", F.explode_outer(places).alias("at"))
    places = places.where(F.array_contains("shared", F.col("at.minimum"))).select(
        "k1", "k2", "at.start", "at.length",
        F.array_join(F.slice("words", F.col("at.start") + 1, F.col("at.length")), " ").alias("window"),
    )
    # The hashes of a window are what is joined by; its words are compared with the item's.
    places = places.withColumns(dict(zip(("w1", "w2"), text_key(F.col("window")), strict=True)))
    bytes_ = wanted.agg(F.sum(F.octet_length("window"))).first()[0]
    exact = wanted.select("w1", "w2", "window")
    exact = F.broadcast(exact) if bytes_ <= broadcast_rows * WINDOW_BYTES and wanted.count() <= broadcast_rows else exact
    hits = written(
        places.join(exact, ["w1", "w2", "window"]).select("k1", "k2", "start", "length", "w1", "w2")
    )
    spans = written(
        hits.groupBy("k1", "k2").agg(
            F.array_sort(F.collect_set(F.struct("start", "length"))).alias("hits")
        )
    )
    items = written(
        hits.select("k1", "k2", "w1", "w2").distinct()
        .join(small(of_items.select("w1", "w2", "item")), ["w1", "w2"])
        .select("k1", "k2", F.coalesce(F.col("item").cast("string"), F.lit("null")).alias("item"))
        .groupBy("k1", "k2")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return (
        rows.join(spans, ["k1", "k2"], "left")
        .join(items, ["k1", "k2"], "left")
        .select(
            "row",
            "n_words",
            F.coalesce(covered(F.col("hits")), F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("hits", F.array().cast("array<struct<start:int,length:int>>")).alias("hits"),
        )
    )


def covered(hits: Column) -> Column:
    """Words inside sorted (start, length) spans, each counted once."""

    def add(so_far, span):
        end = span["start"] + span["length"]
        new = F.greatest(end - F.greatest(span["start"], so_far["end"]), F.lit(0))
        return F.struct((so_far["n"] + new).alias("n"), F.greatest(end, so_far["end"]).alias("end"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(hits, zero, add, lambda x: x["n"])


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, **rules
) -> DataFrame:
    """The rows in which no window of the benchmark occurs.

    Edge cases: rows without words are kept, with their null or empty text; repeated rows
    are kept or left out alike; an empty benchmark keeps all, an empty table is empty; all
    columns stay, whatever their names.
    """
    found = find_benchmark(docs, benchmark, **rules).where(F.col("n_hit") == 0)
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
