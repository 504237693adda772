"""Quality rules: robust multivariate outliers per language and source.

Statistics of each text, rules on single statistics, then minimum covariance determinant
(MCD) estimates of location and scatter per language and source, and rejection by
Mahalanobis distance.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import SPACES, whole_row, whole_text, written
from assayer.operators.shaping import cell

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: The vector that is judged: shrunk ratios to the words, on a scale on which ordinary
#: documents scatter alike whatever their size, and the least standard deviation that each
#: is held to have, so that a ratio that is 0 in most documents has a finite distance.
VECTOR = ["word_length", "symbols", "dup_lines", "repeats"]
LEAST_SPREAD = [0.03, 0.06, 0.06, 0.08]


def repeated_words(words: list[bytes], n: int = WINDOW_WORDS) -> int:
    """Words inside windows of n words that occur twice or more, first occurrences included.

    Windows are ranked exactly by doubling: equal pairs, then fours, then eights.
    """
    if len(words) <= n:
        return 0
    table: dict[bytes, int] = {}
    ranks = np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words))
    span = 1
    while span < n:
        step = min(span, n - span)
        pairs = ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:]
        ranks = np.unique(pairs, return_inverse=True)[1]
        span += step
    often = np.bincount(ranks)[ranks] > 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(often)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + n, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """The counts in the order of COUNTS."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def counts_of(text: Column) -> Column:
    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t) for t in texts], columns=COUNTS, dtype="int64")

    return run(text)


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )


# --- minimum covariance determinant over tables -----------------------------------


def _moments(columns: list[str]) -> list[Column]:
    """Sums that mean and covariance follow from; mergeable, a row per group and task."""
    out = [F.count("*").cast("double").alias("m")]
    for i, a in enumerate(columns):
        out.append(F.sum(a).alias(f"s{i}"))
        out += [F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for j, b in enumerate(columns) if j <= i]
    return out


def _estimates(sums: DataFrame, keys: list[str], least: list[float]) -> DataFrame:
    """Per group the mean, the inverse of the scatter as a flat array, and the log determinant.

    `least` bounds the scatter from below along each axis, which also keeps groups
    invertible in which a column is constant.
    """
    p = len(least)
    floor = np.diag(np.square(least))

    @F.pandas_udf("mean array<double>, inverse array<double>, logdet double")
    def solve(flat: pd.Series) -> pd.DataFrame:
        rows = []
        for v in flat:
            m, k = v[0], 1
            mean, second = np.zeros(p), np.zeros((p, p))
            for i in range(p):
                mean[i], k = v[k] / m, k + 1
                for j in range(i + 1):
                    second[i, j] = second[j, i] = v[k] / m
                    k += 1
            scatter = second - np.outer(mean, mean) + floor
            rows.append((mean, np.linalg.inv(scatter).ravel(), np.linalg.slogdet(scatter)[1]))
        return pd.DataFrame(rows, columns=["mean", "inverse", "logdet"])

    names = [c for c in sums.columns if c == "m" or c[0] == "s" and c[1].isdigit()]
    return sums.select(*keys, solve(F.array(*names)).alias("e")).select(*keys, "e.*")


def _distance(columns: list[str]) -> Column:
    """Squared Mahalanobis distance by the columns `mean` and `inverse`."""
    p = len(columns)
    d = [F.col(c) - F.get("mean", F.lit(i)) for i, c in enumerate(columns)]
    terms = [
        d[i] * d[j] * F.get("inverse", F.lit(i * p + j)) * (1 if i == j else 2)
        for i in range(p)
        for j in range(i + 1)
    ]
    return F.greatest(reduce(lambda a, b: a + b, terms), F.lit(0.0))


#: Distances are ranked in bins of a 64th of an e-fold: a few thousand per group at most.
BINS_PER_E, LOWEST = 64, -20


def _bin(distance: Column) -> Column:
    return F.floor(F.log(distance + math.exp(LOWEST)) * BINS_PER_E).cast("int")


def _bin_top(bin_: Column) -> Column:
    return F.exp((bin_ + 1) / BINS_PER_E) - math.exp(LOWEST)


def _nearest(by_bin: DataFrame, keys: list[str], part: float) -> DataFrame:
    """The bins that hold the nearest `part` of each group's rows, with `share`, what is
    needed of each: all but of the last."""
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    need = F.ceil(F.col("rows") * part) - F.col("before")
    return (
        by_bin.withColumn("before", F.coalesce(F.sum("m").over(upto), F.lit(0.0)))
        .withColumn("rows", F.sum("m").over(whole))
        .where(need > 0)
        .withColumn("share", F.least(need / F.col("m"), F.lit(1.0)))
    )


def _medians(points: DataFrame, group: str, columns: list[str], least: list[float]) -> DataFrame:
    """Per group `mean`, the medians of the columns, and `spread`, their scaled median
    deviations, `least` at least; in bins of an eighth of `least`."""
    p = len(columns)
    width = F.element_at(F.array(*[F.lit(s / 8) for s in least]), F.col("axis") + 1)
    cells = F.array(
        *[F.struct(F.lit(i).alias("axis"), F.floor(F.col(c) * (8 / s)).alias("bin")) for i, (c, s) in enumerate(zip(columns, least, strict=True))]
    )
    keys = [group, "axis"]
    bins = points.select(group, F.explode(cells).alias("c")).groupBy(group, "c.axis", "c.bin").agg(F.count("*").cast("double").alias("m"))
    bins = written(bins)
    middle = _nearest(bins, keys, 0.5).groupBy(*keys).agg(F.max("bin").alias("middle"))
    off = bins.join(middle, keys).select(*keys, "middle", F.abs(F.col("bin") - F.col("middle")).alias("bin"), "m")
    off = off.groupBy(*keys, "middle", "bin").agg(F.sum("m").alias("m"))
    found = _nearest(off, [*keys, "middle"], 0.5).groupBy(*keys, "middle").agg(F.max("bin").alias("off"))
    spread = F.greatest(1.4826 * F.col("off") * width, width * 8)
    one = found.select(group, F.struct("axis", ((F.col("middle") + 0.5) * width).alias("mean"), spread.alias("spread")).alias("a"))
    one = one.groupBy(group).agg(F.array_sort(F.collect_list("a")).alias("a")).where(F.size("a") == p)
    return one.select(group, F.col("a.mean").alias("mean"), F.col("a.spread").alias("spread"))


def mcd(
    points: DataFrame,
    group: str,
    columns: list[str],
    least: list[float],
    support: float = 0.75,
    steps: int = 6,
) -> DataFrame:
    """Per group: `group`, `rows`, `mean`, `inverse`, `logdet` and `unit`.

    Concentration steps from two starts, the half of the rows nearest to the medians of the
    columns on axes scaled by their median deviations, and on axes scaled by `least`:
    distances by the last estimate, the nearest `support` of the rows, their mean and
    covariance. The start that ends with the smaller determinant wins. With a support of a
    half, rows far out that are fewer than half of a group take no part, alike or not. `unit` is the median squared distance over the chi-square
    median, which makes distances comparable to a chi-square variable.

    A step reads all points once and aggregates them by group and distance bin, combined
    before the shuffle; what a group sends on is bounded by its bins, whatever its rows.
    Of the bin that crosses `support` only the needed share counts: its sums are weighted.
    """
    sums = _moments(columns)
    keys = [group, "start"]

    def refit(estimates, part):
        found = points.join(estimates, group).withColumn("bin", _bin(_distance(columns)))
        by_bin = found.groupBy(*keys, "bin").agg(*sums)
        names = [c for c in by_bin.columns if c not in [*keys, "bin"]]
        near = _nearest(by_bin, keys, part).groupBy(*keys).agg(*[F.sum(F.col(c) * F.col("share")).alias(c) for c in names])
        return written(_estimates(near, keys, least))

    first = written(_medians(points, group, columns, least))
    p = len(least)

    def axes(scale):
        return F.array(*[1 / scale(i) ** 2 if i == j else F.lit(0.0) for i in range(p) for j in range(p)])

    starts = [axes(lambda i: F.get("spread", F.lit(i))), axes(lambda i: F.lit(least[i]))]
    now = refit(
        first.select(group, "mean", F.explode(F.array(*[F.struct(F.lit(i).alias("start"), a.alias("inverse")) for i, a in enumerate(starts)])).alias("s"))
        .select(group, "mean", "s.*"),
        0.5,
    )
    for _ in range(steps):
        now = refit(now, support)
    best = now.groupBy(group).agg(F.min_by(F.struct("mean", "inverse", "logdet"), F.struct("logdet", "start")).alias("e"))
    best = best.select(group, "e.*")

    found = points.join(best, group).withColumn("bin", _bin(_distance(columns)))
    by_bin = found.groupBy(group, "bin").agg(F.count("*").cast("double").alias("m"))
    half = _nearest(by_bin, [group], 0.5).groupBy(group).agg(
        F.max("rows").alias("rows"), F.max(_bin_top(F.col("bin"))).alias("median")
    )
    chi_median = p * (1 - 2 / (9 * p)) ** 3
    return best.join(half, group).withColumn("unit", F.greatest(F.col("median") / chi_median, F.lit(1.0))).drop("median")


def pooled(fits: DataFrame, groups: DataFrame, least: list[float], shrink_rows: int, first_rows: int = 20, wide: float = 10.0) -> DataFrame:
    """(k2, rows, mean, inverse, unit): each group's estimate, pooled with wider groups'.

    `fits` is what `mcd` returns; `groups` has the keys `k0`, `k1` and `k2` of all, a
    language and a language and source. A group is judged as if `shrink_rows` more of its
    rows were spread as its language's are, and a language likewise of all; all rows have
    `first_rows` more, about their own mean, `wide` times as far as `least`. The pooled
    scatter includes the distance between the means, so the middle of a small group is
    never far out. No group is too small or large for this rule: with rows, the weight of
    the wider group falls.
    """
    p = len(least)
    prior = np.diag(np.square(np.array(least) * wide))

    @F.pandas_udf("rows double, mean array<double>, inverse array<double>, unit double")
    def pool(levels: pd.Series) -> pd.DataFrame:
        out = []
        for flat in levels:
            per_level = np.asarray(flat, dtype=float).reshape(3, -1)
            mean, scatter, unit, added = per_level[0][2 : 2 + p], prior, 1.0, first_rows
            for level in per_level:
                own = np.linalg.inv(level[2 + p :].reshape(p, p))
                w = level[0] / (level[0] + added)
                off = level[2 : 2 + p] - mean
                mean = mean + w * off
                scatter = w * own + (1 - w) * scatter + w * (1 - w) * np.outer(off, off)
                unit, added = w * level[1] + (1 - w) * unit, shrink_rows
            out.append((per_level[2][0], mean, np.linalg.inv(scatter).ravel(), unit))
        return pd.DataFrame(out, columns=["rows", "mean", "inverse", "unit"])

    found = groups
    for level in ("k0", "k1", "k2"):
        flat = F.concat(F.array("rows", "unit"), "mean", "inverse").alias(f"fit_{level}")
        found = found.join(fits.select(F.col("key").alias(level), flat), level)
    return found.select("k2", pool(F.concat("fit_k0", "fit_k1", "fit_k2")).alias("e")).select("k2", "e.*")


def chi_square_cut(degrees: int, normal_quantile: float) -> float:
    """Wilson-Hilferty: the chi-square quantile at a quantile of the normal distribution."""
    share = 2 / (9 * degrees)
    return degrees * (1 - share + normal_quantile * math.sqrt(share)) ** 3


def judge_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    shrink_rows: int = 200,
    shrink_words: int = 100,
    normal_quantile: float = 4.0,
    support: float = 0.5,
    keep: list[str] | None = None,
) -> DataFrame:
    """Each row with its counts, `base_failed`, `distance` and `kept`.

    Returns `row` (the caller's columns, or those named in `keep`), the counts of COUNTS,
    `base_failed`, `group_rows` (rows of its language and source that were fitted),
    `distance` (squared, in chi-square units) and `kept`.

    A row that fails the base rules is not kept and takes no part in any estimate. The
    others are vectors of four ratios to the words: mean word length (log), symbols,
    duplicate lines and repeated words (square roots). Each ratio is shrunk towards its
    language's by `shrink_words` words, so that short texts do not scatter more than long
    ones. Estimates are fitted per language and source, per language, and over all; each
    is pooled with `shrink_rows` rows of the next wider one (`pooled`). Rejected is a
    distance beyond the chi-square quantile at `normal_quantile` standard deviations.

    Edge cases: a null text has no words and fails the base rules; null languages and
    sources are groups like any other; repeated rows count each; an empty table gives an
    empty result. Texts are read once, in Arrow batches; all later passes are over the
    counts, written as a table. A source with a third of all rows is a few thousand bins.
    """
    kept_columns = docs.select(*[cell(c) for c in keep or docs.columns])
    key = lambda *cols: F.to_json(F.array(*[cell(c).cast("string") for c in cols]), {"ignoreNullFields": "false"})
    counted = docs.select(
        whole_row(kept_columns).alias("row"),
        key(lang_col, source_col).alias("k2"),
        key(lang_col).alias("k1"),
        F.lit("*").alias("k0"),
        counts_of(whole_text(text_col)).alias("c"),
    )
    counted = written(counted.select("row", "k0", "k1", "k2", "c.*").withColumn("base_failed", base_failed()))

    passed = counted.where("NOT base_failed")
    n = F.col("n_words")
    rates = passed.groupBy("k1").agg(
        *[(F.sum(c) / F.sum("n_words")).alias(f"rate_{c}") for c in COUNTS[1:]]
    )
    ratio = {c: (F.col(c) + shrink_words * F.col(f"rate_{c}")) / (n + shrink_words) for c in COUNTS[1:]}
    vector = {
        "word_length": F.log(F.greatest(ratio["word_chars"], F.lit(1e-9))),
        "symbols": F.sqrt(ratio["n_symbols"]),
        "dup_lines": F.sqrt(ratio["n_dup_lines"]),
        "repeats": F.sqrt(ratio["n_repeat_words"]),
    }
    every = counted.join(rates, "k1", "left").select(
        *counted.columns, *[v.alias(c) for c, v in vector.items()]
    )
    every = written(every)
    points = every.where("NOT base_failed").select(
        F.explode(F.array("k0", "k1", "k2")).alias("key"), *VECTOR
    )
    fits = written(mcd(points, "key", VECTOR, LEAST_SPREAD, support))
    groups = every.where("NOT base_failed").select("k0", "k1", "k2").distinct()
    judged = every.join(written(pooled(fits, groups, LEAST_SPREAD, shrink_rows)), "k2", "left")
    cut = chi_square_cut(len(VECTOR), normal_quantile)
    return judged.withColumn("distance", _distance(VECTOR) / F.col("unit")).select(
        "row",
        *COUNTS,
        "base_failed",
        F.col("rows").alias("group_rows"),
        "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).alias("kept"),
    )
