"""0-100 quality score of a scorecard row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight and cap of each penalty.
NULL_WEIGHT, NULL_CAP = 0.8, 30.0
PK_NULL_WEIGHT, PK_NULL_CAP = 2.0, 30.0
DUPLICATE_BASE, DUPLICATE_LOG_WEIGHT, DUPLICATE_CAP = 10.0, 10.0, 30.0
NEGATIVE_WEIGHT, NEGATIVE_CAP = 5.0, 20.0
ORPHAN_WEIGHT, ORPHAN_CAP = 40.0, 40.0
HALF_OPEN_DATES = 5.0


def _amount(name: str) -> Column:
    """Metric as a number; a metric that was not computed counts as 0.

    Also reads the text columns of an exported scorecard.
    """
    value = F.col(name).try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))


def _given(name: str) -> Column:
    """Whether a date is there; the blank text of an exported scorecard is none."""
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) != ""


def _capped(penalty: Column, cap: float) -> Column:
    return F.least(penalty, F.lit(cap))


def score_expr() -> Column:
    duplicates = F.floor(_amount("pk_duplicate_rows"))
    negatives, orphans, rows = map(_amount, ("neg_value_flags", "fk_orphan_rows", "row_count"))
    penalties = [
        _capped(_amount("overall_null_pct") * NULL_WEIGHT, NULL_CAP),
        _capped(_amount("pk_null_pct") * PK_NULL_WEIGHT, PK_NULL_CAP),
        F.when(
            duplicates > 0,
            _capped(DUPLICATE_BASE + F.log10(duplicates + 1.0) * DUPLICATE_LOG_WEIGHT, DUPLICATE_CAP),
        ),
        F.when(negatives > 0, _capped(negatives * NEGATIVE_WEIGHT, NEGATIVE_CAP)),
        F.when(
            (orphans > 0) & (rows > 0),
            _capped(orphans / F.nullif(rows, F.lit(0.0)) * ORPHAN_WEIGHT, ORPHAN_CAP),
        ),
        F.when(_given("date_min") != _given("date_max"), HALF_OPEN_DATES),
    ]
    left = reduce(lambda points, p: points - F.coalesce(p, F.lit(0.0)), penalties, F.lit(100.0))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), left))
    return F.bround(clamped).cast("int")  # half to even


def score(scorecard: DataFrame) -> DataFrame:
    """Scorecard with the score in place of the time stamp, or appended without one."""
    named = score_expr().alias("dq_score_0_100")
    columns = [named if c == "updated_at" else F.col(c) for c in scorecard.columns]
    return scorecard.select(*columns, *([] if "updated_at" in scorecard.columns else [named]))
