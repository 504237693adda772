"""Labels under which a value dictionary counts missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NULL_LABEL = "[NULL]"
BLANK_LABEL = "[BLANK]"


def value_label(c: Column) -> Column:
    """Trimmed text; NULL and blank each get their own label.

    Text that literally reads `[NULL]` counts as missing.
    """
    text = F.btrim(c.cast("string"))
    return F.coalesce(F.when(text == "", BLANK_LABEL).otherwise(text), F.lit(NULL_LABEL))


def merged_label(c: Column) -> Column:
    """Trimmed text; NULL and blank share one label."""
    return F.coalesce(F.nullif(F.btrim(c.cast("string")), F.lit("")), F.lit(NULL_LABEL))


LABEL_RULES = {"split": value_label, "merged": merged_label}
