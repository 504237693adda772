"""The three rule functions for use in SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from assayer.functions.dates import STRICT_FORMATS, date_shape
from assayer.functions.keys import ONE_FLOAT_SUFFIX
from assayer.functions.numbers import NUMERIC, PLAIN_NUMBER


def register_functions(spark: SparkSession) -> None:
    """Temporary SQL functions `try_parse_date`, `try_parse_numeric` and `norm_id`.

    Spark puts a SQL function's body into the calling plan, so they cost no more than
    the expressions themselves.
    """
    reads = ", ".join(
        f"CASE WHEN v RLIKE r'{date_shape(p)}' THEN try_to_date(v, '{p}') END"
        for p in STRICT_FORMATS
    )
    bodies = {
        "try_parse_date(v STRING) RETURNS DATE": f"coalesce({reads})",
        f"try_parse_numeric(v STRING) RETURNS {NUMERIC}": (
            f"CASE WHEN v RLIKE r'{PLAIN_NUMBER}' THEN try_cast(v AS {NUMERIC}) END"
        ),
        "norm_id(v STRING) RETURNS STRING": (
            f"nullif(regexp_replace(btrim(v), r'{ONE_FLOAT_SUFFIX}', ''), '')"
        ),
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
