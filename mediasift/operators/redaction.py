"""The redaction job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import redaction as X
from .pinning import pin


def redact(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace the named text columns by their redacted form."""
    return df.withColumns({c: X.redact_text(F.col(c)) for c in cols})


def redact_header_maps(df: DataFrame, col: str) -> DataFrame:
    """R3."""
    return df.withColumn(col, X.redact_headers(F.col(col)))


def leak_check(redacted: DataFrame, col: str) -> DataFrame:
    """Redacted rows a rule still matches, or that change when redacted again. None are allowed."""
    checked = pin(redacted, {"_once": F.col(col)})
    checked = pin(checked, {"_again": X.redact_text(F.col("_once"))})
    return checked.filter(X.leaks(F.col("_once")) | (F.col("_again") != F.col("_once"))).drop("_once", "_again")
