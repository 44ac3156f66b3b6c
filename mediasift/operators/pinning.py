"""Computing a column exactly once.

Spark pushes a filter through a projection by putting the column's expression
into the filter, once per mention. For a kind that takes a dozen regular
expressions to find out, that multiplies the work of the hot path. Columns
added here come out of a generator, which filters on them do not pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    # The values come from a projection, which is compiled whatever stands in it; a generator with a lambda inside is interpreted
    # node by node. The generator only hands the values on, and no rule puts a projection into a generator.
    kept = [F.col(c) for c in df.columns if c not in columns]
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, values.alias("_pinned")).select(*kept, F.inline(F.array("_pinned")))
