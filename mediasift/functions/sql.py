"""The column expressions as SQL functions.

Temporary SQL functions are expanded by the analyzer into the expressions they
stand for, so calling them from SQL costs what the DataFrame form costs. The
body of each is the SQL text of the expression itself, so there is one
definition of the semantics.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import classify as K
from . import manifests as M
from . import redaction as R
from . import urls as U

_LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'")
# An expression's text names operators like functions; quoted, they are functions.
_OPERATOR = re.compile(r"(?<![\w`])(and|or|not|>=|<=|<=>|=|>|<|!|-|\+|\*|/|%)\(")


def functions() -> dict[str, tuple[dict[str, str], Callable[..., Column]]]:
    """Name to parameters and expression."""
    text = "STRING"
    return {
        "classify": ({"url": text, "mime": text}, K.classify),
        "candidate_key": ({"url": text}, U.candidate_key),
        "family_key": ({"url": text}, U.family_key),
        "redact_text": ({"text": text}, R.redact_text),
        "stable_id": ({"value": text}, U.stable_id),
        "expand_template": (
            {"template": text, "rep_id": text, "bandwidth": "BIGINT", "number": "BIGINT", "time": "BIGINT"},
            M.expand_template,
        ),
    }


def sql_text(column: Column) -> str:
    """The expression as Spark SQL."""
    written = column._jc.node().sql()
    literals = _LITERAL.findall(written)
    pieces = [_OPERATOR.sub(r"`\1`(", piece) for piece in _LITERAL.split(written)]
    return "".join(piece + literal for piece, literal in zip(pieces, [*literals, ""]))


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the functions in this session and return their names."""
    for name, (parameters, expression) in functions().items():
        body = sql_text(expression(*[F.col(p) for p in parameters]))
        declared = ", ".join(f"{p} {kind}" for p, kind in parameters.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({declared}) RETURNS STRING RETURN {body}")
    return list(functions())
