"""Naming a value inside an expression.

A Python variable that holds a ``Column`` and is used five times puts five
copies of it into the plan. ``let`` evaluates it once per row instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))
