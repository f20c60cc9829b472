"""Help for higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: a column used inside a lambda is otherwise worked out for every element."""
    return F.transform(F.array(value), body)[0]
