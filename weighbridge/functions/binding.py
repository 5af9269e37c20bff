"""Name an expression once inside a larger one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column expression used n times is n copies of its tree; nested helpers
    would multiply. A one-element ``transform`` binds it to a variable instead.
    ``body`` must not contain a Python UDF.
    """
    return F.get(F.transform(F.array(value), body), 0)
