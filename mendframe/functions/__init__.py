"""Column functions. Those that need Python are Arrow UDFs over batches, made when they are called."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def arrow_udf(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """A pandas UDF of the given return type, built at the call: importing needs no session, so workers can."""

    def wrap(fn: Callable) -> Callable[..., Column]:
        @functools.wraps(fn)
        def call(*columns) -> Column:
            return F.pandas_udf(fn, returns)(*columns)

        return call

    return wrap
