"""Arrow functions that are made when they are first used: a return type can be
parsed only once there is a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column


def arrow_function(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Decorator: a function over pandas series becomes one over columns."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def column(*cols) -> Column:
            from pyspark.sql.functions import pandas_udf

            return pandas_udf(f, kind)(*cols)

        return column

    return wrap
