"""Arrow functions that modules can declare: a session is needed only when they are applied."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(kind: str) -> Callable:
    """Decorates a function of pandas Series into one of columns."""

    def decorate(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def apply(*columns) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return apply

    return decorate
