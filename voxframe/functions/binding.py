"""Binding an expression to a name inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once, however often f names it.

    A projection that names a column several times is collapsed into one expression that repeats all that is below it, and
    an expression inside a lambda is worked out again for every element; an argument of a lambda is not.
    """
    return F.get(F.transform(F.array(value), lambda x: f(x)), 0)
