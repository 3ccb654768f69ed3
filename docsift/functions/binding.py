"""Bind an expression to a name inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A lambda body that mentions an outer expression evaluates it again for each
    element; a lambda variable does not, which keeps array code linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def part(arr: Column, start: Column, n: Column) -> Column:
    """Up to ``n`` elements from ``start`` (from 1, inside the array).

    ``slice`` copies the whole array on every call, which makes cutting an array into
    pieces quadratic; reading single elements does not. ``arr`` must be a column or a
    lambda variable.
    """
    last = F.least(start + n - 1, F.size(arr))
    return F.transform(F.sequence(start, last), lambda i: F.get(arr, i - 1))
