"""Helpers for building columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable.

    A column that a lambda of ``body`` uses would otherwise be evaluated anew for
    each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
