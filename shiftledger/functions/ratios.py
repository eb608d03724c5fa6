"""Division with a choice about zero divisors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, safe: bool = False) -> Column:
    """``part / whole``. A zero divisor is an error, as it is in a single report; ``safe`` gives NULL instead,
    so that one period or employee without hours does not fail the whole batch."""
    return F.try_divide(part, whole) if safe else part / whole
