"""Association metrics as Column expressions.

All metrics are doubles; every count is cast to double before it is
multiplied, so products of large supports cannot overflow a bigint.  The
operation order is fixed (left to right) so that an SQL oracle written the
same way gives bit-identical values.

``digits`` rounds half-up like the reference's ``ROUND``; ``None`` keeps the
full double.
"""

from __future__ import annotations

from functools import reduce
from typing import Optional, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def rounded(c: Column, digits: Optional[int]) -> Column:
    return c if digits is None else F.round(c, digits)


def support(co, total) -> Column:
    """co / total."""
    return as_double(co) / as_double(total)


def confidence(co, antecedent_supports: Sequence) -> Column:
    """co / the smallest single-member support of the antecedent.

    For n = 2 this is the textbook confidence of item 1 -> item 2; for larger
    sets it is the reference's definition (a bound, not the rule confidence).
    """
    cols = [F.col(s) if isinstance(s, str) else s for s in antecedent_supports]
    least = cols[0] if len(cols) == 1 else F.least(*cols)
    return as_double(co) / as_double(least)


def lift(co, total, supports: Sequence) -> Column:
    """co * total^(n-1) / (s_1 * ... * s_n), all in doubles, left to right."""
    num = as_double(co)
    for _ in range(len(supports) - 1):
        num = num * as_double(total)
    den = reduce(lambda a, b: a * b, [as_double(s) for s in supports])
    return num / den


def percent(part, whole) -> Column:
    """part * 100 / whole in doubles."""
    return as_double(part) * F.lit(100.0) / as_double(whole)
