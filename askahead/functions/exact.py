"""Sums of doubles that do not depend on the order of the rows.

A double is cut into limbs of 30 bits, which are whole numbers, and whole numbers can be added in any order. A sum is then
an ordinary aggregate that combines before the shuffle, and the limbs of the total give the same double on any layout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS, _BASE = 30, 1 << 30
# Limbs after the point: bits down to 2 ** -210, which holds every double from 2 ** -157 on whole. What is smaller is cut.
_AFTER = 7


def _limbs(x: Column) -> list[Column]:
    size = F.abs(x)
    sign = F.signum(x).cast("bigint")
    # Scaling by a power of two and the remainder of doubles are exact.
    after = [F.floor((size * float(1 << _BITS * i)) % float(_BASE)) for i in range(1, _AFTER + 1)]
    return [sign * part.cast("bigint") for part in (F.floor(size), *after)]


def _carried(sums: list[Column]) -> tuple[Column, list[Column]]:
    """The whole part, and the limbs after the point, each from 0 to below its base."""
    carry, limbs = F.lit(0).cast("bigint"), []
    for part in reversed(sums[1:]):
        total = part + carry
        limbs.append(total.bitwiseAND(F.lit(_BASE - 1).cast("bigint")))
        carry = F.shiftright(total, _BITS)
    return sums[0] + carry, limbs


def _value(sums: list[Column]) -> Column:
    """The double of limbs that add up to no less than 0."""
    whole, limbs = _carried(sums)
    return whole + reduce(lambda low, limb: (low + limb) / float(_BASE), limbs, F.lit(0.0))


def exact_sum(x: Column) -> Column:
    """Sum of the doubles of a group as an aggregate; null without any, NaN or infinite if one of them is.

    Whole parts may add up to 2 ** 62, and a group may have 2 ** 32 rows.
    """
    finite = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    # A sum of numbers that are not finite is one of them, in any order.
    strange = F.sum(F.when(F.isnan(x) | (F.abs(x) == float("inf")), x))
    sums = [F.coalesce(F.sum(limb), F.lit(0).cast("bigint")) for limb in _limbs(finite)]
    negated = [-s for s in sums]
    total = F.when(_carried(sums)[0] < 0, -_value(negated)).otherwise(_value(sums))
    return F.when(F.count(x) > 0, F.coalesce(strange, total))
