"""Small helpers over Spark higher-order functions."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(bindings: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Evaluate ``bindings`` once and hand them to ``body`` as fields of one struct.

    Spark does not share common sub-expressions inside lambda functions, so an array that a
    lambda reads many times is bound here first.
    """
    packed = F.struct(*[v.alias(k) for k, v in bindings.items()])
    return F.get(F.transform(F.array(packed), body), 0)


def sums_before(values: Column, block: int = 512) -> Column:
    """For each element of an integer array the sum of the elements before it (bigint), inside the row.

    Sums grow within blocks, and blocks are then shifted by the sums before them, so a long array
    costs about ``block`` steps an element instead of its own length.
    """
    zero = F.array(F.lit(0).cast("bigint"))

    def scan(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def blocks_of(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(v["x"]) / block).cast("int")),
                           lambda b: scan(F.slice(v["x"], b * block + 1, block)))

    def shifted(v: Column) -> Column:
        return F.flatten(F.transform(v["blocks"], lambda b, i: F.transform(
            F.slice(b, F.lit(1), F.size(b) - 1), lambda x: x + F.get(v["shift"], i))))

    def with_shift(v: Column) -> Column:
        lasts = F.transform(v["blocks"], lambda b: F.element_at(b, -1))
        return let({"blocks": v["blocks"], "shift": scan(lasts)}, shifted)

    return let({"x": values}, lambda v: let({"blocks": blocks_of(v)}, with_shift))
