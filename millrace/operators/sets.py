"""Set operations with SQL's precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame

_APPLY = {
    "union": lambda a, b: a.union(b).distinct(),
    "union all": lambda a, b: a.union(b),
    "intersect": lambda a, b: a.intersect(b),
    "intersect all": lambda a, b: a.intersectAll(b),
    "except": lambda a, b: a.subtract(b),
    "except all": lambda a, b: a.exceptAll(b),
}


def combined(first: DataFrame, *rest: tuple[str, DataFrame]) -> DataFrame:
    """``first`` and the (operation, operand) pairs as one flat SQL chain: INTERSECT binds tighter, else left to right."""
    terms: list[tuple[str, DataFrame]] = [("", first)]
    for operation, operand in rest:
        if operation.startswith("intersect"):
            before, left = terms[-1]
            terms[-1] = before, _APPLY[operation](left, operand)
        else:
            terms.append((operation, operand))
    out = terms[0][1]
    for operation, operand in terms[1:]:
        out = _APPLY[operation](out, operand)
    return out
