"""Vector columns."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


# Longer sums outgrow what the JVM compiles as one method, and then run several
# times slower than the higher-order functions.
MAX_WRITTEN_OUT = 16
_UNFIT = "vectors of different lengths in a dot product"


def dot(a: Column | str, b: Column | str, size: int | None = None) -> Column:
    """Dot product of two arrays, summed in double from the first element on.

    Arrays of different lengths, or of another length than ``size``, raise; a
    null array gives null. With a small ``size`` known, the sum is written out,
    which keeps it inside generated code; the higher-order functions are
    interpreted. Both forms multiply the same elements.

    Give names where there are any: two names make one SQL text, while the
    hundred parts of a sum of column objects take 0.2 s to put together.
    """
    if isinstance(a, Column) or isinstance(b, Column):
        return _dot_of_columns(a if isinstance(a, Column) else F.col(a), b if isinstance(b, Column) else F.col(b), size)
    return F.expr(dot_sql(f"`{a}`", f"`{b}`", size))


def dot_sql(a: str, b: str, size: int | None = None) -> str:
    """``dot`` of two SQL expressions, which it repeats: give names, not computations."""
    if size is None or size > MAX_WRITTEN_OUT:
        products = f"zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE))"
        total = f"aggregate({products}, 0D, (s, e) -> s + e)"
    else:
        terms = [f"CAST(get({a}, {i}) AS DOUBLE) * CAST(get({b}, {i}) AS DOUBLE)" for i in range(size)]
        total = " + ".join(["0D", *terms])
    fits = f"size({a}) = size({b})" + (f" AND size({b}) = {size}" if size is not None else "")
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN CAST(NULL AS DOUBLE) WHEN {fits} THEN {total} "
        f"ELSE CAST(raise_error('{_UNFIT}') AS DOUBLE) END"
    )


def _dot_of_columns(a: Column, b: Column, size: int | None) -> Column:
    if size is None or size > MAX_WRITTEN_OUT:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        total = F.aggregate(products, F.lit(0.0), add)
    else:
        terms = [
            F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double")
            for i in range(size)
        ]
        total = reduce(add, terms, F.lit(0.0))
    fits = F.size(a) == (F.size(b) if size is None else F.lit(size))
    if size is not None:
        fits &= F.size(b) == F.lit(size)
    unfit = F.raise_error(F.lit(_UNFIT)).cast("double")
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(fits, total).otherwise(unfit)
