"""Small linear systems inside a row, as array arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def solved(rows: Column, n: int, tolerance: float = 1e-10) -> Column:
    """x of A x = b for a symmetric, positive semidefinite A, given as n arrays of n + 1 numbers: a row of A and b's entry.

    Gauss-Jordan in the order of the rows. A pivot that falls below ``tolerance`` of its first size belongs to a term that depends on
    earlier ones; its coefficient is 0, which leaves the fitted values as they are.
    """
    first = [rows[k][k] for k in range(n)]

    def eliminate(m: Column, k: Column) -> Column:
        size = F.get(F.array(*first), k)
        pivot = F.get(F.get(m, k), k)
        usable = F.abs(pivot) > tolerance * F.abs(size)
        unit = F.transform(F.get(m, k), lambda v: F.when(usable, v / F.when(usable, pivot).otherwise(1.0)).otherwise(0.0))
        return F.transform(m, lambda row, i: F.when(i == k, unit).otherwise(F.zip_with(row, unit, lambda a, u: a - F.get(row, k) * u)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), rows, eliminate)
    return F.transform(done, lambda row: F.get(row, F.lit(n)))
