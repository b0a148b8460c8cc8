"""Error metrics as aggregate column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skylattice.functions.calendar import as_column


def rmse(y: Column | str, p: Column | str) -> Column:
    e = as_column(p) - as_column(y)
    return F.sqrt(F.avg(e * e))


def mae(y: Column | str, p: Column | str) -> Column:
    return F.avg(F.abs(as_column(p) - as_column(y)))


def r2(y: Column | str, p: Column | str) -> Column:
    """1 - SSE/SST over rows where both sides are present; null when the truth is constant."""
    y, p = as_column(y), as_column(p)
    both = y.isNotNull() & p.isNotNull()
    sse = F.sum((p - y) * (p - y))
    sst = F.var_pop(F.when(both, y)) * F.count(F.when(both, y))
    return F.lit(1.0) - F.try_divide(sse, sst)


def smape(y: Column | str, p: Column | str, eps: float = 1e-6) -> Column:
    y, p = as_column(y), as_column(p)
    return F.avg(
        F.lit(2.0) * F.abs(p - y) / (F.abs(y) + F.abs(p) + F.lit(float(eps)))
    ) * F.lit(100.0)
