"""Window specifications over one ordered series per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

UP = Window.unboundedPreceding
UF = Window.unboundedFollowing


class Span:
    """All frames of a series share one partition/order spec, so Spark shuffles and sorts once.

    Bars are unique per (key, ts) after ingest, hence a partition never holds more rows
    than the trading calendar has slots; raw ticks and fills go through `chunks` instead.
    """

    def __init__(self, keys: Sequence[str] = ("symbol",), order: Sequence[str | Column] = ("ts",)):
        self.keys = list(keys)
        self.order = list(order)

    @property
    def w(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def running(self):
        return self.w.rowsBetween(UP, 0)

    @property
    def before(self):
        return self.w.rowsBetween(UP, -1)

    @property
    def after(self):
        return self.w.rowsBetween(1, UF)

    @property
    def whole(self):
        return Window.partitionBy(*self.keys)

    @property
    def desc(self):
        return Window.partitionBy(*self.keys).orderBy(*[_desc(c) for c in self.order])

    def trailing(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def rows(self, lo: int, hi: int):
        return self.w.rowsBetween(lo, hi)

    def lag(self, c, n: int = 1, default=None) -> Column:
        return F.lag(c, n, default).over(self.w)

    def lead(self, c, n: int = 1) -> Column:
        return F.lead(c, n).over(self.w)

    def full(self, n: int, agg: Column, x) -> Column:
        """`agg` over the trailing n rows, null until n non-null values of x are present."""
        frame = self.trailing(n)
        return F.when(F.count(x).over(frame) == n, agg.over(frame))

    def mean(self, x, n: int) -> Column:
        return self.full(n, F.avg(x), x)

    def rn(self) -> Column:
        return F.row_number().over(self.w)

    def rn_desc(self) -> Column:
        return F.row_number().over(self.desc)

    def size(self) -> Column:
        return F.count(F.lit(1)).over(self.whole)


def _desc(c):
    return F.desc(c) if isinstance(c, str) else c.desc()


BARS = Span()


def ratio(a, b) -> Column:
    """a / b with a zero or missing base giving null."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(a, b)
