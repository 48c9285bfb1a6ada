"""Panel window expressions with pandas-compatible null and tie rules.

Every helper takes the partition keys explicitly.  A panel holds one row per
(key, Date), so a partition is bounded by the length of the trading calendar,
and a cross-section partitioned by Date is bounded by the number of sectors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ColumnLike = str | Column
FIRST = Window.unboundedPreceding


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordered(keys: str | Sequence[str], order: str | Sequence[ColumnLike] = "Date") -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def backwards(keys: str | Sequence[str], order: str | Sequence[ColumnLike] = "Date") -> WindowSpec:
    """The same rows latest first.

    Frames that look ahead are written as growing frames over this order: those cost
    one step per row, a frame ending at UNBOUNDED FOLLOWING is rebuilt for every row.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return Window.partitionBy(*keys).orderBy(*[_c(o).desc_nulls_last() for o in order])


def shift(x: ColumnLike, n: int, keys, order="Date") -> Column:
    """Row offset inside the key, negative ``n`` looks ahead."""
    w = ordered(keys, order)
    return F.lag(_c(x), n).over(w) if n >= 0 else F.lead(_c(x), -n).over(w)


def previous(x: ColumnLike, keys, order="Date") -> Column:
    """``shift(x, 1)`` on the descending order, for plans whose rows are sorted that way already."""
    return F.lead(_c(x), 1).over(backwards(keys, order))


def ffill(x: ColumnLike, keys, order="Date") -> Column:
    return F.last(_c(x), ignorenulls=True).over(ordered(keys, order).rowsBetween(FIRST, 0))


def bfill(x: ColumnLike, keys, order="Date") -> Column:
    """This value, else the next one in the key.

    A named column uses a null-skipping lead on the ascending order every other
    helper sorts by, so filling both ways costs no second sort.
    """
    if isinstance(x, str) and isinstance(order, str):
        by = ", ".join(f"`{k}`" for k in ([keys] if isinstance(keys, str) else keys))
        part = f"PARTITION BY {by} " if by else ""
        return F.coalesce(F.col(x), F.expr(f"lead(`{x}`, 1) IGNORE NULLS OVER ({part}ORDER BY `{order}`)"))
    return F.last(_c(x), ignorenulls=True).over(backwards(keys, order).rowsBetween(FIRST, 0))


def fill_both(x: ColumnLike, keys, order="Date") -> Column:
    return F.coalesce(ffill(x, keys, order), bfill(x, keys, order))


def cumprod(x: ColumnLike, keys, order="Date") -> Column:
    """Running product; a null row stays null and is skipped by later rows."""
    x = _c(x)
    return F.when(x.isNotNull(), F.product(x).over(ordered(keys, order).rowsBetween(FIRST, 0)))


def cumsum(x: ColumnLike, keys, order="Date") -> Column:
    x = _c(x)
    return F.when(x.isNotNull(), F.sum(x).over(ordered(keys, order).rowsBetween(FIRST, 0)))


def cummax(x: ColumnLike, keys, order="Date") -> Column:
    """Running maximum; a null row stays null."""
    x = _c(x)
    return F.when(x.isNotNull(), F.max(x).over(ordered(keys, order).rowsBetween(FIRST, 0)))


def product_from_here(x: ColumnLike, keys, order="Date") -> Column:
    """Product of this row and every later one."""
    return F.product(_c(x)).over(backwards(keys, order).rowsBetween(FIRST, 0))


def product_after(x: ColumnLike, keys, order="Date") -> Column:
    """Product of the rows strictly after this one, 1 on the last row."""
    return F.coalesce(F.product(_c(x)).over(backwards(keys, order).rowsBetween(FIRST, -1)), F.lit(1.0))


def pct_change(x: ColumnLike, keys, order="Date") -> Column:
    x = _c(x)
    return F.try_divide(x, shift(x, 1, keys, order)) - 1


def diff(x: ColumnLike, keys, order="Date") -> Column:
    x = _c(x)
    return x - shift(x, 1, keys, order)


def _band(f, x: ColumnLike, n: int, lag: int, keys, order) -> Column:
    x = _c(x)
    w = ordered(keys, order).rowsBetween(-(n + lag - 1), -lag)
    return F.when(F.count(x).over(w) == n, f(x).over(w))


def rolling_mean(x: ColumnLike, n: int, keys, order="Date", lag: int = 0) -> Column:
    """Mean of ``n`` rows ending ``lag`` rows ago; null until n values exist."""
    return _band(F.avg, x, n, lag, keys, order)


def rolling_std(x: ColumnLike, n: int, keys, order="Date", lag: int = 0) -> Column:
    return _band(F.stddev_samp, x, n, lag, keys, order)


def prior(f, x: ColumnLike, keys, order="Date") -> Column:
    """Expanding aggregate over the rows strictly before this one."""
    return f(_c(x)).over(ordered(keys, order).rowsBetween(FIRST, -1))


def expanding(f, x: ColumnLike, keys, order="Date") -> Column:
    return f(_c(x)).over(ordered(keys, order).rowsBetween(FIRST, 0))


def rank_avg(x: ColumnLike, keys, ascending: bool = True) -> Column:
    """Average-tie rank, nulls unranked.

    ``rank`` and the peer count share one ordering, so both come out of one sort.
    """
    x = _c(x)
    w = ordered(keys, x.asc_nulls_last() if ascending else x.desc_nulls_last())
    peers = F.count(F.lit(1)).over(w.rangeBetween(0, 0))
    return F.when(x.isNotNull(), F.rank().over(w) + (peers - 1) / F.lit(2.0))
