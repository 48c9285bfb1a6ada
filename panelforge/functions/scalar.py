"""Scalar column expressions: codes, dates, returns, tax, leverage, exchange price rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Listing code changes, old code -> new code.
CODE_REPLACEMENTS = {
    "1334": "1333", "8815": "3289", "8880": "3291", "4555": "4887", "5007": "5021", "1824": "5076",
    "8385": "5830", "8355": "5831", "8382": "5832", "8369": "5844", "4723": "6028", "8335": "7167",
    "8394": "7180", "8332": "7186", "8379": "7337", "9062": "9147", "9477": "9468",
}
# Disclosure types that only revise a forecast.
FORECAST_REVISION_TYPES = (
    "DividendForecastRevision", "EarnForecastRevision", "REITDividendForecastRevision", "REITEarnForecastRevision",
)
# Exchange daily price limits, (base price below, width); the last row has no upper end.
PRICE_LIMITS = (
    (100, 30), (200, 50), (500, 80), (700, 100), (1000, 150), (1500, 300), (2000, 400), (3000, 500),
    (5000, 700), (7000, 1000), (10000, 1500), (15000, 3000), (20000, 4000), (30000, 5000), (50000, 7000),
    (70000, 10000), (100000, 15000), (150000, 30000), (200000, 40000), (300000, 50000), (500000, 70000),
    (700000, 100000), (1000000, 150000), (1500000, 300000), (2000000, 400000), (3000000, 500000),
    (5000000, 700000), (7000000, 1000000), (10000000, 1500000), (15000000, 3000000), (20000000, 4000000),
    (30000000, 5000000), (50000000, 7000000), (None, 10000000),
)
# Short-sale price ticks, (price up to, tick).
SHORT_SALE_TICKS = ((3000, 1), (5000, 5), (30000, 10), (50000, 50), (None, 100))
SHORT_SALE_RATE = 0.905
TAX_RATE = 0.20315
LEVERAGE_RATIO = 3.1
BUSINESS_DAYS = 252
OUTAGE_DAY = "2020-10-01"
FUND_CATEGORY = "その他"
CAPITAL_GAIN_TAX_TEXT = "譲渡益税"
UNLIMITED_QUOTA = 1_000_000


def normalise_code(code: Column) -> Column:
    """Five-character codes ending in 0 lose the last character."""
    return F.when((F.length(code) == 5) & code.endswith("0"), F.substring(code, 1, 4)).otherwise(code)


def replace_code(code: Column, mapping: Mapping[str, str] = CODE_REPLACEMENTS) -> Column:
    """Constant lookup, evaluated inside the projection."""
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return F.coalesce(F.element_at(table, code), code)


def day(x: Column) -> Column:
    """Day grain of a date, timestamp or ISO string."""
    return F.to_date(F.substring(x.cast("string"), 1, 10))


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def to_number(x: Column) -> Column:
    """Text with thousands separators to double, anything else to null."""
    return F.regexp_replace(x.cast("string"), ",", "").try_cast("double")


def is_full_disclosure(doc_type: Column) -> Column:
    """True for every document that is not a forecast revision; unknown types are kept."""
    return ~F.coalesce(doc_type.isin(*FORECAST_REVISION_TYPES), F.lit(False))


def forecast_eps(current: Column, following: Column) -> Column:
    return F.coalesce(current, following, F.lit(0.0))


def outstanding_shares(issued: Column, treasury: Column) -> Column:
    return issued - F.coalesce(treasury, F.lit(0.0))


def fiscal_year(year_end: Column) -> Column:
    return F.date_format(year_end, "yyyy")


def forecast_year_end(year_end: Column, period: Column) -> Column:
    """A full-year report forecasts the following year, every other report the running one."""
    target = F.when(period == "FY", F.add_months(year_end, 12)).otherwise(year_end)
    return F.date_format(target, "yyyy/MM")


def daytime_return(open_: Column, close: Column) -> Column:
    return F.try_divide(close, open_) - 1


def apply_tax(r: Column, rate: float = TAX_RATE) -> Column:
    return r * (1 - rate)


def remove_tax(r: Column, rate: float = TAX_RATE) -> Column:
    return r / (1 - rate)


def apply_leverage(r: Column, ratio: float = LEVERAGE_RATIO) -> Column:
    return r * ratio


def remove_leverage(r: Column, ratio: float = LEVERAGE_RATIO) -> Column:
    return r / ratio


def annualise_return(r: Column, days: int = BUSINESS_DAYS) -> Column:
    return F.pow(1 + r, F.lit(float(days))) - 1


def annualise_volatility(v: Column, days: int = BUSINESS_DAYS) -> Column:
    return v * F.sqrt(F.lit(float(days)))


def _step(x: Column, table: Sequence[tuple], inclusive: bool) -> Column:
    """First table row whose bound lies above (or at) ``x``."""
    out = None
    for bound, value in table:
        if bound is None:
            return F.lit(value) if out is None else out.otherwise(F.lit(value))
        hit = x <= bound if inclusive else x < bound
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def price_limit(base: Column) -> Column:
    return F.when(base.isNotNull(), _step(base, PRICE_LIMITS, inclusive=False))


def upper_limit(base: Column) -> Column:
    return base + price_limit(base)


def lower_limit(base: Column) -> Column:
    return F.greatest(base - price_limit(base), F.lit(0.0))


def short_sale_limit_price(price: Column) -> Column:
    tick = F.when(price.isNotNull(), _step(price, SHORT_SALE_TICKS, inclusive=True))
    return F.ceil(price * SHORT_SALE_RATE / tick) * tick


def signed_power(x: Column, p: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(p))


def truncate_long(x: Column) -> Column:
    """Toward zero, as an integer cast does."""
    return x.cast("long")
