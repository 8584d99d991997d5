"""Row-local column expressions: time keys, units, clamps, sectors, seasonal terms."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxspark import constants as K


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_of(ts) -> Column:
    """First day of the month a time stamp or date falls in."""
    return F.trunc(F.to_date(col(ts)), "MM")


def half_hour_of_day(ts) -> Column:
    return (F.hour(col(ts)) * 2 + F.floor(F.minute(col(ts)) / 30)).cast("int")


def season_of(ts) -> Column:
    return F.when(F.month(col(ts)).isin(6, 7, 8), "JJA").otherwise("other")


def decimal_year(ts) -> Column:
    return F.year(col(ts)) + (F.month(col(ts)) - 1) / F.lit(12.0)


def month_index(m) -> Column:
    """Months since year zero: consecutive months differ by one."""
    return F.year(col(m)) * 12 + F.month(col(m)) - 1


def seconds_in_month(m) -> Column:
    return F.dayofmonth(F.last_day(col(m))) * K.SECONDS_PER_DAY


def slots_in_month(m) -> Column:
    return F.dayofmonth(F.last_day(col(m))).cast("bigint") * K.SLOTS_PER_DAY


def fahrenheit_to_celsius(c) -> Column:
    return (col(c) - 32.0) * 5.0 / 9.0


def celsius_to_fahrenheit(c) -> Column:
    return col(c) * 9.0 / 5.0 + 32.0


def methane_to_carbon(c) -> Column:
    return col(c) * K.C_PER_CH4


def carbon_to_methane(c) -> Column:
    return col(c) / K.C_PER_CH4


def flux_to_grams_per_slot(c) -> Column:
    return col(c) * K.GRAMS_PER_SLOT


def monthly_flux_to_grams(flux, month) -> Column:
    """Grams of methane of a month that held its mean flux over its own length."""
    return col(flux) * seconds_in_month(month) * 1e-9 * K.MOLAR_MASS_CH4


def clean_value(c, sentinel: float = K.SENTINEL, tolerant: bool = True) -> Column:
    """Number or null: bad text, NaN and the sentinel all become null."""
    v = col(c).try_cast("double")
    if tolerant:
        missing = F.abs(v - sentinel) <= 1e-8 + 1e-5 * abs(sentinel)
    else:
        missing = v == sentinel
    return F.when(~missing & ~F.isnan(v), v)


def clamp(c, low, high) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, col(high)), col(low)))


def out_of_range(c, low, high) -> Column:
    """'below', 'above' or null; the bounds themselves are inside."""
    return F.when(col(c) < col(low), "below").when(col(c) > col(high), "above")


def mask_from(c, month, break_month: str) -> Column:
    return F.when(col(month) < F.lit(break_month).cast("date"), col(c))


def checked_log(c, what: str = "log target needs strictly positive values") -> Column:
    c = col(c)
    return F.when(c <= 0, F.raise_error(F.lit(what)).cast("double")).otherwise(F.ln(c))


def log_standard_error(se, mean) -> Column:
    return F.try_divide(col(se), col(mean))


def q10_from_slope(c) -> Column:
    return F.exp(col(c) * 10.0)


def slope_from_q10(c) -> Column:
    """Null where the ratio is not positive."""
    return F.ln(col(c)) / 10.0


def sector_membership(wd, sector=K.EXCLUDED_SECTOR) -> Column:
    wd = col(wd)
    return F.coalesce((wd >= sector[0]) & (wd < sector[1]), F.lit(False))


def slug_of(label, slugs: Mapping[str, str] = K.SLUGS) -> Column:
    """Slug of a known label. An unknown label stops the job; null stays null."""
    label = col(label)
    known = F.create_map(*[F.lit(x) for kv in slugs.items() for x in kv])
    slug = known[label]
    message = F.concat(F.lit("unknown label: "), label)
    return F.when(label.isNull() | slug.isNotNull(), slug).otherwise(F.raise_error(message).cast("string"))


def seasonal_terms(month) -> dict[str, Column]:
    m = F.month(col(month))
    return {
        "sin_year": F.sin(m * (2 * math.pi / 12)),
        "cos_year": F.cos(m * (2 * math.pi / 12)),
        "year_fraction": (m - 1) / F.lit(12.0),
    }


def inverse_variance_weight(se) -> Column:
    se = col(se)
    return F.when(se > 0, 1.0 / (se * se))


def bias_direction(b, tolerance: float = 0.01) -> Column:
    b = col(b)
    return (
        F.when(F.abs(b) < tolerance, "no material bias")
        .when(b > 0, "model predicts low")
        .when(b <= 0, "model predicts high")
    )


def predicted_over_observed(b) -> Column:
    return F.exp(-col(b))


def prediction_error_pct(b) -> Column:
    return (F.exp(-col(b)) - 1.0) * 100.0


def laplace_quantile(p: float, scale) -> Column:
    """Quantile of a Laplace distribution centred on zero."""
    return col(scale) * (-math.copysign(1.0, p - 0.5) * math.log(1 - 2 * abs(p - 0.5)) if p != 0.5 else 0.0)


def laplace_quantile_of(p, location, scale) -> Column:
    off = col(p) - 0.5
    return col(location) - col(scale) * F.signum(off) * F.ln(1 - 2 * F.abs(off))


def laplace_cdf(x, location, scale) -> Column:
    z = F.try_divide(col(x) - col(location), col(scale))
    return F.when(z < 0, F.exp(z) / 2).otherwise(1 - F.exp(-z) / 2)


def project_metres(lon, lat, lon0: float, lat0: float) -> tuple[Column, Column]:
    east = 111_320.0 * math.cos(math.radians(lat0))
    return (col(lon) - lon0) * east, (col(lat) - lat0) * 110_570.0


def annual_lag(horizon: int, period: int = K.PERIOD) -> int:
    """Smallest whole number of years, in months, that is not below the horizon."""
    return period * max(1, -(-horizon // period))


def horizon_lags(lags, horizon: int) -> list[int]:
    return sorted({k + horizon - 1 for k in lags})


def flux_lags(horizon: int, recent=K.RECENT_LAGS) -> list[int]:
    return sorted({*horizon_lags(recent, horizon), annual_lag(horizon)})
