"""Column functions of the station domain: bands, distances, token lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, digits: int) -> Column:
    """A double rounded as SQL engines do: times ``10 ** digits``, to a whole
    number, halves away from zero, and divided again. Spark's own ``round`` goes
    by the printed decimals instead, and differs where these end in a 5."""
    scale = float(10**digits)
    return F.round((F.col(value) if isinstance(value, str) else value) * scale) / scale


def health_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), "insufficient_history").when(score >= 80, "Healthy")
        .when(score >= 60, "Watch").when(score >= 40, "Degraded").otherwise("Critical")
    )


def status_class(present_rate: Column, padded: Column) -> Column:
    return (
        F.when((present_rate < 0.55) | (padded >= 168), "outage_dominated").when(present_rate < 0.70, "weak")
        .when(present_rate < 0.85, "usable").when(padded > 0, "reliable_but_terminal_gap").otherwise("reliable_reference_candidate")
    )


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def outage_multiplier(full_hours: Column, partial_hours: Column) -> Column:
    return F.when(full_hours > 0, F.exp(-full_hours / 24.0)).when(partial_hours > 0, F.exp(-partial_hours / 72.0)).otherwise(1.0)


def trajectory(delta: Column) -> Column:
    return F.when(delta <= -5, "Deteriorating").when(delta >= 5, "Improving").otherwise("Stable")


def duration_bucket(hours: Column) -> Column:
    return F.when(hours <= 3, "0-3").when(hours <= 24, "3-24").when(hours <= 168, "24-168").otherwise("168+")


def tokens(listed: Column, sep: str = "|") -> Column:
    """Distinct non-empty tokens of a separated list; none of a null."""
    return F.array_distinct(F.filter(F.split(F.coalesce(listed, F.lit("")), "\\" + sep), lambda x: x != ""))


def reason_value(listed: Column, key: str) -> Column:
    """The value of ``key=value`` in a list separated by bars."""
    return F.element_at(F.str_to_map(listed, F.lit("\\|"), F.lit("=")), key)


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null, which ``greatest`` alone would not keep."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def cumulative_hazard(hourly: Column, hours: int) -> Column:
    return 1 - F.pow(1 - hourly, hours)


def stuck_category(modal: Column, spread: Column, distinct: Column) -> Column:
    return (
        F.when(modal >= 0.99, "confirmed_flatline").when(modal >= 0.80, "borderline_lowvar")
        .when((spread > 5) | (distinct > 10), "ranging_not_stuck").otherwise("ambiguous_lowmodal")
    )


def calendar(hour: Column, year_days: float) -> dict[str, Column]:
    day, of_year = F.hour(hour) / 24.0, F.dayofyear(hour) / year_days
    turn = 2 * F.pi()
    return {
        "hour_sin": F.sin(turn * day), "hour_cos": F.cos(turn * day), "doy_sin": F.sin(turn * of_year), "doy_cos": F.cos(turn * of_year),
    }


def correlation(a, b) -> Column:
    """Pearson correlation of rows where both have a value; null if either is
    constant, which ``corr`` would call an error."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
