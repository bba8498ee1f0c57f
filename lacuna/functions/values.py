"""Years, coordinates, region codes and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_MIN = 1900
DEFAULT_BUILD_YEAR = 2026


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def year_from_date(text: Column) -> Column:
    """Year of a YYYY-MM-DD prefix, else the first four digits anywhere, else ''."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.coalesce(
        _filled(F.regexp_extract(t, r"^(\d{4})-\d{2}-\d{2}", 1)), F.regexp_extract(t, r"(\d{4})", 1)
    )


def year_from_survey(year: Column, begin: Column) -> Column:
    """A clean four-digit survey year, else the leading four digits of the start date, else ''."""
    y = F.trim(F.coalesce(year, F.lit("")))
    b = F.trim(F.coalesce(begin, F.lit("")))
    return F.when(y.rlike(r"^\d{4}$"), y).otherwise(F.regexp_extract(b, r"^(\d{4})", 1))


def year_from_event(year: Column, event_date: Column) -> Column:
    """Leading four digits of the year field, else the first four digits of the event date, else ''."""
    y = F.trim(F.coalesce(year, F.lit("")))
    e = F.coalesce(event_date, F.lit(""))
    return F.coalesce(_filled(F.regexp_extract(y, r"^(\d{4})", 1)), F.regexp_extract(e, r"(\d{4})", 1))


def build_year(build_date: str | None) -> int:
    """Build year from a YYYY-… date given by the caller."""
    head = (build_date or "")[:4]
    return int(head) if head.isdigit() else DEFAULT_BUILD_YEAR


def clean_year(year: Column, build_date: str | None = None) -> Column:
    """Year as INT; NULL (unknown) when not a whole number in [1900, build year]."""
    y = F.trim(year.cast("string")).try_cast("int")
    return F.when(y.between(YEAR_MIN, build_year(build_date)), y)


def parse_number(text: Column) -> Column:
    """Finite double from text, else NULL; -0.0 becomes 0.0 so that equal sites compare equal."""
    v = F.trim(text.cast("string")).try_cast("double")
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(finite, v + F.lit(0.0))


def coordinate(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(lon, lat) as doubles; a pair with one unusable half is unknown as a whole."""
    x, y = parse_number(lon), parse_number(lat)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def province_of(region: Column) -> Column:
    return F.substring(region, 1, 2)


def round_by_decimals(value: Column, var: Column, decimals: dict[str, int]) -> Column:
    """Half-even rounding with a number of decimals per variable."""
    out = F.bround(value, 0)
    for name, digits in decimals.items():
        out = F.when(var == name, F.bround(value, digits)).otherwise(out)
    return out


def discovery_status(last_year: Column, build_date: str | None = None, window: int = 10) -> Column:
    """found / dormant / undiscovered from the latest year (0 = seen, year unknown; NULL = never seen)."""
    cut = build_year(build_date) - window
    return (
        F.when(last_year.isNull(), "undiscovered").when(last_year > cut, "found").otherwise("dormant")
    )


# Rarity 1..5 and its red-list category.
RARITY_CATEGORY = {1: "LC", 2: "NT", 3: "VU", 4: "EN", 5: "CR"}


def rarity_to_category(rarity: Column) -> Column:
    out = F.lit(None).cast("string")
    for step, code in RARITY_CATEGORY.items():
        out = F.when(rarity == step, code).otherwise(out)
    return out
