"""Classification rules of the reports: risk, bands, tiers, time ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwell.functions.threats import THREAT_TYPES

# --- fixed values --------------------------------------------------------------------
HIGH_RISK = ("aadhaar", "pan", "passport", "credit_card", "cvv", "account_number")
MEDIUM_RISK = ("phone", "us_phone", "email", "upi", "dob", "voter_id", "gstin")
PII_BANDS = {
    "0 PII": (0, 0),
    "1-10 PII": (1, 10),
    "11-50 PII": (11, 50),
    "50+ PII": (51, None),
}
DATE_RANGES = {"Today": 1, "Last 7 days": 7, "Last 30 days": 30}
SUSPICIOUS_FROM, WARN_FROM = 5, 2
TIMEOUT_MINUTES = 30
# --- end of fixed values ---------------------------------------------------------------


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_threat(pii_type: Column) -> Column:
    return pii_type.isin(*THREAT_TYPES)


def has_threat(summary: Column) -> Column:
    keys = F.coalesce(F.map_keys(summary), F.array().cast("array<string>"))
    return F.arrays_overlap(keys, _texts(THREAT_TYPES))


def threats_in(summary: Column) -> Column:
    """The threat keys of a summary, in the fixed order of the threat types."""
    keys = F.coalesce(F.map_keys(summary), F.array().cast("array<string>"))
    return F.array_intersect(_texts(THREAT_TYPES), keys)


def risk_level(summary: Column) -> Column:
    types = F.array_except(
        F.coalesce(F.map_keys(summary), F.array().cast("array<string>")), _texts(THREAT_TYPES)
    )
    return (
        F.when(F.arrays_overlap(types, _texts(HIGH_RISK)), "HIGH")
        .when(F.arrays_overlap(types, _texts(MEDIUM_RISK)), "MEDIUM")
        .when(F.size(types) > 0, "LOW")
        .otherwise("NONE")
    )


def in_band(pii_count: Column, band: str) -> Column:
    low, high = PII_BANDS[band]
    count = F.coalesce(pii_count, F.lit(0))
    return (count >= low) if high is None else count.between(low, high)


def band_of(pii_count: Column) -> Column:
    first, *others = PII_BANDS
    out = F.when(in_band(pii_count, first), first)
    for band in others:
        out = out.when(in_band(pii_count, band), band)
    return out


def parse_time(text: Column, as_of: Column) -> Column:
    """ISO time text to timestamp; text that is not a time counts as ``as_of``."""
    return F.coalesce(F.try_to_timestamp(text), as_of)


def since(time: Column, date_range: str, as_of: Column) -> Column:
    """Whether ``time`` lies in the range that ends at ``as_of``, counted in full days back."""
    days = DATE_RANGES[date_range]
    return time >= as_of - F.make_dt_interval(F.lit(days))


def login_tier(attempts: Column) -> Column:
    return (
        F.when(attempts >= SUSPICIOUS_FROM, "suspicious")
        .when(attempts >= WARN_FROM, "warn")
        .otherwise("normal")
    )


def share_percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down from a binary quotient; null when ``whole`` is 0."""
    quotient = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.floor(quotient * 100).cast("bigint")


def or_value(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))
