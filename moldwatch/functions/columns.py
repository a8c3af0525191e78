"""Scalar column expressions.

Every function returns a ``Column`` built from ``pyspark.sql.functions``; none
is a Python UDF, so all of them stay inside whole-stage codegen.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "as_col", "to_number", "nan_to_null", "utc_timestamp", "micros",
    "normalize_machine_id", "compact_machine_id", "display_machine_id",
    "tool_from_definition", "clip_probability", "is_idle", "finite_or_null",
    "round_half_even", "event_timestamp", "to_ntz",
]

# A number the way a lenient numeric parser accepts it: optional sign, digits
# with optional fraction and exponent, or inf / infinity / nan words.  Spark's
# own cast also takes suffixes such as '1d' / '1f', which must be rejected.
_NUMERIC_TEXT = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def to_number(c) -> Column:
    """Coerce text or numbers to DOUBLE; anything non-numeric or NaN -> NULL."""
    c = as_col(c)
    text = c.cast("string")
    parsed = F.when(text.rlike(_NUMERIC_TEXT), F.trim(text).try_cast("double"))
    return nan_to_null(parsed)


def utc_timestamp(c) -> Column:
    """Parse to TIMESTAMP (session TZ is UTC); unparsable -> NULL."""
    c = as_col(c)
    return F.coalesce(c.try_cast("timestamp"), F.try_to_timestamp(c.cast("string")))


def to_ntz(c) -> Column:
    return as_col(c).cast("timestamp_ntz")


def micros(c) -> Column:
    return F.unix_micros(as_col(c).cast("timestamp"))


def normalize_machine_id(c) -> Column:
    """Strip non-alphanumerics, upper-case, prefix 'M' if absent."""
    compact = F.upper(F.regexp_replace(F.coalesce(as_col(c).cast("string"), F.lit("")),
                                       r"[^A-Za-z0-9]", ""))
    return F.when(compact.startswith("M"), compact).otherwise(F.concat(F.lit("M"), compact))


def compact_machine_id(c) -> Column:
    """Remove '-', upper-case, trim."""
    return F.trim(F.upper(F.replace(as_col(c).cast("string"), F.lit("-"), F.lit(""))))


def display_machine_id(c) -> Column:
    """'M231' -> 'M-231' only for the pattern M<digits> (P5)."""
    return F.regexp_replace(as_col(c), r"^M(\d+)$", "M-$1")


def tool_from_definition(c, variant: str = "A") -> Column:
    """Tool id from a machine definition string.

    A (P6): trailing '-<alnum>' else the whole string; null/empty -> UNKNOWN.
    B (P7): trailing '-<alnum>' else UNKNOWN.
    C (P8): last run of digits inside the last '-' segment, else UNKNOWN.
    """
    d = as_col(c).cast("string")
    suffix = F.regexp_extract(d, r"-([A-Za-z0-9]+)$", 1)
    has_suffix = d.rlike(r"-([A-Za-z0-9]+)$")
    if variant == "A":
        return (F.when(d.isNull() | (F.trim(d) == ""), F.lit("UNKNOWN"))
                .when(has_suffix, suffix).otherwise(d))
    if variant == "B":
        return F.when(has_suffix, suffix).otherwise(F.lit("UNKNOWN"))
    if variant == "C":
        runs = F.regexp_extract_all(F.substring_index(d, "-", -1), F.lit(r"(\d+)"), 1)
        return F.when(d.isNotNull() & (F.size(runs) > 0), F.element_at(runs, -1)) \
            .otherwise(F.lit("UNKNOWN"))
    raise ValueError(f"unknown variant {variant}")


def clip_probability(c) -> Column:
    """NULL/NaN -> 0, then clip to [0, 1]."""
    return F.least(F.greatest(F.coalesce(nan_to_null(c), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def is_idle(cycle_time, threshold: float = 0.5) -> Column:
    """Idle when the cycle time is missing or below the threshold."""
    return F.coalesce(nan_to_null(cycle_time), F.lit(0.0)) < F.lit(threshold)


def finite_or_null(c, bound: float) -> Column:
    """Keep finite values with |v| <= bound; others -> NULL."""
    c = as_col(c)
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= F.lit(bound))
    return F.when(ok, c)


def round_half_even(c, scale: int) -> Column:
    """Banker's rounding as the Python/numpy round."""
    return F.bround(as_col(c), scale)


def event_timestamp(date_col, seconds_col) -> Column:
    """Calendar date (UTC) + seconds of day; missing/bad seconds -> 0 (P10)."""
    secs = F.coalesce(to_number(seconds_col), F.lit(0.0))
    base = F.unix_micros(F.date_trunc("day", as_col(date_col).cast("timestamp")))
    return F.timestamp_micros(base + (secs * F.lit(1_000_000)).cast("long"))
