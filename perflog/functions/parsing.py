"""String parsing and type coercion as Column expressions.

All of these are JVM-side expressions -- they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ C1 / C2 / C3
def is_home(matchup) -> Column:
    """1 when the matchup reads ``AAA vs. BBB``; null matchup -> 0."""
    return F.coalesce(_c(matchup).contains("vs.").cast("int"), F.lit(0))


def is_away(matchup) -> Column:
    return F.coalesce(_c(matchup).contains("@").cast("int"), F.lit(0))


def opponent(matchup) -> Column:
    """Text after the last ``vs. ``; else after the last ``@ ``; else the last
    space-separated token.  Null stays null."""
    m = _c(matchup)
    return (F.when(m.isNull(), F.lit(None).cast("string"))
             .when(m.contains("vs."), F.element_at(F.split(m, "vs\\. ", -1), -1))
             .when(m.contains("@"), F.element_at(F.split(m, "@ ", -1), -1))
             .otherwise(F.element_at(F.split(m, " ", -1), -1)))


def opponent_last_token(matchup) -> Column:
    """Variant used when building scoring rows: last whitespace token, ``@`` removed.
    A null matchup reads as the text ``None``, as ``str(None)`` would."""
    m = F.coalesce(_c(matchup), F.lit("None"))
    tok = F.element_at(F.split(F.trim(m), "\\s+", -1), -1)
    return F.when(m.contains("@"), F.replace(tok, F.lit("@"), F.lit(""))).otherwise(tok)


# ------------------------------------------------------------------ C4 / C5
def _colon_minutes(s: Column) -> Column:
    # one pass: with exactly one colon, the text before and after it; null operands give null
    one = F.length(s) - F.length(F.replace(s, F.lit(":"), F.lit(""))) == 1
    mins = F.substring_index(s, ":", 1).try_cast("double")
    secs = F.substring_index(s, ":", -1).try_cast("double")
    return F.when(one, mins + secs / 60.0)


def _first_digits(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"(\d+)", 1), F.lit("")).try_cast("double")


def minutes(raw) -> Column:
    """Null-preserving minutes parse: ``mm:ss`` -> m + s/60; a plain number; else
    the first digit run; else null.  Blank and null give null."""
    s = F.trim(_c(raw).cast("string"))
    # coalesce evaluates a later branch only where the earlier ones are null
    return F.coalesce(F.when(s.contains(":"), _colon_minutes(s)).otherwise(s.try_cast("double")), _first_digits(s))


def minutes_or_zero(raw) -> Column:
    """Zero-defaulting minutes parse: null, blank or unparsable -> 0; a malformed
    ``mm:ss`` falls back to its first digit run (else 0); no digit-run fallback
    without a colon."""
    s = F.trim(_c(raw).cast("string"))
    return F.coalesce(F.when(s.contains(":"), F.coalesce(_colon_minutes(s), _first_digits(s)))
                      .otherwise(s.try_cast("double")), F.lit(0.0))


# ------------------------------------------------------------------ B7-B10
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMM dd, yyyy",
                "MMM d, yyyy", "MM/dd/yyyy")
OFFSET_FORMAT = "yyyy-MM-dd'T'HH:mm:ssXXX"


#: Texts of the first three formats in full length, which the cast to a zone-free time reads as they do.
_PLAIN = r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}:[0-9]{2})?\z"


def parse_date(raw, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First format that parses wins; unparsable -> null (never raises).

    Case does not matter (``APR 14, 2024`` parses).  The text is read as UTC and its
    distance from 1970 is added to a zone-free epoch, so no session time zone or
    clock change touches the value; a text with an offset gives its UTC time.
    """
    norm = F.initcap(F.lower(F.trim(_c(raw).cast("string"))))
    utc = F.concat(norm, F.lit(" +0000"))
    read = [F.try_to_timestamp(utc, F.lit(f"{f} Z")) for f in formats]
    read.append(F.try_to_timestamp(F.upper(norm), F.lit(OFFSET_FORMAT)))
    micros = F.unix_micros(F.coalesce(*read))
    parsed = F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    if tuple(formats) != DATE_FORMATS:
        return parsed
    # a format that doesn't fit costs an error raised and caught for each row: plain texts try none
    plain = F.upper(F.trim(_c(raw).cast("string")))
    return F.when(plain.rlike(_PLAIN), plain.try_cast("timestamp_ntz")).otherwise(parsed)


def to_double(raw) -> Column:
    """Numeric coercion, bad values -> null."""
    return _c(raw).try_cast("double")


def to_double_or_zero(raw) -> Column:
    """Numeric coercion, bad or missing values -> 0."""
    return F.coalesce(_c(raw).try_cast("double"), F.lit(0.0))


_TRUE = ("true", "t", "yes", "y", "1")
_FALSE = ("false", "f", "no", "n", "0", "")


def to_bool(raw) -> Column:
    """Parse booleans from text ('False' is false, unlike a plain cast of a non-empty string)."""
    s = F.lower(F.trim(_c(raw).cast("string")))
    return F.when(s.isin(*_TRUE), True).when(s.isin(*_FALSE), False)


def to_id(raw) -> Column:
    """Numeric identifiers -> long; game ids stay strings (leading zeros)."""
    return _c(raw).try_cast("bigint")


def nan_to_null(x) -> Column:
    """NaN and null both mean missing; keep only null after ingest."""
    return F.nanvl(_c(x), F.lit(None).cast("double"))
