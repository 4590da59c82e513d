"""Text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: names that count as sensitive, matched anywhere, case-insensitive.
SENSITIVE = r"(?i)password|passwd|secret|token|authorization|cookie|api.?key|email|phone"

# Control characters with no spreadsheet form, formula starters.
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
FORMULA_START = r"(?U)^\s*[=+@-]"


def is_sensitive(text: Column) -> Column:
    return text.rlike(SENSITIVE)


def tokens(text: Column) -> Column:
    """Lower-cased runs of ``[a-z0-9_]``, duplicates kept, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), 1)


def normalize_name(text: Column) -> Column:
    return F.array_join(tokens(text), "")


def source_digest(text: Column) -> Column:
    """Text identity that ignores checkout line endings."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def safe_text(text: Column) -> Column:
    """Trimmed text, NULL where it is sensitive (see ``safe_text_reason``)."""
    return F.when(is_sensitive(text), F.lit(None)).otherwise(strip(text))


def safe_text_reason(text: Column) -> Column:
    return F.when(is_sensitive(text), F.lit("sensitive_requirements_not_supported"))


def strip(text: Column) -> Column:
    """Trim every Unicode blank, not only spaces."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def guard_formula(text: Column) -> Column:
    """Quote a cell a spreadsheet would run as a formula."""
    return F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)


def sanitize_cell(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_CHARS, "�")


def decimal_text(text: Column) -> Column:
    """True where trimmed text is a plain signed decimal."""
    return strip(text).rlike(r"(?U)^[+-]?\d+(\.\d+)?$")


def parse_number(text: Column) -> Column:
    return F.when(decimal_text(text), strip(text).try_cast("double"))


def parse_integer(text: Column) -> Column:
    """Whole number where the text has no fraction; NULL otherwise."""
    return F.when(decimal_text(text) & ~F.contains(text, F.lit(".")), strip(text).try_cast("bigint"))


def parse_boolean(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))


def pointer_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def iso_seconds(start: Column, end: Column) -> Column:
    """Seconds between two ISO timestamps, three digits, NULL on bad input."""
    a, b = F.try_to_timestamp(start), F.try_to_timestamp(end)
    return F.bround((F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6), 3)


def truncate_details(details: Column, allowed: Column, limit: int = 200) -> Column:
    """Allow-listed members of a string map, values cut to ``limit``."""
    kept = F.map_filter(details, lambda k, v: F.array_contains(allowed, k))
    return F.transform_values(kept, lambda k, v: F.substring(v, 1, limit))
