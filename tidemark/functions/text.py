"""Cleaning of headers, numbers and dates in issuer files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date patterns that issuer files use, tried in this order; fixed values.
DATE_PATTERNS = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss", "MMM d, yyyy", "MMMM d, yyyy", "M/d/yyyy", "M/d/yyyy HH:mm:ss", "d-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy/M/d", "yyyyMMdd"]


def header(c: Column) -> Column:
    """Trimmed, unquoted, lower case, single spaces."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")), r"\s+", " "))


def number(c: Column) -> Column:
    """Drops currency signs, separators and blanks; (x) is negative; dashes and N/A are null."""
    bare = F.regexp_replace(c, r"[$,\s]", "")
    signed = F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
    return F.when(signed.isin("", "-", "--", "N/A", "n/a"), None).otherwise(signed).try_cast("double")


def mixed_date(c: Column) -> Column:
    """The first pattern that fits; null if none does."""
    tries = [F.when(F.length(F.trim(c)) > 0, F.try_to_timestamp(F.trim(c), F.lit(p))) for p in DATE_PATTERNS]
    return F.coalesce(*tries).cast("date")
