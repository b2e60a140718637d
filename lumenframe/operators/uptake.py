"""Standardized uptake values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def tm_seconds(tm: Column) -> Column:
    """Seconds of a DICOM time HHMMSS[.fraction]; null for anything else. Shorter forms HH and HHMM count as whole."""
    fine = tm.rlike(r"^\s*\d{2}(\d{2}(\d{2}(\.\d*)?)?)?\s*$")
    t = F.trim(tm)
    part = lambda a: F.coalesce(F.substring(t, a, 2).try_cast("double"), F.lit(0.0))
    fraction = F.coalesce(F.concat(F.lit("0."), F.rpad(F.substring(F.regexp_extract(t, r"\.(\d*)$", 1), 1, 9), 9, "0")).try_cast("double"), F.lit(0.0))
    seconds = part(1) * 3600 + part(3) * 60 + part(5) + fraction
    return F.when(fine, seconds)


def elapsed(start: Column, scan: Column) -> Column:
    """Seconds from start to scan, both since midnight; a negative difference passes midnight once."""
    d = scan - start
    return F.when(d < 0, d + 86400).otherwise(d)


def suv_factor(weight_kg: Column, dose: Column, half_life: Column, start: Column, scan: Column, strict: bool = False) -> Column:
    """weight * 1000 / (dose decayed to the scan); inputs may be text. Null if anything is missing or no dose is left.

    strict raises on text that is no number instead of giving null.
    """
    number = (lambda c: c.cast("double")) if strict else (lambda c: c.try_cast("double"))
    left = number(dose) * F.exp(-math.log(2) * elapsed(tm_seconds(start), tm_seconds(scan)) / F.nullif(number(half_life), F.lit(0.0)))
    return F.when(left > 0, number(weight_kg) * 1000 / left)
