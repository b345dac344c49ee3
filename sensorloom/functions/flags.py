"""Quality flags and the tests that need one row only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The flag codes.
GOOD, UNKNOWN, SUSPECT, FAIL, MISSING = 1, 2, 3, 4, 9


def worst(*flags: Column) -> Column:
    """The most severe flag. Severity is UNKNOWN, GOOD, SUSPECT, FAIL, MISSING, not the codes' order."""
    severity = [
        F.when(f == UNKNOWN, 0).when(f == GOOD, 1).when(f == SUSPECT, 2).when(f == FAIL, 3).when(f == MISSING, 4)
        for f in flags
    ]
    top = F.greatest(*severity) if len(severity) > 1 else severity[0]
    return (
        F.when(top == 0, UNKNOWN).when(top == 1, GOOD).when(top == 2, SUSPECT).when(top == 3, FAIL).otherwise(MISSING)
    )


def _judged(value: Column, flag: Column) -> Column:
    return F.when(value.isNull(), MISSING).otherwise(flag)


def gross_range(value: Column, fail: tuple[Column, Column] | None = None,
                suspect: tuple[Column, Column] | None = None) -> Column:
    """Outside the probe's span fails, outside the site's usual range is suspect."""
    flag = F.lit(GOOD)
    if suspect is not None:
        flag = F.when((value < suspect[0]) | (value > suspect[1]), SUSPECT).otherwise(flag)
    if fail is not None:
        flag = F.when((value < fail[0]) | (value > fail[1]), FAIL).otherwise(flag)
    return _judged(value, flag)


def sentinel(value: Column, sentinels: Sequence[float] = (-9999.0,)) -> Column:
    return _judged(value, F.when(value.isin(*[float(s) for s in sentinels]), FAIL).otherwise(GOOD))


def out_of_water(depth: Column, floor: float, span_low: Column) -> Column:
    """Between the span's floor and ``floor`` the probe is possibly dry; under the span it fails elsewhere."""
    return _judged(depth, F.when((depth < floor) & (depth >= span_low), SUSPECT).otherwise(GOOD))


def impossible_date(us: Column, now_us: Column, low_us: Column | None = None,
                    high_us: Column | None = None) -> Column:
    bad = us > now_us
    if low_us is not None:
        bad = bad | (us < low_us)
    if high_us is not None:
        bad = bad | (us > high_us)
    return F.when(us.isNull(), MISSING).when(bad, FAIL).otherwise(GOOD)


def data_reception(us: Column, from_us: Column, hours: float = 6) -> Column:
    return F.when(us.isNull(), MISSING).when(from_us - us > hours * 3600e6, FAIL).otherwise(GOOD)


def non_good(tests: dict[str, Column], flag: Column) -> Column:
    """The record kept with a reading: only the tests that were not GOOD, nothing when MISSING."""
    pairs = [part for name, test in tests.items() for part in (F.lit(name), test)]
    return F.when(
        flag != MISSING, F.map_filter(F.create_map(*pairs), lambda _, v: v != GOOD)
    )
