"""Series quality tests and the screened level built from them.

A series here is (keys, us, n, value) with ``n`` the dense row number over readings and missing steps.
Step counts are turned into rows from each series' own spacing, so frame widths differ by series:
blocks of a series' own width let running frames make up its windows (``row_clock`` is the same width as a RANGE frame).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions import flags
from sensorloom.functions.flags import FAIL, GOOD, MISSING, SUSPECT, UNKNOWN
from sensorloom.operators import grid
from sensorloom.operators.scale import framed, numbered, prefix, quantiles, runs
from sensorloom.session import checkpoint

MICROS = 1_000_000
TICK = 1 << 30  # one series-specific window on the rescaled clock: widths to 2**25 rows, 2**33 windows in a series
STEP_SECONDS = 900


def row_clock(n: Column, width: Column) -> Column:
    """``n`` in units of a window's TICK-th part, in whole numbers throughout."""
    whole = F.call_function("div", n, width)
    return whole * TICK + F.call_function("div", (n - whole * width) * TICK, width)


def spacing(df: DataFrame, keys: Sequence[str], chunk_us: int) -> DataFrame:
    """Each series' median spacing in microseconds; NULL with fewer than two rows."""
    gaps = prefix(df, keys, "us", {"_p": ("prev", F.col("us"))}, chunk_us, tie=("n",)).select(
        *keys, (F.col("us") - F.col("_p")).alias("gap")
    )
    return quantiles(gaps, keys, "gap", {"spacing": 0.5})


def rows_for(count: int, spacing_us: Column) -> Column:
    """How many rows span ``count`` quarter-hour steps, half to even and at least 1."""
    rows = F.bround(F.lit(float(count * STEP_SECONDS * MICROS)) / spacing_us).cast("bigint")
    return F.when(spacing_us > 0, F.greatest(rows, F.lit(1))).otherwise(F.lit(count)).cast("bigint")


def run_lengths(df: DataFrame, keys: Sequence[str], tolerance: float = 0.0,
                source: DataFrame | None = None) -> DataFrame:
    """How many rows back each value has stayed within tolerance; a gap starts over."""
    out = runs(
        df, keys, "n", lambda was, now: F.abs(now - was) > tolerance, "_run", also="value",
        start="_start", source=source,
    )
    return out.withColumn("run_length", F.col("n") - F.col("_start")).drop("_start", "_run")


def flat_line(df: DataFrame, keys: Sequence[str], suspect: Column, fail: Column,
              tolerance: float = 0.0, name: str = "flat_line", source: DataFrame | None = None) -> DataFrame:
    out = run_lengths(df, keys, tolerance, source)
    flag = (
        F.when(F.col("value").isNull(), MISSING)
        .when(F.col("run_length") >= fail, FAIL)
        .when(F.col("run_length") >= suspect, SUSPECT)
        .otherwise(GOOD)
    )
    return out.withColumn(name, flag).drop("run_length")


def attenuated(df: DataFrame, keys: Sequence[str], width: Column, min_std: Column | None = None,
               min_range: Column | None = None, name: str = "attenuated_signal") -> DataFrame:
    """Variability collapsed without going flat, over each series' own window.

    A block is as wide as the window, so a window is the end of one block and the start of the next. Each row takes up
    both from running frames and joins them: the work per row does not grow with the window.
    """
    at, value = F.col("n") - F.col("_block") * F.col("_w"), F.col("value")
    out = df.withColumn("_w", width).withColumn("_home", F.call_function("div", F.col("n"), F.col("_w")))
    out = out.withColumn("_block", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
    out = out.withColumn("_late", F.col("_block") == F.col("_home"))  # else a copy of the block before
    out = out.withColumn("_at", F.when(F.col("_late"), at).otherwise(at + F.col("_w")))
    series = Window.partitionBy(*keys, "_block")
    frames = {
        "e": (~F.col("_late"), series.orderBy(F.col("_at").desc(), F.col("_late").desc())),
        "l": (F.col("_late"), series.orderBy("_late", "_at")),
    }
    for part, (mine, order) in frames.items():
        w = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        seen = F.when(mine, value)
        out = out.withColumns({
            f"_n{part}": F.count(seen).over(w), f"_m{part}": F.avg(seen).over(w), f"_v{part}": F.var_pop(seen).over(w),
            f"_lo{part}": F.min(seen).over(w), f"_hi{part}": F.max(seen).over(w),
        })
    out = out.where("_late")
    ne, nl, seen = F.col("_ne"), F.col("_nl"), F.col("_ne") + F.col("_nl")
    apart = F.coalesce(F.col("_ml") - F.col("_me"), F.lit(0.0))
    squares = F.coalesce(F.col("_ve") * ne, F.lit(0.0)) + F.coalesce(F.col("_vl") * nl, F.lit(0.0))
    squares = squares + F.when((ne > 0) & (nl > 0), apart * apart * ne * nl / seen).otherwise(0.0)
    calm = F.lit(False)
    if min_std is not None:
        spread = F.when(seen > 1, F.sqrt(squares / (seen - 1)))
        calm = calm | F.coalesce(spread < min_std, F.lit(False))
    if min_range is not None:
        high, low = F.greatest("_hie", "_hil"), F.least("_loe", "_lol")
        calm = calm | F.coalesce(high - low < min_range, F.lit(False))
    judged = (F.col("n") + 1 >= F.col("_w")) & (seen >= 2)
    flag = F.when(value.isNull(), MISSING).when(judged & calm, SUSPECT).otherwise(GOOD)
    return out.withColumn(name, flag).select(*dict.fromkeys([*df.columns, name]))


def spike(df: DataFrame, keys: Sequence[str], threshold: Column, fail: Column | None = None,
          name: str = "spike") -> DataFrame:
    out = framed(
        df, keys, "n",
        {"_b": lambda w: F.lag("value").over(w), "_a": lambda w: F.lead("value").over(w)},
        before=1, after=1,
    )
    off = F.abs(F.col("value") - (F.col("_b") + F.col("_a")) * 0.5)
    flag = F.when(F.col("value").isNull(), MISSING)
    if fail is not None:
        flag = flag.when(off > fail, FAIL)
    flag = flag.when(off > threshold, SUSPECT).otherwise(GOOD)
    return out.withColumn(name, flag).drop("_a", "_b")


def rate_of_change(df: DataFrame, keys: Sequence[str], width: Column, threshold: Column,
                   span_seconds: int, name: str = "rate_of_change", source: DataFrame | None = None) -> DataFrame:
    """Change against the row one window earlier, the limit held to the same rate over other spans."""
    out = df.withColumn("_at", F.col("n") - width)
    earlier = (df if source is None else source).select(
        *keys, F.col("n").alias("_at"), F.col("value").alias("_v0"), F.col("us").alias("_t0")
    )
    out = out.join(earlier, [*keys, "_at"], "left")
    span = span_seconds * MICROS
    apart = F.col("us") - F.col("_t0")
    limit = F.when(apart != span, threshold * apart / span).otherwise(threshold)
    flag = (
        F.when(F.col("value").isNull(), MISSING)
        .when(F.abs(F.col("value") - F.col("_v0")) > limit, SUSPECT)
        .otherwise(GOOD)
    )
    return out.withColumn(name, flag).drop("_at", "_v0", "_t0")


def staleness(df: DataFrame, keys: Sequence[str], max_gap_us: int, chunk_us: int,
              name: str = "staleness", source: DataFrame | None = None) -> DataFrame:
    seen = F.when(F.col("value").isNotNull(), F.col("us"))
    out = prefix(df, keys, "us", {"_seen": ("last", seen)}, chunk_us, tie=("n",), source=source)
    flag = (
        F.when(F.col("value").isNotNull(), GOOD)
        .when(F.col("_seen").isNull(), MISSING)
        .when(F.col("us") - F.col("_seen") > max_gap_us, FAIL)
        .otherwise(SUSPECT)
    )
    return out.withColumn(name, flag).drop("_seen")


def time_gap(df: DataFrame, keys: Sequence[str], max_gap_us: int, chunk_us: int, name: str = "time_gap",
             source: DataFrame | None = None) -> DataFrame:
    """The reading after a long gap; the first reading takes the second's flag."""
    here = F.when(F.col("value").isNotNull(), F.col("us"))
    source = df if source is None else source
    out = prefix(df, keys, "us", {"_p": ("before", here)}, chunk_us, tie=("n",), source=source)
    out = prefix(out, keys, "us", {"_q": ("before", here)}, chunk_us, tie=("n",), reverse=True, source=source)
    gap = F.when(F.col("_p").isNotNull(), F.col("us") - F.col("_p")).otherwise(F.col("_q") - F.col("us"))
    flag = F.when(F.col("value").isNull(), MISSING).when(gap > max_gap_us, FAIL).otherwise(GOOD)
    return out.withColumn(name, flag).drop("_p", "_q")


def duplicate_share(df: DataFrame, keys: Sequence[str], at: str, value: str, fraction: float) -> DataFrame:
    """Pairs of members that ever read the same at the same moment: coincident, matched, share.

    Members meet on (stamp, value), so only matching readings make a pair; coincidence is counted afterwards and
    for those pairs alone.
    """
    (member,) = keys
    seen = df.where(F.col(value).isNotNull()).select(member, at, F.col(value).alias("_v"))
    left, right = seen.withColumnRenamed(member, "site_a"), seen.withColumnRenamed(member, "site_b")
    matched = checkpoint(left.join(right, [at, "_v"]).where("site_a < site_b").groupBy("site_a", "site_b").agg(F.count(F.lit(1)).alias("n_matched")))
    stamps = seen.select(member, at)
    both = matched.select("site_a", "site_b").join(stamps.withColumnRenamed(member, "site_a"), "site_a").join(
        stamps.withColumnRenamed(member, "site_b"), ["site_b", at])
    coincident = both.groupBy("site_a", "site_b").agg(F.count(F.lit(1)).alias("n_coincident"))
    out = matched.join(coincident, ["site_a", "site_b"])
    share = F.col("n_matched") / F.col("n_coincident")
    return out.withColumn("match_frac", share).withColumn("flagged", share > fraction)


def duplicate_feed(df: DataFrame, keys: Sequence[str], other: str, fraction: float, window: int | None = None,
                   name: str = "duplicate_feed") -> DataFrame:
    """Share of exact matches with another series on the same rows, whole or over a trailing window."""
    both = F.col("value").isNotNull() & F.col(other).isNotNull()
    match = F.when(both, (F.col("value") == F.col(other)).cast("double"))
    out = df.withColumn("_match", match)
    if window is None:
        share = out.groupBy(*keys).agg(F.coalesce(F.avg("_match"), F.lit(0.0)).alias("_share"))
        out = out.join(share, list(keys))
        flag = F.when(F.col("_share") > fraction, SUSPECT).otherwise(GOOD)
    else:
        out = framed(
            out, keys, "n", {"_share": lambda w: F.avg("_match").over(w.rowsBetween(1 - window, 0))}, before=window
        )
        flag = F.when((F.col("n") + 1 >= window) & (F.col("_share") > fraction), SUSPECT).otherwise(GOOD)
    return out.withColumn(name, F.when(F.col("value").isNull(), MISSING).otherwise(flag)).drop("_match", "_share")


def screening_spine(readings: DataFrame, sensors: DataFrame, keys: Sequence[str], chunk_seconds: int,
                    default: int = STEP_SECONDS) -> DataFrame:
    """Readings and, for in-service sensors, one NULL row per expected step nothing fell in.

    The step is the series' own cadence. Every test reads the numbered result, so callers store it.
    """
    pace = checkpoint(grid.cadence(readings, keys, chunk_seconds, default))  # one row per series
    whole = readings.agg(F.min("us").alias("_lo"), F.max("us").alias("_hi"))
    width = F.col("seconds") * MICROS
    ends = pace.crossJoin(whole).select(
        *keys, "seconds",
        F.ceil(F.col("_lo") / width).alias("_a"), (F.floor(F.col("_hi") / width) - 1).alias("_b"),
    )
    blocks = ends.where("_b >= _a").withColumn("_from", F.explode(F.sequence("_a", "_b", F.lit(4096).cast("bigint"))))
    steps = blocks.select(
        *keys, "seconds", F.explode(F.sequence("_from", F.least(F.col("_from") + 4095, F.col("_b")))).alias("_step")
    )
    seen = readings.join(pace, list(keys)).select(*keys, F.floor(F.col("us") / width).alias("_step"))
    empty = (
        steps.join(seen, [*keys, "_step"], "left_anti")
        .withColumn("us", F.col("_step") * width)
        .join(sensors, list(keys))
        .where(covers())
        .select(*keys, "us", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("double").alias("value"))
    )
    rows = readings.select(*keys, "us", "seq", "value").unionByName(empty)
    return numbered(rows, keys, "us", "n", chunk_seconds * MICROS, ("seq",))


def covers() -> Column:
    """In service and inside [install, removed)."""
    return (
        F.col("in_service")
        & F.col("install_us").isNotNull()
        & (F.col("us") >= F.col("install_us"))
        & (F.col("removed_us").isNull() | (F.col("us") < F.col("removed_us")))
    )


def battery(spine: DataFrame, thresholds: DataFrame, keys: Sequence[str], chunk_seconds: int,
            flat: tuple[int, int] = (24, 96), window: int = 24, stale_hours: float = 2,
            dry_floor: float = -25.0) -> DataFrame:
    """Every per-reading test with each series' own window lengths, and their worst.

    ``thresholds`` has one row per key: span_lo, span_hi, usual_lo, usual_hi, spike_over, change_over,
    calm_std, floor (true where the variable has an out-of-water floor).
    """
    chunk = chunk_seconds * MICROS
    gaps = checkpoint(spacing(spine, keys, chunk))  # one row per series
    out = spine.join(gaps, list(keys), "left").join(thresholds, list(keys))
    value = F.col("value")
    dry = F.when(F.col("has_floor"), flags.out_of_water(value, dry_floor, F.col("span_lo"))).otherwise(GOOD)
    ranged = flags.gross_range(
        value, (F.col("span_lo"), F.col("span_hi")), (F.col("usual_lo"), F.col("usual_hi"))
    )
    near_zero = F.col("has_floor") & (value >= dry_floor) & (value < 0)
    out = out.withColumns({
        "out_of_water": F.when(value.isNull(), MISSING).otherwise(dry),
        "gross_range": F.when(near_zero & (ranged == SUSPECT), GOOD).otherwise(ranged),
        "sentinel": flags.sentinel(value),
    })
    out = flat_line(out, keys, rows_for(flat[0], F.col("spacing")), rows_for(flat[1], F.col("spacing")), source=spine)
    out = attenuated(out, keys, rows_for(window, F.col("spacing")), F.col("calm_std"))
    out = spike(out, keys, F.col("spike_over"))
    out = rate_of_change(
        out, keys, rows_for(window, F.col("spacing")), F.col("change_over"), window * STEP_SECONDS, source=spine
    )
    out = staleness(out, keys, int(stale_hours * 3600 * MICROS), chunk, source=spine)
    return out.withColumn("flag", flags.worst(*[F.col(t) for t in TESTS]))


TESTS = ("out_of_water", "gross_range", "sentinel", "flat_line", "attenuated_signal", "spike",
         "rate_of_change", "staleness")


def screen(spine: DataFrame, sensors: DataFrame, thresholds: DataFrame, keys: Sequence[str],
           now_us: int, earliest_us: int, chunk_seconds: int, probe: str | None = None) -> DataFrame:
    """The screened level: battery, missing steps, impossible dates, gaps, dry probes, install dates."""
    out = battery(spine, thresholds, keys, chunk_seconds)
    out = time_gap(out, keys, 2 * 3600 * MICROS, chunk_seconds * MICROS, source=spine)
    date = F.when(F.col("value").isNull(), MISSING).otherwise(
        flags.impossible_date(F.col("us"), F.lit(now_us), F.lit(earliest_us))
    )
    out = out.withColumn("impossible_date", date)
    out = out.withColumn("flag", flags.worst(F.col("flag"), F.col("impossible_date")))
    out = out.join(sensors, list(keys))
    out = out.withColumn(
        "flag", F.when(F.col("value").isNotNull() & ~covers(), UNKNOWN).otherwise(F.col("flag"))
    )
    if probe is not None:
        out = dry_siblings(out, keys, probe)
    return out


def dry_siblings(df: DataFrame, keys: Sequence[str], depth: str) -> DataFrame:
    """A step where depth says the probe is dry marks the other readings of the same stamp."""
    site, variable = keys
    dry = (
        df.where((F.col(variable) == depth) & (F.col("out_of_water") == SUSPECT))
        .select(site, "us").distinct().withColumn("_dry", F.lit(True))
    )
    out = df.join(dry, [site, "us"], "left")
    hit = F.col("_dry").isNotNull() & (F.col(variable) != depth) & (F.col("flag") != MISSING)
    return out.withColumns({
        "out_of_water": F.when(F.col(variable) == depth, F.col("out_of_water"))
        .when(hit, SUSPECT).otherwise(GOOD),
        "flag": F.when(hit, flags.worst(F.col("flag"), F.lit(SUSPECT))).otherwise(F.col("flag")),
    }).drop("_dry")


def states(df: DataFrame, sensors: DataFrame, keys: Sequence[str], as_of_us: Column, stale_us: int,
           service_us: int, chunk_us: int) -> DataFrame:
    """NOT_INSTALLED, PRESENT, STALE or MISSING per step; scraped sites lose old gaps for good."""
    out = prefix(
        df, keys, "us", {"_seen": ("last", F.when(F.col("value").isNotNull(), F.col("us")))}, chunk_us, tie=("n",)
    ).join(sensors, list(keys), "left")
    there = F.coalesce(covers(), F.lit(False))
    gone = (F.col("source") == "scraped") & (F.col("us") < as_of_us - service_us)
    state = (
        F.when(~there, "NOT_INSTALLED")
        .when(F.col("value").isNotNull(), "PRESENT")
        .when(F.coalesce(gone, F.lit(False)), "NOT_INSTALLED")
        .when(F.col("us") - F.col("_seen") <= stale_us, "STALE")
        .otherwise("MISSING")
    )
    return out.withColumn("state", state).drop("_seen")


# How a state maps to a flag when no test has run.
STATE_FLAGS = {"NOT_INSTALLED": UNKNOWN, "PRESENT": GOOD, "STALE": SUSPECT, "MISSING": MISSING}


def state_over_flag(state: Column, flag: Column) -> Column:
    mapped = F.element_at(
        F.create_map(*[part for s, f in STATE_FLAGS.items() for part in (F.lit(s), F.lit(f))]), state
    )
    return F.when(state != "PRESENT", mapped).otherwise(flag)
