"""Quality tests, levels and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions import flags
from sensorloom.operators import grid, quality
from sensorloom.operators.scale import framed, numbered, prefix, runs
from sensorloom.plans import base
from sensorloom.plans.base import DAY_US, EV, FAULTY, HOUR, KEYS, START_US, STEP, US
from sensorloom.plans.registry import query, r6
from sensorloom.session import level as stored
from sensorloom.sources import tables

CHUNK = 4 * 86400
END_US = START_US + 30 * DAY_US
NOW_US = START_US + 29 * DAY_US

NUM = f"{FAULTY}, s AS (SELECT *, row_number() OVER (PARTITION BY site, variable ORDER BY us, seq) - 1 AS n FROM ev)"
COARSE = (
    f"{EV}, s AS (SELECT site, variable, us, seq, floor(value / 40) * 40 AS value, "
    "row_number() OVER (PARTITION BY site, variable ORDER BY us, seq) - 1 AS n FROM ev)"
)
W = "(PARTITION BY site, variable ORDER BY n)"


def faulty(spark, sf):
    return tables.faulty_readings(spark, sf)


def numbered_faulty(spark, sf):
    return numbered(faulty(spark, sf), KEYS, "us", "n", CHUNK * US, ("seq",))


def coarse(spark, sf):
    rough = base.readings(spark, sf).withColumn("value", F.floor(F.col("value") / 40) * 40.0)
    return numbered(rough, KEYS, "us", "n", CHUNK * US, ("seq",))


@query("f1_gross_range", f"""
WITH {FAULTY} SELECT seq, CASE WHEN value IS NULL THEN 9 WHEN value < -50 OR value > 400 THEN 4
  WHEN value < 1 OR value > 200 THEN 3 ELSE 1 END AS flag FROM ev""")
def f1(spark, sf):
    lit = F.lit
    return faulty(spark, sf).select(
        "seq", flags.gross_range(F.col("value"), (lit(-50.0), lit(400.0)), (lit(1.0), lit(200.0))).alias("flag")
    )


@query("f2_flat_line", f"""
WITH {COARSE}, o AS (SELECT *, CASE WHEN abs(value - lag(value) OVER {W}) <= 0 THEN NULL ELSE n END AS opens FROM s),
r AS (SELECT *, n - max(opens) OVER {W} AS run FROM o)
SELECT seq, CASE WHEN value IS NULL THEN 9 WHEN run >= 5 THEN 4 WHEN run >= 3 THEN 3 ELSE 1 END AS flag FROM r""")
def f2(spark, sf):
    out = quality.flat_line(coarse(spark, sf), KEYS, F.lit(3), F.lit(5), name="flag")
    return out.select("seq", "flag")


@query("e12_run_length", f"""
WITH {COARSE}, o AS (SELECT *, CASE WHEN abs(value - lag(value) OVER {W}) <= 0 THEN NULL ELSE n END AS opens FROM s)
SELECT seq, n - max(opens) OVER {W} AS run_length FROM o""")
def e12(spark, sf):
    return quality.run_lengths(coarse(spark, sf), KEYS).select("seq", "run_length")


@query("e13_streaks", f"""
WITH {COARSE}, o AS (SELECT *, CASE WHEN value = lag(value) OVER {W} THEN 0 ELSE 1 END AS opens FROM s),
r AS (SELECT *, sum(opens) OVER {W} AS run FROM o)
SELECT seq, count(*) OVER (PARTITION BY site, variable, run) > 4 AS stuck FROM r""")
def e13(spark, sf):
    marked = runs(coarse(spark, sf), KEYS, "n", lambda was, now: was != now, also="value")
    held = marked.groupBy(*KEYS, "run").agg(F.count(F.lit(1)).alias("held"))
    return marked.join(held, [*KEYS, "run"]).select("seq", (F.col("held") > 4).alias("stuck"))


@query("f3_attenuated_signal", f"""
WITH {NUM}, a AS (SELECT *, stddev_samp(value) OVER p AS sd, count(value) OVER p AS c FROM s
  WINDOW p AS (PARTITION BY site, variable ORDER BY n ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT seq, CASE WHEN value IS NULL THEN 9 WHEN n >= 5 AND c >= 2 AND sd < 20 THEN 3 ELSE 1 END AS flag FROM a""")
def f3(spark, sf):
    out = quality.attenuated(numbered_faulty(spark, sf), KEYS, F.lit(6), F.lit(20.0), name="flag")
    return out.select("seq", "flag")


@query("e15_rolling_collapse", f"""
WITH {NUM} SELECT seq, r6(stddev_samp(value) OVER p) AS std, max(value) OVER p - min(value) OVER p AS spread FROM s
WINDOW p AS (PARTITION BY site, variable ORDER BY n ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def e15(spark, sf):
    out = framed(
        numbered_faulty(spark, sf), KEYS, "n",
        {
            "std": lambda w: r6(F.stddev_samp("value").over(w.rowsBetween(-5, 0))),
            "spread": lambda w: F.max("value").over(w.rowsBetween(-5, 0)) - F.min("value").over(w.rowsBetween(-5, 0)),
        },
        before=6,
    )
    return out.select("seq", "std", "spread")


@query("f4_spike", f"""
WITH {NUM}, a AS (SELECT *, abs(value - 0.5 * (lag(value) OVER {W} + lead(value) OVER {W})) AS off FROM s)
SELECT seq, CASE WHEN value IS NULL THEN 9 WHEN off > 150 THEN 4 WHEN off > 60 THEN 3 ELSE 1 END AS flag FROM a""")
def f4(spark, sf):
    out = quality.spike(numbered_faulty(spark, sf), KEYS, F.lit(60.0), F.lit(150.0), name="flag")
    return out.select("seq", "flag")


@query("e11_spike_excursion", f"""
WITH {NUM} SELECT seq, r6(abs(value - 0.5 * (lag(value) OVER {W} + lead(value) OVER {W}))) AS excursion FROM s""")
def e11(spark, sf):
    out = framed(
        numbered_faulty(spark, sf), KEYS, "n",
        {"b": lambda w: F.lag("value").over(w), "a": lambda w: F.lead("value").over(w)}, before=1, after=1,
    )
    return out.select("seq", r6(F.abs(F.col("value") - (F.col("b") + F.col("a")) * 0.5)).alias("excursion"))


@query("f5_rate_of_change", f"""
WITH {NUM}, a AS (SELECT *, lag(value, 4) OVER {W} AS v0, lag(us, 4) OVER {W} AS t0 FROM s)
SELECT seq, CASE WHEN value IS NULL THEN 9
  WHEN abs(value - v0) > CASE WHEN us - t0 <> {4 * HOUR * US} THEN 80.0 * (us - t0) / {4 * HOUR * US} ELSE 80.0 END
  THEN 3 ELSE 1 END AS flag FROM a""")
def f5(spark, sf):
    out = quality.rate_of_change(
        numbered_faulty(spark, sf), KEYS, F.lit(4).cast("bigint"), F.lit(80.0), 4 * HOUR, name="flag"
    )
    return out.select("seq", "flag")


@query("e14_change_vs_earlier_row", f"""
WITH {NUM} SELECT seq, r6(value - lag(value, 4) OVER {W}) AS change, us - lag(us, 4) OVER {W} AS apart_us FROM s""")
def e14(spark, sf):
    out = framed(
        numbered_faulty(spark, sf), KEYS, "n",
        {"v": lambda w: F.lag("value", 4).over(w), "t": lambda w: F.lag("us", 4).over(w)}, before=4,
    )
    return out.select("seq", r6(F.col("value") - F.col("v")).alias("change"), (F.col("us") - F.col("t")).alias("apart_us"))


@query("f6_sentinel", f"""
WITH {FAULTY} SELECT seq, CASE WHEN value IS NULL THEN 9 WHEN value = -9999 THEN 4 ELSE 1 END AS flag,
  coalesce(value IN (-9999, -999, -99) OR value < 0, false) AS sentinel_or_negative FROM ev""")
def f6(spark, sf):
    v = F.col("value")
    return faulty(spark, sf).select(
        "seq", flags.sentinel(v).alias("flag"),
        F.coalesce(v.isin(-9999.0, -999.0, -99.0) | (v < 0), F.lit(False)).alias("sentinel_or_negative"),
    )


FEED = f"""{EV}, h AS (SELECT site, us // {HOUR * US} AS n, floor(arg_min(value, (us, seq)) / 60) AS value FROM ev GROUP BY ALL),
j AS (SELECT a.site, a.n, a.value, b.value AS other FROM h a LEFT JOIN h b ON b.site = 'view' AND a.n = b.n)"""


def _feed(spark, sf):
    hourly = grid.resample(
        base.readings(spark, sf), ["site"], HOUR, {"value": F.floor(F.min_by("value", F.struct("us", "seq")) / 60)}
    ).withColumnRenamed("step", "n")
    other = hourly.where("site = 'view'").select("n", F.col("value").alias("other"))
    return hourly.join(other, "n", "left")


@query("f7_duplicate_feed", f"""
WITH {FEED}, m AS (SELECT site, coalesce(avg((value = other)::INT), 0) AS share FROM j GROUP BY site)
SELECT site, n, CASE WHEN value IS NULL THEN 9 WHEN share > 0.4 THEN 3 ELSE 1 END AS flag FROM j JOIN m USING (site)""")
def f7(spark, sf):
    return quality.duplicate_feed(_feed(spark, sf), ["site"], "other", 0.4, name="flag").select("site", "n", "flag")


@query("e16_rolling_match_share", f"""
WITH {FEED}, d AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n) - 1 AS i FROM j),
s AS (SELECT *, avg((value = other)::INT) OVER (PARTITION BY site ORDER BY i ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS share FROM d)
SELECT site, n, CASE WHEN i >= 11 AND share > 0.5 THEN 3 ELSE 1 END AS flag FROM s""")
def e16(spark, sf):
    feed = _feed(spark, sf).withColumnRenamed("n", "hour")
    placed = numbered(feed, ["site"], "hour", "n")
    out = quality.duplicate_feed(placed, ["site"], "other", 0.5, window=12, name="flag")
    return out.select("site", F.col("hour").alias("n"), "flag")


@query("c4_site_pair_duplicates", f"""
WITH {EV}, h AS (SELECT site, us // {HOUR * US} AS n, floor(arg_min(value, (us, seq)) / 60) AS value FROM ev GROUP BY ALL)
SELECT a.site AS site_a, b.site AS site_b, count(*) AS n_coincident, count_if(a.value = b.value) AS n_matched,
  r6(count_if(a.value = b.value) / count(*)) AS match_frac, count_if(a.value = b.value) / count(*) > 0.4 AS flagged
FROM h a JOIN h b ON a.n = b.n AND a.site < b.site GROUP BY ALL HAVING count_if(a.value = b.value) > 0""")
def c4(spark, sf):
    hourly = _feed(spark, sf).drop("other")
    out = quality.duplicate_share(hourly, ["site"], "n", "value", 0.4)
    return out.withColumn("match_frac", r6("match_frac"))


STALE = f"""{FAULTY}, s AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN us END) OVER (
  PARTITION BY site, variable ORDER BY us, seq) AS seen FROM ev)"""


@query("f8_staleness", f"""
WITH {STALE} SELECT seq, CASE WHEN value IS NOT NULL THEN 1 WHEN seen IS NULL THEN 9
  WHEN us - seen > {HOUR * US} THEN 4 ELSE 3 END AS flag FROM s""")
def f8(spark, sf):
    out = quality.staleness(
        faulty(spark, sf).withColumn("n", F.col("seq")), KEYS, HOUR * US, CHUNK * US, name="flag"
    )
    return out.select("seq", "flag")


@query("e17_carry_forward_age", f"WITH {STALE} SELECT seq, us - seen AS age_us FROM s")
def e17(spark, sf):
    here = F.when(F.col("value").isNotNull(), F.col("us"))
    out = prefix(faulty(spark, sf), KEYS, "us", {"seen": ("last", here)}, CHUNK * US, tie=("seq",))
    return out.select("seq", (F.col("us") - F.col("seen")).alias("age_us"))


@query("f9_impossible_date", f"""
WITH {EV} SELECT seq, CASE WHEN us > {NOW_US} OR us < {START_US + DAY_US} THEN 4 ELSE 1 END AS flag FROM ev""")
def f9(spark, sf):
    return base.readings(spark, sf).select(
        "seq", flags.impossible_date(F.col("us"), F.lit(NOW_US), F.lit(START_US + DAY_US)).alias("flag")
    )


@query("f10_data_reception", f"""
WITH {EV} SELECT seq, CASE WHEN {END_US} - us > {6 * HOUR * US} THEN 4 ELSE 1 END AS flag FROM ev""")
def f10(spark, sf):
    return base.readings(spark, sf).select("seq", flags.data_reception(F.col("us"), F.lit(END_US)).alias("flag"))


GAP = f"""{FAULTY}, s AS (
  SELECT seq, us, lag(us) OVER w AS p, lead(us) OVER w AS q FROM ev WHERE value IS NOT NULL
  WINDOW w AS (PARTITION BY site, variable ORDER BY us, seq))"""


@query("f11_time_gap", f"""
WITH {GAP} SELECT ev.seq, CASE WHEN ev.value IS NULL THEN 9
   WHEN coalesce(s.us - s.p, s.q - s.us) > {2 * HOUR * US} THEN 4 ELSE 1 END AS flag
FROM ev LEFT JOIN s ON ev.seq = s.seq""")
def f11(spark, sf):
    out = quality.time_gap(
        faulty(spark, sf).withColumn("n", F.col("seq")), KEYS, 2 * HOUR * US, CHUNK * US, name="flag"
    )
    return out.select("seq", "flag")


@query("e18_time_gap_before", f"WITH {GAP} SELECT seq, us - p AS gap_us FROM s")
def e18(spark, sf):
    here = faulty(spark, sf).where("value IS NOT NULL")
    out = prefix(here, KEYS, "us", {"p": ("prev", F.col("us"))}, CHUNK * US, tie=("seq",))
    return out.select("seq", (F.col("us") - F.col("p")).alias("gap_us"))


@query("f12_out_of_water", f"""
WITH {FAULTY}, b AS (SELECT site, variable, us // {STEP * US} AS step, arg_min(value, (us, seq)) AS value FROM ev
  WHERE value IS NOT NULL GROUP BY ALL),
d AS (SELECT site, step FROM b WHERE variable = 'depth' AND value < -25 AND value >= -50)
SELECT site, variable, step, CASE WHEN d.site IS NOT NULL THEN 3 ELSE 1 END AS out_of_water,
  CASE WHEN value = -9999 THEN 4 WHEN d.site IS NOT NULL THEN 3 ELSE 1 END AS flag
FROM b LEFT JOIN d USING (site, step)""")
def f12(spark, sf):
    seen = faulty(spark, sf).where("value IS NOT NULL")
    bins = grid.resample(seen, KEYS, STEP, {"value": F.min_by("value", F.struct("us", "seq"))})
    dry = F.when(F.col("variable") == "depth", flags.out_of_water(F.col("value"), -25.0, F.lit(-50.0))).otherwise(1)
    out = bins.withColumn("us", F.col("step")).withColumn("out_of_water", dry)
    out = out.withColumn("flag", flags.worst(F.col("out_of_water"), flags.sentinel(F.col("value"))))
    return quality.dry_siblings(out, KEYS, "depth").select(*KEYS, "step", "out_of_water", "flag")


@query("f13_worst_of", f"""
WITH {FAULTY}, f AS (SELECT seq, CASE WHEN value IS NULL THEN 9 WHEN value < -50 THEN 4 ELSE 1 END AS a,
  CASE WHEN value < 1 THEN 3 WHEN value IS NULL THEN 2 ELSE 1 END AS b, CASE WHEN seq % 5 = 0 THEN 2 ELSE 1 END AS c FROM ev)
SELECT seq, CASE WHEN 9 IN (a, b, c) THEN 9 WHEN 4 IN (a, b, c) THEN 4 WHEN 3 IN (a, b, c) THEN 3
  WHEN 1 IN (a, b, c) THEN 1 ELSE 2 END AS flag FROM f""")
def f13(spark, sf):
    v = F.col("value")
    a = F.when(v.isNull(), 9).when(v < -50, 4).otherwise(1)
    b = F.when(v < 1, 3).when(v.isNull(), 2).otherwise(1)
    c = F.when(F.col("seq") % 5 == 0, 2).otherwise(1)
    return faulty(spark, sf).select("seq", flags.worst(a, b, c).alias("flag"))


SENSORS = f"""sensors AS (
  SELECT site, variable, variable <> 'temperature' OR site <> 'view' AS in_service,
         {START_US} + CASE WHEN site = 'click' THEN {3 * DAY_US} ELSE 0 END AS install_us,
         CASE WHEN site = 'purchase' AND variable = 'depth' THEN {START_US + 20 * DAY_US} END AS removed_us,
         CASE WHEN site = 'signup' THEN 'scraped' ELSE 'feed' END AS source
  FROM (SELECT DISTINCT site, variable FROM ev))"""


def sensors(spark, sf):
    site, variable = F.col("site"), F.col("variable")
    return base.readings(spark, sf).select(*KEYS).distinct().select(
        *KEYS,
        ((variable != "temperature") | (site != "view")).alias("in_service"),
        (F.lit(START_US) + F.when(site == "click", 3 * DAY_US).otherwise(0)).alias("install_us"),
        F.when((site == "purchase") & (variable == "depth"), START_US + 20 * DAY_US).alias("removed_us"),
        F.when(site == "signup", "scraped").otherwise("feed").alias("source"),
    )


def thresholds(spark, sf):
    variable = F.col("variable")
    depth = variable == "depth"
    return base.readings(spark, sf).select(*KEYS).distinct().select(
        *KEYS, depth.alias("has_floor"), F.lit(-50.0).alias("span_lo"), F.lit(400.0).alias("span_hi"),
        F.when(depth, 0.0).otherwise(1.0).alias("usual_lo"), F.lit(200.0).alias("usual_hi"),
        F.lit(120.0).alias("spike_over"), F.lit(90.0).alias("change_over"), F.lit(15.0).alias("calm_std"),
    )


# The battery with each series' own row counts. SQL frames take no per-row width, so the window
# tests aggregate a list of the last 64 rows cut to the series' own width.
BATTERY = f"""{FAULTY}, {SENSORS},
gaps AS (SELECT site, variable, us - lag(us) OVER (PARTITION BY site, variable ORDER BY us, seq) AS gap FROM ev),
pace AS (SELECT site, variable, greatest(CAST(round_even(quantile_cont(gap, 0.5) / 60e6, 0) AS BIGINT) * 60, 60) * {US} AS wide FROM gaps GROUP BY ALL),
lims AS (SELECT min(us) AS lo, max(us) AS hi FROM ev),
steps AS (SELECT site, variable, wide, unnest(range((lo + wide - 1) // wide, hi // wide)) AS k FROM pace, lims),
empty AS (
  SELECT k.site, k.variable, k.k * k.wide AS us FROM steps k JOIN sensors c USING (site, variable)
  WHERE in_service AND k.k * k.wide >= install_us AND (removed_us IS NULL OR k.k * k.wide < removed_us)
    AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.site = k.site AND e.variable = k.variable AND e.us // k.wide = k.k)),
u AS (SELECT site, variable, us, seq, value FROM ev UNION ALL SELECT site, variable, us, NULL, NULL FROM empty),
s AS (SELECT *, row_number() OVER (PARTITION BY site, variable ORDER BY us, seq NULLS FIRST) - 1 AS n FROM u),
sg AS (SELECT site, variable, quantile_cont(gap, 0.5) AS spacing FROM
  (SELECT site, variable, us - lag(us) OVER (PARTITION BY site, variable ORDER BY n) AS gap FROM s) GROUP BY ALL),
wd AS (SELECT site, variable, greatest(CAST(round_even(24 * 900e6 / spacing, 0) AS BIGINT), 1) AS w24,
              greatest(CAST(round_even(96 * 900e6 / spacing, 0) AS BIGINT), 1) AS w96 FROM sg),
a AS (
  SELECT s.*, w24, w96, lag(value) OVER p AS b1, lead(value) OVER p AS a1,
         list(struct_pack(n := n, v := value)) OVER (PARTITION BY site, variable ORDER BY n ROWS BETWEEN 511 PRECEDING AND CURRENT ROW) AS back,
         max(CASE WHEN value IS NOT NULL THEN us END) OVER p AS seen,
         CASE WHEN value = lag(value) OVER p THEN NULL ELSE n END AS opens
  FROM s JOIN wd USING (site, variable) WINDOW p AS (PARTITION BY site, variable ORDER BY n)),
b AS (
  SELECT a.*, n - max(opens) OVER (PARTITION BY site, variable ORDER BY n) AS run,
         list_filter(list_transform(list_filter(back, lambda x: x.n > a.n - a.w24), lambda x: x.v), lambda v: v IS NOT NULL) AS win
  FROM a),
c AS (SELECT b.*, e.value AS v0, e.us AS t0 FROM b LEFT JOIN s e
       ON e.site = b.site AND e.variable = b.variable AND e.n = b.n - b.w24),
t AS (
  SELECT site, variable, us, seq, n, value,
   CASE WHEN value IS NULL THEN 9 WHEN variable = 'depth' AND value < -25 AND value >= -50 THEN 3 ELSE 1 END AS out_of_water,
   CASE WHEN value IS NULL THEN 9 WHEN value < -50 OR value > 400 THEN 4
        WHEN variable = 'depth' AND value >= -25 AND value < 0 THEN 1
        WHEN value < CASE variable WHEN 'depth' THEN 0 ELSE 1 END OR value > 200 THEN 3 ELSE 1 END AS gross_range,
   CASE WHEN value IS NULL THEN 9 WHEN value = -9999 THEN 4 ELSE 1 END AS sentinel,
   CASE WHEN value IS NULL THEN 9 WHEN run >= w96 THEN 4 WHEN run >= w24 THEN 3 ELSE 1 END AS flat_line,
   CASE WHEN value IS NULL THEN 9 WHEN n + 1 >= w24 AND len(win) >= 2 AND list_aggregate(win, 'stddev_samp') < 15 THEN 3 ELSE 1 END AS attenuated_signal,
   CASE WHEN value IS NULL THEN 9 WHEN abs(value - 0.5 * (b1 + a1)) > 120 THEN 3 ELSE 1 END AS spike,
   CASE WHEN value IS NULL THEN 9 WHEN abs(value - v0) > CASE WHEN us - t0 <> 21600000000 THEN 90.0 * (us - t0) / (21600000000) ELSE 90.0 END THEN 3 ELSE 1 END AS rate_of_change,
   CASE WHEN value IS NOT NULL THEN 1 WHEN seen IS NULL THEN 9 WHEN us - seen > {2 * HOUR * US} THEN 4 ELSE 3 END AS staleness
  FROM c),
battery AS (
  SELECT *, CASE WHEN 9 IN (out_of_water, gross_range, sentinel, flat_line, attenuated_signal, spike, rate_of_change, staleness) THEN 9
    WHEN 4 IN (out_of_water, gross_range, sentinel, flat_line, attenuated_signal, spike, rate_of_change, staleness) THEN 4
    WHEN 3 IN (out_of_water, gross_range, sentinel, flat_line, attenuated_signal, spike, rate_of_change, staleness) THEN 3 ELSE 1 END AS worst
  FROM t)"""

SCREENED = (
    BATTERY
    + f""", pr AS (
  SELECT site, variable, n, lag(us) OVER p AS pu, lead(us) OVER p AS nu FROM t WHERE value IS NOT NULL
  WINDOW p AS (PARTITION BY site, variable ORDER BY n)),
screened AS (
  SELECT b.site, b.variable, b.us, b.seq, b.value, {', '.join('b.' + t for t in quality.TESTS)},
    CASE WHEN b.value IS NULL THEN 9 WHEN b.us > {NOW_US} OR b.us < {START_US} THEN 4 ELSE 1 END AS impossible_date,
    CASE WHEN b.value IS NULL THEN 9 WHEN coalesce(b.us - pu, nu - b.us) > {2 * HOUR * US} THEN 4 ELSE 1 END AS time_gap,
    CASE WHEN b.value IS NULL THEN 9
         WHEN NOT (in_service AND b.us >= install_us AND (removed_us IS NULL OR b.us < removed_us)) THEN 2
         WHEN b.us > {NOW_US} OR b.us < {START_US} THEN greatest(b.worst, 4) ELSE b.worst END AS flag
  FROM battery b LEFT JOIN pr USING (site, variable, n) JOIN sensors USING (site, variable))"""
)


def spine(spark, sf):
    return stored(
        spark, ("spine", sf),
        lambda: quality.screening_spine(faulty(spark, sf), sensors(spark, sf), KEYS, CHUNK),
    )


def screened(spark, sf):
    return stored(
        spark, ("screened", sf),
        lambda: quality.screen(
            spine(spark, sf), sensors(spark, sf), thresholds(spark, sf), KEYS, NOW_US, START_US, CHUNK
        ),
    )


@query("f14_reading_battery", f"""
WITH {BATTERY} SELECT site, variable, us, {', '.join(quality.TESTS)}, worst AS flag FROM battery""")
def f14(spark, sf):
    out = quality.battery(spine(spark, sf), thresholds(spark, sf), KEYS, CHUNK)
    return out.select(*KEYS, "us", *quality.TESTS, "flag")


@query("f15_screen_table", f"WITH {SCREENED} SELECT site, variable, us, impossible_date, time_gap, flag FROM screened")
def f15(spark, sf):
    return screened(spark, sf).select(*KEYS, "us", "impossible_date", "time_gap", "flag")


LOG = f"""log(line, site, variable, a, b) AS (VALUES
  (2, 'view', 'conductivity', {START_US + 3 * DAY_US}, {START_US + 5 * DAY_US}),
  (3, 'view', 'depth', {START_US + 3 * DAY_US}, {START_US + 5 * DAY_US}),
  (4, 'click', 'depth', {START_US + 10 * DAY_US}, NULL),
  (5, 'view', 'conductivity', {START_US + 4 * DAY_US}, {START_US + 6 * DAY_US}))"""


def field_log(spark):
    """Four log lines, the last column open where the note has no end."""
    rows = [
        (2, "view", ["conductivity", "depth"], START_US + 3 * DAY_US, START_US + 5 * DAY_US),
        (4, "click", ["depth"], START_US + 10 * DAY_US, None),
        (5, "view", ["conductivity"], START_US + 4 * DAY_US, START_US + 6 * DAY_US),
    ]
    lines = spark.createDataFrame(rows, "line int, site string, variables array<string>, a bigint, b bigint")
    spread = lines.select("line", "site", F.posexplode("variables").alias("pos", "variable"), "a", "b")
    return spread.withColumn("line", F.col("line") + F.col("pos")).drop("pos")


REVIEWED = (
    SCREENED
    + f""", {LOG}, reviewed AS (
  SELECT s.site, s.variable, s.us, s.value,
     CASE WHEN h.line IS NOT NULL THEN h.line WHEN s.flag IN (4, 9) THEN -1 ELSE 0 END AS removed_by
  FROM screened s LEFT JOIN (
    SELECT s.site, s.variable, s.us, min(line) AS line FROM screened s JOIN log l
      ON s.site = l.site AND s.variable = l.variable AND s.us >= a AND s.us <= coalesce(b, 9e18)
    GROUP BY ALL) h USING (site, variable, us)
  WHERE s.value IS NOT NULL)"""
)


def reviewed(spark, sf):
    from sensorloom.operators.levels import review

    return review(screened(spark, sf), field_log(spark), KEYS, DAY_US)


@query("f16_reviewed_level", f"""
WITH {REVIEWED} SELECT site, variable, us, CASE WHEN removed_by = 0 THEN value END AS value, removed_by FROM reviewed""")
def f16(spark, sf):
    return reviewed(spark, sf).select(*KEYS, "us", "value", "removed_by")


@query("d6_removal_accounting", f"""
WITH {REVIEWED} SELECT site, variable, removed_by AS line, count(*) AS readings FROM reviewed
WHERE removed_by <> 0 GROUP BY ALL""")
def d6(spark, sf):
    return (
        reviewed(spark, sf).where("removed_by <> 0")
        .groupBy(*KEYS, F.col("removed_by").alias("line")).agg(F.count(F.lit(1)).alias("readings"))
    )


@query("c5_field_log_join", f"""
WITH {EV}, {LOG} SELECT seq, min(line) AS line FROM ev JOIN log l
  ON ev.site = l.site AND ev.variable = l.variable AND us >= a AND us <= coalesce(b, 9e18) GROUP BY seq""")
def c5(spark, sf):
    from sensorloom.operators.levels import excluded_by

    return excluded_by(base.readings(spark, sf), field_log(spark), KEYS, DAY_US).where("line > 0").select("seq", "line")


@query("b5_flag_policy", f"""
WITH {SCREENED} SELECT site, variable, count(value) AS readings,
  count(CASE WHEN flag NOT IN (4, 9) THEN value END) AS kept, count(CASE WHEN flag IN (4, 9) THEN value END) AS removed
FROM screened GROUP BY ALL""")
def b5(spark, sf):
    from sensorloom.operators.levels import keep

    return keep(screened(spark, sf), (4, 9)).groupBy(*KEYS).agg(
        F.count("value").alias("readings"), F.count("kept").alias("kept"),
        (F.count("value") - F.count("kept")).alias("removed"),
    )


@query("f20_held_back", f"""
WITH {SCREENED} SELECT site, count(CASE WHEN flag IN (3, 4) THEN value END) AS held FROM screened GROUP BY site""")
def f20(spark, sf):
    from sensorloom.operators.levels import keep

    return keep(screened(spark, sf), (3, 4)).groupBy("site").agg(
        (F.count("value") - F.count("kept")).alias("held")
    )


@query("f21_test_record", f"""
WITH {SCREENED}, k AS (
  SELECT site, variable, us, {', '.join(f"CASE WHEN {t} <> 1 THEN '{t}=' || {t} END AS {t}" for t in sorted(quality.TESTS))}, flag FROM screened)
SELECT site, variable, us, CASE WHEN flag <> 9 THEN concat_ws(',', {', '.join(sorted(quality.TESTS))}) END AS tests FROM k""")
def f21(spark, sf):
    record = flags.non_good({t: F.col(t) for t in sorted(quality.TESTS)}, F.col("flag"))
    text = F.concat_ws(
        ",", F.transform(F.map_entries("tests"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    )
    return screened(spark, sf).withColumn("tests", record).select(
        *KEYS, "us", F.when(F.col("tests").isNotNull(), text).alias("tests")
    )


@query("b6_admit_grid", f"""
WITH {SCREENED} SELECT site, us // {STEP * US} AS step, bool_and(flag NOT IN (4, 9)) AS admitted FROM screened GROUP BY ALL""")
def b6(spark, sf):
    return (
        screened(spark, sf).groupBy("site", grid.step_of("us", STEP).alias("step"))
        .agg(F.bool_and(~F.col("flag").isin(4, 9)).alias("admitted"))
    )


STATES = f"""{BATTERY}, st AS (
  SELECT s.*, max(CASE WHEN value IS NOT NULL THEN us END) OVER (PARTITION BY site, variable ORDER BY n) AS seen FROM s),
states AS (
  SELECT st.site, st.variable, st.us, st.n, st.value,
   CASE WHEN NOT (in_service AND us >= install_us AND (removed_us IS NULL OR us < removed_us)) THEN 'NOT_INSTALLED'
        WHEN value IS NOT NULL THEN 'PRESENT'
        WHEN source = 'scraped' AND us < {END_US - 7 * DAY_US} THEN 'NOT_INSTALLED'
        WHEN us - seen <= {2 * HOUR * US} THEN 'STALE' ELSE 'MISSING' END AS state
  FROM st JOIN sensors USING (site, variable))"""


def states(spark, sf):
    return quality.states(
        spine(spark, sf), sensors(spark, sf), KEYS, F.lit(END_US), 2 * HOUR * US, 7 * DAY_US, CHUNK * US
    )


@query("f17_sensor_state", f"WITH {STATES} SELECT site, variable, us, state FROM states")
def f17(spark, sf):
    return states(spark, sf).select(*KEYS, "us", "state")


@query("d7_state_counts", f"""
WITH {STATES}, names(state) AS (VALUES ('NOT_INSTALLED'), ('PRESENT'), ('STALE'), ('MISSING'))
SELECT d.site, d.variable, n.state, count(s.us) AS steps FROM (SELECT DISTINCT site, variable FROM states) d
CROSS JOIN names n LEFT JOIN states s ON s.site = d.site AND s.variable = d.variable AND s.state = n.state GROUP BY ALL""")
def d7(spark, sf):
    wide = states(spark, sf).groupBy(*KEYS).agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in quality.STATE_FLAGS]
    )
    return wide.unpivot(list(KEYS), list(quality.STATE_FLAGS), "state", "steps")


@query("f18_state_over_flag", f"""
WITH {STATES} SELECT s.site, s.variable, s.us, CASE state WHEN 'NOT_INSTALLED' THEN 2 WHEN 'STALE' THEN 3
  WHEN 'MISSING' THEN 9 ELSE worst END AS flag FROM states s JOIN battery b USING (site, variable, n)""")
def f18(spark, sf):
    rows = spine(spark, sf)
    tested = quality.battery(rows, thresholds(spark, sf), KEYS, CHUNK)
    placed = quality.states(tested, sensors(spark, sf), KEYS, F.lit(END_US), 2 * HOUR * US, 7 * DAY_US, CHUNK * US)
    return placed.select(*KEYS, "us", quality.state_over_flag(F.col("state"), F.col("flag")).alias("flag"))


@query("f19_model_mask", f"""
WITH {FAULTY}, {SENSORS} SELECT seq, CASE WHEN value <> -9999 AND in_service AND us >= install_us
  AND (removed_us IS NULL OR us < removed_us) THEN value END AS value FROM ev JOIN sensors USING (site, variable)""")
def f19(spark, sf):
    kept = F.when((F.col("value") != -9999.0) & quality.covers(), F.col("value"))
    return faulty(spark, sf).join(sensors(spark, sf), list(KEYS)).select("seq", kept.alias("value"))


@query("b11_install_interval", f"""
WITH {EV}, {SENSORS} SELECT seq, in_service AND us >= install_us AND (removed_us IS NULL OR us < removed_us) AS there
FROM ev JOIN sensors USING (site, variable)""")
def b11(spark, sf):
    return base.readings(spark, sf).join(sensors(spark, sf), list(KEYS)).select("seq", quality.covers().alias("there"))


@query("f22_table_check", f"""
WITH {FAULTY}, l AS (SELECT *, us - lag(us) OVER (PARTITION BY site ORDER BY seq) AS gap FROM ev),
c AS (SELECT site, count_if(value < -50 OR value > 400) AS out_of_span, count(*) - count(DISTINCT us) AS repeated,
        count_if(gap < 0) AS out_of_order, count_if(us > {NOW_US}) AS future, quantile_cont(gap, 0.5) AS middle FROM l GROUP BY site),
p AS (SELECT site, 'outside span' AS problem, out_of_span AS readings FROM c
  UNION ALL SELECT site, 'repeated times', repeated FROM c UNION ALL SELECT site, 'times out of order', out_of_order FROM c
  UNION ALL SELECT site, 'times in the future', future FROM c
  UNION ALL SELECT site, 'not on cadence', CASE WHEN abs(middle - 900e6) > 60e6 THEN 1 ELSE 0 END FROM c)
SELECT site, problem, CAST(readings AS BIGINT) AS readings FROM p WHERE readings > 0""")
def f22(spark, sf):
    from sensorloom.operators.health import table_check

    return table_check(faulty(spark, sf), ["site"], (-50.0, 400.0), NOW_US, 900, 60, CHUNK * US)


@query("d8_qc_report", f"""
WITH {FAULTY}, sen AS (SELECT 'sentinels' AS section, site, variable AS item, count_if(coalesce(value IN (-9999, -999, -99) OR value < 0, false)) AS hits, count(*) AS of FROM ev GROUP BY ALL),
h AS (SELECT site, us // {HOUR * US} AS n, floor(arg_min(value, (us, seq)) / 60) AS value FROM clean_ev GROUP BY ALL),
dup AS (SELECT 'duplicates', a.site, b.site, count_if(a.value = b.value), count(*) FROM h a JOIN h b ON a.n = b.n AND a.site < b.site GROUP BY ALL HAVING count_if(a.value = b.value) > 0),
o AS (SELECT site, variable, us, seq, CASE WHEN floor(value / 40) = lag(floor(value / 40)) OVER w THEN 0 ELSE 1 END AS opens FROM clean_ev WINDOW w AS (PARTITION BY site, variable ORDER BY us, seq)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY site, variable ORDER BY us, seq) AS run FROM o),
held AS (SELECT site, variable, run, count(*) AS n FROM r GROUP BY ALL HAVING count(*) > 4),
str AS (SELECT 'streaks', site, variable, sum(n)::BIGINT, count(*) FROM held GROUP BY site, variable)
SELECT * FROM sen UNION ALL SELECT * FROM dup UNION ALL SELECT * FROM str""")
def d8(spark, sf):
    """One report: sentinel readings of all, matching readings of site pairs, rows and runs of long streaks."""
    v = F.col("value")
    bad = F.coalesce(v.isin(-9999.0, -999.0, -99.0) | (v < 0), F.lit(False))
    sentinels = faulty(spark, sf).groupBy(*KEYS).agg(F.count_if(bad).alias("hits"), F.count(F.lit(1)).alias("of"))
    pairs = quality.duplicate_share(_feed(spark, sf).drop("other"), ["site"], "n", "value", 0.4)
    marked = runs(coarse(spark, sf), KEYS, "n", lambda was, now: was != now, also="value")
    held = marked.groupBy(*KEYS, "run").agg(F.count(F.lit(1)).alias("held")).where("held > 4")
    streaks = held.groupBy(*KEYS).agg(F.sum("held").alias("hits"), F.count(F.lit(1)).alias("of"))
    sections = (
        ("sentinels", sentinels, "site", "variable", "hits", "of"),
        ("duplicates", pairs, "site_a", "site_b", "n_matched", "n_coincident"),
        ("streaks", streaks, "site", "variable", "hits", "of"),
    )
    parts = [df.select(F.lit(name).alias("section"), F.col(a).alias("site"), F.col(b).alias("item"), F.col(n).alias("hits"), F.col(of).alias("of"))
             for name, df, a, b, n, of in sections]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("b4_implausible_blanking", f"""
WITH {FAULTY}, lim(variable, lo, hi) AS (VALUES ('conductivity', 1.0, 300.0), ('depth', -30.0, 350.0), ('temperature', 0.5, 250.0))
SELECT seq, site, variable, CASE WHEN value BETWEEN lo AND hi THEN value END AS value,
  count_if(value < lo OR value > hi) OVER (PARTITION BY site, variable) AS blanked FROM ev JOIN lim USING (variable)""")
def b4(spark, sf):
    limits = spark.createDataFrame(
        [("conductivity", 1.0, 300.0), ("depth", -30.0, 350.0), ("temperature", 0.5, 250.0)],
        "variable string, lo double, hi double",
    )
    """Readings outside their kind's limits are blanked, with how many that were per site and column."""
    rows = faulty(spark, sf).join(limits, "variable").withColumn("fits", F.col("value").between(F.col("lo"), F.col("hi")))
    counts = rows.groupBy(*KEYS).agg(F.count_if(~F.col("fits")).alias("blanked"))
    return rows.join(counts, list(KEYS)).select("seq", *KEYS, F.when(F.col("fits"), F.col("value")).alias("value"), "blanked")


@query("c12_threshold_precedence", f"""
WITH {EV}, own(site, variable, suspect_hi, fail_hi) AS (VALUES ('view', 'depth', 120.0, 300.0), ('view', 'conductivity', NULL, 250.0), ('click', 'depth', NULL, NULL)),
probe(variable, span_hi) AS (VALUES ('depth', 400.0), ('conductivity', 350.0))
SELECT seq, coalesce(suspect_hi, fail_hi)::DOUBLE AS usual_hi, span_hi::DOUBLE AS span_hi
FROM ev LEFT JOIN own USING (site, variable) LEFT JOIN probe USING (variable)""")
def c12(spark, sf):
    own = spark.createDataFrame(
        [("view", "depth", 120.0, 300.0), ("view", "conductivity", None, 250.0), ("click", "depth", None, None)],
        "site string, variable string, suspect_hi double, fail_hi double",
    )
    probe = spark.createDataFrame([("depth", 400.0), ("conductivity", 350.0)], "variable string, span_hi double")
    return (
        base.readings(spark, sf).join(own, list(KEYS), "left").join(probe, "variable", "left")
        .select("seq", F.coalesce("suspect_hi", "fail_hi").alias("usual_hi"), "span_hi")
    )
