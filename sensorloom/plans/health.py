"""Data health and exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import frames, grid, health
from sensorloom.operators.scale import numbered, quantiles, runs
from sensorloom.plans import base
from sensorloom.plans.base import CHARTS, DAY_US, EV, GRID, HOUR, KEYS, START_US, STEP, US, local_sql
from sensorloom.plans.charts import SCORES, scores
from sensorloom.plans.quality import CHUNK, END_US, SCREENED, SENSORS, screened, sensors
from sensorloom.plans.registry import query, r6
from sensorloom.sources.tables import load

CUT = START_US + 24 * DAY_US


@query("n1_reading_problems", f"""
WITH {SCREENED} SELECT site, variable, arg_max(value, us) FILTER (WHERE flag = 4 AND value IS NOT NULL) AS value, count(CASE WHEN flag = 4 THEN value END) AS readings
FROM screened GROUP BY ALL HAVING count(CASE WHEN flag = 4 THEN value END) > 0""")
def n1(spark, sf):
    return health.reading_problems(screened(spark, sf), KEYS)


@query("n2_dead_feed", f"""
WITH {EV}, {SENSORS}, n AS (SELECT site, variable, max(us) AS newest FROM ev GROUP BY ALL)
SELECT site, variable, newest FROM sensors LEFT JOIN n USING (site, variable) WHERE newest IS NULL OR {END_US} - newest > {HOUR * US}""")
def n2(spark, sf):
    return health.dead_feeds(sensors(spark, sf), base.readings(spark, sf), KEYS, END_US, 1)


LEVELS = f"""{EV}, r AS (SELECT site, variable, us >= {CUT} AS nw, CASE WHEN us >= {CUT} AND site = 'click' THEN value * 4 ELSE value END AS value FROM ev)"""


def shifted(spark, sf):
    moved = (F.col("us") >= CUT) & (F.col("site") == "click")
    return base.readings(spark, sf).withColumn("value", F.when(moved, F.col("value") * 4).otherwise(F.col("value")))


@query("n3_level_shift", f"""
WITH {LEVELS}, m AS (SELECT site, variable, quantile_cont(value, 0.5) FILTER (WHERE nw) AS c, quantile_cont(value, 0.5) FILTER (WHERE NOT nw) AS h,
  count(*) FILTER (WHERE nw) AS nc, count(*) FILTER (WHERE NOT nw) AS nh FROM r WHERE variable <> 'depth' GROUP BY ALL)
SELECT site, variable, r6(c) AS current, r6(h) AS usual, r6(greatest(c / h, h / c)) AS factor FROM m WHERE nc >= 50 AND nh >= 50 AND c > 0 AND h > 0 AND greatest(c / h, h / c) >= 2.0""")
def n3(spark, sf):
    rows = shifted(spark, sf).where("variable <> 'depth'")
    out = health.level_shifts(rows, KEYS, CUT, 180 * DAY_US, 50, 2.0)
    return out.withColumns({c: r6(c) for c in ("current", "usual", "factor")})


@query("n4_daily_ranges", f"""
WITH {EV} SELECT site, us // {DAY_US} AS day, r6(max(value) - min(value)) AS "range", count(*) AS n FROM ev GROUP BY ALL HAVING count(*) >= 48""")
def n4(spark, sf):
    return health.daily_ranges(base.readings(spark, sf), ["site"], 48).withColumn("range", r6("range"))


DULL = f"""{EV}, q AS (SELECT site, us, CASE WHEN us >= {CUT} AND site IN ('view', 'click') THEN value / 50 ELSE value END AS value FROM ev),
dr AS (SELECT site, us // {DAY_US} AS day, max(value) - min(value) AS rng FROM q GROUP BY ALL HAVING count(*) >= 10),
us2 AS (SELECT site, quantile_cont(rng, 0.05) AS q5, quantile_cont(rng, 0.5) AS usual, count(*) AS n FROM dr WHERE day < {CUT // DAY_US} GROUP BY site),
la AS (SELECT * FROM dr WHERE day >= {CUT // DAY_US} QUALIFY row_number() OVER (PARTITION BY site ORDER BY day DESC) <= 2),
mu AS (SELECT la.site, arg_max(rng, day) AS rng, any_value(usual) AS usual FROM la JOIN us2 USING (site) GROUP BY la.site
  HAVING count(*) >= 2 AND bool_and(rng < least(q5, usual / 4)) AND any_value(n) >= 10)"""


def dulled(spark, sf):
    calm = (F.col("us") >= CUT) & F.col("site").isin("view", "click")
    return base.readings(spark, sf).withColumn("value", F.when(calm, F.col("value") / 50).otherwise(F.col("value")))


def muted(spark, sf):
    ranges = health.daily_ranges(dulled(spark, sf), ["site"], 10)
    return health.muted(ranges, ["site"], F.lit(CUT // DAY_US), 10)


@query("n5_muted_sensor", f"""WITH {DULL} SELECT site, r6(rng) AS "range", r6(usual) AS usual FROM mu""")
def n5(spark, sf):
    return muted(spark, sf).select("site", r6("range").alias("range"), r6("usual").alias("usual"))


@query("n6_daily_job", f"""
WITH {DULL}, st AS (SELECT DISTINCT site FROM ev), nw AS (SELECT site, max(us) AS newest FROM ev GROUP BY site),
md AS (SELECT site, quantile_cont(value, 0.5) FILTER (WHERE us >= {CUT}) AS c, quantile_cont(value, 0.5) FILTER (WHERE us < {CUT}) AS h FROM q GROUP BY site)
SELECT st.site, CASE WHEN {END_US} - newest > {HOUR * US / 4} THEN 'dead' WHEN greatest(c / h, h / c) >= 3.0 AND c > 0 AND h > 0 THEN 'level' WHEN mu.site IS NOT NULL THEN 'muted' END AS problem
FROM st LEFT JOIN nw USING (site) LEFT JOIN md USING (site) LEFT JOIN mu USING (site)""")
def n6(spark, sf):
    rows = dulled(spark, sf)
    every = rows.select("site").distinct()
    dead = health.dead_feeds(every, rows, ["site"], END_US, 0.25).select("site", F.lit("dead").alias("a"))
    level = health.level_shifts(rows, ["site"], CUT, 180 * DAY_US, 1, 3.0).select("site", F.lit("level").alias("b"))
    quiet = muted(spark, sf).select("site", F.lit("muted").alias("c"))
    out = every.join(dead, "site", "left").join(level, "site", "left").join(quiet, "site", "left")
    return out.select("site", F.coalesce("a", "b", "c").alias("problem"))


@query("n7_drift", f"""
WITH {EV}, h AS (SELECT site, value, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM (SELECT site, value, (us >= {CUT})::INT AS a, (us < {CUT})::INT AS b FROM ev) GROUP BY ALL),
c AS (SELECT *, sum(a) OVER w / sum(a) OVER p AS fa, sum(b) OVER w / sum(b) OVER p AS fb, lead(value) OVER w AS nxt FROM h WINDOW w AS (PARTITION BY site ORDER BY value), p AS (PARTITION BY site)),
sd AS (SELECT site, stddev_pop(value) AS sd FROM ev WHERE us < {CUT} GROUP BY site)
SELECT site, r6(CASE WHEN least(sum(a), sum(b)) >= 1000 AND any_value(sd) > 0 THEN sum(abs(fa - fb) * (nxt - value)) / any_value(sd) END) AS ratio,
  CASE WHEN least(sum(a), sum(b)) >= 1000 AND any_value(sd) > 0 THEN sum(abs(fa - fb) * (nxt - value)) / any_value(sd) > 0.1 END AS drifted FROM c JOIN sd USING (site) GROUP BY site""")
def n7(spark, sf):
    rows = base.readings(spark, sf).where("value IS NOT NULL")
    out = health.wasserstein(rows.where(F.col("us") >= CUT), rows.where(F.col("us") < CUT), ["site"], "value", 4.0, need=1000)
    return out.select("site", r6("ratio").alias("ratio"), (F.col("ratio") > 0.1).alias("drifted"))


@query("n8_reference_sample", f"""
WITH {EV} SELECT site, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY md5(seq::VARCHAR)) AS r FROM ev) WHERE r <= 500""")
def n8(spark, sf):
    return health.reference_sample(base.readings(spark, sf), ["site"], 500).select("site", "seq", "value")


@query("n9_site_status", f"""
WITH {DULL}, nw AS (SELECT site, max(us) AS newest FROM ev GROUP BY site), fl AS (SELECT DISTINCT site FROM q WHERE us >= {CUT} AND value > 350)
SELECT nw.site, CASE WHEN fl.site IS NOT NULL THEN 'flagged' WHEN {END_US} - newest > {HOUR * US} THEN 'late' WHEN nw.site = 'purchase' THEN 'paused'
  WHEN mu.site IS NOT NULL THEN 'muted' ELSE 'normal' END AS status FROM nw LEFT JOIN fl USING (site) LEFT JOIN mu USING (site)""")
def n9(spark, sf):
    rows = dulled(spark, sf)
    newest = rows.groupBy("site").agg(F.max("us").alias("newest"))
    hot = rows.where(F.col("us") >= CUT).where("value > 350")
    return health.site_status(rows, newest, hot, muted(spark, sf), newest.where("site = 'purchase'"), END_US, 1)


@query("n10_alert_series", f"""
WITH {SCORES}, al AS (SELECT site, variable, rule, min(step) AS a FROM scores WHERE score > threshold GROUP BY ALL)
SELECT s.site, s.variable, s.rule, s.step, r6(score) AS score, r6(threshold) AS threshold, r6(g.value) AS value, score > threshold AS over_line
FROM scores s JOIN al USING (site, variable, rule) JOIN g ON g.site = s.site AND g.variable = s.variable AND g.step = s.step WHERE s.step BETWEEN a - 12 AND a + 12""")
def n10(spark, sf):
    rows = scores(spark, sf)
    first = rows.where("score > threshold").groupBy(*KEYS, "rule").agg(F.min("step").alias("a"))
    near = rows.join(first, [*KEYS, "rule"]).where("step BETWEEN a - 12 AND a + 12")
    return near.join(base.series(spark, sf), [*KEYS, "step"]).select(
        *KEYS, "rule", "step", r6("score").alias("score"), r6("threshold").alias("threshold"), r6("value").alias("value"),
        (F.col("score") > F.col("threshold")).alias("over_line"),
    )


@query("n11_series_with_outliers", f"""
WITH {GRID}, n AS (SELECT *, row_number() OVER (PARTITION BY site, variable ORDER BY step) AS i FROM g WHERE value IS NOT NULL),
m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY site, variable ORDER BY i ROWS BETWEEN 48 PRECEDING AND 47 FOLLOWING) AS m FROM n),
d AS (SELECT *, quantile_cont(abs(value - m), 0.5) OVER (PARTITION BY site, variable ORDER BY i ROWS BETWEEN 48 PRECEDING AND 47 FOLLOWING) AS d FROM m)
SELECT g.site, g.variable, g.step, r6(g.value) AS value, coalesce(abs(g.value - m) > d * (3.0 * 1.4826), false) AS outlier FROM g LEFT JOIN d USING (site, variable, step)""")
def n11(spark, sf):
    whole = base.series(spark, sf)
    placed = numbered(whole.where("value IS NOT NULL"), KEYS, "step", "i")
    far = frames.centred_outlier(placed, KEYS, "i", 3.0).select(*KEYS, "step", "outlier")
    return whole.join(far, [*KEYS, "step"], "left").select(*KEYS, "step", r6("value").alias("value"), F.coalesce("outlier", F.lit(False)).alias("outlier"))


@query("d20_last_seen", f"""
WITH {EV}, {SENSORS}, n AS (SELECT site, variable, max(us) AS newest FROM ev GROUP BY ALL) SELECT site, variable, newest,
 CASE WHEN newest IS NULL THEN 'none' WHEN {END_US} - newest <= {2 * HOUR * US} THEN 'live' ELSE 'quiet' END AS status FROM sensors LEFT JOIN n USING (site, variable)""")
def d20(spark, sf):
    newest = base.readings(spark, sf).groupBy(*KEYS).agg(F.max("us").alias("newest"))
    age = END_US - F.col("newest")
    status = F.when(age.isNull(), "none").when(age <= 2 * HOUR * US, "live").otherwise("quiet")
    return sensors(spark, sf).select(*KEYS).join(newest, list(KEYS), "left").withColumn("status", status)


LASTDAY = END_US - DAY_US


@query("d21_hour_counts", f"""
WITH {EV}, c AS (SELECT site, variable, us // {HOUR * US} AS hour, count(*) AS n FROM ev WHERE us >= {LASTDAY} GROUP BY ALL), m AS (SELECT site, hour, least(max(n), 4) AS n FROM c GROUP BY ALL)
SELECT s.site, h.hour, coalesce(n, 0) AS readings FROM (SELECT DISTINCT site FROM ev) s CROSS JOIN (SELECT unnest(range({LASTDAY // (HOUR * US)}, {END_US // (HOUR * US)})) AS hour) h LEFT JOIN m ON m.site = s.site AND m.hour = h.hour""")
def d21(spark, sf):
    rows = base.readings(spark, sf)
    counts = rows.where(F.col("us") >= LASTDAY).groupBy(*KEYS, F.floor(F.col("us") / (HOUR * US)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    busiest = counts.groupBy("site", "hour").agg(F.least(F.max("n"), F.lit(4)).alias("n"))
    hours = F.sequence(F.lit(LASTDAY // (HOUR * US)), F.lit(END_US // (HOUR * US) - 1))
    spine = rows.select("site").distinct().withColumn("hour", F.explode(hours))
    return spine.join(busiest, ["site", "hour"], "left").select("site", "hour", F.coalesce("n", F.lit(0)).cast("bigint").alias("readings"))


@query("d22_hour_marks", f"""
WITH {EV}, c AS (SELECT site, us // {HOUR * US} AS hour, count(DISTINCT us // {900 * US}) AS slots FROM ev GROUP BY ALL)
SELECT site, hour, CASE WHEN slots = 4 THEN 'full' WHEN hour = {END_US // (HOUR * US) - 1} THEN 'pending' ELSE 'partial' END AS mark FROM c""")
def d22(spark, sf):
    hour = F.floor(F.col("us") / (HOUR * US)).alias("hour")
    slots = base.readings(spark, sf).groupBy("site", hour).agg(F.count_distinct(F.floor(F.col("us") / (900 * US))).alias("slots"))
    mark = F.when(F.col("slots") == 4, "full").when(F.col("hour") == END_US // (HOUR * US) - 1, "pending").otherwise("partial")
    return slots.select("site", "hour", mark.alias("mark"))


@query("d23_typical_day", f"""
WITH {EV}, q AS (SELECT site, ({local_sql(f"us // {US}")} % 86400) // 3600 AS hour, value FROM ev)
SELECT s.site, h.hour, r6(quantile_cont(value, 0.25)) AS low, r6(quantile_cont(value, 0.5)) AS middle, r6(quantile_cont(value, 0.75)) AS high
FROM (SELECT DISTINCT site FROM ev) s CROSS JOIN (SELECT unnest(range(24)) AS hour) h LEFT JOIN q ON q.site = s.site AND q.hour = h.hour GROUP BY ALL""")
def d23(spark, sf):
    from sensorloom.functions.clock import local

    rows = base.readings(spark, sf).select("site", F.hour(local("time")).cast("bigint").alias("hour"), "value")
    q = quantiles(rows, ["site", "hour"], "value", {"low": 0.25, "middle": 0.5, "high": 0.75})
    spine = rows.select("site").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(23).cast("bigint"))))
    return spine.join(q, ["site", "hour"], "left").withColumns({c: r6(c) for c in ("low", "middle", "high")})


@query("d24_histogram", """
WITH e AS (SELECT l_returnflag, floor(min(l_extendedprice) / 5000.0) AS lo, ceil(max(l_extendedprice) / 5000.0) AS hi FROM lineitem GROUP BY 1),
b AS (SELECT l_returnflag, least(floor(l_extendedprice / 5000.0), hi - 1) AS bin, count(*) AS n FROM lineitem JOIN e USING (l_returnflag) GROUP BY ALL),
s AS (SELECT l_returnflag, unnest(range(lo::BIGINT, greatest(hi, lo + 1)::BIGINT)) AS bin FROM e)
SELECT l_returnflag, bin * 5000.0::DOUBLE AS edge, coalesce(n, 0) AS n FROM s LEFT JOIN b USING (l_returnflag, bin)""")
def d24(spark, sf):
    from sensorloom.operators.explore import histogram

    lines = load(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return histogram(lines, ["l_returnflag"], "l_extendedprice", 5000.0)


@query("d25_missing_and_expected", f"""
WITH {EV} SELECT site, greatest(2880 - count(DISTINCT us // {900 * US}), 0) AS missing, 2880::BIGINT AS expected FROM ev GROUP BY site""")
def d25(spark, sf):
    expected = (END_US - START_US) // (900 * US)
    slots = base.readings(spark, sf).select("site", F.floor(F.col("us") / (900 * US)).alias("s")).distinct()
    return slots.groupBy("site").agg(F.greatest(F.lit(expected) - F.count(F.lit(1)), F.lit(0)).alias("missing"), F.lit(expected).alias("expected"))


@query("d30_inventory_disagreements", f"""
WITH {EV}, {SENSORS}, n AS (SELECT site, variable, max(us) AS newest FROM ev GROUP BY ALL), top AS (SELECT max(newest) AS top FROM n)
SELECT site, variable, CASE WHEN in_service AND top - newest > {HOUR * US} THEN 'in service but silent' WHEN NOT in_service AND top - newest <= {HOUR * US * 12} THEN 'switched off but reporting' END AS problem
FROM sensors LEFT JOIN n USING (site, variable), top WHERE (in_service AND top - newest > {HOUR * US}) OR (NOT in_service AND top - newest <= {HOUR * US * 12})""")
def d30(spark, sf):
    newest = base.readings(spark, sf).groupBy(*KEYS).agg(F.max("us").alias("newest"))
    top = newest.agg(F.max("newest").alias("top"))
    age = F.col("top") - F.col("newest")
    problem = F.when(F.col("in_service") & (age > HOUR * US), "in service but silent").when(
        ~F.col("in_service") & (age <= 12 * HOUR * US), "switched off but reporting"
    )
    out = sensors(spark, sf).join(newest, list(KEYS), "left").crossJoin(F.broadcast(top))
    return out.select(*KEYS, problem.alias("problem")).where("problem IS NOT NULL")


@query("a18_fetch_coverage", f"""
WITH {EV} SELECT site, min(us) <= {START_US + 2 * DAY_US} + {DAY_US} AND max(us) >= {END_US} - {DAY_US} AS covered FROM ev GROUP BY site""")
def a18(spark, sf):
    return base.readings(spark, sf).groupBy("site").agg(
        ((F.min("us") <= START_US + 3 * DAY_US) & (F.max("us") >= END_US - DAY_US)).alias("covered")
    )


@query("a19_retention", f"""
WITH {EV} SELECT site, count(*) AS kept FROM ev WHERE us >= {END_US} - {8 * DAY_US} GROUP BY site""")
def a19(spark, sf):
    from sensorloom.sources.sinks import retained

    return retained(base.readings(spark, sf), "us", END_US, 8 * DAY_US).groupBy("site").agg(F.count(F.lit(1)).alias("kept"))


@query("e23_contiguous_ranges", f"""
WITH {EV}, h AS (SELECT site, us // {HOUR * US} AS n, floor(arg_min(value, (us, seq)) / 60) AS value FROM ev GROUP BY ALL),
p AS (SELECT a.site AS site_a, b.site AS site_b, a.n FROM h a JOIN h b ON a.n = b.n AND a.site < b.site AND a.value = b.value),
l AS (SELECT *, n - lag(n) OVER (PARTITION BY site_a, site_b ORDER BY n) AS gap FROM p), m AS (SELECT site_a, site_b, quantile_cont(gap, 0.5) AS mid FROM l GROUP BY ALL),
o AS (SELECT l.*, sum(CASE WHEN gap <= 3 * mid THEN 0 ELSE 1 END) OVER (PARTITION BY site_a, site_b ORDER BY n) AS run FROM l JOIN m USING (site_a, site_b))
SELECT site_a, site_b, min(n) AS first_hour, max(n) AS last_hour FROM o GROUP BY site_a, site_b, run""")
def e23(spark, sf):
    from sensorloom.operators.explore import contiguous_ranges

    hourly = grid.resample(base.readings(spark, sf), ["site"], HOUR, {"value": F.floor(F.min_by("value", F.struct("us", "seq")) / 60)})
    a = hourly.select(F.col("site").alias("site_a"), F.col("step").alias("n"), F.col("value").alias("_a"))
    b = hourly.select(F.col("site").alias("site_b"), F.col("step").alias("n"), F.col("value").alias("_b"))
    matched = a.withColumnRenamed("_a", "_v").join(b.withColumnRenamed("_b", "_v"), ["n", "_v"]).where("site_a < site_b").select("site_a", "site_b", "n")
    return contiguous_ranges(matched, ["site_a", "site_b"], "n").toDF("site_a", "site_b", "first_hour", "last_hour")
