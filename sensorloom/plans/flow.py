"""Flow graph and explainers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sensorloom.operators import explain, graph
from sensorloom.operators.charts import siblings
from sensorloom.plans import base
from sensorloom.plans.base import CHARTS, DAY_US, EV, GRID, KEYS, START_US, STEP, US, series
from sensorloom.plans.registry import query, r6
from sensorloom.session import level as stored
from sensorloom.sources.tables import load

# Customers stand for sites of a large network: number k drains into k // 2, every tenth is an outlet.
EDGES = "e AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_custkey // 2 >= 1 AND c_custkey % 10 <> 7)"
REACH = f"RECURSIVE {EDGES}, r AS (SELECT src, dst, 1 AS hops FROM e UNION ALL SELECT r.src, e.dst, hops + 1 FROM r JOIN e ON r.dst = e.src)"


def nodes(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("node"))


def edges(spark, sf):
    key = F.col("node")
    return nodes(spark, sf).select(key.alias("src"), F.floor(key / 2).alias("dst")).where("dst >= 1 AND src % 10 <> 7")


def reach(spark, sf):
    return stored(spark, ("reach", sf), lambda: graph.closure(edges(spark, sf)))


@query("l1_flow_closure", f"WITH {REACH} SELECT src, dst, hops FROM r")
def l1(spark, sf):
    return reach(spark, sf).select("src", "dst", "hops")


@query("l2_outlets_and_isolated", f"""
WITH {EDGES}, u AS (SELECT dst, count(*) AS n FROM e GROUP BY dst)
SELECT c_custkey AS node, coalesce(n, 0) AS inflows, e.src IS NULL AND coalesce(n, 0) > 0 AS outlet,
  e.src IS NULL AND coalesce(n, 0) = 0 AS isolated FROM customer LEFT JOIN e ON e.src = c_custkey LEFT JOIN u ON u.dst = c_custkey""")
def l2(spark, sf):
    return graph.roles(nodes(spark, sf), edges(spark, sf))


@query("l3_topology_problems", """
WITH RECURSIVE e AS (SELECT c_custkey AS src, CASE c_custkey % 50 WHEN 0 THEN c_custkey + 1000000 WHEN 1 THEN c_custkey
  WHEN 2 THEN c_custkey + 1 WHEN 3 THEN c_custkey - 1 ELSE c_custkey // 2 END AS dst FROM customer),
r AS (SELECT src, dst, 1 AS h FROM e WHERE src <> dst UNION ALL SELECT r.src, e.dst, h + 1 FROM r JOIN e ON r.dst = e.src WHERE e.src <> e.dst AND h < 40)
SELECT src AS node, 'dangling target' AS problem FROM e WHERE dst NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT src, 'self loop' FROM e WHERE src = dst
UNION ALL SELECT DISTINCT src, 'never reaches an outlet' FROM r WHERE h = 40""")
def l3(spark, sf):
    key = F.col("node")
    kind = key % 50
    target = (
        F.when(kind == 0, key + 1000000).when(kind == 1, key).when(kind == 2, key + 1).when(kind == 3, key - 1)
        .otherwise(F.floor(key / 2))
    )
    return graph.problems(nodes(spark, sf), nodes(spark, sf).select(key.alias("src"), target.alias("dst")))


@query("l4_flow_weights", f"""
WITH RECURSIVE {EDGES}, w AS (SELECT e.*, 1.0::DOUBLE / count(*) OVER (PARTITION BY dst) AS weight FROM e),
r AS (SELECT src, dst, 1 AS hops, weight FROM w UNION ALL SELECT r.src, w.dst, hops + 1, r.weight * w.weight FROM r JOIN w ON r.dst = w.src)
SELECT src, dst, hops, r6(weight) AS weight FROM r""")
def l4(spark, sf):
    return graph.closure(graph.inflow_weights(edges(spark, sf))).withColumn("weight", r6("weight"))


@query("l15_longest_branch", f"""
WITH {REACH}, d AS (SELECT dst AS outlet, src, hops FROM r WHERE dst NOT IN (SELECT src FROM e))
SELECT outlet, max(hops) AS longest, min(src) FILTER (WHERE hops = m) AS head FROM (SELECT *, max(hops) OVER (PARTITION BY outlet) AS m FROM d) GROUP BY outlet""")
def l15(spark, sf):
    ends = graph.roles(nodes(spark, sf), edges(spark, sf)).where("outlet").select(F.col("node").alias("dst"))
    return reach(spark, sf).join(ends, "dst").groupBy(F.col("dst").alias("outlet")).agg(
        F.max("hops").alias("longest"), F.max_by("src", F.struct("hops", -F.col("src"))).alias("head")
    )


# The five reading sites drain purchase -> click -> view <- signup; error is the control.
NETWORK = (("purchase", "click"), ("click", "view"), ("signup", "view"))
PATHS = "paths(src, dst) AS (VALUES ('purchase', 'click'), ('click', 'view'), ('signup', 'view'), ('purchase', 'view'))"
FIRST = f"""{CHARTS}, firsts AS (SELECT variable, step // 84 AS week, site, min(step) AS first FROM charts WHERE ewma > 1.5 GROUP BY ALL)"""


def network(spark):
    return spark.createDataFrame(list(NETWORK), "src string, dst string")


def firsts(spark, sf):
    fired = base.charted(spark, sf).where("ewma > 1.5")
    return fired.groupBy("variable", F.floor(F.col("step") / 84).alias("week"), "site").agg(F.min("step").alias("first"))


@query("l5_first_firing", f"WITH {FIRST} SELECT variable, week, site, first FROM firsts")
def l5(spark, sf):
    return firsts(spark, sf)


@query("g6_first_flag_lag", f"""
WITH {FIRST} SELECT variable, week, site, (first - min(first) OVER (PARTITION BY variable, week)) * 2.0::DOUBLE AS lag_hours FROM firsts""")
def g6(spark, sf):
    w = Window.partitionBy("variable", "week")
    return firsts(spark, sf).select("variable", "week", "site", ((F.col("first") - F.min("first").over(w)) * 2.0).alias("lag_hours"))


@query("l6_firing_order_verdict", f"""
WITH {FIRST}, {PATHS}, p AS (SELECT a.variable, a.week, a.site, a.first, b.site AS other, b.first AS of,
   EXISTS (SELECT 1 FROM paths WHERE src = b.site AND dst = a.site) AS up, EXISTS (SELECT 1 FROM paths WHERE dst = b.site AND src = a.site) AS down
  FROM firsts a LEFT JOIN firsts b ON a.variable = b.variable AND a.week = b.week AND a.site <> b.site),
s AS (SELECT variable, week, site, first, coalesce(string_agg(CASE WHEN up AND of < first THEN other END, ',' ORDER BY other), '') AS upstream_before,
  coalesce(string_agg(CASE WHEN down AND of > first THEN other END, ',' ORDER BY other), '') AS downstream_after,
  coalesce(string_agg(CASE WHEN of = first THEN other END, ',' ORDER BY other), '') AS simultaneous,
  coalesce(string_agg(CASE WHEN of = first AND other = 'error' THEN other END, ',' ORDER BY other), '') AS control FROM p GROUP BY variable, week, site, first)
SELECT *, CASE WHEN control <> '' THEN 'not_transport' WHEN upstream_before <> '' OR downstream_after <> '' THEN 'transport'
  WHEN simultaneous <> '' THEN 'catchment_wide' ELSE 'local' END AS verdict FROM s""")
def l6(spark, sf):
    paths = graph.closure(network(spark))
    return explain.order_verdicts(firsts(spark, sf), paths, ["error"], ["variable", "week"])


@query("l7_travel_window", f"""
WITH {FIRST}, t(src, dst, minutes) AS (VALUES ('purchase', 'click', 45), ('signup', 'view', 90))
SELECT variable, week, site, count(minutes) AS measured, CASE count(minutes) WHEN 0 THEN 'ordering only' ELSE 'measured travel time' END AS confidence
FROM firsts LEFT JOIN t ON t.dst = site GROUP BY ALL""")
def l7(spark, sf):
    times = spark.createDataFrame([("purchase", "click", 45), ("signup", "view", 90)], "src string, site string, minutes int")
    return firsts(spark, sf).join(times, "site", "left").groupBy("variable", "week", "site").agg(
        F.count("minutes").alias("measured"),
        F.when(F.count("minutes") == 0, "ordering only").otherwise("measured travel time").alias("confidence"),
    )


@query("l14_flow_order", f"""
WITH {FIRST} SELECT variable, week, string_agg(site, '>' ORDER BY first, site) AS fired_order, count(*) AS sites FROM firsts GROUP BY ALL""")
def l14(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("first", "site")))
    return firsts(spark, sf).groupBy("variable", "week").agg(
        F.array_join(F.transform(ordered, lambda x: x["site"]), ">").alias("fired_order"), F.count(F.lit(1)).alias("sites")
    )


@query("g2_top_firing_nodes", f"""
WITH {CHARTS}, n AS (SELECT step // 84 AS week, site || '.' || variable AS node, count(*) AS fired FROM charts WHERE ewma > 1.5 GROUP BY ALL)
SELECT week, node, fired FROM n QUALIFY row_number() OVER (PARTITION BY week ORDER BY fired DESC, node) <= 3""")
def g2(spark, sf):
    counts = base.charted(spark, sf).where("ewma > 1.5").groupBy(
        F.floor(F.col("step") / 84).alias("week"), F.concat_ws(".", *KEYS).alias("node")
    ).agg(F.count(F.lit(1)).alias("fired"))
    w = Window.partitionBy("week").orderBy(F.desc("fired"), "node")
    return counts.withColumn("_r", F.row_number().over(w)).where("_r <= 3").drop("_r")


@query("c13_sibling_max", f"""
WITH {GRID} SELECT a.site, a.variable, a.step, r6(max(b.value)) AS siblings FROM g a LEFT JOIN g b
  ON a.site = b.site AND a.step = b.step AND a.variable <> b.variable GROUP BY ALL""")
def c13(spark, sf):
    return siblings(series(spark, sf), ["site", "step"], "variable", "value").select(*KEYS, "step", r6("siblings").alias("siblings"))


# Five parameters for the explainers; the first ten days are the baseline, later six-hour blocks events.
PARAM = f"""{EV.replace("CASE user_id % 3 WHEN 0 THEN 'conductivity' WHEN 1 THEN 'depth' ELSE 'temperature' END AS variable",
  "CASE user_id % 5 WHEN 0 THEN 'temperature' WHEN 1 THEN 'dissolved_oxygen' WHEN 2 THEN 'ph' WHEN 3 THEN 'conductivity' ELSE 'floating_conductivity' END AS parameter")},
cut AS (SELECT {START_US + 10 * DAY_US} AS c),
bl AS (SELECT site, parameter, avg(value) AS bm, stddev_samp(value) AS bs, count(*) AS bn FROM ev, cut WHERE us < c GROUP BY ALL),
evt AS (SELECT site, us // {6 * 3600 * US} AS block, parameter, avg(value) AS em, count(*) AS en FROM ev, cut WHERE us >= c GROUP BY ALL),
obs AS (SELECT site, block, parameter, em AS event_mean, CASE WHEN bn >= 2 AND en >= 1 THEN CASE WHEN abs((em - bm) / bs) < 1.0 THEN 'flat' WHEN em > bm THEN 'up' ELSE 'down' END END AS direction
  FROM evt LEFT JOIN bl USING (site, parameter))"""
SIG = "sig(pollutant, parameter, expected) AS (VALUES " + ", ".join(
    f"('{p}', '{q}', '{d}')" for p, row in explain.SIGNATURES.items() for q, d in zip(explain.PARAMETERS, row, strict=True) if d != "any"
) + ")"
GROUP = ("site", "block")


def parameters(spark, sf):
    name = F.element_at(F.array(*[F.lit(p) for p in explain.PARAMETERS]), (F.col("user_id") % 5 + 1).cast("int"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return load(spark, sf, "events").select(F.col("event_type").alias("site"), name.alias("parameter"), us.alias("us"), "value")


def observed(spark, sf):
    rows = parameters(spark, sf)
    cut = START_US + 10 * DAY_US
    event = rows.where(F.col("us") >= cut).withColumn("block", F.floor(F.col("us") / (6 * 3600 * US)))
    return explain.directions(rows.where(F.col("us") < cut), event, ["site"], ["block"], "parameter", "value")


@query("l8_observed_directions", f"WITH {PARAM} SELECT site, block, parameter, r6(event_mean) AS event_mean, direction FROM obs")
def l8(spark, sf):
    return observed(spark, sf).withColumn("event_mean", r6("event_mean"))


@query("i12_direction", f"WITH {PARAM} SELECT parameter, direction, count(*) AS groups FROM obs GROUP BY ALL")
def i12(spark, sf):
    return observed(spark, sf).groupBy("parameter", "direction").agg(F.count(F.lit(1)).alias("groups"))


@query("l9_absence_reasons", f"""
WITH {PARAM}, fitted AS (SELECT DISTINCT site, parameter FROM ev WHERE NOT (site = 'error' AND parameter = 'ph')),
want AS (SELECT g.site, g.block, p.parameter FROM (SELECT DISTINCT site, block FROM obs) g,
  (VALUES ('temperature'), ('dissolved_oxygen'), ('ph'), ('conductivity'), ('floating_conductivity')) p(parameter))
SELECT w.site, w.block, w.parameter, CASE WHEN f.site IS NULL THEN 'never_installed' ELSE 'installed_but_silent' END AS reason
FROM want w LEFT JOIN obs o USING (site, block, parameter) LEFT JOIN fitted f ON f.site = w.site AND f.parameter = w.parameter WHERE o.site IS NULL""")
def l9(spark, sf):
    seen = observed(spark, sf)
    fitted = parameters(spark, sf).select("site", "parameter").distinct().where("NOT (site = 'error' AND parameter = 'ph')")
    want = seen.select(*GROUP).distinct().withColumn("parameter", F.explode(F.array(*[F.lit(p) for p in explain.PARAMETERS])))
    gone = want.join(seen.select(*GROUP, "parameter"), [*GROUP, "parameter"], "left_anti")
    return gone.join(fitted.withColumn("_f", F.lit(True)), ["site", "parameter"], "left").select(
        *GROUP, "parameter", F.when(F.col("_f").isNull(), "never_installed").otherwise("installed_but_silent").alias("reason")
    )


SCORED = f"""{PARAM}, {SIG}, req AS (SELECT pollutant, count(*) AS comparable FROM sig GROUP BY pollutant),
h AS (SELECT site, block, pollutant, count(*) AS present, count_if(direction = expected) AS agreements
  FROM obs JOIN sig USING (parameter) WHERE direction IS NOT NULL GROUP BY ALL),
sc AS (SELECT g.site, g.block, req.pollutant, comparable, coalesce(agreements, 0) AS agreements, comparable - coalesce(present, 0) AS missing,
  comparable = coalesce(present, 0) AS evaluable, CASE WHEN comparable = coalesce(present, 0) THEN agreements / comparable END AS score
  FROM (SELECT DISTINCT site, block FROM obs) g CROSS JOIN req LEFT JOIN h ON h.site = g.site AND h.block = g.block AND h.pollutant = req.pollutant)"""


@query("l10_signature_evaluability", f"WITH {SCORED} SELECT site, block, pollutant, missing, evaluable FROM sc")
def l10(spark, sf):
    return explain.score_signatures(observed(spark, sf), GROUP).select(*GROUP, "pollutant", "missing", "evaluable")


@query("g1_ranked_signatures", f"""
WITH {SCORED} SELECT site, block, pollutant, r6(score) AS score, rank() OVER (PARTITION BY site, block ORDER BY score DESC, comparable DESC) AS place
FROM sc WHERE evaluable""")
def g1(spark, sf):
    w = Window.partitionBy(*GROUP).orderBy(F.desc("score"), F.desc("comparable"))
    rows = explain.score_signatures(observed(spark, sf), GROUP).where("evaluable")
    return rows.select(*GROUP, "pollutant", r6("score").alias("score"), F.rank().over(w).cast("bigint").alias("place"))


@query("l11_diagnosis", f"""
WITH {SCORED}, d AS (SELECT site, block, count_if(parameter IN ('dissolved_oxygen', 'ph', 'floating_conductivity')) AS telling FROM obs WHERE direction IS NOT NULL GROUP BY ALL),
b AS (SELECT site, block, coalesce(max(score), 0) AS top, count(score) AS judgeable,
  arg_max(pollutant, (score, comparable, pollutant)) FILTER (WHERE evaluable) AS lead FROM sc GROUP BY ALL),
t AS (SELECT sc.site, sc.block, string_agg(pollutant, ',' ORDER BY pollutant) AS tied, count(*) AS ties FROM sc JOIN b USING (site, block) WHERE score = top AND top > 0 GROUP BY ALL),
v AS (SELECT b.*, coalesce(telling, 0) AS telling, coalesce(tied, '') AS tied, CASE WHEN judgeable = 0 OR coalesce(telling, 0) < 1 THEN 'cannot_evaluate'
  WHEN top < 0.5 OR ties > 1 THEN 'possible_new_type' ELSE 'diagnosed' END AS verdict FROM b LEFT JOIN d USING (site, block) LEFT JOIN t USING (site, block))
SELECT site, block, verdict, CASE WHEN verdict = 'diagnosed' THEN lead END AS cause,
  CASE telling WHEN 0 THEN 'none' WHEN 1 THEN 'moderate' ELSE 'good' END AS confidence, r6(top) AS top, tied FROM v""")
def l11(spark, sf):
    return explain.diagnose(observed(spark, sf), GROUP).withColumn("top", r6("top"))


@query("l12_tapwater_numbers", f"""
WITH {PARAM} SELECT site, block, max(CASE WHEN parameter = 'temperature' THEN abs(event_mean - 13.0) <= 1.5 END) AS matches_temperature,
  max(CASE WHEN parameter = 'ph' THEN abs(event_mean - 9.4) <= 0.5 END) AS matches_ph FROM obs GROUP BY ALL""")
def l12(spark, sf):
    near = {
        "temperature": F.abs(F.col("event_mean") - explain.TAP_TEMPERATURE) <= explain.TAP_TEMPERATURE_WITHIN,
        "ph": F.abs(F.col("event_mean") - explain.TAP_PH) <= explain.TAP_PH_WITHIN,
    }
    return observed(spark, sf).groupBy(*GROUP).agg(
        *[F.max(F.when(F.col("parameter") == p, hit)).alias(f"matches_{p}") for p, hit in near.items()]
    )


@query("i16_evidence_sentence", f"""
WITH {PARAM} SELECT site, block, string_agg(parameter || CASE direction WHEN 'up' THEN ' rose' WHEN 'down' THEN ' fell' ELSE ' held steady' END, ', ' ORDER BY parameter) AS evidence
FROM obs WHERE direction IS NOT NULL GROUP BY ALL""")
def i16(spark, sf):
    word = F.when(F.col("direction") == "up", " rose").when(F.col("direction") == "down", " fell").otherwise(" held steady")
    said = F.array_sort(F.collect_list(F.concat("parameter", word)))
    return observed(spark, sf).where("direction IS NOT NULL").groupBy(*GROUP).agg(F.array_join(said, ", ").alias("evidence"))


@query("c15_event_membership", f"""
WITH {CHARTS} SELECT site, variable, count(value) AS readings, count(CASE WHEN f THEN value END) AS during, r6(avg(CASE WHEN f THEN value END)) AS mean_during,
  r6(avg(CASE WHEN NOT f THEN value END)) AS mean_outside FROM (SELECT *, EXISTS (SELECT 1 FROM charts b WHERE b.site = a.site AND b.step = a.step AND b.ewma > 1.5) AS f FROM charts a) GROUP BY ALL""")
def c15(spark, sf):
    hot = base.charted(spark, sf).where("ewma > 1.5").select("site", "step").distinct().withColumn("_f", F.lit(True))
    f = F.col("_f").isNotNull()
    return base.charted(spark, sf).join(hot, ["site", "step"], "left").groupBy(*KEYS).agg(
        F.count("value").alias("readings"), F.count(F.when(f, F.col("value"))).alias("during"),
        r6(F.avg(F.when(f, F.col("value")))).alias("mean_during"), r6(F.avg(F.when(~f, F.col("value")))).alias("mean_outside"),
    )


@query("i13_alert_direction", f"""
WITH {CHARTS}, f AS (SELECT site, variable, min(CASE WHEN ewma > 1.5 THEN step END) AS a, max(CASE WHEN ewma > 1.5 THEN step END) AS b FROM charts GROUP BY ALL)
SELECT site, variable, CASE WHEN avg(CASE WHEN step BETWEEN a AND b THEN value END) > avg(CASE WHEN step < a THEN value END) THEN 'up' ELSE 'down' END AS moved
FROM charts JOIN f USING (site, variable) GROUP BY ALL HAVING count(CASE WHEN step < a THEN value END) > 0""")
def i13(spark, sf):
    hit = F.when(F.col("ewma") > 1.5, F.col("step"))
    spans = base.charted(spark, sf).groupBy(*KEYS).agg(F.min(hit).alias("a"), F.max(hit).alias("b"))
    step, value = F.col("step"), F.col("value")
    before, during = F.when(step < F.col("a"), value), F.when(step.between(F.col("a"), F.col("b")), value)
    out = base.charted(spark, sf).join(spans, list(KEYS)).groupBy(*KEYS).agg(
        F.when(F.avg(during) > F.avg(before), "up").otherwise("down").alias("moved"), F.count(before).alias("_n")
    )
    return out.where("_n > 0").drop("_n")


LINKS = """ed(src, dst) AS (VALUES ('purchase', 'click'), ('click', 'view'), ('signup', 'view')),
both_ways AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed UNION SELECT src, src FROM ed UNION SELECT dst, dst FROM ed),
dg AS (SELECT src, count(*) AS n FROM both_ways GROUP BY src),
lk AS (SELECT b.src, b.dst, 1 / sqrt(x.n * y.n) AS w FROM both_ways b JOIN dg x ON x.src = b.src JOIN dg y ON y.src = b.dst)"""
DIFFUSED = f"""{GRID}, {LINKS},
cells AS (SELECT variable, step, site, value FROM (SELECT DISTINCT variable, step FROM g) CROSS JOIN (SELECT src AS site FROM dg) LEFT JOIN g USING (variable, step, site)),
it AS (SELECT 0 AS i, variable, step, site, coalesce(value, 0.0) AS x FROM cells
  UNION ALL SELECT it.i + 1, it.variable, it.step, lk.dst, coalesce(max(c.value), sum(lk.w * it.x)) FROM it JOIN lk ON lk.src = it.site
    JOIN cells c ON c.variable = it.variable AND c.step = it.step AND c.site = lk.dst WHERE it.i < 40 GROUP BY it.i, it.variable, it.step, lk.dst)
SELECT g.site, variable, step, r6(g.value) AS value, r6(coalesce(g.value, x, 0.0)) AS filled FROM g LEFT JOIN (SELECT * FROM it WHERE i = 40) USING (variable, step, site)"""


@query("l13_fill_missing_nodes", f"WITH RECURSIVE {DIFFUSED}")
def l13(spark, sf):
    wide = series(spark, sf)
    out = graph.propagate_missing(wide, network(spark), ["variable", "step"], "site", "value")
    return out.withColumns({"value": r6("value"), "filled": r6("filled")})


@query("l13_fill_by_messages", f"WITH RECURSIVE {DIFFUSED}")
def l13_messages(spark, sf):
    """The same filling as a network too large for one task gets it."""
    out = graph.propagate_missing(series(spark, sf), network(spark), ["variable", "step"], "site", "value", max_edges=0)
    return out.withColumns({"value": r6("value"), "filled": r6("filled")})
