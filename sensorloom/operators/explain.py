"""What an alert looks like: firing order over the flow graph, directions, signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# What each pollutant does to each parameter ("any" where it tells nothing).
PARAMETERS = ("temperature", "dissolved_oxygen", "ph", "conductivity", "floating_conductivity")
SIGNATURES = {
    "rain": ("any", "up", "down", "down", "down"),
    "tapwater": ("down", "down", "up", "down", "down"),
    "oil": ("up", "down", "down", "down", "down"),
    "sewage": ("up", "down", "any", "up", "up"),
    "fertilizer": ("flat", "down", "any", "up", "up"),
}
DISCRIMINATING = ("dissolved_oxygen", "ph", "floating_conductivity")
SCORE_FLOOR = 0.5
CHANGE_STD = 1.0
TAP_TEMPERATURE, TAP_TEMPERATURE_WITHIN = 13.0, 1.5
TAP_PH, TAP_PH_WITHIN = 9.4, 0.5


def signature_table(df: DataFrame) -> DataFrame:
    """(pollutant, parameter, expected) as a frame beside ``df``'s session."""
    rows = [
        (p, q, d) for p, row in SIGNATURES.items() for q, d in zip(PARAMETERS, row, strict=True)
    ]
    return df.sparkSession.createDataFrame(rows, "pollutant string, parameter string, expected string")


def direction(base_mean: Column, base_std: Column, base_n: Column, event_mean: Column, event_n: Column) -> Column:
    """up, down or flat against the baseline's own spread; NULL without enough data."""
    shift = (event_mean - base_mean) / base_std
    rel = (event_mean - base_mean) / F.abs(base_mean)

    def sign(x: Column, least: float) -> Column:
        return F.when(F.abs(x) < least, "flat").when(x > 0, "up").otherwise("down")

    level = F.when(event_mean == 0, "flat").when(event_mean > 0, "up").otherwise("down")
    still = F.when(base_mean == 0, level).otherwise(sign(rel, 0.05))
    moved = F.when(base_std.isNull() | (base_std == 0), still).otherwise(sign(shift, CHANGE_STD))
    return F.when((base_n >= 2) & (event_n >= 1), moved)


def directions(baseline: DataFrame, event: DataFrame, site: Sequence[str], group: Sequence[str],
               parameter: str, value: str) -> DataFrame:
    """Direction and event mean per event group and parameter."""
    usual = baseline.groupBy(*site, parameter).agg(
        F.avg(value).alias("_bm"), F.stddev_samp(value).alias("_bs"), F.count(value).alias("_bn")
    )
    seen = event.groupBy(*site, *group, parameter).agg(F.avg(value).alias("event_mean"), F.count(value).alias("_en"))
    out = seen.join(usual, [*site, parameter], "left")
    moved = direction(F.col("_bm"), F.col("_bs"), F.coalesce("_bn", F.lit(0)), F.col("event_mean"), F.col("_en"))
    return out.select(*site, *group, parameter, "event_mean", moved.alias("direction"))


def score_signatures(observed: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per group and pollutant: asserted, matched and missing parameters, score where all were observed."""
    table = signature_table(observed).where("expected <> 'any'")
    asserted = table.groupBy("pollutant").agg(F.count(F.lit(1)).alias("comparable"))
    hits = (
        observed.where("direction IS NOT NULL").join(F.broadcast(table), "parameter")
        .groupBy(*group, "pollutant")
        .agg(
            F.count(F.lit(1)).alias("present"),
            F.count_if(F.col("direction") == F.col("expected")).alias("agreements"),
        )
    )
    groups = observed.select(*group).distinct()
    out = groups.crossJoin(F.broadcast(asserted)).join(hits, [*group, "pollutant"], "left")
    present, agree = F.coalesce("present", F.lit(0)), F.coalesce("agreements", F.lit(0))
    complete = present == F.col("comparable")
    return out.select(
        *group, "pollutant", "comparable", agree.alias("agreements"),
        (F.col("comparable") - present).alias("missing"), complete.alias("evaluable"),
        F.when(complete, agree / F.col("comparable")).alias("score"),
    )


def diagnose(observed: DataFrame, group: Sequence[str]) -> DataFrame:
    """Verdict, cause, confidence and the tied best candidates per group."""
    rows = score_signatures(observed, group)
    telling = observed.where("direction IS NOT NULL").groupBy(*group).agg(
        F.count_if(F.col("parameter").isin(*DISCRIMINATING)).alias("telling")
    )
    best = rows.groupBy(*group).agg(
        F.coalesce(F.max("score"), F.lit(0.0)).alias("top"), F.count("score").alias("judgeable"),
        F.max_by("pollutant", F.when(F.col("evaluable"), F.struct("score", "comparable", "pollutant"))).alias("lead"),
    )
    tied = rows.join(best.select(*group, "top"), list(group)).where("score = top AND top > 0").groupBy(*group).agg(
        F.array_join(F.array_sort(F.collect_list("pollutant")), ",").alias("tied"), F.count(F.lit(1)).alias("ties")
    )
    out = best.join(telling, list(group), "left").join(tied, list(group), "left")
    n = F.coalesce("telling", F.lit(0))
    verdict = (
        F.when((F.col("judgeable") == 0) | (n < 1), "cannot_evaluate")
        .when(F.col("top") < SCORE_FLOOR, "possible_new_type")
        .when(F.col("ties") > 1, "possible_new_type")
        .otherwise("diagnosed")
    )
    confidence = F.when(n == 0, "none").when(n == 1, "moderate").otherwise("good")
    return out.select(
        *group, verdict.alias("verdict"), F.when(verdict == "diagnosed", F.col("lead")).alias("cause"),
        confidence.alias("confidence"), "top", F.coalesce("tied", F.lit("")).alias("tied"),
    )


def order_verdicts(firsts: DataFrame, reach: DataFrame, controls: Sequence[str], group: Sequence[str]) -> DataFrame:
    """How each firing sits among its flow neighbours' first firings in the same group.

    A group is one network's firings, so the pairs within it are few and bounded by the network.
    """
    mine = firsts.select(*group, F.col("site"), F.col("first"))
    theirs = firsts.select(*group, F.col("site").alias("other"), F.col("first").alias("other_first"))
    pairs = mine.join(theirs, list(group)).where("site <> other")
    up = reach.select(F.col("src").alias("other"), F.col("dst").alias("site"), F.lit(True).alias("_up"))
    down = reach.select(F.col("dst").alias("other"), F.col("src").alias("site"), F.lit(True).alias("_down"))
    pairs = pairs.join(up, ["site", "other"], "left").join(down, ["site", "other"], "left")
    same = F.col("other_first") == F.col("first")

    def names(when: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(when, F.col("other")))), ",")

    seen = pairs.groupBy(*group, "site").agg(
        names(F.col("_up").isNotNull() & (F.col("other_first") < F.col("first"))).alias("upstream_before"),
        names(F.col("_down").isNotNull() & (F.col("other_first") > F.col("first"))).alias("downstream_after"),
        names(same).alias("simultaneous"),
        names(same & F.col("other").isin(*controls)).alias("control"),
    )
    out = mine.join(seen, [*group, "site"], "left").na.fill(
        "", ["upstream_before", "downstream_after", "simultaneous", "control"]
    )
    verdict = (
        F.when(F.col("control") != "", "not_transport")
        .when((F.col("upstream_before") != "") | (F.col("downstream_after") != ""), "transport")
        .when(F.col("simultaneous") != "", "catchment_wide")
        .otherwise("local")
    )
    return out.withColumn("verdict", verdict)
