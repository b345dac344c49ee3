"""From scores to verdicts: rules, judgements, the support stack, notices, refits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.operators.rain import fired
from sensorloom.operators.scale import period_join, quantiles, runs


def clean_mask(grid: DataFrame, spans: DataFrame, wet: DataFrame, mode: str = "decay_mode") -> DataFrame:
    """A step is clean outside every half-open labelled span [lo, hi) and with the gate not raised."""
    inside = period_join(
        grid.select("step").distinct(), spans, [], "step", "lo", "hi", 360, closed_end=False
    ).select("step").distinct().withColumn("_labelled", F.lit(True))
    out = grid.join(inside, "step", "left").join(
        wet.select("step", F.col(mode).alias("_m")), "step", "left"
    )
    calm = F.coalesce("_m", F.lit(1.0)) <= 1.0 + 1e-9
    return out.withColumn("clean", F.col("_labelled").isNull() & calm).drop("_labelled", "_m")


def held_out(held: DataFrame, keys: Sequence[str], by: str, budget: float, gap: int = 8) -> DataFrame:
    """Alarms (merged runs over ``line``) and judged steps per test, against twice the budget."""
    judged = held.groupBy(by).agg(F.count(F.lit(1)).alias("judged"))
    hits = held.where(F.col("stat") > F.col("line")).select(*keys, "step")
    marked = runs(hits, keys, "step", lambda was, now: now - was > gap, "_c", start="_s")
    alarms = marked.where("step = _s").groupBy(by).agg(F.count(F.lit(1)).alias("alarms"))
    rate = F.coalesce("alarms", F.lit(0)) / F.col("judged")
    return judged.join(alarms, by, "left").select(
        by, F.coalesce("alarms", F.lit(0)).alias("alarms"), "judged", rate.alias("rate"),
        (rate <= 2 * budget).alias("passed"),
    )


def refit(grid: DataFrame, clean: DataFrame, keys: Sequence[str], need: int) -> DataFrame:
    """Median and IQR on the kept steps where there are enough, the base calibration elsewhere."""
    probs = {"a": 0.25, "m": 0.5, "b": 0.75}
    kept = grid.join(clean.where("clean").select(*keys, "step"), [*keys, "step"])
    new = quantiles(kept, keys, "value", probs, count="steps").select(
        *keys, F.struct("steps", "a", "m", "b").alias("n")
    )
    old = quantiles(grid, keys, "value", probs).select(*keys, F.struct("a", "m", "b").alias("o"))
    enough = F.coalesce(F.col("n.steps") >= need, F.lit(False))
    return old.join(new, list(keys), "left").select(
        *keys, enough.alias("refitted"),
        F.when(enough, F.col("n.m")).otherwise(F.col("o.m")).alias("median"),
        F.when(enough, F.col("n.b") - F.col("n.a")).otherwise(F.col("o.b") - F.col("o.a")).alias("iqr"),
    )


def robust_calibration(real: DataFrame, keys: Sequence[str], error: str, level: str) -> DataFrame:
    """Per node: median and IQR of the forecast error and of the level, the IQR kept above zero."""
    probs = {"a": 0.25, "m": 0.5, "b": 0.75}
    long = real.unpivot(list(keys), [error, level], "_what", "_x")
    q = quantiles(long, [*keys, "_what"], "_x", probs)

    def pick(what: str, c: Column) -> Column:
        return F.max(F.when(F.col("_what") == what, c))

    iqr = F.greatest(F.col("b") - F.col("a"), F.lit(1e-6))
    return q.groupBy(*keys).agg(
        pick(error, F.col("m")).alias("error_median"), pick(error, iqr).alias("error_iqr"),
        pick(level, F.col("m")).alias("level_median"), pick(level, iqr).alias("level_iqr"),
    )


def two_rules(real: DataFrame, calibration: DataFrame, wet: DataFrame, keys: Sequence[str],
              line: float, k: float, mode: str = "deployed_mode") -> DataFrame:
    """Forecast-residual score against a rain-raised line (s1, t1) and level-shift score (s2, t2)."""
    out = real.join(calibration, list(keys)).join(wet.select("step", F.col(mode).alias("_m")), "step", "left")
    return out.select(
        *keys, "step", "value",
        ((F.col("err") - F.col("error_median")) / F.col("error_iqr")).alias("s1"),
        (F.lit(line) * F.coalesce("_m", F.lit(1.0))).alias("t1"),
        F.abs((F.col("value") - F.col("level_median")) / F.col("level_iqr")).alias("s2"),
        F.lit(k).alias("t2"),
    )


def judge(ruled: DataFrame, keys: Sequence[str], min_real: int = 30, min_over: int = 3) -> DataFrame:
    """One verdict per calibrated node, or why there is none."""
    counts = ruled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_real"),
        F.count_if(F.col("s1") > F.col("t1")).alias("_o1"), F.count_if(F.col("s2") > F.col("t2")).alias("_o2"),
    )
    names = F.concat_ws(
        ",",
        F.when(F.col("_o1") >= min_over, F.lit("forecast_residual")),
        F.when(F.col("_o2") >= min_over, F.lit("level_shift")),
    )
    enough = F.col("n_real") >= min_real
    return counts.select(
        *keys, "n_real", enough.alias("judged"),
        F.when(enough, names).otherwise("insufficient_real_data").alias("rules_fired"),
    )


def support_stack(rows: DataFrame, base: Column, modulators: Mapping[str, Column],
                  detectors: Mapping[str, Column]) -> DataFrame:
    """Final line, verdict, and the verdict without each module in turn."""
    raised = {n: F.coalesce(m, F.lit(1.0)) for n, m in modulators.items()}
    votes = {n: F.coalesce(v, F.lit(False)) for n, v in detectors.items()}
    score = F.col("score")

    def line(leave: str | None = None) -> Column:
        return reduce(lambda a, b: a * b, [m for n, m in raised.items() if n != leave], base)

    def verdict(primary: Column, leave: str | None = None) -> Column:
        any_vote = reduce(lambda a, b: a | b, [v for n, v in votes.items() if n != leave], primary)
        return F.when(any_vote, "fired").when(score.isNull(), "not_scorable").otherwise("clear")

    primary = fired(score, line())
    without = F.struct(
        *[verdict(fired(score, line(n))).alias(n) for n in raised],
        *[verdict(primary, n).alias(n) for n in votes],
    )
    return rows.withColumns({
        "final_threshold": line(), "primary_fired": primary, "verdict": verdict(primary), "without": without,
    })


def notice(scores: DataFrame, keys: Sequence[str], min_steps: int = 1, scale: float = 1.0) -> DataFrame:
    """Groups over their line: first and last step over, peak, base at the first, how many steps."""
    over = fired(F.col("score"), F.col("threshold") * scale)
    at = F.when(over, F.col("step"))
    out = scores.groupBy(*keys).agg(
        F.min(at).alias("first_over"), F.max(at).alias("last_over"), F.max("score").alias("peak"),
        F.min_by("base", at).alias("base"), F.count(at).alias("steps_over"),
    )
    return out.where(F.col("steps_over") >= max(1, min_steps))


def longest_run(hits: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    marked = runs(hits, keys, position, lambda was, now: now - was > 1, "_r")
    lengths = marked.groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_c"))
    return lengths.groupBy(*keys).agg(F.max("_c").alias("longest"))
