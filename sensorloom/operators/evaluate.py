"""Grading detectors against labelled events, and the injection studies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.operators.scale import framed, period_join, runs


def number_events(grid: DataFrame, keys: Sequence[str], flag: str, gap: int = 0, name: str = "event",
                  bucket: int = 2048) -> DataFrame:
    """Numbers runs of flagged steps from 1, runs at most ``gap`` steps apart (inside steps too) as one."""
    hits = grid.where(flag).select(*keys, "step")
    marked = runs(hits, keys, "step", lambda was, now: now - was > gap + 1, name)
    spans = marked.groupBy(*keys, name).agg(F.min("step").alias("_lo"), F.max("step").alias("_hi"))
    inside = period_join(grid.select(*keys, "step"), spans, keys, "step", "_lo", "_hi", bucket)
    out = grid.join(inside.select(*keys, "step", name), [*keys, "step"], "left")
    return out.withColumn(name, F.coalesce(name, F.lit(0)))


def classify_events(numbered: DataFrame, keys: Sequence[str], labelled: str, detected: str) -> DataFrame:
    """tp, fp, fn or tn per step, overlapping labelled and detected events forming one group."""
    pair = numbered.withColumn("_pair", F.struct(F.col(labelled).alias("l"), F.col(detected).alias("d")))

    def breaks(was: Column, now: Column) -> Column:
        def quiet(p: Column) -> Column:
            return (p["l"] == 0) & (p["d"] == 0)

        moved_l, moved_d = was["l"] != now["l"], was["d"] != now["d"]
        return (moved_l | moved_d) & (quiet(was) | quiet(now) | (moved_l & moved_d))

    marked = runs(pair, keys, "step", breaks, "_group", also="_pair")
    kinds = marked.groupBy(*keys, "_group").agg(
        F.bool_or(F.col(labelled) > 0).alias("_l"), F.bool_or(F.col(detected) > 0).alias("_d")
    )
    kind = (
        F.when(F.col("_l") & F.col("_d"), "tp").when(F.col("_d"), "fp").when(F.col("_l"), "fn").otherwise("tn")
    )
    return marked.join(kinds.select(*keys, "_group", kind.alias("class")), [*keys, "_group"]).drop("_group", "_pair")


def event_metrics(classed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of tp, fp and fn events with precision and recall, every event weighing the same."""
    starts = framed(classed, keys, "step", {"_was": lambda w: F.lag("class").over(w)}, before=1)
    starts = starts.where(F.col("_was").isNull() | (F.col("_was") != F.col("class")))
    out = starts.groupBy(*keys).agg(
        *[F.count_if(F.col("class") == k).alias(k) for k in ("tp", "fp", "fn")]
    )
    tp = F.col("tp")
    return out.withColumns({
        "precision": F.when(tp + F.col("fp") > 0, tp / (tp + F.col("fp"))),
        "recall": F.when(tp + F.col("fn") > 0, tp / (tp + F.col("fn"))),
    })


def caught(grid: DataFrame, spans: DataFrame, keys: Sequence[str], over: str, seconds: int,
           bucket: int = 2048) -> DataFrame:
    """Per key and span: whether a step over the line fell inside, and minutes to the first."""
    hits = period_join(grid.where(over).select(*keys, "step"), spans, [], "step", "lo", "hi", bucket)
    first = hits.groupBy(*keys, "span").agg(F.min("step").alias("_first"))
    every = grid.select(*keys).distinct().crossJoin(spans)  # one row per key and span is the result
    return every.join(first, [*keys, "span"], "left").select(
        *keys, "span", F.col("_first").isNotNull().alias("caught"),
        ((F.col("_first") - F.col("lo")) * (seconds / 60.0)).alias("minutes"),
    )


def false_alarms_per_week(grid: DataFrame, keys: Sequence[str], over: str, clean: str, seconds: int,
                          gap: int = 0) -> DataFrame:
    weeks = grid.groupBy(*keys).agg((F.count_if(F.col(clean)) * (seconds / 604800.0)).alias("_weeks"))
    hits = grid.where(F.col(over) & F.col(clean)).select(*keys, "step")
    marked = runs(hits, keys, "step", lambda was, now: now - was > gap + 1, "_e")
    events = marked.groupBy(*keys).agg(F.max("_e").alias("_events"))
    return weeks.join(events, list(keys), "left").select(
        *keys, F.coalesce("_events", F.lit(0)).alias("alarms"),
        F.when(F.col("_weeks") > 0, F.coalesce("_events", F.lit(0)) / F.col("_weeks")).alias("per_week"),
    )


def range_scores(grid: DataFrame, keys: Sequence[str], labelled: str, detected: str) -> DataFrame:
    """Range-based precision and recall: each range's covered share, averaged over ranges.

    A key with only labels or only detections has one of the two, the other is NULL.
    """
    def share(of: str, by: str, name: str) -> DataFrame:
        marked = runs(grid.where(of), keys, "step", lambda was, now: now - was > 1, "_r")
        per = marked.groupBy(*keys, "_r").agg(F.avg(F.col(by).cast("int")).alias("_s"))
        return per.groupBy(*keys).agg(F.avg("_s").alias(name))

    precision = share(detected, labelled, "range_precision")
    return precision.join(share(labelled, detected, "range_recall"), list(keys), "full")


def forecast_skill(rows: DataFrame, keys: Sequence[str], model: str, need: int = 200) -> DataFrame:
    """MAE, RMSE and skill of a forecast against persistence and the diurnal naive on the same rows."""
    names = {"model": model, "persistence": "persistence", "diurnal": "diurnal"}
    same = rows.dropna(subset=["value", *names.values()])
    errors = {
        k: [F.avg(F.abs(F.col("value") - F.col(c))).alias(f"mae_{k}"),
            F.avg((F.col("value") - F.col(c)) * (F.col("value") - F.col(c))).alias(f"mse_{k}")]
        for k, c in names.items()
    }
    out = same.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[e for pair in errors.values() for e in pair])
    skill = {
        k: F.when(F.col(f"mse_{k}") > 0, 1 - F.col("mse_model") / F.col(f"mse_{k}")) for k in ("persistence", "diurnal")
    }
    p, d = skill["persistence"] > 0, skill["diurnal"] > 0
    verdict = (
        F.when(F.col("n") < need, "insufficient data").when(p & d, "beats both baselines")
        .when(p, "beats only persistence").when(d, "beats only diurnal naive").otherwise("beats neither baseline")
    )
    return out.select(
        *keys, "n", "mae_model", F.sqrt("mse_model").alias("rmse_model"),
        skill["persistence"].alias("skill_persistence"), skill["diurnal"].alias("skill_diurnal"), verdict.alias("verdict"),
    )


def inject(windows: DataFrame, magnitudes: Sequence[float], width: int) -> DataFrame:
    """Every window under every shape and magnitude: step, ramp and one-step spike added to the value.

    ``windows`` has i, the step's place in its window.
    """
    i = F.col("i")
    shapes = {
        "step": F.lit(1.0), "ramp": i / float(width - 1), "spike": F.when(i == width // 2, 1.0).otherwise(0.0),
    }
    cases = F.array(*[
        F.struct(F.lit(s).alias("shape"), F.lit(float(m)).alias("magnitude"), (unit * float(m)).alias("delta"))
        for s, unit in shapes.items() for m in magnitudes
    ])
    return windows.select(*windows.columns, F.inline(cases)).withColumn("value", F.col("value") + F.col("delta"))


def fault_shapes(windows: DataFrame, width: int, size: Mapping[str, float]) -> DataFrame:
    """A window's value under each fault: stuck, stale, partial, drift, spike, decouple."""
    i, v, head, middle, spread = (F.col(c) for c in ("i", "value", "head", "centre", "spread"))
    share = i / float(width - 1)
    shapes = {
        "stuck": head,
        "stale": F.when(i < width // 2, v),
        "partial": v + (middle - v) * size["partial"],
        "drift": v + spread * size["drift"] * share,
        "spike": F.when(i == width - 2, v + spread * size["spike"]).otherwise(v),
        "decouple": 2 * middle - v,
    }
    cases = F.array(*[F.struct(F.lit(s).alias("shape"), x.alias("faulted")) for s, x in shapes.items()])
    return windows.select(*windows.columns, F.inline(cases))
