"""Alarm clusters, generalised Pareto tails and lines, nulls and p-values."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.functions.stats import gpd_sf, threshold_for
from sensorloom.operators.scale import prefix, quantiles, runs
from sensorloom.session import checkpoint

# The ladder of start percentiles and the least clusters a fit needs.
LADDER = (98.0, 95.0, 90.0, 85.0, 80.0)
MIN_CLUSTERS = 20


def clusters(hits: DataFrame, keys: Sequence[str], stat: str, gap: int = 8) -> DataFrame:
    """Peak and extent of each run of hits, runs at most ``gap`` steps apart being one."""
    marked = runs(hits, keys, "step", lambda was, now: now - was > gap, "_cluster")
    return marked.groupBy(*keys, "_cluster").agg(
        F.max(stat).alias("peak"), F.min("step").alias("first_step"),
        F.max("step").alias("last_step"), F.count(F.lit(1)).alias("steps"),
    ).drop("_cluster")


def ladder(stats: DataFrame, keys: Sequence[str], stat: str, gap: int = 8,
           need: int = MIN_CLUSTERS) -> tuple[DataFrame, DataFrame]:
    """The first percentile that leaves enough clusters, and its exceedances.

    All five levels are tried in one pass. Returns (one row per key: percentile, t, n, n_t;
    one row per cluster: keys, t, excess).
    """
    names = {f"_p{i}": p / 100.0 for i, p in enumerate(LADDER)}
    levels = quantiles(stats, keys, stat, names, count="n")
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("_rank"), F.lit(p).alias("percentile"), F.col(f"_p{i}").alias("t"))
            for i, p in enumerate(LADDER)
        ]
    )
    tried = levels.select(*keys, "n", F.inline(rows))
    hits = (
        stats.join(tried, list(keys)).where(F.col(stat) > F.col("t"))
        .select(*keys, "_rank", "percentile", "t", "n", "step", stat)
    )
    peaks = clusters_with(hits, [*keys, "_rank"], stat, gap, ["percentile", "t", "n"])
    counted = peaks.groupBy(*keys, "_rank", "percentile", "t", "n").agg(F.count(F.lit(1)).alias("n_t"))
    best = (
        counted.where(F.col("n_t") >= need).groupBy(*keys)
        .agg(F.min_by(F.struct("percentile", "t", "n", "n_t", "_rank"), "_rank").alias("b"))
        .select(*keys, "b.*")
    )
    excess = peaks.join(best.select(*keys, "_rank"), [*keys, "_rank"]).select(
        *keys, "t", (F.col("peak") - F.col("t")).alias("excess")
    )
    return best.drop("_rank"), excess


def clusters_with(hits: DataFrame, keys: Sequence[str], stat: str, gap: int, carry: Sequence[str]) -> DataFrame:
    marked = runs(hits, keys, "step", lambda was, now: now - was > gap, "_cluster")
    return marked.groupBy(*keys, "_cluster").agg(
        F.max(stat).alias("peak"), *[F.first(c).alias(c) for c in carry]
    ).drop("_cluster")


def fit_gpd(excess: DataFrame, keys: Sequence[str], y: str = "excess", rounds: int = 5,
            points: int = 48, bounded: bool = False) -> DataFrame:
    """(n, sigma, gamma) of a generalised Pareto per key by profile likelihood.

    With s = gamma / sigma the likelihood depends on s alone: gamma(s) = mean(log1p(s y)). Candidates
    for s are spread over its range, held as one array per key, and their means are taken in one aggregate
    map-side, so a key's exceedances never gather in one task. Each round narrows to the best
    candidate's neighbours. The exponential limit wins where no candidate beats it. ``bounded`` also
    tries negative shapes (down to -1), whose tails end.
    """
    excess = checkpoint(excess.select(*keys, y))  # read once per round
    basics = excess.groupBy(*keys).agg(
        F.count(y).alias("n"), F.avg(y).alias("_mean"), F.max(y).alias("_top")
    )
    limits = basics.withColumns({"_a": -(1 - 1e-6) / F.col("_top"), "_b": F.lit(0.0)})
    best = limits
    for i in range(rounds):
        candidates = []
        for k in range(points + 1):
            share = k / float(points)
            if i:
                at = F.col("_a") + (F.col("_b") - F.col("_a")) * share
            else:
                # first over nine decades of s in units of 1 / mean, on both sides of 0 if asked
                split = 0.4 if bounded else 0.0
                if bounded and share < split:
                    at = F.col("_a") * (1 - share / split) ** 3.0
                else:
                    at = math.exp(math.log(1e-6) + (share - split) / (1 - split) * math.log(1e9)) / F.col("_mean")
            candidates.append(at)
        tried = best.withColumn("_ss", F.array(*candidates))
        # all candidates' means in one aggregate: an exceedance stays one row
        means = excess.join(tried.select(*keys, "_ss"), list(keys)).groupBy(*keys).agg(
            *[F.avg(F.log1p(F.get("_ss", F.lit(k)) * F.col(y))).alias(f"_g{k}") for k in range(points + 1)]
        )
        means = means.select(*keys, F.array(*[f"_g{k}" for k in range(points + 1)]).alias("_gs"))
        cells = F.transform(
            F.arrays_zip("_ss", "_gs"),
            lambda c, k: F.struct((-F.log(c["_gs"] / c["_ss"]) - c["_gs"] - 1.0).alias("_ll"), k.alias("_k"), c["_ss"].alias("_s"), c["_gs"].alias("_gamma")),
        )
        usable = F.filter(cells, lambda c: c["_ll"].isNotNull() & ~F.isnan(c["_ll"]) & (c["_s"] != 0) & (c["_gamma"] > -1))
        found = tried.join(means, list(keys)).withColumn("_best", F.array_max(usable)).where("_best IS NOT NULL")
        beside = lambda step: F.when(F.get("_ss", F.col("_best._k") + step) != 0, F.get("_ss", F.col("_best._k") + step))
        best = checkpoint(found.select(
            *keys, "n", "_mean", "_top", "_best",
            F.coalesce(beside(-1), F.col("_best._s")).alias("_a"), F.coalesce(beside(1), F.col("_best._s")).alias("_b"),
        ))  # one row per key
    flat = -F.log("_mean") - 1.0
    exponential = flat >= F.col("_best._ll")
    return best.select(
        *keys, "n",
        F.when(exponential, F.col("_mean")).otherwise(F.col("_best._gamma") / F.col("_best._s")).alias("sigma"),
        F.when(exponential, 0.0).otherwise(F.col("_best._gamma")).alias("gamma"),
    )


def pot(scores: DataFrame, keys: Sequence[str], score: str, q: float = 1e-4, u: float = 0.98) -> DataFrame:
    """Peaks over threshold with its diagnostics and fallbacks, one row per key."""
    scores = checkpoint(scores.select(*keys, score))
    marks = checkpoint(quantiles(scores, keys, score, {"u": u, "_q": 1.0 - q}, count="n"))
    over = scores.join(marks.select(*keys, "u"), list(keys)).where(F.col(score) > F.col("u"))
    excess = over.select(*keys, (F.col(score) - F.col("u")).alias("excess"))
    fit = fit_gpd(excess, keys).withColumnRenamed("n", "n_u")
    out = marks.join(fit, list(keys), "left").withColumn("n_u", F.coalesce("n_u", F.lit(0)))
    enough = (F.col("n") >= 50) & (F.col("n_u") >= MIN_CLUSTERS) & (F.col("sigma") > 0)
    ratio = F.lit(q) * F.col("n") / F.col("n_u")
    line = F.when(F.col("n") < 50, F.lit(None).cast("double")).when(
        enough, threshold_for(F.col("u"), F.col("sigma"), F.col("gamma"), ratio, 1e-8)
    ).otherwise(F.col("_q"))
    note = (
        F.when(F.col("n") < 50, "too few scores to fit")
        .when(~enough, "too few exceedances, empirical quantile used").otherwise("")
    )
    out = out.withColumns({"threshold": line, "fitted": enough, "note": note}).drop("_q")
    rate = scores.join(out.select(*keys, "threshold"), list(keys)).groupBy(*keys).agg(
        F.avg((F.col(score) > F.col("threshold")).cast("double")).alias("empirical_rate")
    )
    return out.join(rate, list(keys), "left")


def fit_null(samples: DataFrame, keys: Sequence[str], score: str, tail: float = 0.95) -> DataFrame:
    """One row per channel: n, and the tail's u, sigma, gamma, share where it can be fitted."""
    marks = checkpoint(quantiles(samples, keys, score, {"u": tail}, count="n"))
    over = samples.join(marks, list(keys)).where(F.col(score) > F.col("u"))
    excess = over.select(*keys, (F.col(score) - F.col("u")).alias("excess"))
    fit = fit_gpd(excess, keys).withColumnRenamed("n", "n_u")
    usable = (F.col("n") >= 50) & (F.col("n_u") >= MIN_CLUSTERS) & (F.col("sigma") > 0)
    return marks.join(fit, list(keys), "left").select(
        *keys, "n", *[F.when(usable, F.col(c)).alias(c) for c in ("u", "sigma", "gamma")],
        F.when(usable, F.col("n_u") / F.col("n")).alias("tail_p"),
    )


def pvalues(scores: DataFrame, samples: DataFrame, tails: DataFrame, keys: Sequence[str], score: str,
            width: float) -> DataFrame:
    """Right-tail probability of each score against its channel's null: (1 + #>=) / (1 + n), the
    fitted tail above u.

    Scores and null samples are merged and counted along the score axis in chunks of ``width``, so the
    null is never gathered into an array.
    """
    counted = samples.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"))
    marks = counted.select(*keys, score, "_n", F.lit(1).alias("_kind"), F.lit(None).cast(
        scores.select(F.struct(*scores.columns).alias("r")).schema["r"].dataType).alias("_row"))
    asked = scores.where(F.col(score).isNotNull()).select(
        *keys, score, F.lit(0).cast("bigint").alias("_n"), F.lit(0).alias("_kind"),
        F.struct(*scores.columns).alias("_row"),
    )
    ranked = prefix(
        asked.unionByName(marks), keys, score, {"_below": ("sum", F.col("_n"))}, width, tie=("_kind",)
    ).where("_kind = 0")
    out = ranked.select("_row.*", "_below").join(tails, list(keys))
    empirical = (1.0 + F.col("n") - F.col("_below")) / (1.0 + F.col("n"))
    gamma = F.greatest("gamma", F.lit(0.0))
    tail = F.col("tail_p") * gpd_sf(F.col(score), F.col("u"), F.col("sigma"), gamma)
    p = F.when(F.col("u").isNotNull() & (F.col(score) > F.col("u")), F.greatest(tail, F.lit(1e-300)))
    return out.withColumn("p", p.otherwise(empirical)).select(*scores.columns, "p")


def fisher(pvals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fisher's statistic over the live channels and how many there were."""
    held = F.least(F.greatest("p", F.lit(1e-300)), F.lit(1.0))
    return pvals.groupBy(*keys).agg(
        F.sum(-2.0 * F.log(held)).alias("fisher"), F.count("p").alias("channels")
    )


def thresholds_for_rates(tails: DataFrame, stops: Mapping[str, float], tests: int = 3) -> DataFrame:
    """Each tail's line at each sensitivity stop, a stop's rate split evenly over the tests."""
    table = F.array(*[F.struct(F.lit(n).alias("stop"), F.lit(r).alias("rate")) for n, r in stops.items()])
    out = tails.select(*tails.columns, F.inline(table))
    ratio = F.col("rate") / tests * F.col("n") / F.col("n_t")
    return out.withColumn(
        "threshold", threshold_for(F.col("t"), F.col("sigma"), F.col("gamma"), ratio)
    )
