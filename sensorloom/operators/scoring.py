"""Control statistics to score rows: base lines per kind, corroboration, the rain-gated line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sensorloom.operators.charts import corroborated, siblings
from sensorloom.operators.scale import quantiles
from sensorloom.session import checkpoint

RULES = (("hampel_spike", "spike", "hampel_base"), ("cusum_shift", "cusum", "cusum_base"),
         ("ewma_drift", "ewma", "ewma_base"))


def kind_lines(charted: DataFrame, kind: str = "variable", q: float = 0.98) -> DataFrame:
    """One empirical base line per kind of sensor and rule, in one pass over (kind, rule)."""
    long = charted.unpivot([kind], ["hampel", "cusum", "ewma"], "rule", "stat")
    lines = quantiles(long, [kind, "rule"], "stat", {"line": q})
    return lines.groupBy(kind).agg(
        *[
            F.max(F.when(F.col("rule") == stat, F.col("line"))).alias(f"{stat}_base")
            for stat in ("hampel", "cusum", "ewma")
        ]
    )


def spikes_with_lines(charted: DataFrame, keys: Sequence[str], lines: DataFrame | None = None) -> DataFrame:
    """The spike statistic kept only as far as the step before or a sibling sensor agrees."""
    site, variable = keys
    out = charted.join(lines if lines is not None else checkpoint(kind_lines(charted, variable)), variable)
    out = out.withColumn("ratio", F.col("hampel") / F.col("hampel_base"))
    out = siblings(out, [site, "step"], variable, "ratio")
    out = corroborated(out, keys, "ratio", "siblings", "_agreed")
    return out.withColumn("spike", F.col("_agreed") * F.col("hampel_base")).drop("_agreed")


def score_rows(charted: DataFrame, wet: DataFrame, keys: Sequence[str], mode: str = "deployed",
               lines: DataFrame | None = None) -> DataFrame:
    """(site, variable, rule, step, score, threshold, base) for every judged step."""
    out = spikes_with_lines(charted, keys, lines).join(
        wet.select("step", F.col(f"{mode}_mode").alias("_m")), "step", "left"
    )
    m = F.coalesce("_m", F.lit(1.0))
    rows = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"), F.col(stat).alias("score"),
                (F.col(base) * m).alias("threshold"), F.col(base).alias("base"),
            )
            for rule, stat, base in RULES
        ]
    )
    return (
        out.select(*keys, "step", F.inline(rows))
        .where("score IS NOT NULL")
        .select(*keys, "rule", "step", "score", "threshold", "base")
    )
