"""The alert life cycle on stored items: classification, cooldowns, quiet times, upserts, digests."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.operators.scale import period_join, runs


def fold_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], object],
                  step: Callable[[object, pd.Series], tuple[object, str]], name: str) -> DataFrame:
    """Adds a column decided row by row in order per key, from a small carried state.

    Rows are hash-partitioned by key and sorted, then streamed through Arrow batches with the state
    carried across batches, so no group is ever held whole. Give keys that include an episode where
    a pause resets the state: then one busy key spreads over many tasks.
    """
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    key_columns = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in key_columns)
                if key != held:
                    held, state = key, start()
                state, said = step(state, row)
                out.append(said)
            yield pdf.assign(**{name: out})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    return placed.mapInPandas(run, f"{fields}, {name} string")


def episodes(df: DataFrame, keys: Sequence[str], at: str, pause: int, size: int = 1 << 12) -> DataFrame:
    """Numbers stretches of items separated by at least ``pause``; one answers for its own state."""
    return runs(df, keys, at, lambda was, now: now - was >= pause, "episode", size)


def notice_checks(scores: DataFrame, checks: DataFrame, keys: Sequence[str], bucket: int, min_steps: int = 1) -> DataFrame:
    """What each check's window holds over the line: one item per check and group."""
    inside = period_join(scores, checks, [], "step", "window_start", "window_end", bucket)
    at = F.when(F.col("score") > F.col("threshold"), F.col("step"))
    items = inside.groupBy("check_id", "checked_at", *keys).agg(
        F.min(at).alias("first_over"), F.max(at).alias("last_over"), F.max("score").alias("peak"), F.count(at).alias("steps_over")
    )
    return items.where(F.col("steps_over") >= max(1, min_steps))


def classify(items: DataFrame, keys: Sequence[str], repeat: int) -> DataFrame:
    """new, same or repeat per item against the last new item of its key.

    An item is the same when its first step over has not moved, a repeat within ``repeat`` of the last
    new one. A pause of ``repeat`` with a fresh first step starts clean, which is where keys are split.
    """
    split = runs(
        items.withColumn("_seen", F.struct(F.col("checked_at").alias("c"), F.col("first_over").alias("f"))),
        keys, "checked_at",
        lambda was, now: (now["c"] - was["c"] >= repeat) & (now["f"] > was["c"]), "episode", 1 << 12, also="_seen",
    ).drop("_seen")

    def step(last, row):
        if last is not None and last[0] == row.first_over:
            return last, "same"
        if last is not None and row.checked_at - last[1] < repeat:
            return last, "repeat"
        return (row.first_over, row.checked_at), "new"

    return fold_in_order(split, [*keys, "episode"], ["checked_at"], lambda: None, step, "outcome").drop("episode")


def cooldown(sends: DataFrame, keys: Sequence[str], at: str, hold: int, tie: Sequence[str] = ()) -> DataFrame:
    """sent or held: an item is held within ``hold`` of its key's last sent one."""
    split = episodes(sends, keys, at, hold)

    def step(last, row):
        now = getattr(row, at)
        if last is not None and now - last < hold:
            return last, "held"
        return now, "sent"

    return fold_in_order(split, [*keys, "episode"], [at, *tie], lambda: None, step, "outcome").drop("episode")


def extend(open_alerts: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An open alert grows to the later last step and the higher peak."""
    return open_alerts.unionByName(seen).groupBy(*keys).agg(
        F.min("first_over").alias("first_over"), F.max("last_over").alias("last_over"), F.max("peak").alias("peak")
    )


def note_problems(known: DataFrame, found: DataFrame, keys: Sequence[str], now: int) -> DataFrame:
    """Upsert: open problems keep their start, cleared ones start afresh, new ones open."""
    old = known.select(*keys, "first_at", "last_at", "cleared_at", F.lit(True).alias("_k"))
    out = old.join(found.select(*keys).distinct().withColumn("_f", F.lit(True)), list(keys), "full")
    seen = F.col("_f").isNotNull()
    fresh = F.col("_k").isNull() | F.col("cleared_at").isNotNull()
    return out.select(
        *keys,
        F.when(seen & fresh, F.lit(now)).otherwise(F.col("first_at")).alias("first_at"),
        F.when(seen, F.lit(now)).otherwise(F.col("last_at")).alias("last_at"),
        F.when(~seen, F.col("cleared_at")).alias("cleared_at"),
    )


def clear_problems(problems: DataFrame, daily: Column, now: int, day: int, daily_ran: bool) -> DataFrame:
    """Per-pass kinds clear after a day unseen; daily kinds when the next daily run misses them."""
    ended = (~daily & (now - F.col("last_at") > day)) | (daily & F.lit(daily_ran) & (F.col("last_at") < now))
    return problems.withColumn(
        "cleared_at", F.when(F.col("cleared_at").isNull() & ended, F.lit(now)).otherwise(F.col("cleared_at"))
    )


def digest(problems: DataFrame) -> DataFrame:
    """Problems started since the last summary, and sent ones that cleared since."""
    started = problems.where("cleared_at IS NULL AND sent_at IS NULL").withColumn("part", F.lit("started"))
    ended = problems.where(
        "cleared_at IS NOT NULL AND cleared_sent_at IS NULL AND sent_at IS NOT NULL"
    ).withColumn("part", F.lit("cleared"))
    return started.unionByName(ended)


def failure_pauses(checks: DataFrame, keys: Sequence[str], order: str, limit: int = 3, size: int = 1 << 12) -> DataFrame:
    """Stretches of failed checks long enough to pause the service."""
    marked = runs(checks, keys, order, lambda was, now: was != now, "_r", size, also="ok")
    out = marked.groupBy(*keys, "_r", "ok").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("failures")
    )
    return out.where(~F.col("ok") & (F.col("failures") >= limit)).drop("_r", "ok")


def recent_readings(alerts: DataFrame, readings: DataFrame, keys: Sequence[str], back: int, last: int, bucket: int) -> DataFrame:
    """Each alert with its last ``last`` readings of the ``back`` before its end, newest last.

    Only the newest ``last`` rows per alert are ranked and gathered.
    """
    spans = alerts.select(*keys, "alert", (F.col("last_over") - back).alias("_lo"), F.col("last_over").alias("_hi"))
    near = period_join(readings, spans, keys, "step", "_lo", "_hi", bucket)
    w = Window.partitionBy("alert").orderBy(F.desc("step"))
    newest = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    cells = F.transform(F.array_sort(F.collect_list(F.struct("step", "value"))), lambda c: c["value"])
    return newest.groupBy("alert").agg(cells.alias("values"))
