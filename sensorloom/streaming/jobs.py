"""Structured Streaming jobs: ingest, incremental screening, windows, stateful charts and alerts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sensorloom.session import checkpoint, scratch
from sensorloom.sources import sinks

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """A parquet folder as a stream, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_now(df: DataFrame, mode: str, path: str, mark: str | None = None) -> DataFrame:
    """Run a streaming query over all there is into a parquet table, and return the table.

    With the checkpoint folder ``mark`` of an earlier run it goes on from there.
    """
    spark = df.sparkSession
    query = (
        df.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", mark or scratch(spark)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def replay(parts: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Let ``parts`` arrive one after the other in a folder and run the same streaming query after each.

    A part may be any number of files; state and watermark go on from run to run.
    """
    spark = parts[0].sparkSession
    folder, out, mark = scratch(spark), scratch(spark), scratch(spark)
    for part in parts:
        part.write.mode("append").parquet(folder)
        table = run_now(build(stream(spark, folder, part.schema)), mode, out, mark)
    return table


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], mark: str | None = None) -> None:
    query = (
        df.writeStream.foreachBatch(each).option("checkpointLocation", mark or scratch(df.sparkSession))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _stored(spark: SparkSession, schema, table: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(table)
    except Exception as missing:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def ingest(df: DataFrame, table: str, keys: Sequence[str], late: str = "30 days", mark: str | None = None) -> None:
    """Append only new or changed readings to the raw table, late ones up to ``late`` old.

    A batch may hold several versions of a reading: each that differs from the one fetched before it is kept,
    however the files fell into batches. A batch meets only the stored days it touches, and a batch that is
    run again finds its own rows and adds none.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("day").distinct()
        stored = _stored(batch.sparkSession, batch.schema, table).join(touched, "day", "left_semi")
        sinks.append_days(sinks.changed_versions(stored, batch, keys), table)

    run_batches(df.withWatermark("time", late), each, mark)


def screen_incrementally(df: DataFrame, raw: str, flags: str, flag: Callable[[DataFrame], DataFrame],
                         reach: Callable[[DataFrame, DataFrame], DataFrame], keys: Sequence[str], mark: str | None = None) -> None:
    """Per batch: append the readings, re-flag only the series days they can change.

    ``reach`` gets all stored rows and the batch, and returns for each series the days to flag again
    (``keys``, flag_from, flag_to) and the first day whose rows those flags depend on (read_from). It follows the
    series' own rows, so a slow sensor reaches as far as its flags do. A batch run again replaces its own rows.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _stored(spark, batch.schema, raw)
        sinks.append_days(batch.join(known.select("seq").distinct(), "seq", "left_anti"), raw)
        rows = spark.read.schema(batch.schema).parquet(raw)
        around = checkpoint(reach(rows, batch))
        near = rows.join(around, list(keys)).where("day >= read_from")
        fresh = flag(near.select(*rows.columns)).join(around, list(keys)).where("day BETWEEN flag_from AND flag_to")
        days = fresh.select("day").distinct()
        # a day's partition also holds other series' flags and days of this series that stay as they were
        fresh = checkpoint(fresh.drop("flag_from", "flag_to", "read_from"))
        old = _stored(spark, fresh.schema, flags).join(days, "day", "left_semi").join(fresh.select("seq"), "seq", "left_anti")
        sinks.replace_days(checkpoint(old.unionByName(fresh)), flags)

    run_batches(df, each, mark)


def tumbling(df: DataFrame, keys: Sequence[str], width: str, late: str = "1 day") -> DataFrame:
    w = F.window("time", width)
    out = df.withWatermark("time", late).groupBy(*keys, w).agg(F.count("value").alias("readings"), F.max("value").alias("top"))
    return out.select(*keys, F.unix_seconds("window.start").alias("second"), "readings", "top")


def sliding(df: DataFrame, keys: Sequence[str], width: str, slide: str, late: str = "1 day") -> DataFrame:
    w = F.window("time", width, slide)
    out = df.withWatermark("time", late).groupBy(*keys, w).agg(F.count("value").alias("readings"), F.max("value").alias("top"))
    return out.select(*keys, F.unix_seconds("window.start").alias("second"), "readings", "top")


def sessions(df: DataFrame, keys: Sequence[str], gap: str, late: str = "1 day") -> DataFrame:
    """One alarm per cluster of over-line moments closer than the gap."""
    w = F.session_window("time", gap)
    out = df.withWatermark("time", late).groupBy(*keys, w).agg(F.count(F.lit(1)).alias("steps"), F.max("value").alias("peak"))
    return out.select(*keys, F.unix_seconds("session_window.start").alias("second"), "steps", "peak")


class Charts(StatefulProcessor):
    """CUSUM and EWMA of each key over all batches, in closed form from the state the last batch left.

    With S the running sum of a stretch, the upper sum is S + max(start, -min S); a long gap of steps begins a new
    stretch from zero. Steps must arrive in order from batch to batch; inside a batch they are sorted. A key that
    has been silent for so long starts from zero anyway: a timer at ``step_ms`` a step then removes its state.
    """

    allowance, lam, reset, step_ms = 0.5, 0.2, 8, 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", "up double, down double, mean double, at bigint")

    def _one_sided(self, push: np.ndarray, start: float) -> np.ndarray:
        total = np.cumsum(push - self.allowance)
        return total + np.maximum(start, -np.minimum.accumulate(total))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat([f.dropna(subset=["z"]) for f in rows]).sort_values("step", ignore_index=True)
        if frame.empty:
            return
        up, down, mean, at = self.carried.get() if self.carried.exists() else (0.0, 0.0, 0.0, None)
        step, z = frame["step"].to_numpy(), frame["z"].to_numpy()
        opens = np.diff(step, prepend=step[0] if at is None else at) > self.reset + 1
        cusum, ewma = np.empty(len(z)), np.empty(len(z))
        for part in np.split(np.arange(len(z)), np.flatnonzero(opens)):
            if not len(part):
                continue
            if opens[part[0]]:
                up = down = mean = 0.0
            highs, lows = self._one_sided(z[part], up), self._one_sided(-z[part], down)
            means = pd.Series(np.append(mean, z[part])).ewm(alpha=self.lam, adjust=False).mean().to_numpy()[1:]
            cusum[part], ewma[part] = np.maximum(highs, lows), np.abs(means) / math.sqrt(self.lam / (2.0 - self.lam))
            up, down, mean = float(highs[-1]), float(lows[-1]), float(means[-1])
        self.carried.update((up, down, mean, int(step[-1])))
        if self.step_ms:
            wake(self.handle, (int(step[-1]) + self.reset + 2) * self.step_ms)
        yield pd.DataFrame({"site": key[0], "variable": key[1], "step": step, "cusum": cusum, "ewma": ewma})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.carried.clear()
        return iter(())

    def close(self) -> None:
        pass


class Alerts(StatefulProcessor):
    """new, same or repeat per item, against the key's last new item."""

    repeat = 3

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "first_over bigint, checked_at bigint")

    def handleInputRows(self, key, rows, timerValues):
        last = self.state.get() if self.state.exists() else None
        batch = pd.concat(list(rows)).sort_values("checked_at")
        said = []
        for first, checked in zip(batch["first_over"], batch["checked_at"], strict=True):
            if last is not None and last[0] == first:
                said.append("same")
            elif last is not None and checked - last[1] < self.repeat:
                said.append("repeat")
            else:
                last = (int(first), int(checked))
                said.append("new")
        if last is not None:
            self.state.update(last)
        yield pd.DataFrame({"site": key[0], "variable": key[1], "rule": key[2], "checked_at": batch["checked_at"],
                            "first_over": batch["first_over"], "outcome": said})

    def close(self) -> None:
        pass


class Cooldown(StatefulProcessor):
    """sent or held per item, a sent item starting its key's hold.

    Initial state (``at`` of stored sends) lets a new stream go on where an old one was lost. With ``step_ms`` a timer
    removes the state of a key once its hold is over.
    """

    hold, step_ms = 6, 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sent", "at bigint")

    def _remember(self, at: int) -> None:
        self.state.update((at,))
        if self.step_ms:
            wake(self.handle, (at + self.hold) * self.step_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._remember(int(initialState["at"].max()))

    def handleInputRows(self, key, rows, timerValues):
        last = self.state.get()[0] if self.state.exists() else None
        batch = pd.concat(list(rows)).sort_values("at")
        moments = batch["at"].to_numpy()
        sent = np.zeros(len(moments), dtype=bool)
        place = 0 if last is None else int(np.searchsorted(moments, last + self.hold))
        while place < len(moments):  # from send to send
            sent[place] = True
            last = int(moments[place])
            place = int(np.searchsorted(moments, last + self.hold)) if self.hold else place + 1
        if sent.any():
            self._remember(last)
        yield pd.DataFrame({"site": key[0], "variable": key[1], "rule": key[2], "at": batch["at"], "outcome": np.where(sent, "sent", "held")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class QuietTime(StatefulProcessor):
    """When each item of a model is sent: at once, or held in a queue until the quiet time after the last send ends.

    What the queue lets out is a send of its own and starts the next quiet time. Nothing is dropped. A timer opens the
    queue; with nothing in it, the model is forgotten.
    """

    gap, step_ms = 4, 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")
        self.queue = handle.getListState("queue", "site string, variable string, at bigint")

    def _told(self, key, held: list, at: int) -> pd.DataFrame:
        return pd.DataFrame([(site, variable, key[0], step, at) for site, variable, step in held], columns=["site", "variable", "rule", "at", "sent_at"])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        last = int(initialState["at"].max())
        self.last.update((last,))
        wake(self.handle, (last + self.gap) * self.step_ms)

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else None
        held = [tuple(x) for x in self.queue.get()]
        batch = pd.concat(list(rows)).sort_values(["at", "site", "variable"])
        moments, place = batch["at"].to_numpy(), 0
        items = list(zip(batch["site"], batch["variable"], batch["at"].astype(int), strict=True))
        while place < len(moments):  # from send to send
            if last is not None:
                upto = int(np.searchsorted(moments, last + self.gap, side="right" if held or moments[place] < last + self.gap else "left"))
                held += items[place:upto]
                place = upto
                if place == len(moments):
                    break
            if held:  # time has gone past the end of the quiet time
                last += self.gap
                yield self._told(key, held, last)
                held = []
                continue
            upto = int(np.searchsorted(moments, moments[place], side="right"))
            last = int(moments[place])
            yield self._told(key, items[place:upto], last)
            place = upto
        self.last.update((last,))
        if held:
            self.queue.put(held)
        else:
            self.queue.clear()
        wake(self.handle, (last + self.gap) * self.step_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.queue.get()]
        if not held:
            self.last.clear()
            return
        last = self.last.get()[0] + self.gap
        self.queue.clear()
        self.last.update((last,))
        wake(self.handle, (last + self.gap) * self.step_ms)
        yield self._told(key, held, last)

    def close(self) -> None:
        pass


class Problems(StatefulProcessor):
    """Life cycle of a problem from its sightings: opened at the first, cleared once it was not seen for ``unseen``.

    A timer says so without any further row, and takes the state away. Rows: ``at`` in units of ``step_ms``.
    """

    unseen, step_ms = 24, 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "first_at bigint, last_at bigint, sightings bigint")

    def _cleared(self, key, state) -> dict:
        return {"site": key[0], "variable": key[1], "first_at": state[0], "last_at": state[1], "sightings": state[2], "cleared_at": state[1] + self.unseen}

    def handleInitialState(self, key, initialState, timerValues) -> None:
        newest = initialState.sort_values("last_at").iloc[-1]
        self.state.update((int(newest["first_at"]), int(newest["last_at"]), int(newest["sightings"])))
        wake(self.handle, (int(newest["last_at"]) + self.unseen) * self.step_ms + 1)

    def handleInputRows(self, key, rows, timerValues):
        state = self.state.get() if self.state.exists() else None
        at = np.sort(pd.concat(list(rows))["at"].to_numpy())
        parts = np.split(at, np.flatnonzero(np.diff(at) > self.unseen) + 1)
        out = []
        for part in parts:
            if state is not None and part[0] - state[1] > self.unseen:
                out.append(self._cleared(key, state))
                state = None
            first, seen = (int(part[0]), 0) if state is None else (state[0], state[2])
            state = (first, int(part[-1]), seen + len(part))
        self.state.update(state)
        wake(self.handle, (state[1] + self.unseen) * self.step_ms + 1)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.state.get()
        self.state.clear()
        yield pd.DataFrame([self._cleared(key, state)])

    def close(self) -> None:
        pass


def wake(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """One timer a key, at this moment."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at_ms)


def stateful(df: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: str, late: str | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Run a processor per key. With ``late``, the watermark's delay on ``time``, its timers run on event time.

    ``initial``: rows from which a new stream takes its first state (``keys`` and the processor's columns).
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    if late is not None:
        df = df.withWatermark("time", late)
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None" if late is None else "EventTime",
        initialState=None if initial is None else initial.groupBy(*keys))
