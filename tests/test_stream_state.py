"""State of streams: it survives a restart, lets held items out, and goes when it is of no more use."""

import itertools

from pyspark.sql import functions as F

from sensorloom.session import scratch
from sensorloom.streaming import jobs

ITEMS = "site string, variable string, rule string, at bigint"
SENT = f"{ITEMS}, outcome string"


def items(spark, rows):
    return spark.createDataFrame(rows, ITEMS).withColumn("time", F.timestamp_seconds("at"))


def sends(moments, hold):
    last, out = None, []
    for at in sorted(moments):
        if last is None or at - last >= hold:
            last = at
            out.append((at, "sent"))
        else:
            out.append((at, "held"))
    return out


def processor(kind, **settings):
    made = kind()
    for name, value in settings.items():
        setattr(made, name, value)
    return made


def test_cooldown_goes_on_from_stored_sends_with_a_fresh_checkpoint(spark):
    moments = [1, 3, 7, 8, 12, 13, 14, 19, 24, 25]
    rows = [("a", "v", "r", at) for at in moments]
    run = lambda part, initial: jobs.stateful(part, ["site", "variable", "rule"], processor(jobs.Cooldown, step_ms=1000), SENT, "0 seconds", initial)
    first = jobs.replay([items(spark, rows[:6])], lambda part: run(part, None))
    stored = first.where("outcome = 'sent'").groupBy("site", "variable", "rule").agg(F.max("at").alias("at"))
    second = jobs.replay([items(spark, rows[6:])], lambda part: run(part, stored))
    got = sorted((r["at"], r["outcome"]) for r in first.unionByName(second).collect())
    assert got == sends(moments, 6)
    alone = jobs.replay([items(spark, rows[6:])], lambda part: run(part, None))
    assert sorted((r["at"], r["outcome"]) for r in alone.collect()) != got[6:]


def test_silent_keys_leave_no_state(spark):
    folder, out, mark = scratch(spark), scratch(spark), scratch(spark)
    left = []
    for rows in ([(f"s{i}", "v", "r", 10 + i) for i in range(40)], [("late", "v", "r", 500)], [("later", "v", "r", 900)]):
        items(spark, rows).write.mode("append").parquet(folder)
        stream = jobs.stateful(jobs.stream(spark, folder, items(spark, rows).schema), ["site", "variable", "rule"], processor(jobs.Cooldown, step_ms=1000), SENT, "0 seconds")
        query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
        states = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        left.append((max(states), states[-1]))
    assert left[0][0] >= 40 and left[-1][1] <= 4, left  # a value and its timer for each of the newest keys


def quiet(moments, gap):
    out, last, at = {}, None, sorted(set(moments))
    while at:
        if last is None or (at[0] >= last + gap):
            last = at[0]
        else:
            last += gap
        told = [x for x in at if x <= last]
        out.update(dict.fromkeys(told, last))
        at = at[len(told):]
    return out


def test_quiet_time_holds_and_lets_out(spark):
    moments = [1, 2, 2, 4, 5, 6, 20, 30, 31, 34, 35, 60]
    rows = [(f"s{i}", "v", "m", at) for i, at in enumerate(moments)]
    beat = items(spark, [("heartbeat", "none", "none", 10_000)])
    schema = f"{ITEMS}, sent_at bigint"
    for cuts in ([0, 12], [0, 3, 5, 8, 12], [0, 1, 2, 3, 4, 5, 6, 7, 12]):
        parts = [items(spark, rows[a:b]) for a, b in itertools.pairwise(cuts)]
        got = jobs.replay([*parts, beat], lambda part: jobs.stateful(part, ["rule"], jobs.QuietTime(), schema, "2 seconds")).where("rule = 'm'").collect()
        assert sorted((r["site"], r["sent_at"]) for r in got) == sorted((r[0], quiet(moments, 4)[r[3]]) for r in rows)


def test_problems_clear_by_a_timer(spark):
    seen = [1, 6, 25, 41, 42, 91, 115, 140]
    rows = [("a", "v", "r", at) for at in seen]
    schema = "site string, variable string, first_at bigint, last_at bigint, sightings bigint, cleared_at bigint"
    beat = items(spark, [("heartbeat", "none", "none", 10_000)])
    for cuts in ([0, 8], [0, 2, 5, 8]):
        parts = [items(spark, rows[a:b]) for a, b in itertools.pairwise(cuts)]
        run = lambda part: jobs.stateful(part, ["site", "variable"], processor(jobs.Problems, step_ms=1000), schema, "1 second")
        got = sorted(tuple(r)[2:] for r in jobs.replay([*parts, beat], run).where("site = 'a'").collect())
        assert got == [(1, 42, 5, 66), (91, 115, 2, 139), (140, 140, 1, 164)]
