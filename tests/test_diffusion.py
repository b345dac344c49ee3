"""Filling of missing nodes: the joined form against the form in one task and against a plain loop."""

import numpy as np
import pytest

from sensorloom.operators import graph

SCHEMA = "variable string, step bigint, site string, value double"
EDGES = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("e", "c"), ("f", "f"), (None, "a")]


def rows_of(seed=4):
    rng = np.random.default_rng(seed)
    rows = [
        (v, s, n, None if rng.random() < 0.5 else round(float(rng.normal()), 2))
        for v in ("x", None) for s in range(6) for n in "abcdefz" if rng.random() < 0.8
    ]
    return [*rows, ("x", 1, "a", 9.0), ("x", 1, "a", None), ("y", 0, "b", None), (None, None, "a", 2.0), (None, None, "b", None)]


def by_loop(rows, rounds):
    nodes = sorted({n for e in EDGES if None not in e for n in e})
    near = {n: {n} for n in nodes}
    for a, b in EDGES:
        if a and b:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for key in {r[:2] for r in rows}:
        known = {}
        for r in rows:
            if r[:2] == key and r[3] is not None:
                known[r[2]] = max(r[3], known.get(r[2], -np.inf))
        x = {n: known.get(n, 0.0) for n in nodes}
        for _ in range(rounds):
            x = {n: known.get(n, sum(x[m] / np.sqrt(len(near[n]) * len(near[m])) for m in near[n])) for n in nodes}
        out[key] = x | known
    return out


@pytest.mark.parametrize("most, rounds", [(4096, 40), (0, 40), (0, 1), (4096, 1)])
def test_both_forms_equal_a_plain_loop(spark, most, rounds):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    got = graph.propagate_missing(df, edges, ["variable", "step"], "site", "value", rounds, most)
    assert got.columns == [*df.columns, "filled"]
    told, want = got.collect(), by_loop(rows, rounds)
    assert len(told) == len(rows)
    for r in told:
        own = r.value if r.value is not None else want[(r.variable, r.step)].get(r.site, 0.0)
        assert r.filled == pytest.approx(own), r


@pytest.mark.parametrize("most", [4096, 0])
def test_no_rows_and_nothing_missing(spark, most):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    whole = spark.createDataFrame([("x", 1, "a", 1.0), ("x", 1, "b", 2.0)], SCHEMA)
    fill = lambda df: graph.propagate_missing(df, edges, ["variable", "step"], "site", "value", 5, most).collect()
    assert fill(whole.where("false")) == []
    assert {(r.site, r.filled) for r in fill(whole)} == {("a", 1.0), ("b", 2.0)}
