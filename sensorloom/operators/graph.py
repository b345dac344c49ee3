"""Flow graphs with at most one downstream per node: closure, checks, weights, diffusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sensorloom.session import checkpoint


def closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Every (src, dst) pair joined by a downstream path, with hops and the edge weights' product.

    Pointer doubling: round k extends the paths of exactly 2**k hops by every known path, so the
    number of joins is the logarithm of the longest chain. Each round is checkpointed. Edges must be
    free of cycles (see ``cyclic``).
    """
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    known = edges.select("src", "dst", F.lit(1).alias("hops"), weight.alias("weight"))
    for k in range(max_rounds + 1):
        if k == max_rounds:
            raise ValueError(f"paths still grow after {max_rounds} doublings: the edges have a cycle")
        known = checkpoint(known)
        ends = known.where(F.col("hops") == 2**k).select(
            "src", F.col("dst").alias("mid"), F.col("hops").alias("h"), F.col("weight").alias("w")
        )
        if ends.isEmpty():
            break
        onward = known.select(F.col("src").alias("mid"), "dst", "hops", "weight")
        longer = ends.join(onward, "mid").select(
            "src", "dst", (F.col("h") + F.col("hops")).alias("hops"), (F.col("w") * F.col("weight")).alias("weight")
        )
        known = known.unionByName(longer)
    return known


def cyclic(edges: DataFrame, nodes: int) -> DataFrame:
    """Nodes whose way downstream never ends: still moving after more hops than there are nodes."""
    jump = edges.where("src <> dst").select("src", "dst")
    rounds = max(1, nodes.bit_length())
    for k in range(rounds):
        onward = jump.select(F.col("src").alias("dst"), F.col("dst").alias("_next"))
        jump = jump.join(onward, "dst").select("src", F.col("_next").alias("dst"))
        if k % 4 == 3:
            jump = checkpoint(jump)
            if jump.isEmpty():
                break
    return jump.select("src").distinct()


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, problem) rows: dangling target, self loop, no way to an outlet."""
    names = nodes.select(F.col("node").alias("dst"))
    dangling = edges.join(names, "dst", "left_anti").select(F.col("src").alias("node"), F.lit("dangling target").alias("problem"))
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.lit("self loop").alias("problem"))
    stuck = cyclic(edges, nodes.count()).select(F.col("src").alias("node"), F.lit("never reaches an outlet").alias("problem"))
    return dangling.unionByName(loops).unionByName(stuck)


def inflow_weights(edges: DataFrame) -> DataFrame:
    """Each edge's share of its target: a node fed by several splits evenly between them."""
    fed = edges.groupBy("dst").agg((1.0 / F.count(F.lit(1))).alias("weight"))
    return edges.join(fed, "dst")


def roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node: has it a downstream, an upstream; outlet and isolated."""
    down = edges.select(F.col("src").alias("node")).distinct().withColumn("_d", F.lit(True))
    up = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("inflows"))
    out = nodes.join(down, "node", "left").join(up, "node", "left")
    flows, fed = F.col("_d").isNotNull(), F.coalesce("inflows", F.lit(0))
    return out.select(
        "node", fed.alias("inflows"), (~flows & (fed > 0)).alias("outlet"), (~flows & (fed == 0)).alias("isolated")
    )


def undirected_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of the normalised undirected graph, every node joined to itself."""
    given = edges.select("src", "dst").dropna()
    both = given.unionByName(given.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = both.unionByName(both.select("src", F.col("src").alias("dst"))).distinct()
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("_n"))
    ends = degree.select(F.col("src").alias("dst"), F.col("_n").alias("_m"))
    return both.join(degree, "src").join(ends, "dst").select("src", "dst", (1 / F.sqrt(F.col("_n") * F.col("_m"))).alias("weight"))


def _by_messages(values: DataFrame, edges: DataFrame, keys: Sequence[str], node: str, value: str, iterations: int,
                 cut: int = 4) -> DataFrame:
    """The diffusion as joins of open nodes with their edges, for networks of any size.

    What known nodes send never changes and is summed once; only open nodes send again each round. Steps with nothing missing
    take no part. Lineage is cut every ``cut`` rounds.
    """
    weights = checkpoint(undirected_weights(edges))
    rows = values.withColumn("_k", F.struct(*keys))
    open_steps = rows.where(F.col(value).isNull()).select("_k").distinct()
    known = checkpoint(
        rows.where(F.col(value).isNotNull()).join(open_steps, "_k", "left_semi")
        .groupBy("_k", F.col(node).alias("dst")).agg(F.max(value).alias("x"))
    )

    def sent(state: DataFrame) -> DataFrame:
        out = state.withColumnRenamed("dst", "src").join(weights, "src")
        return out.select("_k", "dst", (F.col("weight") * F.col("x")).alias("x"))

    def summed(messages: DataFrame) -> DataFrame:
        return messages.groupBy("_k", "dst").agg(F.sum("x").alias("x")).join(known, ["_k", "dst"], "left_anti")

    base = state = checkpoint(summed(sent(known)))
    for i in range(1, iterations):
        state = summed(sent(state).unionByName(base))
        if i % cut == 0:
            state = checkpoint(state)
    filled = known.unionByName(state).select("_k", F.col("dst").alias(node), F.col("x").alias("_x"))
    out = rows.join(filled, ["_k", node], "left").withColumn("filled", F.coalesce(F.col(value), F.col("_x"), F.lit(0.0)))
    return out.select(*values.columns, "filled")


def propagate_missing(values: DataFrame, edges: DataFrame, keys: Sequence[str], node: str, value: str,
                      iterations: int = 40, max_edges: int = 4096) -> DataFrame:
    """Missing node values by diffusion on the normalised undirected graph, known nodes held fixed.

    Up to ``max_edges`` edges one step's network is a handful of nodes, so each step is one small grouped pandas task; steps
    with nothing missing never enter it. Larger networks go round by round as joins of open nodes with their edges, with the
    same result. A node without edges has nobody to borrow from and reads 0, as diffusion leaves it. A node given
    twice in a step counts with its larger value.
    """
    import numpy as np
    import pandas as pd

    known_edges = edges.select("src", "dst").dropna().limit(max_edges + 1).collect()
    if len(known_edges) > max_edges:
        return _by_messages(values, edges, keys, node, value, iterations)
    names = sorted({n for r in known_edges for n in (r.src, r.dst)})
    place = {n: i for i, n in enumerate(names)}
    adjacency = np.eye(len(names))
    for r in known_edges:
        adjacency[place[r.src], place[r.dst]] = adjacency[place[r.dst], place[r.src]] = 1.0
    half = 1.0 / np.sqrt(adjacency.sum(axis=1))
    spread = half[:, None] * adjacency * half[None, :]

    boxed = values.withColumn("_k", F.struct(*keys))  # a box of nulls equals itself
    state = boxed.groupBy("_k").agg(F.count(value).alias("_known"), F.count(F.lit(1)).alias("_all"))
    marked = boxed.join(state, "_k")
    whole = marked.where("_known = _all").select(*values.columns, F.col(value).alias("filled"))
    rest = marked.where("_known < _all").select(*values.columns)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        linked = pdf[node].isin(place)
        alone, pdf = pdf[~linked], pdf[linked]
        at = pdf[node].map(place).to_numpy(dtype=int)
        x = np.zeros(len(names))
        held = np.zeros(len(names), dtype=bool)
        real = pdf[value].notna().to_numpy()
        held[at[real]] = True
        x[at[real]] = -np.inf
        np.maximum.at(x, at[real], pdf[value].to_numpy(dtype=float)[real])
        known = x.copy()
        for _ in range(iterations):
            x = np.where(held, known, spread @ x)
        own = pdf[value].to_numpy(dtype=float)
        return pd.concat([pdf.assign(filled=np.where(real, own, x[at])), alone.assign(filled=alone[value].fillna(0.0))])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rest.schema]
    return whole.unionByName(
        rest.groupBy(*keys).applyInPandas(fill, ", ".join([*fields, "filled double"]))
    )
