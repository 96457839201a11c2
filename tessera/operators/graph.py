"""Graph operators over edge tables: simple graphs, balls, snapshots, weights, PageRank, components."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import decay, overlaps
from ..sources.stages import written

#: Rows that are broadcast to edges and other large tables.
FEW = 1_000_000


def simple(edges: DataFrame, source: str = "src", target: str = "dst", position: str = "pos") -> DataFrame:
    """Undirected simple graph (lo, hi, and the other columns): of parallel edges the last by position stays."""
    others = [c for c in edges.columns if c not in (source, target)]
    low, high = F.least(source, target).alias("lo"), F.greatest(source, target).alias("hi")
    last = F.max_by(F.struct(*others), F.col(position)).alias("_e")
    return edges.groupBy(low, high).agg(last).select("lo", "hi", "_e.*")


def induced_simple(edges: DataFrame, members: DataFrame, position: str = "pos") -> DataFrame:
    """Pairs (question_id, lo, hi, ...) of the simple graph of edges (src, dst, position, ...) within each question's members: parallel edges meet there alone, not in the whole graph."""
    inside = induced(edges.withColumnsRenamed({"src": "lo", "dst": "hi"}), members)
    others = [c for c in edges.columns if c not in ("src", "dst")]
    low, high = F.least("lo", "hi").alias("_lo"), F.greatest("lo", "hi").alias("_hi")
    last = inside.groupBy("question_id", low, high).agg(F.max_by(F.struct(*others), F.col(position)).alias("_e"))
    return last.select("question_id", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "_e.*")


def arcs(pairs: DataFrame, *columns: str) -> DataFrame:
    """Both directions of undirected pairs (lo, hi): src, dst and the columns named."""
    keep = [c for c in ("question_id",) if c in pairs.columns]
    one = pairs.select(*keep, F.col("lo").alias("src"), F.col("hi").alias("dst"), *columns)
    return one.union(pairs.select(*keep, F.col("hi").alias("src"), F.col("lo").alias("dst"), *columns))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, degree: parallel edges count each, a loop twice; nodes without edges have 0."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
    count = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(count, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def layer_counts(**layers: DataFrame) -> DataFrame:
    """One row: the rows of each layer, by name."""
    parts = [df.agg(F.count(F.lit(1)).alias(name), F.lit(0).alias("_k")) for name, df in layers.items()]
    return reduce(lambda a, b: a.join(b, "_k"), parts).drop("_k")


def top_degrees(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """The k nodes of highest degree, ties by node."""
    return degrees(nodes, edges).orderBy(F.desc("degree"), "node").limit(k)


def appearances(nodes: DataFrame, bridge: DataFrame, place: str = "passage") -> DataFrame:
    """nodes (node), bridge (node and a place): node, n, in how many distinct places it appears; 0 for nodes that do not."""
    count = bridge.groupBy("node").agg(F.count_distinct(place).alias("n"))
    return nodes.join(count, "node", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def appearance_report(counts: DataFrame, k: int = 5) -> DataFrame:
    """counts (node, n): one row with the least, mean and most, and the k first nodes by count (ties by node) in order."""
    best = counts.orderBy(F.desc("n"), "node").limit(k).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "node", "n"))).alias("top"), F.lit(0).alias("_k"))
    total = counts.agg(F.min("n").alias("least"), F.avg("n").alias("mean"), F.max("n").alias("most"), F.lit(0).alias("_k"))
    return total.join(best, "_k").select("least", "mean", "most", F.transform("top", lambda x: F.struct(x["node"], x["n"])).alias("top"))


def counted(rows: DataFrame, name: str = "nodes", most: int | None = None) -> DataFrame:
    """rows, written and counted; up to `most` (FEW) are broadcast where they are joined, so that the large side is not shuffled."""
    rows = written(rows, name)
    return F.broadcast(rows) if rows.count() <= (FEW if most is None else most) else rows


def of_known(rows: DataFrame, members: DataFrame, *columns: str, node: str = "node") -> DataFrame:
    """rows whose columns all are some member's node: found where rows are read, if the distinct nodes are few."""
    known = counted(members.select(F.col(node).alias("_known")).distinct())
    for c in columns:
        rows = rows.join(known.withColumnRenamed("_known", c), c, "left_semi")
    return rows


def ball(pairs: DataFrame, seeds: DataFrame, radius: int = 1) -> DataFrame:
    """(question_id, node) within `radius` steps of the question's seeds (question_id, node)."""
    both = arcs(pairs.select("lo", "hi"))
    reached = seeds.select("question_id", "node").distinct()
    front = reached
    for _ in range(radius):
        front = counted(front, "front")
        front = front.join(both, F.col("node") == F.col("src")).select("question_id", F.col("dst").alias("node"))
        reached = reached.union(front).distinct()
        front = reached
    return reached


def induced(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs whose two ends are members (question_id, node) of the same question. Pairs with an end that is no question's leave first."""
    pairs = of_known(pairs, members, "lo", "hi")
    low = members.select("question_id", F.col("node").alias("lo"))
    high = members.select("question_id", F.col("node").alias("hi"))
    return pairs.join(low, "lo").join(high, ["question_id", "hi"])


def time_filter(rows: DataFrame, keys: list[str], start: str, end: str, q_start, q_end, strict: bool = True) -> DataFrame:
    """Rows whose period overlaps the query's; a question (of `keys`; without any the table is one) for which none would stay keeps all.

    Whether a question has a valid row is one value a question, made by partial sums; no question's rows come together.
    """
    if not strict:
        return rows
    valid = written(rows.withColumn("_valid", overlaps(start, end, q_start, q_end)), "timed")
    some = valid.groupBy(*keys).agg(F.max("_valid").alias("_some"))
    out = valid.join(some, keys) if keys else valid.withColumn("_k", F.lit(0)).join(F.broadcast(some.withColumn("_k", F.lit(0))), "_k").drop("_k")
    return out.where(F.col("_valid") | ~F.col("_some")).drop("_valid", "_some")


def edge_weight(start, end, year, semantic: Column | None = None, alpha: float = 0.5, sigma: float = 5.0) -> Column:
    """alpha * time + (1 - alpha) * meaning; an edge without meaning counts 0.5 there."""
    meaning = F.lit(0.5) if semantic is None or alpha >= 1 else F.greatest(F.lit(0.0), F.least(F.lit(1.0), semantic))
    return alpha * decay(start, end, year, sigma) + (1 - alpha) * meaning


def ppr(arc_rows: DataFrame, nodes: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 100, cut_every: int = 5, tolerance: float = 1e-6, isolated: DataFrame | None = None) -> DataFrame:
    """Personalised PageRank of any size, by joins: (question_id, node, score).

    arc_rows (question_id, src, dst, w) in both directions, nodes and seeds (question_id, node). Restart is uniform
    on the seeds; a node without arcs gives its mass to the seeds. Sums are partial before each exchange. Every `cut_every`
    rounds the state is written, and the rounds end where the last one moved less than nodes times `tolerance` in every question.
    A question without seeds has constant scores of 1. isolated (question_id, n): nodes without arcs that are counted but not listed; their mass goes to the seeds in the first round.
    """
    arc_rows = arc_rows.where("w > 0")
    out = arc_rows.groupBy("question_id", "src").agg(F.sum("w").alias("_t"))
    steps = written(arc_rows.join(out, ["question_id", "src"]).select("question_id", "src", "dst", (F.col("w") / F.col("_t")).alias("p")), "ppr-steps")
    counted = nodes.groupBy("question_id").agg(F.count(F.lit(1)).alias("_n"), F.lit(0).cast("long").alias("_apart"))
    if isolated is not None:
        counted = counted.drop("_apart").join(isolated.select("question_id", F.col("n").alias("_apart")), "question_id", "left").withColumn("_apart", F.coalesce("_apart", F.lit(0)))
    own = seeds.select("question_id", "node").distinct().join(nodes, ["question_id", "node"], "left_semi")
    share = own.groupBy("question_id").agg((1.0 / F.count(F.lit(1))).alias("_s"))
    base = nodes.join(own.withColumn("_seed", F.lit(1)), ["question_id", "node"], "left").join(share, "question_id", "left").join(counted, "question_id")
    base = base.join(out.select("question_id", F.col("src").alias("node"), F.lit(1).alias("_out")), ["question_id", "node"], "left")
    base = base.select("question_id", "node", F.when(F.col("_seed") == 1, F.col("_s")).otherwise(0.0).alias("p0"), F.col("_s").isNull().alias("none"), F.col("_out").isNull().alias("dangling"), (1.0 / (F.col("_n") + F.col("_apart"))).alias("x"), F.lit(1.0).alias("moved"), F.col("_apart").alias("apart"))
    state = written(base, "ppr")
    for k in range(iterations):
        flow = steps.join(state.select("question_id", F.col("node").alias("src"), "x"), ["question_id", "src"]).groupBy("question_id", F.col("dst").alias("node")).agg(F.sum(F.col("x") * F.col("p")).alias("_in"))
        lost = state.groupBy("question_id").agg((F.sum(F.when(F.col("dangling"), F.col("x")).otherwise(0.0)) + (F.max(F.col("apart") * F.col("x")) if k == 0 else 0.0)).alias("_lost"))
        new = damping * (F.coalesce("_in", F.lit(0.0)) + F.col("_lost") * F.col("p0")) + (1 - damping) * F.col("p0")
        joined = state.withColumnRenamed("x", "_x").join(flow, ["question_id", "node"], "left").join(lost, "question_id")
        state = joined.select("question_id", "node", "p0", "none", "dangling", new.alias("x"), F.abs(new - F.col("_x")).alias("moved"), "apart")
        if (k + 1) % cut_every == 0 and k + 1 < iterations:
            state = written(state, "ppr")
            far = state.where("NOT none").groupBy("question_id").agg((F.sum("moved") >= tolerance * (F.count(F.lit(1)) + F.max("apart"))).alias("_far")).where("_far")
            if tolerance > 0 and far.isEmpty():
                break
    return state.select("question_id", "node", F.when(F.col("none"), 1.0).otherwise(F.col("x")).alias("score"))


def ppr_grouped(arc_rows: DataFrame, nodes: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6, isolated: DataFrame | None = None) -> DataFrame:
    """The same for questions whose subgraphs are small: each question's is one pandas group, iterated until a round moves less than nodes times `tolerance`.

    isolated (question_id, n): nodes without arcs that are counted but not listed; their score is 0 after the first round.
    """
    rows = arc_rows.select("question_id", "src", "dst", F.col("w").cast("double").alias("w"))
    rows = rows.unionByName(nodes.select("question_id", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("w")))
    rows = rows.unionByName(seeds.select("question_id", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(1.0).alias("w")))

    if isolated is not None:
        rows = rows.unionByName(isolated.select("question_id", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("n").cast("double").alias("w")))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        more = g.w[g.src.isna()].sum()
        g = g[~g.src.isna()]
        flat = g[g.dst.isna()]
        names = pd.Index(flat.src[flat.w == 0].unique())
        n = len(names)
        seed = np.unique(names.get_indexer(flat.src[flat.w == 1]))
        seed = seed[seed >= 0]
        if not n or not len(seed):
            return pd.DataFrame({"question_id": [g.question_id.iloc[0] if n else 0] * n, "node": names, "score": np.ones(n)})
        e = g[~g.dst.isna() & (g.w > 0)]
        a, b, w = names.get_indexer(e.src), names.get_indexer(e.dst), e.w.to_numpy()
        keep = (a >= 0) & (b >= 0)
        a, b, w = a[keep], b[keep], w[keep]
        total = np.bincount(a, w, n)
        step = w / total[a]
        p = np.zeros(n)
        p[seed] = 1 / len(seed)
        x, dangling = np.full(n, 1 / (n + more)), total == 0
        apart = more / (n + more)  # mass of the isolated nodes, which goes to the seeds in the first round
        for _ in range(iterations):
            new = damping * (np.bincount(b, x[a] * step, n) + (x[dangling].sum() + apart) * p) + (1 - damping) * p
            done = np.abs(new - x).sum() + apart < (n + more) * tolerance
            x, apart = new, 0.0
            if done:
                break
        return pd.DataFrame({"question_id": [g.question_id.iloc[0]] * n, "node": names, "score": x})

    kind = nodes.schema["question_id"].dataType.simpleString()
    return rows.groupBy("question_id").applyInPandas(run, f"question_id {kind}, node string, score double")


def augmented(pairs: DataFrame, bridge: DataFrame, weight: Column | float = 1.0) -> DataFrame:
    """Arcs of an entity graph (question_id, lo, hi, w) and of its links to passages (question_id, node, passage, ...)."""
    weight = F.lit(weight) if isinstance(weight, float) else weight
    links = bridge.select("question_id", F.col("node").alias("lo"), F.col("passage").alias("hi"), weight.alias("w"))
    return arcs(pairs.select("question_id", "lo", "hi", "w").unionByName(links), "w")


def _forest(batches):
    """Union-find over the rows (u, v) of one task: node and least node of its component."""
    root: dict = {}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b in batches:
        for x, y in zip(b["u"].tolist(), b["v"].tolist()):
            x, y = top(root.setdefault(x, x)), top(root.setdefault(y, y))
            if x != y:
                root[max(x, y)] = min(x, y)
    if root:
        yield pd.DataFrame({"node": list(root), "component": [top(x) for x in root]})


def components(edges: DataFrame, few: int = 1_000_000, most_rounds: int = 60) -> DataFrame:
    """edges (a, b): (node, component), the least node reachable.

    Up to `few` distinct edges (counted) are joined by union-find in one task, more by alternating large and small stars.
    """
    now, before = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars"), None
    if now.count() <= few:
        kind = now.schema["u"].dataType.simpleString()
        return written(now.coalesce(1).mapInPandas(_forest, f"node {kind}, component {kind}"), "stars")
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").where("v <> m").union(least.select("u", "m")).toDF("u", "v").distinct()
        now = written(small, "stars")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before = state
    raise RuntimeError(f"no fixed point within {most_rounds} rounds")
