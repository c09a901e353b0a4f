"""Connected components of a link table, as Spark joins and groupings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lapwise.llm.scratch import written


def forest(n: int, left: np.ndarray, right: np.ndarray, cost: np.ndarray | None = None) -> np.ndarray:
    """Indices of links that join the same nodes as all links do, at most n - 1 of them; the cheapest by cost.

    Boruvka rounds: each tree takes its cheapest outgoing link (ties by index), then the trees are merged.
    """
    tree = np.arange(n)
    order = np.arange(len(left)) if cost is None else np.argsort(cost, kind="stable")
    a, b, at = left[order], right[order], order
    chosen: list[np.ndarray] = []
    while len(a):
        ta, tb = tree[a], tree[b]
        open_ = ta != tb
        a, b, at, ta, tb = a[open_], b[open_], at[open_], ta[open_], tb[open_]
        if not len(a):
            break
        best = np.full(n, len(a))
        np.minimum.at(best, ta, np.arange(len(a)))
        np.minimum.at(best, tb, np.arange(len(a)))
        picked = np.unique(best[best < len(a)])
        chosen.append(at[picked])
        low, high = np.minimum(ta[picked], tb[picked]), np.maximum(ta[picked], tb[picked])
        while True:  # hook the picked links' trees together by smallest root
            root = np.arange(n)
            np.minimum.at(root, high, low)
            while (deeper := root[root]).tolist() != root.tolist():
                root = deeper
            tree = root[tree]
            low, high = root[low], root[high]
            apart = low != high
            if not apart.any():
                break
            low, high = np.minimum(low[apart], high[apart]), np.maximum(low[apart], high[apart])
    return np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)


def components(links: DataFrame, *, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """node and component (the smallest node reachable) for every node of links.

    Alternating large-star and small-star rounds: each round is two groupings by node with the minimum taken before the
    shuffle, and two joins that Spark may split where a star is large. The link table of each round is written to the
    shared folder. Rows with a null end are left out; self-links and repeats do no harm.
    """
    ends = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    edges = written(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("centre"), F.least("a", "least").alias("low"))
        large = both.where("b > a").join(low, F.col("a") == F.col("centre")).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        large = large.distinct()
        large = written(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "centre")
        joined = large.join(low, F.col("a") == F.col("centre"))
        small = joined.select(F.col("a"), F.col("low").alias("b")).unionByName(joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))).distinct()
        edges = written(small, "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = nodes.join(edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low")), F.col("node") == F.col("n"), "left")
    return found.select("node", F.coalesce("low", "node").alias("component"))
