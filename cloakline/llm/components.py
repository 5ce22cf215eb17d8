"""Connected components of a graph whose links no machine holds.

In each round every node hooks onto its smallest neighbour, chains of hooks
are shortened by pointer jumping until all nodes point at a root, and the links
are rewritten between roots. Links within a component vanish, so few rounds
remain; a remainder of bounded size is finished by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakline.llm.common import written


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of the component of each of n nodes, by links a to b."""
    p = np.arange(n)
    while len(a):
        x, y = p[a], p[b]
        live = x != y
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(p, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(q := p[p], p):
            p = q
    return p


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) of the graph of links a to b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    p = roots(len(nodes), at[: len(a)], at[len(a) :])
    own = p != np.arange(len(nodes))
    return nodes[own], nodes[p[own]]


def _forest_table(table: pa.Table) -> pa.Table:
    x, y = forest(table.column("a").to_numpy(), table.column("b").to_numpy())
    return pa.table({"node": pa.array(x, pa.int64()), "root": pa.array(y, pa.int64())})


def components(links: DataFrame, finish: int = 15_000) -> DataFrame:
    """(node, root) for each node of links (a, b), longs, that isn't itself the smallest of its component."""
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = None
    while True:
        links = written(links.distinct(), "links")
        n = links.count()
        if n <= finish:
            if n:
                last = written(links.groupBy(F.lit("all").alias("every")).applyInArrow(_forest_table, "node long, root long"), "roots")
                found = last if found is None else _through(found, last)
            break
        hooks = written(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = written(hooks.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("node", "root")
            if not jumped.where("moved").limit(1).count():
                break
        found = hooks if found is None else _through(found, hooks)
        for c in "ab":
            to = hooks.select(F.col("node").alias(c), F.col("root").alias("to"))
            links = links.join(to, c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found


def _through(found: DataFrame, later: DataFrame) -> DataFrame:
    """Nodes that point at the roots of an earlier round point at those of the later one."""
    up = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
    moved = found.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return written(moved.unionByName(later), "roots")
