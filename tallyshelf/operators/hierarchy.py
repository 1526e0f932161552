"""Trees of (node, parent) by doubling: each round joins ancestors with themselves, so
that a tree of depth d takes about log2(d) rounds, whatever its width.

Rounds are tables in the shared folder.  The side that is joined by node has one row a
node and is broadcast only where it is small; the other may hold a node that is the
ancestor of a third of all rows, in the form that AQE splits.  Repeated rows count
once.  Nodes on a cycle raise ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.scratch import broadcast_if_small, stage


def _broken(rows: DataFrame) -> ValueError:
    """The error for rows whose ancestors never end."""
    some = sorted(str(r.node) for r in rows.select("node").distinct().limit(5).collect())
    return ValueError(f"on or below a cycle: {', '.join(some)}")


def ancestors_by_doubling(nodes: DataFrame) -> list[DataFrame]:
    """Staged (node, up): the ancestor 1, 2, 4, ... steps above, as far as there is one."""
    now = stage(nodes.select("node", F.col("parent").alias("up")).filter("node is not null and up is not null").distinct(), "ancestors")
    most, steps = now.count(), []
    while not now.isEmpty():
        if 1 << len(steps) > most:  # more steps than there are links
            raise _broken(now)
        steps.append(now)
        next_up = broadcast_if_small(now).select(F.col("node").alias("_node"), F.col("up").alias("_up"))
        now = stage(now.join(next_up, F.col("up") == F.col("_node")).select("node", F.col("_up").alias("up")), "ancestors")
    return steps


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of all nodes, themselves at 0 included.

    Parents that are no nodes count as ancestors.  With ancestors of 2^k steps, all
    pairs below 2^k steps become those below 2^(k+1); each pair is made once.
    """
    own = nodes.select("node").filter("node is not null").distinct()
    pairs = own.select(F.col("node").alias("ancestor"), F.col("node").alias("descendant"), F.lit(0).alias("distance"))
    for k, step in enumerate(ancestors_by_doubling(nodes)):
        up = broadcast_if_small(step)
        above = pairs.join(up, F.col("ancestor") == F.col("node")).select(F.col("up").alias("ancestor"), "descendant", (F.col("distance") + (1 << k)).alias("distance"))
        pairs = pairs.union(stage(above, "closure"))
    return pairs


def rooted(nodes: DataFrame, **joined: tuple[Column, str]) -> DataFrame:
    """(node, root, level) of every node that hangs on a root, a node without parent.
    Each further name gets a column: the texts of (column, separator) from the root
    down to the node.  Nodes below a parent that is no node are left out."""
    columns = [F.col("parent").alias("up"), F.col("node").alias("root"), F.lit(0).alias("level"), *(c.alias(name) for name, (c, _) in joined.items())]
    now = stage(nodes.filter("node is not null").select("node", *columns).distinct(), "rooted")
    most, rounds = now.count(), 0
    while not now.filter("up is not null").isEmpty():
        if 1 << rounds > 2 * most:
            raise _broken(now.filter("up is not null"))
        above = broadcast_if_small(now).select(*(F.col(c).alias(f"_{c}") for c in now.columns))
        texts = [F.concat(F.col(f"_{name}"), F.lit(by), F.col(name)).alias(name) for name, (_, by) in joined.items()]
        met = now.filter("up is not null").join(above, F.col("up") == F.col("_node"))
        met = met.select("node", F.col("_up").alias("up"), F.col("_root").alias("root"), (F.col("level") + F.col("_level") + 1).alias("level"), *texts)
        now, rounds = stage(now.filter("up is null").union(met), "rooted"), rounds + 1
    return now.drop("up")


def breadcrumbs(nodes: DataFrame, by: str = " > ") -> DataFrame:
    """R2: (node, level, path): names from the root to each node of (node, parent, name)."""
    return rooted(nodes, path=(F.col("name"), by)).select("node", "level", "path")


def subtree(nodes: DataFrame, start: Column) -> DataFrame:
    """(node, level) of the nodes for which ``start`` holds, at level 0, and of all
    below the nearest of them; the links above them are cut, so no more than the
    depth below counts."""
    at = F.coalesce(start, F.lit(False))
    cut = nodes.withColumn("_start", at).withColumn("parent", F.when(~F.col("_start"), F.col("parent")))
    tops = cut.filter("_start").select(F.col("node").alias("root")).distinct()
    return rooted(cut).join(broadcast_if_small(stage(tops, "subtree-tops")), "root", "left_semi").select("node", "level")
