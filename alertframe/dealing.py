"""Dealing rows out to tasks by what they will cost, where neither their bytes nor their splits tell."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of stored input a task, tasks a core at least and at most, and from where on a size stands for "not known".
PART, FEWEST, MOST, UNKNOWN = 1 << 20, 4, 200, 1 << 60


def parts(df: DataFrame) -> int:
    """How many tasks df's rows are worth, by the stored tables that it reads: a join's or a text's own estimate may be
    off by orders of magnitude."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return min(MOST * cores, max(FEWEST * cores, sum(s for s in sizes if s < UNKNOWN) // PART))


def dealt(df: DataFrame) -> bool:
    """Whether df's tasks are those of a repartition, with nothing after it that has tasks of its own."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.children().size() == 1 and node.nodeName() in ("Project", "Filter", "Generate"):
        node = node.children().apply(0)
    if node.nodeName() in ("Aggregate", "Window"):  # by the same key: no exchange of their own
        while node.children().size() == 1 and node.nodeName() in ("Project", "Filter", "Aggregate", "Window"):
            node = node.children().apply(0)
        return node.nodeName() == "RepartitionByExpression"
    return node.nodeName() in ("Repartition", "RepartitionByExpression")


def deal(df: DataFrame, *key: str) -> DataFrame:
    """df evenly in as many tasks as it is worth, rows of equal keys in one; as it is if it was dealt out before."""
    return df.repartition(parts(df), *key) if key or not dealt(df) else df
