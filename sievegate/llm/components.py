"""Connected components of a link table by hooking, pointer jumping and contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store


def roots(pointers: DataFrame, store: Store, name: str) -> DataFrame:
    """``pointers`` has one row (node, parent) a node, with parent < node; gives (node, component), component being the end of the way."""
    step, now = 0, store.put(f"{name}-jump0", pointers.select("node", "parent", F.lit(True).alias("moved")))
    while True:
        step += 1
        further = now.select(F.col("node").alias("parent"), F.col("parent").alias("further"))
        jumped = now.join(further, "parent", "left").select("node", F.coalesce("further", "parent").alias("parent"), F.col("further").isNotNull().alias("moved"))
        before, now = now, store.put(f"{name}-jump{step}", jumped)
        moved = now.agg(F.max("moved")).first()[0]
        store.drop(f"{name}-jump{step - 1}")
        if not moved:
            return now.select("node", F.col("parent").alias("component"))


def connected_components(links: DataFrame, store: Store, name: str) -> DataFrame:
    """``links`` has the long columns a and b; gives (node, component) for each node in a link that is not itself the smallest of its component.

    Each round hooks every node to its smallest neighbour if that is smaller,
    jumps along the pointers to their ends, and contracts the links to links
    between ends. Only grouped minima and joins with one row a node are used, so
    no task holds a component, and the hot end of a star is a key that a join
    may split. Nulls must not occur; loops and repeated links are allowed.
    """
    pairs = lambda df, x, y: df.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges = store.put(f"{name}-0", pairs(links, F.col("a"), F.col("b")))
    found, step = None, 0
    while not edges.isEmpty():
        step += 1
        up = roots(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent")), store, f"{name}-{step}")
        of = lambda c: up.select(F.col("node").alias(c), F.col("component").alias(f"{c}_end"))  # noqa: B023, E731
        mapped = edges.join(of("u"), "u").join(of("v"), "v", "left")  # each u has a pointer
        before, edges = edges, store.put(f"{name}-{step}", pairs(mapped, F.col("u_end"), F.coalesce("v_end", "v")))
        if found is not None:
            later = up.select(F.col("node").alias("component"), F.col("component").alias("end"))
            up = found.join(later, "component", "left").select("node", F.coalesce("end", "component").alias("component")).unionByName(up)
        found = store.put(f"{name}-found{step}", up)
        store.drop(f"{name}-{step - 1}", f"{name}-found{step - 1}")
    return found if found is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
