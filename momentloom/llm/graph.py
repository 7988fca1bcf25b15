"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentloom.session import stage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable id for every id that has an edge to another: columns id, component.

    ``edges`` has integer columns a and b. Each round every vertex points to that neighbour, or
    itself, which is first in an order drawn anew; the pointers are followed four steps, both ends of
    each edge are replaced by what they lead to, and loops and repeated edges go. So the table shrinks
    by more than half in a round, for chains and stars alike, and later rounds cost little. The rounds'
    pointers are put together backwards. Nothing but whether edges are left reaches the driver.
    """
    links = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not links.isEmpty():
        if len(maps) == rounds:
            raise ValueError(f"components have not settled after {rounds} rounds")
        drawn = _drawn(len(maps))
        both = links.union(links.select("b", "a"))
        up = F.least(drawn(F.col("id")), F.min(drawn(F.col("b"))))["id"]
        near = stage(both.groupBy(F.col("a").alias("id")).agg(up.alias("up")), "pointers")
        for _ in range(2):
            near = _through(near, near)
        maps.append(stage(near, "pointers"))
        for end in ("a", "b"):
            to = maps[-1].select(F.col("id").alias(end), F.col("up").alias(f"_{end}"))
            links = links.join(to, end).drop(end).withColumnRenamed(f"_{end}", end)
        links = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    if not maps:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    reached = maps.pop()
    while maps:
        reached = _through(maps.pop(), reached)
    reached = stage(reached, "reached")
    least = reached.groupBy("up").agg(F.min("id").alias("component"))
    return reached.join(least, "up").select("id", "component")


def _drawn(turn: int):
    """A vertex with its place in the order of a round before it."""
    return lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("at"), c.alias("id"))


def _through(first: DataFrame, then: DataFrame) -> DataFrame:
    """Where ``first`` leads, and on by ``then`` from there if it goes on."""
    ahead = then.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
    on: Column = F.coalesce("_up", "up")
    return first.join(ahead, first.up == ahead._id, "left").select("id", on.alias("up"))
