"""Connected components of a graph given as pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from ledgerline.storage import materialize

UNSETTLED = 4  # pointers are followed until at most one node in so many is not below a root


def connected_components(
    pairs: DataFrame,
    a: str = "a",
    b: str = "b",
    block: Sequence[str] = (),
    on_round: Callable[[int], None] | None = None,
) -> DataFrame:
    """Smallest node of the component of each paired node: (block, node, component).

    Every round points each node at its smallest neighbour (or itself), follows the pointers until most nodes are
    below a root, and replaces both ends of every edge by where they point; edges inside one node go.
    What is left is a smaller graph of the same components, about a third of a shuffled chain, and a sorted chain is done
    in one round. Pointers never lead to a larger node, so the smallest node of a component stays. The loop ends
    when no edge is left; then the pointers of all rounds are followed once, from the last to the first.
    Each round's pointers and edges are tables in the shared folder, so all rounds together write and shuffle a small multiple
    of the first. Hubs: minima are combined map side; the joins are inner or left and may be split.
    """
    block = list(block)
    edges = materialize(pairs.select(*block, F.col(a).alias("_a"), F.col(b).alias("_b")).filter("_a is not null and _b is not null"))
    rounds: list[DataFrame] = []
    while not rounds or not edges.isEmpty():
        if on_round:
            on_round(len(rounds) + 1)
        both = edges.select(*block, F.col("_a").alias("node"), F.col("_b").alias("other"))
        both = both.unionByName(edges.select(*block, F.col("_b").alias("node"), F.col("_a").alias("other")))
        pointers = both.groupBy(*block, "node").agg(F.least(F.col("node"), F.min("other")).alias("parent"))
        settled = False
        while not settled:
            pointers = materialize(_follow(pointers, block))
            nodes, moving = pointers.agg(F.count("*"), F.count_if("moving")).first()
            pointers, settled = pointers.drop("moving"), moving * UNSETTLED <= nodes
        rounds.append(pointers)
        for end in ("_a", "_b"):
            to = pointers.select(*block, F.col("node").alias(end), F.col("parent").alias("_to"))
            edges = edges.join(to, [*block, end]).drop(end).withColumnRenamed("_to", end)
        kept = edges.filter(F.col("_a") != F.col("_b"))
        edges = materialize(kept.select(*block, F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct())
    found = rounds.pop().withColumnRenamed("parent", "component")
    while rounds:
        above = found.select(*block, F.col("node").alias("parent"), "component")
        found = rounds.pop().join(above, [*block, "parent"], "left")
        found = found.select(*block, "node", F.coalesce("component", "parent").alias("component"))
    return materialize(found)


def _follow(pointers: DataFrame, block: list[str]) -> DataFrame:
    """Every pointer leads to where its target points; ``moving`` marks those whose target was not a root."""
    up = pointers.select(*block, F.col("node").alias("parent"), F.col("parent").alias("_up"))
    moving = (F.col("_up") != F.col("parent")).alias("moving")
    return pointers.join(up, [*block, "parent"]).select(*block, "node", F.col("_up").alias("parent"), moving)
