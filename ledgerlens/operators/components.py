"""Connected components and minimum spanning forests as rounds of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordered import attach, hash_salt
from ledgerlens.settings import settle


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(node)`` and ``edges(a, b)`` to ``(node, label)``, label the smallest node.

    Every round hooks each component to its smallest neighbour, jumps pointers and
    contracts the edges, which shrink geometrically.  Neighbours combine before the
    shuffle and labels come back through salted joins, so a hub is never one task.
    """
    both = edges.where(F.col("a") != F.col("b"))
    live = settle(
        both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "cc-edges",
    )
    label = nodes.select("node", F.col("node").alias("label")).distinct()
    while not live.isEmpty():
        hook = live.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up"))
        # Two jumps flatten most of the chains that hooking makes.
        for _ in range(2):
            above = hook.select(F.col("a").alias("up"), F.col("up").alias("top"))
            hook = hook.join(above, "up", "left").select("a", F.coalesce("top", "up").alias("up"))
        hook = settle(hook, "cc-hooks")
        # Written every round: a salted join reads its input twice, so a plan that was
        # carried along instead would double with each round.
        label = settle(
            attach(label, hook.select(F.col("a").alias("label"), "up"), ["label"], hash_salt("node")).select(
                "node", F.coalesce("up", "label").alias("label")
            ),
            "cc-labels",
        )
        left = attach(live, hook, ["a"], hash_salt("b")).select(F.coalesce("up", "a").alias("a"), "b")
        right_up = hook.select(F.col("a").alias("b"), F.col("up").alias("other"))
        moved = attach(left, right_up, ["b"], hash_salt("a")).select("a", F.coalesce("other", "b").alias("b"))
        live = settle(moved.where(F.col("a") != F.col("b")).distinct(), "cc-edges")
    return label


def spanning_forest(edges: DataFrame, weight: list[str], key: str) -> DataFrame:
    """Keys of the minimum spanning forest of ``edges(key, a, b, *weight)``.

    Weights are distinct, so the forest is what adding edges in weight order and
    skipping those that close a cycle would give.
    """
    live = edges.where(F.col("a") != F.col("b")).select(key, "a", "b", *weight)
    chosen: list[DataFrame] = []
    live = settle(live, "msf-edges")
    while not live.isEmpty():
        ends = live.unionByName(live.withColumns({"a": F.col("b"), "b": F.col("a")}))
        best = ends.groupBy("a").agg(
            F.min_by(F.struct("a", "b", key), F.struct(*weight)).alias("e")
        ).select("e.*")
        picked = settle(best.dropDuplicates([key]), "msf-picked")
        chosen.append(picked.select(key))
        nodes = picked.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        labels = connected_components(nodes, picked)
        at = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        moved = live.join(at("a"), "a", "left").join(at("b"), "b", "left").select(
            key, F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"), *weight
        )
        live = settle(moved.where(F.col("a") != F.col("b")), "msf-edges")
    if not chosen:
        return live.select(key)
    return reduce(DataFrame.unionByName, chosen).distinct()
