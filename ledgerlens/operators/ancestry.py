"""Failing commands and their failing ancestors (J1), by pointer doubling.

A jump table says of every execution where 2^k steps up lead, and which marked execution
is met first on the way.  Composing a table with itself doubles the steps, so a tree of
any depth takes as many rounds as its depth has binary digits.  A way that has not ended
after as many steps as its session has executions goes in a circle.

Chains of failing ancestors are jump tables again, over failing executions only.  In every
join one side has one narrow row per execution; where many executions have one parent, the
other side is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.settings import settle

KEY = ["session_id", "node"]
#: Single steps that are composed in one plan before tables are doubled.
FIRST_STEPS = 8


def _onward(table: DataFrame, more: DataFrame) -> DataFrame:
    """Ways of ``table`` followed by those of ``more``; a way that ended stays as it is.

    Ended ways meet nothing, and are spread by their nodes.
    """
    then = more.select(
        "session_id", F.col("node").alias("at"), F.lit(True).alias("moves"), F.col("up").alias("up2"), F.col("near").alias("near2")
    )
    ways = table.withColumns({"at": F.coalesce("up", "node"), "moves": F.col("up").isNotNull()})
    return ways.join(then, ["session_id", "at", "moves"], "left").select(
        *KEY, F.col("up2").alias("up"), F.coalesce("near", "near2").alias("near")
    )


def _jumps(edges: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges as written, and ``session_id, node, near, endless`` of every node with an edge up.

    ``edges``: session_id, node, up; ``marked``: session_id, node.  ``near`` is the first
    marked node above (the node itself, where its circle leads back to it).
    """
    hits = marked.select("session_id", F.col("node").alias("up"), F.lit(True).alias("hit"))
    first = settle(edges.join(hits, ["session_id", "up"], "left").select(
        *KEY, "up", F.when(F.col("hit"), F.col("up")).alias("near")
    ), "ancestry-edges")
    table = first
    for _ in range(FIRST_STEPS - 1):
        table = _onward(table, first)
    table, steps, most = settle(table, "ancestry-jumps"), FIRST_STEPS, None
    while not table.where(F.col("up").isNotNull()).isEmpty():
        most = most or first.groupBy("session_id").count().agg(F.max("count")).first()[0]
        if steps > most:
            break
        table, steps = settle(_onward(table, table), "ancestry-jumps"), 2 * steps
    return first, table.select(*KEY, "near", F.col("up").isNotNull().alias("endless"))


def _first_met(walks: DataFrame, marked: DataFrame, jumps: DataFrame) -> DataFrame:
    """Adds ``first``, the first marked node from ``start`` on, ``start`` included, and ``endless``."""
    at = marked.select(*KEY, F.lit(True).alias("hit")).join(jumps, KEY, "full").select(
        "session_id", F.col("node").alias("start"), F.when(F.col("hit"), F.col("node")).otherwise(F.col("near")).alias("first"),
        F.coalesce("endless", F.lit(False)).alias("endless"),
    )
    return walks.join(at, ["session_id", "start"], "left")


def _all_met(walks: DataFrame, jumps: DataFrame) -> DataFrame:
    """``session_id, seq, ancestor``: every marked node on the way of ``first``, that one included.

    In each round the nodes found so far are followed by twice as many steps along marked
    nodes; a circle has been seen whole after as many steps as there are nodes.
    """
    chain = jumps.where(F.col("near").isNotNull() & (F.col("near") != F.col("node"))).select(*KEY, F.col("near").alias("next"))
    met = walks.where(F.col("first").isNotNull()).select("session_id", "seq", F.col("first").alias("ancestor"))
    most = chain.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0
    steps, count = 1, None
    while steps <= most:
        onward = chain.select("session_id", F.col("node").alias("ancestor"), "next")
        found = met.join(onward, ["session_id", "ancestor"]).select("session_id", "seq", F.col("next").alias("ancestor"))
        met = settle(met.unionByName(found).distinct(), "ancestry-met")
        before, count, steps = count, met.count(), 2 * steps
        if count == before:
            break
        after = chain.select("session_id", F.col("node").alias("next"), F.col("next").alias("after"))
        chain = settle(chain.join(after, ["session_id", "next"]).select(*KEY, F.col("after").alias("next")), "ancestry-chain")
        if chain.isEmpty():
            break
    return met


class Ancestry:
    """The failing ancestors of reported failures.

    ``failures``: session_id, seq, exec_id, parent_exec_id; one row per reported failure.
    ``exits``: all readable exits, whose latest row per exec_id gives its parent.
    """

    def __init__(self, failures: DataFrame, exits: DataFrame) -> None:
        known = exits.where(F.col("exec_id").isNotNull() & F.col("parent_exec_id").isNotNull())
        failures = settle(failures.select("session_id", "seq", "exec_id", "parent_exec_id"), "ancestry-failures")
        parents = known.groupBy("session_id", F.col("exec_id").alias("node")).agg(F.max_by("parent_exec_id", "seq").alias("up"))
        self.failing = failures.where(F.col("exec_id").isNotNull()).select("session_id", F.col("exec_id").alias("node")).distinct()
        self.edges, jumps = _jumps(parents, self.failing)
        walks = failures.where(F.col("parent_exec_id").isNotNull()).select(
            "session_id", "seq", F.col("exec_id").alias("self"), F.col("parent_exec_id").alias("start")
        )
        self.walks = settle(_first_met(walks, self.failing, jumps).where(F.col("first").isNotNull()), "ancestry-walks")
        # From one failing execution to the next failing one above it.
        self.chain = settle(
            jumps.join(self.failing, KEY, "left_semi").where(F.col("near").isNotNull()).select(*KEY, F.col("near").alias("up")),
            "ancestry-failing-chain",
        )

    def subsumed(self) -> DataFrame:
        """``session_id, seq`` of failures beneath a failing ancestor whose whole way up ends.

        A way that closes on itself is no evidence.  That is known of the executions; a failure
        whose own parent is another than that of its execution may still lead back to itself.
        """
        ended = self.walks.where(~F.col("endless"))
        own = self.edges.select("session_id", F.col("node").alias("self"), F.col("up").alias("own_parent"))
        odd = ended.join(own, ["session_id", "self"]).where(F.col("own_parent") != F.col("start")).drop("own_parent")
        if not odd.isEmpty():
            met = _all_met(odd, self.chain.withColumnRenamed("up", "near"))
            back = met.join(odd.select("session_id", "seq", F.col("self").alias("ancestor")), ["session_id", "seq", "ancestor"])
            ended = ended.join(back, ["session_id", "seq"], "left_anti")
        return ended.select("session_id", "seq")

    def beneath(self, reported: DataFrame) -> DataFrame:
        """``session_id, seq, ancestor``: the failures beneath each of the executions ``session_id, node``."""
        if self.walks.isEmpty():
            return self.walks.select("session_id", "seq", F.col("start").alias("ancestor"))
        # Reported failures above another one are few, as long as ways end: the jumps find them at once.
        reported = settle(reported, "ancestry-reported")
        _, jumps = _jumps(self.chain, reported)
        walks = self.walks.select("session_id", "seq", "self", F.col("first").alias("start"))
        met = _all_met(_first_met(walks, reported, jumps), jumps.join(reported, KEY, "left_semi"))
        itself = self.walks.select("session_id", "seq", F.col("self").alias("ancestor"))
        return met.join(itself, ["session_id", "seq", "ancestor"], "left_anti")

    def descends(self) -> DataFrame:
        """``session_id, seq, ancestor``: every failing execution above a failure."""
        return self.beneath(self.failing)
