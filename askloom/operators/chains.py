"""Chains followed in logarithmic rounds: every round doubles the length of the jumps (pointer doubling).

A chain is given by pointers from one node to the next. Walking it takes as many steps as it is long; jumping takes a join a round, and as many
rounds as the length has binary digits. A round shuffles on node ids, which spread evenly, and is kept as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.session import staged


def reached(roots: DataFrame, jumps: DataFrame) -> tuple[DataFrame, int]:
    """``node`` of the roots and all that follows them by ``jumps`` (node, to; one row a node, never back), and the rounds taken."""
    found, rounds = staged(roots.select("node").distinct(), "reached"), 0
    jumps = staged(jumps.select("node", "to").filter("to IS NOT NULL"), "jumps")
    while True:
        # What has been found reaches 2 ** rounds nodes from a root, and a jump is as far.
        new = staged(found.join(jumps, "node").select(F.col("to").alias("node")).distinct().join(found, "node", "left_anti"), "reached")
        rounds += 1
        if new.isEmpty():
            return found, rounds
        found = found.unionByName(new)  # tables of all rounds, which are few
        further = jumps.withColumnRenamed("node", "at").withColumnRenamed("to", "node")
        jumps = staged(further.join(jumps, "node").select(F.col("at").alias("node"), "to"), "jumps")


def _doubled(state: DataFrame) -> DataFrame:
    """The state with jumps twice as far.

    ``before`` is the node ``steps`` back, NULL once the head has been passed; then ``reach`` is the head. ``least`` is the least node passed.
    """
    back = state.select(F.col("node").alias("before"), F.struct(F.col("before"), "steps", "reach", "least").alias("b"))
    far = state.filter("before IS NOT NULL").join(back, "before")
    jumped = far.select("node", "b.before", (F.col("steps") + F.col("b.steps")).alias("steps"), "b.reach", F.least("least", "b.least").alias("least"))
    return state.filter("before IS NULL").unionByName(jumped)


def _ranked(before: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The state of all nodes of ``before`` (node, before) after the last round, and the rounds; nodes on circles still have a ``before``."""
    step = F.when(F.col("before").isNull(), 0).otherwise(1).cast("long")
    first = before.select("node", "before", step.alias("steps"), F.coalesce("before", "node").alias("reach"), F.least("node", "before").alias("least"))
    state = staged(first, label)
    rounds, open_ = 0, state.filter("before IS NOT NULL").count()
    while open_:
        state = staged(_doubled(state), label)
        rounds += 1
        # Chains have nodes at every distance, so a round that ends none has only circles left.
        left = state.filter("before IS NOT NULL").count()
        if left == open_:
            break
        open_ = left
    return state, rounds


def chain_order(links: DataFrame) -> tuple[DataFrame, int]:
    """``node, head, rank`` of every node of ``links`` (node, to), and the rounds taken. Ranks count from 1 at the head.

    Of several links from a node the least ``to`` holds, of several to a node the least ``node``, so nodes form chains and circles; the head
    of a circle is its least node. A link to itself or to or from NULL is none.
    """
    usable = links.select("node", "to").filter("node IS NOT NULL AND to IS NOT NULL AND node <> to")
    nodes = links.select("node").unionByName(links.select(F.col("to").alias("node"))).filter("node IS NOT NULL").distinct()
    one = usable.groupBy("node").agg(F.min("to").alias("to"))
    into = one.groupBy("to").agg(F.min("node").alias("before")).withColumnRenamed("to", "node")
    before = staged(nodes.join(into, "node", "left"), "chain-links")
    state, rounds = _ranked(before, "chain-ranks")
    circle = staged(state.filter("before IS NOT NULL"), "chain-circles")
    size = circle.count()
    if size:
        # Every node of a circle learns its least node; the circle opens before that node.
        done = 1 << rounds
        while done < size:
            circle, done, rounds = staged(_doubled(circle), "chain-circles"), 2 * done, rounds + 1
        heads = circle.filter("node = least").select("node")
        opened = heads.select("node", F.lit(True).alias("opens"))
        before = before.join(opened, "node", "left").select("node", F.when(F.col("opens").isNull(), F.col("before")).alias("before"))
        before = staged(before, "chain-links")
        state, more = _ranked(before, "chain-ranks")
        rounds += more
    return state.select("node", F.col("reach").alias("head"), (F.col("steps") + 1).alias("rank")), rounds
