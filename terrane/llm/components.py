"""Connected components of an edge table by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise


def _roots(hooks: DataFrame) -> tuple[DataFrame, int]:
    """The forest ``(id, to)`` with every ``to`` replaced by its tree's root, and the joins that took.

    Each join doubles the distance that a vertex sees, so a path of n vertices takes about log2(n) of them.
    """
    joins = 0
    while True:
        up = hooks.toDF("to", "above")
        jumped = materialise(hooks.join(up, "to").select("id", F.col("above").alias("to"), (F.col("above") != F.col("to")).alias("moved")), "hooks")
        joins += 1
        hooks = jumped.select("id", "to")
        if jumped.where("moved").isEmpty():
            return hooks, joins


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: list[int] | None = None) -> DataFrame:
    """``(id, label)`` for every id of an edge; label is the smallest id reachable.

    Each round hooks every vertex to the smallest of itself and its neighbours, which makes a forest; pointers are then
    jumped to the roots and the edges contracted along them. A tree holds at least two vertices that still have edges,
    so a round at least halves these, whatever the shape of a component; joins grow with the logarithm's square at
    worst, and a path takes one round. All state is tables in the shared folder; nothing is collected. Null ends and
    loops are ignored; an empty edge table has no rows. ``rounds`` gets the number of joins of each round.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct()
    e = materialise(e, "edges")
    label = None
    while not e.isEmpty():
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "hooks")
        roots, joins = _roots(hooks)
        if rounds is not None:
            rounds.append(joins)
        at_a, at_b = roots.toDF("a", "to_a"), roots.toDF("b", "to_b")
        e = materialise(e.join(at_a, "a").join(at_b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct(), "edges")
        if label is None:
            label = roots.toDF("id", "label")
        else:
            label = label.join(roots.toDF("label", "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
            label = materialise(label, "labels")
    return spark.createDataFrame([], "id long, label long") if label is None else label
