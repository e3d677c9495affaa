"""Flow records reduced per candidate: the shortest path, its controlling structures, names that are global."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import bins


def flow_mode(dealloc_calls: Column, acquire_calls: Column) -> Column:
    """How a family's flows run: from a deallocation, from an acquisition, or from any source."""
    return F.when(F.size(dealloc_calls) > 0, "use_after_free").when(F.size(acquire_calls) > 0, "leak").otherwise("standard")


def with_edges(flows: DataFrame, path: str = "path") -> DataFrame:
    """``flows`` with the path without immediate repeats and its number of edges."""
    short = bins.compressed_path(F.col(path))
    return flows.withColumn(path, short).withColumn("edges", F.size(short) - 1)


def shortest(flows: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Per candidate the flow with the fewest edges, then the first sink line; a use after free needs an edge.

    ``flows``: the key, mode, edges, sink_line, flow_id. A partial aggregate, however many flows a candidate has.
    """
    usable = flows.where((F.col("mode") != "use_after_free") | (F.col("edges") > 0))
    order = F.struct("edges", "sink_line", "flow_id")
    return usable.groupBy(key).agg(F.min(order).alias("_f"), F.count("*").alias("flows")).select(key, "_f.*", "flows")


def structures(nodes: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Per candidate its distinct controlling structures by line: array of struct(line, node, kind).

    ``nodes``: the key, node, label, line, seq. Of a node's records the first counts; labels that control nothing go.
    """
    kind = bins.structure_kind(F.col("label"))
    first = nodes.withColumn("kind", kind).where("kind is not null").groupBy(key, "node").agg(F.min_by(F.struct("line", "node", "kind"), F.struct("seq", "line", "kind")).alias("s"))
    return first.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("structures"))


def global_names(used: Column, local: Column, parameters: Column) -> Column:
    """The names in use that are neither local nor parameters."""
    return F.array_except(F.array_except(used, local), parameters)
