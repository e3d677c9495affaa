"""Binning of measurements into descriptor values, and vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def taint_bin(edges: Column) -> Column:
    """zero, short (1-2), medium (3-5) or long; null stays null and a negative count is an error."""
    return (
        F.when(edges < 0, F.raise_error(F.lit("taint length must not be negative")).cast("string"))
        .when(edges == 0, "zero")
        .when(edges <= 2, "short")
        .when(edges <= 5, "medium")
        .when(edges > 5, "long")
    )


def size_tier(nloc: Column, ccn: Column) -> Column:
    """large from 100 lines or complexity 12 on, small below 30 lines and complexity 5, else medium."""
    return F.when(nloc.isNull() | ccn.isNull(), F.lit(None)).when((nloc >= 100) | (ccn >= 12), "large").when((nloc < 30) & (ccn < 5), "small").otherwise("medium")


def flow_class(kinds: Column) -> Column:
    """linear without controlling structures, nested with two or more, else the structure's kind (unknown: error)."""
    kind = F.get(kinds, F.lit(0))
    return (
        F.when(F.size(kinds) == 0, "linear")
        .when(F.size(kinds) >= 2, "nested")
        .when(kind.isin("conditional", "loop", "exception"), kind)
        .otherwise(F.raise_error(F.concat(F.lit("unknown control structure "), kind)).cast("string"))
    )


def structure_kind(node: Column) -> Column:
    """The kind of a control structure's syntax node; null if it controls nothing."""
    return F.when(node.isin("IF", "SWITCH", "ELSE"), "conditional").when(node.isin("FOR", "WHILE", "DO"), "loop").when(node == "CATCH", "exception")


def guarded(predicates: Column) -> Column:
    """guarded if any predicate refers to the source."""
    return F.when(F.exists(predicates, lambda p: p["refs_source"]), "guarded").otherwise("unguarded")


def compressed_path(statements: Column) -> Column:
    """A path of statements without immediate repeats."""
    return F.filter(statements, lambda x, i: (i == 0) | (x != F.get(statements, i - 1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b) + F.lit(1e-12))


def chosen_arguments(arguments: Column, indexes: Column) -> Column:
    """The arguments at the 1-based indexes; all of them if there are none."""
    return F.when(F.size(indexes) == 0, arguments).otherwise(F.filter(arguments, lambda x, i: F.array_contains(indexes, i + 1)))


def unit_vector(a: Column) -> Column:
    """The vector scaled to length one."""
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + F.lit(1e-12)))


def mean_pool(vectors: Column, most: int = 512) -> Column:
    """The mean of the first token vectors, scaled to length one."""
    first = F.slice(vectors, 1, most)
    zero = F.transform(F.get(first, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(first, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return unit_vector(total)
