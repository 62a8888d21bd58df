"""Connected components of graphs whose edges are rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.session import cut_lineage, stored

CROWD = 100_000  # edges of one key that a task walks through


def connected(edges: DataFrame, keys: list[str], crowd: int = CROWD) -> DataFrame:
    """keys, node, root: every node of `edges(keys, u, v)` with the least node of its component.

    Nodes of different keys are never connected; nodes may be of any type that has an order.  Keys with at
    most `crowd` edges are walked through, each in one task, after a single shuffle; the edges of larger ones
    are spread, and their components found by stars.
    """
    edges = stored(edges.select(*keys, "u", "v"), "edges")
    whole = F.lit(True)
    for name in (*keys, "u", "v"):
        whole = whole & F.col(name).isNotNull()
    crowded = cut_lineage(edges.where(whole).groupBy(*keys).count().where(F.col("count") > crowd).select(*keys))
    none_crowded = crowded.isEmpty()
    few = edges.where(whole) if none_crowded else edges.where(whole).join(crowded, keys, "left_anti")
    found, rest = _walked(few, keys), edges.where(~whole)
    if not none_crowded:
        rest = rest.unionByName(edges.where(whole).join(crowded, keys, "left_semi"))
    elif rest.isEmpty():
        return found
    return found.unionByName(_by_stars(rest, keys))


def _walked(edges: DataFrame, keys: list[str]) -> DataFrame:
    """`connected` by union-find.  Edges come in order of their lesser node, so the least node of a component
    is the first that is seen of it."""
    fields = edges.select(*keys, F.col("u").alias("node"), F.col("u").alias("root")).dtypes
    schema = ", ".join(f"`{name}` {kind}" for name, kind in fields)
    ordered = (
        edges.select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .repartition(*keys)
        .sortWithinPartitions(*keys, "u", "v")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, parent = None, {}, []  # nodes of the group, numbered as they are seen
        rows: list[tuple] = []

        def end() -> None:
            names = list(number)
            rows.extend((*group, name, names[_root(parent, i)]) for i, name in enumerate(names))

        def out(kinds: list[pa.DataType]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            made = [_column(values, kind) for values, kind in zip(columns, kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names=[*keys, "node", "root"])

        kinds = None
        for batch in batches:
            kinds = batch.schema.types
            for *own, u, v in zip(*map(_values, batch.columns), strict=True):
                if own != group:
                    if group is not None:
                        end()
                    group, number, parent = own, {}, []
                for node in (u, v):
                    if node not in number:
                        number[node] = len(parent)
                        parent.append(len(parent))
                a, b = _root(parent, number[u]), _root(parent, number[v])
                parent[max(a, b)] = min(a, b)
            yield out(kinds)
        if group is not None:
            end()
            yield out(kinds)

    return ordered.mapInArrow(run, schema)


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = i = parent[parent[i]]
    return i


def _values(column: pa.Array) -> list:
    """Values that can be keys: structs become tuples."""
    if pa.types.is_struct(column.type):
        return list(zip(*map(_values, column.flatten()), strict=True))
    return column.to_pylist()


def _column(values: Sequence, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_struct(kind):
        return pa.array(values, kind)
    parts = list(zip(*values, strict=True)) if values else [()] * kind.num_fields
    made = [_column(part, kind.field(i).type) for i, part in enumerate(parts)]
    return pa.StructArray.from_arrays(made, fields=list(kind.fields))


def _by_stars(edges: DataFrame, keys: list[str]) -> DataFrame:
    """`connected` for edges that are many.

    Large and small stars alternate: in a large star, a node hands its greater neighbours to the least one it
    knows; in a small star, its lesser neighbours and itself.  Edges never become more than they
    were, and the number of rounds grows with the logarithm of the longest path.  Least neighbours are folded in the
    map tasks, so a hub's neighbours are not gathered in one place.
    """
    pairs = edges.select(*keys, F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
    nodes = edges.select(*keys, F.col("u").alias("node")).union(edges.select(*keys, F.col("v")))
    nodes = cut_lineage(nodes.distinct())
    stars, last = cut_lineage(pairs.where(F.col("node") != F.col("root")).distinct()), None
    while True:
        mark = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64(*keys, "node", "root"))).first())
        if mark == last:
            break
        last = mark
        stars = cut_lineage(_small_stars(_large_stars(stars, keys), keys))
    found = nodes.join(stars, [*keys, "node"], "left")
    return found.select(*keys, "node", F.coalesce("root", "node").alias("root"))


def _large_stars(stars: DataFrame, keys: list[str]) -> DataFrame:
    turned = stars.select(*keys, F.col("root").alias("node"), F.col("node").alias("root"))
    both = stars.union(turned).withColumnRenamed("root", "other")
    least = both.groupBy(*keys, "node").agg(F.min("other").alias("least"))
    return (
        both.join(least.withColumn("least", F.least("least", "node")), [*keys, "node"])
        .where(F.col("other") > F.col("node"))
        .select(*keys, F.col("other").alias("node"), F.col("least").alias("root"))
        .distinct()
    )


def _small_stars(stars: DataFrame, keys: list[str]) -> DataFrame:
    least = stars.groupBy(*keys, "node").agg(F.min("root").alias("least"))
    lesser = stars.join(least, [*keys, "node"]).where(F.col("root") != F.col("least"))
    handed = lesser.select(*keys, F.col("root").alias("node"), F.col("least").alias("root"))
    return handed.union(least.select(*keys, "node", F.col("least").alias("root"))).distinct()
