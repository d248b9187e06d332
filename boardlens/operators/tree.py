"""Flattening node trees of many boards, level by level, and pruning empty structure.

A tree is walked by levels, one join or one array explosion each, so depth costs
rounds and breadth costs nothing but rows; levels are written to the shared
folder. ``path`` is the position of every ancestor's child: ordering by it is
the pre-order of a recursive walk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardlens.functions.text import present, trimmed
from boardlens.sources.scratch import materialise

# Containers without content of their own, and the type whose children are not visited.
STRUCTURAL = ("DOCUMENT", "CANVAS", "PAGE", "FRAME", "GROUP", "SECTION")
ATOMIC = "TABLE"


def own_content(text, image_ref):
    return trimmed(text).isNotNull() | present(image_ref).isNotNull()


def flatten_levels(nodes: DataFrame, *, max_depth: int = 200) -> DataFrame:
    """Adjacency rows (board_id, id, parent_id, pos, type, ...) with ``path`` and ``ancestors``.

    Roots are rows without a parent. Children of a TABLE and rows that no root
    reaches are dropped; a cycle ends with an error at ``max_depth``.
    """
    level = nodes.where(F.col("parent_id").isNull()).withColumns({"path": F.array(F.col("pos").cast("int")), "ancestors": F.array("id")})
    levels = []
    for _ in range(max_depth):
        level = materialise(level, "tree-level")
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, levels) if levels else level
        levels.append(level)
        up = level.where(F.col("type") != ATOMIC).select("board_id", F.col("id").alias("parent_id"), F.col("path").alias("_up"), F.col("ancestors").alias("_over"))
        level = nodes.join(up, ["board_id", "parent_id"]).select(*nodes.columns, F.concat("_up", F.array(F.col("pos").cast("int"))).alias("path"), F.concat("_over", F.array("id")).alias("ancestors"))
    raise ValueError("the tree is deeper than max_depth, or has a cycle")


def prune(flat: DataFrame) -> DataFrame:
    """Keep what is no bare structure, and every ancestor of such a node."""
    content = flat.where(~F.col("type").isin(*STRUCTURAL) | own_content(F.col("text"), F.col("image_ref")))
    kept = content.select("board_id", F.explode("ancestors").alias("id")).distinct()
    return flat.join(kept, ["board_id", "id"], "left_semi")


def flatten_documents(docs: DataFrame, *, doc: str = "doc", max_depth: int = 200) -> DataFrame:
    """Normalised nodes of raw documents (board_id, VARIANT ``doc``): pruned, in pre-order ``ord``, root not emitted."""
    first = docs.withColumn("root", F.expr(f"try_variant_get({doc}, '$.document', 'variant')"))
    wrong = first.where(F.col("root").isNull() | F.expr("try_variant_get(root, '$.id', 'string') IS NULL OR try_variant_get(root, '$.type', 'string') IS NULL"))
    if wrong.limit(1).count():
        raise ValueError("a document without a root node")

    def get(path: str, kind: str, of: str = "v") -> str:
        return f"try_variant_get({of}, '$.{path}', '{kind}')"

    def fields(level: DataFrame) -> DataFrame:
        fills = F.expr(get("fills", "array<variant>"))
        image = F.expr("get(filter(transform(fills, f -> struct(try_variant_get(f, '$.type', 'string') AS t, try_variant_get(f, '$.imageRef', 'string') AS r)), f -> f.t = 'IMAGE' AND f.r <> ''), 0).r")
        number = lambda p: F.coalesce(F.expr(get(p, "double")), F.lit(0.0))
        out = level.withColumn("fills", fills).select(
            "*",
            F.expr(get("id", "string")).alias("id"),
            F.expr(get("name", "string")).alias("name"),
            F.expr(get("type", "string")).alias("type"),
            *[number(f"absoluteBoundingBox.{c}").alias(c) for c in ("x", "y", "width", "height")],
            number("rotation").alias("rotation"),
            image.alias("image_ref"),
            F.expr(get("characters", "string")).alias("text"),
            F.expr(get("connectorStart.endpointNodeId", "string")).alias("connector_start_id"),
            F.expr(get("connectorEnd.endpointNodeId", "string")).alias("connector_end_id"),
        )
        return out.where("id IS NOT NULL AND name IS NOT NULL AND type IS NOT NULL").withColumn("ancestors", F.concat("over", F.array("id")))

    children = lambda df, v: df.withColumn("kids", F.expr(f"try_variant_get({v}, '$.children', 'array<variant>')"))
    top = children(first, "root").select("board_id", F.expr("try_variant_get(root, '$.id', 'string')").alias("parent_id"), F.array().cast("array<int>").alias("up"), F.array().cast("array<string>").alias("over"), F.posexplode("kids").alias("pos", "v"))
    levels, level = [], top
    for _ in range(max_depth):
        level = materialise(fields(level).withColumn("path", F.concat("up", F.array("pos"))), "tree-level")
        if not level.limit(1).count():
            break
        levels.append(level)
        deeper = children(level.where(F.col("type") != ATOMIC), "v")
        level = deeper.select("board_id", F.col("id").alias("parent_id"), F.col("path").alias("up"), F.col("ancestors").alias("over"), F.posexplode("kids").alias("pos", "v"))
    else:
        raise ValueError("the tree is deeper than max_depth")
    columns = ["board_id", "id", "name", "type", "x", "y", "width", "height", "rotation", "image_ref", "text", "parent_id", "connector_start_id", "connector_end_id", "path", "ancestors"]
    flat = reduce(DataFrame.unionByName, [x.select(*columns) for x in levels]) if levels else level.select(*columns)
    order = Window.partitionBy("board_id").orderBy("path")
    kept = prune(flat).withColumn("ord", F.row_number().over(order).cast("long") - 1)
    return kept.select("board_id", "ord", *columns[1:-2])


def clusterable_leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent, no connector, and have a size."""
    parents = nodes.where(F.col("parent_id").isNotNull()).select("board_id", F.col("parent_id").alias("id")).distinct()
    own = nodes.where((F.col("type") != "CONNECTOR") & ((F.col("width") > 0) | (F.col("height") > 0)))
    return own.join(parents, ["board_id", "id"], "left_anti")


def content_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that a diff looks at."""
    return nodes.where(~F.col("type").isin(*STRUCTURAL, "CONNECTOR"))
