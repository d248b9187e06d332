"""Connector arrows as edges, and their aggregation to relations between clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.functions.text import present, trimmed


def connector_edges(nodes: DataFrame) -> DataFrame:
    """Connectors attached at both ends; the label is the trimmed text or null."""
    both = present(F.col("connector_start_id")).isNotNull() & present(F.col("connector_end_id")).isNotNull()
    return nodes.where((F.col("type") == "CONNECTOR") & both).select("board_id", "ord", F.col("id").alias("connector_id"), F.col("connector_start_id").alias("from_node_id"), F.col("connector_end_id").alias("to_node_id"), trimmed(F.col("text")).alias("label"))


def node_owner(clusters: DataFrame, *, last: bool = True) -> DataFrame:
    """(board_id, node_id, cluster_id); of several clusters that hold a node the last (or first) one."""
    rows = clusters.select("board_id", "cluster_ord", "cluster_id", F.explode("node_ids").alias("node_id"))
    pick = F.max_by if last else F.min_by
    return rows.groupBy("board_id", "node_id").agg(pick("cluster_id", "cluster_ord").alias("cluster_id"))


def cluster_relations(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges between different clusters by (from, to): count and labels in order of first sight.

    ``first_ord`` orders relations that tie in their count. Labels are counted
    per (pair, label) before a pair's labels meet, so a busy pair is few rows.
    """
    owner = node_owner(clusters)
    start = owner.select("board_id", F.col("node_id").alias("from_node_id"), F.col("cluster_id").alias("from_cluster_id"))
    end = owner.select("board_id", F.col("node_id").alias("to_node_id"), F.col("cluster_id").alias("to_cluster_id"))
    met = edges.join(start, ["board_id", "from_node_id"]).join(end, ["board_id", "to_node_id"]).where("from_cluster_id <> to_cluster_id")
    pair = ["board_id", "from_cluster_id", "to_cluster_id"]
    by_label = met.groupBy(*pair, "label").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    seen = F.collect_list(F.when(present(F.col("label")).isNotNull(), F.struct("first", "label")))
    return by_label.groupBy(*pair).agg(F.transform(F.array_sort(seen), lambda s: s["label"]).alias("labels"), F.sum("n").cast("int").alias("edge_count"), F.min("first").alias("first_ord"))


def relation_labels(relations: DataFrame, clusters: DataFrame) -> DataFrame:
    """Relations both of whose clusters are given, with the clusters' labels."""
    label = lambda side: clusters.select("board_id", F.col("cluster_id").alias(f"{side}_cluster_id"), F.col("label").alias(f"{side}_label"))
    return relations.join(label("from"), ["board_id", "from_cluster_id"]).join(label("to"), ["board_id", "to_cluster_id"])


def relation_lines(relations: DataFrame, clusters: DataFrame) -> DataFrame:
    """One text line per labelled relation, with the order to show them in (``edge_count`` desc, ``first_ord``)."""
    named = relation_labels(relations, clusters)
    quoted = F.array_join(F.transform("labels", lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", ")
    line = F.concat(
        F.lit('- "'), F.col("from_label"), F.lit('" → "'), F.col("to_label"), F.lit('"'),
        F.when(F.size("labels") > 0, F.concat(F.lit(" — "), quoted)).otherwise(""),
        F.when(F.col("edge_count") > 1, F.concat(F.lit(" ("), F.col("edge_count").cast("string"), F.lit(" connectors)"))).otherwise(""),
    )
    return named.withColumn("line", line)


def one_hop(primaries: DataFrame, relations: DataFrame) -> DataFrame:
    """(board_id, cluster_id) next to a primary, in either direction, and no primary itself."""
    on = ["board_id", "cluster_id"]
    out = relations.select("board_id", F.col("from_cluster_id").alias("cluster_id"), F.col("to_cluster_id").alias("next"))
    back = relations.select("board_id", F.col("to_cluster_id").alias("cluster_id"), F.col("from_cluster_id").alias("next"))
    near = out.union(back).join(primaries.select(*on).distinct(), on, "left_semi").select("board_id", F.col("next").alias("cluster_id")).distinct()
    return near.join(primaries.select(*on).distinct(), on, "left_anti")
