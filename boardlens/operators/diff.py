"""What changed between two snapshots of boards: nodes, clusters, connections."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardlens.functions import text as T
from boardlens.operators import graph, refine, tree
from boardlens.sources.scratch import materialise

MIN_OVERLAP, SHOWN = 0.5, 8


def node_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(board_id, id, change): added, removed or edited content nodes; moves are no edits."""
    side = lambda df, p: tree.content_nodes(df).select("board_id", "id", F.lit(True).alias(f"{p}_in"), F.coalesce(T.utrim(F.col("text")), F.lit("")).alias(f"{p}_text"), F.col("image_ref").alias(f"{p}_image"))
    met = side(before, "b").join(side(after, "a"), ["board_id", "id"], "full_outer")
    same = (F.col("b_text") == F.col("a_text")) & F.col("b_image").eqNullSafe(F.col("a_image"))
    change = F.when(F.col("b_in").isNull(), "added").when(F.col("a_in").isNull(), "removed").when(~same, "edited")
    return met.select("board_id", "id", change.alias("change")).where("change IS NOT NULL")


def candidate_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cluster pairs sharing at least half of the smaller one's members, by an equi-join on members."""
    side = lambda df, p: df.select("board_id", F.col("cluster_id").alias(f"{p}_id"), F.col("cluster_ord").alias(f"{p}_ord"), F.size("node_ids").alias(f"{p}_size"), F.explode(F.array_distinct("node_ids")).alias("node_id"))
    keys = ["board_id", "b_id", "b_ord", "b_size", "a_id", "a_ord", "a_size"]
    pairs = side(before, "b").join(side(after, "a"), ["board_id", "node_id"]).groupBy(*keys).agg(F.count("*").alias("overlap"))
    return pairs.where(F.col("overlap") / F.least("b_size", "a_size") >= MIN_OVERLAP)


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One-to-one matches taken in order of overlap, then board order on both sides.

    A pair that is the best of both its clusters would be taken before any that
    touches them, so all such pairs of all boards are taken in one round.
    """
    left, taken = materialise(pairs, "match"), None
    order = [F.desc("overlap"), "b_ord", "a_ord"]
    while True:
        b, a = Window.partitionBy("board_id", "b_id").orderBy(*order), Window.partitionBy("board_id", "a_id").orderBy(*order)
        best = materialise(left.withColumns({"rb": F.row_number().over(b), "ra": F.row_number().over(a)}).where("rb = 1 AND ra = 1").drop("rb", "ra"), "match")
        if not best.limit(1).count():
            return taken if taken is not None else best
        taken = best if taken is None else taken.unionByName(best)
        left = materialise(left.join(best.select("board_id", "b_id"), ["board_id", "b_id"], "left_anti").join(best.select("board_id", "a_id"), ["board_id", "a_id"], "left_anti"), "match")


def cluster_changes(before: DataFrame, after: DataFrame, nodes_before: DataFrame, nodes_after: DataFrame) -> DataFrame:
    """(board_id, change, cluster_ord, label, previous_label, added, removed, edited): new, removed, modified, unchanged."""
    matched = greedy_match(candidate_pairs(before, after))
    named = lambda df, nodes, p: df.drop("content_hash").join(refine.content_hash(refine.members(df, nodes), "board_id", "cluster_id"), ["board_id", "cluster_id"], "left").select("board_id", F.col("cluster_id").alias(f"{p}_id"), F.col("label").alias(f"{p}_label"), F.col("summary").alias(f"{p}_summary"), F.col("node_ids").alias(f"{p}_nodes"), F.col("content_hash").alias(f"{p}_hash"), F.col("cluster_ord").alias(f"{p}_n"))
    b, a = named(before, nodes_before, "b"), named(after, nodes_after, "a")
    edits = node_changes(nodes_before, nodes_after).where("change = 'edited'").groupBy("board_id").agg(F.collect_set("id").alias("edits"))
    met = matched.select("board_id", "b_id", "a_id").join(b, ["board_id", "b_id"]).join(a, ["board_id", "a_id"]).join(edits, "board_id", "left")
    none = F.array().cast("array<string>")
    both = F.array_intersect("a_nodes", "b_nodes")
    count = lambda arr: F.size(arr).cast("int")
    same = F.col("a_hash").eqNullSafe(F.col("b_hash"))
    met = met.select("board_id", F.when(same, "unchanged").otherwise("modified").alias("change"), F.col("a_n").alias("cluster_ord"), F.col("a_label").alias("label"), F.col("b_label").alias("previous_label"), F.col("a_summary").alias("summary"), count(F.array_except("a_nodes", "b_nodes")).alias("added"), count(F.array_except("b_nodes", "a_nodes")).alias("removed"), count(F.array_intersect(both, F.coalesce("edits", none))).alias("edited"))
    rest = lambda df, p, change: df.join(matched.select("board_id", f"{p}_id"), ["board_id", f"{p}_id"], "left_anti").select("board_id", F.lit(change).alias("change"), F.col(f"{p}_n").alias("cluster_ord"), F.col(f"{p}_label").alias("label"), F.lit(None).cast("string").alias("previous_label"), F.col(f"{p}_summary").alias("summary"), *[F.lit(0).alias(c) for c in ("added", "removed", "edited")])
    return met.unionByName(rest(a, "a", "new")).unionByName(rest(b, "b", "removed"))


def connection_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(board_id, from_node_id, to_node_id, label, change, n, first_ord): edges as bags by (from, to, label)."""
    bag = lambda df, p: df.groupBy("board_id", "from_node_id", "to_node_id", F.coalesce("label", F.lit("")).alias("label")).agg(F.count("*").alias(f"{p}_n"), F.min("ord").alias(f"{p}_ord"))
    met = bag(before, "b").join(bag(after, "a"), ["board_id", "from_node_id", "to_node_id", "label"], "full_outer")
    more = F.coalesce("a_n", F.lit(0)) - F.coalesce("b_n", F.lit(0))
    return met.where(more != 0).select("board_id", "from_node_id", "to_node_id", "label", F.when(more > 0, "added").otherwise("removed").alias("change"), F.abs(more).alias("n"), F.coalesce("a_ord", "b_ord").alias("first_ord"))


def endpoint_labels(changes: DataFrame, clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """``changes`` with both ends named: cluster label, node text, node name, or the id."""
    owner = graph.node_owner(clusters, last=False).join(clusters.select("board_id", "cluster_id", "label"), ["board_id", "cluster_id"])
    out = changes
    for side in ("from", "to"):
        o = owner.select("board_id", F.col("node_id").alias(f"{side}_node_id"), F.col("label").alias("_label"))
        n = nodes.select("board_id", F.col("id").alias(f"{side}_node_id"), T.cut_ellipsis(T.trimmed(F.col("text")), 40).alias("_text"), T.present(F.col("name")).alias("_name"))
        out = out.join(o, ["board_id", f"{side}_node_id"], "left").join(n, ["board_id", f"{side}_node_id"], "left")
        out = out.withColumn(f"{side}_name", F.coalesce("_label", "_text", "_name", f"{side}_node_id")).drop("_label", "_text", "_name")
    return out


def statistics(nodes: DataFrame, clusters: DataFrame, connections: DataFrame) -> DataFrame:
    """Nine counts per board that changed anywhere."""
    n = nodes.groupBy("board_id").agg(*[F.count_if(F.col("change") == c).alias(f"{c}_nodes") for c in ("added", "removed", "edited")])
    c = clusters.groupBy("board_id").agg(*[F.count_if(F.col("change") == k).alias(f"{k}_clusters") for k in ("new", "removed", "modified", "unchanged")])
    e = connections.groupBy("board_id").agg(*[F.coalesce(F.sum(F.when(F.col("change") == k, F.col("n"))), F.lit(0)).alias(f"{k}_connections") for k in ("added", "removed")])
    return n.join(c, "board_id", "full_outer").join(e, "board_id", "full_outer").fillna(0)


def report(board: str, times: tuple[str, str], stats: dict, clusters: list, connections: list) -> str:
    """The text of one board's changes (rows are what the functions above return, in board order)."""
    lines = [f"Board {board} — changes from {times[0]} to {times[1]}:", ""]
    if not any(v for k, v in stats.items() if k not in ("unchanged_clusters", "board_id")):
        return "\n".join([*lines, "No changes — the board content is identical."])

    def section(items: list, render) -> None:
        lines.extend(render(x) for x in items[:SHOWN])
        if len(items) > SHOWN:
            lines.append(f"- … and {len(items) - SHOWN} more")

    of = lambda k: [c for c in clusters if c["change"] == k]
    first = lambda s: re.split(r"(?<=[.!?])\s+", s or "")[0].strip()
    if of("new"):
        lines.append(f"New clusters ({len(of('new'))}):")
        section(of("new"), lambda c: f'- "{c["label"]}": {first(c["summary"])}')
    if of("removed"):
        lines.append(f"Removed clusters ({len(of('removed'))}):")
        section(of("removed"), lambda c: f'- "{c["label"]}"')
    if of("modified"):
        lines.append(f"Modified clusters ({len(of('modified'))}):")

        def modified(c) -> str:
            parts = [f"+{c['added']} nodes"] * (c["added"] > 0) + [f"-{c['removed']} nodes"] * (c["removed"] > 0) + [f"{c['edited']} edited"] * (c["edited"] > 0)
            was = f' (was "{c["previous_label"]}")' if c["previous_label"] != c["label"] else ""
            return f'- "{c["label"]}"{was}: {", ".join(parts) or "reorganized"}'

        section(of("modified"), modified)
    edges = {k: [e for e in connections if e["change"] == k for _ in range(e["n"])] for k in ("added", "removed")}
    if edges["added"] or edges["removed"]:
        lines.append(f"Connections: +{len(edges['added'])} / -{len(edges['removed'])}")
        named = lambda e: f'"{e["from_name"]}" → "{e["to_name"]}"' + (f' ("{e["label"]}")' if e["label"] else "")
        section(edges["added"], lambda e: f"- new: {named(e)}")
        section(edges["removed"], lambda e: f"- removed: {named(e)}")
    lines.append(f"Nodes: +{stats['added_nodes']} added / -{stats['removed_nodes']} removed / {stats['edited_nodes']} edited.")
    if stats["unchanged_clusters"]:
        lines.append(f"Unchanged clusters: {stats['unchanged_clusters']}.")
    return "\n".join(lines)
