"""Turning clusters into labelled ones: deterministic text rules, routing, inventories, reuse, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlens.functions import text as T

SPARSE_TEXT, SCREENSHOTS, MAX_LISTED, MAX_INVENTORY, MAX_TEXT, MAX_ID = 40, 6, 160, 24_000, 300, 200


def members(clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cluster members with their nodes' columns and ``pos``; ids without a node are dropped."""
    rows = clusters.select("board_id", "cluster_id", F.posexplode("node_ids").alias("pos", "id"))
    return rows.join(nodes, ["board_id", "id"])


def has_image() -> Column:
    return T.present(F.col("image_ref")).isNotNull()


def cluster_facts(rows: DataFrame) -> DataFrame:
    """Per cluster: node, text and image counts, trimmed text length, texts and names in order."""
    text = T.trimmed(F.col("text"))
    in_order = lambda value: F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("pos", value.alias("v"))))), lambda s: s["v"])
    return rows.groupBy("board_id", "cluster_id").agg(
        F.count("*").alias("n_nodes"),
        F.count(text).alias("n_texts"),
        F.sum(has_image().cast("int")).alias("n_images"),
        F.sum(F.coalesce(F.length(text), F.lit(0))).alias("text_length"),
        in_order(text).alias("texts"),
        in_order(F.when(~T.utrim(F.col("name")).rlike(T.GENERIC_NAMES), T.trimmed(F.col("name")))).alias("names"),
    )


def wants_vision(mode: str) -> Column:
    """Whether a cluster (of :func:`cluster_facts`) is due for a vision model in this mode."""
    if mode == "max_speed":
        return F.lit(False)
    return F.lit(True) if mode == "max_quality" else (F.col("n_images") > 0) | (F.col("text_length") < SPARSE_TEXT)


def _s(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def deterministic(facts: DataFrame) -> DataFrame:
    """``facts`` with the label and summary that text rules give."""
    number = F.regexp_replace("cluster_id", "^cluster_", "")
    label = F.coalesce(T.compact_label(F.get("texts", 0)), T.compact_label(F.get("names", 0)), F.concat(F.lit("Cluster "), number))
    text = lambda c: F.col(c).cast("string")
    head = F.concat(F.lit("Cluster contains "), text("n_nodes"), F.lit(" board element"), _s(F.col("n_nodes")), F.lit(" with "), text("n_texts"), F.lit(" extracted text item"), _s(F.col("n_texts")), F.lit("."))
    quoted = F.array_join(F.transform(F.slice("texts", 1, 5), lambda t: F.concat(F.lit('"'), T.cut_dots(t, 120), F.lit('"'))), "; ")
    middle = F.when(F.size("texts") > 0, F.concat(F.lit("Extracted text highlights: "), quoted, F.lit("."))).otherwise("No readable text was extracted from this cluster.")
    images = F.when(F.col("n_images") > 0, F.concat(F.lit("It includes "), text("n_images"), F.lit(" image element"), _s(F.col("n_images")), F.lit(" that were not visually described because timeout-safe fallback was used.")))
    tail = F.lit("The source node IDs are retained for follow-up context.")
    return facts.withColumns({"label": label, "summary": F.concat_ws(" ", head, middle, images, tail)})


def vision_queue(facts: DataFrame) -> DataFrame:
    """``facts`` with ``queue``: pictures first, then little text, many pictures, id (binary order)."""
    order = Window.partitionBy("board_id").orderBy(F.desc(F.col("n_images") > 0), "text_length", F.desc("n_images"), "cluster_id")
    return facts.withColumn("queue", F.row_number().over(order))


def screenshot_nodes(rows: DataFrame, *, k: int = SCREENSHOTS) -> DataFrame:
    """The k nodes of each cluster to take a picture of: with image, by area, id."""
    order = Window.partitionBy("board_id", "cluster_id").orderBy(F.desc(has_image()), F.desc(F.col("width") * F.col("height")), "id")
    return rows.withColumn("shot", F.row_number().over(order)).where(F.col("shot") <= k)


def inventory(rows: DataFrame, *, max_nodes: int = MAX_LISTED, max_chars: int = MAX_INVENTORY) -> DataFrame:
    """(board_id, cluster_id, text, listed): node lines that fit, skipping those that do not, and what was left out."""
    text = T.trimmed(F.col("text"))
    order = Window.partitionBy("board_id", "cluster_id").orderBy(F.desc(has_image()), F.desc(text.isNotNull()), F.desc(F.col("width") * F.col("height")), "id")
    said = F.when(text.isNotNull(), F.concat(F.lit(": "), F.substring(F.to_json(F.array(T.cut_append(text, MAX_TEXT))), F.lit(2), F.length(F.to_json(F.array(T.cut_append(text, MAX_TEXT)))) - 2))).otherwise("")
    line = F.concat(F.lit("- "), F.col("id"), F.lit(" ("), F.col("type"), F.lit(")"), F.when(has_image(), " [contains image]").otherwise(""), said)
    ranked = rows.withColumns({"r": F.row_number().over(order), "total": F.count("*").over(Window.partitionBy("board_id", "cluster_id"))})
    ranked = ranked.where(F.col("r") <= max_nodes)
    each = F.collect_list(F.when(F.length("id") <= MAX_ID, F.struct("r", "id", line.alias("line"))))
    per = ranked.groupBy("board_id", "cluster_id").agg(F.array_sort(each).alias("cand"), F.max("total").alias("total"))
    entry = per.schema["cand"].dataType
    start = F.struct(F.array().cast(entry).alias("kept"), F.lit(0).alias("used"))

    def add(acc, c):
        more = F.length(c["line"]) + F.when(F.size(acc["kept"]) > 0, 1).otherwise(0)
        fits = acc["used"] + more <= max_chars
        return F.struct(F.when(fits, F.concat(acc["kept"], F.array(c))).otherwise(acc["kept"]).alias("kept"), F.when(fits, acc["used"] + more).otherwise(acc["used"]).alias("used"))

    kept = F.aggregate("cand", start, add, lambda a: a["kept"])

    def notice(n: Column) -> Column:
        total = F.col("total")
        return F.concat(F.lit("[Inventory truncated: showing "), n.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" elements; "), (total - n).cast("string"), F.lit(" omitted by deterministic node/character limits. Omitted elements remain cluster members and are retained automatically.]"))

    per = per.withColumn("kept", kept)
    # The notice may need room: the last entries go until both fit.
    room = lambda n: F.aggregate(F.slice("kept", F.lit(1), n), F.lit(0), lambda a, e: a + F.length(e["line"]) + 1)
    fits = lambda n: (n == F.col("total")) | (room(n) + F.length(notice(n)) <= max_chars)
    many = F.coalesce(F.get(F.filter(F.sequence(F.size("kept"), F.lit(0), F.lit(-1)), fits), 0), F.lit(0))
    per = per.withColumn("many", F.when(F.size("kept") > 0, many).otherwise(0))
    final = F.slice("kept", F.lit(1), F.col("many"))
    lines = F.concat(F.transform(final, lambda e: e["line"]), F.when(F.col("many") < F.col("total"), F.array(notice(F.col("many")))).otherwise(F.array().cast("array<string>")))
    return per.select("board_id", "cluster_id", F.array_join(lines, "\n").alias("text"), F.transform(final, lambda e: e["id"]).alias("listed"))


def _within(ordered: Column, i: Column) -> Column:
    """Whether the ordered array holds ``i``, by binary search: halving steps lead to the number of elements up to ``i``."""
    steps = F.array(*[F.lit(1 << b) for b in range(30, -1, -1)])
    upto = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(ordered, n + step - 1) <= i, n + step).otherwise(n))
    return F.coalesce(F.get(ordered, upto - 1) == i, F.lit(False))


def merge_reply(node_ids: Column, confirmed: Column, listed: Column) -> Column:
    """A model's confirmed ids merged: known and listed ones, and all that were not listed; all if none is left.

    What goes is what was listed and not confirmed. Set operations take time in
    proportion to the ids; ids that repeat, which these would merge, are searched.
    """
    said = F.coalesce(confirmed, F.array().cast("array<string>"))
    ids, gone = F.array_compact(node_ids), F.array_compact(F.array_except(listed, said))
    searched = F.get(F.transform(F.array(F.array_sort(gone)), lambda g: F.filter(ids, lambda i: ~_within(g, i))), 0)
    kept = F.when(F.size(F.array_distinct(ids)) == F.size(ids), F.array_except(ids, gone)).otherwise(searched)
    valid = F.array_compact(F.array_intersect(F.array_intersect(said, listed), node_ids))
    return F.when(F.size(valid) > 0, kept).otherwise(node_ids)


def content_hash(rows: DataFrame, *keys: str) -> DataFrame:
    """SHA-256 per group over members' id, type, trimmed text and image, in id order: geometry and names play no part."""
    item = F.struct(F.col("id"), F.col("type"), T.trimmed(F.col("text")).alias("text"), F.col("image_ref").alias("imageRef"))
    return rows.groupBy(*keys).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(item))), 256).alias("content_hash"), F.count("*").alias("n_members"))


def node_hash(nodes: DataFrame) -> DataFrame:
    """SHA-256 per board over all thirteen fields of all nodes, in id order."""
    fields = ("id", "name", "type", "x", "y", "width", "height", "rotation", "image_ref", "text", "parent_id", "connector_start_id", "connector_end_id")
    return nodes.groupBy("board_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))), 256).alias("node_hash"))


def reuse_index(previous: DataFrame, nodes: DataFrame) -> DataFrame:
    """Previous clusters by the content hash of their members; only those whose members all resolve, the last of equals."""
    rows = members(previous, nodes)
    whole = content_hash(rows, "board_id", "cluster_id").join(previous.drop("content_hash"), ["board_id", "cluster_id"]).where(F.col("n_members") == F.size("node_ids"))
    keep = F.struct("label", "summary", "summary_source", "model_id", "confirmed_node_ids")
    return whole.groupBy("board_id", F.col("content_hash")).agg(F.max_by(keep, "cluster_ord").alias("previous"))


def reuse(clusters: DataFrame, facts: DataFrame, index: DataFrame, mode: str) -> DataFrame:
    """``clusters`` (with content_hash) and ``previous`` where it may be reused: made by vision, or vision is not due."""
    met = clusters.join(facts.withColumn("due", wants_vision(mode)).select("board_id", "cluster_id", "due"), ["board_id", "cluster_id"]).join(index, ["board_id", "content_hash"], "left")
    may = F.col("previous").isNotNull() & ((F.col("previous.summary_source") == "vision_llm") | ~F.col("due"))
    return met.withColumn("previous", F.when(may, F.col("previous")))


def carried_ids(node_ids: Column, confirmed: Column) -> Column:
    """Earlier confirmed ids that are members still, in their order now; all members if none is."""
    both = F.array_intersect(node_ids, F.coalesce(confirmed, F.array().cast("array<string>")))
    return F.when(F.size(both) > 0, both).otherwise(node_ids)


def quality_report(clusters: DataFrame) -> DataFrame:
    """Per board: models in order of first use, and clusters by how their summary came about."""
    first = clusters.where(T.present(F.col("model_id")).isNotNull()).groupBy("board_id", "model_id").agg(F.min("cluster_ord").alias("o")).groupBy("board_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "model_id"))), lambda s: s["model_id"]).alias("models_used"))
    by = lambda s: F.count_if(F.col("summary_source") == s)
    counts = clusters.groupBy("board_id").agg(F.count("*").alias("clusters"), by("deterministic").alias("deterministic_clusters"), by("vision_llm").alias("vision_clusters"), by("cache").alias("cached_clusters"), F.transform(F.array_sort(F.collect_list(F.struct("cluster_ord", "label"))), lambda s: s["label"]).alias("labels"))
    return counts.join(first, "board_id", "left").withColumn("models_used", F.coalesce("models_used", F.array().cast("array<string>")))


def ingest_summary(report: DataFrame, hint: str) -> DataFrame:
    """(board_id, summary): the sentence an ingest answers with; ``reused`` and ``fallbacks`` are columns of the report."""
    quoted = F.transform("labels", lambda v: F.concat(F.lit('"'), v, F.lit('"')))
    shown = F.concat(F.array_join(F.slice(quoted, 1, 8), ", "), F.when(F.size("labels") > 8, ", ...").otherwise(""))
    n = lambda c: F.col(c).cast("string")
    cached = F.when(F.col("cached_clusters") > 0, F.concat(F.lit(" Loaded "), n("cached_clusters"), F.lit(" clusters from cache."))).otherwise("")
    again = F.when(F.col("reused") > 0, F.concat(F.lit(" Reused "), n("reused"), F.lit(" unchanged cluster"), _s(F.col("reused")), F.lit(" from the previous ingest."))).otherwise("")
    fell = F.when(F.col("fallbacks") > 0, F.concat(F.lit(" "), n("fallbacks"), F.lit(" cluster"), _s(F.col("fallbacks")), F.lit(" used text fallback because vision processing timed out, failed, or exceeded its budget."))).otherwise("")
    return report.select("board_id", F.concat(F.lit("Ingested board "), F.col("board_id"), F.lit(": "), n("clusters"), F.lit(" clusters - "), shown, F.lit(f" (docStructureHint={hint})."), cached, again, fell).alias("summary"))
