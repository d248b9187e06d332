"""Lexical retrieval over clusters, one-hop expansion, budgeted rendering and extractive answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlens.functions import text as T
from boardlens.operators import graph

TOP_K = 6
RELATION_HEADING = "Connections between clusters (from connector arrows):"
MIN_LINE, RELATION_SHARE = 160, 0.25


def _hay(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def retrieval_score(words: Column) -> Column:
    """2 for each word in the label, 1 in the summary, 1 in the phase; repeated words count again."""
    one = lambda w: F.when(F.contains(_hay("label"), w), 2).otherwise(0) + F.when(F.contains(_hay("summary"), w), 1).otherwise(0) + F.when(F.contains(_hay("phase"), w), 1).otherwise(0)
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + one(w))


def primaries(clusters: DataFrame, question: str, *, k: int = TOP_K) -> DataFrame:
    """The clusters that answer: all for an overview question, else the k best of each board with a score.

    ``place`` is their order: board order, or score then board order. The best
    of a partition are found before the boards are shuffled together.
    """
    q = F.lit(question)
    words = T.significant_words(q)
    scored = clusters.withColumns({"overview": T.is_overview(q), "score": retrieval_score(words)})
    order = Window.partitionBy("board_id").orderBy(F.desc(F.when(F.col("overview"), 0).otherwise(F.col("score"))), "cluster_ord")
    ranked = scored.where(F.col("overview") | (F.col("score") > 0)).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("overview") | (F.col("place") <= k))


def retrieve(clusters: DataFrame, relations: DataFrame, question: str, *, k: int = TOP_K) -> DataFrame:
    """Primaries and their neighbours: columns of ``clusters`` with ``primary`` and ``place``."""
    first = primaries(clusters, question, k=k).drop("score")
    plain = first.where(~F.col("overview"))
    near = clusters.join(graph.one_hop(plain, relations), ["board_id", "cluster_id"], "left_semi")
    after = Window.partitionBy("board_id").orderBy("cluster_ord")
    near = near.withColumns({"place": (F.row_number().over(after) + 1_000_000).cast("int"), "primary": F.lit(False)})
    return first.withColumn("primary", F.lit(True)).drop("overview").unionByName(near)


def no_match(clusters: DataFrame, found: DataFrame) -> DataFrame:
    """(board_id, no_match): boards with clusters but no primary for a question that is no overview."""
    some = found.where("primary").select("board_id").distinct().withColumn("hit", F.lit(True))
    return clusters.select("board_id").distinct().join(some, "board_id", "left").select("board_id", F.col("hit").isNull().alias("no_match"))


def extractive_answer(clusters: DataFrame, question: str, *, k: int = TOP_K) -> DataFrame:
    """(board_id, answer, cited): labels and first sentences of the best clusters, in the question's language."""
    german = T.is_german(F.lit(question))
    best = primaries(clusters, question, k=k).where(F.col("place") <= k)
    each = best.groupBy("board_id").agg(F.array_sort(F.collect_list(F.struct("place", "label", T.first_sentence(F.coalesce("summary", F.lit(""))).alias("first")))).alias("m"))
    labels = F.transform("m", lambda s: s["label"])
    details = F.array_join(F.slice(F.filter(F.transform("m", lambda s: s["first"]), lambda s: s != ""), 1, 4), " ")
    listed = T.format_list(labels, german)
    answer = F.when(german, F.concat(F.lit("Aus dem Board geht hervor: Das Projekt dreht sich vor allem um "), listed, F.lit(". "), details)).otherwise(F.concat(F.lit("Based on the board, the project is mainly about "), listed, F.lit(". "), details))
    unsupported = F.when(german, "Die Antwort ist im gecachten Board-Kontext nicht belegt.").otherwise("The answer is not supported by the cached board context.")
    out = clusters.select("board_id").distinct().join(each.select("board_id", T.utrim(answer).alias("found"), labels.alias("cited")), "board_id", "left")
    return out.select("board_id", F.coalesce("found", unsupported).alias("answer"), F.coalesce("cited", F.array().cast("array<string>")).alias("cited"))


def cluster_line() -> Column:
    phase = F.when(T.present(F.col("phase")).isNotNull(), F.concat(F.lit(" ("), T.escape_markup(F.col("phase")), F.lit(")"))).otherwise("")
    return F.concat(F.lit("- "), T.escape_markup(F.coalesce("label", F.lit(""))), phase, F.lit(": "), T.escape_markup(F.coalesce("summary", F.lit(""))))


def render_context(found: DataFrame, relations: DataFrame, max_chars: int) -> DataFrame:
    """(board_id, text, included): candidate lines and relation lines within ``max_chars`` a board.

    Lines are folded in order: the budget left after a shortened line depends on
    where its trailing space falls, so a running sum would not be exact.
    """
    rel = graph.relation_lines(relations, found)
    lines = rel.groupBy("board_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("edge_count")).alias("o"), "first_ord", "from_cluster_id", "to_cluster_id", T.escape_markup(F.col("line")).alias("line")))).alias("rel"))
    per = found.groupBy("board_id").agg(F.array_sort(F.collect_list(F.struct("place", "cluster_id", cluster_line().alias("line")))).alias("cand")).join(lines, "board_id", "left")
    none = F.array().cast(lines.schema["rel"].dataType)
    rel_all = F.coalesce("rel", none)
    section = F.length(F.concat(F.lit(RELATION_HEADING + "\n"), F.array_join(F.transform(rel_all, lambda r: r["line"]), "\n")))
    reserve = F.when(F.size(rel_all) > 0, F.least(section + 2, F.lit(int(max_chars * RELATION_SHARE)))).otherwise(0)
    per = per.withColumns({"rel": rel_all, "budget": F.lit(max_chars) - reserve})
    per = per.withColumn("per", F.greatest(F.lit(MIN_LINE), F.floor(F.col("budget") / F.size("cand")).cast("int")))
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("ids"), F.lit(False).alias("full"))

    def add(acc, c):
        left = F.col("budget") - F.length(acc["text"]) - F.when(acc["text"] == "", 0).otherwise(1)
        line = T.cut_to(c["line"], F.least(left, F.col("per")))
        stop = acc["full"] | (left < 1) | (line == "")
        text = F.concat(acc["text"], F.when(acc["text"] == "", "").otherwise("\n"), line)
        return F.struct(F.when(stop, acc["text"]).otherwise(text).alias("text"), F.when(stop, acc["ids"]).otherwise(F.concat(acc["ids"], F.array(c["cluster_id"]))).alias("ids"), stop.alias("full"))

    per = per.withColumn("done", F.aggregate("cand", start, add))
    ids = F.col("done.ids")
    shown = F.filter("rel", lambda r: F.array_contains(ids, r["from_cluster_id"]) & F.array_contains(ids, r["to_cluster_id"]))
    begin = F.struct(F.col("done.text").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def relate(acc, r):
        head = F.concat(F.when(acc["text"] == "", "").otherwise("\n\n"), F.lit(RELATION_HEADING + "\n"), r["line"])
        more = F.when(acc["n"] == 0, head).otherwise(F.concat(F.lit("\n"), r["line"]))
        stop = acc["full"] | (F.length(acc["text"]) + F.length(more) > max_chars)
        return F.struct(F.when(stop, acc["text"]).otherwise(F.concat(acc["text"], more)).alias("text"), (acc["n"] + F.when(stop, 0).otherwise(1)).alias("n"), stop.alias("full"))

    return per.select("board_id", F.aggregate(shown, begin, relate, lambda a: a["text"]).alias("text"), ids.alias("included"))


def filter_topic(clusters: DataFrame, topic: str) -> DataFrame:
    """Clusters in which a topic word occurs; the whole board (``fallback``) where none does; all without usable words."""
    words = T.topic_words(F.lit(topic))
    hay = F.lower(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("phase", F.lit(""))))
    match = (F.size(words) == 0) | F.exists(words, lambda w: F.contains(hay, w))
    board = Window.partitionBy("board_id")
    flagged = clusters.withColumn("_match", match).withColumn("_any", F.max("_match").over(board))
    return flagged.where(F.col("_match") | ~F.col("_any")).withColumn("fallback", ~F.col("_any")).drop("_match", "_any")


def context_text(clusters: DataFrame, relations: DataFrame, topic: str | None = None) -> DataFrame:
    """(board_id, context_text): header, a paragraph per cluster, relations whose ends both stayed."""
    chosen = filter_topic(clusters, topic) if topic else clusters.withColumn("fallback", F.lit(False))
    total = clusters.groupBy("board_id").agg(F.count("*").alias("total"))
    phase = F.when(T.present(F.col("phase")).isNotNull(), F.concat(F.lit(" ["), F.col("phase"), F.lit("]"))).otherwise("")
    para = F.concat(F.lit("## "), F.coalesce("label", F.lit("")), phase, F.lit("\n"), F.coalesce("summary", F.lit("")))
    body = chosen.groupBy("board_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster_ord", para.alias("p")))), lambda s: s["p"]).alias("ps"), F.max("fallback").alias("fallback")).join(total, "board_id")
    rel = graph.relation_lines(relations, chosen).groupBy("board_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("edge_count")).alias("o"), "first_ord", "line"))), lambda s: s["line"]).alias("lines"))
    t = topic or ""
    note = F.when(F.col("fallback"), f'(No cluster specifically matched topic "{t}" — showing the full board.)\n\n').otherwise("")
    named = F.when(~F.col("fallback") & F.lit(bool(topic)), f" (topic: {t})").otherwise("")
    header = F.concat(F.lit("Board "), F.col("board_id"), F.lit(" — "), F.size("ps").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" clusters"), named, F.lit(":"))
    block = F.when(F.col("lines").isNotNull(), F.concat(F.lit("\n\n## Connections between clusters (from connector arrows)\n"), F.array_join("lines", "\n"))).otherwise("")
    return body.join(rel, "board_id", "left").select("board_id", F.concat(note, header, F.lit("\n\n"), F.array_join("ps", "\n\n"), block).alias("context_text"))
