"""Registered queries of the read side (context, relations, answers, diffs, reuse, texts) and their DuckDB SQL.

Boards are brands of ``part``, clusters its keys modulo seven, connectors lead
from each part of a brand to the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardlens.functions import text as T
from boardlens.operators import diff, graph, phases, refine, retrieve, spatial
from boardlens.sources.scratch import new_dir
from boardlens.sources.snapshots import SnapshotStore

RELATED = "Which alpha cluster comes first for any brand?"
HINT, CUSTOM = "user_journey", ("Rising tion", "Falling sche")
NAMES = ("Group of things", "Thing")


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def _groups(spark: SparkSession, sf_dir: str, groups: int = 7) -> DataFrame:
    """Clusters of every brand with a label, summary and phase."""
    k, n = F.col("p_partkey"), F.col("cluster_ord")
    rows = _part(spark, sf_dir).groupBy(F.col("p_brand").alias("board_id"), (k % groups).cast("int").alias("cluster_ord"))
    rows = rows.agg(F.transform(F.array_sort(F.collect_list(k)), lambda x: x.cast("string")).alias("node_ids"), F.min(k).alias("first"))
    return rows.select(
        "board_id", "cluster_ord", F.concat(F.lit("cluster_"), _text(n)).alias("cluster_id"), "node_ids",
        F.concat(F.lit("Group "), _text(n), F.lit(" of "), F.col("board_id")).alias("label"),
        F.concat(F.lit("Holds "), _text(F.size("node_ids")), F.lit(" parts. The first is "), _text(F.col("first")), F.lit("! All <fine>.")).alias("summary"),
        F.when(n % 3 == 0, "alpha & beta").alias("phase"),
    )


_CLUSTERS = """c AS (SELECT p_brand AS board_id, p_partkey % 7 AS k, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY ALL),
clusters AS (SELECT board_id, k, 'cluster_' || k AS cluster_id, 'Group ' || k || ' of ' || board_id AS label,
  'Holds ' || n || ' parts. The first is ' || f || '! All <fine>.' AS summary, CASE WHEN k % 3 = 0 THEN 'alpha & beta' END AS phase FROM c)"""


def _connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as connector nodes, some of them loose, and some as plain nodes."""
    k = F.col("p_partkey")
    after = F.lead(k).over(Window.partitionBy("p_brand").orderBy(k))
    label = F.when(k % 5 > 0, F.concat(F.lit(" to "), _text(k % 3), F.lit(" "))).otherwise("  ")
    return _part(spark, sf_dir).select(
        F.col("p_brand").alias("board_id"), k.alias("ord"), F.concat(F.lit("x"), _text(k)).alias("id"), F.when(k % 17 == 0, "STICKY").otherwise("CONNECTOR").alias("type"),
        F.when(k % 19 == 0, "").otherwise(_text(k)).alias("connector_start_id"), _text(after).alias("connector_end_id"), label.alias("text"),
    )


def connector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectors attached at both ends."""
    return graph.connector_edges(_connectors(spark, sf_dir)).select("board_id", "connector_id", "from_node_id", "to_node_id", "label")


_EDGES = """n AS (SELECT p_brand AS board_id, p_partkey AS ord, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS t, CASE WHEN p_partkey % 5 > 0 THEN 'to ' || (p_partkey % 3) END AS label FROM part),
e AS (SELECT * FROM n WHERE t IS NOT NULL AND ord % 17 <> 0 AND ord % 19 <> 0)"""
CONNECTORS = f"WITH {_EDGES} SELECT board_id, 'x' || ord AS connector_id, CAST(ord AS VARCHAR) AS from_node_id, CAST(t AS VARCHAR) AS to_node_id, label FROM e"


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cluster_relations(graph.connector_edges(_connectors(spark, sf_dir)), _groups(spark, sf_dir))


_RELATIONS = f"""{_CLUSTERS}, {_EDGES},
met AS (SELECT board_id, ord % 7 AS a, t % 7 AS b, label, count(*) AS n, min(ord) AS first FROM e WHERE ord % 7 <> t % 7 GROUP BY ALL),
rel AS (SELECT board_id, a, b, coalesce(list(label ORDER BY first, label) FILTER (label IS NOT NULL), []) AS labels, CAST(sum(n) AS BIGINT) AS edge_count, min(first) AS first_ord FROM met GROUP BY ALL),
lines AS (SELECT rel.*, '- "' || x.label || '" → "' || y.label || '"' || CASE WHEN len(labels) > 0 THEN ' — ' || array_to_string(list_transform(labels, lambda l: '"' || l || '"'), ', ') ELSE '' END
  || CASE WHEN edge_count > 1 THEN ' (' || edge_count || ' connectors)' ELSE '' END AS line FROM rel JOIN clusters x ON x.board_id = rel.board_id AND x.k = a JOIN clusters y ON y.board_id = rel.board_id AND y.k = b)"""


def relation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between clusters as lines of text, labels in order of first sight."""
    lines = graph.relation_lines(_relations(spark, sf_dir), _groups(spark, sf_dir))
    order = Window.partitionBy("board_id").orderBy(F.desc("edge_count"), "first_ord", "line")
    return lines.select("board_id", F.row_number().over(order).cast("long").alias("place"), "from_label", "to_label", "line")


LINES = f"""WITH {_RELATIONS} SELECT lines.board_id, row_number() OVER (PARTITION BY lines.board_id ORDER BY edge_count DESC, first_ord, line) AS place,
'Group ' || a || ' of ' || board_id AS from_label, 'Group ' || b || ' of ' || board_id AS to_label, line FROM lines"""


def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of every board on a topic, on one that no cluster has, and without."""
    clusters, relations = _groups(spark, sf_dir), _relations(spark, sf_dir)
    parts = [retrieve.context_text(clusters, relations, t).select(F.lit(t or "").alias("topic"), "board_id", "context_text") for t in ("alpha", "zzqq", None)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


CONTEXT = f"""WITH {_RELATIONS}, topics(topic) AS (VALUES ('alpha'), ('zzqq'), ('')),
m AS (SELECT topic, clusters.*, topic = '' OR contains(lower(label || ' ' || summary || ' ' || coalesce(phase, '')), topic) AS hit FROM clusters, topics),
w AS (SELECT *, bool_or(hit) OVER (PARTITION BY topic, board_id) AS found, count(*) OVER (PARTITION BY topic, board_id) AS total FROM m),
kept AS (SELECT * FROM w WHERE hit OR NOT found),
body AS (SELECT topic, board_id, found, total, count(*) AS shown, string_agg('## ' || label || CASE WHEN phase IS NULL THEN '' ELSE ' [' || phase || ']' END || E'\\n' || summary, E'\\n\\n' ORDER BY k) AS ps FROM kept GROUP BY ALL),
ls AS (SELECT x.topic, x.board_id, string_agg(line, E'\\n' ORDER BY edge_count DESC, first_ord, line) AS ls FROM lines JOIN kept x ON x.board_id = lines.board_id AND x.k = a JOIN kept y ON y.topic = x.topic AND y.board_id = lines.board_id AND y.k = b GROUP BY ALL)
SELECT topic, board_id, CASE WHEN found THEN '' ELSE '(No cluster specifically matched topic "' || topic || E'" — showing the full board.)\\n\\n' END || 'Board ' || board_id || ' — ' || shown || ' of ' || total || ' clusters'
  || CASE WHEN found AND topic <> '' THEN ' (topic: ' || topic || ')' ELSE '' END || E':\\n\\n' || ps || CASE WHEN ls IS NULL THEN '' ELSE E'\\n\\n## Connections between clusters (from connector arrows)\\n' || ls END AS context_text
FROM body LEFT JOIN ls USING (topic, board_id)"""


def retrieve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best clusters of every board for a question, and what they are connected with."""
    found = retrieve.retrieve(_groups(spark, sf_dir), _relations(spark, sf_dir), RELATED, k=2)
    return found.select("board_id", "cluster_id", "primary", F.col("place").cast("long").alias("place"))


NEIGHBOURS = f"""WITH {_RELATIONS}, s AS (SELECT *, 3 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS score FROM clusters),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY score DESC, k) AS place FROM s) WHERE place <= 2),
near AS (SELECT DISTINCT rel.board_id, CASE WHEN p.k = a THEN b ELSE a END AS k FROM rel JOIN p ON p.board_id = rel.board_id AND (p.k = a OR p.k = b)),
more AS (SELECT n.* FROM near n LEFT JOIN p ON p.board_id = n.board_id AND p.k = n.k WHERE p.k IS NULL)
SELECT board_id, cluster_id, true AS primary, place FROM p
UNION ALL SELECT board_id, 'cluster_' || k, false, 1000000 + row_number() OVER (PARTITION BY board_id ORDER BY k) FROM more"""


def no_match_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards without a cluster for a question."""
    few = _groups(spark, sf_dir).where("cluster_ord = 3 OR board_id < 'Brand#2'")
    question = "Where are the alpha clusters, numbered three?"
    found = retrieve.retrieve(few, _relations(spark, sf_dir).limit(0), question)
    return retrieve.no_match(few.where("cluster_ord <> 0"), found.where("cluster_ord = 3"))


NO_MATCH = f"""WITH {_CLUSTERS}, few AS (SELECT * FROM clusters WHERE k = 3 OR board_id < 'Brand#2'), hit AS (SELECT DISTINCT board_id FROM few WHERE k = 3)
SELECT DISTINCT few.board_id, hit.board_id IS NULL AS no_match FROM few LEFT JOIN hit USING (board_id) WHERE k <> 0"""


def overview_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions ask for an overview, and by how many words the others are searched."""
    n, t = F.col("conv_id") + F.col("turn"), F.col("text")
    q = F.when(n % 6 == 0, F.concat(F.lit("Tell me project about? "), t)).when(n % 6 == 1, F.concat(t, F.lit(" SUMMARY"))).when(n % 6 == 2, F.concat(F.lit("How do the parts relate to "), t)).when(n % 6 == 3, F.concat(F.lit("summaryx "), t)).otherwise(t)
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", T.is_overview(q).alias("overview"), F.size(T.significant_words(q)).cast("long").alias("n_words"))


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


OVERVIEW = f"""WITH q AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'Tell me project about? ' || text WHEN 1 THEN text || ' SUMMARY' WHEN 2 THEN 'How do the parts relate to ' || text WHEN 3 THEN 'summaryx ' || text ELSE text END AS q FROM conversations)
SELECT conv_id, turn, {" OR ".join("regexp_matches(q, '(?i)" + p.replace("'", "''") + "')" for p in T.OVERVIEW_PATTERNS)} AS overview,
CAST(len(list_filter(regexp_split_to_array(lower(q), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2 AND NOT list_contains({_sql_list(T.STOP_WORDS)}, w))) AS BIGINT) AS n_words FROM q"""


def _doc_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("board_id"), F.col("doc_id").alias("cluster_ord"), F.col("lang").alias("label"), F.col("text").alias("summary"))


def framework_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the phases of a built-in framework and of custom ones."""
    docs = _doc_clusters(spark, sf_dir)
    built = phases.map_phases(docs, HINT).select(F.col("cluster_ord").alias("doc_id"), "phase")
    own = phases.map_phases(docs, HINT, list(CUSTOM)).select(F.col("cluster_ord").alias("doc_id"), F.col("phase").alias("custom_phase"))
    return built.join(own, "doc_id")


def _phase_sql(words: dict, name: str) -> str:
    points = {p: " + ".join(f"CASE WHEN contains(lower(lang), '{k}') THEN 2 ELSE 0 END + CASE WHEN contains(lower(text), '{k}') THEN 1 ELSE 0 END" for k in ks) for p, ks in words.items()}
    each = ", ".join(f"{{'s': {e}, 'p': '{p}'}}" for p, e in points.items())
    return f"""(SELECT doc_id, CASE WHEN list_max(list_transform(xs, lambda x: x.s)) > 0 AND len(list_filter(xs, lambda x: x.s = list_max(list_transform(xs, lambda y: y.s)))) = 1
  THEN list_filter(xs, lambda x: x.s = list_max(list_transform(xs, lambda y: y.s)))[1].p ELSE 'unclear' END AS {name} FROM (SELECT doc_id, [{each}] AS xs FROM documents))"""


PHASES = f"""SELECT doc_id, phase, custom_phase FROM {_phase_sql(phases.FRAMEWORKS[HINT], "phase")}
JOIN {_phase_sql({p: dict.fromkeys([p.lower(), *p.lower().split()]) for p in CUSTOM}, "custom_phase")} USING (doc_id)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> dict:
    """Two versions of the boards: parts gone and new, moved to the next cluster, and with other texts."""
    k = F.col("p_partkey")
    p = _part(spark, sf_dir)
    node = lambda df, text: df.select(F.col("p_brand").alias("board_id"), k.alias("ord"), _text(k).alias("id"), F.col("p_name").alias("name"), F.lit("STICKY").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image_ref"))

    def side(rows: DataFrame, at: Column, label: Column) -> DataFrame:
        held = rows.groupBy(F.col("p_brand").alias("board_id"), at.cast("int").alias("cluster_ord")).agg(F.transform(F.array_sort(F.collect_list(k)), lambda x: x.cast("string")).alias("node_ids"))
        return held.select("board_id", "cluster_ord", F.concat(F.lit("cluster_"), _text(F.col("cluster_ord"))).alias("cluster_id"), "node_ids", label.alias("label"), F.lit("One. Two.").alias("summary"))

    old, new = p.where(k % 13 != 0), p.where(k % 10 != 0)
    edges = graph.connector_edges(_connectors(spark, sf_dir))
    name = F.concat(F.lit("Group "), _text(F.col("cluster_ord")))
    return {
        "nodes": (node(old, F.col("p_name")), node(new, F.when(k % 9 == 0, F.concat(F.col("p_name"), F.lit(" anew"))).otherwise(F.concat(F.lit(" "), F.col("p_name"))))),
        "clusters": (side(old, k % 7, name), side(new, F.when(k % 11 == 0, (k + 1) % 7).otherwise(k % 7), F.when(F.col("cluster_ord") % 2 == 0, F.concat(name, F.lit("!"))).otherwise(name))),
        "edges": (edges.where("ord % 3 <> 0"), edges.where("ord % 4 <> 0")),
    }


_DIFF = f"""{_EDGES}, bn AS (SELECT p_brand AS board_id, p_partkey AS id, p_partkey % 7 AS k, p_name AS t FROM part WHERE p_partkey % 13 <> 0),
an AS (SELECT p_brand AS board_id, p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN (p_partkey + 1) % 7 ELSE p_partkey % 7 END AS k, CASE WHEN p_partkey % 9 = 0 THEN p_name || ' anew' ELSE p_name END AS t FROM part WHERE p_partkey % 10 <> 0),
bc AS (SELECT board_id, k, count(*) AS n, list([CAST(id AS VARCHAR), t] ORDER BY id) AS content, 'Group ' || k AS label FROM bn GROUP BY ALL),
ac AS (SELECT board_id, k, count(*) AS n, list([CAST(id AS VARCHAR), t] ORDER BY id) AS content, 'Group ' || k || CASE WHEN k % 2 = 0 THEN '!' ELSE '' END AS label FROM an GROUP BY ALL),
both_in AS (SELECT board_id, b.k AS bk, a.k AS ak, count(*) AS overlap, count(*) FILTER (a.t <> b.t) AS edited FROM bn b JOIN an a USING (board_id, id) GROUP BY ALL),
cand AS (SELECT o.*, row_number() OVER (PARTITION BY o.board_id ORDER BY overlap DESC, bk, ak) AS i FROM both_in o JOIN bc ON bc.board_id = o.board_id AND bc.k = bk JOIN ac ON ac.board_id = o.board_id AND ac.k = ak WHERE overlap / least(bc.n, ac.n) >= 0.5),
g(board_id, i, ub, ua, hit) AS (SELECT DISTINCT board_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), false FROM cand
  UNION ALL SELECT x.board_id, x.j, CASE WHEN free THEN list_append(ub, bk) ELSE ub END, CASE WHEN free THEN list_append(ua, ak) ELSE ua END, free
  FROM (SELECT g.*, c.i AS j, bk, ak, NOT list_contains(ub, bk) AND NOT list_contains(ua, ak) AS free FROM g JOIN cand c ON c.board_id = g.board_id AND c.i = g.i + 1) x),
m AS (SELECT cand.* FROM cand JOIN g ON g.board_id = cand.board_id AND g.i = cand.i AND hit),
changes AS (SELECT m.board_id, CASE WHEN a.content = b.content THEN 'unchanged' ELSE 'modified' END AS change, ak AS cluster_ord, a.label, b.label AS previous_label, a.n - overlap AS added, b.n - overlap AS removed, edited
    FROM m JOIN bc b ON b.board_id = m.board_id AND b.k = bk JOIN ac a ON a.board_id = m.board_id AND a.k = ak
  UNION ALL SELECT board_id, 'new', k, label, NULL, 0, 0, 0 FROM ac WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.board_id = ac.board_id AND ak = k)
  UNION ALL SELECT board_id, 'removed', k, label, NULL, 0, 0, 0 FROM bc WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.board_id = bc.board_id AND bk = k)),
moved AS (SELECT board_id, ord, t, coalesce(label, '') AS label, CASE WHEN ord % 3 = 0 THEN 'added' ELSE 'removed' END AS change FROM e WHERE (ord % 3 = 0) <> (ord % 4 = 0))"""


def cluster_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters matched between two versions: new, removed, modified, unchanged, and by what."""
    s = _snapshots(spark, sf_dir)
    out = diff.cluster_changes(*s["clusters"], *s["nodes"])
    return out.select("board_id", "change", F.col("cluster_ord").cast("long").alias("cluster_ord"), "label", "previous_label", *[F.col(c).cast("long").alias(c) for c in ("added", "removed", "edited")])


CHANGES = f"WITH RECURSIVE {_DIFF} SELECT board_id, change, cluster_ord, label, previous_label, added, removed, edited FROM changes"


def diff_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine counts of what changed on each board."""
    s = _snapshots(spark, sf_dir)
    out = diff.statistics(diff.node_changes(*s["nodes"]), diff.cluster_changes(*s["clusters"], *s["nodes"]), diff.connection_changes(*s["edges"]))
    return out.select("board_id", *[F.col(c).cast("long").alias(c) for c in out.columns if c != "board_id"])


STATISTICS = f"""WITH RECURSIVE {_DIFF}, nodes AS (SELECT coalesce(a.board_id, b.board_id) AS board_id, count(*) FILTER (b.id IS NULL) AS added_nodes, count(*) FILTER (a.id IS NULL) AS removed_nodes, count(*) FILTER (a.t <> b.t) AS edited_nodes
  FROM an a FULL JOIN bn b ON a.board_id = b.board_id AND a.id = b.id GROUP BY ALL),
cl AS (SELECT board_id, {", ".join(f"count(*) FILTER (change = '{k}') AS {k}_clusters" for k in ("new", "removed", "modified", "unchanged"))} FROM changes GROUP BY ALL),
co AS (SELECT board_id, count(*) FILTER (change = 'added') AS added_connections, count(*) FILTER (change = 'removed') AS removed_connections FROM moved GROUP BY ALL)
SELECT board_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("added_nodes", "removed_nodes", "edited_nodes", "new_clusters", "removed_clusters", "modified_clusters", "unchanged_clusters", "added_connections", "removed_connections"))}
FROM nodes FULL JOIN cl USING (board_id) FULL JOIN co USING (board_id)"""


def endpoint_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections added and removed, both ends named by cluster, text, name or id."""
    s = _snapshots(spark, sf_dir)
    few = s["clusters"][1].where("cluster_ord < 4")
    nodes = s["nodes"][1].withColumn("text", F.when(F.col("ord") % 2 == 0, F.concat_ws(" ", *["text"] * 5)))
    out = diff.endpoint_labels(diff.connection_changes(*s["edges"]), few, nodes)
    return out.select("board_id", "from_node_id", "to_node_id", "label", "change", "n", "from_name", "to_name")


ENDPOINTS = f"""WITH RECURSIVE {_DIFF}, shown AS (SELECT board_id, id, CASE WHEN k < 4 THEN 'Group ' || k || CASE WHEN k % 2 = 0 THEN '!' ELSE '' END
  WHEN id % 2 = 0 THEN CASE WHEN length(five) <= 40 THEN five ELSE substr(five, 1, 39) || '…' END ELSE name END AS shown FROM (SELECT an.*, part.p_name AS name,
  CASE WHEN id % 9 = 0 THEN array_to_string([t, t, t, t, t], ' ') ELSE array_to_string([t, t, t, t, t], '  ') END AS five FROM an JOIN part ON p_partkey = id))
SELECT moved.board_id, CAST(ord AS VARCHAR) AS from_node_id, CAST(moved.t AS VARCHAR) AS to_node_id, label, change, CAST(1 AS BIGINT) AS n,
coalesce(x.shown, CAST(ord AS VARCHAR)) AS from_name, coalesce(y.shown, CAST(moved.t AS VARCHAR)) AS to_name
FROM moved LEFT JOIN shown x ON x.board_id = moved.board_id AND x.id = ord LEFT JOIN shown y ON y.board_id = moved.board_id AND y.id = moved.t"""


def _rows(spark: SparkSession, sf_dir: str, groups: int) -> DataFrame:
    """Parts as nodes in clusters, with an area, text and image."""
    k = F.col("p_partkey")
    return _part(spark, sf_dir).select(
        F.col("p_brand").alias("board_id"), F.concat(F.lit("cluster_"), _text(k % groups)).alias("cluster_id"), k.alias("pos"), _text(k).alias("id"), F.lit("Text").alias("name"), F.lit("STICKY").alias("type"),
        (60 + k % 180).cast("double").alias("width"), (60 + k % 120).cast("double").alias("height"), F.when(F.col("p_size") % 10 == 0, F.col("p_type")).alias("image_ref"), F.when(k % 3 != 0, F.concat(F.lit(" "), F.col("p_name"))).alias("text"),
    )


def inventory_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element list of each cluster for a model, at most four elements."""
    out = refine.inventory(_rows(spark, sf_dir, 3), max_nodes=4)
    return out.select("board_id", "cluster_id", "text", F.array_join("listed", ",").alias("listed"))


INVENTORY = """WITH r AS (SELECT p_brand AS board_id, 'cluster_' || (p_partkey % 3) AS cluster_id, CAST(p_partkey AS VARCHAR) AS id, p_size % 10 = 0 AS img, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS t, (60 + p_partkey % 180) * (60 + p_partkey % 120) AS area FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY board_id, cluster_id ORDER BY img DESC, (t IS NOT NULL) DESC, area DESC, id) AS p, count(*) OVER (PARTITION BY board_id, cluster_id) AS total FROM r)
SELECT board_id, cluster_id, string_agg('- ' || id || ' (STICKY)' || CASE WHEN img THEN ' [contains image]' ELSE '' END || CASE WHEN t IS NULL THEN '' ELSE ': "' || t || '"' END, E'\\n' ORDER BY p)
  || CASE WHEN any_value(total) > count(*) THEN E'\\n[Inventory truncated: showing ' || count(*) || ' of ' || any_value(total) || ' elements; ' || (any_value(total) - count(*)) || ' omitted by deterministic node/character limits. Omitted elements remain cluster members and are retained automatically.]' ELSE '' END AS text,
  string_agg(id, ',' ORDER BY p) AS listed FROM k WHERE p <= 4 GROUP BY board_id, cluster_id"""


def reply_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that a model confirmed, merged with those it was not shown, and carried over to a later version."""
    ids = F.col("node_ids")
    number = lambda i: i.cast("long")
    confirmed = F.concat(F.filter(ids, lambda i: (number(i) % 5 == 0) & (F.col("cluster_ord") != 2)), F.array(F.lit("zz")))
    listed = F.filter(ids, lambda i: number(i) % 2 == 0)
    both = lambda c: F.array_join(c, ",")
    return _groups(spark, sf_dir).select("board_id", "cluster_id", both(refine.merge_reply(ids, confirmed, listed)).alias("merged"), both(refine.carried_ids(ids, F.reverse(confirmed))).alias("carried"))


MERGE = """WITH c AS (SELECT p_brand AS board_id, p_partkey % 7 AS k, list(p_partkey ORDER BY p_partkey) AS ids FROM part GROUP BY ALL),
v AS (SELECT *, list_filter(ids, lambda i: i % 5 = 0 AND k <> 2) AS said FROM c), w AS (SELECT *, list_filter(said, lambda i: i % 2 = 0) AS valid FROM v)
SELECT board_id, 'cluster_' || k AS cluster_id, array_to_string(CASE WHEN len(valid) = 0 THEN ids ELSE list_filter(ids, lambda i: i % 2 = 1 OR list_contains(valid, i)) END, ',') AS merged,
array_to_string(CASE WHEN len(said) = 0 THEN ids ELSE said END, ',') AS carried FROM w"""


def reuse_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of a new version that take over an earlier one's label, by content and by how it was made."""
    old, k = _rows(spark, sf_dir, 7), F.col("pos")
    new = old.withColumn("text", F.when(k % 50 == 0, "changed").otherwise(F.col("text"))).withColumn("image_ref", F.when(k % 7 < 3, F.col("image_ref")))
    old = old.withColumn("image_ref", F.when(k % 7 < 3, F.col("image_ref")))
    before = _groups(spark, sf_dir).withColumns({"summary_source": F.when(F.col("cluster_ord") % 2 == 0, "vision_llm").otherwise("deterministic"), "model_id": F.lit("m"), "confirmed_node_ids": F.col("node_ids")})
    index = refine.reuse_index(before, old.drop("cluster_id", "pos"))
    hashed = refine.content_hash(new, "board_id", "cluster_id")
    out = refine.reuse(hashed, refine.cluster_facts(new), index, "balanced")
    return out.select("board_id", "cluster_id", "due", F.col("previous.label").alias("label"))


CARRY = """WITH r AS (SELECT p_brand AS board_id, p_partkey % 7 AS k, p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS t, CASE WHEN p_size % 10 = 0 AND p_partkey % 7 < 3 THEN p_type END AS img FROM part),
a AS (SELECT * REPLACE (CASE WHEN id % 50 = 0 THEN 'changed' ELSE t END AS t) FROM r),
n AS (SELECT board_id, k, list([CAST(id AS VARCHAR), t, img] ORDER BY id) AS content, count(img) > 0 OR coalesce(sum(length(t)), 0) < 40 AS due FROM a GROUP BY ALL),
o AS (SELECT board_id, list([CAST(id AS VARCHAR), t, img] ORDER BY id) AS content, k % 2 = 0 AS seen, 'Group ' || k || ' of ' || board_id AS label FROM r GROUP BY board_id, k)
SELECT n.board_id, 'cluster_' || k AS cluster_id, due, CASE WHEN seen OR NOT due THEN o.label END AS label FROM n LEFT JOIN o ON o.board_id = n.board_id AND o.content = n.content"""


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence that an ingest of each board answers with."""
    n = F.col("cluster_ord")
    c = _groups(spark, sf_dir, 10).withColumns({"summary_source": F.when(n % 3 == 0, "vision_llm").when(n % 3 == 1, "deterministic").otherwise("cache"), "model_id": F.when(n % 3 == 0, "m")})
    report = refine.quality_report(c).withColumns({"reused": F.col("cached_clusters"), "fallbacks": F.when(F.col("board_id") < "Brand#2", 0).otherwise(F.col("vision_clusters"))})
    return refine.ingest_summary(report, "freeform")


SUMMARY = """WITH c AS (SELECT p_brand AS board_id, p_partkey % 10 AS k FROM part GROUP BY ALL), s AS (SELECT board_id, count(*) AS n, count(*) FILTER (k % 3 = 2) AS cached, CASE WHEN board_id < 'Brand#2' THEN 0 ELSE count(*) FILTER (k % 3 = 0) END AS fell,
  list('"Group ' || k || ' of ' || board_id || '"' ORDER BY k) AS ls FROM c GROUP BY board_id)
SELECT board_id, 'Ingested board ' || board_id || ': ' || n || ' clusters - ' || array_to_string(ls[1:8], ', ') || CASE WHEN n > 8 THEN ', ...' ELSE '' END || ' (docStructureHint=freeform).'
|| CASE WHEN cached > 0 THEN ' Loaded ' || cached || ' clusters from cache. Reused ' || cached || ' unchanged cluster' || CASE WHEN cached = 1 THEN '' ELSE 's' END || ' from the previous ingest.' ELSE '' END
|| CASE WHEN fell > 0 THEN ' ' || fell || ' cluster' || CASE WHEN fell = 1 THEN '' ELSE 's' END || ' used text fallback because vision processing timed out, failed, or exceeded its budget.' ELSE '' END AS summary FROM s"""


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text rules on every document."""
    t = F.col("text")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        "doc_id", T.cut_dots(t, 50).alias("dots"), T.cut_ellipsis(t, 41).alias("ellipsis"), T.cut_append(t, 30).alias("appended"), T.cut_to(t, (F.col("doc_id") % 60).cast("int")).alias("cut"), T.first_sentence(t).alias("sentence"),
        T.escape_markup(F.concat(F.lit("<&"), F.col("lang"), F.lit(">"))).alias("escaped"), T.safe_name(F.concat("source", F.lit(" é/."))).alias("name"), T.format_list(F.array("lang", "source", "lang"), F.col("lang") == "de").alias("listed"),
    )


_TRIM = r"'^[\s\x{FEFF}\p{Z}]+|[\s\x{FEFF}\p{Z}]+$', '', 'g'"
_FIRST = r"regexp_replace(CASE WHEN regexp_matches({0}, '[.!?][\s\x{{FEFF}}\p{{Z}}]') THEN regexp_extract({0}, '^((?s:.)*?[.!?])[\s\x{{FEFF}}\p{{Z}}]', 1) ELSE {0} END, " + _TRIM.replace("{", "{{").replace("}", "}}") + ")"
TEXTS = rf"""SELECT doc_id, CASE WHEN length(text) <= 50 THEN text ELSE substr(text, 1, 47) || '...' END AS dots, CASE WHEN length(text) <= 41 THEN text ELSE substr(text, 1, 40) || '…' END AS ellipsis,
CASE WHEN length(text) <= 30 THEN text ELSE substr(text, 1, 30) || '…' END AS appended,
CASE WHEN doc_id % 60 < 1 THEN '' WHEN length(text) <= doc_id % 60 THEN text WHEN doc_id % 60 = 1 THEN '…' ELSE regexp_replace(substr(text, 1, doc_id % 60 - 1), '[\s\x{{FEFF}}\p{{Z}}]+$', '') || '…' END AS cut,
{_FIRST.format("text")} AS sentence, '&lt;&amp;' || lang || '&gt;' AS escaped, regexp_replace(source || ' é/.', '[^A-Za-z0-9_-]', '_', 'g') AS name,
CASE WHEN lang = source THEN lang ELSE lang || CASE WHEN lang = 'de' THEN ' und ' ELSE ' and ' END || source END AS listed FROM documents"""


def reply_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies parsed in all their wrappings, and times as text, on every event."""
    n = F.col("event_id")
    raw = F.when(n % 4 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(n % 4 == 1, F.concat(F.lit("It is "), F.col("props"), F.lit(" so."))).when(n % 4 == 2, F.col("props")).otherwise("none")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.variant_get(T.parse_json_reply(raw), "$.k", "long").alias("k"), T.iso_seconds(n * 86_399_517).alias("at"))


REPLIES = """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(props->>'$.k' AS BIGINT) END AS k, strftime(make_timestamp(CAST(event_id AS BIGINT) * 86399517000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM events"""


def _extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("source").alias("board_id"), F.col("doc_id").alias("cluster_ord"), F.col("doc_id").cast("string").alias("cluster_id"), F.concat("lang", F.lit(" "), F.col("doc_id").cast("string")).alias("label"), F.col("text").alias("summary"), F.lit(None).cast("string").alias("phase"))


def members_of_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of clusters with their place and node; ids without a node are dropped."""
    nodes = _rows(spark, sf_dir, 7).drop("cluster_id", "pos").where(F.col("id").cast("long") % 6 != 0)
    out = refine.members(_groups(spark, sf_dir), nodes)
    return out.select("board_id", "cluster_id", F.col("pos").cast("long").alias("pos"), "id", "text")


MEMBERS = """WITH c AS (SELECT p_brand AS board_id, 'cluster_' || (p_partkey % 7) AS cluster_id, p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN ' ' || p_name END AS text, row_number() OVER (PARTITION BY p_brand, p_partkey % 7 ORDER BY p_partkey) - 1 AS pos FROM part)
SELECT board_id, cluster_id, pos, CAST(k AS VARCHAR) AS id, text FROM c WHERE k % 6 <> 0"""


def snapshot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards written twice and read back: the latest snapshot of each, and its history without repeats."""
    store = SnapshotStore(spark, new_dir(spark, "snapshots"))
    k = F.col("p_partkey")
    rows = _part(spark, sf_dir).select(F.col("p_brand").alias("board_id"), _text(k).alias("id"), k.alias("n"))
    for stamp, kept in (("a1", rows.where("n % 3 = 0")), ("a1", rows.where("n % 3 > 0")), ("b2", rows.where("n % 2 = 0 AND board_id < 'Brand#3'"))):
        held = kept.withColumn("snapshot_id", F.lit(stamp))
        store.write("nodes", held)
        head = held.select("board_id", "snapshot_id").distinct()
        none = F.lit(None).cast("string")
        store.append_headers(head.select("board_id", "snapshot_id", none.alias("node_hash"), F.lit(0).cast("long").alias("created_at_ms"), none.alias("doc_structure_hint"), none.alias("ingest_mode"), F.array().cast("array<string>").alias("custom_phases")))
    seen = store.history().groupBy("board_id").agg(F.count("*").alias("entries"))
    found = store.read("nodes", store.latest()).groupBy("board_id", "snapshot_id").agg(F.count("*").alias("nodes"), F.sum("n").alias("total"))
    return found.join(seen, "board_id")


STORE = """WITH a AS (SELECT p_brand AS board_id, 'a1' AS snapshot_id, p_partkey AS n FROM part WHERE p_partkey % 3 > 0), b AS (SELECT p_brand, 'b2', p_partkey FROM part WHERE p_partkey % 2 = 0 AND p_brand < 'Brand#3'),
h AS (SELECT board_id, snapshot_id FROM (SELECT p_brand AS board_id, 'a1' AS snapshot_id FROM part UNION SELECT p_brand, 'b2' FROM part WHERE p_partkey % 2 = 0 AND p_brand < 'Brand#3')),
l AS (SELECT board_id, max(snapshot_id) AS snapshot_id, count(*) AS entries FROM h GROUP BY board_id)
SELECT board_id, snapshot_id, count(*) AS nodes, CAST(sum(n) AS BIGINT) AS total, any_value(entries) AS entries FROM (SELECT * FROM a UNION ALL SELECT * FROM b) JOIN l USING (board_id, snapshot_id) GROUP BY board_id, snapshot_id"""


def node_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked geometry of all nodes: centre, radius, whether rotated."""
    from boardlens.plans.catalogue import _part_nodes

    shapes = spatial.footprints(spatial.check_geometry(_part_nodes(spark, sf_dir)))
    return shapes.select("board_id", "id", "cx", "cy", "radius", "rotated")


SHAPES = """SELECT p_brand AS board_id, p_partkey AS id, (p_partkey * 7919) % 4000 + (60 + p_partkey % 180) / 2 AS cx, (p_partkey * 104729) % 3000 + (60 + p_partkey % 120) / 2 AS cy,
(60 + p_partkey % 180 + 60 + p_partkey % 120) / 4 AS radius, p_partkey % 5 = 0 AS rotated FROM part"""

_QUERIES = (
    connector_edges, relation_lines, context_text, retrieve_neighbours, no_match_boards, overview_questions, framework_phases, cluster_changes, diff_statistics, endpoint_labels, inventory_text, reply_merge, reuse_carry, ingest_summary,
    text_rules, reply_rules, members_of_clusters, snapshot_store, node_shapes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "connector_edges": CONNECTORS, "relation_lines": LINES, "context_text": CONTEXT, "retrieve_neighbours": NEIGHBOURS, "no_match_boards": NO_MATCH, "overview_questions": OVERVIEW, "framework_phases": PHASES, "cluster_changes": CHANGES,
        "diff_statistics": STATISTICS, "endpoint_labels": ENDPOINTS, "inventory_text": INVENTORY, "reply_merge": MERGE, "reuse_carry": CARRY, "ingest_summary": SUMMARY, "text_rules": TEXTS, "reply_rules": REPLIES, "members_of_clusters": MEMBERS,
        "snapshot_store": STORE, "node_shapes": SHAPES,
    }
