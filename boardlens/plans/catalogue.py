"""The registered queries over the given tables and their DuckDB SQL.

The tables hold no boards, so each query derives its input from them with
integer arithmetic that both engines share. Queries of the read side are in
:mod:`boardlens.plans.readside`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardlens.functions import text as T
from boardlens.operators import diff, graph, history, phases, refine, retrieve, spatial, tree
from boardlens.plans import readside

QUESTION = "there enan there ation"
TOPICS = ("enan", "zzqq")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("board_id"), F.col("doc_id").alias("cluster_ord"), F.col("doc_id").cast("string").alias("cluster_id"), F.col("lang").alias("label"), F.col("text").alias("summary"), F.lit(None).cast("string").alias("phase"))


def _part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    d = lambda c: c.cast("double")
    return _table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("board_id"), k.alias("ord"), k.alias("id"), F.col("p_name").alias("name"), F.lit("STICKY").alias("type"),
        d((k * 7919) % 4000).alias("x"), d((k * 104729) % 3000).alias("y"), d(60 + k % 180).alias("width"), d(60 + k % 120).alias("height"),
        F.when(k % 5 == 0, 30.0).otherwise(0.0).alias("rotation"),
        F.when(F.col("p_size") % 10 == 0, F.col("p_type")).alias("image_ref"), F.when(k % 3 != 0, F.col("p_name")).alias("text"),
        F.lit(None).cast("string").alias("parent_id"),
    )


_NODES = """nodes AS (SELECT p_brand AS board_id, p_partkey AS id, ((p_partkey * 7919) % 4000)::DOUBLE AS x, ((p_partkey * 104729) % 3000)::DOUBLE AS y,
  (60 + p_partkey % 180)::DOUBLE AS w, (60 + p_partkey % 120)::DOUBLE AS h, p_partkey % 5 = 0 AS rot, p_size % 10 = 0 AS img,
  CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS text, p_name AS name FROM part),
shapes AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy, (w + h) / 4 AS r FROM nodes),
gaps AS (SELECT a.board_id, a.id AS a, b.id AS b, CASE WHEN a.rot OR b.rot
    THEN greatest(0, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) - a.r - b.r)
    ELSE sqrt(pow(greatest(0, a.x - (b.x + b.w), b.x - (a.x + a.w)), 2) + pow(greatest(0, a.y - (b.y + b.h), b.y - (a.y + a.h)), 2)) END AS gap
  FROM shapes a JOIN shapes b ON a.board_id = b.board_id AND a.id <> b.id),
pairs AS (SELECT board_id, a, b FROM gaps WHERE a < b AND gap <= 160)"""
_COMPONENTS = f"""{_NODES}, both_ways AS (SELECT board_id, a, b FROM pairs UNION SELECT board_id, b, a FROM pairs),
reach(board_id, n, m) AS (SELECT board_id, id, id FROM nodes UNION SELECT r.board_id, r.n, e.b FROM reach r JOIN both_ways e ON e.board_id = r.board_id AND e.a = r.m),
comp AS (SELECT board_id, n AS id, min(m) AS part FROM reach GROUP BY ALL)"""


def topk_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best documents of each board for a question."""
    found = retrieve.primaries(_doc_clusters(spark, sf_dir), QUESTION)
    return found.select("board_id", F.col("cluster_ord").alias("doc_id"), F.col("score").cast("long").alias("score"), F.col("place").cast("long").alias("place"))


def _score_sql(words: list[str]) -> str:
    hit = lambda c, w: f"CASE WHEN contains(lower(coalesce({c}, '')), '{w}') THEN 1 ELSE 0 END"
    return " + ".join(f"2 * {hit('lang', w)} + {hit('text', w)}" for w in words)


TOPK = f"""WITH s AS (SELECT source AS board_id, doc_id, CAST({_score_sql(["there", "enan", "there", "ation"])} AS BIGINT) AS score FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0)
SELECT board_id, doc_id, score, place FROM r WHERE place <= 6"""


def topic_filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each board that a topic selects; whole boards where it selects none."""
    c = _doc_clusters(spark, sf_dir)
    out = [retrieve.filter_topic(c, t).select(F.lit(t).alias("topic"), "board_id", F.col("cluster_ord").alias("doc_id"), "fallback") for t in TOPICS]
    return out[0].unionByName(out[1])


TOPIC = " UNION ALL ".join(
    f"""SELECT '{t}' AS topic, board_id, doc_id, NOT hit AS fallback FROM (SELECT source AS board_id, doc_id,
  contains(lower(lang || ' ' || text), '{t}') AS m, bool_or(contains(lower(lang || ' ' || text), '{t}')) OVER (PARTITION BY source) AS hit FROM documents) WHERE m OR NOT hit"""
    for t in TOPICS
)
PHASES = {"rising": ("tion", "enan"), "turning": ("ation", "ouer"), "falling": ("sche", "there"), "resting": ("ción", "for the")}


def phase_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by phase: most keyword points, unclear on ties."""
    words = spark.createDataFrame([(i, p, k) for i, (p, ks) in enumerate(PHASES.items()) for k in ks], "phase_ord int, phase string, keyword string")
    return phases.classify(_doc_clusters(spark, sf_dir), words).select(F.col("cluster_ord").alias("doc_id"), "phase")


_POINTS = {p: " + ".join(f"CASE WHEN contains(lower(lang), '{k}') THEN 2 ELSE 0 END + CASE WHEN contains(lower(text), '{k}') THEN 1 ELSE 0 END" for k in ks) for p, ks in PHASES.items()}
PHASE = (
    "WITH s AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{p}' AS phase, {e} AS score FROM documents" for p, e in _POINTS.items())
    + "), t AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM s) SELECT doc_id, CASE WHEN max(top) > 0 AND count(*) FILTER (score = top) = 1 THEN max(phase) FILTER (score = top) ELSE 'unclear' END AS phase FROM t GROUP BY doc_id"
)


def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German or English by marker words."""
    c = _table(spark, sf_dir, "conversations")
    german, english = T.language_scores(F.col("text"))
    return c.select("conv_id", "turn", german.cast("long").alias("german"), english.cast("long").alias("english"), T.is_german(F.col("text")).alias("is_german"))


def _in(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


LANGUAGE = f"""WITH w AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM conversations),
s AS (SELECT conv_id, turn, CAST(len(list_filter(ws, lambda x: list_contains({_in(T.GERMAN_MARKERS)}, x))) + CASE WHEN regexp_matches(lower(text), '[äöüß]') THEN 2 ELSE 0 END AS BIGINT) AS german,
  CAST(len(list_filter(ws, lambda x: list_contains({_in(T.ENGLISH_MARKERS)}, x))) AS BIGINT) AS english FROM w)
SELECT conv_id, turn, german, english, german > english AS is_german FROM s"""


def _line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    order = Window.partitionBy("l_orderkey").orderBy(*rest)
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", *rest).withColumn("next", F.lead("l_partkey").over(order)).where("next IS NOT NULL")
    return li.select(F.lit("all").alias("board_id"), F.col("l_orderkey").alias("ord"), F.col("l_partkey").cast("string").alias("from_node_id"), F.col("next").cast("string").alias("to_node_id"), F.col("l_returnflag").alias("label"))


def _brand_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_list(F.col("p_partkey").cast("string")).alias("node_ids"))
    return p.select(F.lit("all").alias("board_id"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("cluster_ord"), F.col("p_brand").alias("cluster_id"), "node_ids")


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cluster_relations(_line_edges(spark, sf_dir), _brand_clusters(spark, sf_dir))


def cluster_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands joined by consecutive parts of orders: counts and labels."""
    r = _relations(spark, sf_dir)
    return r.select("from_cluster_id", "to_cluster_id", F.array_join(F.sort_array("labels"), ",").alias("labels"), F.col("edge_count").cast("long").alias("edge_count"))


_EDGES = """e AS (SELECT l_orderkey, l_partkey AS f, l_returnflag AS label, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS t FROM lineitem),
rel AS (SELECT a.p_brand AS from_cluster_id, b.p_brand AS to_cluster_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, count(*) AS edge_count
  FROM e JOIN part a ON a.p_partkey = f JOIN part b ON b.p_partkey = t WHERE a.p_brand <> b.p_brand GROUP BY ALL)"""
RELATIONS = f"WITH {_EDGES} SELECT * FROM rel"


def one_hop_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands one relation of a certain strength away from two given ones."""
    strong = _relations(spark, sf_dir).where("edge_count % 7 = 0")
    first = spark.createDataFrame([("all", "Brand#11"), ("all", "Brand#23")], "board_id string, cluster_id string")
    return graph.one_hop(first, strong).select("cluster_id")


ONE_HOP = f"""WITH {_EDGES}, s AS (SELECT * FROM rel WHERE edge_count % 7 = 0), p(c) AS (VALUES ('Brand#11'), ('Brand#23')),
n AS (SELECT to_cluster_id AS cluster_id FROM s JOIN p ON c = from_cluster_id UNION SELECT from_cluster_id FROM s JOIN p ON c = to_cluster_id)
SELECT cluster_id FROM n WHERE cluster_id NOT IN (SELECT c FROM p)"""


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: _table(spark, sf_dir, n)
    none = F.lit(None).cast("string")
    row = lambda df, kid, parent, pos, kind, text=none: df.select(F.lit("all").alias("board_id"), kid.alias("id"), parent.alias("parent_id"), pos.cast("int").alias("pos"), kind.alias("type"), text.alias("text"), none.alias("image_ref"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    sticky = F.col("o_orderkey") % 20 == 0
    return (
        row(t("region"), key("r", "r_regionkey"), none, F.col("r_regionkey"), F.lit("CANVAS"))
        .unionByName(row(t("nation"), key("n", "n_nationkey"), key("r", "n_regionkey"), F.col("n_nationkey"), F.lit("SECTION")))
        .unionByName(row(t("customer"), key("c", "c_custkey"), key("n", "c_nationkey"), F.col("c_custkey"), F.lit("GROUP")))
        .unionByName(row(t("orders"), key("o", "o_orderkey"), key("c", "o_custkey"), F.col("o_orderkey"), F.when(sticky, "STICKY").otherwise("FRAME"), F.when(sticky, F.col("o_orderpriority"))))
    )


def tree_flatten_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A five-level hierarchy flattened in pre-order, bare structure pruned."""
    kept = tree.prune(tree.flatten_levels(_hierarchy(spark, sf_dir)))
    return kept.select("id", "parent_id", "type", F.array_join(F.transform("path", lambda p: p.cast("string")), "/").alias("path"))


TREE = """WITH RECURSIVE rows AS (
  SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_regionkey AS pos, 'CANVAS' AS type FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, 'SECTION' FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, 'GROUP' FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN 'STICKY' ELSE 'FRAME' END FROM orders),
flat AS (SELECT id, parent_id, type, CAST(pos AS VARCHAR) AS path, [id] AS anc FROM rows WHERE parent_id IS NULL
  UNION ALL SELECT r.id, r.parent_id, r.type, f.path || '/' || r.pos, list_append(f.anc, r.id) FROM rows r JOIN flat f ON f.id = r.parent_id),
kept AS (SELECT DISTINCT unnest(anc) AS id FROM flat WHERE type NOT IN ('DOCUMENT', 'CANVAS', 'PAGE', 'FRAME', 'GROUP', 'SECTION'))
SELECT id, parent_id, type, path FROM flat WHERE id IN (SELECT id FROM kept)"""


def leaf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchy rows that are nobody's parent and have a size."""
    h = _hierarchy(spark, sf_dir)
    n = F.regexp_extract("id", "([0-9]+)", 1).cast("long")
    sized = h.withColumns({"width": (n % 3).cast("double"), "height": (n % 2).cast("double")})
    return tree.clusterable_leaves(sized).select("id", "type")


LEAF = TREE.split("flat AS")[0].rstrip().rstrip(",").replace("WITH RECURSIVE", "WITH") + """
SELECT id, type FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM rows) WHERE id NOT IN (SELECT parent_id FROM rows WHERE parent_id IS NOT NULL) AND (n % 3 > 0 OR n % 2 > 0)"""
DOCUMENT = """{"document": {"id": "0:0", "name": "Document", "type": "DOCUMENT", "children": [{"id": "0:1", "name": "Page", "type": "CANVAS", "children": [
{"id": "1:2", "name": "Sticky", "type": "STICKY", "absoluteBoundingBox": {"x": 10, "y": 20, "width": 100, "height": 80}, "characters": "Hello"},
{"id": "1:3", "name": "Group", "type": "GROUP", "absoluteBoundingBox": {"x": 200, "y": 20, "width": 50, "height": 50}, "children": [
  {"id": "1:4", "name": "Sticky", "type": "STICKY", "absoluteBoundingBox": {"x": 205, "y": 25, "width": 40, "height": 40}, "characters": "World"}]},
{"id": "1:5", "name": "Sticky", "type": "STICKY", "rotation": 45, "absoluteBoundingBox": {"x": 400, "y": 20, "width": 120, "height": 120}, "characters": "Tilted"},
{"id": "1:6", "name": "Picture", "type": "SHAPE_WITH_TEXT", "absoluteBoundingBox": {"x": 600, "y": 20, "width": 300, "height": 200}, "fills": [{"type": "SOLID"}, {"type": "IMAGE", "imageRef": "img-ref-abc123"}]},
{"id": "1:7", "name": "Empty", "type": "FRAME", "absoluteBoundingBox": {"x": 1000, "y": 20, "width": 100, "height": 100}},
{"id": "1:8", "name": "Section", "type": "SECTION", "absoluteBoundingBox": {"x": 1200, "y": 20, "width": 400, "height": 400}, "children": [{"id": "1:9", "name": "Group", "type": "GROUP"}]},
{"id": "1:10", "name": "Table", "type": "TABLE", "absoluteBoundingBox": {"x": 1700, "y": 20, "width": 300, "height": 150}, "children": [{"id": "1:11", "name": "Cell", "type": "TABLE_CELL", "characters": "a"}]}]}]}}"""


def flatten_one_document(spark: SparkSession) -> DataFrame:
    """The raw document above flattened from VARIANT."""
    docs = spark.createDataFrame([("board", DOCUMENT)], "board_id string, raw string").select("board_id", F.parse_json("raw").alias("doc"))
    return tree.flatten_documents(docs).select("ord", "id", "type", "parent_id", "rotation", "image_ref", "text", "x", "width")


def tree_flatten_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw documents, a region each, with nations as pages and customers as notes, tables or empty frames, flattened from VARIANT."""
    t = lambda n: _table(spark, sf_dir, n)
    k = F.col("c_custkey")
    box = F.struct(k.cast("double").alias("x"), F.lit(2.0).alias("y"), F.lit(100.0).alias("width"), F.lit(80.0).alias("height"))
    cell = F.when(k % 5 == 0, F.array(F.struct(F.concat(F.lit("t"), k.cast("string")).alias("id"), F.lit("Cell").alias("name"), F.lit("TABLE_CELL").alias("type"), F.lit("in").alias("characters"))))
    kind = F.when(k % 5 == 0, "TABLE").when(k % 7 == 0, "FRAME").otherwise("STICKY")
    fills = F.when(k % 3 == 0, F.array(F.struct(F.lit("SOLID").alias("type"), F.lit("no").alias("imageRef")), F.struct(F.lit("IMAGE").alias("type"), F.concat(F.lit("img"), k.cast("string")).alias("imageRef"))))
    note = F.struct(F.concat(F.lit("c"), k.cast("string")).alias("id"), F.lit("Note").alias("name"), kind.alias("type"), box.alias("absoluteBoundingBox"), fills.alias("fills"), F.when((k % 7 != 0) & (k % 5 != 0), F.col("c_name")).alias("characters"), cell.alias("children"))
    notes = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", note.alias("n")))), lambda s: s["n"]).alias("children"))
    page = F.struct(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit("CANVAS").alias("type"), "children")
    pages = t("nation").join(notes, "n_nationkey", "left").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", page.alias("p")))), lambda s: s["p"]).alias("children"))
    root = F.struct(F.struct(F.lit("0:0").alias("id"), F.lit("DOCUMENT").alias("type"), "children").alias("document"))
    docs = pages.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("board_id"), F.parse_json(F.to_json(root)).alias("doc"))
    return tree.flatten_documents(docs).select("board_id", "ord", "id", "type", "parent_id", "image_ref", "text", "x", "width")


VARIANT = """WITH kept AS (SELECT 'r' || n_regionkey AS board_id, n_nationkey AS n, c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'TABLE' WHEN c_custkey % 7 = 0 THEN 'FRAME' ELSE 'STICKY' END AS type,
    CASE WHEN c_custkey % 3 = 0 THEN 'img' || c_custkey END AS image_ref, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 THEN c_name END AS text FROM customer JOIN nation ON n_nationkey = c_nationkey),
c AS (SELECT * FROM kept WHERE type <> 'FRAME' OR image_ref IS NOT NULL),
rows AS (SELECT board_id, n, k, 'c' || k AS id, type, 'n' || n AS parent_id, image_ref, text, CAST(k AS DOUBLE) AS x, 100.0::DOUBLE AS width FROM c
  UNION ALL SELECT DISTINCT board_id, n, -1, 'n' || n, 'CANVAS', '0:0', NULL, NULL, 0.0::DOUBLE, 0.0::DOUBLE FROM c)
SELECT board_id, row_number() OVER (PARTITION BY board_id ORDER BY n, k) - 1 AS ord, id, type, parent_id, image_ref, text, x, width FROM rows"""


def spatial_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node pairs of each board within 160."""
    return spatial.near_pairs(_part_nodes(spark, sf_dir), gap=160)


PAIRS = f"WITH {_NODES} SELECT board_id, a, b FROM pairs"


def wide_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs where nodes over six cells are compared with their board."""
    return spatial.near_pairs(_part_nodes(spark, sf_dir), gap=160, max_cells=6)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.single_linkage(_part_nodes(spark, sf_dir), gap=160)


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the near pairs (every node is in one)."""
    return _parts(spark, sf_dir).select("board_id", "id", "part")


COMPONENTS = f"WITH RECURSIVE {_COMPONENTS} SELECT board_id, id, part FROM comp"


def cluster_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes of the components, numbered in reading order."""
    boxes = spatial.cluster_boxes(_parts(spark, sf_dir).withColumn("split", F.lit("")))
    return boxes.select("board_id", F.col("cluster_ord").cast("long").alias("n"), *[F.col(f"bounding_box.{c}").alias(c) for c in ("x", "y", "width", "height")], F.size("node_ids").cast("long").alias("members"))


BOXES = f"""WITH RECURSIVE {_COMPONENTS}, b AS (SELECT c.board_id, part, min(x) AS x, min(y) AS y, max(x + w) AS x1, max(y + h) AS y1, min(c.id) AS first, count(*) AS members
  FROM comp c JOIN nodes n ON n.id = c.id GROUP BY ALL)
SELECT board_id, row_number() OVER (PARTITION BY board_id ORDER BY y, x, first) AS n, x, y, x1 - x AS width, y1 - y AS height, members FROM b"""


def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap that each board's own spacing suggests."""
    return spatial.adaptive_gap(_part_nodes(spark, sf_dir)).select("board_id", F.round("gap", 6).alias("gap"))


ADAPTIVE = f"""WITH {_NODES}, c AS (SELECT board_id, id, count(*) OVER (PARTITION BY board_id) AS n, row_number() OVER (PARTITION BY board_id ORDER BY id) - 1 AS i FROM nodes),
s AS (SELECT *, greatest(1, n // 150) AS stride FROM c), m AS (SELECT s.board_id, s.id, min(gap) AS g FROM s JOIN gaps ON gaps.board_id = s.board_id AND a = s.id WHERE n >= 12 AND i % stride = 0 GROUP BY ALL),
l AS (SELECT board_id, list_sort(list(g)) AS gs FROM m WHERE g > 0.5 GROUP BY board_id), t AS (SELECT board_id, max(n) AS n, max(stride) AS stride FROM s GROUP BY board_id)
SELECT t.board_id, round(CASE WHEN n >= 12 AND len(gs) >= (n / stride) / 4 THEN greatest(96.0, least(320.0, 3 * gs[len(gs) // 2 + 1])) ELSE 160.0 END, 6)::DOUBLE AS gap FROM t LEFT JOIN l USING (board_id)"""


def adaptive_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards clustered by the gap that their own spacing suggests, parts left whole."""
    boxes = spatial.cluster(_part_nodes(spark, sf_dir), adaptive=True, max_size=1 << 40)
    return boxes.select("board_id", F.col("cluster_ord").cast("long").alias("n"), *[F.col(f"bounding_box.{c}").alias(c) for c in ("x", "y", "width", "height")], F.size("node_ids").cast("long").alias("members"))


ADAPTED = f"""WITH RECURSIVE {ADAPTIVE[len("WITH "):].split("SELECT t.board_id")[0].rstrip()},
tuned AS (SELECT t.board_id, CASE WHEN n >= 12 AND len(gs) >= (n / stride) / 4 THEN greatest(96.0, least(320.0, 3 * gs[len(gs) // 2 + 1])) ELSE 160.0 END AS gap FROM t LEFT JOIN l USING (board_id)),
near AS (SELECT gaps.board_id, a, b FROM gaps JOIN tuned USING (board_id) WHERE gaps.gap <= tuned.gap),
reach(board_id, n, m) AS (SELECT board_id, id, id FROM nodes UNION SELECT r.board_id, r.n, e.b FROM reach r JOIN near e ON e.board_id = r.board_id AND e.a = r.m),
comp AS (SELECT board_id, n AS id, min(m) AS part FROM reach GROUP BY ALL),
boxes AS (SELECT comp.board_id, part, min(x) AS x, min(y) AS y, max(x + w) AS x1, max(y + h) AS y1, min(comp.id) AS first, count(*) AS members FROM comp JOIN nodes ON nodes.id = comp.id GROUP BY ALL)
SELECT board_id, row_number() OVER (PARTITION BY board_id ORDER BY y, x, first) AS n, x, y, x1 - x AS width, y1 - y AS height, members FROM boxes"""


def bisect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each board as one part, halved until no part is over 8: part sizes."""
    members = _part_nodes(spark, sf_dir).withColumn("part", F.lit(0))
    half = spatial.bisect(members, max_size=8)
    return half.groupBy("board_id", "split").agg(F.count("*").alias("members"))


HALVES = f"""WITH RECURSIVE {_NODES.split("gaps AS")[0].rstrip().rstrip(",")},
r(board_id, id, x, y, w, h, cx, cy, split, lvl) AS (SELECT board_id, id, x, y, w, h, cx, cy, '', 0 FROM shapes
  UNION ALL SELECT board_id, id, x, y, w, h, cx, cy, split || CASE WHEN k <= ceil(n / 2) THEN '0' ELSE '1' END, lvl + 1 FROM (
    SELECT *, row_number() OVER (PARTITION BY board_id, split ORDER BY CASE WHEN wide THEN cx ELSE cy END, CASE WHEN wide THEN cy ELSE cx END, CAST(id AS VARCHAR)) AS k FROM (
      SELECT *, count(*) OVER p AS n, max(x + w) OVER p - min(x) OVER p >= max(y + h) OVER p - min(y) OVER p AS wide FROM r WINDOW p AS (PARTITION BY board_id, split)) WHERE n > 8)),
f AS (SELECT board_id, id, arg_max(split, lvl) AS split FROM r GROUP BY ALL)
SELECT board_id, split, count(*) AS members FROM f GROUP BY ALL"""


def bisect_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One halving of each board across its longer side."""
    nodes = _part_nodes(spark, sf_dir).withColumn("part", F.lit(0))
    most = nodes.groupBy("board_id").count().agg(F.max("count")).first()[0]
    half = spatial.bisect(nodes, max_size=max(1, -(-most // 2)))
    return half.where(F.length("split") > 0).groupBy("board_id", "split").agg(F.count("*").alias("members"), F.sum("id").alias("ids"))


BISECT = f"""WITH {_NODES}, s AS (SELECT *, count(*) OVER p AS n, max(x + w) OVER p - min(x) OVER p >= max(y + h) OVER p - min(y) OVER p AS wide FROM shapes WINDOW p AS (PARTITION BY board_id)),
m AS (SELECT max(n) AS most FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY CASE WHEN wide THEN cx ELSE cy END, CASE WHEN wide THEN cy ELSE cx END, CAST(id AS VARCHAR)) AS k FROM s)
SELECT board_id, CASE WHEN k <= ceil(n / 2) THEN '0' ELSE '1' END AS split, count(*) AS members, CAST(sum(id) AS BIGINT) AS ids FROM r, m WHERE n > greatest(1, ceil(most / 2)) GROUP BY ALL"""


def _part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part_nodes(spark, sf_dir).withColumns({"cluster_id": F.concat(F.lit("cluster_"), (F.col("ord") % 7).cast("string")), "pos": F.col("ord")})
    return refine.cluster_facts(rows)


def vision_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which clusters go to a vision model, and which are due."""
    q = refine.vision_queue(_part_facts(spark, sf_dir)).withColumn("due", refine.wants_vision("balanced"))
    return q.select("board_id", "cluster_id", "n_images", "text_length", F.col("queue").cast("long").alias("queue"), "due")


_FACTS = f"""{_NODES}, f AS (SELECT board_id, 'cluster_' || (id % 7) AS cluster_id, CAST(count(*) AS BIGINT) AS n_nodes, CAST(count(text) AS BIGINT) AS n_texts, CAST(count(*) FILTER (img) AS BIGINT) AS n_images,
  CAST(coalesce(sum(length(trim(text))), 0) AS BIGINT) AS text_length, list(trim(text) ORDER BY id) FILTER (text IS NOT NULL) AS texts,
  list(trim(name) ORDER BY id) FILTER (trim(name) <> '' AND NOT regexp_matches(trim(name), '(?i)^(sticky|text|rectangle|ellipse|shape|connector|section|group|frame|table)( \\d+)?$')) AS names FROM nodes GROUP BY ALL)"""
VISION = f"WITH {_FACTS} SELECT board_id, cluster_id, n_images, text_length, row_number() OVER (PARTITION BY board_id ORDER BY (n_images > 0) DESC, text_length, n_images DESC, cluster_id) AS queue, n_images > 0 OR text_length < 40 AS due FROM f"


def screenshot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six nodes of each cluster to take pictures of."""
    rows = _part_nodes(spark, sf_dir).withColumns({"cluster_id": F.concat(F.lit("cluster_"), (F.col("ord") % 7).cast("string")), "id": F.col("id").cast("string")})
    return refine.screenshot_nodes(rows).select("board_id", "cluster_id", "id", F.col("shot").cast("long").alias("shot"))


SHOTS = f"WITH {_NODES}, r AS (SELECT board_id, 'cluster_' || (id % 7) AS cluster_id, CAST(id AS VARCHAR) AS id, row_number() OVER (PARTITION BY board_id, id % 7 ORDER BY img DESC, w * h DESC, CAST(id AS VARCHAR)) AS shot FROM nodes) SELECT * FROM r WHERE shot <= 6"


def deterministic_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and summaries by text rules."""
    return refine.deterministic(_part_facts(spark, sf_dir)).select("board_id", "cluster_id", "label", "summary")


REFINE = f"""WITH {_FACTS}, l AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(coalesce(texts[1], names[1]), '\\s+', ' ', 'g'), '^["'']', ''), '["'']$', '') AS flat FROM f),
m AS (SELECT *, array_to_string(list_filter(string_split(trim(flat), ' '), lambda w: w <> '')[1:6], ' ') AS short FROM l)
SELECT board_id, cluster_id, CASE WHEN coalesce(texts[1], names[1]) IS NULL THEN 'Cluster ' || substr(cluster_id, 9) WHEN length(short) <= 60 THEN short ELSE substr(short, 1, 57) || '...' END AS label,
'Cluster contains ' || n_nodes || ' board element' || CASE WHEN n_nodes = 1 THEN '' ELSE 's' END || ' with ' || n_texts || ' extracted text item' || CASE WHEN n_texts = 1 THEN '' ELSE 's' END || '. ' ||
CASE WHEN n_texts > 0 THEN 'Extracted text highlights: ' || array_to_string(list_transform(texts[1:5], lambda t: '"' || CASE WHEN length(t) <= 120 THEN t ELSE substr(t, 1, 117) || '...' END || '"'), '; ') || '.' ELSE 'No readable text was extracted from this cluster.' END ||
CASE WHEN n_images > 0 THEN ' It includes ' || n_images || ' image element' || CASE WHEN n_images = 1 THEN '' ELSE 's' END || ' that were not visually described because timeout-safe fallback was used.' ELSE '' END ||
' The source node IDs are retained for follow-up context.' AS summary FROM m"""


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the clusters' summaries came about, by board."""
    c = _doc_clusters(spark, sf_dir)
    n = F.col("cluster_ord")
    c = c.withColumns({"summary_source": F.when(n % 3 == 0, "vision_llm").when(n % 3 == 1, "deterministic").otherwise("cache"), "model_id": F.when(n % 3 == 0, F.concat(F.lit("model-"), (n % 4).cast("string")))})
    r = refine.quality_report(c)
    return r.select("board_id", "deterministic_clusters", "vision_clusters", "cached_clusters", F.array_join("models_used", ",").alias("models_used"))


QUALITY = """WITH c AS (SELECT source AS board_id, doc_id AS n, doc_id % 3 AS k, CASE WHEN doc_id % 3 = 0 THEN 'model-' || (doc_id % 4) END AS m FROM documents),
u AS (SELECT board_id, string_agg(m, ',' ORDER BY o) AS models_used FROM (SELECT board_id, m, min(n) AS o FROM c WHERE m IS NOT NULL GROUP BY ALL) GROUP BY board_id)
SELECT c.board_id, count(*) FILTER (k = 1) AS deterministic_clusters, count(*) FILTER (k = 0) AS vision_clusters, count(*) FILTER (k = 2) AS cached_clusters, coalesce(any_value(models_used), '') AS models_used
FROM c LEFT JOIN u USING (board_id) GROUP BY c.board_id"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = _table(spark, sf_dir, "documents")
    node = lambda df, text: df.select(F.col("source").alias("board_id"), F.col("doc_id").cast("string").alias("id"), F.lit("STICKY").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image_ref"), F.col("doc_id").alias("ord"))
    k = F.col("doc_id")
    before = node(d.where(k % 13 != 0), F.col("text"))
    after = node(d.where(k % 10 != 0), F.when(k % 7 == 0, F.concat(F.col("text"), F.lit(" edited"))).otherwise(F.concat(F.col("text"), F.lit("  "))))
    return before, after


def node_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents added, removed and edited between two versions."""
    return diff.node_changes(*_versions(spark, sf_dir))


NODE_DIFF = """WITH b AS (SELECT source AS board_id, CAST(doc_id AS VARCHAR) AS id, trim(text, E' \\t\\n\\r') AS t FROM documents WHERE doc_id % 13 <> 0),
a AS (SELECT source AS board_id, CAST(doc_id AS VARCHAR) AS id, trim(CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text || '  ' END, E' \\t\\n\\r') AS t FROM documents WHERE doc_id % 10 <> 0)
SELECT coalesce(a.board_id, b.board_id) AS board_id, coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'edited' END AS change
FROM b FULL JOIN a ON a.board_id = b.board_id AND a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.t <> b.t"""


def content_hash_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which clusters of a new version have the content of an earlier one."""
    before, after = _versions(spark, sf_dir)
    by = lambda df: refine.content_hash(df.withColumn("cluster_id", F.floor(F.col("ord") / 40).cast("string")), "board_id", "cluster_id")
    old = by(before).select("board_id", "content_hash").distinct().withColumn("hit", F.lit(True))
    new = by(after).join(old, ["board_id", "content_hash"], "left")
    return new.select("board_id", "cluster_id", F.col("n_members"), F.coalesce("hit", F.lit(False)).alias("reused"))


REUSE = NODE_DIFF.split("\nSELECT")[0] + """, g AS (SELECT board_id, CAST(floor(CAST(id AS BIGINT) / 40) AS BIGINT) AS c, list([id, t] ORDER BY id) AS content, count(*) AS n FROM a GROUP BY ALL),
o AS (SELECT DISTINCT board_id, content FROM (SELECT board_id, floor(CAST(id AS BIGINT) / 40) AS c, list([id, t] ORDER BY id) AS content FROM b GROUP BY ALL))
SELECT g.board_id, CAST(c AS VARCHAR) AS cluster_id, n AS n_members, o.content IS NOT NULL AS reused FROM g LEFT JOIN o ON o.board_id = g.board_id AND o.content = g.content"""


def _clusterings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    side = lambda c: p.groupBy(F.col("p_brand").alias("board_id"), c.cast("int").alias("cluster_ord")).agg(F.collect_list(k.cast("string")).alias("node_ids")).withColumn("cluster_id", F.concat(F.lit("cluster_"), F.col("cluster_ord").cast("string")))
    return side(F.floor(k / 100) % 9), side(F.floor((k + 30) / 100) % 9)


def cluster_match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster pairs of two clusterings that share half of the smaller one."""
    return diff.candidate_pairs(*_clusterings(spark, sf_dir)).select("board_id", "b_id", "a_id", "overlap")


CANDIDATES = """WITH b AS (SELECT p_brand AS board_id, (p_partkey // 100) % 9 AS c, p_partkey AS k FROM part), a AS (SELECT p_brand AS board_id, ((p_partkey + 30) // 100) % 9 AS c, p_partkey AS k FROM part),
bs AS (SELECT board_id, c, count(*) AS n FROM b GROUP BY ALL), s AS (SELECT board_id, c, count(*) AS n FROM a GROUP BY ALL),
o AS (SELECT b.board_id, b.c AS bc, a.c AS ac, count(*) AS overlap FROM b JOIN a USING (board_id, k) GROUP BY ALL)
SELECT o.board_id, 'cluster_' || bc AS b_id, 'cluster_' || ac AS a_id, overlap FROM o JOIN bs ON bs.board_id = o.board_id AND bs.c = bc JOIN s ON s.board_id = o.board_id AND s.c = ac WHERE overlap / least(bs.n, s.n) >= 0.5"""


def cluster_match_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches of the two clusterings."""
    return diff.greedy_match(diff.candidate_pairs(*_clusterings(spark, sf_dir))).select("board_id", "b_id", "a_id", "overlap")


GREEDY = f"""WITH RECURSIVE {CANDIDATES[len("WITH "):].split("SELECT o.board_id")[0].rstrip()}, cand AS (SELECT o.board_id, bc, ac, overlap, row_number() OVER (PARTITION BY o.board_id ORDER BY overlap DESC, bc, ac) AS i
  FROM o JOIN bs ON bs.board_id = o.board_id AND bs.c = bc JOIN s ON s.board_id = o.board_id AND s.c = ac WHERE overlap / least(bs.n, s.n) >= 0.5),
g(board_id, i, ub, ua, hit) AS (SELECT DISTINCT board_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), false FROM cand
  UNION ALL SELECT x.board_id, x.j, CASE WHEN free THEN list_append(ub, bc) ELSE ub END, CASE WHEN free THEN list_append(ua, ac) ELSE ua END, free
  FROM (SELECT g.*, c.i AS j, bc, ac, NOT list_contains(ub, bc) AND NOT list_contains(ua, ac) AS free FROM g JOIN cand c ON c.board_id = g.board_id AND c.i = g.i + 1) x)
SELECT cand.board_id, 'cluster_' || bc AS b_id, 'cluster_' || ac AS a_id, overlap FROM cand JOIN g ON g.board_id = cand.board_id AND g.i = cand.i WHERE hit"""


def connection_bag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges added and removed between two versions, as bags."""
    e = _line_edges(spark, sf_dir)
    out = diff.connection_changes(e.where("ord % 3 <> 0"), e.where("ord % 4 <> 0"))
    return out.select("from_node_id", "to_node_id", "label", "change", "n")


BAG = f"""WITH {_EDGES.split(chr(10) + "rel AS")[0].rstrip(",")}, g AS (SELECT CAST(f AS VARCHAR) AS from_node_id, CAST(t AS VARCHAR) AS to_node_id, label, count(*) FILTER (l_orderkey % 4 <> 0) - count(*) FILTER (l_orderkey % 3 <> 0) AS more FROM e WHERE t IS NOT NULL GROUP BY ALL)
SELECT from_node_id, to_node_id, label, CASE WHEN more > 0 THEN 'added' ELSE 'removed' END AS change, abs(more) AS n FROM g WHERE more <> 0"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("board_id"), F.row_number().over(order).cast("long").alias("seq"), F.col("event_type").alias("cache_key"))


_HISTORY = """h AS (SELECT user_id AS board_id, event_type AS cache_key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
d AS (SELECT * FROM (SELECT *, lag(cache_key) OVER (PARTITION BY board_id ORDER BY seq) AS p FROM h) WHERE p IS DISTINCT FROM cache_key),
n AS (SELECT board_id, seq, cache_key, row_number() OVER (PARTITION BY board_id ORDER BY seq DESC) AS age FROM d)"""


def history_dedupe_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History without adjacent repeats, the newest twenty."""
    return history.append(_history(spark, sf_dir))


def history_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry three before the newest."""
    return history.nth_back(_history(spark, sf_dir), 3)


def _gc_inputs(spark: SparkSession, sf_dir: str):
    h = _history(spark, sf_dir)
    two = F.col("board_id") - F.col("board_id") % 2  # two boards share their keys
    h = h.withColumn("cache_key", F.concat(F.regexp_replace("cache_key", "_", ""), (F.col("seq") % 29).cast("string"), F.lit("u"), two.cast("string")))
    kept = history.append(h)
    pointers = kept.groupBy("board_id").agg(F.min_by("cache_key", "seq").alias("cache_key")).withColumn("schema_version", F.when(F.col("board_id") % 2 == 0, 3).otherwise(2))
    return history.dropped(h), h.groupBy("cache_key").agg(F.min("board_id").alias("board_id")), kept, pointers


def snapshot_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that fell off the cap and nothing refers to."""
    dropped, owners, kept, pointers = _gc_inputs(spark, sf_dir)
    return history.collectable(dropped, owners, kept, pointers)


GC = """WITH h AS (SELECT user_id AS board_id, seq, replace(event_type, '_', '') || (seq % 29) || 'u' || (user_id - user_id % 2) AS cache_key FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)),
d AS (SELECT * FROM (SELECT *, lag(cache_key) OVER (PARTITION BY board_id ORDER BY seq) AS p FROM h) WHERE p IS DISTINCT FROM cache_key),
n AS (SELECT board_id, seq, cache_key, row_number() OVER (PARTITION BY board_id ORDER BY seq DESC) AS age FROM d),
k AS (SELECT * FROM n WHERE age <= 20), x AS (SELECT DISTINCT board_id, cache_key FROM n WHERE age > 20 AND (board_id, cache_key) NOT IN (SELECT (board_id, cache_key) FROM k)),
o AS (SELECT cache_key, min(board_id) AS owner FROM h GROUP BY ALL), p AS (SELECT board_id, arg_min(cache_key, seq) AS cache_key FROM k GROUP BY ALL)
SELECT x.board_id, x.cache_key FROM x JOIN o USING (cache_key) WHERE owner = x.board_id AND regexp_full_match(x.cache_key, '[a-z0-9]{1,64}')
AND x.cache_key NOT IN (SELECT cache_key FROM k) AND x.cache_key NOT IN (SELECT cache_key FROM p WHERE board_id % 2 = 0)"""


def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each board from its best documents."""
    c = _doc_clusters(spark, sf_dir).withColumn("label", F.concat("label", F.lit(" "), "cluster_id"))
    out = retrieve.extractive_answer(c, QUESTION)
    return out.select("board_id", "answer", F.array_join("cited", "; ").alias("cited"))


_FIRST = readside._FIRST.format("text")
EXTRACT = f"""WITH s AS (SELECT source AS board_id, doc_id, lang || ' ' || doc_id AS label, {_FIRST} AS first, CAST({_score_sql(["there", "enan", "there", "ation"])} AS BIGINT) AS score FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0),
a AS (SELECT board_id, list(label ORDER BY place) AS ls, list(first ORDER BY place) FILTER (first <> '') AS fs FROM r WHERE place <= 6 GROUP BY board_id)
SELECT b.board_id, CASE WHEN ls IS NULL THEN 'The answer is not supported by the cached board context.' ELSE regexp_replace('Based on the board, the project is mainly about ' || CASE WHEN len(ls) = 1 THEN ls[1] ELSE array_to_string(ls[1:-2], ', ') || ' and ' || ls[-1] END || '. ' || array_to_string(coalesce(fs, [])[1:4], ' '), {readside._TRIM}) END AS answer,
coalesce(array_to_string(ls, '; '), '') AS cited FROM (SELECT DISTINCT source AS board_id FROM documents) b LEFT JOIN a USING (board_id)"""


def budget_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each board's best documents rendered within 2,000 characters."""
    c = _doc_clusters(spark, sf_dir)
    none = spark.createDataFrame([], "board_id string, from_cluster_id string, to_cluster_id string, labels array<string>, edge_count int, first_ord long")
    found = retrieve.retrieve(c, none, QUESTION)
    out = retrieve.render_context(found, none, 2000)
    return out.select("board_id", "text", F.length("text").cast("long").alias("n_chars"), F.size("included").cast("long").alias("included"))


_CUT = r"CASE WHEN {n} < 1 THEN '' WHEN length(line) <= {n} THEN line WHEN {n} = 1 THEN '…' ELSE regexp_replace(substr(line, 1, {n} - 1), '[\s\x{{FEFF}}\p{{Z}}]+$', '') || '…' END"
_LEFT = "least(2000 - length(text) - CASE WHEN text = '' THEN 0 ELSE 1 END, per)"
_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
RENDER = f"""WITH RECURSIVE {TOPK[len("WITH "):].split("SELECT board_id, doc_id, score")[0].rstrip()}, c AS (SELECT r.board_id, place, '- ' || {_ESCAPED.format("lang")} || ': ' || {_ESCAPED.format("text")} AS line, CAST(greatest(160, 2000 // least(6, count(*) OVER (PARTITION BY r.board_id))) AS BIGINT) AS per
  FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE place <= 6),
g(board_id, place, text, shown, ended) AS (SELECT DISTINCT board_id, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), false FROM c
  UNION ALL SELECT board_id, place + 1, CASE WHEN stop THEN text WHEN text = '' THEN cut ELSE text || E'\\n' || cut END, shown + CASE WHEN stop THEN 0 ELSE 1 END, stop
  FROM (SELECT *, ended OR room < 1 OR cut = '' AS stop FROM (SELECT g.*, {_LEFT} AS room, {_CUT.format(n=_LEFT)} AS cut FROM g JOIN c ON c.board_id = g.board_id AND c.place = g.place + 1)))
SELECT board_id, arg_max(text, place) AS text, CAST(length(arg_max(text, place)) AS BIGINT) AS n_chars, arg_max(shown, place) AS included FROM g GROUP BY board_id"""


def url_key_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board keys of page addresses."""
    p = _table(spark, sf_dir, "pages")
    made = F.concat(F.when(F.col("page_id") % 5 == 0, "http").otherwise("https"), F.lit("://www.boards.example"), F.when(F.col("page_id") % 7 == 0, ":8080").otherwise(""), F.lit("/board/Key"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.when(F.col("page_id") % 3 == 0, "/name").when(F.col("page_id") % 11 == 0, "/a/b").otherwise(""))
    return p.select("page_id", T.file_key(made, "boards.example").alias("key"), T.file_key(F.col("url"), "boards.example").alias("page_key"))


URL = """SELECT page_id, CASE WHEN page_id % 5 = 0 OR page_id % 7 = 0 OR (page_id % 3 <> 0 AND page_id % 11 = 0) THEN NULL ELSE 'Key' || lpad(CAST(page_id AS VARCHAR), 6, '0') END AS key, CAST(NULL AS VARCHAR) AS page_key FROM pages"""

_QUERIES = (
    topk_retrieval, topic_filter_fallback, phase_classify, language_guess, cluster_relations, one_hop_neighbours, leaf_filter, tree_flatten_prune, tree_flatten_variant, spatial_pairs, wide_pairs, connected_components, cluster_boxes,
    adaptive_threshold, adaptive_clusters, bisect, bisect_round, vision_priority, screenshot_topk, deterministic_refine, quality_report, content_hash_reuse, node_diff, cluster_match_candidates, cluster_match_greedy, connection_bag_diff,
    history_dedupe_cap, history_nth, snapshot_gc, extractive_answer, budget_render, url_key_extract,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES} | readside.queries()


def oracle_sql() -> dict[str, str]:
    return readside.oracle_sql() | {
        "tree_flatten_variant": VARIANT, "wide_pairs": PAIRS, "adaptive_clusters": ADAPTED, "bisect": HALVES, "cluster_match_greedy": GREEDY, "extractive_answer": EXTRACT, "budget_render": RENDER,
        "topk_retrieval": TOPK, "topic_filter_fallback": TOPIC, "phase_classify": PHASE, "language_guess": LANGUAGE, "cluster_relations": RELATIONS, "one_hop_neighbours": ONE_HOP, "leaf_filter": LEAF, "tree_flatten_prune": TREE,
        "spatial_pairs": PAIRS, "connected_components": COMPONENTS, "cluster_boxes": BOXES, "adaptive_threshold": ADAPTIVE, "bisect_round": BISECT, "vision_priority": VISION, "screenshot_topk": SHOTS, "deterministic_refine": REFINE,
        "quality_report": QUALITY, "content_hash_reuse": REUSE, "node_diff": NODE_DIFF, "cluster_match_candidates": CANDIDATES, "connection_bag_diff": BAG,
        "history_dedupe_cap": f"WITH {_HISTORY} SELECT board_id, seq, cache_key FROM n WHERE age <= 20", "history_nth": f"WITH {_HISTORY} SELECT board_id, seq, cache_key FROM n WHERE age = 4", "snapshot_gc": GC, "url_key_extract": URL,
    }
