"""Spatial clustering of boards: similarity self-join on a grid, components, bisection, numbering.

Two nodes are near if their gap is at most the threshold: the distance of their
boxes, or of their discs as soon as one of them is rotated. The join never
compares all nodes of a board: nodes are hashed to the grid cells that their
bounds touch (disc and box both, on boards with a rotated node), joined by cell,
and a pair is tested in the first cell that both touch only, so no distinct is
needed. Cells double from level to level: a node over more than ``max_cells``
cells goes up to the first level where it touches no more, a pair meets on the
higher of its nodes' levels, and nodes are hashed on their own level and on the
higher ones that their board uses.

Single linkage does not need all near pairs, whose number grows with the square
of a board's density. Nodes that touch one fine cell, whose diagonal is less
than the gap, are near, so a cell joins all its nodes by a star; only nodes in
different parts after that are paired, in the cells where such nodes meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlens.functions import validate
from boardlens.operators.components import connected_components
from boardlens.sources.scratch import materialise

# Fixed values.
DEFAULT_GAP, MIN_NODES, STRIDE_TARGET, MIN_GAP, FACTOR, LEAST, MOST = 160.0, 12, 150, 0.5, 3.0, 96.0, 320.0
MAX_CLUSTER, MAX_CELLS, MIN_CELL, ROTATED = 250, 4096, 128.0, 1e-6

#: Cells that a node may touch on every level, however large they are.
LEAST_CELLS = 4

#: Side of a fine cell by the gap (its diagonal is 0.99 gaps), and fine cells that a node's star takes at most (a node over more is left to the pairs).
FINE, FINE_CELLS = 0.7, 64


def check_geometry(nodes: DataFrame) -> DataFrame:
    """``nodes`` with rows that fail at run time where a size is negative or a number not finite."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    fine = (F.col("width") >= 0) & (F.col("height") >= 0)
    for c in ("x", "y", "width", "height", "rotation"):
        fine = fine & finite(F.col(c))
    centre = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    fine = fine & finite(centre[0]) & finite(centre[1]) & finite(F.col("width") + F.col("height"))
    return nodes.where(F.when(F.coalesce(fine, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid geometry of node "), F.col("id").cast("string"))).cast("boolean")))


def footprints(nodes: DataFrame) -> DataFrame:
    """Centre, radius and whether rotated, beside the nodes' columns."""
    return nodes.withColumns(
        {
            "cx": F.col("x") + F.col("width") / 2,
            "cy": F.col("y") + F.col("height") / 2,
            "radius": (F.col("width") + F.col("height")) / 4,
            "rotated": F.abs("rotation") > ROTATED,
        }
    )


def footprint_gap(a: str, b: str) -> Column:
    """Gap of two footprint structs named a and b."""
    g = lambda s, c: F.col(f"{s}.{c}")
    dx = F.greatest(F.lit(0.0), g(a, "x") - (g(b, "x") + g(b, "width")), g(b, "x") - (g(a, "x") + g(a, "width")))
    dy = F.greatest(F.lit(0.0), g(a, "y") - (g(b, "y") + g(b, "height")), g(b, "y") - (g(a, "y") + g(a, "height")))
    discs = F.greatest(F.lit(0.0), F.hypot(g(a, "cx") - g(b, "cx"), g(a, "cy") - g(b, "cy")) - g(a, "radius") - g(b, "radius"))
    return F.when(g(a, "rotated") | g(b, "rotated"), discs).otherwise(F.hypot(dx, dy))


_SHAPE = ("id", "ord", "x", "y", "width", "height", "cx", "cy", "radius", "rotated")


def _with_discs(nodes: DataFrame, gap: Column | float) -> DataFrame:
    """Footprints with ``gap`` and ``discs`` (whether the board has a rotated node)."""
    g = gap if isinstance(gap, Column) else F.lit(validate.gap(gap))
    f = footprints(nodes).withColumn("gap", g)
    return f.join(f.groupBy("board_id").agg(F.max("rotated").alias("discs")), "board_id")


def near_pairs(nodes: DataFrame, *, gap: Column | float = DEFAULT_GAP, max_cells: int = MAX_CELLS, apart: str | None = None) -> DataFrame:
    """(board_id, a, b) of the pairs within ``gap`` (a number, or a column of ``nodes``), a before b in board order.

    ``apart``: a column that tells nodes known to be joined; only pairs that
    differ in it are sought, and a and b are its values.
    """
    validate.positive_integer("max_cells", max_cells)
    f = _with_discs(nodes, gap)
    side = F.greatest(F.lit(MIN_CELL), F.col("gap"))
    half = F.col("gap") / 2
    low = lambda c, m: F.when(F.col("discs"), F.least(F.col(c), F.col(m) - F.col("radius"))).otherwise(F.col(c)) - half
    high = lambda c, s, m: F.when(F.col("discs"), F.greatest(F.col(c) + F.col(s), F.col(m) + F.col("radius"))).otherwise(F.col(c) + F.col(s)) + half
    f = f.withColumns({"x0": F.floor(low("x", "cx") / side), "y0": F.floor(low("y", "cy") / side), "x1": F.floor(high("x", "width", "cx") / side), "y1": F.floor(high("y", "height", "cy") / side)})
    up = lambda c, level: F.call_function("shiftright", F.col(c), level)
    span = lambda a, b, level: (up(b, level) - up(a, level) + 1).cast("double")
    many = lambda level: span("x0", "x1", level) * span("y0", "y1", level) > max(max_cells, LEAST_CELLS)
    top = F.ceil(F.log2(F.greatest(span("x0", "x1", F.lit(0)), span("y0", "y1", F.lit(0))))).cast("int")  # two cells a side at most
    name = apart or "id"
    f = f.withColumn("level", F.when(many(F.lit(0)), F.size(F.filter(F.sequence(F.lit(1), top), many)) + 1).otherwise(0))
    f = f.select("board_id", "gap", *_SHAPE[1:], F.col(name).alias("name"), "x0", "y0", "x1", "y1", "level")
    shape = F.struct(*_SHAPE[1:], "name")  # made after rows are dealt out
    used = f.groupBy("board_id").agg(F.collect_set("level").alias("levels"))
    dealt = f.join(used, "board_id").withColumn("at", F.explode(F.filter("levels", lambda level: level >= F.col("level")))).drop("levels")
    dealt = dealt.withColumns({c: up(c, F.col("at")) for c in ("x0", "y0", "x1", "y1")})
    dealt = dealt.withColumn("gx", F.explode(F.sequence("x0", "x1"))).withColumn("gy", F.explode(F.sequence("y0", "y1"))).drop("x1", "y1")
    cell = ["board_id", "at", "gx", "gy"]
    other = F.expr("a.ord < b.ord")
    if apart:
        other = F.expr("a.name < b.name")
        mixed = dealt.groupBy(*cell).agg(F.min("name").alias("p"), F.max("name").alias("q")).where("p <> q")
        # Written first: few cells are mixed as a rule, and of a table the planner knows whether it is small enough to be sent to all.
        mixed = materialise(mixed.select(*cell), "mixed-cells")
        dealt = dealt.join(mixed, cell, "left_semi")
    else:
        # By a given number: cells are small but pairs of theirs many, so tasks are not to be merged by the size of what they read.
        dealt = dealt.repartition(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell)
    a = dealt.select("gap", *cell, shape.alias("a"), F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("level").alias("a_level"))
    b = dealt.select(*cell, shape.alias("b"), F.col("x0").alias("bx"), F.col("y0").alias("by"), F.col("level").alias("b_level"))
    close = footprint_gap("a", "b") <= F.col("gap")
    first_cell = (F.col("gx") == F.greatest("ax", "bx")) & (F.col("gy") == F.greatest("ay", "by")) & (F.col("at") == F.greatest("a_level", "b_level"))
    met = a.join(b, cell).where(first_cell & other & close)
    return met.select("board_id", F.col("a.name").alias("a"), F.col("b.name").alias("b"))


def cell_stars(nodes: DataFrame, *, gap: Column | float = DEFAULT_GAP) -> DataFrame:
    """(board_id, a, b) of some near pairs that join all nodes touching a fine cell: one pair for a node and cell.

    A cell joins its boxes that are not rotated, and, where a rotated node's disc
    touches it, all nodes whose discs do (one of them rotated makes a pair's gap
    that of the discs).
    """
    f = _with_discs(nodes, gap).where("gap > 0").withColumn("side", F.lit(FINE) * F.col("gap"))
    at = lambda c: F.floor(c / F.col("side"))

    def dealt(rows: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
        rows = rows.withColumns({"x0": at(x0), "y0": at(y0), "x1": at(x1), "y1": at(y1)})
        few = (F.col("x1") - F.col("x0") + 1).cast("double") * (F.col("y1") - F.col("y0") + 1).cast("double") <= FINE_CELLS
        return rows.where(few).withColumn("gx", F.explode(F.sequence("x0", "x1"))).withColumn("gy", F.explode(F.sequence("y0", "y1")))

    r = F.col("radius")
    boxes = dealt(f.where(~F.col("rotated")), F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height"))
    discs = dealt(f.where("discs"), F.col("cx") - r, F.col("cy") - r, F.col("cx") + r, F.col("cy") + r)
    side = F.col("side")
    off = lambda c, g: F.greatest(F.lit(0.0), F.col(g) * side - F.col(c), F.col(c) - (F.col(g) + 1) * side)
    discs = discs.where(F.hypot(off("cx", "gx"), off("cy", "gy")) <= r)
    rows = boxes.select("board_id", F.lit(0).alias("kind"), "gx", "gy", "id", F.lit(True).alias("heads")).unionByName(discs.select("board_id", F.lit(1).alias("kind"), "gx", "gy", "id", F.col("rotated").alias("heads")))
    cell = ["board_id", "kind", "gx", "gy"]
    head = rows.where("heads").groupBy(*cell).agg(F.min("id").alias("head"))
    return rows.join(head, cell).where("id <> head").select("board_id", F.col("id").alias("a"), F.col("head").alias("b"))


def single_linkage(nodes: DataFrame, *, gap: Column | float = DEFAULT_GAP, max_cells: int = MAX_CELLS) -> DataFrame:
    """``nodes`` with ``part``: the smallest id that steps of near pairs lead to."""

    def joined(rows: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        found = connected_components(pairs, keys=("board_id",)).select("board_id", F.col("node").alias(name), "component")
        return rows.join(found, ["board_id", name], "left").withColumn("part", F.coalesce("component", name)).drop("component")

    starred = joined(nodes, cell_stars(nodes, gap=gap), "id")
    starred = materialise(starred.select(*nodes.columns, "part"), "linkage")
    rest = near_pairs(starred, gap=gap, max_cells=max_cells, apart="part").distinct()
    return joined(starred.withColumnRenamed("part", "star"), rest, "star").select(*nodes.columns, "part")


def adaptive_gap(nodes: DataFrame) -> DataFrame:
    """(board_id, gap): three times the upper-middle nearest gap of every stride-th node, clamped."""
    w = Window.partitionBy("board_id")
    f = footprints(nodes).withColumns({"n": F.count("*").over(w), "i": F.row_number().over(w.orderBy("ord")) - 1})
    f = f.withColumn("stride", F.greatest(F.lit(1), F.floor(F.col("n") / STRIDE_TARGET)))
    boards = f.groupBy("board_id").agg(F.max("n").alias("n"), F.max("stride").alias("stride"))
    shape = F.struct(*_SHAPE)
    sample = f.where((F.col("n") >= MIN_NODES) & (F.col("i") % F.col("stride") == 0)).select("board_id", shape.alias("a"))
    pairs = sample.join(f.where(F.col("n") >= MIN_NODES).select("board_id", shape.alias("b")), "board_id").where("a.ord <> b.ord")
    nearest = pairs.select("board_id", F.col("a.ord").alias("o"), footprint_gap("a", "b").alias("g")).groupBy("board_id", "o").agg(F.min("g").alias("g")).where(F.col("g") > MIN_GAP)
    kept = nearest.groupBy("board_id").agg(F.sort_array(F.collect_list("g")).alias("gs"))  # at most 2 * STRIDE_TARGET values
    k = F.size("gs")
    value = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), FACTOR * F.get("gs", F.floor(k / 2).cast("int"))))
    enough = F.col("gs").isNotNull() & (k >= (F.col("n") / F.col("stride")) / 4) & (k > 0)
    return boards.join(kept, "board_id", "left").select("board_id", F.when((F.col("n") >= MIN_NODES) & enough, value).otherwise(F.lit(DEFAULT_GAP)).alias("gap"))


def bisect(members: DataFrame, *, max_size: int = MAX_CLUSTER) -> DataFrame:
    """``members`` (board_id, part, id, ord and box) with ``split``: the halves taken until no part is over ``max_size``.

    A part is cut across the longer side of its box (x if equal) at half its
    members in order of centre, other centre, id; all parts are cut in one round.
    """
    validate.positive_integer("max_size", max_size)
    state = footprints(members).withColumn("split", F.lit(""))
    while True:
        part = Window.partitionBy("board_id", "part", "split")
        sized = state.withColumn("_n", F.count("*").over(part))
        if not sized.where(F.col("_n") > max_size).limit(1).count():
            return state.drop("cx", "cy", "radius", "rotated")
        wide = F.max(F.col("x") + F.col("width")).over(part) - F.min("x").over(part)
        tall = F.max(F.col("y") + F.col("height")).over(part) - F.min("y").over(part)
        sized = sized.withColumn("_x", wide >= tall)
        order = part.orderBy(F.when(F.col("_x"), F.col("cx")).otherwise(F.col("cy")), F.when(F.col("_x"), F.col("cy")).otherwise(F.col("cx")), F.collate(F.col("id").cast("string"), "UNICODE"), "ord")
        rank = F.row_number().over(order)
        sized = sized.withColumn("_rank", rank)
        half = F.when(F.col("_rank") <= F.ceil(F.col("_n") / 2), "0").otherwise("1")
        split = F.when(F.col("_n") > max_size, F.concat("split", half)).otherwise(F.col("split"))
        state = materialise(sized.withColumn("split", split).drop("_n", "_x", "_rank"), "bisect")


def cluster_boxes(members: DataFrame) -> DataFrame:
    """Clusters of members (board_id, part, split, ...): box, node_ids, and their number in reading order."""
    boxes = members.groupBy("board_id", "part", "split").agg(
        F.min("x").alias("bx"),
        F.min("y").alias("by"),
        F.max(F.col("x") + F.col("width")).alias("x1"),
        F.max(F.col("y") + F.col("height")).alias("y1"),
        F.min("ord").alias("first"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda s: s["id"]).alias("node_ids"),
    )
    order = Window.partitionBy("board_id").orderBy("by", "bx", "first", "split")
    boxes = boxes.withColumn("cluster_ord", F.row_number().over(order))
    box = F.struct(F.col("bx").alias("x"), F.col("by").alias("y"), (F.col("x1") - F.col("bx")).alias("width"), (F.col("y1") - F.col("by")).alias("height"))
    return boxes.select("board_id", "cluster_ord", F.concat(F.lit("cluster_"), F.col("cluster_ord").cast("string")).alias("cluster_id"), "node_ids", box.alias("bounding_box"))


def cluster(nodes: DataFrame, *, gap: float | None = None, adaptive: bool = False, max_size: int = MAX_CLUSTER, max_cells: int = MAX_CELLS) -> DataFrame:
    """Clusters of all boards: single linkage within the gap, large ones bisected, numbered in reading order."""
    nodes = check_geometry(nodes)
    if adaptive and gap is None:
        members = single_linkage(nodes.join(adaptive_gap(nodes), "board_id"), gap=F.col("gap"), max_cells=max_cells).drop("gap")
    else:
        members = single_linkage(nodes, gap=DEFAULT_GAP if gap is None else gap, max_cells=max_cells)
    return cluster_boxes(bisect(members, max_size=max_size))
