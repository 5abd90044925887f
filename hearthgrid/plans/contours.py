"""Areas above a probability threshold as multipolygons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthgrid.grid import GridSpec
from hearthgrid.operators.polygons import cell_outline
from hearthgrid.session import materialize

KEY = ["run_id", "horizon_h", "threshold"]


def above_thresholds(forecast: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Cells listed under every threshold they reach."""
    reached = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("p") >= t)
    return forecast.select("run_id", "horizon_h", "i", "j", F.explode(reached).alias("threshold"))


def contour_edges(forecast: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    return cell_outline(above_thresholds(forecast, thresholds), KEY)


def contour_summary(forecast: DataFrame, thresholds: Sequence[float], grid: GridSpec) -> DataFrame:
    """Edge count, area in square degrees (from the edges alone) and bounds per contour."""
    e = contour_edges(forecast, thresholds)
    signed = (F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2.0
    return e.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("edges"), (F.sum(signed) * F.lit(grid.cell * grid.cell)).alias("area_deg2"),
        (F.lit(grid.origin_lon) + F.min("x1") * F.lit(grid.cell)).alias("min_lon"), (F.lit(grid.origin_lat) + F.min("y1") * F.lit(grid.cell)).alias("min_lat"),
        (F.lit(grid.origin_lon) + F.max("x1") * F.lit(grid.cell)).alias("max_lon"), (F.lit(grid.origin_lat) + F.max("y1") * F.lit(grid.cell)).alias("max_lat"))


def _far_end(direction: str) -> tuple[Column, Column]:
    """(x2, y2) of a unit edge from its start (x1, y1) and direction: 0 east, 1 north, 2 west, 3 south."""
    step = lambda plus, minus: F.expr(f"CASE {direction} WHEN {plus} THEN 1 WHEN {minus} THEN -1 ELSE 0 END")
    return F.col("x1") + step(0, 2), F.col("y1") + step(1, 3)


def chained_edges(edges: DataFrame, grid: GridSpec) -> DataFrame:
    """Edges as ``id`` (start corner and direction) with the ``next`` one of their ring and whether the ring turns between them.

    Where two edges leave a corner (cells that touch in it only), the ring turns left and stays with its cell.
    """
    across = grid.n_lon + 1
    corner = lambda x, y: (F.col(y) * across + F.col(x)).cast("long")
    way = F.expr("CASE WHEN x2 > x1 THEN 0 WHEN y2 > y1 THEN 1 WHEN x2 < x1 THEN 2 ELSE 3 END")
    drawn = edges.select(*KEY, corner("x1", "y1").alias("start"), corner("x2", "y2").alias("corner"), way.alias("way"))
    leaving = drawn.groupBy(*KEY, F.col("start").alias("corner")).agg(F.expr("bit_or(shiftleft(1, way))").alias("ways"))
    left, straight = F.pmod(F.col("way") + 1, F.lit(4)), F.col("way")
    has = lambda d: F.getbit(F.col("ways"), d) == 1
    ahead = F.when(has(left), left).when(has(straight), straight).otherwise(F.pmod(F.col("way") + 3, F.lit(4)))
    joined = drawn.join(leaving, [*KEY, "corner"]).withColumn("ahead", ahead)
    return joined.select(*KEY, (F.col("start") * 4 + F.col("way")).alias("id"), (F.col("corner") * 4 + F.col("ahead")).alias("next"), (F.col("ahead") != F.col("way")).alias("turns"))


def labelled_rings(chained: DataFrame, grid: GridSpec) -> DataFrame:
    """Edges (x1, y1, x2, y2, way, turns) with their ``ring``, its smallest edge, and ``off``, the number of edges ahead to that one.

    List ranking by pointer doubling: after round ``k`` an edge knows the smallest of the ``2 ** k`` edges from itself on,
    and the edge behind them. A ring is done when a round finds nothing smaller; every round is one join, written.
    """
    state = materialize(chained.select(*KEY, "id", "turns", F.col("next").alias("jump"), F.col("id").alias("ring"), F.lit(0).cast("long").alias("off"), F.lit(True).alias("better")), "ring-edges")
    hop = 1
    while state.agg(F.max("better")).first()[0]:
        there = state.select(*KEY, F.col("id").alias("jump"), F.col("jump").alias("beyond"), F.col("ring").alias("low"), F.col("off").alias("more"))
        better = F.col("low") < F.col("ring")
        state = materialize(state.drop("better").join(there, [*KEY, "jump"]).select(
            *KEY, "id", "turns", F.col("beyond").alias("jump"), F.least("ring", "low").alias("ring"), F.when(better, F.col("more") + hop).otherwise(F.col("off")).alias("off"), better.alias("better")), "ring-edges")
        hop *= 2
    across = grid.n_lon + 1
    placed = state.withColumns({"way": F.col("id") % 4, "corner": F.expr("id DIV 4")}).withColumns({"x1": F.col("corner") % across, "y1": F.expr(f"corner DIV {across}")})
    x2, y2 = _far_end("way")
    return placed.withColumns({"x2": x2, "y2": y2}).select(*KEY, "ring", "off", "way", "turns", "x1", "y1", "x2", "y2")


def ring_owners(edges: DataFrame, holes: DataFrame) -> DataFrame:
    """(keys, ring, owner): the outer ring that each of ``holes`` (keys, ring) lies in.

    A sweep along each row of cells: left of a hole's leftmost edge its polygon is filled as far as the next edge to the
    left, which is on the same polygon: on its outer ring, or on another hole further left. Chains of holes are
    followed by doubling.
    """
    upright = edges.where("way IN (1, 3)").select(*KEY, "ring", F.col("x1").alias("x"), F.least("y1", "y2").alias("row"))
    before = upright.withColumn("left", F.lag("ring").over(Window.partitionBy(*KEY, "row").orderBy("x")))
    first = before.join(holes, [*KEY, "ring"], "left_semi").groupBy(*KEY, "ring").agg(F.min_by("left", F.struct("x", "row")).alias("owner"))
    links = materialize(first.withColumn("of_hole", F.lit(True)), "hole-links")
    while True:
        up = links.select(*KEY, F.col("ring").alias("owner"), F.col("owner").alias("above"))
        links = materialize(links.drop("of_hole").join(up, [*KEY, "owner"], "left").select(*KEY, "ring", F.coalesce("above", "owner").alias("owner"), F.col("above").isNotNull().alias("of_hole")), "hole-links")
        if not links.agg(F.max("of_hole")).first()[0]:
            return links.drop("of_hole")


def contour_rings(forecast: DataFrame, thresholds: Sequence[float], grid: GridSpec) -> DataFrame:
    """One row per ring: ``ring``, ``owner`` (the outer ring it belongs to), ``hole``, ``cells`` (area within, in cells) and its corners in order.

    Outer rings run counter-clockwise, holes clockwise. ``corners`` starts at the lowest, leftmost one and lists each once.
    """
    edges = materialize(labelled_rings(chained_edges(contour_edges(forecast, thresholds), grid), grid), "rings")
    sizes = edges.groupBy(*KEY, "ring").agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("cells"))
    sizes = materialize(sizes, "ring-sizes")
    # A corner is the far end of an edge; the far end of the last edge is where the ring starts.
    turn = F.expr("CASE off WHEN 1 THEN 0L WHEN 0 THEN 1L ELSE 9223372036854775807L - off END")
    corners = edges.where("turns").groupBy(*KEY, "ring").agg(F.array_sort(F.collect_list(F.struct(turn.alias("turn"), F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("corners"))
    holes = sizes.where("cells < 0").select(*KEY, "ring")
    owners = ring_owners(edges, holes)
    return sizes.join(corners, [*KEY, "ring"]).join(owners, [*KEY, "ring"], "left").select(
        *KEY, "ring", F.coalesce("owner", "ring").alias("owner"), (F.col("cells") < 0).alias("hole"), F.abs("cells").alias("cells"),
        F.transform("corners", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("corners"))


def contour_polygons(forecast: DataFrame, thresholds: Sequence[float], grid: GridSpec) -> DataFrame:
    """(run_id, horizon_h, threshold, polygons): outer rings with their holes, all rings closed.

    Polygons are in the order of their lowest, leftmost corner, holes within a polygon as well.
    """
    place = lambda c: F.struct((F.lit(grid.origin_lon) + c["x"] * F.lit(grid.cell)).alias("lon"), (F.lit(grid.origin_lat) + c["y"] * F.lit(grid.cell)).alias("lat"))
    closed = F.transform(F.concat("corners", F.slice("corners", 1, 1)), place)
    rings = contour_rings(forecast, thresholds, grid).select(*KEY, "owner", "hole", "ring", closed.alias("points"))
    shapes = rings.groupBy(*KEY, "owner").agg(F.array_sort(F.collect_list(F.struct("hole", "ring", "points"))).alias("rings"))
    shapes = shapes.select(*KEY, "owner", F.transform("rings", lambda r: r["points"]).alias("rings"))
    listed = shapes.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("owner", "rings"))).alias("all"))
    return listed.select(*KEY, F.transform("all", lambda p: p["rings"]).alias("polygons"))


def complete_contours(runs: DataFrame, horizons: Sequence[int], thresholds: Sequence[float], polygons: DataFrame) -> DataFrame:
    """One record per run, horizon and threshold, also when the contour is empty (null polygons)."""
    wanted = runs.select("run_id", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_h")).withColumn(
        "threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return wanted.join(polygons, KEY, "left")
