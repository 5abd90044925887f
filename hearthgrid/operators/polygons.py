"""Polygons as rings of (lon, lat): measures, containment, cell outlines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.functions.geo import EARTH_RADIUS_M

#: Points and edges of a bin that one task holds at most, about; and rows that it hands on at a time.
ASKED_POINTS, HELD_EDGES, TOLD_ROWS = 1 << 16, 1 << 19, 1 << 18


def vertex_count(rings: str = "rings") -> Column:
    return F.coalesce(F.size(F.flatten(F.col(rings))), F.lit(0))


def edges(polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """One row per edge (x1, y1) -> (x2, y2) of every ring."""
    ring = polygons.select(key, F.posexplode(rings).alias("ring", "points")).where(F.size("points") > 1)
    pairs = F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b"))
    return ring.select(key, "ring", F.posexplode(pairs).alias("edge", "e")).select(
        key, "ring", "edge", F.col("e.a.lon").alias("x1"), F.col("e.a.lat").alias("y1"), F.col("e.b.lon").alias("x2"), F.col("e.b.lat").alias("y2"))


def measures(polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """Bounding box, vertex count and spherical area (outer ring minus holes) in km2."""
    km2 = (EARTH_RADIUS_M / 1000.0) ** 2 / 2.0
    per_ring = edges(polygons, key, rings).groupBy(key, "ring").agg(
        F.abs(F.sum(F.radians(F.col("x2") - F.col("x1")) * (F.lit(2.0) + F.sin(F.radians("y1")) + F.sin(F.radians("y2"))))).alias("twice"),
        F.min("x1").alias("min_lon"), F.min("y1").alias("min_lat"), F.max("x1").alias("max_lon"), F.max("y1").alias("max_lat"),
        (F.count(F.lit(1)) + 1).alias("vertices"),
    )
    signed = F.when(F.col("ring") == 0, F.col("twice")).otherwise(-F.col("twice"))
    return per_ring.groupBy(key).agg(
        F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"),
        F.sum("vertices").alias("vertex_count"), (F.sum(signed) * F.lit(km2)).alias("area_km2"),
    )


def slabs(polygons: DataFrame, key: str, rings: str = "rings") -> tuple[DataFrame, DataFrame]:
    """The slab index: ``(key, lat_lo, lat_hi, lon_lo, lon_hi, slabs, height)`` per polygon, and ``(key, slab, x1, y1, x2, y2)``.

    A polygon is cut into strips of equal height. There are as many as its ``n`` edges allow with at most about ``2 n``
    entries: an edge is listed under each strip it touches, and a strip holds about as many edges as any line of latitude
    meets. Level edges meet no line and are not listed.
    """
    every = edges(polygons, key, rings)
    shape = every.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("y2") - F.col("y1"))).alias("climb"), F.min("y1").alias("lat_lo"), F.max("y1").alias("lat_hi"),
        F.min("x1").alias("lon_lo"), F.max("x1").alias("lon_hi"))
    tall = F.col("lat_hi") - F.col("lat_lo")
    wanted = F.floor(F.col("n") * tall / F.greatest(F.col("climb"), tall))
    shape = shape.withColumn("slabs", F.when(tall > 0, F.greatest(F.lit(1), wanted)).otherwise(F.lit(1)).cast("long")).withColumn("height", tall / F.col("slabs"))
    shape = shape.select(key, "lat_lo", "lat_hi", "lon_lo", "lon_hi", "slabs", "height")
    met = every.where("y1 <> y2").join(shape.select(key, "lat_lo", "slabs", "height"), key)
    listed = met.withColumn("slab", F.explode(F.sequence(slab_of(F.least("y1", "y2")), slab_of(F.greatest("y1", "y2")))))
    return shape, listed.select(key, "slab", "x1", "y1", "x2", "y2")


def slab_of(lat: Column) -> Column:
    """The strip of a latitude, of a row with its polygon's ``lat_lo``, ``height`` and ``slabs``."""
    raw = F.floor((lat - F.col("lat_lo")) / F.nullif(F.col("height"), F.lit(0.0)))
    return F.least(F.greatest(F.coalesce(raw, F.lit(0)), F.lit(0)), F.col("slabs") - 1)


def with_parity(asked: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """``asked`` (columns that can be grouped by, with key, slab, lat, lon) and ``inside``: whether an odd number of edges lies to the east.

    A row meets the edges of its polygon's strip only; crossings are added up in the same task that joined them.
    """
    crosses = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (
        F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    met = asked.join(listed, [key, "slab"], "left")
    return met.groupBy(key, "slab", *[c for c in asked.columns if c not in (key, "slab")]).agg((F.sum(F.when(crosses, 1).otherwise(0)) % 2 == 1).alias("inside"))


def _bin_edges(polygons: DataFrame, key: str, width: str, rings: str) -> DataFrame:
    """What points of a bin meet: ``(bin_i, bin_j, key, box, x1, y1, x2, y2)``, each edge in the bins around it.

    For the bins farther west in the polygon's box the edge lies to the east, whatever the longitude: only the latitudes where that
    starts and stops matter. They are rows without x (from y1 north), and those of edges that meet in a vertex cancel out.
    """
    every = edges(polygons, key, rings)
    shape = every.groupBy(key).agg(*[f(g(f"{c}1", f"{c}2")).alias(f"{name}_{end}") for c, name in (("y", "lat"), ("x", "lon")) for f, g, end in ((F.min, F.least, "lo"), (F.max, F.greatest, "hi"))])
    box = ["lat_lo", "lat_hi", "lon_lo", "lon_hi"]
    number = lambda text: F.expr(f"CAST(floor({text} / {width}) AS BIGINT)")
    # Merged: edges and boxes grow with the polygons, and look as few as they are.
    met = every.where("y1 <> y2").join(shape.hint("merge"), key).withColumns({
        "south": number("least(y1, y2)"), "north": number("greatest(y1, y2)"), "first": number("lon_lo"), "last": number("lon_hi"),
        "west": number("least(x1, x2)") - 1, "east": number("greatest(x1, x2)") + 1})
    rows = met.withColumn("bin_i", F.explode(F.sequence("south", "north")))
    place = ["bin_i", "bin_j", key, *box]
    near = rows.withColumn("bin_j", F.explode(F.sequence(F.greatest("first", "west"), F.least("last", "east")))).select(*place, "x1", "y1", "x2", "y2")
    turns = F.array(F.when(F.col("bin_i") > F.col("south"), F.lit(float("-inf"))).otherwise(F.least("y1", "y2")), F.when(F.col("bin_i") == F.col("north"), F.greatest("y1", "y2")))
    far = rows.where("first < west").withColumn("bin_j", F.explode(F.sequence("first", F.col("west") - 1))).select(*place, F.explode(turns).alias("y1"))
    far = far.where("y1 IS NOT NULL").groupBy(*place, "y1").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").drop("n")
    return near.unionByName(far, allowMissingColumns=True)


def _tell_inside(held: pa.StructArray, asked: pa.StructArray, key: str, keep: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """(kept columns, key) of the asked points inside the held polygons of their bin, in batches of a bounded size."""
    column = lambda rows, c: rows.field(rows.type.get_field_index(c))
    number = lambda rows, c: column(rows, c).to_numpy(zero_copy_only=False)
    points = asked.take(pa.array(np.argsort(number(asked, "_lat"), kind="stable")))
    lat, lon = number(points, "_lat"), number(points, "_lon")
    names = column(held, key).dictionary_encode()
    which = names.indices.to_numpy()
    by_shape = np.argsort(which, kind="stable")
    which = which[by_shape]
    begins = np.flatnonzero(np.diff(which, prepend=-1))
    ends = np.append(begins[1:], len(which))
    x1, y1, x2, y2, lat_lo, lat_hi, lon_lo, lon_hi = (number(held, c)[by_shape] for c in ("x1", "y1", "x2", "y2", "lat_lo", "lat_hi", "lon_lo", "lon_hi"))
    far = column(held, "x1").is_null().to_numpy(zero_copy_only=False)[by_shape]
    # An edge crosses the latitudes from its lower end to below its upper one; rows are in their order.
    start = np.searchsorted(lat, np.where(far, y1, np.minimum(y1, y2)), "left")
    stop = np.where(far, len(lat), np.searchsorted(lat, np.maximum(y1, y2), "left"))
    low, high = np.searchsorted(lat, lat_lo[begins], "left"), np.searchsorted(lat, lat_hi[begins], "right")
    rise, run = y2 - y1, x2 - x1
    rows, shapes, ready = [], [], 0

    def batch() -> pa.RecordBatch:
        index = pa.array(np.concatenate(rows))
        owner = pa.array(np.repeat(np.array([n for n, _ in shapes], np.int32), [n for _, n in shapes]))
        return pa.RecordBatch.from_arrays([*[column(points, c).take(index) for c in keep], names.dictionary.take(owner)], [*keep, key])

    for p in np.flatnonzero(low < high):
        a, b, first, last = low[p], high[p], begins[p], ends[p]
        odd = np.zeros(b - a, dtype=bool)
        for e in range(first, last):
            s, t = max(start[e], a), min(stop[e], b)
            if s >= t:
                continue
            if far[e]:
                np.logical_not(odd[s - a:t - a], out=odd[s - a:t - a])
            else:
                odd[s - a:t - a] ^= lon[s:t] < run[e] * (lat[s:t] - y1[e]) / rise[e] + x1[e]
        inside = np.flatnonzero(odd) + a
        at = lon[inside]
        inside = inside[(at >= lon_lo[first]) & (at <= lon_hi[first])]
        if len(inside):
            rows.append(inside)
            shapes.append((which[first], len(inside)))
            ready += len(inside)
            if ready >= TOLD_ROWS:
                yield batch()
                rows, shapes, ready = [], [], 0
    if ready:
        yield batch()


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: str, bin_deg: float = 0.5, rings: str = "rings", keep: Sequence[str] | None = None,
                       asked_points: int = ASKED_POINTS, held_edges: int = HELD_EDGES) -> DataFrame:
    """(kept point columns, key) for every polygon that holds the point, by even-odd crossings. ``keep`` is all columns by default.

    Points and edges are dealt out by bin, and what lies in a polygon is told in the task that holds both: pairs are never dealt out,
    written or grouped. A task holds the edges of one bin, listed for its polygons, and so many of its points; bins with more points or
    edges are cut up, each part of the points meeting each part of the polygons. Points that repeat are repeated in the result.
    """
    keep = list(points.columns if keep is None else keep)
    width = f"{bin_deg!r}D"
    listed = _bin_edges(polygons, key, width, rings)
    placed = points.where("lat IS NOT NULL AND lon IS NOT NULL").select(
        F.expr(f"CAST(floor(lat / {width}) AS BIGINT)").alias("bin_i"), F.expr(f"CAST(floor(lon / {width}) AS BIGINT)").alias("bin_j"),
        F.struct(*keep, F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon")).alias("point"))
    place = ["bin_i", "bin_j"]

    def parts(rows: DataFrame, most: int, name: str) -> DataFrame:
        return rows.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / most).alias(name)).where(F.col(name) > 1)

    busy = parts(placed, asked_points, "point_parts").join(parts(listed, held_edges, "edge_parts"), place, "full_outer")
    cut = lambda rows: rows.join(busy, place, "left").fillna(1, ["point_parts", "edge_parts"])
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    right = cut(placed).withColumn("point_part", F.expr("pmod(xxhash64(point), point_parts)")).withColumn("edge_part", each("edge_parts"))
    left = cut(listed).withColumn("edge_part", F.pmod(F.xxhash64(key), F.col("edge_parts"))).withColumn("point_part", each("point_parts"))
    unit = [*place, "point_part", "edge_part"]
    edge = F.struct(key, "lat_lo", "lat_hi", "lon_lo", "lon_hi", "x1", "y1", "x2", "y2")
    both = left.select(*unit, F.lit(0).alias("kind"), edge.alias("edge")).unionByName(right.select(*unit, F.lit(1).alias("kind"), "point"), allowMissingColumns=True)
    # Few bytes, much work behind each: dealt to all tasks (a fixed count is not merged away again at run time).
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), points.sparkSession.sparkContext.defaultParallelism)
    dealt = both.repartition(tasks, *unit).sortWithinPartitions(*unit, "kind").select(*unit, "kind", "edge", "point")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in [*[points.schema[c] for c in keep], polygons.schema[key]]])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, asked = None, [], []
        for batch in batches:
            units = np.stack([batch.column(n).to_numpy() for n in range(len(unit))], axis=1)
            kind = batch.column(len(unit)).to_numpy()
            starts = np.flatnonzero(np.append(True, (units[1:] != units[:-1]).any(axis=1)))[:len(units)]
            for first, last in zip(starts, np.append(starts[1:], len(units))):
                now = tuple(units[first])
                if now != here:
                    if held and asked:
                        yield from _tell_inside(pa.concat_arrays(held), pa.concat_arrays(asked), key, keep)
                    here, held, asked = now, [], []
                edges_end = first + int(np.searchsorted(kind[first:last], 1))
                if edges_end > first:
                    held.append(batch.column(len(unit) + 1).slice(first, edges_end - first))
                if last > edges_end and held:  # edges come first: points of a bin without any need not be kept
                    asked.append(batch.column(len(unit) + 2).slice(edges_end, last - edges_end))
        if held and asked:
            yield from _tell_inside(pa.concat_arrays(held), pa.concat_arrays(asked), key, keep)

    return dealt.mapInArrow(tell, schema)


def cell_outline(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Directed boundary edges of the union of unit cells (i, j), per key.

    Each cell gives four directed edges (interior on the left); an edge shared by two cells appears in
    both directions and cancels in one grouped count.
    """
    sides = F.expr(
        "array(named_struct('x1', j, 'y1', i, 'x2', j + 1, 'y2', i), named_struct('x1', j + 1, 'y1', i, 'x2', j + 1, 'y2', i + 1), "
        "named_struct('x1', j + 1, 'y1', i + 1, 'x2', j, 'y2', i + 1), named_struct('x1', j, 'y1', i + 1, 'x2', j, 'y2', i))"
    )
    directed = cells.select(*keys, F.explode(sides).alias("e")).select(*keys, "e.*")
    marked = directed.withColumns({
        "ax": F.least("x1", "x2"), "ay": F.least("y1", "y2"), "bx": F.greatest("x1", "x2"), "by": F.greatest("y1", "y2")})
    return (
        marked.groupBy(*keys, "ax", "ay", "bx", "by")
        .agg(F.count(F.lit(1)).alias("sides"), *[F.min(c).alias(c) for c in ("x1", "y1", "x2", "y2")])
        .where("sides = 1").select(*keys, "x1", "y1", "x2", "y2")
    )
