"""Terrain tables: newest version per region, windows with masks, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.grid import GridSpec
from hearthgrid.operators.polygons import slab_of, slabs, with_parity
from hearthgrid.operators.runs import newest_per
from hearthgrid.session import deal


def newest_cells(cells: DataFrame, meta: DataFrame, id_col: str = "terrain_id") -> DataFrame:
    """Cells of the newest version of each region; the ledger is small, the cells are only filtered."""
    newest = newest_per(meta.select("region", "created_at", id_col), ["region"], ["created_at", id_col]).select(id_col)
    return cells.join(newest, id_col, "left_semi")


def clip(cells: DataFrame, grid: GridSpec, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Cells of the box's window, with centre coordinates."""
    w = grid.window(*bbox)
    return cells.where(w.contains(F.col("i"), F.col("j"))).withColumns({"lat": grid.lat_centre(F.col("i")), "lon": grid.lon_centre(F.col("j"))})


def with_region_fallback(regional: DataFrame, base: DataFrame, value: str) -> DataFrame:
    """Regional value where the region has one, else the value of the global base raster."""
    b = base.select("i", "j", F.col(value).alias("_base"))
    return regional.join(b, ["i", "j"], "full_outer").withColumn(value, F.coalesce(value, "_base")).drop("_base")


def stats(cells: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Coverage fraction, range and mean of a raster, flagged below 90 %."""
    return cells.groupBy(*keys).agg(
        F.avg(F.col(value).isNotNull().cast("double")).alias("coverage"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"),
    ).withColumn("poor_coverage", F.col("coverage") < 0.9)


def aoi_windows(aois: DataFrame, terrain: DataFrame, grid: GridSpec, key: str = "aoi_id") -> DataFrame:
    """Terrain of every area's window: slope, aspect, elevation, joint valid flag, in-area flag of the cell centre.

    The window of one area is bounded by the area limit; its cells are generated per row, meet the edges of one
    strip of the area each and the raster in one equi-join on (i, j). Rings are not copied to cells.
    """
    c, lat0, lon0 = F.lit(grid.cell), F.lit(grid.origin_lat), F.lit(grid.origin_lon)
    clipped = lambda x, top: F.greatest(F.lit(0), F.least(x, F.lit(top)))
    i0, i1 = clipped(F.floor((F.col("min_lat") - lat0) / c), grid.n_lat), clipped(F.ceil((F.col("max_lat") - lat0) / c), grid.n_lat)
    j0, j1 = clipped(F.floor((F.col("min_lon") - lon0) / c), grid.n_lon), clipped(F.ceil((F.col("max_lon") - lon0) / c), grid.n_lon)
    shape, listed = slabs(aois, key)
    sized = aois.where((i1 > i0) & (j1 > j0)).select(key, i0.alias("i0"), i1.alias("i1"), j0.alias("j0"), j1.alias("j1"))
    made = sized.agg(F.sum((F.col("i1") - F.col("i0")) * (F.col("j1") - F.col("j0")))).first()[0]
    boxed = sized.select(key, F.explode(F.sequence("i0", F.col("i1") - 1)).alias("i"), "j0", "j1")
    # Both grow with the areas, whatever Spark takes lists made of few rows for: merged, never sent to all tasks.
    strips, listed = shape.select(key, "lat_lo", "height", "slabs").hint("merge"), listed.hint("merge")
    rows = boxed.withColumn("lat", grid.lat_centre(F.col("i"))).join(strips, key, "left").withColumn("slab", slab_of(F.col("lat")))
    cells = deal(rows, made or 0, key, "slab").select(key, "slab", "i", F.explode(F.sequence("j0", F.col("j1") - 1)).alias("j"), "lat").withColumn("lon", grid.lon_centre(F.col("j")))
    masked = with_parity(cells, listed, key).drop("slab").withColumnRenamed("inside", "in_area")
    valid = F.col("z").isNotNull() & F.col("slope_deg").isNotNull()
    return masked.join(terrain.select("i", "j", "z", "slope_deg", "aspect_deg"), ["i", "j"], "left").withColumn("valid", valid)
