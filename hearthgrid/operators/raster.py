"""Raster tables: point look-ups, bilinear sampling, windows, gradients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgrid.grid import GridSpec, GridWindow

METRES_PER_DEGREE = 111320.0  # fixed value used for cell sizes of terrain gradients


def sample_cell(points: DataFrame, raster: DataFrame, grid: GridSpec, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Value of the cell that holds the point; null outside the raster."""
    located = points.withColumns({"i": grid.row(F.col("lat")), "j": grid.col(F.col("lon"))})
    values = raster.select(*keys, "i", "j", F.col(value).alias(out))
    return located.join(values, [*keys, "i", "j"], "left").drop("i", "j")


def quads(raster: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """The four corner values z00, z01, z10, z11 of every square between nodes.

    Done once on the raster side, so sampling points need a single equi-join and no regrouping.
    """
    corners = F.expr(
        "array(named_struct('bi', i, 'bj', j, 'c', 0), named_struct('bi', i, 'bj', j - 1, 'c', 1), "
        "named_struct('bi', i - 1, 'bj', j, 'c', 2), named_struct('bi', i - 1, 'bj', j - 1, 'c', 3))"
    )
    parts = raster.select(*keys, F.col(value).alias("z"), F.explode(corners).alias("q")).select(*keys, "q.*", "z")
    return parts.groupBy(*keys, "bi", "bj").agg(
        *[F.max(F.when(F.col("c") == n, F.col("z"))).alias(name) for n, name in enumerate(("z00", "z01", "z10", "z11"))]
    )


def bilinear(points: DataFrame, raster: DataFrame, first: tuple[float, float], step: float, shape: tuple[int, int],
             value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Linear interpolation between node centres; null outside the node range or next to a missing node.

    The base index is clamped to n-2 so that a point on the last node still has four corners.
    """
    lat0, lon0 = first
    located = points.withColumns({
        "fi": F.expr(f"(lat - {lat0!r}D) / {step!r}D"), "fj": F.expr(f"(lon - {lon0!r}D) / {step!r}D"),
    }).withColumns({
        "bi": F.expr(f"least(floor(fi), {shape[0] - 2})"), "bj": F.expr(f"least(floor(fj), {shape[1] - 2})"),
    })
    met = located.join(quads(raster, value, keys), [*keys, "bi", "bj"], "left")
    inside = f"fi BETWEEN 0 AND {shape[0] - 1} AND fj BETWEEN 0 AND {shape[1] - 1}"
    mix = ("z00 * (1e0 - (fi - bi)) * (1e0 - (fj - bj)) + z01 * (1e0 - (fi - bi)) * (fj - bj) "
           "+ z10 * (fi - bi) * (1e0 - (fj - bj)) + z11 * (fi - bi) * (fj - bj)")
    return met.withColumn(out, F.expr(f"CASE WHEN {inside} THEN {mix} END")).drop(
        "fi", "fj", "bi", "bj", "z00", "z01", "z10", "z11")


def window_cells(raster: DataFrame, window: GridWindow, row: str = "i", n_lat: int | None = None,
                 nodata: float | None = None, value: str = "value") -> DataFrame:
    """Cells of a window with a valid flag. With ``n_lat`` the row counts from the north and is flipped."""
    if n_lat is not None:
        raster = raster.withColumn("i", F.lit(n_lat - 1) - F.col(row))
    v = F.col(value) if nodata is None else F.nullif(F.col(value), F.lit(nodata))
    return raster.where(window.contains(F.col("i"), F.col("j"))).withColumn(value, v).withColumn("valid", F.col(value).isNotNull())


def difference(before: str, here: str, after: str) -> Column:
    """Central difference; one-sided when one neighbour lies outside the raster.

    ``has_*`` flags tell an absent cell (edge) from a present cell without a value.
    """
    return F.expr(
        f"CASE WHEN {before}_in AND {after}_in THEN ({after} - {before}) / 2e0 "
        f"WHEN {after}_in THEN {after} - {here} WHEN {before}_in THEN {here} - {before} END"
    )


def gradients(dem: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Central differences per cell step along i (north) and j (east), one-sided at the edges.

    Neighbours come from sending every cell to its four neighbours and pivoting once per target cell,
    keyed by raster and cell: no per-raster window, so one huge raster spreads over all tasks.
    """
    moves = F.expr(
        "array(named_struct('ti', i, 'tj', j, 'c', 0), named_struct('ti', i + 1, 'tj', j, 'c', 1), "
        "named_struct('ti', i - 1, 'tj', j, 'c', 2), named_struct('ti', i, 'tj', j + 1, 'c', 3), "
        "named_struct('ti', i, 'tj', j - 1, 'c', 4))"
    )
    names = ("z", "south", "north", "west", "east")
    cells = (
        dem.select(*keys, "z", F.explode(moves).alias("m"))
        .select(*keys, F.col("m.ti").alias("i"), F.col("m.tj").alias("j"), "m.c", "z")
        .groupBy(*keys, "i", "j")
        .agg(
            *[F.max(F.when(F.col("c") == n, F.col("z"))).alias(name) for n, name in enumerate(names)],
            *[F.max(F.col("c") == n).alias(f"{name}_in") for n, name in enumerate(names)],
        )
        .where("z_in")
    )
    return cells.select(*keys, "i", "j", "z", difference("south", "z", "north").alias("d_i"), difference("west", "z", "east").alias("d_j"))


def slope_aspect(dem: DataFrame, cell_deg: float, lat_centre: Column, keys: Sequence[str]) -> DataFrame:
    """Slope in degrees and downslope azimuth; null where undefined, aspect null where flat."""
    graded = gradients(dem, keys).withColumns({
        "north": F.col("d_i") / F.lit(METRES_PER_DEGREE * cell_deg),
        "east": F.col("d_j") / (F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat_centre)) * F.lit(cell_deg)),
    })
    steep = F.degrees(F.atan(F.sqrt(F.col("east") * F.col("east") + F.col("north") * F.col("north"))))
    known = F.col("east").isNotNull() & F.col("north").isNotNull()
    graded = graded.withColumn("slope_deg", F.when(known, F.least(F.greatest(steep, F.lit(0.0)), F.lit(90.0))))
    turned = F.degrees(F.atan2(-F.col("east"), -F.col("north"))) + F.lit(360.0)
    graded = graded.withColumn("aspect_deg", F.when(F.col("slope_deg") > 1e-9, F.pmod(turned, F.lit(360.0))))
    return graded.select(*keys, "i", "j", "z", "slope_deg", "aspect_deg")


def circular_mean(degrees: Column) -> Column:
    """Mean direction; null when the directions cancel out."""
    s, c = F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))
    return F.when(F.sqrt(s * s + c * c) >= 1e-12, F.pmod(F.degrees(F.atan2(s, c)) + F.lit(360.0), F.lit(360.0)))


def regrid(cells: DataFrame, keys: Sequence[str], value: str, first: tuple[float, float], step: float, shape: tuple[int, int],
           new_first: tuple[float, float], new_step: float, new_shape: tuple[int, int]) -> DataFrame:
    """Bilinear resampling of every raster onto a new regular grid (centres at new_first + n * new_step).

    Each source square carries its four corners and generates the new nodes that fall into it, so the
    work is one pivot and one explode; no join with the target grid at all.
    """
    square = quads(cells, value, keys).where(f"bi BETWEEN 0 AND {shape[0] - 2} AND bj BETWEEN 0 AND {shape[1] - 2}")

    def span(base: str, axis: int) -> Column:
        to_new = f"(({first[axis]!r}D + {{}} * {step!r}D) - {new_first[axis]!r}D) / {new_step!r}D - 1e-9"
        start = f"CAST(ceil({to_new.format(base)}) AS BIGINT)"
        # The last square also owns the nodes on its far edge.
        stop = (f"CASE WHEN {base} = {shape[axis] - 2} THEN CAST(floor({to_new.format(f'({base} + 1)')} + 2e-9) AS BIGINT) "
                f"ELSE CAST(ceil({to_new.format(f'({base} + 1)')}) AS BIGINT) - 1 END")
        return F.expr(f"filter(CASE WHEN {stop} >= {start} THEN sequence({start}, {stop}) ELSE array() END, n -> n BETWEEN 0 AND {new_shape[axis] - 1})")

    nodes = square.withColumn("i", F.explode(span("bi", 0))).withColumn("j", F.explode(span("bj", 1)))
    fi = f"(({new_first[0]!r}D + i * {new_step!r}D) - {first[0]!r}D) / {step!r}D - bi"
    fj = f"(({new_first[1]!r}D + j * {new_step!r}D) - {first[1]!r}D) / {step!r}D - bj"
    placed = nodes.withColumns({"fi": F.expr(fi), "fj": F.expr(fj)})
    mix = "z00 * (1e0 - fi) * (1e0 - fj) + z01 * (1e0 - fi) * fj + z10 * fi * (1e0 - fj) + z11 * fi * fj"
    return placed.select(*keys, "i", "j", F.expr(mix).alias(value))
