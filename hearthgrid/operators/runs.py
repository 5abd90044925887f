"""Ledgers of model runs and terrain versions: newest, as-of and containment look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthgrid.operators.asof import last_before
from hearthgrid.operators.neighbours import HOUR_US, micros
from hearthgrid.session import materialize

BOX = ("min_lon", "min_lat", "max_lon", "max_lat")
TILE_DEG = 5
#: Runs on offer in a map tile and hour are listed in rows of so many; a point looks through every row of its tile and hour.
OFFER_ROWS = 64
#: Up to so many runs on offer, about 45 MB, may be sent to every task; written files do not tell, they are packed far smaller.
SENT_OFFERS = 500_000


def newest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key: one hash aggregation with map-side combine, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[f"best.{c}" for c in rest])


def covers_point(lat: Column, lon: Column) -> Column:
    """A missing box means the whole world."""
    return (
        (F.coalesce(F.col("min_lon"), F.lit(-180.0)) <= lon) & (F.coalesce(F.col("max_lon"), F.lit(180.0)) >= lon)
        & (F.coalesce(F.col("min_lat"), F.lit(-90.0)) <= lat) & (F.coalesce(F.col("max_lat"), F.lit(90.0)) >= lat)
    )


def covers_box(min_lon, min_lat, max_lon, max_lat) -> Column:
    """Whole-world reading of a missing box, for a requested box."""
    return (
        (F.coalesce(F.col("min_lon"), F.lit(-180.0)) <= min_lon) & (F.coalesce(F.col("max_lon"), F.lit(180.0)) >= max_lon)
        & (F.coalesce(F.col("min_lat"), F.lit(-90.0)) <= min_lat) & (F.coalesce(F.col("max_lat"), F.lit(90.0)) >= max_lat)
    )


def stored_box_contains(min_lon, min_lat, max_lon, max_lat) -> Column:
    """Strict reading for cache look-ups: a row without a box never matches."""
    return (F.col("min_lon") <= min_lon) & (F.col("min_lat") <= min_lat) & (F.col("max_lon") >= max_lon) & (F.col("max_lat") >= max_lat)


WORLD = {"min_lon": -180.0, "max_lon": 180.0, "min_lat": -90.0, "max_lat": 90.0}


def _tiles(axis: str, shift: int) -> Column:
    """The map tiles that a box touches along an axis."""
    return F.explode(F.expr(f"sequence(CAST(floor((min_{axis} + {shift}e0) / {TILE_DEG}) AS INT), CAST(floor((max_{axis} + {shift}e0) / {TILE_DEG}) AS INT))"))


def _by_box(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Completed runs by box, the newest of each run time, ``(area, run_us, run_time, created_at, run_id)``; and the boxes ``(area, edges)``.

    A missing edge is the edge of the world.
    """
    ready = runs.where("status = 'completed'").select("run_id", "run_time", "created_at", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in WORLD.items()])
    ready = ready.withColumn("area", F.xxhash64(*WORLD))
    best = newest_per(ready.select("area", "run_time", "created_at", "run_id", *WORLD), ["area", "run_time"], ["created_at", "run_id"])
    return best.withColumn("run_us", micros(F.col("run_time"))), ready.select("area", *WORLD).distinct()


def _covering(asked: DataFrame, boxes: DataFrame, lat: str, lon: str, covers: Column) -> DataFrame:
    """``asked`` with the ``area`` of each box that covers it. World-wide boxes are met without a tile, others by the tile of (lat, lon)."""
    whole = " AND ".join(f"{c} = {v!r}D" for c, v in WORLD.items())
    world = boxes.where(whole).agg(F.max("area").alias("area"))  # one row, null if no run has the whole world
    everywhere = asked.withColumn("area", world.select("area").scalar()).where("area IS NOT NULL")
    tiled = boxes.where(f"NOT ({whole})").withColumn("tile_i", _tiles("lat", 90)).withColumn("tile_j", _tiles("lon", 180)).withColumnsRenamed({c: f"r_{c}" for c in WORLD})
    placed = asked.withColumns({"tile_i": F.expr(f"CAST(floor(({lat} + 90e0) / {TILE_DEG}) AS INT)"), "tile_j": F.expr(f"CAST(floor(({lon} + 180e0) / {TILE_DEG}) AS INT)")})
    local = placed.join(tiled, ["tile_i", "tile_j"]).where(covers).select(*asked.columns, "area")
    return everywhere.unionByName(local)


def _newest_run(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, run_id, run_time): of the last runs of each row's areas the newest one."""
    met = last_before(asked, runs, "area", "t_us", ["run_us", "run_id", "run_time", "created_at"]).where("run_id IS NOT NULL")
    best = F.max_by(F.struct("run_id", "run_time"), F.struct("run_time", "created_at", "run_id")).alias("run")
    return met.groupBy("id").agg(best).select("id", "run.run_id", "run.run_time")


def _tile(axis: str, of: str) -> Column:
    """Map tile of a coordinate. It never falls as the coordinate grows, so a point in a box lies in one of the tiles from edge to edge."""
    edge = WORLD[f"max_{axis}"]
    return F.expr(f"floor((least(greatest({of}, {-edge!r}D), {edge!r}D) + {edge!r}D) / {TILE_DEG})")


def _hour(at: str) -> Column:
    """Start of the hour of a time in microseconds."""
    return F.expr(f"{at} - pmod({at}, {HOUR_US})")


def _offers(asked: DataFrame, runs: DataFrame, tolerance_us: int) -> DataFrame:
    """The runs a point may choose from, newest first, per asked (hour, tile_lat, tile_lon): rows of up to OFFER_ROWS of them.

    A run is on offer from its time until the next one of its box, or until it is too old, wherever its box touches the tile.
    """
    ready = _by_box(runs)[0].where("run_us IS NOT NULL")
    following = F.lead("run_us").over(Window.partitionBy("area").orderBy("run_us"))
    offered = ready.withColumn("until_us", F.least(F.col("run_us") + F.lit(tolerance_us), following - 1)).withColumns(
        {f"first_{axis}": _tile(axis, f"min_{axis}") for axis in ("lat", "lon")} | {f"last_{axis}": _tile(axis, f"max_{axis}") for axis in ("lat", "lon")})
    hourly = offered.withColumn("hour", F.explode(F.sequence(_hour("run_us"), _hour("until_us"), F.lit(HOUR_US))))
    # Rows made by exploding look as few as the runs, so they are not left to a broadcast.
    met = asked.join(hourly.hint("merge"), "hour").where("tile_lat BETWEEN first_lat AND last_lat AND tile_lon BETWEEN first_lon AND last_lon")
    place = ["hour", "tile_lat", "tile_lon"]
    newest = Window.partitionBy(*place).orderBy(F.desc("run_us"), F.desc("created_at"), F.desc("run_id"))
    run = F.struct("run_us", "created_at", "run_id", "run_time", "until_us", *WORLD)
    return met.withColumn("part", F.floor((F.row_number().over(newest) - 1) / OFFER_ROWS)).groupBy(*place, "part").agg(
        F.sort_array(F.collect_list(run), asc=False).alias("offers")).drop("part")


def runs_at_points(points: DataFrame, runs: DataFrame, tolerance_h: int = 6) -> DataFrame:
    """``points`` (id, lat, lon, t_us) with run_id, run_time of the newest completed run in ``[t - tolerance, t]`` whose box covers the point.

    Points without such a run are absent; an id has one row. Points meet the few runs on offer in their hour and map tile, listed
    once for all points there, instead of asking for each box that covers them.
    """
    placed = points.where("t_us IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").withColumns({"hour": _hour("t_us"), "tile_lat": _tile("lat", "lat"), "tile_lon": _tile("lon", "lon")})
    asked = placed.select("hour", "tile_lat", "tile_lon").distinct()
    offers = materialize(_offers(asked, runs, tolerance_h * HOUR_US), "run-offers")  # written, so that the join is planned by its size
    if (offers.agg(F.sum(F.size("offers"))).first()[0] or 0) > SENT_OFFERS:
        offers = offers.hint("merge")
    fits = "r.run_us <= t_us AND r.until_us >= t_us AND r.min_lat <= lat AND r.max_lat >= lat AND r.min_lon <= lon AND r.max_lon >= lon"
    # The outer generator is not asked twice, as one would be whose empty lists are filtered out beforehand.
    met = placed.join(offers, ["hour", "tile_lat", "tile_lon"]).selectExpr(*points.columns, f"inline_outer(slice(filter(offers, r -> {fits}), 1, 1))")
    rest = [c for c in points.columns if c != "id"] + ["run_id", "run_time"]
    best = F.max_by(F.struct(*rest), F.struct("run_us", "created_at", "run_id")).alias("best")
    return met.where("run_us IS NOT NULL").repartition("id").groupBy("id").agg(best).select("id", "best.*")


def as_of_run(points: DataFrame, runs: DataFrame, tolerance_h: int = 6) -> DataFrame:
    """(id, run_id, run_time) of the newest completed run in ``[t - tolerance, t]`` whose box covers the point (id, lat, lon, t_us)."""
    return runs_at_points(points.select("id", "lat", "lon", "t_us"), runs, tolerance_h).select("id", "run_id", "run_time")


def latest_run_at(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest completed run at or before ``at`` (id, at) wherever its box is; no age limit."""
    ready = runs.where("status = 'completed'").withColumn("area", F.lit(0).cast("long"))
    best = newest_per(ready.select("area", "run_time", "created_at", "run_id"), ["area", "run_time"], ["created_at", "run_id"]).withColumn("t_us", micros(F.col("run_time")))
    asked = requests.select("id", F.lit(0).cast("long").alias("area"), micros(F.col("at")).alias("t_us"))
    return last_before(asked, best, "area", "t_us", ["run_id", "run_time"]).where("run_id IS NOT NULL").select("id", "run_id", "run_time")


def latest_run_for_boxes(boxes: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest completed run at or before ``at`` that covers each box (id, box, at); no age limit.

    A request finds the different run boxes that cover it through the map tile of its south-west corner, and asks for the last
    run of each.
    """
    ready, areas = _by_box(runs)
    covers = F.expr("r_min_lon <= min_lon AND r_max_lon >= max_lon AND r_min_lat <= min_lat AND r_max_lat >= max_lat")
    asked = _covering(boxes.select("id", *BOX, micros(F.col("at")).alias("t_us")), areas, "min_lat", "min_lon", covers).select("id", "area", "t_us")
    return _newest_run(asked, ready.withColumn("t_us", F.col("run_us")))
