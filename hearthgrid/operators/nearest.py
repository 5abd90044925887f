"""Nearest earlier detection within a time span, at any distance.

Order is by planar degrees, the reported distance is the great circle. Nothing is paired wholesale:

1. Copies of a detection (same place and time) are at distance 0.
2. A task holds the detections of one map tile, with a rim around it and one span before, and looks for each target in cells from
   fine to coarse, so that a target meets the few rows of the first cells that are not empty; a hit counts only inside the rim. Tiles
   of too many rows are cut into smaller ones, targets that found nothing look around in wider ones.
3. All other targets walk down a tree of ever smaller cells. At each level an as-of merge over time tells which cells
   have a detection in the target's span; only cells that can still hold the nearest one are opened. Each target
   carries a handful of cells from level to level.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthgrid.functions.geo import EARTH_RADIUS_M, haversine_km
from hearthgrid.operators.asof import last_before
from hearthgrid.operators.neighbours import HOUR_US, POINT, count_upto, micros
from hearthgrid.session import materialize

#: Sides of tiles in degrees; the rim around a tile is an eighth of its side. Tiles of too many rows are looked through at the next smaller side.
TILE_DEG, WIDER_DEG, WORLD_DEG = (3.2, 0.4, 0.05), 25.6, 8192.0
RIM = 8
#: Rows that a task holds of a tile and its rim at most, rows that a target meets at most, and rows compared at a time.
HELD_ROWS, MET_ROWS, COMPARED_ROWS = 1 << 19, 4096, 1 << 20
#: Cell sides inside a tile: twice the rim, and so many times a quarter of it.
HALVINGS = 6
# Cell sides of the tree in degrees, coarse to fine; below the last one single positions are compared.
TREE_DEG = (128.0, 16.0, 2.0, 0.25, 0.03125, 0.00390625)
NONE_KM = 999.0
PLACED = "abs(lat) <= 360 AND abs(lon) <= 360 AND t_us IS NOT NULL"


def nearest_before(df: DataFrame, span_h: int = 24, crowded_rows: int = HELD_ROWS, time: str = "acq_time") -> DataFrame:
    """One row per distinct (lat, lon, t_us) with ``nn_km``: 999 when no other detection lies in ``[t - span, t]``."""
    width = span_h * HOUR_US
    series = materialize(
        df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("lat", "lon", micros(F.col(time)).alias("t_us")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("b", F.expr(f"floor(t_us / {width})")), "nearest-series")
    copies = series.where("n > 1").select(*POINT, F.lit(0.0).alias("nn_km"))
    found, left = [], [series.where(f"n = 1 AND NOT coalesce({PLACED}, false)").select(*POINT)]

    skipped = None
    for deg in TILE_DEG:
        near, skipped = _look_around(series, skipped, width, deg, 3 * width, crowded_rows)
        found.append(near)
        if skipped is None:
            break
    left += [skipped] if skipped is not None else []
    rest = materialize(_all([near.where("q_lat IS NULL AND NOT lost").select(*POINT) for near in found]), "nearest-rest")
    # The last tile is the world: who finds nothing there has nothing before it.
    for deg, bucket in ((WIDER_DEG, width), (WORLD_DEG, HOUR_US)):
        if rest.isEmpty():
            break
        near, skipped = _look_around(series, rest, width, deg, bucket, crowded_rows)
        found.append(near)
        left += [skipped] if skipped is not None else []
        rest = near.where("q_lat IS NULL AND NOT lost").select(*POINT)
    told = _all([near.where("q_lat IS NOT NULL") for near in found]).select(*POINT, haversine_km("lat", "lon", "q_lat", "q_lon").alias("nn_km"))
    nothing = rest.select(*POINT, F.lit(NONE_KM).alias("nn_km"))
    walking = materialize(_all(left + [near.where("lost").select(*POINT) for near in found]), "nearest-walking")
    parts = copies.unionByName(told).unionByName(nothing)
    if walking.isEmpty():
        return parts
    # Only days before a target matter to it.
    days = walking.selectExpr(f"explode(array(floor(t_us / {width}) - 1, floor(t_us / {width}))) AS b").distinct()
    walked = _walk_down(walking, series.join(days, "b", "left_semi"), width)
    return parts.unionByName(walking.join(walked, POINT, "left").withColumn("nn_km", F.coalesce("nn_km", F.lit(NONE_KM))))


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _look_around(series: DataFrame, asked: DataFrame | None, width: int, deg: float, bucket: int, held_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """``asked`` (single detections of ``series`` by default) with the nearest earlier place q_lat, q_lon within the rim, null if there is none.

    Who meets more than MET_ROWS rows is ``lost``. Also those of them that lie in tiles of more than ``held_rows`` rows and were not looked at, None if there are no such tiles.
    """
    rim, place = deg / RIM, ["ti", "tj", "tb"]
    cell = lambda c, by: f"floor(({c} + {deg / 2 + by!r}D) / {deg!r}D)"
    home = {"ti": cell("lat", 0.0), "tj": cell("lon", 0.0), "tb": f"floor(t_us / {bucket})"}
    at_home = lambda df: df.where(PLACED).selectExpr(*POINT, *[f"{text} AS {name}" for name, text in home.items()])
    held = series.where(PLACED)
    if asked is not None:
        days = asked.selectExpr(f"explode(array(floor(t_us / {width}) - 1, floor(t_us / {width}))) AS b").distinct()
        held = held.join(days, "b", "left_semi")
    for name, c in (("ti", "lat"), ("tj", "lon")):
        held = held.withColumn(name, F.explode(F.expr(f"sequence({cell(c, -rim)}, {cell(c, rim)})")))
    held = held.withColumn("tb", F.explode(F.expr(f"sequence(floor(t_us / {bucket}), floor((t_us + {width}) / {bucket}))")))
    if asked is None:
        at_home_too = " AND ".join(f"{name} = {text}" for name, text in home.items())
        rows = held.selectExpr(*POINT, *place, "true AS held", f"n = 1 AND {at_home_too} AS asked")
        asked = series.where("n = 1")
    else:
        tiles = at_home(asked).select(*place).distinct()
        rows = held.join(tiles, place, "left_semi").selectExpr(*POINT, *place, "true AS held", "false AS asked").unionByName(
            at_home(asked).selectExpr(*POINT, *place, "false AS held", "true AS asked"))
    crowded = materialize(rows.groupBy(*place).agg(F.count_if("held").alias("rows")).where(F.col("rows") > held_rows).select(*place), "nearest-crowded")
    skipped = None
    if not crowded.isEmpty():
        rows = rows.join(crowded, place, "left_anti")
        skipped = materialize(at_home(asked).join(crowded, place, "left_semi").select(*POINT), "nearest-skipped")
    schema = T.StructType([*[T.StructField(c, series.schema[c].dataType) for c in POINT], T.StructField("q_lat", T.DoubleType()), T.StructField("q_lon", T.DoubleType()), T.StructField("lost", T.BooleanType())])
    # Few bytes, much work behind each: dealt to all tasks (a fixed count is not merged away again at run time).
    tasks = max(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), series.sparkSession.sparkContext.defaultParallelism)
    return materialize(rows.repartition(tasks, *place).groupBy(*place).applyInArrow(_nearest_held(width, rim), schema), "nearest-around"), skipped


def _km(lat: np.ndarray, lon: np.ndarray, q_lat: np.ndarray, q_lon: np.ndarray) -> np.ndarray:
    """``haversine_km`` of many pairs."""
    north, east = np.sin(np.radians(q_lat - lat) / 2), np.sin(np.radians(q_lon - lon) / 2)
    h = north * north + np.cos(np.radians(lat)) * np.cos(np.radians(q_lat)) * east * east
    return 2 * EARTH_RADIUS_M / 1000 * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def _nearest_held(width: int, rim: float):
    """Nearest earlier rows within the rim, among the rows a task holds: a function of the rows of one tile."""

    def same_place(lat, lon, at, held, asked) -> np.ndarray:
        """For each row the last held one at its place before it in the span, or -1."""
        order = np.lexsort((~asked, at, lon, lat))
        last = np.maximum.accumulate(np.where(held[order], np.arange(len(order)), -1))
        last = np.concatenate(([-1], last[:-1]))
        other = order[np.maximum(last, 0)]
        met = (last >= 0) & (lat[other] == lat[order]) & (lon[other] == lon[order]) & (at[order] - at[other] <= width) & asked[order]
        found = np.full(len(order), -1)
        found[order[met]] = other[met]
        return found

    def run(rows: pa.Table) -> pa.Table:
        lat, lon, at = (rows.column(c).to_numpy() for c in POINT)
        held, asked = (rows.column(c).to_numpy() for c in ("held", "asked"))
        best = same_place(lat, lon, at, held, asked)
        open_ = np.flatnonzero(asked & (best < 0))
        known = np.flatnonzero(held)
        known = known[np.argsort(at[known], kind="stable")]
        k_lat, k_lon, k_at = lat[known], lon[known], at[known]
        bits = int(len(known)).bit_length()
        lost = np.zeros(len(lat), dtype=bool)
        for halving in reversed(range(HALVINGS)):
            if not len(open_) or not len(known):
                break
            side = 2 * rim / 4**halving
            first = [np.floor(c.min() / side) - 1 for c in (k_lat, k_lon)]
            wide = int(np.floor(k_lon.max() / side) - first[1]) + 2
            tall = int(np.floor(k_lat.max() / side) - first[0]) + 2
            i, j = ((np.floor(c / side) - f).astype(np.int64) for c, f in zip((k_lat, k_lon), first))
            keys = np.sort(((i * wide + j) << bits) + np.arange(len(known)))
            low, high = np.searchsorted(k_at, at[open_] - width, "left"), np.searchsorted(k_at, at[open_], "right")
            begins, ends = [], []
            for a in (-0.5, 0.5):
                for b in (-0.5, 0.5):
                    i, j = (np.floor(c[open_] / side + s) - f for c, s, f in zip((lat, lon), (a, b), first))
                    inside = (i >= 0) & (i < tall) & (j >= 0) & (j < wide)
                    cell = (np.where(inside, i, 0).astype(np.int64) * wide + np.where(inside, j, 0).astype(np.int64)) << bits
                    begins.append(np.searchsorted(keys, cell + low))
                    ends.append(np.where(inside, np.searchsorted(keys, cell + high), begins[-1]))
            begins = np.stack(begins, axis=1)
            sizes = np.stack(ends, axis=1) - begins
            met = sizes.sum(axis=1)
            turn = np.flatnonzero((met > 1) & (met <= MET_ROWS))  # each meets itself
            done = np.zeros(len(open_), dtype=bool)
            cuts = np.searchsorted(np.cumsum(met[turn]), np.arange(COMPARED_ROWS, met[turn].sum() + COMPARED_ROWS, COMPARED_ROWS), "left")
            for chunk in np.split(turn, np.unique(cuts)):
                if not len(chunk):
                    continue
                size = sizes[chunk].ravel()
                ends_at = np.cumsum(size)
                position = np.arange(ends_at[-1]) + np.repeat(begins[chunk].ravel() - (ends_at - size), size)
                q = keys[position] & ((1 << bits) - 1)
                each = met[chunk]
                owner = np.repeat(open_[chunk], each)
                d_lat, d_lon = lat[owner] - k_lat[q], lon[owner] - k_lon[q]
                planar = d_lat * d_lat + d_lon * d_lon
                planar[(d_lat == 0) & (d_lon == 0) & (k_at[q] == at[owner])] = np.inf
                least = np.minimum.reduceat(planar, np.cumsum(each) - each)
                hit = least <= (side / 2) ** 2 * (1 - 1e-9)
                equal = np.flatnonzero((planar == np.repeat(least, each)) & np.repeat(hit, each))
                owner, q = owner[equal], known[q[equal]]
                if len(owner) > hit.sum():  # ties go to the shorter great circle
                    order = np.lexsort((_km(lat[owner], lon[owner], lat[q], lon[q]), owner))
                    owner, q = owner[order], q[order]
                    keep = np.append(True, owner[1:] != owner[:-1])
                    owner, q = owner[keep], q[keep]
                best[owner] = q
                done[chunk[hit]] = True
            # Who meets too many rows meets more of them in wider cells.
            lost[open_[met > MET_ROWS]] = True
            open_ = open_[~done & (met <= MET_ROWS)]
        answered = np.flatnonzero(asked)
        q = best[answered]
        return pa.table({c: rows.column(c).take(pa.array(answered)) for c in POINT} | {
            name: pa.array(values[np.maximum(q, 0)], mask=q < 0) for name, values in (("q_lat", lat), ("q_lon", lon))} | {"lost": pa.array(lost[answered])})

    return run


def _planar(lat: str, lon: str) -> str:
    return f"(lat - {lat}) * (lat - {lat}) + (lon - {lon}) * (lon - {lon})"


def _closest(pairs: DataFrame) -> DataFrame:
    """Nearest candidate (q_lat, q_lon) per target by planar distance; ties go to the shorter great circle."""
    scored = pairs.withColumns({"planar": F.expr(_planar("q_lat", "q_lon")), "km": haversine_km("lat", "lon", "q_lat", "q_lon")})
    return scored.groupBy(*POINT).agg(F.min(F.struct("planar", "km")).alias("best")).select(*POINT, "best.planar", F.col("best.km").alias("nn_km"))


def _cell(deg: float, lat: str = "lat", lon: str = "lon") -> tuple[str, str]:
    return f"floor({lat} / {deg!r}D)", f"floor({lon} / {deg!r}D)"


def _in_span(frontier: DataFrame, stream: DataFrame, unit: list[str], width: int) -> DataFrame:
    """Keep (target, position) rows whose position has another detection in the target's span.

    ``own`` tells that the position is the target's, which is then not counted. A position's day is what one window holds.
    """
    asked = frontier.selectExpr("*", f"inline(array(named_struct('b', floor(t_us / {width}), 'at_us', t_us, 'sign', 1L), "
                                     f"named_struct('b', floor(t_us / {width}) - 1, 'at_us', t_us, 'sign', 1L), "
                                     f"named_struct('b', floor(t_us / {width}) - 1, 'at_us', t_us - {width} - 1, 'sign', -1L)))")
    answered = count_upto(stream, asked, [*unit, "b"])
    kept = answered.groupBy(*frontier.columns).agg(F.sum(F.col("sign") * F.col("upto")).alias("found"))
    return kept.where(F.col("found") - F.col("own") > 0).drop("found")


def _cells_in_span(frontier: DataFrame, stream: DataFrame, width: int) -> DataFrame:
    """Keep (target, cell) rows whose cell has another detection in the target's span, by the last one at or before its time.

    Cells and instants are merged in ranges of time, so a cell that holds a third of all detections is spread like any other. In its own
    cell a target asks for the instant before, and for company at its own.
    """
    key = F.expr("shiftleft(ci, 32) + (cj & 4294967295L)")
    moments = stream.select(key.alias("unit"), "at_us", "n")
    asked = frontier.withColumns({"unit": key, "ask_us": F.col("t_us") - F.col("own")})
    seen = last_before(asked.select("unit", "ask_us").distinct(), moments.select("unit", F.col("at_us").alias("ask_us"), F.col("at_us").alias("seen_us")), "unit", "ask_us", ["seen_us"])
    company = moments.where("n > 1").select("unit", F.col("at_us").alias("t_us"), F.col("n").alias("peers"))
    met = asked.join(seen, ["unit", "ask_us"]).join(company, ["unit", "t_us"], "left")
    return met.where(f"seen_us >= t_us - {width} OR (own = 1 AND peers > 1)").select(*frontier.columns)


def _walk_down(targets: DataFrame, series: DataFrame, width: int) -> DataFrame:
    frontier = None
    for level, deg in enumerate(TREE_DEG):
        ci, cj = _cell(deg)
        boxes = series.selectExpr("lat", "lon", f"{ci} AS ci", f"{cj} AS cj").groupBy("ci", "cj").agg(
            F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"), F.min("lon").alias("lon_lo"), F.max("lon").alias("lon_hi"))
        stream = series.selectExpr(f"{ci} AS ci", f"{cj} AS cj", "t_us AS at_us", "n").groupBy("ci", "cj", "at_us").agg(F.sum("n").alias("n"))
        if frontier is None:
            # The top level has at most 3 x 4 cells on the whole globe.
            tops = boxes.agg(F.collect_list(F.struct(*boxes.columns)).alias("cells")).select("cells").scalar()
            opened = targets.select(*POINT, F.explode(tops).alias("u")).select(*POINT, "u.*")
        else:
            pi, pj = _cell(TREE_DEG[level - 1], "lat_lo", "lon_lo")
            children = boxes.selectExpr("*", f"{pi} AS pi", f"{pj} AS pj")
            opened = frontier.selectExpr(*POINT, "ci AS pi", "cj AS pj").join(children, ["pi", "pj"]).drop("pi", "pj")
        opened = opened.withColumn("own", F.expr(f"CAST(ci = {ci} AND cj = {cj} AS INT)"))
        present = _cells_in_span(opened, stream, width)
        reach = present.withColumns({
            "near": F.expr("pow(greatest(0e0, lat_lo - lat, lat - lat_hi), 2e0) + pow(greatest(0e0, lon_lo - lon, lon - lon_hi), 2e0)"),
            "far": F.expr("pow(greatest(abs(lat - lat_lo), abs(lat - lat_hi)), 2e0) + pow(greatest(abs(lon - lon_lo), abs(lon - lon_hi)), 2e0)"),
        })
        # A present cell holds a detection no farther than its far corner: farther cells cannot win.
        limit = reach.groupBy(*POINT).agg(F.min("far").alias("limit"))
        frontier = materialize(reach.join(limit, POINT).where("near <= limit * (1e0 + 1e-9) + 1e-12").select(*POINT, "ci", "cj"), f"nearest-level-{level}")
        if frontier.isEmpty():
            return targets.limit(0).select(*POINT, F.lit(NONE_KM).alias("nn_km"))
    ci, cj = _cell(TREE_DEG[-1])
    sites = series.selectExpr("lat AS q_lat", "lon AS q_lon", f"{ci} AS ci", f"{cj} AS cj").distinct()
    stream = series.selectExpr("lat AS q_lat", "lon AS q_lon", "b", "t_us AS at_us", "n")
    opened = frontier.join(sites, ["ci", "cj"]).select(*POINT, "q_lat", "q_lon", F.expr("CAST(q_lat = lat AND q_lon = lon AS INT)").alias("own"))
    return _closest(_in_span(opened, stream, ["q_lat", "q_lon"], width)).select(*POINT, "nn_km")
