"""Past-only context features of detections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.functions.features import firms_features, time_features
from hearthgrid.grid import GridSpec
from hearthgrid.operators.nearest import nearest_before
from hearthgrid.operators.neighbours import HOUR_US, Span, attach_counts, micros, neighbour_counts
from hearthgrid.operators.raster import sample_cell

DAY_US = 24 * HOUR_US
RADIUS_SPANS = (
    Span("n_2km_6h", 2000.0, 6 * HOUR_US), Span("n_2km_24h", 2000.0, 24 * HOUR_US),
    Span("n_5km_6h", 5000.0, 6 * HOUR_US), Span("n_5km_24h", 5000.0, 24 * HOUR_US),
)
FEATURE_CELL_DEG = 0.01
#: Rows of same-cell histories that a task takes at a time, about; and bits of a time within two slots of 30 days.
HELD_ROWS, REACH_BITS = 1 << 17, 43


def radius_counts(detections: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Neighbours within 2/5 km and 6/24 h before each row; peers of the same time count, the row itself does not.

    ``counts`` may bring RADIUS_SPANS counted elsewhere.
    """
    counted = attach_counts(detections, neighbour_counts(detections, RADIUS_SPANS) if counts is None else counts)
    return counted.withColumns({s.name: F.col(s.name) - 1 for s in RADIUS_SPANS})


def _histories(slot_us: int):
    """Same-cell features of sorted rows (ci, cj, slot, t_us, n, asked), of as many whole groups (ci, cj, slot) at a time as have come."""

    def tell(block: pa.Table) -> pa.RecordBatch:
        ci, cj, slot, t_us, n, asked = (c.to_numpy() for c in block.columns)
        begins = np.append(True, (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1]) | (slot[1:] != slot[:-1]))
        group = np.cumsum(begins) - 1
        base = group << REACH_BITS  # times of a group count from the start of the slot before its own
        at = t_us - (slot - 1) * slot_us
        keys = base + at
        day = t_us // DAY_US
        opens = begins | np.append(True, day[1:] != day[:-1])
        closes = np.append(opens[1:], True)
        total, opened, closed = (np.concatenate(([0], np.cumsum(x))) for x in (n, opens, closes))
        i = np.flatnonzero(asked)
        upto = lambda before: np.searchsorted(keys, base[i] + np.maximum(at[i] - before - 1, -1), "right")
        found = {
            "n_same_cell_24h": total[i + 1] - total[upto(DAY_US)] - 1,
            "n_same_cell_7d": total[i + 1] - total[upto(7 * DAY_US)] - 1,
            "seen_same_cell_past_3d": (total[i] > total[upto(3 * DAY_US)]).astype(np.int32),
            "days_with_detection_past_30d_in_cell": opened[i] - closed[upto(30 * DAY_US)],
        }
        return pa.RecordBatch.from_pydict({"ci": ci[i], "cj": cj[i], "t_us": t_us[i]} | found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < HELD_ROWS:
                continue
            block = pa.Table.from_batches(held).combine_chunks()
            ci, cj, slot = (block.column(c).to_numpy() for c in range(3))
            # The last group may go on in the next batch.
            whole = int(np.argmax((ci == ci[-1]) & (cj == cj[-1]) & (slot == slot[-1])))
            if whole:
                yield tell(block.slice(0, whole))
                block = block.slice(whole)
            held, rows = block.to_batches(), 0 if whole else rows - HELD_ROWS
        if held and sum(b.num_rows for b in held):
            yield tell(pa.Table.from_batches(held).combine_chunks())

    return run


def same_cell_history(detections: DataFrame, cell_deg: float = FEATURE_CELL_DEG) -> DataFrame:
    """n_same_cell_24h, n_same_cell_7d, seen_same_cell_past_3d, days_with_detection_past_30d_in_cell.

    All four are differences of running counts, so a busy cell costs a sort, not a pairing. Rows are
    folded per (cell, time), made visible in their own 30-day slot and the next one, and counted along
    time inside (cell, slot), many of them at a time. Distinct days use the same trick: a day enters at its first detection and
    leaves after its last one. A task holds the different times of one cell in two slots.
    """
    slot_us = 30 * DAY_US
    cell = {"ci": F.floor(F.col("lat") / F.lit(cell_deg)), "cj": F.floor(F.col("lon") / F.lit(cell_deg))}
    placed = detections.withColumns({**cell, "t_us": micros(F.col("acq_time"))})
    key = ["ci", "cj"]
    moments = placed.where("ci IS NOT NULL AND cj IS NOT NULL AND t_us IS NOT NULL").groupBy(*key, "t_us").agg(F.count(F.lit(1)).alias("n"))
    own = F.expr(f"floor(t_us / {slot_us})")
    seen = moments.withColumn("slot", F.explode(F.array(own, own + 1))).select(*key, "slot", "t_us", "n", (F.col("slot") == own).alias("asked"))
    tasks = max(int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions")), detections.sparkSession.sparkContext.defaultParallelism)
    dealt = seen.repartition(tasks, *key, "slot").sortWithinPartitions(*key, "slot", "t_us")
    history = dealt.mapInArrow(_histories(slot_us), "ci long, cj long, t_us long, n_same_cell_24h long, n_same_cell_7d long, seen_same_cell_past_3d int, days_with_detection_past_30d_in_cell long")
    return placed.join(history, [*key, "t_us"]).drop(*key, "t_us")


def terrain_features(detections: DataFrame, terrain: DataFrame, grid: GridSpec) -> DataFrame:
    """(id, elevation_m, slope_deg, aspect_sin, aspect_cos) of the terrain cell (i, j, z, slope_deg, aspect_deg) below each row."""
    aspect = F.radians("aspect_deg")
    flat = terrain.select("i", "j", F.struct(F.col("z").alias("elevation_m"), "slope_deg", F.sin(aspect).alias("aspect_sin"), F.cos(aspect).alias("aspect_cos")).alias("ground"))
    return sample_cell(detections.select("id", "lat", "lon"), flat, grid, "ground", "ground").select("id", "ground.*")


def denoiser_features(detections: DataFrame, terrain: DataFrame | None = None, grid: GridSpec | None = None, counts: DataFrame | None = None) -> DataFrame:
    """FIRMS, time, radius, cell, nearest-neighbour and (with ``terrain``) terrain features for all rows at once."""
    base = firms_features(detections).withColumns(time_features(F.col("acq_time")))
    around = radius_counts(detections.select("id", "lat", "lon", "acq_time"), counts).select("id", *[s.name for s in RADIUS_SPANS])
    history = same_cell_history(detections.select("id", "lat", "lon", "acq_time")).drop("lat", "lon", "acq_time")
    points = detections.select("id", "lat", "lon", "acq_time")
    nearest = attach_counts(points, nearest_before(points)).select("id", F.col("nn_km").alias("dist_nn_24h_km"))
    joined = base.join(around, "id", "left").join(history, "id", "left").join(nearest, "id", "left")
    return joined if terrain is None else joined.join(terrain_features(detections, terrain, grid), "id", "left")
