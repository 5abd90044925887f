"""Domain tables derived from the generic parquet tables.

Column formulas are text that Spark SQL and ANSI engines read alike (double literals carry an
exponent), so a check can evaluate the same inputs elsewhere. Nothing is sampled or capped:
every derived table grows with its parent.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.session import deal

DETECTIONS = {
    "id": "event_id",
    "lat": "40e0 + ((user_id * 37) % 1000) * 0.02e0 + (k % 10) * 0.001e0",
    "lon": "22e0 + ((user_id * 53) % 1000) * 0.02e0 + floor(k / 10) * 0.001e0",
    "acq_time": "ts",
    "sensor": "CASE WHEN event_type IN ('view', 'click') THEN 'VIIRS' "
              "WHEN event_type IN ('signup', 'purchase') THEN 'MODIS' END",
    "source": "CASE event_id % 3 WHEN 0 THEN 'VIIRS_SNPP_NRT' WHEN 1 THEN 'VIIRS_NOAA20_NRT' ELSE 'MODIS_NRT' END",
    "confidence": "CASE WHEN event_type = 'error' AND k < 20 THEN NULL ELSE CAST(k AS DOUBLE) END",
    "brightness": "250e0 + value",
    "bright_t31": "280e0 + k * 0.1e0",
    "frp": "value",
    "scan": "1e0 + (k % 5) * 0.1e0",
    "track": "1e0 + (k % 3) * 0.1e0",
    "daynight": "CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 'D' ELSE 'N' END",
    "denoised_score": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE k / 100e0 END",
    "is_noise": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE k < 30 END",
    "false_source_masked": "event_id % 11 = 0",
    "fire_likelihood": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE ((k * 7) % 100) / 100e0 END",
    "ingest_batch_id": "CAST(day(ts) - 1 AS BIGINT)",
    "created_at": "ts",
    "k": "k",
}

# Feed rows: all text, with bad coordinates, bad times and both spellings of confidence mixed in.
RAW_ROWS = {
    "row_id": "event_id",
    "latitude": "CASE WHEN event_id % 50 = 0 THEN 'bad' WHEN event_id % 53 = 0 THEN '95.0' "
                "WHEN event_id % 61 = 0 THEN NULL ELSE concat(CAST(40 + CAST(floor(((user_id * 37) % 1000) * 20 / 1000e0) AS BIGINT) AS VARCHAR(10)), '.', "
                "lpad(CAST((((user_id * 37) % 1000) * 20 + k % 10) % 1000 AS VARCHAR(10)), 3, '0')) END",
    "longitude": "concat(CAST(22 + CAST(floor(((user_id * 53) % 1000) * 20 / 1000e0) AS BIGINT) AS VARCHAR(10)), '.', "
                 "lpad(CAST((((user_id * 53) % 1000) * 20 + CAST(floor(k / 10) AS BIGINT)) % 1000 AS VARCHAR(10)), 3, '0'))",
    "acq_date": "CASE WHEN event_id % 67 = 0 THEN '' ELSE CAST(CAST(ts AS DATE) AS VARCHAR(10)) END",
    "acq_time": "CASE WHEN event_id % 59 = 0 THEN '2460' ELSE CAST(hour(ts) * 100 + minute(ts) AS VARCHAR(10)) END",
    "confidence": "CASE WHEN event_id % 3 = 1 THEN NULL WHEN event_id % 7 = 0 THEN 'n' "
                  "WHEN k >= 97 THEN '150' ELSE CAST(k AS VARCHAR(10)) END",
    "confidence_text": "CASE event_id % 5 WHEN 0 THEN 'h' WHEN 1 THEN 'Nominal' WHEN 2 THEN 'low' WHEN 3 THEN '' END",
    "brightness": "CASE WHEN event_id % 13 = 0 THEN '' ELSE CAST(CAST(floor(250 + value * 4) AS BIGINT) AS VARCHAR(10)) END",
    "bright_t31": "CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE CAST(280 + k AS VARCHAR(10)) END",
    "frp": "CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(10))",
    "instrument": "CASE WHEN event_type IN ('view', 'click') THEN 'VIIRS' WHEN event_type = 'error' THEN '' END",
    "satellite": "CASE WHEN event_type = 'signup' THEN 'Aqua' WHEN event_type = 'error' THEN '' END",
    "sensor": "CASE WHEN event_type = 'purchase' THEN 'MODIS' END",
    "source": "CASE event_id % 3 WHEN 0 THEN 'VIIRS_SNPP_NRT' WHEN 1 THEN 'VIIRS_NOAA20_NRT' ELSE 'MODIS_NRT' END",
    "ts": "ts",
}

INDUSTRIAL = {
    "source_id": "s_suppkey",
    "name": "s_name",
    "kind": "CASE s_nationkey % 3 WHEN 0 THEN 'power_plant' WHEN 1 THEN 'refinery' ELSE 'steel_mill' END",
    "lat": "40.004e0 + ((s_suppkey * 37) % 1000) * 0.02e0",
    "lon": "22.004e0 + ((s_suppkey * 53 + (s_suppkey % 5) * 211) % 1000) * 0.02e0",
}

# One forecast run per supplier: four run times a day, some failed, half of them limited to a box.
WEATHER_RUNS = {
    "run_id": "s_suppkey",
    "run_time": "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * (6 * (s_suppkey % 121))",
    "created_at": "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * (6 * (s_suppkey % 121) + s_nationkey)",
    "model": "CASE WHEN s_nationkey % 3 = 0 THEN 'regional' ELSE 'global' END",
    "status": "CASE WHEN s_suppkey % 10 = 7 THEN 'failed' ELSE 'completed' END",
    "horizon_hours": "24",
    "step_hours": "3",
    "min_lon": "CASE WHEN s_nationkey % 2 = 1 THEN 22e0 + (s_suppkey % 3) * 5e0 END",
    "min_lat": "CASE WHEN s_nationkey % 2 = 1 THEN 40e0 + (s_suppkey % 4) * 3e0 END",
    "max_lon": "CASE WHEN s_nationkey % 2 = 1 THEN 42e0 END",
    "max_lat": "CASE WHEN s_nationkey % 2 = 1 THEN 60e0 END",
    "acct": "CAST(floor(s_acctbal) AS BIGINT)",
}
# Weather nodes every 2 degrees from (40, 22): 11 x 11 nodes, leads 0..24 h by 3 h.
WEATHER_NODES = 11
WEATHER_STEP_DEG = 2.0
WEATHER_ORIGIN = (40.0, 22.0)
WEATHER_LEADS = tuple(range(0, 25, 3))
WEATHER_CELLS = {
    "run_id": "run_id",
    "run_time": "run_time",
    "valid_time": "run_time + INTERVAL '1' HOUR * lead_h",
    "lead_h": "lead_h",
    "i": "i",
    "j": "j",
    "lat": "40e0 + i * 2e0",
    "lon": "22e0 + j * 2e0",
    "u10": "CAST((run_id * 3 + i * 5 + j * 7 + lead_h) % 21 - 10 AS DOUBLE)",
    "v10": "CAST((run_id * 7 + i * 3 + j * 5 + 2 * lead_h) % 21 - 10 AS DOUBLE)",
    "t2m": "CAST(270 + (abs(acct) + i + j + lead_h / 3) % 30 AS DOUBLE)",
    "rh2m": "CAST((run_id * 11 + i * 13 + j * 17 + 3 * lead_h) % 101 AS DOUBLE)",
    "tp": "((run_id + i + j + CAST(lead_h / 3 AS BIGINT)) % 8) * 0.0005e0",
}
TRUTH_CELLS = {
    "u10": "u10 * 0.9e0 + 0.5e0 + ((i + 2 * j) % 3) * 0.1e0",
    "v10": "v10",
    "t2m": "t2m - 1e0 + ((i * j) % 4) * 0.25e0",
    "rh2m": "rh2m * 0.95e0",
}

# Reference fields on a coarser grid: every 6 h and every 4 degrees.
TRUTH_NODES = {
    "run_id": "s_suppkey",
    "ti": "ti",
    "i": "i",
    "j": "j",
    "u10": "CAST((s_suppkey * 5 + i * 3 + j + ti) % 17 - 8 AS DOUBLE)",
    "t2m": "CAST(268 + (s_suppkey + i * 2 + j * 3 + ti) % 29 AS DOUBLE)",
}
TRUTH_SHAPE = (5, 6, 6)

# Terrain tiles of 20 x 20 cells of 0.1 degree; a region may have several versions.
TERRAIN_META = {
    "terrain_id": "s_suppkey",
    "region": "concat('R', lpad(CAST(s_suppkey % 100 AS VARCHAR(10)), 2, '0'))",
    "tile_i": "CAST(floor((s_suppkey % 100) / 10) AS BIGINT)",
    "tile_j": "(s_suppkey % 10)",
    "created_at": "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * s_suppkey",
    "cell": "0.1e0",
    "origin_lat": "40e0 + floor((s_suppkey % 100) / 10) * 2e0",
    "origin_lon": "22e0 + (s_suppkey % 10) * 2e0",
    "n_lat": "20",
    "n_lon": "20",
    "has_features": "s_suppkey % 4 <> 1",
}
TERRAIN_SIDE = 20
DEM_CELLS = {
    "terrain_id": "terrain_id",
    "region": "region",
    "created_at": "created_at",
    "i": "tile_i * 20 + a",
    "j": "tile_j * 20 + b",
    "a": "a",
    "b": "b",
    "z": "CASE WHEN (a * 7 + b * 3 + terrain_id) % 97 = 0 THEN NULL "
         "ELSE 100e0 + (tile_i * 20 + a) * 12e0 + (tile_j * 20 + b) * 7e0 + 5e0 * ((a * b) % 7) + terrain_id % 13 END",
}

LANDCOVER_SIDE = 200
# Land-cover class codes in the order used by the derived raster.
LANDCOVER_CODES = (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100, 255)
LANDCOVER_ROW = "(l_orderkey * 7 + l_linenumber) % 200"
LANDCOVER_COL = "(l_partkey * 3 + l_suppkey) % 200"
LANDCOVER_PICK = "max(l_suppkey % 12)"

AOIS = {
    "aoi_id": "c_custkey",
    "name": "c_name",
    "created_at": "TIMESTAMP '2023-01-01 00:00:00' + INTERVAL '1' HOUR * c_custkey",
    "segment": "c_mktsegment",
    "cy": "40.5e0 + ((c_custkey * 53) % 190) * 0.1e0",
    "cx": "22.5e0 + ((c_custkey * 37) % 190) * 0.1e0",
    "half": "0.1e0 + (c_custkey % 4) * 0.05e0",
}
AOI_CORNERS = (  # (lon, lat) corner offsets in units of ``half``: a trapezoid
    ("cx - half * 1.2e0", "cy - half"),
    ("cx + half * 1.2e0", "cy - half"),
    ("cx + half * 1.5e0", "cy + half"),
    ("cx - half * 1.2e0", "cy + half"),
)
AOI_BOX = {"min_lon": "cx - half * 1.2e0", "max_lon": "cx + half * 1.5e0", "min_lat": "cy - half", "max_lat": "cy + half"}

FORECAST_RUNS = {
    "run_id": "o_orderkey",
    "ref_time": "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * (6 * (o_custkey % 120))",
    "created_at": "o_orderdate",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'completed' ELSE 'failed' END",
    "region": "concat('R', lpad(CAST(o_custkey % 100 AS VARCHAR(10)), 2, '0'))",
    "min_lon": "22e0 + (o_custkey % 10) * 2e0",
    "max_lon": "24e0 + (o_custkey % 10) * 2e0",
    "min_lat": "40e0 + floor((o_custkey % 100) / 10) * 2e0",
    "max_lat": "42e0 + floor((o_custkey % 100) / 10) * 2e0",
}

SCORES = {
    "id": "event_id",
    "acq_time": "ts",
    "y": "CASE WHEN (k >= 50) <> (event_id % 7 = 0) THEN 1 ELSE 0 END",
    "p": "k / 100e0",
    "sensor": DETECTIONS["sensor"],
    "daynight": DETECTIONS["daynight"],
    "confidence_norm": "CASE WHEN event_type = 'error' AND k < 20 THEN 30e0 ELSE CAST(k AS DOUBLE) END",
    "frp": "value",
}


# Forecast cells with their outcome: one per order line, sixty cases of three horizons.
HINDCAST = {
    "cell_id": "l_orderkey * 10 + l_linenumber",
    "case_id": "l_orderkey % 60",
    "ref_time": "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * (12 * (l_orderkey % 60))",
    "horizon_h": "CASE l_linenumber % 3 WHEN 0 THEN 6 WHEN 1 THEN 12 ELSE 24 END",
    "i": "l_partkey % 200",
    "j": "l_suppkey % 200",
    "y_pred": "l_quantity / 50e0",
    "y_obs": "CASE WHEN (l_partkey * 7 + l_orderkey) % 100 < l_quantity * l_quantity / 25e0 THEN 1e0 ELSE 0e0 END",
    "fire_t0": "CASE WHEN l_discount > 0.08e0 THEN 1e0 ELSE 0e0 END",
}


def select_text(columns: dict[str, str]) -> list[str]:
    # Times carry no zone, so plain literals become zone-free ones here.
    return [f"{expr.replace('TIMESTAMP ', 'TIMESTAMP_NTZ ')} AS {name}" for name, expr in columns.items()]


class Tables:
    """Lazy access to the derived tables under one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def dealt(self, name: str, key: str, each: int) -> DataFrame:
        """A table of which every row becomes ``each`` rows, dealt out by its key."""
        table = self.raw(name)
        return deal(table, table.count() * each, key)

    @cached_property
    def _events(self) -> DataFrame:
        """Events with ``k`` out of their JSON, made by a generator: read once a row, not wherever a formula or a filter on one has it."""
        return self.raw("events").selectExpr("event_id", "ts", "user_id", "event_type", "value", "inline(array(struct(CAST(get_json_object(props, '$.k') AS BIGINT) AS k)))")

    @cached_property
    def detections(self) -> DataFrame:
        return self._events.selectExpr(*select_text(DETECTIONS))

    @cached_property
    def raw_rows(self) -> DataFrame:
        """A feed as it would be read. Rows are made by a generator, so that a formula is worked out once, not wherever its column is read."""
        fields = [expr.replace("TIMESTAMP ", "TIMESTAMP_NTZ ") + f" AS {name}" for name, expr in RAW_ROWS.items()]
        return self._events.selectExpr(f"inline(array(struct({', '.join(fields)})))")

    @cached_property
    def scores(self) -> DataFrame:
        return self._events.selectExpr(*select_text(SCORES))

    @cached_property
    def industrial(self) -> DataFrame:
        return self.raw("supplier").selectExpr(*select_text(INDUSTRIAL))

    @cached_property
    def weather_runs(self) -> DataFrame:
        return self.raw("supplier").selectExpr(*select_text(WEATHER_RUNS))

    @cached_property
    def weather_cells(self) -> DataFrame:
        nodes = F.sequence(F.lit(0), F.lit(WEATHER_NODES - 1))
        runs = self.dealt("supplier", "s_suppkey", len(WEATHER_LEADS) * WEATHER_NODES * WEATHER_NODES).selectExpr(*select_text(WEATHER_RUNS))
        return (
            runs.select("run_id", "run_time", "acct")
            .withColumn("lead_h", F.explode(F.array(*[F.lit(h) for h in WEATHER_LEADS])))
            .withColumn("i", F.explode(nodes))
            .withColumn("j", F.explode(nodes))
            .selectExpr(*select_text(WEATHER_CELLS))
        )

    @cached_property
    def truth_cells(self) -> DataFrame:
        keep = ["run_id", "run_time", "valid_time", "lead_h", "i", "j", "lat", "lon"]
        return self.weather_cells.selectExpr(*keep, *select_text(TRUTH_CELLS))

    @cached_property
    def truth_nodes(self) -> DataFrame:
        out = self.dealt("supplier", "s_suppkey", math.prod(TRUTH_SHAPE)).select("s_suppkey")
        for name, count in zip(("ti", "i", "j"), TRUTH_SHAPE):
            out = out.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        return out.selectExpr(*select_text(TRUTH_NODES))

    @cached_property
    def terrain_meta(self) -> DataFrame:
        return self.raw("supplier").selectExpr(*select_text(TERRAIN_META))

    @cached_property
    def dem_cells(self) -> DataFrame:
        side = F.sequence(F.lit(0), F.lit(TERRAIN_SIDE - 1))
        tiles = self.dealt("supplier", "s_suppkey", TERRAIN_SIDE * TERRAIN_SIDE).selectExpr(*select_text(TERRAIN_META))
        return (
            tiles.select("terrain_id", "region", "created_at", "tile_i", "tile_j")
            .withColumn("a", F.explode(side))
            .withColumn("b", F.explode(side))
            .selectExpr(*select_text(DEM_CELLS))
        )

    @cached_property
    def landcover(self) -> DataFrame:
        codes = F.array(*[F.lit(c) for c in LANDCOVER_CODES])
        return (
            self.raw("lineitem")
            .selectExpr(f"{LANDCOVER_ROW} AS i", f"{LANDCOVER_COL} AS j", "l_suppkey")
            .groupBy("i", "j")
            .agg(F.expr(LANDCOVER_PICK).alias("pick"))
            .select("i", "j", F.element_at(codes, (F.col("pick") + 1).cast("int")).alias("class"))
        )

    @cached_property
    def aois(self) -> DataFrame:
        corners = [*AOI_CORNERS, AOI_CORNERS[0]]
        ring = "array(" + ", ".join(f"named_struct('lon', {x}, 'lat', {y})" for x, y in corners) + ")"
        base = self.raw("customer").selectExpr(*select_text(AOIS))
        return base.selectExpr("aoi_id", "name", "created_at", "segment", *select_text(AOI_BOX), f"array({ring}) AS rings")

    @cached_property
    def hindcast(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(*select_text(HINDCAST))

    @cached_property
    def forecast_runs(self) -> DataFrame:
        return self.raw("orders").selectExpr(*select_text(FORECAST_RUNS))
