"""Registered queries next to their ANSI SQL in DuckDB, on the smallest data set.

``scripts/check_oracle.py`` does the same for every key at any size.
"""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "prj_firms_parse", "prj_dedupe_hash", "prj_kernel_weight", "prj_geojson", "flt_bbox", "flt_dq_grid", "flt_aoi_rules", "join_pip_aoi",
    "join_mask_industrial", "join_persist_neighbors", "join_radius_counts", "join_asof_weather_run", "agg_precip_lookback", "agg_heatmap_dense",
    "agg_validation_summary", "set_insert_ignore", "win_same_cell_counts", "win_days_30d", "agg_threshold_sweep", "agg_roc_pr_auc", "join_truth_align",
    "join_regrid", "job_slope_aspect", "join_bilinear", "job_hindcast_dataset", "job_calibrate_apply", "job_label_v1", "job_split_stratified",
    "snk_run_ledger", "str_bucket_counts", "job_score_detections",
)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", QUICK)
def test_query_equals_sql(spark, duck, key):
    problem, _ = compare(entry.queries()[key](spark, FOLDER), duck, entry.oracle_sql()[key])
    assert problem is None, problem


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 209
    assert entry.entry(spark).columns == ["id", "cluster_size", "sensor_count", "masked", "landcover_score", "confidence_score", "persistence_score",
                                          "weather_score", "fire_likelihood"]
