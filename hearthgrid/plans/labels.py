"""Rule labels of detections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.operators.heatmap import chronic_cells
from hearthgrid.operators.neighbours import HOUR_US, Span, attach_counts, neighbour_counts
from hearthgrid.operators.proximity import near_any


@dataclass(frozen=True)
class LabelRules:
    """Default parameters of the first rule set."""

    industrial_radius_km: float = 2.0
    chronic_days: int = 20
    chronic_window_days: int = 90
    cluster_km: float = 2.0
    cluster_hours: int = 24
    low_confidence: float = 30.0
    singleton_km: float = 5.0
    singleton_hours: int = 24
    cell_deg: float = 0.01
    version: str = "v1.0.0"


def in_chronic_cell(df: DataFrame, cell_deg: float, days: int, history: DataFrame | None = None) -> DataFrame:
    """Flag rows in cells seen on many days. The chronic cells are few; Spark picks the join by their real size."""
    cells = chronic_cells(df if history is None else history, cell_deg, days).select("ci", "cj", F.lit(True).alias("_hit"))
    placed = df.withColumns({"ci": F.floor(F.col("lat") / F.lit(cell_deg)), "cj": F.floor(F.col("lon") / F.lit(cell_deg))})
    return placed.join(cells, ["ci", "cj"], "left").withColumn("chronic", F.col("_hit").isNotNull()).drop("_hit", "ci", "cj")


def rule_spans(rules: LabelRules = LabelRules()) -> list[Span]:
    """What the rules count around a detection."""
    return [
        Span("near", rules.singleton_km * 1000.0, rules.singleton_hours * HOUR_US, rules.singleton_hours * HOUR_US),
        Span("close", rules.cluster_km * 1000.0, rules.cluster_hours * HOUR_US, rules.cluster_hours * HOUR_US),
    ]


def label_detections(detections: DataFrame, industrial: DataFrame, rules: LabelRules = LabelRules(),
                     start: str | None = None, end: str | None = None, bbox: tuple | None = None, counts: DataFrame | None = None) -> DataFrame:
    """id, label, rule. Rules in order: industrial, low-confidence singleton, chronic cell, cluster; else UNKNOWN.

    Neighbours and chronic days are looked for in all detections, the labels are given to the selected ones.
    ``counts`` may bring the spans of the rules counted elsewhere.
    """
    rows = detections.select("id", "lat", "lon", "acq_time", "confidence")
    counts = neighbour_counts(rows, rule_spans(rules)) if counts is None else counts
    wanted, history = rows, rows
    if start is not None and end is not None:
        first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
        wanted = wanted.where(F.col("acq_time").between(first, last))
        history = rows.where(F.col("acq_time").between(first - F.make_dt_interval(F.lit(rules.chronic_window_days)), last))
    if bbox is not None:
        wanted = wanted.where(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))
    flagged = near_any(wanted, industrial, rules.industrial_radius_km * 1000.0, "industrial")
    flagged = in_chronic_cell(flagged, rules.cell_deg, rules.chronic_days, history)
    flagged = attach_counts(flagged, counts)
    rule = (
        F.when(F.col("industrial"), "Industrial Mask")
        .when((F.col("confidence") < rules.low_confidence) & (F.col("near") == 1), "Low-Conf Singleton")
        .when(F.col("chronic"), "Chronic Static")
        .when(F.col("close") > 1, "Persistent Cluster")
        .otherwise("Default")
    )
    label = F.when(F.col("rule") == "Persistent Cluster", "POSITIVE").when(F.col("rule") == "Default", "UNKNOWN").otherwise("NEGATIVE")
    return flagged.withColumn("rule", rule).select("id", label.alias("label"), "rule", F.lit(rules.version).alias("rule_version"))


def label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("acq_time").alias("first_time"), F.max("acq_time").alias("last_time"))


def with_labels(detections: DataFrame, labels: DataFrame, version: str) -> DataFrame:
    return detections.join(labels.where(F.col("rule_version") == version), "id")
