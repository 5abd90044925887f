"""Table changes as whole-table jobs: insert-if-new, newest-wins, replace, retention, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgrid.operators.runs import newest_per


def first_per_key(df: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Keep the earliest row per key; a min_by aggregation, so copies fold before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*arrival)).alias("best")
    return df.groupBy(*keys).agg(best).select(*[(f"best.{c}" if c in rest else c) for c in df.columns])


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` to append: first of each key, and not in the target yet."""
    return first_per_key(incoming, keys, arrival).join(target.select(*keys), list(keys), "left_anti").select(*incoming.columns)


def upsert(target: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Whole new table state: the newest version of each key wins."""
    return newest_per(target.unionByName(changes), [key], [version])


def replace_slice(target: DataFrame, incoming: DataFrame, slice_keys: Sequence[str]) -> DataFrame:
    """Drop the (source, version) slices that ``incoming`` brings, then add its rows."""
    touched = incoming.select(*slice_keys).distinct()
    return target.join(touched, list(slice_keys), "left_anti").select(*incoming.columns).unionByName(incoming)


def apply_changes(log: DataFrame, key: str, order: Sequence[str], deleted: str = "deleted") -> DataFrame:
    """Current state of a change log: newest entry per key, tombstones dropped."""
    return newest_per(log, [key], list(order)).where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def keep_recent(df: DataFrame, time: str, now: str, days: int) -> DataFrame:
    return df.where(F.col(time) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def ledger_state(entries: DataFrame, key: str, order: str, meta: str = "metadata") -> DataFrame:
    """Fold the entries of an append-only ledger: last non-null value per column, metadata merged right over left.

    A key has a handful of entries (open, progress, close), so the ordered list per key stays short.
    """
    values = [c for c in entries.columns if c not in (key, order, meta)]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values]
    listed = F.array_sort(F.collect_list(F.struct(order, meta)), lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0))
    merged = F.aggregate(listed, F.create_map().cast("map<string,string>"), lambda acc, e: F.map_concat(acc, F.coalesce(e[meta], F.create_map().cast("map<string,string>"))))
    return entries.groupBy(key).agg(*last, merged.alias(meta))
