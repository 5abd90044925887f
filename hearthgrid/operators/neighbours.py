"""Counts of detections within a distance and a time span of each detection.

Copies are folded first: work is done per distinct (position, time). Rows then meet in cells of two
radii by one longest span. A cell that holds few rows is joined row by row, so one target meets at
most a fixed number of candidates. A busy cell is sorted by time, once: each position that asks takes the
rows within the distance and reads all its targets' counts off their running sums. A crowded cell is never
held like that: it is cut into nested sub-cells, whole sub-cells inside the disc are answered from running
counts over time, and only the sub-cells crossed by the circle are opened further. All ways are exact and add up.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hearthgrid.functions.geo import (
    LAT_SERIES,
    LON_SERIES,
    MAX_M_PER_DEG_LAT,
    MAX_M_PER_DEG_LON_EQ,
    MIN_M_PER_DEG_LAT,
    MIN_M_PER_DEG_LON_EQ,
    DistanceCells,
    local_metres,
    lon_delta,
)
from hearthgrid.session import materialize

HOUR_US = 3_600_000_000
POINT = ["lat", "lon", "t_us"]
UNIT = ["level", "u_row", "u_col", "u_lat", "u_lon", "b"]
# Sub-cells per cell side, coarse to fine; below the last one single positions are used.
PARTS = (8, 64)
# Relative margin of the box-to-disc bounds; boxes closer to the circle than this are opened.
BOX_MARGIN = 0.001
CROWDED_ROWS = 2048
#: Rows of a cell that are counted pair by pair at most (fewer where nothing is told apart by a group), and rows that one task holds of a cell at most.
BUSY_ROWS, FEW_ROWS, HELD_ROWS = 256, 64, 16_384
#: Up to so many cells of few rows, about 20 MB, may be sent to every task, so that probes of all others are not dealt out.
SENT_CELLS = 200_000
#: Pairs of a position and a row that are looked at at a time.
LOOKED_AT = 1 << 20
#: Values of the group that are counted at a time.
TAGS = 16
#: Targets that meet a busy cell in one task, about; more are cut up and meet copies of it.
ASKING_ROWS = 1 << 17


@dataclass(frozen=True)
class Span:
    """Neighbours no farther than ``radius_m`` with time in ``[t - before_us, t + after_us]``."""

    name: str
    radius_m: float
    before_us: int
    after_us: int = 0


def micros(when: Column) -> Column:
    return F.unix_micros(when.cast("timestamp"))


def neighbour_counts(df: DataFrame, spans: Sequence[Span], group: str | None = None,
                     crowded_rows: int = HELD_ROWS, time: str = "acq_time", asking: DataFrame | None = None, busy_rows: int | None = None) -> DataFrame:
    """One row per distinct (lat, lon, t_us) with a count per span, the row's own copies included.

    With ``asking`` only its points are answered; the neighbours still come from ``df``, which holds these rows as well.
    With ``group`` the result also has ``members``: the sorted distinct non-null values of that column
    among the neighbours of the first span.
    """
    tag = [group] if group else []
    busy_rows = (BUSY_ROWS if group else FEW_ROWS) if busy_rows is None else busy_rows
    series = (
        df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col(time).isNotNull())
        .groupBy("lat", "lon", micros(F.col(time)).alias("t_us"), *tag)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bucket_us = max(max(s.before_us, s.after_us) for s in spans)
    cells = DistanceCells(max(s.radius_m for s in spans))
    series = cells.add_home(series).withColumn("b", F.floor(F.col("t_us") / F.lit(bucket_us)))
    # Written once: every branch below reads it, and its size is then known to the optimizer.
    series = materialize(series, "neighbour-series")

    place = ["cell_row", "cell_col", "b"]
    occupied = materialize(series.groupBy(*place).agg(F.count(F.lit(1)).alias("rows")), "neighbour-cells")
    few = occupied.where(F.col("rows") <= min(busy_rows, crowded_rows)).select(*place)
    filled = occupied.where(F.col("rows") > min(busy_rows, crowded_rows))
    filled = filled.select(*place, (F.col("rows") > crowded_rows).alias("crowded"))
    crowded, busy = (filled.where(c).select(*place) for c in ("crowded", "NOT crowded"))
    offsets = [o for o, wanted in ((-1, any(s.before_us for s in spans)), (0, True), (1, any(s.after_us for s in spans))) if wanted]
    if asking is None:
        targets = series.selectExpr(*POINT, "b AS tb").distinct() if group else series.selectExpr(*POINT, "b AS tb")
    else:
        asked = asking.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col(time).isNotNull())
        targets = asked.select("lat", "lon", micros(F.col(time)).alias("t_us")).distinct().withColumn("tb", F.floor(F.col("t_us") / F.lit(bucket_us)))
    marked = series.join(filled, place, "left")
    sparse = marked.where(F.col("crowded").isNull()).drop("crowded")
    held = marked.where(~F.col("crowded")).drop("crowded")
    dense = marked.where(F.col("crowded")).drop("crowded")
    parts = _sparse_part(targets, sparse, few, spans, cells, offsets, group).unionByName(_busy_part(targets, held, busy, spans, cells, offsets, group))
    parts = parts.unionByName(_dense_part(targets, dense, crowded, spans, cells, offsets, group))
    sums = [F.sum(s.name).alias(s.name) for s in spans]
    if not group:
        return parts.groupBy(*POINT).agg(*sums)
    first = spans[0].name
    return (
        parts.groupBy(*POINT, group).agg(*sums)
        .groupBy(*POINT)
        .agg(*sums, F.array_sort(F.collect_set(F.when(F.col(first) > 0, F.col(group)))).alias("members"))
    )


def attach_counts(df: DataFrame, counts: DataFrame, time: str = "acq_time") -> DataFrame:
    """Put the per-point counts back on every row."""
    return df.withColumn("t_us", micros(F.col(time))).join(counts, POINT, "left").drop("t_us")


def _sparse_part(targets, rows, few, spans, cells, offsets, group):
    probes = _spread(targets, cells, offsets).select(*POINT, "cell_row", "cell_col", "b")
    if few.count() <= SENT_CELLS:
        probes = probes.join(F.broadcast(few), few.columns, "left_semi")
    tag = [group] if group else []
    other = rows.selectExpr("cell_row", "cell_col", "b", "lat AS q_lat", "lon AS q_lon", "t_us AS q_us", "n", *tag)
    before, after = max(s.before_us for s in spans), max(s.after_us for s in spans)
    # Merged: probes are several for each target, and look as few as the targets.
    pairs = (
        probes.hint("merge").join(other, ["cell_row", "cell_col", "b"])
        .where(f"q_us BETWEEN t_us - {before} AND t_us + {after}")
        .withColumn("metres", local_metres("lat", "lon", "q_lat", "q_lon"))
        .where(F.col("metres") <= max(s.radius_m for s in spans))
    )
    hits = [
        f"CASE WHEN metres <= {s.radius_m!r}D AND q_us BETWEEN t_us - {s.before_us} AND t_us + {s.after_us} THEN n ELSE 0 END AS {s.name}"
        for s in spans
    ]
    return pairs.selectExpr(*POINT, *tag, *hits)


def _spread(points: DataFrame, cells: DistanceCells, offsets: Sequence[int]) -> DataFrame:
    """Rows for every cell and every time bucket a target can have neighbours in."""
    shifts = ", ".join(f"tb + {o}" for o in offsets)
    return cells.explode_cover(points).withColumn("b", F.explode(F.expr(f"array({shifts})")))


def _metres(lat: float, lon: float, q_lat: np.ndarray, q_lon: np.ndarray) -> np.ndarray:
    """``local_metres`` of one position to many."""
    phi = np.radians((lat + q_lat) / 2)
    north = LAT_SERIES[0] + LAT_SERIES[1] * np.cos(2 * phi) + LAT_SERIES[2] * np.cos(4 * phi)
    east = LON_SERIES[0] * np.cos(phi) + LON_SERIES[1] * np.cos(3 * phi) + LON_SERIES[2] * np.cos(5 * phi)
    across = np.mod(q_lon - lon + 540.0, 360.0) - 180.0
    return np.sqrt((north * (q_lat - lat)) ** 2 + (east * across) ** 2)


def _within(asked: np.ndarray, sites: np.ndarray, radii: Sequence[float]) -> list[np.ndarray]:
    """Whether ``_metres`` of each asked position (as complex numbers) to each site is within a radius, one table per radius.

    Cosines of multiples come from the first one; what is too close to the circle to tell is measured in full.
    """
    lat, lon = asked.real[:, None], asked.imag[:, None]
    c = np.cos(np.radians((lat + sites.real) / 2))
    cc = c * c
    twice = 2 * cc - 1
    north = LAT_SERIES[0] + LAT_SERIES[1] * twice + LAT_SERIES[2] * (2 * twice * twice - 1)
    east = c * (LON_SERIES[0] + LON_SERIES[1] * (4 * cc - 3) + LON_SERIES[2] * ((16 * cc - 20) * cc + 5))
    across = sites.imag - lon
    across -= 360 * np.rint(across / 360)
    square = (north * (sites.real - lat)) ** 2 + (east * across) ** 2
    out = []
    for radius in radii:
        inside = square <= radius * radius
        a, b = np.nonzero(np.abs(square - radius * radius) <= 1e-6 * radius * radius + 1e-6)
        if len(a):
            inside[a, b] = _metres(asked.real[a], asked.imag[a], sites.real[b], sites.imag[b]) <= radius
        out.append(inside)
    return out


def _positions(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.empty(len(lat), dtype=complex)
    both.real, both.imag = lat, lon
    return np.unique(both, return_inverse=True)


def _plain_counts(spans: Sequence[Span]):
    """Counts for the targets that ask one cell, nothing told apart: a function of the targets and of the cell's rows.

    The rows around each position stand in order of time in one list of all positions, so a count is a difference of running sums.
    """
    radii = sorted({s.radius_m for s in spans})

    def run(asking: pa.Table, rows: pa.Table) -> pa.Table:
        array = lambda t, c: t.column(c).to_numpy()
        order = np.argsort(array(rows, "q_us"), kind="stable")
        at, n = array(rows, "q_us")[order], array(rows, "n")[order]
        sites, site = _positions(array(rows, "q_lat")[order], array(rows, "q_lon")[order])
        asked, owner = _positions(array(asking, "lat"), array(asking, "lon"))
        when = array(asking, "t_us")
        by_place = np.argsort(owner, kind="stable")
        limits = np.searchsorted(owner[by_place], np.arange(len(asked) + 1))
        ends = [(np.searchsorted(at, when - s.before_us, "left"), np.searchsorted(at, when + s.after_us, "right")) for s in spans]
        bits = int(len(at)).bit_length()
        counts = np.zeros((len(when), len(spans)), dtype=np.int64)
        step = max(1, LOOKED_AT // max(1, len(at)))
        for first in range(0, len(asked), step):
            last = min(first + step, len(asked))
            mine = by_place[limits[first]:limits[last]]
            place = (owner[mine] - first).astype(np.int64) << bits
            for radius, inside in zip(radii, _within(asked[first:last], sites, radii)):
                whose, row = np.nonzero(inside[:, site])
                keys = (whose << bits) + row
                upto = np.concatenate(([0], np.cumsum(n[row])))
                for c, (s, (low, high)) in enumerate(zip(spans, ends)):
                    if s.radius_m == radius:
                        counts[mine, c] = upto[np.searchsorted(keys, place + high[mine])] - upto[np.searchsorted(keys, place + low[mine])]
        told = np.flatnonzero(counts.any(axis=1))
        return pa.table({c: asking.column(c).take(pa.array(told)) for c in POINT} | {s.name: pa.array(np.ascontiguousarray(counts[told, c])) for c, s in enumerate(spans)})

    return run


def _cell_counts(spans: Sequence[Span], group: str):
    """Counts for the targets that ask one cell, per value of the group: a function of the targets and of the cell's rows."""

    def run(asking: pa.Table, rows: pa.Table) -> pa.Table:
        array = lambda t, c: t.column(c).to_numpy()
        order = np.argsort(array(rows, "q_us"), kind="stable")
        at, n = array(rows, "q_us")[order], array(rows, "n")[order]
        sites, site = _positions(array(rows, "q_lat")[order], array(rows, "q_lon")[order])
        tags = rows.column(group).combine_chunks().dictionary_encode(null_encoding="encode")
        tag = tags.indices.to_numpy()[order]
        asked, owner = _positions(array(asking, "lat"), array(asking, "lon"))
        when = array(asking, "t_us")
        by_site = np.argsort(owner, kind="stable")
        limits = np.searchsorted(owner[by_site], np.arange(len(asked) + 1))
        different = len(tags.dictionary)
        whose, which, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, len(spans)), np.int64)]
        for k, p in enumerate(asked):
            mine = by_site[limits[k]:limits[k + 1]]
            metres = _metres(p.real, p.imag, sites.real, sites.imag)[site]
            inside = [np.flatnonzero(metres <= s.radius_m) for s in spans]
            ends = [(np.searchsorted(at[i], when[mine] - s.before_us, "left"), np.searchsorted(at[i], when[mine] + s.after_us, "right")) for i, s in zip(inside, spans)]
            for low in range(0, different, TAGS):
                values = np.arange(low, min(low + TAGS, different))
                counts = np.zeros((len(mine), len(values), len(spans)), dtype=np.int64)
                for c, (i, (first, last)) in enumerate(zip(inside, ends)):
                    upto = np.zeros((len(i) + 1, len(values)), dtype=np.int64)
                    np.cumsum((tag[i, None] == values) * n[i, None], axis=0, out=upto[1:])
                    counts[:, :, c] = upto[last] - upto[first]
                m, g = np.nonzero(counts.any(axis=2))
                whose.append(mine[m])
                which.append(values[g])
                found.append(counts[m, g])
        whose, which, found = np.concatenate(whose), np.concatenate(which), np.concatenate(found)
        out = {c: asking.column(c).take(pa.array(whose)) for c in POINT}
        out[group] = tags.dictionary.take(pa.array(which))
        return pa.table(out | {s.name: pa.array(np.ascontiguousarray(found[:, c])) for c, s in enumerate(spans)})

    return run


def _busy_part(targets, rows, busy, spans, cells, offsets, group):
    """Contribution of busy cells. A task holds one of them, of a bounded number of rows, and a part of its targets."""
    tag, place = [group] if group else [], ["cell_row", "cell_col", "b"]
    probes = _spread(targets, cells, offsets).select(*POINT, *place).join(busy, place, "left_semi")
    heavy = probes.groupBy(*place).agg(F.count(F.lit(1)).alias("asking")).where(F.col("asking") > ASKING_ROWS).select(
        *place, F.ceil(F.col("asking") / ASKING_ROWS).cast("int").alias("cuts"))
    cuts = F.coalesce("cuts", F.lit(1))
    asking = probes.join(heavy, place, "left").withColumn("cut", F.pmod(F.xxhash64(*POINT), cuts).cast("int")).drop("cuts")
    held = rows.selectExpr(*place, "lat AS q_lat", "lon AS q_lon", "t_us AS q_us", "n", *tag).join(heavy, place, "left").withColumn(
        "cut", F.explode(F.sequence(F.lit(0), cuts - 1))).drop("cuts")
    fields = [*targets.select(*POINT).schema.fields, *[rows.schema[c] for c in tag], *[T.StructField(s.name, T.LongType()) for s in spans]]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    # Few bytes, much work behind each: dealt to all tasks (a fixed count is not merged away again at run time).
    tasks = max(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), targets.sparkSession.sparkContext.defaultParallelism)
    asking, held = (side.repartition(tasks, *place, "cut") for side in (asking, held))
    return asking.groupBy(*place, "cut").cogroup(held.groupBy(*place, "cut")).applyInArrow(_cell_counts(spans, group) if group else _plain_counts(spans), schema)


def _dense_part(targets, rows, crowded, spans, cells, offsets, group):
    """Contribution of crowded cells: find the units inside each disc, then read running counts."""
    tag = [group] if group else []
    radii = sorted({s.radius_m for s in spans})
    last = len(PARTS)
    circle = ["lat", "lon", "tb", "radius"]
    met = (
        _spread(targets.select("lat", "lon", "tb").distinct(), cells, offsets)
        .join(crowded, ["cell_row", "cell_col", "b"], "left_semi")
        .withColumn("radius", F.explode(F.array(*[F.lit(r) for r in radii])))
        .join(_units(rows, cells, 0), ["cell_row", "cell_col", "b"])
    )
    found = []
    for level in range(last):
        if level:
            met = opened.join(_units(rows, cells, level), ["p_row", "p_col", "b"])  # noqa: F821
        near, far = _box_reach()
        met = met.withColumns({"near": near, "far": far})
        found.append(met.where(f"far * {1.0 + BOX_MARGIN} <= radius").selectExpr(
            *circle, f"{level} AS level", "u_row", "u_col", "0e0 AS u_lat", "0e0 AS u_lon", "b"))
        opened = met.where(f"far * {1.0 + BOX_MARGIN} > radius AND near * {1.0 - BOX_MARGIN} <= radius").selectExpr(
            *circle, "b", "u_row AS p_row", "u_col AS p_col")
    row, col = cells.sub_cell(PARTS[-1])
    sites = rows.selectExpr("lat AS u_lat", "lon AS u_lon", "b", f"{row} AS p_row", f"{col} AS p_col").distinct()
    found.append(
        opened.join(sites, ["p_row", "p_col", "b"])
        .where(local_metres("lat", "lon", "u_lat", "u_lon") <= F.col("radius"))
        .selectExpr(*circle, f"{last} AS level", "0L AS u_row", "0L AS u_col", "u_lat", "u_lon", "b")
    )
    inside = found[0]
    for more in found[1:]:
        inside = inside.unionByName(more)

    # Events of every unit, at all levels, folded per time.
    nested = [
        "named_struct('level', {}, 'u_row', {}, 'u_col', {}, 'u_lat', 0e0, 'u_lon', 0e0)".format(level, *cells.sub_cell(parts))
        for level, parts in enumerate(PARTS)
    ]
    nested.append(f"named_struct('level', {last}, 'u_row', 0L, 'u_col', 0L, 'u_lat', lat, 'u_lon', lon)")
    stream = (
        rows.withColumn("u", F.explode(F.expr(f"array({', '.join(nested)})")))
        .selectExpr("u.*", "b", "t_us AS at_us", "n", *tag)
        .groupBy(*UNIT, *tag, "at_us").agg(F.sum("n").alias("n"))
    )

    # Two look-ups per target, unit and span: the count up to the end minus the count before the start.
    asks = ", ".join(
        f"named_struct('span', '{s.name}', 'reach', {s.radius_m!r}D, 'sign', {sign}L, 'at_us', t_us + {shift}L)"
        for s in spans for sign, shift in ((1, s.after_us), (-1, -s.before_us - 1))
    )
    questions = (
        targets.join(inside, ["lat", "lon", "tb"])
        .withColumn("q", F.explode(F.expr(f"array({asks})"))).where("q.reach = radius")
        .select(*POINT, *UNIT, "q.span", "q.sign", "q.at_us")
    )
    key = list(UNIT)
    if group:  # one question per value seen in the unit
        key.append("g_key")
        stream = stream.withColumn("g_key", F.expr(f"coalesce(concat('=', {group}), '-')"))
        questions = questions.join(stream.select(*key, group).distinct(), UNIT)
    answered = count_upto(stream, questions, key)
    return answered.selectExpr(
        *POINT, *tag, *[f"CASE WHEN span = '{s.name}' THEN sign * upto ELSE 0L END AS {s.name}" for s in spans])


def count_upto(stream: DataFrame, questions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add ``upto``: how many events (weight n) of the same key have ``at_us`` at or before the question's.

    Equal questions are asked once, so the sorted stream of a key is bounded by its distinct instants.
    """
    moments = questions.select(*key, "at_us").distinct().selectExpr(*key, "at_us", "0L AS n", "1 AS asked")
    running = Window.partitionBy(*key).orderBy("at_us", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answers = (
        stream.selectExpr(*key, "at_us", "n", "0 AS asked").unionByName(moments)
        .withColumn("upto", F.sum("n").over(running))
        .where("asked = 1").select(*key, "at_us", "upto")
    )
    return questions.join(answers, [*key, "at_us"])


def _units(rows: DataFrame, cells: DistanceCells, level: int) -> DataFrame:
    """Occupied sub-cells with the tight box of their positions; below the top, keyed by the parent."""
    row, col = cells.sub_cell(PARTS[level])
    boxes = (
        rows.selectExpr("cell_row", "cell_col", "b", "lat", "lon", f"{row} AS u_row", f"{col} AS u_col")
        .groupBy("cell_row", "cell_col", "b", "u_row", "u_col")
        .agg(F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"), F.min("lon").alias("lon_lo"), F.max("lon").alias("lon_hi"))
    )
    if level == 0:
        return boxes
    ratio = PARTS[level] // PARTS[level - 1]
    parent = (f"floor(u_row / {ratio}) AS p_row", f"floor(u_col / {ratio}) AS p_col")
    return boxes.selectExpr("b", "u_row", "u_col", "lat_lo", "lat_hi", "lon_lo", "lon_hi", *parent)


def _box_reach() -> tuple[Column, Column]:
    """Lower bound of the distance to a unit's box and upper bound of the distance to its far corner.

    The target is first moved next to the box, so boxes across the date line compare the right way.
    """
    middle = "((lon_lo + lon_hi) / 2e0)"
    lon = f"({middle} + {lon_delta(middle, 'lon')})"
    flat = "cos(radians(greatest(abs(lat), abs(lat_lo), abs(lat_hi))))"
    steep = "cos(radians(least(abs(lat), abs(lat_lo), abs(lat_hi))))"
    near = (f"sqrt(pow({MIN_M_PER_DEG_LAT!r}D * greatest(0e0, lat_lo - lat, lat - lat_hi), 2e0) + "
            f"pow({MIN_M_PER_DEG_LON_EQ!r}D * {flat} * greatest(0e0, lon_lo - {lon}, {lon} - lon_hi), 2e0))")
    far = (f"sqrt(pow({MAX_M_PER_DEG_LAT!r}D * greatest(abs(lat - lat_lo), abs(lat - lat_hi)), 2e0) + "
           f"pow({MAX_M_PER_DEG_LON_EQ!r}D * {steep} * greatest(abs({lon} - lon_lo), abs({lon} - lon_hi)), 2e0))")
    return F.expr(near), F.expr(far)
