"""ANSI SQL text of the derived tables, used as CTEs in front of every check query."""

from __future__ import annotations

from hearthgrid.functions import geo
from hearthgrid.sources import testbed as tb


def _cols(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


_EVENTS = "(SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_LEADS = ", ".join(str(h) for h in tb.WEATHER_LEADS)
_CODES = ", ".join(str(c) for c in tb.LANDCOVER_CODES)
_AOI_POINTS = [*tb.AOI_CORNERS, tb.AOI_CORNERS[0]]

# name -> (text, tables it needs)
_CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "detections": (f"SELECT {_cols(tb.DETECTIONS)} FROM {_EVENTS}", ()),
    "raw_rows": (f"SELECT {_cols(tb.RAW_ROWS)} FROM {_EVENTS}", ()),
    "scores": (f"SELECT {_cols(tb.SCORES)} FROM {_EVENTS}", ()),
    "industrial": (f"SELECT {_cols(tb.INDUSTRIAL)} FROM supplier", ()),
    "weather_runs": (f"SELECT {_cols(tb.WEATHER_RUNS)} FROM supplier", ()),
    "weather_cells": (
        f"SELECT {_cols(tb.WEATHER_CELLS)} FROM (SELECT w.run_id, w.run_time, w.acct, l.lead_h, a.i, b.j FROM weather_runs w, "
        f"(SELECT unnest([{_LEADS}]) AS lead_h) l, (SELECT unnest(range({tb.WEATHER_NODES})) AS i) a, "
        f"(SELECT unnest(range({tb.WEATHER_NODES})) AS j) b)",
        ("weather_runs",),
    ),
    "truth_cells": (
        f"SELECT run_id, run_time, valid_time, lead_h, i, j, lat, lon, {_cols(tb.TRUTH_CELLS)} FROM weather_cells",
        ("weather_cells",),
    ),
    "truth_nodes": (
        f"SELECT {_cols(tb.TRUTH_NODES)} FROM supplier, (SELECT unnest(range({tb.TRUTH_SHAPE[0]})) AS ti) t, "
        f"(SELECT unnest(range({tb.TRUTH_SHAPE[1]})) AS i) a, (SELECT unnest(range({tb.TRUTH_SHAPE[2]})) AS j) b",
        (),
    ),
    "terrain_meta": (f"SELECT {_cols(tb.TERRAIN_META)} FROM supplier", ()),
    "dem_cells": (
        f"SELECT {_cols(tb.DEM_CELLS)} FROM (SELECT t.*, a.a, b.b FROM terrain_meta t, "
        f"(SELECT unnest(range({tb.TERRAIN_SIDE})) AS a) a, (SELECT unnest(range({tb.TERRAIN_SIDE})) AS b) b)",
        ("terrain_meta",),
    ),
    "landcover": (
        f"SELECT i, j, ([{_CODES}])[CAST(pick + 1 AS INTEGER)] AS class FROM (SELECT {tb.LANDCOVER_ROW} AS i, "
        f"{tb.LANDCOVER_COL} AS j, {tb.LANDCOVER_PICK} AS pick FROM lineitem GROUP BY 1, 2)",
        (),
    ),
    "aois": (
        f"SELECT aoi_id, name, created_at, segment, {_cols(tb.AOI_BOX)}, cx, cy, half FROM "
        f"(SELECT {_cols(tb.AOIS)} FROM customer)",
        (),
    ),
    "aoi_edges": (
        " UNION ALL ".join(
            f"SELECT aoi_id, {n} AS edge, {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2 FROM aois"
            for n, ((x1, y1), (x2, y2)) in enumerate(zip(_AOI_POINTS, _AOI_POINTS[1:]))
        ),
        ("aois",),
    ),
    "hindcast": (f"SELECT {_cols(tb.HINDCAST)} FROM lineitem", ()),
    "forecast_runs": (f"SELECT {_cols(tb.FORECAST_RUNS)} FROM orders", ()),
}


def add_cte(name: str, text: str, needs: tuple[str, ...] = ()) -> None:
    """Register a shared building block (used by several check queries)."""
    _CTES[name] = (text, needs)


def cte(name: str) -> str:
    """The text of a registered building block."""
    return _CTES[name][0]


def with_ctes(*names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH ...`` clause holding the named tables, their parents first, then the extra ones."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for parent in _CTES[name][1]:
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({_CTES[n][0]})" for n in ordered]
    parts += [f"{n} AS ({text})" for n, text in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"


def metres(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The local ellipsoidal distance as text (the test domain does not touch the date line)."""
    return geo.local_metres_text(lat1, lon1, lat2, lon2, f"({lon2} - {lon1})").replace("::D", "::DOUBLE")


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    dphi = f"(radians({lat2} - {lat1}) / 2e0)"
    dlam = f"(radians({lon2} - {lon1}) / 2e0)"
    h = f"(sin({dphi}) * sin({dphi}) + cos(radians({lat1})) * cos(radians({lat2})) * sin({dlam}) * sin({dlam}))"
    return f"({2.0 * geo.EARTH_RADIUS_M / 1000.0!r}::DOUBLE * asin(sqrt(least(1e0, {h}))))"
