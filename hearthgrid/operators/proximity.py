"""Distance tests against a table of fixed places (power plants, refineries, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hearthgrid.functions.geo import DistanceCells, local_metres_text, lon_delta


def near_any(df: DataFrame, places: DataFrame, radius_m: float, out: str) -> DataFrame:
    """Add a boolean: is any place within ``radius_m``?

    Each place is listed in the few cells its disc can touch; rows meet it through an equi-join on their
    own cell. The existence join keeps one row per detection however many places match, and Spark
    broadcasts the places only while their estimated size allows it. Both frames must belong to one
    session (inside a micro-batch: read the places through the batch's session).
    """
    cells = DistanceCells(radius_m)
    around = cells.explode_cover(places.select("lat", "lon").distinct()).selectExpr(
        "cell_row", "cell_col", "lat AS p_lat", "lon AS p_lon")
    metres = local_metres_text("h.lat", "h.lon", "p.p_lat", "p.p_lon", lon_delta("h.lon", "p.p_lon")).replace("::D", "D")
    return df.sparkSession.sql(
        f"""SELECT h.* EXCEPT (cell_row, cell_col, cells_in_row),
                   EXISTS (SELECT 1 FROM {{around}} p
                           WHERE p.cell_row = h.cell_row AND p.cell_col = h.cell_col AND {metres} <= {float(radius_m)!r}D) AS {out}
            FROM {{homes}} h""",
        around=around, homes=cells.add_home(df),
    )
