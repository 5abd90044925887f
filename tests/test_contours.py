"""Contour rings against flood fill."""

import math
import random
from collections import defaultdict

import pytest

from hearthgrid.grid import GridSpec
from hearthgrid.plans import contours


def flood(cells, diagonal):
    """Connected parts of a set of cells."""
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    left, parts = set(cells), []
    while left:
        part, stack = set(), [left.pop()]
        while stack:
            i, j = stack.pop()
            part.add((i, j))
            for a, b in steps:
                if (i + a, j + b) in left:
                    left.remove((i + a, j + b))
                    stack.append((i + a, j + b))
        parts.append(part)
    return parts


def expected(cells):
    """For each part of the filled cells: its area with holes filled, and the sorted areas of its holes."""
    n = max(max(c) for c in cells) + 2
    empty = {(i, j) for i in range(-1, n + 1) for j in range(-1, n + 1)} - cells
    of = {c: k for k, part in enumerate(flood(cells, False)) for c in part}
    sizes, holes = defaultdict(int), defaultdict(list)
    for c, k in of.items():
        sizes[k] += 1
    for gap in flood(empty, True):
        if (-1, -1) in gap:
            continue
        # The part around a gap is the one left of its leftmost cell.
        i, j = min(gap, key=lambda c: (c[1], c[0]))
        holes[of[i, j - 1]].append(len(gap))
        inside = {of[i + a, j + b] for i, j in gap for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if (i + a, j + b) in of}
        assert of[i, j - 1] in inside
    # Rings follow the filled side, so a hole's area is that of the gap and of all parts within it.
    return sizes, holes


def rings_of(spark, shapes, grid):
    rows = [(run, 6, i, j, 0.9) for run, cells in shapes.items() for i, j in cells]
    df = spark.createDataFrame(rows, "run_id long, horizon_h int, i long, j long, p double")
    return contours.contour_rings(df, [0.5], grid).collect()


def inside_area(corners):
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(corners, corners[1:] + corners[:1])) / 2


def check(rings, cells):
    sizes, holes = expected(cells)
    outer = {r["ring"]: r for r in rings if not r["hole"]}
    assert len(outer) == len(sizes) and sum(r["hole"] for r in rings) == sum(map(len, holes.values()))
    net = defaultdict(float)
    for r in rings:
        assert (inside_area(r["corners"]) < 0) == r["hole"] and abs(inside_area(r["corners"])) == r["cells"]
        assert all((a["x"] == b["x"]) != (a["y"] == b["y"]) for a, b in zip(r["corners"], r["corners"][1:]))
        assert (r["corners"][0]["y"], r["corners"][0]["x"]) == min((c["y"], c["x"]) for c in r["corners"])
        net[r["owner"]] += -r["cells"] if r["hole"] else r["cells"]
    number = defaultdict(int)
    for r in rings:
        number[r["owner"]] += r["hole"]
    assert set(net) == set(outer)
    assert sorted((net[k], number[k]) for k in outer) == sorted((float(sizes[k]), len(holes[k])) for k in sizes)


def spiral(n):
    """A path of cells that winds inwards, one cell apart."""
    cells, i, j, step, turned = {(0, 0)}, 0, 0, 0, 0
    ways = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    while turned < 2:
        a, b = ways[step % 4]
        ahead, far = (i + a, j + b), (i + 2 * a, j + 2 * b)
        if 0 <= ahead[0] < n and 0 <= ahead[1] < n and ahead not in cells and far not in cells:
            i, j = ahead
            cells.add(ahead)
            turned = 0
        else:
            step, turned = step + 1, turned + 1
    return cells


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(2)
    noise = {run: {(i, j) for i in range(30) for j in range(30) if rng.random() < share} for run, share in ((1, 0.3), (2, 0.55), (3, 0.8))}
    rows = {4: {(i, j) for i in range(9) for j in range(25)} - {(4, j) for j in range(2, 24, 3)} - {(i, 12) for i in range(2, 7)}}
    nested = {5: {(i, j) for i in range(21) for j in range(21) if max(abs(i - 10), abs(j - 10)) % 2 == 0}}
    return noise | rows | nested | {6: spiral(40), 7: {(0, 0), (1, 1), (2, 2), (1, 3), (0, 4)}, 8: {(29, 29)}}


def test_rings_and_holes_equal_flood_fill(spark, shapes):
    found = defaultdict(list)
    for r in rings_of(spark, shapes, GridSpec(1.0, 0.0, 0.0, 64, 64)):
        found[r["run_id"]].append(r)
    assert set(found) == set(shapes)
    for run, cells in shapes.items():
        check(found[run], cells)


def test_a_grid_of_a_million_cells(spark):
    """Waves with islands in lakes, one ring of many thousands of edges among them."""
    n = 1000
    cells = {(i, j) for i in range(n) for j in range(n) if math.sin(i / 37) * math.cos(j / 23) + 0.4 * math.sin((i + 2 * j) / 11) > 0.35 or (i == 500 and j % 7)}
    check(rings_of(spark, {1: cells}, GridSpec(0.01, 0.0, 0.0, n, n)), cells)


def test_no_contour(spark):
    df = spark.createDataFrame([(1, 6, 0, 0, 0.1)], "run_id long, horizon_h int, i long, j long, p double")
    grid = GridSpec(1.0, 0.0, 0.0, 4, 4)
    assert contours.contour_rings(df, [0.5], grid).count() == 0 and contours.contour_polygons(df, [0.5], grid).count() == 0
