"""Approximate nearest neighbours: a few stable projections in a kd-tree, verified until a chi-square test stops the search.

A vector is projected onto ``PROJECTIONS`` random directions with normal components. For two vectors at distance ``d`` the squared
distance of the projections is ``d * d`` times a chi-square variable of that many degrees, whatever the data. A
search takes projected neighbours in the order of their distance, verifies each on the original vectors, and stops once a
vector as near as the worst neighbour found would have been seen before with probability ``CONFIDENCE``: once the projected distance
passes ``d_k * sqrt(q)``, ``q`` being that quantile. Each true neighbour is found with at least that probability.

The top of the kd-tree is fitted on a bounded sample and cuts all rows into leaves; leaves with many rows are split again by
hash, so that a hot spot is several units. Each unit builds the lower levels over its own rows.
1. A query is searched in its own unit, which gives it a first distance ``d_k``.
2. With that it visits only leaves whose box lies within the radius of the test. Queries go there in blocks of
   bounded size; a unit tightens the distance further while it searches, and returns at most the neighbours asked for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthgrid.llm.frames import materialize
from hearthgrid.llm.vectors import embeddings, finite, lists, matrix

QUERY = "op12_nearest_vectors"
#: Approximate by nature; tests hold it against brute force.
ORACLE_SQL = None
NEIGHBOURS, PROJECTIONS, CONFIDENCE, SEED = 10, 8, 0.97, 7
#: The top of the tree is fitted on this many rows at most, those with the smallest hashes of their vec_id.
SAMPLE_ROWS = 4096
#: Levels of splits of the top; rows of a unit, queries of a block and rows of a unit's smallest leaf at most.
LEVELS, UNIT_ROWS, BLOCK_QUERIES, LEAF_ROWS = 5, 1 << 15, 1024, 64
#: Projections of equal vectors may differ by rounding; this much of their squared length is allowed for.
SLACK = 1e-9


def chi_square_quantile(share: float, degrees: int) -> float:
    """The value that a chi-square variable of an even number of degrees stays below with probability ``share``."""

    def below(x: float) -> float:
        term = total = 1.0
        for j in range(1, degrees // 2):
            term *= x / 2 / j
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < share:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return high


def directions(dim: int, projections: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, projections))


@dataclass
class Top:
    """The upper levels of the tree: node ``k`` has children ``2k + 1`` and ``2k + 2`` and cuts ``axis[k]`` at ``at[k]``."""

    axis: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range((len(self.axis) + 1).bit_length() - 1):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.at[node])
        return node - len(self.axis)

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point from the box of each leaf."""
        gap = np.maximum(np.maximum(self.low[None] - points[:, None], points[:, None] - self.high[None]), 0)
        return np.einsum("qld,qld->ql", gap, gap)


def fitted_top(sample: np.ndarray, levels: int) -> Top:
    """Median splits of the widest axis, level by level; an empty part is cut at zero."""
    nodes, dim = (1 << levels) - 1, sample.shape[1]
    axis, at = np.zeros(nodes, dtype=np.int64), np.zeros(nodes)
    parts = {0: (np.arange(len(sample)), np.full(dim, -np.inf), np.full(dim, np.inf))}
    for k in range(nodes):
        rows, low, high = parts.pop(k)
        points = sample[rows]
        if len(rows):
            axis[k] = int(np.argmax(points.max(0) - points.min(0)))
            at[k] = float(np.median(points[:, axis[k]]))
        right = points[:, axis[k]] >= at[k]
        below, above = high.copy(), low.copy()
        below[axis[k]], above[axis[k]] = min(high[axis[k]], at[k]), max(low[axis[k]], at[k])
        parts[2 * k + 1], parts[2 * k + 2] = (rows[~right], low, below), (rows[right], above, high)
    boxes = [parts[nodes + leaf] for leaf in range(nodes + 1)]
    return Top(axis, at, np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes]))


class Tree:
    """A kd-tree over the projections of one unit; leaves are consecutive rows of ``order``."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.points, self.order = points, np.arange(len(points))
        pending, leaves = [(0, len(points))], []
        while pending:
            a, b = pending.pop()
            if b - a <= leaf_rows:
                leaves.append((a, b))
                continue
            inside = points[self.order[a:b]]
            widest, middle = int(np.argmax(inside.max(0) - inside.min(0))), (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(inside[:, widest], middle)]
            pending += [(a, a + middle), (a + middle, b)]
        self.leaves = np.array(leaves).reshape(-1, 2)
        self.low = np.array([points[self.order[a:b]].min(0) for a, b in leaves])
        self.high = np.array([points[self.order[a:b]].max(0) for a, b in leaves])

    def rings(self, query: np.ndarray):
        """``(near, rows)``: leaves by their distance from the query, twice as many each time; ``near`` bounds what they hold from below."""
        gap = np.maximum(np.maximum(self.low - query, query - self.high), 0)
        far = np.einsum("ld,ld->l", gap, gap)
        by, begin, many = np.argsort(far, kind="stable"), 0, 1
        while begin < len(by):
            some = by[begin:begin + many]
            yield far[some[0]], np.concatenate([self.order[a:b] for a, b in self.leaves[some]])
            begin, many = begin + many, many * 2


def searched(ids: np.ndarray, vectors: np.ndarray, tree: Tree, own: int, query: np.ndarray, projected: np.ndarray, bound: float, k: int, quantile: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest found among a unit's rows, none farther than ``bound`` (squared): ids and squared distances, nearest first."""
    found, near = np.zeros(0, dtype=np.int64), np.zeros(0)
    slack = SLACK * (1.0 + float(projected @ projected))
    for least, rows in tree.rings(projected):
        if least > bound * quantile + slack:
            break  # the stopping test: whatever is left would have shown up nearer
        gap = tree.points[rows] - projected
        rows = rows[np.einsum("ij,ij->i", gap, gap) <= bound * quantile + slack]
        rows = rows[ids[rows] != own]
        gap = vectors[rows] - query
        far = (gap * gap).sum(1)
        stay = far <= bound
        found, near = np.concatenate([found, ids[rows[stay]]]), np.concatenate([near, far[stay]])
        best = np.lexsort((found, near))[:k]
        found, near = found[best], near[best]
        if len(near) == k:
            bound = min(bound, float(near[-1]))
    return found, near


def taking_part(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``(vec_id, embedding)`` of the rows that take part, one for each vec_id, and the length of their vectors (0: no row).

    Rows go that have no vec_id, or whose vector is null, empty, zero, holds null or non-finite components, or is not as long as the vector
    with the smallest vec_id. Of several vectors with one vec_id the smallest (in order of components) counts.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    first = rows.select("vec_id", F.size("embedding").alias("n")).orderBy("vec_id", "n").first()
    return (rows.filter(F.size("embedding") == first["n"]), first["n"]) if first else (rows, 0)


def units(rows: DataFrame, top: Top, projection: np.ndarray) -> tuple[DataFrame, dict[int, int]]:
    """Rows with ``leaf`` and ``unit`` (leaf and a hash of the vec_id), and how many units each leaf has."""
    dim = len(projection)

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = top.leaf(matrix(batch.column(1), dim) @ projection)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf.astype(np.int32))], ["vec_id", "embedding", "leaf"])

    found = materialize(rows.mapInArrow(placed, "vec_id long, embedding array<double>, leaf int"), "vector_leaves")
    parts = {r["leaf"]: -(-r["n"] // UNIT_ROWS) for r in found.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    several = F.create_map(*[F.lit(x) for leaf in sorted(parts) for x in (leaf, parts[leaf])])
    unit = F.struct("leaf", F.pmod(F.xxhash64("vec_id"), several[F.col("leaf")]).cast("int").alias("part"))
    return found.withColumn("unit", unit), parts


def nearest(vectors: DataFrame, every: int = 100, k: int = NEIGHBOURS, projections: int = PROJECTIONS, confidence: float = CONFIDENCE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each vec_id divisible by ``every`` the ``k`` nearest other rows found (all, if fewer).

    ``score`` is the Euclidean distance in double precision, ties go to the smaller vec_id. See ``taking_part`` for rows that
    count; copies under other vec_ids are neighbours like any other. No rows give no rows.
    """
    schema = "query_id long, vec_id long, score double"
    spark = vectors.sparkSession
    rows, dim = taking_part(vectors)
    rows = materialize(rows, "vectors")
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    quantile, projection = chi_square_quantile(confidence, projections), directions(dim, projections)
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE_ROWS).select("embedding").toArrow()
    top = fitted_top(matrix(sample.column(0), dim) @ projection, LEVELS)
    placed, parts = units(rows, top, projection)

    def at_home(table: pa.Table) -> pa.Table:
        """The queries of a unit among its own rows; one row each, with what was found."""
        ids, points = table.column("vec_id").to_numpy(), matrix(table.column("embedding"), dim)
        projected = points @ projection
        own = np.flatnonzero(ids % every == 0)
        tree = Tree(projected) if len(own) else None
        got = [searched(ids, points, tree, int(ids[q]), points[q], projected[q], math.inf, k, quantile) for q in own]
        kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))
        found = [[{"vec_id": int(v), "score": math.sqrt(s)} for v, s in zip(*g)] for g in got]
        bound = [float(g[1][-1]) if len(g[1]) == k else math.inf for g in got]
        return pa.table({"query_id": pa.array(ids[own]), "embedding": lists(points[own]), "unit": table.column("unit").combine_chunks().take(pa.array(own)),
                         "bound": pa.array(bound, pa.float64()), "found": pa.array(found, kind)})

    unit_type = "struct<leaf:int,part:int>"
    home = placed.groupBy("unit").applyInArrow(at_home, f"query_id long, embedding array<double>, unit {unit_type}, bound double, found array<struct<vec_id:long,score:double>>")
    home = materialize(home, "vector_homes")

    def abroad(batches):
        """Units of other leaves that a query has to visit, and the other units of its own leaf."""
        for batch in batches:
            if not batch.num_rows:
                continue
            points = matrix(batch.column(1), dim) @ projection
            slack = SLACK * (1.0 + np.einsum("ij,ij->i", points, points))
            within = top.distances(points) <= (batch.column(3).to_numpy() * quantile + slack)[:, None]
            leaf, part = (batch.column(2).field(c).to_numpy() for c in ("leaf", "part"))
            visits = [(q, x, p) for q, x in zip(*np.nonzero(within)) for p in range(parts.get(int(x), 0)) if (x, p) != (leaf[q], part[q])]
            if visits:
                row, x, p = (pa.array(np.array(c, dtype=t)) for c, t in zip(zip(*visits), (np.int64, np.int32, np.int32)))
                there = pa.StructArray.from_arrays([x, p], ["leaf", "part"])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), there, batch.column(3).take(row)], ["query_id", "embedding", "unit", "bound"])

    blocks = -(-home.count() // BLOCK_QUERIES)
    visits = home.select("query_id", "embedding", "unit", "bound").mapInArrow(abroad, f"query_id long, embedding array<double>, unit {unit_type}, bound double")
    visits = visits.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(blocks, 1))).cast("int"))
    here = placed.select("unit", "vec_id", "embedding", (F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0)).alias("block"))

    def visited(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block of queries among the rows of a unit."""
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, points = left.column("vec_id").to_numpy(), matrix(left.column("embedding"), dim)
        tree = Tree(points @ projection)
        queries, bounds, own = matrix(right.column("embedding"), dim), right.column("bound").to_numpy(), right.column("query_id").to_numpy()
        projected = queries @ projection
        got = [searched(ids, points, tree, int(own[q]), queries[q], projected[q], float(bounds[q]), k, quantile) for q in range(len(own))]
        return pa.table({"query_id": pa.array(np.repeat(own, [len(g[0]) for g in got])), "vec_id": pa.array(np.concatenate([g[0] for g in got])),
                         "score": pa.array(np.sqrt(np.concatenate([g[1] for g in got])))})

    away = here.groupBy("block", "unit").cogroup(visits.groupBy("block", "unit")).applyInArrow(visited, schema)
    near = home.select("query_id", F.explode("found").alias("f")).select("query_id", "f.vec_id", "f.score")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.union(away).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return nearest(embeddings(spark, folder))
