"""Vector compression: every part of a vector is coded by a small codebook that exact ball k-means fits.

Components become integers, so distances, ties and means are exact. A point that had entry ``c`` lies within the ball
around ``c``, whose radius is the largest distance of its points. Only entries that are no farther from ``c`` than twice
the radius are neighbours of the ball and can win one of its points. Sorted by distance from ``c`` they cut the ball into
rings: a point at distance ``d`` can only go to the neighbours within ``2 d``, the first few of the list. In the stable
core, closer to ``c`` than half way to the first neighbour, no point is compared at all.

Each round is one scan: the codebooks (a fixed number of entries) travel to the tasks, a batch's own radii bound its balls, and a
task adds the sums of its entries as a few rows of its own, from which the next codebooks come.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.llm.frames import materialize
from hearthgrid.llm.vectors import embeddings, finite, lists, matrix

QUERY = "op13_vector_codes"
SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Largest integer component; larger ones count as this, so that squared distances stay within 64 bits.
LARGEST = 1 << 26


def integers(vectors: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)`` of every component."""
    return np.floor(np.clip(vectors * SCALE, -LARGEST, LARGEST)).astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def first_guess(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """An entry that is near in the first component; where the balls start from."""
    order = np.argsort(book[:, 0], kind="stable")
    at = np.searchsorted(book[order, 0], points[:, 0])
    return order[np.minimum(at, len(book) - 1)]


def reassigned(points: np.ndarray, book: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry (ties to the lower index) and squared distance of each point, from entries ``start``; and how many compares it took."""
    gaps = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(gaps, -1)
    others = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
    gaps = np.take_along_axis(gaps, others, axis=1)
    best, code = squared(points, book[start]), start.copy()
    radius = np.zeros(len(book), dtype=np.int64)
    np.maximum.at(radius, start, best)
    # Twice a distance is squared here: an entry farther than that is farther from the point than its own one is.
    members = np.argsort(start, kind="stable")
    limits = np.searchsorted(start[members], np.arange(len(book) + 1))
    ring = np.zeros(len(points), dtype=np.int64)
    for c in np.flatnonzero(np.diff(limits)):
        neighbours = gaps[c, :np.searchsorted(gaps[c], 4 * radius[c], "right")]
        own = members[limits[c]:limits[c + 1]]
        ring[own] = np.searchsorted(neighbours, 4 * best[own], "right")
    compares = int(ring.sum())
    outer = np.argsort(-ring, kind="stable")
    reach = len(points) - np.searchsorted(np.sort(ring), np.arange(ring.max(initial=0)), "right")
    for j, n in enumerate(reach):
        rows = outer[:n]
        candidate = others[start[rows], j]
        far = squared(points[rows], book[candidate])
        wins = (far < best[rows]) | ((far == best[rows]) & (candidate < code[rows]))
        rows = rows[wins]
        best[rows], code[rows] = far[wins], candidate[wins]
    return code, best, compares


def coded(values: np.ndarray, books: np.ndarray, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances (rows x parts) of integer vectors; ``start`` holds earlier codes, if any."""
    width = books.shape[2]
    codes = np.empty((len(values), len(books)), dtype=np.uint8)
    errors = np.empty((len(values), len(books)), dtype=np.int64)
    for p, book in enumerate(books):
        points = values[:, p * width:(p + 1) * width]
        guess = first_guess(points, book) if start is None else start[:, p].astype(np.int64)
        codes[:, p], errors[:, p], _ = reassigned(points, book, guess)
    return codes, errors


def entry_sums(values: np.ndarray, codes: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Number (parts x entries) and sum (with components) of the points of each entry."""
    parts = codes.shape[1]
    width = values.shape[1] // parts
    count, total = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
    for p in range(parts):
        count[p] = np.bincount(codes[:, p], minlength=entries)
        for k in range(width):  # a batch's sums are far below 2 ** 53
            total[p, :, k] = np.bincount(codes[:, p], weights=values[:, p * width + k], minlength=entries).astype(np.int64)
    return count, total


def _round(rows: DataFrame, books: np.ndarray, again: bool) -> DataFrame:
    """Rows with their codes under ``books``, and rows of sums: ``part, entry, n, total`` for the entries that a task used."""
    parts, entries, width = books.shape
    source = "vector" if again else "embedding"
    label = rows.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, vector array<int>, codes binary, part int, entry int, n long, total array<long>"
    names = [f.split()[0] for f in schema.replace(label, "x").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, kind = 0, 0, None
        for batch in batches:
            kind = batch.column(1).type
            if not batch.num_rows:
                continue
            values = matrix(batch.column(2), parts * width, np.int64) if again else integers(matrix(batch.column(2), parts * width))
            earlier = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts) if again else None
            codes, _ = coded(values, books, earlier)
            n, s = entry_sums(values, codes, entries)
            count, total = count + n, total + s
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists(values.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                 none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64()))], names)
        if kind is not None and np.any(count):
            p, e = np.nonzero(count)
            none = pa.nulls(len(p))
            yield pa.RecordBatch.from_arrays(
                [none.cast(pa.int64()), none.cast(kind), none.cast(pa.list_(pa.int32())), none.cast(pa.binary()),
                 pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), lists(total[p, e])], names)

    return rows.select("vec_id", "label", source, *(["codes"] if again else [])).mapInArrow(run, schema)


def updated(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Codebooks whose entries are the floored means of their points; unused entries stay."""
    books = books.copy()
    columns = [F.sum(F.col("total")[k]) for k in range(books.shape[2])]
    for part, entry, n, *total in sums.groupBy("part", "entry").agg(F.sum("n"), *columns).collect():
        books[part, entry] = [t // n for t in total]
    return books


def taking_part(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """The rows ``(vec_id, label, embedding)`` that are coded, and the length of their vectors (0: no row).

    Rows go whose vector is null, holds null or non-finite components, has a length that ``parts`` doesn't divide (zero too), or
    another length than the vector with the smallest vec_id. Rows without a vec_id are coded, after the others.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(finite(F.col("embedding")) & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(1).select(F.size("embedding")).first()
    dim = first[0] if first else 0
    return rows.filter(F.size("embedding") == dim), dim


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, codes, error)`` of every row that takes part (see ``taking_part``), and the codebooks (parts x entries x width).

    Codebooks start from the smallest vec_ids (of equal ones, the smaller vector first; fewer rows make fewer entries). Repeated rows are
    coded and counted like any other. Components beyond ``LARGEST / SCALE`` count as that. No rows give no rows.
    """
    rows, dim = taking_part(vectors, parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect() if dim else []
    width = dim // parts
    values = integers(np.array([r[0] for r in first], dtype=np.float64).reshape(len(first), dim))
    books = values.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    label = rows.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, codes binary, error long"
    if not dim:
        return rows.select("vec_id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(0).cast("long").alias("error")).filter(F.lit(False)), books
    for k in range(rounds):
        table = materialize(_round(rows, books, k > 0), "vector_codes")
        books = updated(books, table.filter("entry IS NOT NULL"))
        rows = table.filter("entry IS NULL")
    again = rounds > 0

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = matrix(batch.column(2), dim, np.int64) if again else integers(matrix(batch.column(2), dim))
                earlier = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts) if again else None
                codes, errors = coded(values, books, earlier)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors.sum(1))], ["vec_id", "label", "codes", "error"])

    chosen = rows.select("vec_id", "label", "vector", "codes") if again else rows.select("vec_id", "label", "embedding")
    return chosen.mapInArrow(last, schema), books


def book_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Code and error of every vector, the error of its label, and the codebooks' digest."""
    found, books = vector_codes(embeddings(spark, folder))
    found = materialize(found, "vector_errors")
    by_label = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return found.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds spelled out: points, entries, nearest entries, means."""
    kept = """kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, embedding FROM embeddings
      WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)"""
    width = f"(len(embedding) // {PARTS})"
    points = f"""points AS MATERIALIZED (SELECT r, vec_id, label, p.range AS part,
      [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding[p.range * {width} + 1:(p.range + 1) * {width}]] AS v FROM kept, range({PARTS}) p)"""
    steps = [kept, points, f"book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM points WHERE r <= {ENTRIES})"]
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT r, part, min(d * {ENTRIES} + entry) % {ENTRIES} AS entry, min(d) AS d FROM (
          SELECT p.r, p.part, b.entry, CAST(list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(p.v, b.v)]) AS BIGINT) AS d FROM points p JOIN book{k} b USING (part)) GROUP BY r, part)""")
        if k < ROUNDS:
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (
              SELECT part, entry, list(m ORDER BY i) AS v FROM (SELECT part, entry, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM (
                SELECT n.part, n.entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{k} n JOIN points USING (r, part)) GROUP BY part, entry, i) GROUP BY part, entry) m USING (part, entry))""")
    steps.append(f"""final AS (SELECT r, vec_id, any_value(label) AS label, string_agg(printf('%02x', n.entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
      FROM near{ROUNDS} n JOIN points USING (r, part) GROUP BY r, vec_id)""")
    digest = f"SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, i)) FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM book{ROUNDS})"
    return (f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, ({digest}) AS codebooks_sha256 FROM final")


ORACLE_SQL = _sql()
