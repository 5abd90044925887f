"""Vector codes and nearest neighbours against brute force."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from hearthgrid.llm import nearest_vectors, vector_codes

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label string, codes int, entry string, unit int, rank double"


def read(name):
    return duckdb.sql(f"select * from '{FOLDER}/{name}.parquet'").fetchall()


def table(spark, rows):
    """Rows (vec_id, vector, label) with further columns whose names clash."""
    return spark.createDataFrame([(v, None if x is None else [None if c is None else float(c) for c in x], lab, 1, "e", None, 0.5) for v, x, lab in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def awkward_rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 32))
    rows = [(k, (centres[k % 6] + 0.2 * rng.normal(size=32)).tolist(), None if k % 5 == 0 else f"l{k % 3}") for k in range(400)]
    rows += [(400 + k, [0.5] * 32, "copy") for k in range(300)]
    bad = [None, [], [0.0] * 32, [None] + [1.0] * 31, [math.nan] * 32, [math.inf] + [0.0] * 31, [1.0] * 16, [1.0] * 33]
    rows += [(1000 + k, x, "bad") for k, x in enumerate(bad)] + [(7, rows[7][1], "again"), (100, rows[100][1], "l1"), (None, rows[8][1], None), (None, None, None)]
    return rows


def plain_codes(rows, parts, entries, rounds):
    """Codes by comparing every part with every entry, in Python's integers."""
    kept = [(v, [math.floor(256 * c) for c in x], lab) for v, x, lab in rows if x and None not in x and all(map(math.isfinite, x)) and len(x) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = lambda x, p: tuple(x[p * width:(p + 1) * width])
    books = [[cut(x, p) for _, x, _ in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for step in range(rounds + 1):
        codes = [[nearest(cut(x, p), books[p]) for p in range(parts)] for _, x, _ in kept]
        if step < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    own = [cut(x, p) for (_, x, _), c in zip(kept, codes) if c[p][1] == k]
                    if own:
                        books[p][k] = tuple(sum(c) // len(own) for c in zip(*own))
    return Counter((v, lab, bytes(k for _, k in c), sum(d for d, _ in c)) for (v, _, lab), c in zip(kept, codes)), books


@pytest.mark.parametrize("shape", [(4, 16, 2), (8, 64, 1), (2, 5, 0), (16, 1000 // 4, 2)])
def test_codes_equal_brute_force(spark, awkward_rows, shape):
    want, books = plain_codes(awkward_rows, *shape)
    got, found = vector_codes.vector_codes(table(spark, awkward_rows), *shape)
    assert Counter((r["vec_id"], r["label"], bytes(r["codes"]), r["error"]) for r in got.collect()) == want
    assert [[tuple(e) for e in book] for book in found.tolist()] == books


def test_balls_skip_compares_and_lose_none():
    rng = np.random.default_rng(4)
    book = rng.integers(-200, 200, (64, 4))
    points = book[rng.integers(0, 64, 5000)] + rng.integers(-15, 16, (5000, 4))
    all_far = ((points[:, None] - book[None]) ** 2).sum(2)
    code, far, compares = vector_codes.reassigned(points, book, rng.integers(0, 64, 5000))
    assert (code == all_far.argmin(1)).all() and (far == all_far.min(1)).all()
    again, _, fewer = vector_codes.reassigned(points, book, code)
    assert (again == code).all() and fewer < 5000 < compares  # most points lie in stable cores now


def test_codes_without_rows(spark):
    for rows in ([], [(1, None, "x"), (2, [1.0] * 15, None)]):
        got, books = vector_codes.vector_codes(table(spark, rows))
        assert got.collect() == [] and books.size == 0


def plain_nearest(rows, every, k):
    best = {}
    for v, x, _ in rows:
        if v is not None and x and None not in x and all(map(math.isfinite, x)) and any(x) and (v not in best or x < best[v]):
            best[v] = x
    dim = len(best[min(best)]) if best else 0
    ids = np.array(sorted(v for v in best if len(best[v]) == dim))
    matrix = np.array([best[v] for v in ids.tolist()])
    out = {}
    for q in ids[ids % every == 0].tolist():
        far = np.sqrt(((matrix - np.array(best[q])) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, far)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(far[j])) for j in order]
    return out


def lists_of(frame):
    out = {}
    for r in sorted(map(tuple, frame.collect()), key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(r[1:])
    assert all([x[0] for x in v] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [(v, s) for _, v, s in found] for q, found in out.items()}


def test_nearest_with_full_confidence_equals_brute_force(spark, awkward_rows, monkeypatch):
    monkeypatch.setattr(nearest_vectors, "UNIT_ROWS", 40)
    monkeypatch.setattr(nearest_vectors, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(nearest_vectors, "LEAF_ROWS", 4)
    want = plain_nearest(awkward_rows, 10, 10)
    got = lists_of(nearest_vectors.nearest(table(spark, awkward_rows), every=10, confidence=1 - 1e-12))
    assert got.keys() == want.keys()
    for q, rows in want.items():
        assert [v for v, _ in got[q]] == [v for v, _ in rows] and np.allclose([s for _, s in got[q]], [s for _, s in rows], rtol=1e-13, atol=0)


def test_few_or_no_candidates(spark):
    assert nearest_vectors.nearest(table(spark, [])).collect() == []
    assert nearest_vectors.nearest(table(spark, [(0, [1.0, 2.0], None)])).collect() == []
    got = nearest_vectors.nearest(table(spark, [(0, [1.0, 2.0], None), (1, [1.0, 4.0], None), (100, [1.0, 2.0], None)]))
    assert Counter(map(tuple, got.collect())) == Counter([(0, 1, 100, 0.0), (0, 2, 1, 2.0), (100, 1, 0, 0.0), (100, 2, 1, 2.0)])


def test_recall(spark):
    rows = [(v, x, None) for v, x, _ in read("embeddings")]
    want = plain_nearest(rows, 10, 10)
    got = lists_of(nearest_vectors.nearest(spark.read.parquet(f"{FOLDER}/embeddings.parquet"), every=10))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_quantile():
    # Fixed values of the chi-square distribution.
    for share, degrees, value in [(0.95, 2, 5.991465), (0.95, 8, 15.507313), (0.99, 8, 20.090235), (0.5, 4, 3.356694)]:
        assert abs(nearest_vectors.chi_square_quantile(share, degrees) - value) < 1e-5


def test_digest_of_books():
    assert vector_codes.book_digest(np.array([[[1, -2], [3, 4]]])) == hashlib.sha256(b"1,-2,3,4").hexdigest()
