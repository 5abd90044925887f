"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by the number of their distinct shingles (powers of two). An item's sketch is the list of
its smallest shingle hashes. A document that contains at least ``need`` of an item's ``n`` shingles misses at most ``n - need``
of them, so it shares one of the ``n - need + 1`` smallest hashes for certain: with sketches of that length the search
has no false negative, however long the document is. (Banded signatures of whole documents would have one: a short
item's Jaccard similarity with a long document is near zero.) A partition is left out for documents that have fewer
shingles than its smallest ``need``. Pairs that share a sketch hash are verified on the shingles' bytes.

Items are taken in blocks of bounded size, each block against all documents in one scan without a shuffle; the
number of blocks follows the number of items.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.llm.batches import PUNCTUATION, Words, slices, texts, words_of, xxh64
from hearthgrid.llm.frames import corpus_session, documents, materialize

QUERY = "op5_decontamination"
SHINGLE, CONTAINMENT = 5, 0.8
#: Text of the items that one block holds at most (but for one longer item).
BLOCK_BYTES = 16 << 20


def needed(n: int, containment: float) -> int:
    """How many of ``n`` shingles reach the containment (exact for thresholds of up to six decimals)."""
    return max(1, -(-n * round(containment * 1_000_000) // 1_000_000))


def runs(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length, hash and text limits of all runs of exactly ``width`` words; shorter texts have none."""
    start, length, first = words.shingles(width)
    whole = np.repeat(np.diff(words.first) >= width, np.diff(first))
    kept = np.concatenate([[0], np.cumsum(whole)])[first]
    start, length = start[whole], length[whole]
    return start, length, xxh64(words.data, start, length), kept


class Partition:
    """Items of one shingle width whose shingle counts share a power of two, behind one table of sketch hashes."""

    def __init__(self, width: int, members: list[tuple[int, dict[bytes, int]]], containment: float):
        self.width = width
        self.need = [needed(len(s), containment) for _, s in members]
        self.least = min(self.need)
        self.items = [item for item, _ in members]
        self.shingles = [frozenset(s) for _, s in members]
        self.hashes = [np.sort(np.fromiter(s.values(), np.uint64, len(s))) for _, s in members]
        sketch = [(h, k) for k, hashes in enumerate(self.hashes) for h in hashes[:len(hashes) - self.need[k] + 1].tolist()]
        sketch.sort()
        self.sketch = np.array([h for h, _ in sketch], dtype=np.uint64)
        self.owner = np.array([k for _, k in sketch], dtype=np.int64)
        self.coarse = np.zeros(1 << 16, dtype=bool)
        self.coarse[(self.sketch >> np.uint64(48)).astype(np.int64)] = True

    def found(self, words: Words, start, length, hashes, first) -> Iterator[tuple[int, int, int]]:
        """``(text number, member, shared shingles)`` for the items that a text contains."""
        may = np.flatnonzero(self.coarse[(hashes >> np.uint64(48)).astype(np.int64)])
        lo, hi = np.searchsorted(self.sketch, hashes[may], "left"), np.searchsorted(self.sketch, hashes[may], "right")
        may, lo, hi = may[hi > lo], lo[hi > lo], hi[hi > lo]
        text = np.searchsorted(first, may, "right") - 1
        long_enough = np.diff(first)[text] >= self.least
        pairs = {(t, k) for t, a, b in zip(text[long_enough].tolist(), lo[long_enough].tolist(), hi[long_enough].tolist()) for k in self.owner[a:b].tolist()}
        for t, k in sorted(pairs):
            a, b = int(first[t]), int(first[t + 1])
            same = a + np.flatnonzero(np.isin(hashes[a:b], self.hashes[k]))
            shared = {bytes(words.data[start[i]:start[i] + length[i]]) for i in same.tolist()} & self.shingles[k]
            if len(shared) >= self.need[k]:
                yield t, k, len(shared)


class Block:
    """A bounded set of items, ready to be searched in documents."""

    def __init__(self, items: list[tuple[int, bytes]], shingle: int = SHINGLE, containment: float = CONTAINMENT):
        words = words_of([t for _, t in items], PUNCTUATION) if items else None
        grouped: dict[tuple[int, int], list] = defaultdict(list)
        for k, (item, _) in enumerate(items):
            count = int(words.first[k + 1] - words.first[k])
            if not count:
                continue
            width = min(shingle, count)
            lo, hi = int(words.first[k]), int(words.first[k + 1]) - width + 1
            spans = [(int(words.start[i]), int(words.end[i + width - 1])) for i in range(lo, hi)]
            hashes = xxh64(words.data, np.array([a for a, _ in spans]), np.array([b - a for a, b in spans]))
            distinct = {bytes(words.data[a:b]): int(h) for (a, b), h in zip(spans, hashes)}
            grouped[width, (len(distinct) - 1).bit_length()].append((item, distinct))
        self.partitions = [Partition(width, members, containment) for (width, _), members in sorted(grouped.items())]

    def search(self, items: list[bytes]) -> list[tuple[int, int, int, int]]:
        """``(text number, item, shared, shingles of the item)`` for all items contained in the texts."""
        out = []
        for lo, hi in slices(items):
            words = words_of(items[lo:hi], PUNCTUATION)
            at = {width: runs(words, width) for width in {p.width for p in self.partitions}}
            for p in self.partitions:
                out += [(lo + t, p.items[k], shared, len(p.shingles[k])) for t, k, shared in p.found(words, *at[p.width])]
        return out


def blocks(items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> Iterator[Block]:
    """The items in blocks of about BLOCK_BYTES of text; one block at a time is on the driver."""
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 + size // BLOCK_BYTES
    for k in range(count):
        mine = named.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(count)) == k).distinct().orderBy("item_id", "text")
        yield Block([(r["item_id"], r["text"].encode()) for r in mine.collect()], shingle, containment)


def contained(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item, containment)`` for each row of ``docs`` and item it contains.

    Words are runs of letters, digits and non-ASCII characters in lower case (A-Z). A shingle is ``shingle`` words;
    an item of fewer words is one shingle of its own width; items and documents without words (null, empty) are in no
    pair. Repeated documents and repeated items each give their own rows, equal ones excepted. No rows on either side give no rows.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_shared int, n_item int"
    parts = []
    for block in blocks(items, shingle, containment):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = block.search(texts(batch.column(1)))
                ids = batch.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int32()), pa.array([h[3] for h in hits], pa.int32())],
                    ["doc_id", "item_id", "n_shared", "n_item"],
                )

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        parts.append(materialize(part, "contained") if parts else part)
    found = reduce(DataFrame.union, parts, spark.createDataFrame([], schema)) if len(parts) != 1 else parts[0]
    return found.distinct().withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs``, all columns, that contain none of the items."""
    place = docs.columns.index("text")
    for k, block in enumerate(blocks(items, shingle, containment)):
        docs = materialize(docs, "decontaminated") if k else docs

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stay = np.ones(batch.num_rows, dtype=bool)
                stay[[h[0] for h in block.search(texts(batch.column(place)))]] = False
                yield batch.filter(pa.array(stay))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item that a document contains, by five-word shingles and a containment of 0.8."""
    return contained(documents(spark, folder), corpus_session(spark).read.parquet(f"{folder}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), words AS (
  SELECT kind, id, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda w: w <> '') AS w FROM texts
), widths AS (
  SELECT DISTINCT least(5, len(w)) AS n FROM words WHERE kind = 'i' AND len(w) > 0
), runs AS (
  SELECT DISTINCT kind, id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
  FROM words JOIN widths ON len(w) >= n AND (kind = 'd' OR n = least(5, len(w)))
), items AS (
  SELECT id, n, s, count(*) OVER (PARTITION BY id) AS n_item FROM runs WHERE kind = 'i'
)
SELECT d.id AS doc_id, i.id AS item_id, count(*)::INTEGER AS n_shared, max(n_item)::INTEGER AS n_item,
       count(*)::DOUBLE / max(n_item) AS containment
FROM items i JOIN runs d ON d.kind = 'd' AND d.n = i.n AND d.s = i.s
GROUP BY d.id, i.id HAVING count(*) * 10 >= max(n_item) * 8
"""
