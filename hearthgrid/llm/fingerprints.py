"""SimHash document fingerprints: weighted term hashes vote on signed bits; block tables find all near fingerprints.

Terms are pairs of neighbouring words in lower case (A-Z), weighted by ``1 + log2`` of their count in the text, rounded down.
Each term's XXH64 gives 64 votes and a mix of it 64 more; a bit is set where more than half of the weight says so.

Fingerprints within a Hamming radius: the bits are cut into ``blocks`` blocks, and two fingerprints that differ in at
most ``radius`` bits agree on ``blocks - radius`` of them at least. One table for each choice of that many blocks holds the
chosen blocks in front; queries meet the table's rows that agree there and are checked in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.llm.batches import U64, bit_votes, counted_hashes, packed, slices, spread, texts, words_of, xxh64
from hearthgrid.llm.frames import documents, materialize

QUERY = "op2_fingerprints"
ORACLE_SQL = None
TERM_WORDS, BITS = 2, 128
#: A term's weight does not pass this, so that 255 // TOP_WEIGHT votes fit into one byte counter.
TOP_WEIGHT = 15
RADIUS, BLOCKS = 3, 5
#: Ranges of doc_ids per shuffle partition.
RANGES_PER_PARTITION = 2


def simhash(items: list[bytes]) -> np.ndarray:
    """Fingerprints as rows of two 64-bit numbers; a text of one word has that word as its term, one without words is zero."""
    out = np.zeros((len(items), 2), dtype=U64)
    for lo, hi in slices(items):
        words = words_of(items[lo:hi])
        start, length, first = words.shingles(TERM_WORDS)
        hashes, count, limits = counted_hashes(xxh64(words.data, start, length), first)
        weight = np.minimum(np.frexp(count)[1], TOP_WEIGHT).astype(U64)
        total = np.add.reduceat(np.append(weight, U64(0)), np.minimum(limits[:-1], len(weight))) if len(hashes) else np.zeros(hi - lo, U64)
        total = np.where(np.diff(limits) > 0, total, 0).astype(np.int64)
        for k, h in enumerate((hashes, spread(hashes))):
            out[lo:hi, k] = packed(2 * bit_votes(h, limits, weight, TOP_WEIGHT) > total[:, None])
    return out


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1)


def shown(prints: np.ndarray) -> list[str]:
    return [f"{int(a):016x}{int(b):016x}" for a, b in prints]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, hi long, lo long)`` for every row; a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = simhash(texts(batch.column(1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints[:, 0]), pa.array(prints[:, 1])], ["doc_id", "hi", "lo"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, hi long, lo long")


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """For each table, which bits of either half its chosen blocks take."""
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << b for b in range(a, z)) for a, z in zip(cuts, cuts[1:])]
    whole = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [(mask & (1 << 64) - 1, mask >> 64) for mask in whole]


def _signed(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``(q_hi, q_lo, hi, lo, distance)``: every distinct fingerprint of ``prints`` within ``radius`` bits of each of ``queries``.

    A pair is found in the first table on whose blocks it agrees and nowhere else. Equal fingerprints are pairs of
    distance 0. Hot blocks are skewed joins, which adaptive execution splits.
    """
    masks = block_masks(radius, blocks)
    # The first half's blocks, the second half's blocks, and the table's number.
    tables = F.posexplode(F.array(*[F.struct(_signed(a).alias("a"), _signed(b).alias("b")) for a, b in masks])).alias("table", "m")

    def permuted(rows: DataFrame, hi: str, lo: str) -> DataFrame:
        rows = rows.select(F.col("hi").alias(hi), F.col("lo").alias(lo)).distinct().select(hi, lo, tables)
        return rows.select(hi, lo, "table", F.col(hi).bitwiseAND(F.col("m.a")).alias("ka"), F.col(lo).bitwiseAND(F.col("m.b")).alias("kb"))

    dh, dl = F.col("q_hi").bitwiseXOR(F.col("hi")), F.col("q_lo").bitwiseXOR(F.col("lo"))
    distance = F.bit_count(dh) + F.bit_count(dl)
    agree = [dh.bitwiseAND(_signed(a)).bitwiseOR(dl.bitwiseAND(_signed(b))) == 0 for a, b in masks]
    first = F.lit(len(masks))
    for k in reversed(range(len(masks))):
        first = F.when(agree[k], k).otherwise(first)
    left, right = permuted(queries, "q_hi", "q_lo"), permuted(prints, "hi", "lo")
    met = left.join(right, (left["table"] == right["table"]) & (left["ka"] == right["ka"]) & (left["kb"] == right["kb"]) & (distance <= radius) & (left["table"] == first))
    return met.select("q_hi", "q_lo", "hi", "lo", distance.alias("distance"))


def neighbours_in_order(docs: DataFrame) -> DataFrame:
    """``(r, last, id, doc_id, text)``: the rows dealt out by ranges ``r`` of doc_id, with the first rows of the next range behind.

    The rows that ``last`` marks are there for the text only. The range after the last is the first one. Ranges come
    from quantiles of doc_id, so they hold about as many rows each; only one number per range goes through the driver.
    """
    spark = docs.sparkSession
    missing = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(missing)).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    cuts = ids.filter("id IS NOT NULL").approxQuantile("id", [k / ranges for k in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    cuts = np.unique(np.array(cuts, dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(id):
        return pd.Series(np.searchsorted(cuts, id.to_numpy(), "right").astype(np.int32))

    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(missing)).alias("id"))
    firsts = sorted(tuple(r) for r in narrow.withColumn("r", range_of("id")).groupBy("r").agg(F.min("id")).collect())
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}  # the first range's row closes the last one
    starts = np.array(sorted(before), dtype=np.int64)
    targets = np.array([before[s] for s in starts.tolist()], dtype=np.int32)

    @F.pandas_udf("int")
    def closes(id):
        values = id.to_numpy()
        at = np.minimum(np.searchsorted(starts, values), len(starts) - 1)
        return pd.Series(targets[at]).where(starts[at] == values)

    dealt = rows.withColumn("own", range_of("id")).withColumn("also", closes("id"))
    roles = F.explode(F.array(F.struct(F.col("own").alias("r"), F.lit(0).alias("last")), F.struct(F.col("also").alias("r"), F.lit(1).alias("last")))).alias("role")
    both = dealt.select(roles, "id", "doc_id", "text").filter("role.r IS NOT NULL").select("role.r", "role.last", "id", "doc_id", "text")
    return both.repartition("r").sortWithinPartitions("r", "last", "id", F.xxhash64("text"))


def edited(text: str, following: str) -> str:
    """``text`` whose last half (rounded down) is replaced by as many first characters of the next text, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compared(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and how alike its own is to that and to the next document's.

    The next document is the next row by doc_id (rows without one come first, equal doc_ids are ordered by text hash); after the last
    comes the first, and a single row is its own next. Null texts count as empty. No rows give no rows.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, hi long, lo long"

    def finished(held: list[tuple]) -> pa.RecordBatch:
        """Rows of (range, last, doc_id, text) whose next row is behind them; the last of them is only looked at."""
        rows = [(d, t, held[k + 1][3]) for k, (r, last, d, t) in enumerate(held[:-1]) if not last and held[k + 1][0] == r]
        prints = simhash([t.encode() for _, _, _, t in held])
        at = np.array([k for k, (r, last, _, _) in enumerate(held[:-1]) if not last and held[k + 1][0] == r], dtype=np.int64)
        own, following = prints[at], prints[at + 1]
        changed = [edited(t, n) for _, t, n in rows]
        after = simhash([c.encode() for c in changed])
        return pa.RecordBatch.from_arrays(
            [pa.array([d for d, _, _ in rows], pa.int64()), pa.array([len(t) for _, t, _ in rows], pa.int64()),
             pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()), pa.array(shown(own), pa.string()), pa.array(shown(after), pa.string()),
             pa.array(1 - differing(own, after) / BITS), pa.array(1 - differing(own, following) / BITS), pa.array(own[:, 0].view(np.int64)), pa.array(own[:, 1].view(np.int64))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "hi", "lo"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                held.append(row)
                if len(held) > 256:
                    yield finished(held)
                    held = held[-1:]
        if len(held) > 1:
            yield finished(held)

    return neighbours_in_order(docs).select("r", "last", "doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document, and for doc_ids divisible by 20 how many other documents lie within three bits."""
    found = materialize(compared(documents(spark, folder)), "compared")
    counted = found.groupBy("hi", "lo").agg(F.count("*").alias("n"))
    asked = found.filter("doc_id % 20 = 0").select("hi", "lo").distinct()
    near = within_radius(asked, counted.select("hi", "lo")).join(counted, ["hi", "lo"]).groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg(F.sum("n").alias("n"))
    others = F.when(F.col("doc_id") % 20 == 0, F.col("n") - 1).alias("n_near")
    return found.join(near, ["hi", "lo"], "left").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", others)
