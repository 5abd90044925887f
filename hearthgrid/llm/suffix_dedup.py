"""Removal of repeated byte strings by bucket-pointer refinement over a sparse set of suffixes.

Every byte position has a bucket, named by a 64-bit number: first by its own byte, then buckets of twice the width
come from pairs of buckets at the same and at a later offset, each round reusing the one before (``pointers``).
Not every suffix has to be sorted: a string of ``length`` bytes is answered for by the position of the smallest
bucket of ``GRAM`` bytes in it (the leftmost of several), which is the same in every copy. That leaves about one
position in 85, an anchor with the run of string starts it answers for.

1. Anchors meet in their bucket. One that is alone there has no repeated string.
2. In a bucket, anchors whose whole surroundings (all their strings) are equal are repeated altogether. The others, and one anchor
   for each set of equal ones, are refined: their starts are cut into blocks of 32, and a block's bucket is the
   stretch all its strings share. Equal blocks are repeated altogether; blocks alone in their bucket are not at all;
   the rest is halved, and the bucket of a half comes from the bucket of the whole and the bytes the half adds.
   Six rounds reach single strings.

Each round counts rows per bucket and joins the counts back; no group is gathered or paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.llm.batches import U64, slices
from hearthgrid.llm.frames import documents, materialize

QUERY = "op10_suffix_dedup"
ORACLE_SQL = None
LENGTH, GRAM, BLOCK = 200, 32, 32
#: Bytes of text worked on at a time; a longer text is worked through in such stretches.
STRETCH = 1 << 20
PLACE_BITS = 22
KEY = ["id", "h"]
M1, M2, M3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xFF51AFD7ED558CCD)


def joined_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of the bucket that follows from two buckets (in this order)."""
    with np.errstate(over="ignore"):
        t = a * M1
        t ^= b + M2
        t *= M3
        t ^= t >> U64(32)
    return t


with np.errstate(over="ignore"):
    BYTE_NAMES = joined_name(np.arange(256, dtype=U64) * M3, np.arange(256, dtype=U64) + M1)


def pointers(data: np.ndarray, widest: int) -> dict[int, np.ndarray]:
    """Bucket names of every position for widths 1, 2, 4 up to ``widest``; only those from GRAM on are kept."""
    width, names, kept = 1, BYTE_NAMES[data], {}
    while True:
        if width >= min(GRAM, widest):
            kept[width] = names
        if width * 2 > widest or len(names) <= width:
            return kept
        names = joined_name(names[:-width], names[width:])
        width *= 2


def widest_within(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def name_of(names: np.ndarray, width: int, start: np.ndarray, size: np.ndarray, pieces: int) -> np.ndarray:
    """The name of ``size`` bytes from ``start`` by ``pieces`` overlapping buckets of ``width``."""
    out = names[start]
    for k in range(1, pieces):
        out = joined_name(out, names[start + (size - width) * k // (pieces - 1)])
    return joined_name(out, size.astype(U64))


def least_in_window(keys: np.ndarray, window: int) -> np.ndarray:
    """Smallest of each ``window`` consecutive keys, by doubling."""
    have = 1
    while have * 2 <= window:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    rest = window - have
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def anchors_of(data: np.ndarray, limits: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts that lie one behind the other: place, bucket, surroundings, smallest and largest distance to a start."""
    starts = np.zeros(len(data), dtype=bool)
    for a, b in zip(limits[:-1], limits[1:]):
        if b - a >= length:
            starts[a:b - length + 1] = True
    first = np.flatnonzero(starts)
    none = np.zeros(0, dtype=np.int64)
    if not len(first):
        return none, none.astype(U64), none.astype(U64), none, none
    wide = widest_within(length)
    names = pointers(data, wide)
    keys = (names[GRAM] >> U64(PLACE_BITS)) << U64(PLACE_BITS) | np.arange(len(names[GRAM]), dtype=U64)
    least = least_in_window(keys, length - GRAM + 1)
    place = (least[first] & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    owner = np.searchsorted(limits, first, "right")
    fresh = np.ones(len(first), dtype=bool)
    fresh[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    lowest, highest = first[at], first[np.append(at[1:], len(first)) - 1]
    place = place[at]
    pieces = -(-(2 * length - GRAM) // wide)
    around = name_of(names[wide], wide, lowest, highest - lowest + length, pieces)
    around = joined_name(around, (place - highest).astype(U64))
    return place, names[GRAM][place], around, place - highest, place - lowest


def stretches(items: list[bytes], length: int, stretch: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray, tuple[int, int] | None]]:
    """``(parts, data, limits, own)``: several whole texts, or a stretch of a long one; a part is (text, offset).

    Stretches of a long text overlap, so that every string an anchor of the range ``own`` answers for lies in one of them.
    """
    for lo, hi in slices(items, stretch):
        if hi - lo == 1 and len(items[lo]) > stretch:
            text = items[lo]
            for a in range(0, len(text) - GRAM + 1, stretch):
                begin, end = max(0, a - (length - GRAM)), min(a + stretch + length - 1, len(text))
                yield [(lo, begin)], np.frombuffer(text, np.uint8)[begin:end], np.array([0, end - begin]), (a, a + stretch)
        else:
            yield [(k, 0) for k in range(lo, hi)], np.frombuffer(b"".join(items[lo:hi]), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in items[lo:hi]])]), None


def anchors_in(items: list[bytes], length: int, stretch: int | None = None) -> pd.DataFrame:
    """Anchors of all texts: text number, place, bucket, around, nearest, farthest."""
    found = []
    for parts, data, limits, own in stretches(items, length, stretch or STRETCH):
        place, bucket, around, nearest, farthest = anchors_of(data, limits, length)
        part = np.searchsorted(limits, place, "right") - 1
        text, offset = (np.array([p[k] for p in parts], dtype=np.int64)[part] for k in (0, 1))
        rows = pd.DataFrame({"text": text, "place": place - limits[part] + offset, "bucket": bucket.view(np.int64), "around": around.view(np.int64),
                             "nearest": nearest, "farthest": farthest})
        found.append(rows if own is None else rows[(rows["place"] >= own[0]) & (rows["place"] < own[1])])
    if not found:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("text", "place", "bucket", "around", "nearest", "farthest")})
    return pd.concat(found, ignore_index=True)


def keyed(docs: DataFrame) -> DataFrame:
    """``(id, h, doc_id, text)``: rows are told apart by doc_id and text; rows equal in both are alike in every result."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc, F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("h"), doc.alias("doc_id"), text.alias("text"))


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """Every anchor of every text (see ``anchors_in``) with the row it lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = anchors_in([t.encode() for t in batch.column(2).to_pylist()], length)
            at = pa.array(rows["text"].to_numpy(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(rows["bucket"]), pa.array(rows["around"]), pa.array(rows["place"].to_numpy(np.int64)),
                 pa.array(rows["nearest"].to_numpy(np.int32)), pa.array(rows["farthest"].to_numpy(np.int32))],
                ["id", "h", "bucket", "around", "place", "nearest", "farthest"],
            )

    return docs.select("id", "h", "text").mapInArrow(run, "id long, h long, bucket long, around long, place long, nearest int, farthest int")


def first_blocks(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The blocks of 32 starts of each anchor in ``asked``: what their strings share, and up to 31 bytes on either side."""
    share, side = length - BLOCK + 1, BLOCK - 1
    wide = widest_within(share)
    half = max(GRAM, wide // 2)

    def named(data: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent names of the shared stretch that starts at each ``x``."""
        names, size = pointers(data, wide), np.full(len(x), share, dtype=np.int64)
        return tuple(name_of(names[w], w, x, size, max(2, -(-share // w)) if w < share else 1) for w in (wide, half))

    def blocks_of(items: list[bytes], counts: np.ndarray, place, near, far) -> tuple[np.ndarray, ...]:
        """Blocks of the anchors of several texts: number of the anchor, distance, both names, bytes before and behind."""
        text = b"".join(items)
        begin = np.concatenate([[0], np.cumsum([len(t) for t in items])])
        doc = np.repeat(np.arange(len(items)), counts)
        number = far // BLOCK - near // BLOCK + 1
        which = np.repeat(np.arange(len(place)), number)
        low = BLOCK * (near[which] // BLOCK + np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number))
        first, last = begin[doc[which]], begin[doc[which] + 1]
        x = first + place[which] - low
        one, two = np.empty(len(x), U64), np.empty(len(x), U64)
        data = np.frombuffer(text, np.uint8)
        for a in range(0, len(text), STRETCH):  # more than one only for a long text
            here = np.flatnonzero((x >= a) & (x < a + STRETCH))
            if len(here):
                one[here], two[here] = named(data[a:a + STRETCH + share], x[here] - a)
        # Equal strings lie equally far from their anchors; without the distance, one place could meet itself under two anchors.
        one, two = joined_name(one, low.astype(U64)), joined_name(two, ~low.astype(U64))
        before = [text[max(f, i - side):i] for f, i in zip(first.tolist(), x.tolist())]
        behind = [text[i + share:min(e, i + share + side)] for e, i in zip(last.tolist(), x.tolist())]
        return which, low, one, two, before, behind

    schema = "id long, h long, need boolean, place long, low int, nearest int, farthest int, one long, two long, before binary, behind binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            items, wanted = [t.encode() for t in batch.column(2).to_pylist()], batch.column(3)
            limits = np.concatenate([[0], np.cumsum(wanted.value_lengths().to_numpy())])
            fields = wanted.flatten()
            place, near, far, need = (fields.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("place", "nearest", "farthest", "need"))
            for lo, hi in slices(items, STRETCH):
                a, b = limits[lo], limits[hi]
                counts = np.diff(limits[lo:hi + 1])
                which, low, one, two, before, behind = blocks_of(items[lo:hi], counts, place[a:b], near[a:b], far[a:b])
                row = pa.array(lo + np.repeat(np.arange(hi - lo), counts)[which])
                which = which + a
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(need[which] == 1), pa.array(place[which]), pa.array(low.astype(np.int32)), pa.array(near[which].astype(np.int32)),
                     pa.array(far[which].astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(before, pa.binary()), pa.array(behind, pa.binary())],
                    names,
                )

    # A document's anchors are bounded by its length. Rows equal in id and text are one here.
    listed = asked.groupBy(*KEY).agg(F.collect_list(F.struct("place", "nearest", "farthest", F.col("need").cast("int").alias("need"))).alias("wanted"))
    return docs.select(*KEY, "text").join(listed, KEY).dropDuplicates(KEY).select(*KEY, "text", "wanted").mapInArrow(run, schema)


def refined(blocks: DataFrame) -> DataFrame:
    """``(id, h, from, to)``: ranges of repeated string starts among the blocks of anchors that are still in need of an answer."""
    answers, size, names = [], BLOCK, ["one", "two"]
    alike = [*names, "before", "behind"]
    while True:
        numbers = ["id", "h", "place", "low", "nearest", "farthest"]
        sets = blocks.groupBy(*alike).agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in numbers], F.max("need").alias("need"))
        sets = materialize(sets, "suffix_sets")
        several = sets.filter("n > 1 AND need").select(*alike)
        first, last = F.greatest("low", "nearest"), F.least(F.col("low") + (size - 1), F.col("farthest"))
        hit = blocks.filter("need").join(several, alike, "left_semi").filter(first <= last)
        answers.append(materialize(hit.select(*KEY, (F.col("place") - last).alias("from"), (F.col("place") - first).alias("to")), "suffix_answers"))
        if size == 1:
            return reduce(DataFrame.union, answers)
        open_sets = sets.withColumn("need", F.col("need") & (F.col("n") == 1)).drop("n")
        crowded = materialize(open_sets.groupBy(*names).agg(F.count("*").alias("c"), F.max("need").alias("any")).filter("c > 1 AND any").select(*names), "crowded_blocks")
        rest, half = open_sets.join(crowded, names), size // 2
        nearer = F.struct(F.col("low").alias("low"), F.substring("behind", 1, half).alias("more"), F.lit(0).alias("side"),
                          F.expr(f"substring(before, greatest(length(before) - {half - 1}, 0) + 1)").alias("before"), F.expr(f"substring(behind, {half + 1})").alias("behind"))
        farther = F.struct((F.col("low") + half).alias("low"), F.expr(f"substring(before, greatest(length(before) - {half}, 0) + 1)").alias("more"), F.lit(1).alias("side"),
                           F.expr(f"substring(before, 1, greatest(length(before) - {half}, 0))").alias("before"), F.expr(f"substring(behind, 1, {half - 1})").alias("behind"))
        halves = rest.select(*KEY, "place", "nearest", "farthest", "need", *names, F.explode(F.array(nearer, farther)).alias("part"))
        added = [F.xxhash64(F.lit(k), "one", "two", "part.side", "part.more").alias(name) for k, name in enumerate(names)]
        blocks = halves.filter(F.length("part.more") == half).select(*KEY, "place", "part.low", "nearest", "farthest", "need", *added, "part.before", "part.behind")
        blocks, size = materialize(blocks, "suffix_blocks"), half


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(id, h, from, to)``: ranges of starts of strings that also start elsewhere, for rows of ``keyed`` documents."""
    if length < GRAM + BLOCK or 2 * length + STRETCH > 1 << PLACE_BITS:
        raise ValueError(f"strings of {GRAM + BLOCK} bytes or more, and far fewer than {1 << PLACE_BITS}")
    found = materialize(anchors(docs, length), "anchors")
    # Written first: a join against a plain table can be split where one bucket is hot, one against an aggregate of the same key cannot.
    crowded = materialize(found.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "crowded_buckets")
    shared = materialize(found.join(crowded, "bucket"), "shared_anchors")
    alike = ["bucket", "around"]
    numbers = ["id", "h", "place", "nearest", "farthest"]
    sets = materialize(shared.groupBy(*alike).agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in numbers]), "anchor_sets")
    several = sets.filter("n > 1").select(*alike)
    whole = shared.join(several, alike, "left_semi").select(*KEY, (F.col("place") - F.col("farthest")).alias("from"), (F.col("place") - F.col("nearest")).alias("to"))
    # Buckets with several sets, one of them a single anchor: all single ones ask, larger sets answer through one member.
    mixed = materialize(sets.groupBy("bucket").agg(F.count("*").alias("sets"), F.min("n").alias("least")).filter("sets > 1 AND least = 1").select("bucket"), "mixed_buckets")
    one_each = sets.filter("n = 1").select("bucket", "around", *numbers, F.lit(True).alias("need"))
    # The smallest values of a larger set may come from different anchors, so its member is looked up.
    member = shared.join(sets.filter("n > 1").select(*alike, F.col("id").alias("least_id")), alike).filter("id = least_id")
    member = member.groupBy(*alike).agg(F.min(F.struct(*numbers)).alias("m")).select(*alike, "m.*", F.lit(False).alias("need"))
    asked = one_each.unionByName(member).join(mixed, "bucket", "left_semi").select(*numbers, "need").distinct()
    return whole.union(refined(materialize(first_blocks(docs, asked, length), "suffix_blocks")))


def merged(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by strings that start in the (inclusive) ranges."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def cut(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` for every row: removed byte runs (start, end exclusive) and the bytes that stay.

    A byte goes if a string of ``length`` bytes over it also starts at another place, in the same or in any other row.
    Null and shorter texts keep all. Repeated rows are copies of each other and lose what they share. ``kept`` is
    binary: a cut may fall within a character.
    """
    rows = keyed(docs)
    ranges = repeated_starts(rows, length).groupBy(*KEY).agg(F.collect_list(F.struct("from", "to")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, size = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode()
                gone = merged([(r["from"], r["to"]) for r in found or ()], length)
                edges = [0, *[e for span in gone for e in span], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "end": b} for a, b in gone])
                size.append(len(raw))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = rows.join(ranges, KEY, "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """What every document loses to 200-byte strings that occur elsewhere too."""
    found = cut(documents(spark, folder))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
