"""Packing by concatenation: prefix sums over partition totals give global offsets, fixed windows cut the stream.

First pass: every partition tokenizes its rows and writes their ids with a running position inside the partition. The
totals per partition (one number each) are then summed in partition order. Second pass: a document's first global position is
its partition's offset plus its own position; windows of ``length`` ids cut it into pieces, and a document that
crosses a window's end leaves one boundary record on either side. Nothing is shuffled but the partition totals, and
no document is looked at by more than one task.
"""

from __future__ import annotations

import base64
import functools
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthgrid.llm.frames import documents, materialize

QUERY = "op9_packing"
ORACLE_SQL = None
LENGTH, END = 2048, 1
#: Known pieces of text per Python worker; the store is emptied when it is full.
KNOWN_UNITS = 400_000
#: Split points that no pre-token of the byte-level pattern crosses, for texts with plain white space only.
UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Where Python's and the tokenizer's idea of white space could differ, or a special token could hide.
UNUSUAL = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\|endoftext\|>")

#: Bytes without which a text has nothing unusual: a quick look before the pattern.
SUSPECT = bytes([0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, ord("<")])


def tokenizer_files() -> dict[str, str]:
    """Where the vocabulary lies on this machine and the pattern that belongs to it."""
    import public_tokenizers

    return {"ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


class Ids:
    """Token ids of texts as little-endian 16-bit numbers, with a bounded store of the units seen before."""

    def __init__(self, ranks: str, pattern: str):
        assert sys.byteorder == "little" and array("H").itemsize == 2
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=merges, special_tokens={"<|endoftext|>": len(merges)})
        self.known: dict[str, bytes] = {}

    def direct(self, text: str) -> bytes:
        return np.array(self.encoding.encode(text, allowed_special="all"), dtype="<u2").tobytes()

    def of(self, text: str) -> bytes:
        raw = text.encode()
        if len(raw.translate(None, SUSPECT)) < len(raw) and UNUSUAL.search(text):
            return self.direct(text)
        units, known = UNIT.findall(text), self.known
        parts = list(map(known.get, units))
        if None in parts:
            if len(known) > KNOWN_UNITS:
                known.clear()
            for k, part in enumerate(parts):
                if part is None:
                    unit = units[k]
                    part = known.get(unit)
                    if part is None:
                        part = known[unit] = array("H", self.encoding.encode_ordinary(unit)).tobytes()
                    parts[k] = part
        return b"".join(parts)


@functools.lru_cache(maxsize=2)
def ids_of(ranks: str, pattern: str) -> Ids:
    """One store for each worker process."""
    return Ids(ranks, pattern)


def tokenized(docs: DataFrame, files: dict[str, str] | None = None, end: int = END) -> DataFrame:
    """``(part, start_in_part, doc_id, n, ids)``: the ids of each row with ``end`` behind, and where they lie in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        store = ids_of(**(files or tokenizer_files()))
        closing = np.array([end], dtype="<u2").tobytes()
        for batch in batches:
            packed = [store.of(text or "") + closing for text in batch.column(1).to_pylist()]
            counts = np.array([len(p) // 2 for p in packed], dtype=np.int64)
            starts = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(packed), part, np.int64)), pa.array(starts), batch.column(0), pa.array(counts), pa.array(packed, pa.binary())],
                ["part", "start_in_part", "doc_id", "n", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "part long, start_in_part long, doc_id long, n long, ids binary")


def pack(docs: DataFrame, length: int = LENGTH, files: dict[str, str] | None = None, end: int = END) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    Every sequence but the last is full, so at most ``length - 1`` places are padding. Null and empty texts are
    the single id ``end``. Rows with equal or null doc_ids are packed one by one. No rows give no pieces. ``ids`` holds
    the piece's ids as little-endian 16-bit numbers.
    """
    stored = materialize(tokenized(docs, files, end), "token_ids")
    totals = stored.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the scan
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = stored.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, at, n = (batch.column(k) for k in range(3))
            at, n = at.to_numpy(), n.to_numpy()
            pieces = (at + n - 1) // length - at // length + 1
            owner = np.repeat(np.arange(len(n)), pieces)
            sequence = at[owner] // length + np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo = np.maximum(sequence * length, at[owner])
            hi = np.minimum((sequence + 1) * length, at[owner] + n[owner])
            start = lo - at[owner]
            raw = [memoryview(x) for x in batch.column(3).to_pylist()]
            ids = [bytes(raw[d][2 * a:2 * (a + k)]) for d, a, k in zip(owner.tolist(), start.tolist(), (hi - lo).tolist())]
            crc = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [doc.take(pa.array(owner)), pa.array(start), pa.array(hi - lo), pa.array(crc, pa.int64()), pa.array(n[owner]), pa.array(sequence),
                 pa.array(lo - sequence * length), pa.array(ids, pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document in sequences of 2048 tokens."""
    return pack(documents(spark, folder)).drop("ids")
