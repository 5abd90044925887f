"""The trie of conversation prefixes from sorted, padded matrices of turn ids.

A conversation becomes rows of at most ``BAND`` consecutive turns, so that a long one is many short rows; a row knows the hash of what
comes before it. Turn ids hash position, role and text; the hash of a prefix is the XOR of its turns' ids. Rows are sorted by
(band, prefix before, turn ids, conv_id) over all tasks and cut into shards of ``SHARD_ROWS`` consecutive rows. In a
shard, a padded matrix of turn ids is put in order with ``lexsort``. A row starts a node at a depth where its column, or one before
it, differs from the row above: change masks, OR-accumulated over the columns. ``reduceat`` over those starts
aggregates every depth.

A node that contains the first or last row of its shard may go on in the next one. Such nodes, one path at either end of a
shard, are recombined by the hash of their prefix; so are the tops of later bands with the nodes they hang from.

Sums over subtrees need no walk through the trie. Each node is booked on its smallest member; a member is the smallest one of
its nodes from some depth on. So the nodes below a node are those booked on its members: sums over members, which
shards and copies of a conversation can be split for. Two passes: the first finds the depth from which each
conversation is the smallest member, the second adds up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthgrid.llm.frames import corpus_session, materialize

QUERY = "op11_prefix_trie"
#: DuckDB has no CRC-32, which the contract's rebuilding needs; tests compare with brute force.
ORACLE_SQL = None
#: Turns of a row, rows of a shard, and bands whose running hashes are worked out together.
BAND, SHARD_ROWS, GROUP = 32, 4096, 1024
#: The rebuilt conversations share heads of up to this many turns within families of this many ids.
HEADS, FAMILY = 9, 5
NO_ENDS = hashlib.sha256(b"").hexdigest()
PARTITION_BITS = 33


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv, t1, t2, size, at)``: hashes and UTF-8 bytes of each turn; ``at`` puts a conversation's turns in order (null turns first).

    Null roles and texts count as empty. Turns of one number, repeated ones too, all stay, in the order of their
    hashes. Rows without a conv_id take no part.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    slim = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"),
        F.octet_length(text).cast("long").alias("size"))
    keys = ["conv", "turn", "t1", "t2", "tie"]  # the tie breaker lets even equal rows be dealt to several tasks
    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = slim.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    return ordered.withColumn("at", F.monotonically_increasing_id()).select("conv", "t1", "t2", "size", "at")


def placed(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their position in the conversation (from 1), and ``(conv, own)``: the number of turns of each conversation.

    A conversation may lie in several partitions; a partition's share is counted first.
    """
    parted = ordered.withColumn("pid", F.shiftright("at", PARTITION_BITS))
    shares = materialize(parted.groupBy("conv", "pid").agg(F.min("at").alias("first"), F.count("*").alias("n")), "turn_shares")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = shares.withColumn("shift", before - F.col("first") + 1).select("conv", "pid", "shift")
    rows = parted.join(offsets, ["conv", "pid"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), "t1", "t2", "size")
    return rows, shares.groupBy("conv").agg(F.sum("n").alias("own"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv, pos, t1, t2, size)`` of the rebuilt conversations, and ``(conv, len)`` of all of them, turnless ones too."""
    rows, counts = placed(materialize(turns(conversations), "turns"))
    rows, counts = materialize(rows, "placed_turns"), materialize(counts, "turn_counts")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    frame = counts.select("conv", "own", head.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    frame = frame.join(counts.select(F.col("conv").alias("base"), F.col("own").alias("there")), "base", "left")
    frame = frame.withColumn("head", F.least("h", F.coalesce("there", F.lit(0))))
    frame = materialize(frame.select("conv", "base", "h", "head", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")), "rebuilt")
    tails = rows.join(frame.select("conv", "h", "head"), "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "t1", "t2", "size")
    first = rows.filter((F.col("pos") < HEADS) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "base")
    heads = first.join(frame.select("conv", "base", "h"), "base").filter("pos <= h").select("conv", "pos", "t1", "t2", "size")
    return tails.unionByName(heads), frame.select("conv", "len")


def _running(rows: DataFrame) -> DataFrame:
    """``before_a, before_b, before_size`` of the bands of long conversations, over groups of bands and then over groups."""
    sums = {"a": F.bit_xor, "b": F.bit_xor, "size": F.sum}
    rows = rows.withColumn("part", F.expr(f"band DIV {GROUP}"))
    inside = Window.partitionBy("conv", "part").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    outside = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("conv", "part").agg(*[f(f"sum_{c}").alias(c) for c, f in sums.items()])
    groups = groups.select("conv", "part", *[F.coalesce(f(c).over(outside), F.lit(0)).alias(f"group_{c}") for c, f in sums.items()])
    joined = rows.join(groups, ["conv", "part"])
    inner = {c: F.coalesce(f(f"sum_{c}").over(inside), F.lit(0)) for c, f in sums.items()}
    return joined.withColumns({f"before_{c}": inner[c] + F.col("group_size") if c == "size" else inner[c].bitwiseXOR(F.col(f"group_{c}")) for c in sums}).drop("part", *[f"group_{c}" for c in sums])


def shards(rows: DataFrame, frame: DataFrame, band: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(shard, conv, band, len, total, before_a, before_b, before_size, ids, sizes)``: the sorted rows of at most ``band`` turns.

    ``ids`` holds two numbers (of 63 bits) for each turn. Every conversation has a row of band 0; ``total`` is its bytes.
    """
    a, b = F.xxhash64("pos", "t1", "t2"), F.xxhash64("t2", "pos", "t1")
    named = rows.select("conv", "pos", F.shiftrightunsigned(a, 1).alias("a"), F.shiftrightunsigned(b, 1).alias("b"), "size", F.expr(f"(pos - 1) DIV {band}").alias("band"))
    blocks = named.groupBy("conv", "band").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "size"))).alias("turns"),
                                               F.bit_xor("a").alias("sum_a"), F.bit_xor("b").alias("sum_b"), F.sum("size").alias("sum_size"))
    blocks = materialize(blocks, "turn_bands")
    totals = blocks.groupBy("conv").agg(F.sum("sum_size").alias("total"))
    frame = materialize(frame.join(totals, "conv", "left").select("conv", "len", F.coalesce("total", F.lit(0)).alias("total")), "conversations")
    full = frame.join(blocks, "conv", "left").withColumn("band", F.coalesce("band", F.lit(0)))
    none = [F.lit(0).cast("long").alias(f"before_{c}") for c in ("a", "b", "size")]
    whole = full.filter(F.col("len") <= band).select("*", *none).unionByName(_running(full.filter(F.col("len") > band)))
    whole = whole.withColumn("turns", F.coalesce("turns", F.array())).select(
        "conv", "band", "len", "total", "before_a", "before_b", "before_size",
        F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"]))).alias("ids"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    keys = ["band", "before_a", "before_b", "ids", "conv"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = whole.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    # Consecutive rows of a task, by its running number: many short shards where there are many rows.
    return ordered.withColumn("shard", F.expr(f"monotonically_increasing_id() DIV {shard_rows}"))


@dataclass
class Level:
    """The nodes of one depth of a shard: limits of their rows, whether the row at ``start`` reaches the depth, and what may go on elsewhere."""

    start: np.ndarray
    end: np.ndarray
    there: np.ndarray
    edge: np.ndarray


class Matrix:
    """A shard's rows, sorted and padded; column ``j`` is the turn at local depth ``j + 1``."""

    def __init__(self, table: pa.Table, band: int):
        column = lambda c: table.column(c).to_numpy()
        ids, sizes = table.column("ids").combine_chunks(), table.column("sizes").combine_chunks()
        length = sizes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        n, width = len(length), int(length.max(initial=0))
        row, at = np.repeat(np.arange(n), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        padded = [np.full((n, width), -1, dtype=np.int64) for _ in range(2)]
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        padded[0][row, at], padded[1][row, at] = flat[0::2], flat[1::2]
        bytes_ = np.zeros((n, width), dtype=np.int64)
        bytes_[row, at] = sizes.flatten().to_numpy(zero_copy_only=False)
        conv, bands, before_a, before_b = column("conv"), column("band"), column("before_a"), column("before_b")
        # Padding is smaller than any id, so conversations that end come before those that go on.
        keys = [conv, *[padded[k][:, j] for j in range(width - 1, -1, -1) for k in (1, 0)], before_b, before_a, bands]
        order = np.lexsort(keys)
        self.order, self.rows, self.width, self.shard = order, n, width, int(column("shard")[0])
        self.conv, self.length, self.len, self.bands = conv[order], length[order], column("len")[order], bands[order]
        self.total, a, b, sizes = column("total")[order], padded[0][order], padded[1][order], bytes_[order]
        before = (before_a[order], before_b[order], self.bands)
        changed = np.ones((n, width + 1), dtype=bool)
        changed[1:, 0] = np.logical_or.reduce([x[1:] != x[:-1] for x in before])
        changed[1:, 1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.changed = np.logical_or.accumulate(changed, axis=1)
        self.prefix = [np.bitwise_xor.accumulate(np.concatenate([x[order][:, None], np.where(y < 0, 0, y)], axis=1), axis=1) for x, y in ((before_a, a), (before_b, b))]
        # Bytes of the turns before the one at each local depth; at depth 0, of all turns before the band (none in the first).
        upto = column("before_size")[order][:, None] + np.concatenate([np.zeros((n, 1), dtype=np.int64), np.cumsum(sizes, axis=1)], axis=1)
        self.earlier = np.concatenate([upto[:, :1], upto[:, :-1]], axis=1)
        self.depth = self.bands * band
        self.full = band

    def level(self, j: int) -> Level:
        start = np.flatnonzero(self.changed[:, j])
        end = np.append(start[1:], self.rows)
        return Level(start, end, self.length[start] >= j, (start == 0) | (end == self.rows))

    def smallest(self, level: Level) -> np.ndarray:
        """The row of the smallest member of each node."""
        low = np.minimum.reduceat(self.conv, level.start)
        return np.flatnonzero(self.conv == np.repeat(low, level.end - level.start))


TOP = "shard long, depth long, pa long, pb long, conv long, size long, ends boolean, open boolean, longest long"


def first_pass(band: int):
    """For each conversation the smallest depth at which it is its node's smallest member, as far as a shard can tell; open nodes are listed."""

    def run(table: pa.Table) -> pa.Table:
        m = Matrix(table, band)
        since, size, ends = np.full(m.rows, -1, dtype=np.int64), np.zeros(m.rows, dtype=np.int64), np.zeros(m.rows, dtype=bool)
        parts = []
        for j in range(m.width, -1, -1):  # the smallest depth is written last
            level = m.level(j)
            low = m.smallest(level)
            longest = np.maximum.reduceat(m.len, level.start)
            depth = m.depth[level.start] + j
            opened = level.there & (level.edge | (j == 0) | ((j == m.full) & (longest > depth)))
            at, closed = level.start, level.there & ~opened
            rows = low[closed]
            since[rows], size[rows] = depth[closed], m.earlier[at[closed], j]
            ends[rows] |= longest[closed] == depth[closed]
            k = np.flatnonzero(opened)
            parts.append((depth[k], m.prefix[0][at[k], j], m.prefix[1][at[k], j], m.conv[low[k]], m.earlier[at[k], j], longest[k]))
        depth, pa_, pb, conv, earlier, longest = (np.concatenate(c) for c in zip(*parts))
        rows = np.flatnonzero(since >= 0)
        own, seen = len(rows), len(depth)
        none, absent = pa.nulls(own, pa.int64()), pa.nulls(seen, pa.bool_())
        both = lambda x, y: pa.chunked_array([pa.array(x), pa.array(y)])
        return pa.table({
            "shard": pa.array(np.full(own + seen, m.shard)), "depth": both(since[rows], depth), "pa": pa.chunked_array([none, pa.array(pa_)]),
            "pb": pa.chunked_array([none, pa.array(pb)]), "conv": both(m.conv[rows], conv), "size": both(size[rows], earlier),
            "ends": pa.chunked_array([pa.array(ends[rows]), absent]), "open": both(np.zeros(own, dtype=bool), np.ones(seen, dtype=bool)),
            "longest": pa.chunked_array([none, pa.array(longest)]),
        })

    return run


NODE = ("shard long, open boolean, depth long, pa long, pb long, conv long, n long, children long, leaves long, total long, booked long, low_booked long, "
        "low_total long, size long, parent long, qa long, qb long, ends string, first long, ids string")


def second_pass(band: int):
    """All nodes of a shard with sums over the members there; ids of the members that end at an open node come as rows of their own."""

    def run(table: pa.Table) -> pa.Table:
        m = Matrix(table, band)
        take = lambda c: table.column(c).to_numpy()[m.order]
        since, leaf, booked = take("since"), take("leaf"), take("booked")
        names = [f.split()[0] for f in NODE.split(", ")]
        found, chunks, above = [], [], None
        for j in range(m.width + 1):
            level = m.level(j)
            at, depth, low = level.start, m.depth[level.start] + j, m.smallest(level)
            here = np.repeat(depth, level.end - at)
            add = lambda x: np.add.reduceat(x.astype(np.int64), at)
            ending = add(m.len == here)
            node = level.there & ((j > 0) | (m.bands[at] == 0))
            k = np.flatnonzero(node)
            sums = [add(x)[k] for x in (np.ones(m.rows), (since <= here + 1) & (m.len > here), leaf, m.total, booked)]
            if j:
                upper, upper_low = above
                over = np.searchsorted(upper.start, at[k], "right") - 1
                known = ~upper.edge[over] & (j > 1)
                parent = m.conv[upper_low[over]]
                q = [m.prefix[x][at[k], j - 1] for x in (0, 1)]
            else:
                known, parent, q = np.ones(len(k), dtype=bool), np.zeros(len(k), dtype=np.int64), [np.zeros(len(k), dtype=np.int64)] * 2
            root = np.full(len(k), j == 0)
            ends = []
            for s, e, edge, some in zip(at[k].tolist(), level.end[k].tolist(), level.edge[k].tolist(), ending[k].tolist()):
                # Ascending: members that end here have equal turns, so conv_id has put them in order.
                ids = ",".join(map(str, m.conv[s:e][m.len[s:e] == here[s]].tolist())) if some else ""
                ends.append(hashlib.sha256(ids.encode()).hexdigest() if ids and not edge else NO_ENDS)
                if ids and edge:
                    chunks.append((m.prefix[0][s, j], m.prefix[1][s, j], int(here[s]), int(ids.split(",", 1)[0]), ids))
            masked = lambda x, hide: pa.array(x, mask=hide)
            found.append(pa.table([
                pa.array(np.full(len(k), m.shard)), pa.array(level.edge[k]), pa.array(depth[k]), pa.array(m.prefix[0][at[k], j]), pa.array(m.prefix[1][at[k], j]),
                pa.array(m.conv[low[k]]), *[pa.array(x) for x in sums], pa.array(booked[low[k]]), pa.array(m.total[low[k]]), pa.array(m.earlier[at[k], j]),
                masked(parent, root | ~known), masked(q[0], known), masked(q[1], known), pa.array(ends, pa.string()), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.string()),
            ], names))
            above = level, low
        if chunks:
            c = list(zip(*chunks))
            columns = {"pa": pa.array(c[0], pa.int64()), "pb": pa.array(c[1], pa.int64()), "depth": pa.array(c[2], pa.int64()), "first": pa.array(c[3], pa.int64()), "ids": pa.array(c[4], pa.string())}
            found.append(pa.table([columns[f.name] if f.name in columns else pa.nulls(len(chunks), f.type) for f in found[0].schema], names))
        return pa.concat_tables(found)

    return run


def _ends(chunks: DataFrame) -> DataFrame:
    """``(pa, pb, depth, digest)`` of the ids of the members that end at each node, streamed in order.

    A digest has one order of bytes, so a node's ids pass one task; they are read piece by piece and never gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for batch in batches:
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in ("pa", "pb", "depth", "ids")]):
                if key != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield _digests(done)
                done = []
        if node is not None:
            yield _digests([(*node, state.hexdigest())])

    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = chunks.repartition(tasks, "pa", "pb", "depth").sortWithinPartitions("pa", "pb", "depth", "first")
    return ordered.select("pa", "pb", "depth", "ids").mapInArrow(run, "pa long, pb long, depth long, digest string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in c[:3]], pa.array(c[3], pa.string())], ["pa", "pb", "depth", "digest"])


def trie(conversations: DataFrame, band: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of the rebuilt conversations' trie; the columns are those of ``query``.

    See ``turns`` for nulls, ties and repeated rows. A conversation whose rebuilt form has no turn ends at the root. The size
    of a text is that of its UTF-8 bytes. No rows (or none with a conv_id) give no rows.
    """
    rows, frame = rebuilt(conversations)
    table = materialize(shards(rows, frame, band, shard_rows), "trie_shards")
    tops = materialize(table.groupBy("shard").applyInArrow(first_pass(band), TOP), "trie_tops")
    key = ["pa", "pb", "depth"]
    joint = tops.filter("open").groupBy(*key).agg(F.min("conv").alias("conv"), F.min("size").alias("size"), F.max("longest").alias("longest"))
    joint = materialize(joint, "trie_joint")
    since = tops.filter("NOT open").select("conv", "depth", "size", "ends").union(joint.select("conv", "depth", "size", F.col("longest") == F.col("depth")))
    since = since.groupBy("conv").agg(F.min("depth").alias("since"), F.min("size").alias("size"), F.max("ends").alias("ends"))
    far = F.col("len") + 2  # never the smallest member of any node
    members = table.join(since, "conv", "left").select(
        table["*"], F.coalesce("since", far).alias("since"), F.coalesce(F.col("ends").cast("long"), F.lit(0)).alias("leaf"),
        F.coalesce(F.col("total") - F.col("size"), F.lit(0)).alias("booked"))
    nodes = materialize(members.groupBy("shard").applyInArrow(second_pass(band), NODE), "trie_nodes")

    found = tops.filter("open").select("shard", *key).distinct().join(joint.select(*key, "conv"), key)
    found = found.select("shard", F.col("pa").alias("qa"), F.col("pb").alias("qb"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("top"))
    columns = ["conv", "depth", "parent", "n", "children", "leaves", "total", "booked", "low_booked", "low_total", "size", "ends"]
    alone = nodes.filter("ids IS NULL AND NOT open").join(found, ["shard", "qa", "qb", "depth"], "left").withColumn("parent", F.coalesce("parent", "top")).select(*columns)
    split = nodes.filter("ids IS NULL AND open").groupBy(*key).agg(
        F.min(F.struct("conv", "low_booked", "low_total")).alias("low"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "total", "booked")],
        F.min("size").alias("size"), F.min("parent").alias("parent"), F.min("qa").alias("qa"), F.min("qb").alias("qb"))
    above = joint.select(F.col("pa").alias("qa"), F.col("pb").alias("qb"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("top"))
    split = split.join(above, ["qa", "qb", "depth"], "left").join(_ends(nodes.filter("ids IS NOT NULL")), key, "left")
    split = split.withColumn("parent", F.coalesce("parent", "top")).withColumn("ends", F.coalesce("digest", F.lit(NO_ENDS))).select("low.*", "*").select(*columns)
    # Bytes of each node's last text, once for every member, less once for every node.
    saved = F.expr("total - n * size - (booked - low_booked + low_total - size)")
    return alone.unionByName(split).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return trie(corpus_session(spark).read.parquet(f"{folder}/conversations.parquet"))
