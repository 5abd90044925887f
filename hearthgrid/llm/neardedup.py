"""SimHash near-dedup: fingerprints within a few bits are linked, candidates are pruned by pigeonring chains.

A fingerprint of 64 bits is cut into ``segments`` equal parts on a ring. If two fingerprints differ in at most ``radius`` bits,
then from some part on, every chain of ``l`` consecutive parts differs in at most ``l * radius / segments`` bits: its share.
The shares of the first few are below one, so these parts are equal. They are the key under which fingerprints meet, once for each
part that a chain can start from. Of two that meet, the differences are summed along the ring, and the pair goes as soon as
a running sum passes its share; the sum over the whole ring is the Hamming check. Equal fingerprints are one.

A key of more than ``CROWDED`` different fingerprints pairs nobody: its members meet at points instead. Two fingerprints differ in at
most ``2k`` bits exactly if flipping at most ``k`` bits of each leads to one common value. Members of such a meeting
point are all within the radius, so tying each to the smallest member keeps every connection with one link per member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthgrid.llm.batches import U64, bit_votes, distinct_hashes, packed, slices, spread, texts, words_of, xxh64
from hearthgrid.llm.components import components
from hearthgrid.llm.frames import documents, materialize

QUERY = "op8_neardedup"
ORACLE_SQL = None
BITS, SEED = 64, 42
#: Hashes under which documents are compared when similar texts are looked for.
VIEWS = 10
#: Different fingerprints of a key that are paired at most; larger keys are solved by meeting points.
CROWDED = 64
#: Segments of the views' fingerprints: shorter and so fewer keys, as these only leave out texts that are alone.
VIEW_SEGMENTS = 8
#: Words of 64 bits in the bitmap of a text's shingles.
MARKS = 16


def signed(value: int) -> int:
    """A 64-bit pattern as the long that Spark holds it in."""
    return value - (1 << 64) if value >> 63 else value


def simhash64(items: list[bytes], shingle: int) -> np.ndarray:
    """One fingerprint per text: a bit is set if it is set in more than half of the shingle hashes; no word gives zero."""
    words = words_of(items)
    start, length, first = words.shingles(shingle)
    votes = bit_votes(xxh64(words.data, start, length, SEED), first)
    return packed(2 * votes > np.diff(first)[:, None])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs``; a null text counts as empty, other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = texts(batch.column(1))
            for lo, hi in slices(items):
                fp = simhash64(items[lo:hi], shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def ring(radius: int, segments: int | None = None) -> tuple[int, int]:
    """Number of segments, and how many of them a chain begins with that have to be equal."""
    segments = segments or (8 if radius == 1 else 16)
    return segments, (segments - 1) // radius


def flips(most: int) -> list[int]:
    return [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(BITS), n)]


def _longs(values: list[int]):
    return F.array(*[F.lit(signed(v)).cast("long") for v in values])


def _turned(value: Column, bits: Column) -> Column:
    """``value`` rotated, so that the segment at ``bits`` comes lowest."""
    return F.call_function("shiftrightunsigned", value, bits).bitwiseOR(F.call_function("shiftleft", value, BITS - bits))


def _chain(value: Column, bits: Column, length: int, segments: int) -> Column:
    """The bits of the chain of ``length`` segments that starts at ``bits``."""
    return _turned(value, bits).bitwiseAND(F.lit(signed((1 << (BITS // segments * length)) - 1)).cast("long"))


def ring_keys(rows: DataFrame, radius: int, *names: str, segments: int | None = None) -> DataFrame:
    """``names``, ``fp``, ``at`` and ``key``: one row for each segment that a chain can start from, keyed by its equal segments."""
    segments, equal = ring(radius, segments)
    starts = F.explode(F.sequence(F.lit(0), F.lit(BITS - 1), F.lit(BITS // segments))).alias("at")
    return rows.select(*names, "fp", starts).withColumn("key", _chain(F.col("fp"), F.col("at"), equal, segments))


def within_shares(difference: Column, at: Column, radius: int, length: int | None = None) -> Column:
    """Whether each chain of up to ``length`` segments (all) from ``at`` on stays within its share of the radius."""
    segments, equal = ring(radius)
    passed = F.lit(True)
    for n in range(equal + 1, (length or segments) + 1):
        passed = passed & (F.bit_count(_chain(difference, at, n, segments)) <= n * radius // segments)
    return passed


def _meeting(rows: DataFrame, *names: str) -> DataFrame:
    """``(fp, low)`` for the fingerprints that meet another one under the key ``names``; ``low`` is the smallest there."""
    shared = rows.groupBy(*names).agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high").drop("high")
    return rows.join(shared, list(names)).select("fp", "low")


def meeting_links(distinct: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: enough links to connect all distinct fingerprints that differ in at most ``radius`` (1 or even) bits."""
    if radius == 1:
        probes = F.posexplode(_longs([((1 << BITS) - 1) ^ (1 << b) for b in range(BITS)])).alias("bit", "mask")
        met = _meeting(distinct.select("fp", probes).select("fp", "bit", F.col("fp").bitwiseAND(F.col("mask")).alias("kept")), "bit", "kept")
    elif radius % 2 == 0:
        probes = F.explode(_longs(flips(radius // 2))).alias("flip")
        met = _meeting(distinct.select("fp", probes).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")), "point")
    else:
        raise ValueError("the radius is 1 or even")
    return met.filter((F.col("fp") != F.col("low")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= radius)).select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def links(distinct: DataFrame, radius: int, crowded: int = CROWDED) -> DataFrame:
    """``(a, b)``: links that connect all distinct fingerprints that differ in at most ``radius`` (1 or even) bits.

    Pairs of a key of at most ``crowded`` fingerprints are tested along the ring; larger keys go by meeting points.
    """
    keyed = materialize(ring_keys(distinct.select("fp"), radius), "ring_keys")
    sizes = materialize(keyed.groupBy("at", "key").agg(F.count("*").alias("n")).filter("n > 1"), "ring_sizes")
    few = keyed.join(sizes.filter(F.col("n") <= crowded).select("at", "key"), ["at", "key"])
    others = few.withColumnRenamed("fp", "other")
    near = within_shares(F.col("fp").bitwiseXOR(F.col("other")), F.col("at"), radius)
    pairs = few.join(others, ["at", "key"]).filter((F.col("fp") > F.col("other")) & near).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    many = keyed.join(sizes.filter(F.col("n") > crowded).select("at", "key"), ["at", "key"], "left_semi").select("fp").distinct()
    return pairs.distinct().union(meeting_links(many, radius))


def near_groups(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row: the smallest doc_id that links of at most ``radius`` bits reach.

    Texts without words have fingerprint zero and link like any other. Rows without a doc_id stay ungrouped
    (component_id null). Repeated rows are members of their group like other copies. No rows give no rows.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("lowest")), "distinct_fingerprints")
    if radius:
        root = components(links(distinct, radius)).select(F.col("node").alias("fp"), "root")
        rooted = distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        lowest = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
        found = rooted.join(lowest, "root").select("fp", "component_id")
    else:
        found = distinct.select("fp", F.col("lowest").alias("component_id"))
    named = prints.filter("doc_id IS NOT NULL").join(found, "fp").select("doc_id", "fp", "component_id")
    return named.union(prints.filter("doc_id IS NULL").select("doc_id", "fp", F.lit(None).cast("long")))


def word_views(docs: DataFrame, views: int, shingle: int) -> DataFrame:
    """What near-copy search reads of each row: ``(doc_id, x, t1, t2, n, marks, f0, f1, ...)``.

    ``x`` is a hash of the text as it is, ``t1, t2`` one of 128 bits of its words in order, ``n`` and ``marks`` the number
    and a bitmap of its different word shingles, ``f0, ...`` fingerprints of its set of words under several hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "x", "t1", "t2", "n", "marks", *[f"f{k}" for k in range(views)]]
        for batch in batches:
            items = texts(batch.column(2))
            for lo, hi in slices(items):
                words = words_of(items[lo:hi])
                whole_start, whole_size, whole_first = words.shingles(1 << 40)
                ids = np.zeros((hi - lo, 2), dtype=np.int64)
                for t, a, n in zip(np.flatnonzero(np.diff(whole_first)).tolist(), whole_start.tolist(), whole_size.tolist()):
                    ids[t] = np.frombuffer(xxhash.xxh3_128_digest(words.data[a:a + n]), np.int64)
                start, length, first = words.shingles(shingle)
                hashes, limits = distinct_hashes(xxh64(words.data, start, length, SEED), first)
                different = np.diff(limits)
                marks = np.zeros((hi - lo, 64 * MARKS), dtype=bool)
                marks[np.repeat(np.arange(hi - lo), different), (hashes % U64(64 * MARKS)).astype(np.int64)] = True
                marks = np.packbits(marks, axis=1, bitorder="little").view("<i8")
                start, length, first = words.shingles(1)
                hashes, limits = distinct_hashes(xxh64(words.data, start, length, SEED), first)
                columns = []
                for _ in range(views):
                    columns.append(pa.array(packed(2 * bit_votes(hashes, limits) > np.diff(limits)[:, None]).view(np.int64)))
                    hashes = spread(hashes)
                offsets = pa.array(np.arange(0, MARKS * (hi - lo) + 1, MARKS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(different.astype(np.int64)),
                                                  pa.ListArray.from_arrays(offsets, pa.array(marks.ravel().astype(np.int64))), *columns], names)

    schema = ", ".join(["doc_id long, x long, t1 long, t2 long, n long, marks array<long>", *[f"f{k} long" for k in range(views)]])
    return docs.select(F.col("doc_id").cast("long"), text_hash(), "text").mapInArrow(run, schema)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("x")


def may_be_similar(n: str, marks: str, other_n: str, other_marks: str, similarity: float) -> Column:
    """False only for sets that are less similar: each bit in which their bitmaps differ is a member of one set alone."""
    bits = sum((F.bit_count(F.get(marks, F.lit(k)).bitwiseXOR(F.get(other_marks, F.lit(k)))) for k in range(MARKS)), F.lit(0))
    return bits * F.lit(1 + similarity) <= (F.col(n) + F.col(other_n)) * F.lit(1 - similarity) + F.lit(1e-6)


def verified(pairs: DataFrame, held: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those ``pairs(a, b)`` of nodes whose texts' sets of word shingles have at least this Jaccard similarity; ``held`` has ``(node, text)``."""

    def shingles_of(words, k: int) -> set[bytes]:
        lo, hi = int(words.first[k]), int(words.first[k + 1])
        width = min(shingle, hi - lo)
        return {bytes(words.data[a:b]) for a, b in zip(words.start[lo:hi - width + 1].tolist(), words.end[lo + width - 1:hi].tolist())} if hi > lo else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for left, right in zip(texts(batch.column(2)), texts(batch.column(3))):
                words = words_of([left, right])
                x, y = shingles_of(words, 0), shingles_of(words, 1)
                both = len(x & y)
                stay.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(stay, pa.bool_()))

    left, right = (held.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def view_groups(different: DataFrame, radius: int, crowded: int = CROWDED) -> DataFrame:
    """``(view, fp, group)`` for the ``different(view, fp)`` that are tied by steps of at most ``radius`` bits to others of their view.

    Fingerprints that share a ring key of at most ``crowded`` are paired, those of larger keys are tied by meeting points.
    Groups only say where to look for pairs.
    """
    keyed = ring_keys(different, radius, "view", segments=VIEW_SEGMENTS).select("view", "fp", F.xxhash64("view", "at", "key").alias("key"))
    # Dealt by key once: what counts the keys and what is joined to the counts read the same shuffle.
    dealt, member = keyed.repartition("key"), F.struct("view", "fp")
    shared = dealt.groupBy("key").agg(F.min(member).alias("low"), F.max(member).alias("high"), F.count("*").alias("n")).filter("low <> high").select("key", "n")
    chained = materialize(dealt.join(shared, "key"), "chained")
    few = chained.filter(F.col("n") <= crowded).select("key", "view", "fp")
    others = few.select("key", F.col("view").alias("other_view"), F.col("fp").alias("other"))
    near = (F.col("view") == F.col("other_view")) & (F.col("fp") > F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)
    pairs = few.join(others, "key").filter(near).select("view", "fp", "other")
    many = chained.filter(F.col("n") > crowded).select("view", "fp").distinct()
    flipped = F.explode(_longs(flips(radius // 2))).alias("flip")
    reached = many.select("view", "fp", flipped).select("view", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    points = reached.groupBy("view", "at").agg(F.min("fp").alias("other"), F.max("fp").alias("high")).filter("other <> high").select("view", "at", "other")
    met = reached.join(points, ["view", "at"]).filter("fp <> other").select("view", "fp", "other")
    named = [F.xxhash64("view", c).alias(x) for c, x in (("fp", "a"), ("other", "b"))]
    links = materialize(pairs.union(met).distinct().select("view", "fp", "other", *named), "view_links")
    # Each fingerprint is tied to one it is near first; what is left to tie are the few groups that other links join.
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    own = materialize(components(both.groupBy("a").agg(F.min("b").alias("b"))), "own_groups")
    left, right = (own.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    rooted = links.select("a", "b").join(left, "a").join(right, "b").filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
    tied = components(rooted).select(F.col("node").alias("root"), F.col("root").alias("top"))
    group = own.join(tied, "root", "left").select(F.col("node").alias("g"), F.coalesce("top", "root").alias("group"))
    ends = links.select("view", "fp").union(links.select("view", "other")).distinct()  # every end has a link of its own, so a root
    return ends.withColumn("g", F.xxhash64("view", "fp")).join(group, "g").select("view", "fp", "group")


def linked(grouped: DataFrame, nodes: DataFrame, held: DataFrame, views: int, radius: int, shingle: int, similarity: float) -> DataFrame:
    """``(node, root)``: the components that all links of similar texts within ``radius`` bits in some view make.

    First each node is tested with one node of its group in each view, another one in every view; that ties most of a large group.
    Then every pair that is within the radius and not yet in one component is looked at, in the first view that
    has it within the radius only. Bitmaps of the shingles are compared while pairs are joined, so that few are made, and those
    are tested on the texts. No pair within the radius is left out.
    """
    names = [f"f{k}" for k in range(views)]
    marked = nodes.select("node", "n", "marks", F.array(*names).alias("prints"))
    other = marked.select(*[F.col(c).alias(f"other_{c}") for c in marked.columns])
    likely = may_be_similar("n", "marks", "other_n", "other_marks", similarity)
    # By the text, not by the number of the node, so that another run chooses the same.
    known = grouped.join(nodes.select("node", "t1"), "node")
    leads = known.groupBy("view", "group").agg(F.min_by("node", F.xxhash64("view", "t1")).alias("other_node"))
    first = grouped.join(leads, ["view", "group"]).filter("node <> other_node").select("node", "other_node").distinct()
    first = first.join(marked, "node").join(other, "other_node").filter(likely).select(F.greatest("node", "other_node").alias("a"), F.least("node", "other_node").alias("b"))
    found = materialize(components(verified(materialize(first.distinct(), "pairs"), held, shingle, similarity)), "roots")

    rooted = grouped.join(found, "node", "left").select("view", "group", "fp", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("view", "group").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("view", "group")
    here = materialize(rooted.join(mixed, ["view", "group"], "left_semi").join(marked, "node"), "members")
    there = here.select("view", "group", *[F.col(c).alias(f"other_{c}") for c in here.columns if c not in ("view", "group")])
    apart = lambda k: F.bit_count(F.get("prints", F.lit(k)).bitwiseXOR(F.get("other_prints", F.lit(k)))) > radius
    earlier = F.lit(True)
    for k in range(views):
        earlier = earlier & ((F.col("view") <= k) | apart(k))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))) <= radius
    met = here.join(there, ["view", "group"]).filter((F.col("node") > F.col("other_node")) & (F.col("root") != F.col("other_root")) & near & earlier & likely)
    fresh = materialize(met.select(F.col("node").alias("a"), F.col("other_node").alias("b")), "pairs")
    similar = verified(fresh, held, shingle, similarity)
    known = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return materialize(components(known.union(similar)), "roots")


def similar_groups(docs: DataFrame, views: int = VIEWS, radius: int = 2, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, x, component_id, stays, copies)`` for every doc_id and text hash ``x``: the smallest doc_id that links of similar texts reach,
    whether this is the row of the group that stays, and how many rows have both.

    Texts of equal words in equal order are copies. Of the others, fingerprints of the set of words are taken under
    ``views`` hashes (pigeonring keys leave out texts that are alone). Any two within ``radius`` bits in a view are linked if their sets of ``shingle``-word shingles reach the Jaccard similarity. Texts that
    similar are within two bits in at least one view with high but not full probability (README has measured figures).
    Rows without a doc_id are left out. A doc_id with several texts belongs to the group of each of them.
    """
    prints = materialize(word_views(docs.filter("doc_id IS NOT NULL"), views, shingle), "word_views")
    names = [f"f{k}" for k in range(views)]
    nodes = prints.groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "x")).alias("low"), F.min("n").alias("n"), F.min(F.struct("marks")).alias("m"), *[F.min(c).alias(c) for c in names])
    nodes = materialize(nodes.select("t1", "t2", "low", "n", "m.marks", *names, F.monotonically_increasing_id().alias("node")), "texts")
    rows = nodes.select("node", F.posexplode(F.array(*names)).alias("view", "fp"))
    different = materialize(rows.groupBy("view", "fp").agg(F.count("*").alias("several")), "view_fingerprints")
    group = view_groups(different.select("view", "fp"), radius)
    tied = different.join(group, ["view", "fp"], "left").filter("group IS NOT NULL OR several > 1").select("view", "fp", F.coalesce("group", F.xxhash64("view", "fp")).alias("group"))
    grouped = materialize(rows.join(tied, ["view", "fp"]).select("view", "group", "fp", "node"), "view_groups")
    wanted = nodes.join(grouped.select("node").distinct(), "node", "left_semi").select("node", "low.doc_id", "low.x")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(), "text").join(wanted, ["doc_id", "x"]).select("node", "text")
    held = materialize(held.groupBy("node").agg(F.max("text").alias("text")), "texts_held")  # repeated rows have equal texts
    found = linked(grouped, nodes, held, views, radius, shingle, similarity)
    rooted = nodes.join(found, "node", "left").select("t1", "t2", "low", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("first"))
    rooted = rooted.join(lowest, "root").select("t1", "t2", "first")
    copies = prints.groupBy("t1", "t2", "doc_id", "x").agg(F.count("*").alias("copies"))
    return copies.join(rooted, ["t1", "t2"]).select(
        "doc_id", "x", F.col("first.doc_id").alias("component_id"), (F.struct("doc_id", "x") == F.col("first")).alias("stays"), "copies")


def drop_near_copies(docs: DataFrame, views: int = VIEWS, radius: int = 2, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of similar texts the one with the smallest doc_id (and text hash), once.

    Null, empty and blank texts are copies of each other. Rows without a doc_id all stay. Of rows that repeat both doc_id and
    text one stays, whichever it is if other columns differ. Different texts under one doc_id are rows of
    their own. No rows give no rows; other columns are kept as they are.
    """
    judged = similar_groups(docs, views, radius, shingle, similarity).select(F.col("doc_id").alias("__id"), F.col("x").alias("__x"), "stays", "copies")
    judged = judged.select("__id", "__x", F.struct("stays", "copies").alias("__judged"))
    keyed = docs.filter("doc_id IS NOT NULL").withColumns({"__id": F.col("doc_id").cast("long"), "__x": text_hash()})
    stay = keyed.join(judged, ["__id", "__x"]).filter("__judged.stays")
    once, again = stay.filter("__judged.copies = 1"), stay.filter("__judged.copies > 1").dropDuplicates(["__id", "__x"])
    return once.union(again).select(*docs.columns).union(docs.filter("doc_id IS NULL"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document (words of three, links of at most two bits)."""
    found = near_groups(documents(spark, folder))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
