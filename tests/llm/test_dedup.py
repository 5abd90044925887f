"""Near copies, fingerprints and repeated strings against brute force."""

import random
from collections import Counter

import numpy as np
import xxhash
import pytest
from pyspark.sql import functions as F

from hearthgrid.llm import batches, fingerprints, neardedup, suffix_dedup
from hearthgrid.llm.components import components


def simhash(text, width=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def groups(items, linked):
    """Smallest member that each index reaches."""
    root = list(range(len(items)))
    changed = True
    while changed:
        changed = False
        for i in range(len(items)):
            for j in range(len(items)):
                if root[j] < root[i] and linked(items[i], items[j]):
                    root[i], changed = root[j], True
    return root


@pytest.mark.parametrize("radius", [0, 1, 2, 4])
def test_near_groups_equal_brute_force(awkward, radius):
    rows = [(r["doc_id"], simhash(r["text"])) for r in awkward.collect()]
    known = sorted({r for r in rows if r[0] is not None})
    root = groups(known, lambda a, b: a[0] == b[0] and a[1] == b[1] or bin(a[1] ^ b[1]).count("1") <= radius)
    want = Counter([(d, f, known[root[known.index((d, f))]][0] if d is not None else None) for d, f in rows])
    got = Counter([(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in neardedup.near_groups(awkward, radius).collect()])
    assert got == want


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_chains_lose_no_pair_and_prune_more_with_each_segment(spark, radius):
    """Pairs that differ in up to twice the radius: all within it pass from some start, and longer chains leave fewer of the others."""
    rng = np.random.default_rng(3)
    flipped = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 2 * radius + 3), replace=False)) for _ in range(1500)]
    rows = spark.createDataFrame([(k, neardedup.signed(x)) for k, x in enumerate(flipped)], "k long, fp long")
    segments, equal = neardedup.ring(radius)
    assert segments > 2 * radius and equal * radius < segments <= (equal + 1) * radius
    met = neardedup.ring_keys(rows, radius, "k").filter("key = 0")
    lengths = range(equal, segments + 1)
    passed = [neardedup.within_shares(F.col("fp"), F.col("at"), radius, n).alias(f"p{n}") for n in lengths]
    table = met.select("k", *passed).groupBy("k").agg(*[F.max(f"p{n}").alias(f"p{n}") for n in lengths]).collect()
    left = [{r["k"] for r in table if r[f"p{n}"]} for n in lengths]
    assert left[-1] == {k for k, x in enumerate(flipped) if bin(x).count("1") <= radius}
    pruned = [len(a) - len(b) for a, b in zip(left, left[1:])]
    assert min(pruned) >= 0 and sum(pruned) > 0 and all(a >= b for a, b in zip(left, left[1:]))


def test_crowded_keys_go_by_meeting_points(spark):
    rng = random.Random(6)
    prints = sorted({rng.getrandbits(10) << 50 | rng.choice([0, 7, 1 << 20]) for _ in range(150)})
    rows = spark.createDataFrame([(neardedup.signed(p),) for p in prints], "fp long")
    near = groups(prints, lambda a, b: bin(a ^ b).count("1") <= 2)
    for crowded in (2, 10, 1000):
        root = {r["node"]: r["root"] for r in components(neardedup.links(rows, 2, crowded)).collect()}
        got = {p: root.get(neardedup.signed(p), neardedup.signed(p)) for p in prints}
        assert len(set(got.values())) == len(set(near)) and all((near[i] == near[j]) == (got[prints[i]] == got[prints[j]]) for i in range(0, len(prints), 7) for j in range(len(prints)))


def test_similar_texts(awkward, spark):
    found = {r["doc_id"]: r["component_id"] for r in neardedup.similar_groups(awkward).collect()}
    assert found[5] == found[6] == found[7] == found[8] == 5 and found[0] == found[1] == found[2] == 0
    assert found[3] == 3 and found[4] == 4 and found[9] == 9 and found[11] == 11
    stay = neardedup.drop_near_copies(awkward)
    ids = Counter(r["doc_id"] for r in stay.collect())
    assert stay.columns == awkward.columns and ids[5] == 1 and ids[90] == 2 and ids[None] == 2 and not {6, 7, 8} & set(ids)
    assert neardedup.drop_near_copies(awkward.limit(0)).count() == 0 and neardedup.near_groups(awkward.limit(0)).count() == 0


def test_dissimilar_members_of_a_meeting_point_hide_nothing(spark):
    """Equal word sets meet in every view: reordered texts at the smallest and the largest doc_id, and similar ones between."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(200)]
    swapped = lambda k: " ".join([*words[:k], words[k + 1], words[k], *words[k + 2:]])
    shuffled = lambda: " ".join(rng.sample(words, len(words)))
    rows = [(1, shuffled()), (2, shuffled()), (3, " ".join(words)), (4, swapped(50)), (5, swapped(120)), (6, swapped(170)), (9, shuffled())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardedup.similar_groups(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 3, 9: 9}
    assert sorted(r["doc_id"] for r in neardedup.drop_near_copies(docs).collect()) == [1, 2, 3, 9]


def test_bitmaps_never_reject_similar_sets(spark):
    rng = random.Random(8)
    rows = []
    for k in range(0, 400, 2):
        text = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 300))]
        other = [w if rng.random() > 0.03 else "changed" for w in text]
        rows += [(k, " ".join(text)), (k + 1, " ".join(other))]
    views = {r["doc_id"]: r for r in neardedup.word_views(spark.createDataFrame(rows, "doc_id long, text string"), 1, 5).collect()}
    pairs = spark.createDataFrame([(k, views[k]["n"], views[k]["marks"], views[k + 1]["n"], views[k + 1]["marks"]) for k in range(0, 400, 2)], "k long, n long, marks array<long>, m long, others array<long>")
    likely = {r["k"] for r in pairs.filter(neardedup.may_be_similar("n", "marks", "m", "others", 0.8)).collect()}
    texts = dict(rows)

    def jaccard(a, b):
        x, y = ({tuple(t[i:i + 5]) for i in range(max(1, len(t) - 4))} for t in (a.split(), b.split()))
        return len(x & y) / len(x | y)

    similar = {k for k in range(0, 400, 2) if jaccard(texts[k], texts[k + 1]) >= 0.8}
    assert similar <= likely and len(likely) < 200 and len(similar) > 10


def test_texts_of_one_doc_id_stay_apart(spark):
    """Unrelated texts under one doc_id tie no groups together, and each group keeps one row."""
    rng = random.Random(2)
    make = lambda: " ".join(f"w{rng.randint(0, 999)}" for _ in range(60))
    a, b, c = make(), make(), make()
    rows = [(1, a), (7, a), (7, b), (9, b), (7, b), (12, c), (None, a), (None, a), (None, None), (20, None), (21, "  ")]
    stay = neardedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, stay.collect())) == Counter([(1, a), (7, b), (12, c), (None, a), (None, a), (None, None), (20, None)])


def test_components(spark):
    chain = [(k + 1, k) for k in range(40)] + [(100, 101), (102, 101), (7, 7)] + [(500, 500 - k) for k in range(1, 30)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and got[102] == 100 and {got[500 - k] for k in range(30)} == {471}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hashes_equal_the_library():
    texts = [b"", b"  A b\n c ", b"x" * 100, "é ÀB zz".encode(), b"a b c d e f g" * 9]
    for width in (1, 3, 5):
        words = batches.words_of(texts)
        start, size, first = words.shingles(width)
        got = batches.xxh64(words.data, start, size)
        for k, text in enumerate(texts):
            w = text.lower().split()
            want = [xxhash.xxh64_intdigest(b" ".join(w[i:i + width]), 42) for i in range(max(1, len(w) - width + 1))] if w else []
            assert got[first[k]:first[k + 1]].tolist() == want


def test_fingerprints_in_order(awkward, spark):
    docs = awkward.filter("doc_id IS NOT NULL AND doc_id <> 90").dropDuplicates(["doc_id"])
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in fingerprints.compared(docs).collect()}
    own = fingerprints.simhash([t.encode() for _, t in rows])
    assert len(got) == len(rows) and got[5]["fingerprint"] == got[6]["fingerprint"]
    for k, (doc, text) in enumerate(rows):
        following = (k + 1) % len(rows)
        changed = fingerprints.edited(text, rows[following][1])
        other = fingerprints.simhash([changed.encode()])
        assert got[doc]["n_chars"] == len(text) and len(changed) <= len(text)
        assert got[doc]["fingerprint"] == fingerprints.shown(own[k:k + 1])[0] and got[doc]["edited_fingerprint"] == fingerprints.shown(other)[0]
        assert got[doc]["near_next"] == 1 - fingerprints.differing(own[k:k + 1], own[following:following + 1])[0] / 128
    assert fingerprints.compared(awkward).count() == awkward.count() and fingerprints.compared(awkward.limit(0)).count() == 0
    assert [tuple(r)[1] for r in fingerprints.compared(docs.filter("doc_id = 9")).collect()] == [len(rows[9][1])]


def test_block_tables_find_all_within_radius(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, (30, 2), dtype=np.int64)
    near = base.copy()
    for row in near[:20]:
        for bit in rng.choice(127, rng.integers(0, 5), replace=False).tolist():
            row[bit // 64] ^= 1 << (bit % 64) if bit != 63 else 0
    rows = np.concatenate([base, near])
    prints = spark.createDataFrame([tuple(map(int, r)) for r in rows], "hi long, lo long")
    got = Counter(tuple(r) for r in fingerprints.within_radius(prints, prints).collect())
    distinct = {tuple(map(int, r)) for r in rows}
    count = lambda a, b: bin((a[0] ^ b[0]) & (1 << 64) - 1).count("1") + bin((a[1] ^ b[1]) & (1 << 64) - 1).count("1")
    assert got == Counter((*a, *b, count(a, b)) for a in distinct for b in distinct if count(a, b) <= 3)


def removed(rows, length):
    """What brute force cuts from ``(doc_id, bytes)``: counter of (doc_id, size, spans, kept)."""
    seen = Counter(t[i:i + length] for _, t in rows for i in range(len(t) - length + 1))
    want = Counter()
    for doc, text in rows:
        gone = np.zeros(len(text) + 2, dtype=bool)
        for i in range(len(text) - length + 1):
            if seen[text[i:i + length]] > 1:
                gone[i + 1:i + 1 + length] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
        kept = bytes(b for b, g in zip(text, gone[1:]) if not g)
        want[doc, len(text), tuple(zip(edges[::2], edges[1::2])), kept] += 1
    return want


def cut_rows(docs, length):
    return Counter((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in suffix_dedup.cut(docs, length).collect())


@pytest.mark.parametrize("length", [64, 200])
def test_repeated_strings_equal_brute_force(awkward, length):
    assert cut_rows(awkward, length) == removed([(r["doc_id"], (r["text"] or "").encode()) for r in awkward.collect()], length)


def test_long_texts_are_worked_in_stretches():
    rng = np.random.default_rng(1)
    piece = bytes(rng.integers(97, 110, 700, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 110, 5000, dtype=np.uint8)) + piece, piece + bytes(rng.integers(97, 110, 3000, dtype=np.uint8)), b"q" * 2500, b"r" * 1100]
    whole = suffix_dedup.anchors_in(texts, 200).sort_values(["text", "place"]).reset_index(drop=True)
    for stretch in (300, 1024, 2500):
        cut = suffix_dedup.anchors_in(texts, 200, stretch).sort_values(["text", "place"]).reset_index(drop=True)
        assert whole.equals(cut.astype(whole.dtypes))


@pytest.mark.parametrize("mirrored", [False, True])
def test_copies_that_begin_or_end_at_a_stretch_border(spark, mirrored):
    """A text of just over a stretch, and its part behind (or before) the border: nothing but the part itself repeats."""
    rng = np.random.default_rng(5)
    border, size = suffix_dedup.STRETCH, suffix_dedup.STRETCH + 5000
    text = rng.integers(97, 123, size, dtype=np.uint8).tobytes().decode()
    part, span = (text[border - 5000:border], (border - 5000, border)) if mirrored else (text[border:], (border, size))
    got = cut_rows(spark.createDataFrame([(1, text), (2, part)], "doc_id long, text string"), 200)
    assert {k[:3] for k in got} == {(1, size, (span,)), (2, 5000, ((0, 5000),))}


def test_texts_of_several_stretches_equal_brute_force(spark):
    """Copies at many offsets from the borders of short stretches."""
    rng = np.random.default_rng(7)
    make = lambda n: rng.integers(97, 100, n, dtype=np.uint8).tobytes()
    shared = make(400)
    items = [make(900 + k) + shared + make(600) for k in range(0, 260, 37)] + [shared, make(350) + shared[:330], shared[120:] + make(90)]
    whole = suffix_dedup.anchors_in(items, 200).sort_values(["text", "place"]).reset_index(drop=True)
    cut = suffix_dedup.anchors_in(items, 200, 512).sort_values(["text", "place"]).reset_index(drop=True)
    assert whole.equals(cut.astype(whole.dtypes))
    docs = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(items)], "doc_id long, text string")
    assert cut_rows(docs, 200) == removed(list(enumerate(items)), 200)


@pytest.mark.parametrize("crowded", [64, 2])
def test_view_groups_equal_brute_force(spark, crowded):
    """Fingerprints tied by steps of two bits in a view, by pairs of a key and by meeting points; equal ones in two views stay apart."""
    rng = random.Random(4)
    rows = set()
    for _ in range(12):
        fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 9])):
            rows |= {(view, fp) for view in rng.choice([(0,), (1,), (0, 1)])}
            for _ in range(rng.choice([0, 1, 2, 2, 3])):
                fp ^= 1 << rng.randrange(64)
    rows = sorted(rows)
    root = {r: r for r in rows}

    def top(r):
        while root[r] != r:
            r = root[r]
        return r

    for a in rows:
        for b in rows:
            if a[0] == b[0] and (a[1] ^ b[1]).bit_count() <= 2:
                root[max(top(a), top(b))] = min(top(a), top(b))
    wanted = {}
    for r in rows:
        wanted.setdefault(top(r), set()).add(r)
    wanted = {frozenset(g) for g in wanted.values() if len(g) > 1}
    frame = spark.createDataFrame([(v, neardedup.signed(fp)) for v, fp in rows], "view int, fp long")
    found = {}
    for r in neardedup.view_groups(frame, 2, crowded).collect():
        found.setdefault(r["group"], set()).add((r["view"], r["fp"] % (1 << 64)))
    assert {frozenset(g) for g in found.values()} == wanted
