"""The prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from hearthgrid.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, shard long, depth string, size double, ends string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_force(rows):
    """Rows (conv_id, turn, role, text); turns of one number must be equal, or their order is not fixed by the contract."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(abs(c) % 5 * (1 if c >= 0 else -1))
        sequence = tuple(own.get(base, [])[:h] + ts[h:])
        for d in range(len(sequence) + 1):
            members[sequence[:d]].append((c, len(sequence)))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = Counter(), Counter()
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, n in of if n == len(node)))
        parent = min(members[node[:-1]])[0] if node else None
        out.append((min(of)[0], len(node), parent, len(of), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def found(conversations, *sizes):
    got = prefix_trie.trie(conversations, *sizes)
    assert got.columns == COLUMNS
    return Counter(map(tuple, got.collect()))


@pytest.fixture(scope="module")
def awkward_rows():
    rng = random.Random(5)
    said = [None, "", "hi", "é漢😀", "yes", "x" * 5000]
    shared = [("system", f"line {k}") for k in range(90)]
    rows = []
    for conv in [*range(60), -7, -5, -3, 10**12 + 4]:
        base = shared[:rng.randint(0, 90)] if conv % 3 == 0 else []
        for k, (role, text) in enumerate(base + [(rng.choice(["user", "assistant", None]), rng.choice(said)) for _ in range(rng.randint(1, 12))]):
            rows.append((conv, k if k else rng.choice([None, 0]), role, text))
    for conv in range(200, 260):  # copies, and heads of copies
        rows += [(conv, k, "user", f"same {k}") for k in range(11 if conv % 4 else 6)]
    rows += [(300, 3, "user", "again"), (300, 3, "user", "again"), (300, None, None, None), (None, 1, "user", "lost"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("sizes", [(), (4, 5), (1, 3), (32, 1)])
def test_trie_equals_brute_force(spark, awkward_rows, sizes):
    extra = [(*r, 1, "d", 0.5, None) for r in awkward_rows]
    random.Random(1).shuffle(extra)
    docs = spark.createDataFrame(extra, SCHEMA).repartition(3)
    assert found(docs, *sizes) == brute_force(awkward_rows)


def test_trie_of_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert found(table, 3, 50) == brute_force(rows)
    assert Counter(map(tuple, prefix_trie.query(spark, "/root/testdata/sf0.001").collect())) == brute_force(rows)


def test_long_conversations_run_over_groups_of_bands(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "GROUP", 3)
    rows = [(c, k, "user", f"turn {k}" if k < 70 + c else f"own {c} {k}") for c in range(0, 30, 5) for k in range(100)]
    assert found(spark.createDataFrame([(*r, 1, "d", 0.5, None) for r in rows], SCHEMA), 4, 7) == brute_force(rows)


def test_tables_without_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert not found(empty) and not found(spark.createDataFrame([(None, 1, "user", "x", 1, None, None, None)], SCHEMA))
    assert found(empty.union(spark.createDataFrame([(4, None, None, None, None, None, None, None)], SCHEMA))) == brute_force([(4, None, None, None)])
