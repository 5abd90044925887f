"""Sharding, packing, decontamination, classifiers and the pipeline on small tables."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hearthgrid.llm import decontamination, packing, quality, registry, sharding, toxicity
from hearthgrid.llm.labelled import fold, sample

FOLDER = "/root/testdata/sf0.001"


def test_sharding(awkward, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 7)  # several buckets even here
    rows = awkward.select("doc_id", "text", "source").collect()
    got = sharding.interleaved(awkward, 5).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows)
    shards = Counter(r["shard"] for r in got)
    assert set(shards) == set(range(5)) and max(shards.values()) - min(shards.values()) <= 1
    for s, n in shards.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    again = sharding.interleaved(awkward.repartition(7), 5).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert sharding.interleaved(awkward.limit(0)).count() == 0 and sharding.interleaved(awkward.limit(3), 24).count() == 3


def test_sharding_matches_the_mixture(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 17)).alias("source"))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    seen = Counter((r["shard"], source[r["doc_id"]]) for r in sharding.interleaved(docs, 12).collect())
    total = Counter(source.values())
    assert all(abs(seen[s, k] - n / 12) <= 2 for s in range(12) for k, n in total.items())


def test_packing(awkward):
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in awkward.collect()]
    got = packing.pack(awkward, length=50).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(ids.astype("<u4").tobytes())
    for k in range(len(sequences)):
        at = 0
        for r in sorted(sequences[k], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 50 or k == len(sequences) - 1
    documents, stream = [], []
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        stream += np.frombuffer(r["ids"], "<u2").tolist()
        if r["start"] == 0:
            documents.append((r["doc_id"], r["doc_tokens"]))
    assert Counter(documents) == Counter((d, len(i)) for d, i in rows) and len(stream) == sum(len(i) for _, i in rows)
    rebuilt, at = Counter(), 0
    for doc, n in documents:
        rebuilt[doc, tuple(stream[at:at + n])] += 1
        at += n
    assert rebuilt == Counter((d, tuple(i)) for d, i in rows)
    assert packing.pack(awkward.limit(0)).count() == 0


def test_packing_ids_equal_the_library():
    import random

    import public_tokenizers

    library, own, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Ids(**packing.tokenizer_files()), random.Random(1)
    letters = " \n\t\r\x0b\x1c\x1f\x85\xa0 　ab'stéñ1２!?漢😀<"
    for k in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) + ("<|endoftext|>" if k % 50 == 0 else "") + rng.choice(letters)
        assert np.frombuffer(own.of(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def contained(docs, items, threshold=0.8):
    def runs(text, width):
        words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text).split(" ")
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words if w]
        return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}, len(words)

    for doc, text in docs:
        for item, passage in items:
            n = runs(passage or "", 1)[1]
            width = min(5, n)
            if n:
                want = runs(passage, width)[0]
                both = len(want & runs(text or "", width)[0])
                if both >= threshold * len(want):
                    yield doc, item, both, len(want)


def test_decontamination(awkward, spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    long = next(t for d, t in rows if d == 9)
    words = long.split()
    items = [(1, " ".join(words[1000:1040])), (2, ("; ".join(words[40:60]) + "!").upper()), (3, " ".join(words[5:20] + ["alien"] + words[21:35])), (4, "no such words in any text at all"),
             (5, None), (6, ""), (7, "One"), (8, " ".join(words[1000:1040])), (1, " ".join(words[1000:1040])), (9, "two words"), (10, " ".join(words[100:104] + ["x"] * 9)), (11, " ".join(words[5:15] + ["alien"] + words[16:25]))]
    table = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    want = set(contained(rows, items))
    assert {(9, 1), (9, 8), (9, 2), (9, 3), (3, 7), (4, 9)} == {w[:2] for w in want}
    for size in (decontamination.BLOCK_BYTES, 300):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        got = [tuple(r)[:4] for r in decontamination.contained(awkward, table).collect()]
        assert set(got) == want and len(got) == len(want)
        clean = decontamination.drop_contaminated(awkward, table)
        assert clean.columns == awkward.columns and Counter(r["doc_id"] for r in clean.collect()) == Counter(d for d, _ in rows if d not in {w[0] for w in want})
    assert decontamination.contained(awkward, table.limit(0)).count() == 0 and decontamination.contained(awkward.limit(0), table).count() == 0


@pytest.mark.parametrize("module,label,floor", [(quality, "quality", 0.85), (toxicity, "toxic", 0.8)])
def test_classifiers_on_held_out_rows(spark, module, label, floor):
    folder = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in module.query(spark, folder).collect()]
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= module.THRESHOLD) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % module.MODULUS == module.HELD_OUT) for r in rows)
    ordered = sorted(held, key=lambda r: r["score"])
    y = np.array([truth[r["doc_id"]] for r in ordered])
    pos = y.sum()
    auc = (np.flatnonzero(y).sum() - pos * (pos - 1) / 2) / (pos * (len(y) - pos))
    accuracy = np.mean([r["predicted"] == truth[r["doc_id"]] for r in held])
    assert auc > 0.95 and accuracy > floor


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_awkward_rows(spark, awkward, module, label):
    for known in ([], [(5, 1)], [(5, 1), (5, 0), (None, 1), (6, None)]):
        table = spark.createDataFrame(known, f"doc_id long, {label} int")
        rows = module.score(awkward, module.train(awkward, table)).collect()
        assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    table = spark.createDataFrame([(k, k % 2) for k in range(50)], f"doc_id long, {label} int")
    model = module.train(awkward, table)
    scores = defaultdict(set)
    for r in module.score(awkward, model).collect():
        scores[r["doc_id"]].add(r["score"])
    assert scores[5] == scores[6] and scores[0] == scores[1]
    assert module.score(awkward.limit(0), model).count() == 0
    labelled, totals = sample(awkward, table, label, fold(module.MODULUS) != module.HELD_OUT, 4)
    assert len(labelled) <= 8 and sum(totals.values()) == sum(zlib.crc32(str(k).encode()) % module.MODULUS != module.HELD_OUT for k in range(50))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and 0 < seen[-1] < seen[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    benchmark = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert not list(contained([tuple(r) for r in docs.select("doc_id", "text").collect()], benchmark))


def test_pipeline_on_awkward_rows(spark, awkward, tmp_path):
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = corpus_pipeline.documents(spark, str(tmp_path))
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        docs = stage(spark, docs, str(tmp_path))
        docs.count()


def test_check_sql(spark):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    for key, sql in registry.oracles().items():
        got = registry.queries()[key](spark, FOLDER)
        names = sorted(got.columns)
        assert Counter(map(tuple, got.select(*names).collect())) == Counter(con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
