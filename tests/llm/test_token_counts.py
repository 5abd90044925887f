import random

import duckdb
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from hearthgrid.llm import token_counts as C


def reference(pieces):
    """The library's own unigram model over the same pieces, bytes for unknown characters."""
    vocab = [("<unk>", 0.0), *pieces, *[(f"<0x{b:02X}>", 0.0) for b in range(256)]]
    made = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement=C.SPACE, prepend_scheme="always", split=False)
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(4))
def test_small_vocabularies_with_ties(seed):
    rng = random.Random(seed)
    names = {"".join(rng.choice("ab" + C.SPACE) for _ in range(rng.randint(1, 4))) for _ in range(25)}
    if seed % 2:
        names = {n for n in names if C.SPACE not in n.lstrip(C.SPACE)}
    pieces = [(n, float(-rng.randint(0, 4))) for n in sorted(names)]
    counter, want = C.Counter(pieces), reference(pieces)
    for _ in range(1500):
        text = "".join(rng.choice("ab \ncé") for _ in range(rng.randint(1, 14)))
        if text.startswith(" ") or C.SPACE in text:
            continue
        assert counter.of(text) == want(text), (text, pieces)


def test_whole_texts_equal_the_library():
    pieces = C.vocabulary(C.vocabulary_file())
    counter, want = C.Counter(pieces), reference(pieces)
    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()
    for (text,) in [*rows, ("a  b   c",), ("漢字 😀\n\n  x",), ("x" * 5000,), ("\t\x00end ",)]:
        assert counter.of(text) == want(text), text[:80]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "the end", 7), (3, "the end", 8), (3, "the end", 8)], "doc_id long, text string, n_tokens long")
    got = sorted([tuple(r) for r in C.token_counts(docs).collect()], key=str)
    n = C.counter_of(C.vocabulary_file()).of("the end")
    assert n > 0 and got == sorted([(1, 0, 0), (2, 0, 0), (None, 7, n), (3, 7, n), (3, 7, n)], key=str)
    assert C.token_counts(docs.limit(0)).count() == 0
