import random

import pytest

SCHEMA = "doc_id long, text string, source string, part long, score double, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with nulls everywhere, empty and long texts, copies, near copies, repeated rows and clashing column names."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = make(150)
    near = base.split()
    near[70] = "changed"
    passage = make(60)
    texts = [None, "", "   \n ", "one", "two words", base, base, " ".join(near), base.upper(), make(3000), "é漢😀 " + make(30), make(40) + " " + passage + " " + make(30),
             make(20) + " " + passage + " " + make(50), "z" * 900, "z" * 500, *[make(rng.randint(1, 120)) for _ in range(40)]]
    rows = [(k, t, None if k % 7 == 0 else f"s{k % 3}", 5, 0.5, 1) for k, t in enumerate(texts)]
    rows += [(5, base, "s1", 5, 0.5, 1), (None, base, None, None, None, None), (None, None, None, None, None, None), (90, make(33), "s0", 1, 1.0, 1), (90, make(35), "s0", 1, 1.0, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
