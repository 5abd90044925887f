import hashlib
import math
import random
import re
import time
from collections import Counter

from hearthgrid.llm import secrets as S

SCHEMA = "doc_id long, text string, base string, spans string, n_chars long"
RNG = random.Random(5)
KEY = "".join(RNG.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(40))
LONG = "".join(RNG.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789+/") for _ in range(1500))
TEXTS = [
    None, "", "plain words only", f"use {KEY} now", f"é漢😀 {KEY}, and {KEY}!", f"password = \"{KEY}\" tail", f"x{LONG}y", "a" * 30 + "1" * 30,
    "token=secret:abcdefghijklmnop", "Secret : short token:'abcdefghijkl'", "AKIA" + "B7" * 10 + " AKIAshort", "0123456789abcdef0123 deadbeefdeadbeef",
    "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "123e4567-e89b-12d3-a456-426614174000", "some/long/path/of/words/1234", "https_example_" + KEY,
    "ab" * 3000 + " " + "word " * 4000 + KEY, "api_key=" + "z" * 12 + " apikey='" + "q" * 11, f"{KEY[:19]} {KEY[:20]}", "aA1" + "b" * 19 + KEY[:20] + "c" * 300 + KEY[20:],
]


def base(text):
    out = []
    for kind, (pattern, group, least) in S.BASE.items():
        out += [(m.start(), S.KINDS.index(kind), m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out)


def threshold(s):
    if any(re.search(p, s) for p in S.ALLOWED):
        return None
    return next((bits for p, bits in S.CLASSES if re.search(p, s)), None)


def added(text):
    for m in re.finditer(S.CANDIDATE, text):
        s, bits = m[0], threshold(m[0])
        if bits is None:
            continue
        hot = []
        for k in range(len(s) - S.WINDOW + 1):
            counts = Counter(s[k:k + S.WINDOW]).values()
            if -sum(c / S.WINDOW * math.log2(c / S.WINDOW) for c in counts) >= bits - 1e-9:
                hot.append(k)
        if hot:
            yield m.start() + hot[0], 3, m.start() + hot[-1] + S.WINDOW


def test_spans_equal_brute_force(spark):
    docs = spark.createDataFrame([(k, t, "x", "y", 7) for k, t in enumerate(TEXTS)] + [(None, "token=abcdefghijklmnop", None, None, None)], SCHEMA)
    found = {r["doc_id"]: r for r in S.scanned(docs).collect()}
    seen = 0
    for k, text in enumerate(TEXTS):
        text = text or ""
        fixed = base(text)
        free = [a for a in added(text) if not any(a[0] < b[2] and b[0] < a[2] for b in fixed)]
        seen += len(free)
        assert [tuple(s) for s in found[k]["base"]] == fixed, text[:80]
        assert [tuple(s) for s in found[k]["spans"]] == sorted(fixed + free), text[:80]
    assert seen >= 6 and len(found[None]["base"]) == 1


def test_redaction_and_clashing_columns(spark):
    docs = spark.createDataFrame([(k, t, "x", "y", None if t is None else len(t)) for k, t in enumerate(TEXTS)], SCHEMA)
    out = S.redact(docs)
    assert out.schema == docs.schema
    rows = {r["doc_id"]: r for r in out.collect()}
    for k, text in enumerate(TEXTS):
        if text is None:
            assert rows[k]["text"] is None
            continue
        pieces, at = [], 0
        for a, _, b in sorted(base(text) + [s for s in added(text) if not any(s[0] < x[2] and x[0] < s[2] for x in base(text))]):
            if a >= at:
                pieces += [text[at:a], "[REDACTED]"]
            at = max(at, b)
        assert rows[k]["text"] == "".join(pieces) + text[at:]
        assert rows[k]["n_chars"] == len(rows[k]["text"]) and rows[k]["base"] == "x"


def test_query_digest_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in S.query(spark, str(tmp_path)).collect():
        want = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in base(TEXTS[r["doc_id"]] or ""))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert S.redact(docs.limit(0)).count() == 0 and S.scanned(docs.limit(0)).count() == 0


def test_keys_beside_patterns_and_placeholders(spark):
    digest, letters = "0123456789abcdef" * 2 + "01234567", "qWzRtYpLkJhGfDsXcVbNmEuIoAQwZrTyPlKj"
    around = [(f"{digest}/", ""), (f"{digest}-", f"-{digest}"), ("AKIA" + "B7" * 8 + "/", ""), ("", f"/{digest}"), ("", "-token=" + "v" * 14),
              ("example/keys/", ""), ("https_example_", ""), ("abcdef/", "/xxxxxxxx")]
    texts = [f"see {a}{KEY}{b} end" for a, b in around] + [f"see {letters} end", "example/placeholder/example1", "see " + "x" * 40 + "1 end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in S.scanned(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in S.redact(docs).collect()}
    for k, (before, _) in enumerate(around):
        at = len("see " + before)
        assert any(s["kind"] == 3 and s["start"] <= at + 2 and s["stop"] >= at + len(KEY) - 2 for s in found[k]), texts[k]
        assert KEY[3:-3] not in clean[k] and digest not in clean[k]
    assert [s["kind"] for s in found[len(around)]] == [3] and not found[len(around) + 1] and not found[len(around) + 2]


def words(rng, n, letters):
    return "".join(rng.choice(letters) for _ in range(n))


def test_strings_of_20000_characters_equal_brute_force(spark):
    rng = random.Random(9)
    mixed = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789+/"
    texts = [words(rng, 20_000, mixed), "a1B/" * 4000 + words(rng, 4000, mixed), words(rng, 20_000, "abcdefABCDEF0123456789"), "x" * 9000 + words(rng, 60, mixed) + "Q1q" * 4000,
             " ".join(words(rng, 30, mixed) for _ in range(700)), "deadbeef00112233 " * 1300, words(rng, S.STRETCH + 7, "aB1") + words(rng, S.STRETCH - 3, mixed)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in S.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        fixed = base(text)
        assert got[k] == sorted(fixed + [a for a in added(text) if not any(a[0] < b[2] and b[0] < a[2] for b in fixed)]), text[:60]


def test_megabytes_without_a_break(spark):
    """Each a single candidate; a deep regex or a step that walks the string from its start would not come back."""
    rng = random.Random(3)
    base64 = "".join(chr(c) for c in bytes(rng.choices(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1 << 20)))
    upper = "".join(chr(c) for c in bytes(rng.choices(b"0123456789ABCDEF", k=1 << 20)))
    texts = ["a/b/" * (1 << 18), base64, upper, "0123456789abcdef" * (1 << 16), "example/" * (1 << 17), "=" * (1 << 20), "ab-12/" * (1 << 17)]
    began = time.perf_counter()
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in S.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.perf_counter() - began < 300
    assert got[0] == [] and got[3] == [(0, 2, 1 << 20)] and got[4] == [] and got[5] == [] and got[6] == []
    whole = lambda spans: spans and spans[0][0] < 40 and spans[-1][2] > (1 << 20) - 40
    assert whole(got[1]) and whole(got[2])
