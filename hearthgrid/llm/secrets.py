"""Secret scans with SQL expressions only: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Patterns (kinds ``assign``, ``access``, ``hex``) are split points of the text: what lies between and within the
matches gives their places. Candidate strings of the kind ``entropy`` are runs of key characters, cut at pattern matches. A window of
``WINDOW`` characters slides over each; the sum of ``c * log2(c)`` over its characters' counts ``c`` is kept up to date by
the counts of the character that enters and of the one that leaves among those that stay, and the entropy is
``log2(WINDOW) - sum / WINDOW``. The sums are whole numbers (of ``1 / SCALE`` bits), so a long string adds up no rounding.
Each character class of a string (hexadecimal; letters of both cases with digits; one case with digits; no digits) has its own
threshold. The span of a string runs from its first to its last window that reaches the threshold. Strings on the allow list and strings
inside a pattern's span give none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.llm.frames import documents

QUERY = "op6_secret_scans"
ORACLE_SQL = None

# The base patterns, the group that is measured, and its least length.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
KINDS = (*BASE, "entropy")
#: Runs shorter than the least length never count and hold no other match, so these two are looked up at that length.
LOOKED_UP = {"assign": BASE["assign"][0], "access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}

WINDOW = 20
#: Where a base match begins that has its least length.
BEGINS = r"""[0-9a-f]{16}|AKIA[A-Z0-9]{14}|(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""
#: Runs of key characters, cut at base matches: they end before one, and start at the run's begin or right behind one
#: (a matched ``assign`` reaches to the end of the run, so there is nothing behind it).
CANDIDATE = rf"(?:(?<![A-Za-z0-9+/_=-])|(?<=[0-9a-f]{{16}})(?![0-9a-f])|(?<=[A-Z0-9]{{18}})(?![A-Z0-9]))(?:(?!{BEGINS})[A-Za-z0-9+/_=-]){{{WINDOW},}}+"
#: Character class of a candidate by pattern, first match wins, and the bits per character that make it a secret.
CLASSES = (
    (r"^[0-9]+$", None),
    (r"^([0-9a-f]+|[0-9A-F]+)$", 3.0),
    (r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])", 3.6),
    (r"^(?=.*[A-Za-z])(?=.*[0-9])", 3.4),
    (r"^(?=.*[A-Za-z])", 3.9),
)
#: Harmless strings: UUIDs, dates and versions, paths of words and short numbers, and those in which a placeholder starts in every
#: window. No pattern repeats a group without bound: the regex engine would go one call deeper for each repetition.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9T:_/+-]+$",
    r"^(?=.*[/_=+-])(?!.*(?:[0-9]{5}|(?:^|[A-Za-z])[0-9]|[0-9][A-Za-z]))",
    rf"(?i)^(?!.*?(?:(?!example|placeholder|x{{6}}|0123456|abcdef).){{{WINDOW}}})",
)
#: Long candidates are worked through in pieces of so many windows, long lists of places in parts of so many.
STRETCH, LISTED = 2048, 512
SCALE = 1 << 40
#: What a character adds to the sum of ``c * log2(c)`` if there were ``c`` of it, for each ``c``.
STEPS = [round(((c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0)) * SCALE) for c in range(WINDOW)]
SPAN = "struct<kind:int,start:int,stop:int>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def _located(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans of the pattern's matches (leftmost, not overlapping) whose group has ``least`` characters."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole, part = (F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), F.length) for g in (0, group))
    own = F.zip_with(whole, part, lambda w, g: F.struct(w.alias("own"), g.alias("n")))
    matches = F.zip_with(between, own, lambda gap, m: F.struct(gap.alias("gap"), m["own"].alias("own"), m["n"].alias("n")))
    none = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("here"), F.array().cast(f"array<array<{SPAN}>>").alias("before"))

    def step(state, x):
        """Move behind the match and list it; the list goes on in parts, as an array is copied when it grows."""
        begin = state["at"] + x["gap"]
        span = F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + x["own"]).alias("stop")))
        full = F.size(state["here"]) >= LISTED
        counts = F.coalesce(x["n"] >= least, F.lit(False))
        here = F.when(~counts, state["here"]).when(full, span).otherwise(F.concat(state["here"], span))
        before = F.when(counts & full, F.concat(state["before"], F.array(state["here"]))).otherwise(state["before"])
        return F.struct((begin + F.coalesce(x["own"], F.lit(0))).alias("at"), here.alias("here"), before.alias("before"))

    return F.aggregate(matches, start, step, lambda state: F.concat(F.flatten(state["before"]), state["here"]))


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns."""
    found = []
    for kind, (_, group, least) in BASE.items():
        pattern = LOOKED_UP[kind]
        spans = _located(text, pattern, group, least, KINDS.index(kind))
        found.append(F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>")))
    return F.concat(*found)


def hot_windows(chars: Column, threshold: Column) -> Column:
    """``first, last``: starts (from 0) of the first and last window of an array of characters that reach the threshold, null if none does."""
    steps = F.array(*[F.lit(n).cast("long") for n in STEPS])
    kept = WINDOW - 1

    def change(i):
        """What the sum changes by when character ``i`` enters and the one that is a window's length before it leaves."""
        stay = F.slice(chars, F.greatest(i - kept, F.lit(0)) + 1, F.least(i, F.lit(kept)))
        enters = F.get(steps, F.least(i, F.lit(kept)) - F.size(F.array_remove(stay, F.get(chars, i))))
        leaves = F.get(steps, F.lit(kept) - F.size(F.array_remove(stay, F.get(chars, i - WINDOW))))
        return F.struct(i.alias("i"), F.when(i >= WINDOW, enters - leaves).otherwise(enters).alias("more"))

    limit = F.lit(float(WINDOW * SCALE)) * (F.log2(F.lit(float(WINDOW))) - threshold) + F.lit(1e-9 * SCALE)

    def slide(state, x):
        total = state["total"] + x["more"]
        hot = (x["i"] >= kept) & (total <= state["limit"])
        return F.struct(total.alias("total"), state["limit"].alias("limit"), F.when(hot & state["first"].isNull(), x["i"] - kept).otherwise(state["first"]).alias("first"),
                        F.when(hot, x["i"] - kept).otherwise(state["last"]).alias("last"))

    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).cast("long").alias("total"), limit.alias("limit"), none.alias("first"), none.alias("last"))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.size(chars) - 1), change), start, slide)


def _threshold(candidate: Column) -> Column:
    chosen = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES):
        chosen = F.when(candidate.rlike(pattern), F.lit(bits).cast("double")).otherwise(chosen)
    for pattern in ALLOWED:
        chosen = F.when(candidate.rlike(pattern), F.lit(None).cast("double")).otherwise(chosen)
    return chosen


def entropy_spans(text: Column) -> Column:
    """Spans of candidate strings with windows of high entropy."""
    places = _located(text, CANDIDATE, 0, WINDOW, KINDS.index("entropy"))
    strings = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    judged = F.zip_with(places, strings, lambda p, s: F.struct(p["start"].alias("start"), s.alias("s"), _threshold(s).alias("bits")))
    judged = F.filter(judged, lambda c: c["bits"].isNotNull())
    nowhere = F.struct(F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def windows(pieces, bits):
        """First and last hot window of a string in pieces; each is read with the start of the next, so no window is cut."""
        def inside(piece, k):
            more = F.coalesce(F.substring(F.get(pieces, k + 1), 1, WINDOW - 1), F.lit(""))
            return F.struct((k * STRETCH).alias("b"), _let(F.split(F.concat(piece, more), ""), lambda chars: hot_windows(chars, bits)).alias("w"))

        def join(state, x):
            return F.struct(F.coalesce(state["first"], x["b"] + x["w"]["first"]).alias("first"), F.coalesce(x["b"] + x["w"]["last"], state["last"]).alias("last"))

        return F.aggregate(F.transform(pieces, inside), nowhere, join)

    def spanned(c):
        hot = _let(F.regexp_extract_all(c["s"], F.lit(f".{{1,{STRETCH}}}"), F.lit(0)), lambda pieces: windows(pieces, c["bits"]))
        return _let(hot, lambda w: F.struct(F.lit(KINDS.index("entropy")).alias("kind"), (c["start"] + w["first"]).alias("start"), (c["start"] + w["last"] + WINDOW).alias("stop")))

    found = F.filter(F.transform(judged, spanned), lambda s: s["start"].isNotNull())
    return F.when(text.rlike(CANDIDATE), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _ordered(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of ordered spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def scanned(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``text``, with ``base`` and ``spans``: arrays of (start, kind, stop), ordered, code points, end exclusive.

    A null text is scanned as the empty one. Rows are independent, so repeated rows give repeated results. Spans of
    different kinds may overlap; added spans never touch base ones.
    """
    whole = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    based = whole.withColumn("base", base_spans(F.col("text")))
    # One row in, one row out: spans are computed once although several columns read them.
    based = based.select(*keep, "text", F.explode(F.array(F.struct("base", entropy_spans(F.col("text")).alias("added")))).alias("found"))
    free = F.filter("found.added", lambda a: ~F.exists("found.base", lambda b: (a["start"] < b["stop"]) & (b["start"] < a["stop"])))
    merged = based.select(*keep, "text", F.explode(F.array(F.struct(_ordered(F.col("found.base")).alias("base"), _ordered(F.concat("found.base", free)).alias("spans")))).alias("r"))
    return merged.select(*keep, "text", "r.base", "r.spans")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with every stretch that ordered ``spans`` cover replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        begin = F.greatest(state["at"], s["start"])
        between = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        fresh = F.concat(state["out"], between, F.lit(mark))
        out = F.when(s["start"] >= state["at"], fresh).otherwise(state["out"])
        return F.struct(F.greatest(s["stop"], begin).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns; secrets in ``text`` are blacked out and ``n_chars`` (if there) is counted anew.

    Null texts stay null; texts without secrets stay as they are.
    """
    others = [c for c in docs.columns if c != "text"]
    keep = [F.struct(*[F.col(c) for c in others]).alias("__row"), F.col("text").isNull().alias("__none")]
    found = scanned(docs.select(*keep, "text"), ("__row", "__none"))
    clean = found.select("__row", F.when(~F.col("__none"), redacted(F.col("text"), F.col("spans"))).alias("text"), (F.size("spans") > 0).alias("__changed"))
    def value(c):
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.when(F.col("__changed"), F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(f"__row.{c}")).alias(c)
        return F.col(f"__row.`{c}`").alias(c)
    return clean.select(*[value(c) for c in docs.columns])


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and places of the secrets in every document."""
    found = scanned(documents(spark, folder))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        F.col("doc_id").cast("long"), *[number(k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
