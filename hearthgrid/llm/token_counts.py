"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary matches of a text; for every position the best score of a
segmentation that ends there is kept with its number of pieces, and nothing else. Tie rule of unigram tokenizers:
of equal scores the first one found stays, that is the one whose last piece begins first. A character that no piece
covers alone may be passed as unknown at the lowest score less ten; it falls back to bytes and counts as many tokens
as its UTF-8 form has.

No piece of the vocabulary holds a space behind another character, and some characters (line ends among them) are in
no piece at all. A best segmentation therefore falls apart at these places, and each stretch between them has to be
worked out once: a bounded store per worker process remembers the counts.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgrid.llm.frames import documents

QUERY = "op1_token_counts"
ORACLE_SQL = None
# Fixed values of unigram tokenizers: the sign for a space, and how far unknown lies below the lowest score.
SPACE, UNKNOWN_PENALTY = "▁", 10.0
#: Known stretches per Python worker; the store is emptied when it is full. Longer stretches are not stored.
KNOWN_STRETCHES, LONGEST_KNOWN = 500_000, 64


def vocabulary_file() -> str:
    """Where the vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and their scores; control, unknown and byte pieces match no text."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (k for k in range(model.vocab_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)))
    return [(model.id_to_piece(k), model.get_score(k)) for k in ids]


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}
        used = set("".join(piece for piece, _ in pieces))
        joined = any(SPACE in piece.lstrip(SPACE) for piece, _ in pieces)
        # Stretches: spaces and what follows them up to the next space or line end; whole lines if pieces join words.
        line = "" if "\n" in used else "\n"
        self.stretch = re.compile(f" *[^ {line}]+| +|{line}" if line and not joined else " *[^ ]+| +" if not joined else f"[^{line}]+|{line}" if line else "(?s).+")

    def worked_out(self, stretch: str) -> int:
        """Number of tokens in the best segmentation of a stretch."""
        text = stretch.replace(" ", SPACE)
        best, count = [0.0], [0]
        matches = self.automaton.iter(text)
        end, found = next(matches, (len(text), None))
        for at, letter in enumerate(text):
            top, pieces, alone = None, 0, False
            while end == at:  # longest piece first
                length, score = found
                score += best[at + 1 - length]
                if top is None or score > top:
                    top, pieces = score, count[at + 1 - length] + 1
                alone = alone or length == 1
                end, found = next(matches, (len(text), None))
            if not alone and (top is None or best[at] + self.unknown > top):
                top, pieces = best[at] + self.unknown, count[at] + len(letter.encode())
            best.append(top)
            count.append(pieces)
        return count[-1]

    def of(self, text: str) -> int:
        """Number of tokens of a text, which gets a space in front; the empty text has none."""
        if not text:
            return 0
        stretches, known = self.stretch.findall(" " + text), self.known
        try:
            return sum([known[s] for s in stretches])
        except KeyError:
            pass
        if len(known) > KNOWN_STRETCHES:
            known.clear()
        total = 0
        for s in stretches:
            n = known.get(s)
            if n is None:
                n = self.worked_out(s)
                if len(s) <= LONGEST_KNOWN:
                    known[s] = n
            total += n
        return total


@functools.lru_cache(maxsize=2)
def counter_of(path: str) -> Counter:
    """One counter for each worker process."""
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_chars, n_tokens)`` for every row and whole text; null and empty texts have no token.

    Rows are independent: repeated rows and null doc_ids give their own results; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path or vocabulary_file())
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([counter.of(t) for t in texts], pa.int64())],
                ["doc_id", "n_chars", "n_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, n_tokens long")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Token count of every document."""
    return token_counts(documents(spark, folder))
