"""Arrow batches of texts as byte arrays: word spans, shingle spans and XXH64 over spans, all vectorised.

A batch is cut into slices of at most ``SLICE_BYTES`` of text (a single longer text is a slice of its own), so the
arrays that are alive at a time follow the slice and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64

# Fixed values of XXH64.
PRIME_1 = U64(0x9E3779B185EBCA87)
PRIME_2 = U64(0xC2B2AE3D27D4EB4F)
PRIME_3 = U64(0x165667B19E3779F9)
PRIME_4 = U64(0x85EBCA77C2B2AE63)
PRIME_5 = U64(0x27D4EB2F165667C5)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What is no letter, digit or part of a longer UTF-8 sequence separates words of normalised text.
PUNCTUATION = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def slices(items: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose texts have at most ``most`` bytes together (one text at least)."""
    begin = size = 0
    for i, item in enumerate(items):
        if size + len(item) > most and i > begin:
            yield begin, i
            begin, size = i, 0
        size += len(item)
    if begin < len(items):
        yield begin, len(items)


@dataclass
class Words:
    """Words of several texts: ``data`` holds them with one space between, text ``t`` has words ``first[t]:first[t+1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of every run of ``width`` words (fewer words: all of them), and ``first`` of the runs per text."""
        count = np.diff(self.first)
        runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
        first = np.concatenate([[0], np.cumsum(runs)])
        inside = np.arange(first[-1]) - np.repeat(first[:-1], runs)
        head = np.repeat(self.first[:-1], runs) + inside
        tail = head + np.repeat(np.minimum(count, width), runs) - 1
        begin = self.start[head]
        return begin, self.end[tail] - begin, first


def words_of(items: list[bytes], separators: np.ndarray = SPACE) -> Words:
    """Words of the texts in lower case (A-Z); ``separators`` says which bytes part words."""
    flat = LOWER[np.frombuffer(b" ".join(items) + b" ", dtype=np.uint8)]
    limits = np.concatenate([[0], np.cumsum([len(x) + 1 for x in items])])
    gap = separators[flat]
    keep = np.empty_like(gap)
    keep[0] = not gap[0]
    np.logical_not(gap[1:] & gap[:-1], out=keep[1:])
    flat[gap] = 0x20
    data, gap = flat[keep], gap[keep]
    # A kept gap ends exactly one word, so words and gaps alternate.
    end = np.flatnonzero(gap)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    kept = np.concatenate([[0], np.cumsum(keep)])[limits]
    return Words(np.concatenate([data, np.zeros(8, np.uint8)]), start, end, np.searchsorted(start, kept))


def rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def mixed(lane: np.ndarray) -> np.ndarray:
    return rotl(lane * PRIME_2, 31) * PRIME_1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``data[start:start+length]`` for each span; ``data`` has eight spare bytes at its end."""
    out = np.empty(len(start), dtype=U64)
    eight = np.ndarray(len(data) - 7, "<u8", buffer=data, strides=(1,))
    four = np.ndarray(len(data) - 3, "<u4", buffer=data, strides=(1,))
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1, [len(ordered)]]) if len(ordered) else []
    with np.errstate(over="ignore"):
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            which, size = order[lo:hi], int(ordered[lo])
            at, left = start[which], size
            if size >= 32:
                v = [np.full(len(at), U64(seed) + x, dtype=U64) for x in (PRIME_1 + PRIME_2, PRIME_2, U64(0), U64(0) - PRIME_1)]
                while left >= 32:
                    for k in range(4):
                        v[k] = rotl(v[k] + eight[at + 8 * k] * PRIME_2, 31) * PRIME_1
                    at, left = at + 32, left - 32
                h = rotl(v[0], 1) + rotl(v[1], 7) + rotl(v[2], 12) + rotl(v[3], 18)
                for k in range(4):
                    h = (h ^ mixed(v[k])) * PRIME_1 + PRIME_4
            else:
                h = np.full(len(at), U64(seed) + PRIME_5, dtype=U64)
            h = h + U64(size)
            while left >= 8:
                h = rotl(h ^ mixed(eight[at]), 27) * PRIME_1 + PRIME_4
                at, left = at + 8, left - 8
            if left >= 4:
                h = rotl(h ^ (four[at].astype(U64) * PRIME_1), 23) * PRIME_2 + PRIME_3
                at, left = at + 4, left - 4
            for k in range(left):
                h = rotl(h ^ (data[at + k].astype(U64) * PRIME_5), 11) * PRIME_1
            h ^= h >> U64(33)
            h *= PRIME_2
            h ^= h >> U64(29)
            h *= PRIME_3
            h ^= h >> U64(32)
            out[which] = h
    return out


ONES = U64(0x0101010101010101)


def bit_votes(hashes: np.ndarray, first: np.ndarray, weights: np.ndarray | None = None, top: int = 1) -> np.ndarray:
    """How much weight has each of the 64 bits set, for each group ``first[g]:first[g+1]`` of hashes: groups x 64.

    Eight bits are counted at a time, one in each byte of a word; blocks of ``255 // top`` hashes keep a byte from
    running over. Weights are whole numbers up to ``top``. Column ``b`` is bit ``b`` from the lowest.
    """
    sizes, block = np.diff(first), 255 // top
    votes = np.zeros((len(sizes), 64), dtype=np.int64)
    if not len(hashes):
        return votes
    blocks = -(-sizes // block)
    begin = np.concatenate([[0], np.cumsum(blocks)])
    starts = np.repeat(first[:-1], blocks) + block * (np.arange(begin[-1]) - np.repeat(begin[:-1], blocks))
    full = np.flatnonzero(sizes)
    for shift in range(8):
        lanes = (hashes >> U64(shift)) & ONES
        if weights is not None:
            lanes *= weights
        sums = np.add.reduceat(lanes, starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        votes[full, shift::8] = np.add.reduceat(sums, begin[full], axis=0)
    return votes


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, lowest first, as unsigned numbers."""
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(U64)


def spread(h: np.ndarray) -> np.ndarray:
    """Another 64 bits from a hash (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = h + U64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def counted_hashes(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each group ``first[g]:first[g+1]``, how often each occurs, and the groups' limits among them."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, owner))
    hashes = hashes[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    return hashes[at], np.diff(np.append(at, len(hashes))), np.searchsorted(at, first)


def distinct_hashes(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, _, limits = counted_hashes(hashes, first)
    return found, limits
