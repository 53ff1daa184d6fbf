"""Numpy views of Arrow string batches: words and rolling hashes for many texts at once.

Every function works on a chunk: the UTF-8 bytes of some whole texts in one array
with the offset of each. Nothing here knows Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
_rng = np.random.default_rng(20_240_607)
BYTE_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
LANES = _rng.integers(0, 1 << 63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Separators of `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True

#: A second modulus for substrings: powers of two alone let some strings of equal length
#: share a hash whatever the base (those of Thue and Morse, from 1024 bytes on).
PRIME = U64((1 << 31) - 1)
PRIME_BASE = 1_734_205_963
#: So many sums of a byte times a power stay below 2**63.
STRETCH = 1 << 22

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n (modulo 2**64), kept for the next chunk."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            out = np.full(size, base, U64)
            out[0] = 1
            _powers[name] = np.cumprod(out, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME_BASE**i and its inverse for i < n, modulo PRIME."""
    if "prime" not in _powers or len(_powers["prime"]) < n:
        p = int(PRIME)
        for name, base in (("prime", PRIME_BASE), ("prime_down", pow(PRIME_BASE, -1, p))):
            out = np.ones(1, U64)
            while len(out) < max(n, CHUNK_BYTES + 1):
                out = np.concatenate([out, out * U64(pow(base, len(out), p)) % PRIME])
            _powers[name] = out
    return _powers["prime"][:n], _powers["prime_down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets of each text and the end), nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        end = min(end, n)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def stretches(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(index of the first text, number of texts) of the chunks of a column."""
    for at, _, offsets in chunks(column, size):
        yield at, len(offsets) - 1


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of a chunk, and the number of the first word
    of each text (and of the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Sums:
    """Prefix sums of a chunk under both moduli."""

    def __init__(self, wide: np.ndarray, prime: np.ndarray):
        self.wide, self.prime = wide, prime

    def __len__(self) -> int:
        return len(self.wide)


def prefix(data: np.ndarray) -> Sums:
    """Prefix sums from which the hash of any substring follows."""
    n = len(data)
    up, _ = powers(n + 1)
    wide = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUE[data] * up[:n], dtype=U64, out=wide[1:])
    up, _ = prime_powers(n + 1)
    prime = np.zeros(n + 1, U64)
    terms = (data.astype(U64) + U64(1)) * up[:n]
    for at in range(0, n, STRETCH):
        end = min(n, at + STRETCH)
        np.cumsum(terms[at:end], dtype=U64, out=prime[at + 1 : end + 1])
        # a sum is kept whole within a stretch; the next one goes on from its remainder
        prime[at + 1 : end + 1] = (prime[at + 1 : end + 1] + prime[at]) % PRIME
    return Sums(wide, prime)


def weak_hash(sums: Sums, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of substrings that something else tells apart later, modulo 2**64 only."""
    _, down = powers(len(sums))
    return mix((sums.wide[ends] - sums.wide[starts]) * down[starts] + (ends - starts).astype(U64) * LANES[63])


def substring_hash(sums: Sums, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = prime_powers(len(sums))
    rest = (sums.prime[ends] + PRIME - sums.prime[starts]) % PRIME * down[starts] % PRIME
    return mix(weak_hash(sums, starts, ends) + rest * LANES[62])


def ngrams(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n neighbours; over the whole chunk, so callers keep those inside a text."""
    size = len(values) - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    out = values[:size] * LANES[0]
    for k in range(1, n):
        out = out + values[k : k + size] * LANES[k]
    return mix(out)
