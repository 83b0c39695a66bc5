"""Arrow columns as numpy buffers, and word and window hashes over whole batches.

Everything here works on one slice of an Arrow batch at a time; a slice holds a bounded number of text
bytes (or one row, if that row alone is longer), whatever the number of rows in the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20
LONG_WORD = 64

# Byte classes of the two word definitions in use: everything but ASCII white space, and letters,
# digits and all non-ASCII characters.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = bytes(range(256)).lower()
#: Lower case, and a blank for whatever is in no alphanumeric word: ``text.translate(...)``, then ``split()``.
TO_WORDS = bytes(LOWER[i] if ALPHANUMERIC[i] else 0x20 for i in range(256))

_generator = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _generator.integers(0, 2**64, 256, dtype=np.uint64, endpoint=False)
_OTHER_VALUES = _generator.integers(0, 2**64, 256, dtype=np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_OTHER_BASE = np.uint64(0xD1342543DE82EF95)
_OTHER_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))
_powers = {base: np.ones(1, np.uint64) for base in (_BASE, _INVERSE, _OTHER_BASE, _OTHER_INVERSE)}
_KEPT_POWERS = 1 << 21  # of a base; the powers for longer sequences are computed whenever they are needed


def powers(n: int, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i in 0..n."""
    bases = (_OTHER_BASE, _OTHER_INVERSE) if other else (_BASE, _INVERSE)
    found = []
    for base in bases:
        if len(_powers[base]) <= n:
            values = np.full(max(n + 1, min(n + n // 8, _KEPT_POWERS)), base, np.uint64)
            values[0] = 1
            np.cumprod(values, dtype=np.uint64, out=values)
            if n >= _KEPT_POWERS:
                found.append(values)
                continue
            _powers[base] = values
        found.append(_powers[base][: n + 1])
    return tuple(found)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class PrefixHashes:
    """Polynomial hashes of every range of a sequence of 64-bit values, after one cumulative sum.

    ``other`` takes another base. Modulo 2**64 some long regular sequences (of 1,024 values) have one hash for any base.
    """

    def __init__(self, values: np.ndarray, other: bool = False):
        self._up, down = powers(len(values), other)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * down[: len(values)], dtype=np.uint64, out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self._sums[ends] - self._sums[starts]) * self._up[ends]


def byte_hashes(buffer: np.ndarray, other: bool = False) -> PrefixHashes:
    return PrefixHashes(_OTHER_VALUES[buffer] if other else _BYTE_VALUES[buffer], other)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, one after the other, and the rows' offsets. A null row is empty."""
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or len(offsets) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of parts of at most ``limit`` bytes, or of one longer row."""
    if len(column) == 0:
        return
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for row, length in enumerate(lengths.tolist()):
        if row > first and held + length > limit:
            yield first, row - first
            first, held = row, 0
        held += length
    yield first, len(lengths) - first


class Words:
    """The words of a slice: byte ranges, the row of each, and each row's first word."""

    def __init__(self, buffer: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        inside = kind[buffer]
        starts, ends = inside.copy(), inside.copy()
        if len(buffer):
            fresh = offsets[:-1][np.diff(offsets) > 0]  # first bytes of rows
            starts[1:] &= ~inside[:-1]
            starts[fresh] = inside[fresh]
            ends[:-1] &= ~inside[1:]
            last = fresh[fresh > 0] - 1
            ends[last] = inside[last]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)  # rows + 1 entries
        self.counts = np.diff(self.first)
        self.rows = np.repeat(np.arange(len(self.counts)), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, buffer: np.ndarray) -> np.ndarray:
        """A hash of each word. Polynomials modulo 2**64 collide on long regular strings, so long words have a digest instead."""
        found = mix(byte_hashes(buffer)(self.starts, self.ends))
        for i in np.flatnonzero(self.ends - self.starts > LONG_WORD).tolist():
            digest = hashlib.blake2b(buffer[self.starts[i] : self.ends[i]], digest_size=8).digest()
            found[i] = int.from_bytes(digest, "little")
        return found

    def windows(self, size: int) -> np.ndarray:
        """The first words of all windows of ``size`` words that lie in one row."""
        if len(self) < size:
            return np.zeros(0, np.int64)
        at = np.arange(len(self) - size + 1)
        return at[self.rows[at] == self.rows[at + size - 1]]


def covered(starts: np.ndarray, length: int | np.ndarray, total: int) -> np.ndarray:
    """Which of ``total`` positions lie in a range of ``length`` from one of the starts."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0


def binaries(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from one buffer and its offsets in bytes."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)]
    ).cast(pa.binary())


def extend(
    df: DataFrame,
    inputs: list[Column],
    added: StructType,
    function: Callable[[list[pa.Array]], list[pa.Array]],
    keep: list[str] | None = None,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``df`` with columns that ``function`` derives from ``inputs``, a slice at a time; no shuffle.

    The first input is text or binary and bounds the slice. A column of ``df`` whose name is that of an
    added one is replaced. ``keep`` names the columns to carry along (default: all).
    """
    new = {name.lower() for name in added.names}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    marks = [f"__in{i}" for i in range(len(inputs))]
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(m) for c, m in zip(inputs, marks)])
    schema = StructType([source.schema[c] for c in kept] + list(added.fields))
    arrow = to_arrow_schema(schema)
    width, count = len(kept), len(inputs)

    def run(batches):
        for batch in batches:
            for first, rows in slices(batch.column(width), limit):
                part = batch.slice(first, rows)
                out = function([part.column(width + i) for i in range(count)])
                arrays = [part.column(i) for i in range(width)] + out
                yield pa.RecordBatch.from_arrays(
                    [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow
                )
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)
