"""Byte strings that occur more than once in a corpus, removed wherever they occur.

Units (see ``repeats``) of one anchor are aligned at it. A shard sorts their suffixes from the anchor on by merging runs:
a comparison finds the common extension of two suffixes by binary search over hashes of their prefixes, and the
bytes after it decide. Neighbours' common extensions, verified byte by byte, give blocks of units that agree to the right as
far as needed; within a block, two independent hashes of the bytes to the left (136 of them at most) find the units that share a window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tableflow.llm.batches import byte_hashes, extend, mix, utf8
from tableflow.llm.repeats import PART_BYTES, PRESSED_SLICE, Items, gather, repeated_ranges, unpack, unpressed, with_ranges

LENGTH = 200
GRAM = 64
HOT = PART_BYTES // 512  # units have at most 336 bytes, and equal ones meet once: those of one anchor stay below a shard's text


def items_of(gram: int):
    def items(column: pa.Array) -> Items:
        buffer, offsets = utf8(column)
        hashes = byte_hashes(buffer)
        n = max(0, len(buffer) - gram + 1)
        at = np.arange(n)
        grams = mix(hashes(at, at + gram))
        rows = np.repeat(np.arange(len(column)), np.diff(offsets))

        def content(begin, end):
            data, lengths = gather(buffer, begin, end)
            return data.tobytes(), lengths

        plain, lies = lambda: (buffer, np.arange(len(buffer) + 1)), lambda begin, end: (buffer, begin, end)
        return Items(len(buffer), rows, offsets, grams, _windows(hashes), content, plain, lies)

    return items


def _windows(hashes, length: int = LENGTH):
    return lambda at: mix(hashes(at, at + length))


class Suffixes:
    """Suffixes of units: where they begin and end in a buffer."""

    def __init__(self, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.buffer, self.begin, self.end = buffer, begin, end
        self.hashes = byte_hashes(buffer)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j, by binary search over prefix hashes."""
        low = np.zeros(len(i), np.int64)
        high = np.minimum(self.end[i] - self.begin[i], self.end[j] - self.begin[j])
        a, b = self.begin[i], self.begin[j]
        while True:
            wide = low < high
            if not wide.any():
                return low
            mid = (low + high + 1) // 2
            same = self.hashes(a, a + mid) == self.hashes(b, b + mid)
            low, high = np.where(wide & same, mid, low), np.where(wide & ~same, mid - 1, high)

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Suffix i comes before suffix j; an end comes before every byte, and equal suffixes go by number."""
        n = self.common(i, j)
        a, b = self.begin[i] + n, self.begin[j] + n
        last = len(self.buffer) - 1
        left = np.where(a < self.end[i], self.buffer[np.minimum(a, last)].astype(np.int64), -1)
        right = np.where(b < self.end[j], self.buffer[np.minimum(b, last)].astype(np.int64), -1)
        return np.where(left != right, left < right, i < j)

    def sort(self, groups: np.ndarray) -> np.ndarray:
        """Order of the suffixes within each group (groups are ascending), by a bottom-up mergesort.

        In every round each element finds, by binary search with ``less``, how many of its sibling run's elements come before it.
        """
        n = len(groups)
        first = np.searchsorted(groups, groups)
        size = np.searchsorted(groups, groups, "right") - first
        order, width = np.arange(n), 1
        while n and width < int(size.max()):
            place = np.arange(n) - first
            run = place // width
            sibling = first + (run ^ 1) * width
            stop = np.minimum(sibling + width, first + size)
            low, high = np.minimum(sibling, stop), stop
            start = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                before = self.less(order[mid], order[open_])
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            target = first + (run // 2) * 2 * width + place % width + (low - start)
            merged = np.empty(n, np.int64)
            merged[target] = order
            order, width = merged, 2 * width
        return order

    def verified(self, order: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Common extension of each suffix with the one before it in order (0 for the first of a group), compared as bytes."""
        out = np.zeros(len(order), np.int64)
        at = np.flatnonzero(groups[1:] == groups[:-1]) + 1
        if len(at):
            i, j = order[at - 1], order[at]
            n = self.common(i, j)
            edge = np.cumsum(n) - n
            inner = np.arange(int(n.sum()))
            left = self.buffer[np.repeat(self.begin[i] - edge, n) + inner]
            if not np.array_equal(left, self.buffer[np.repeat(self.begin[j] - edge, n) + inner]):
                raise ArithmeticError("two byte strings have one hash")
            out[at] = n
        return out


def shard_of(length: int):
    def shard(columns: list[np.ndarray], content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        token, row, _, offset, lead, sizes, digest = columns
        none = np.zeros(0, np.int64)
        if not len(token):
            return none, none, none
        buffer = np.frombuffer(content, np.uint8)
        begin = np.cumsum(sizes) - sizes
        whole = mix(digest.astype(np.uint64)) ^ mix(lead.astype(np.uint64))
        # Units with equal bytes and anchor place: all their windows repeat. One of them goes on.
        order = np.lexsort((whole, token))
        token, row, offset, lead, sizes, begin, whole = (x[order] for x in (token, row, offset, lead, sizes, begin, whole))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (whole[1:] != whole[:-1])
        unit = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        copies = np.bincount(unit)
        group = np.searchsorted(np.unique(token), token[at])
        alone = np.bincount(group)[group] == 1
        out_unit = [np.repeat(np.flatnonzero(copies > 1), 1)]
        starts, ends = [lead[at][copies > 1] * 0], [sizes[at][copies > 1]]
        some = np.flatnonzero(~alone)
        if len(some):
            # Only their bytes are hashed: hashes take many times the memory of the bytes, and copies are most of a shard.
            own, lengths = gather(buffer, begin[at][some], (begin + sizes)[at][some])
            z = np.cumsum(lengths)
            a = z - lengths
            middle = a + lead[at][some]
            suffixes = Suffixes(own, middle, z)
            groups = group[some]
            order = suffixes.sort(groups)
            lcp = suffixes.verified(order, groups)
            hashes, others = suffixes.hashes, byte_hashes(own, other=True)
            left, right = (middle - a)[order], (z - middle)[order]
            for back in range(int(left.max()) + 1):
                ahead = length - back
                fits = (left >= back) & (right >= ahead)
                if fits.sum() < 2:
                    continue
                block = np.cumsum(lcp < ahead)[fits]
                members = order[fits]
                before = middle[members] - back, middle[members]
                key = mix(hashes(*before)) ^ mix(mix(others(*before)) ^ block.astype(np.uint64))
                _, which, count = np.unique(key, return_inverse=True, return_counts=True)
                shared = members[count[which] > 1]
                out_unit.append(some[shared])
                starts.append(middle[shared] - back - a[shared])
                ends.append(starts[-1] + length)
        units, starts, ends = np.concatenate(out_unit), np.concatenate(starts), np.concatenate(ends)
        # Every row that has the unit gets its ranges.
        many = copies[units]
        edge = np.cumsum(many) - many
        member = np.repeat(at[units] - edge, many) + np.arange(int(many.sum()))
        return row[member], offset[member] + np.repeat(starts, many), offset[member] + np.repeat(ends, many)

    return shard


def _repeat(keys, least, copies):
    return copies > 1


FIELDS = StructType([StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [StructField("kept", StringType()), StructField("kept_sha256", StringType())])


def _to_characters(buffer: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone``, and the other bytes of every character of which one is gone."""
    head = (buffer & 0xC0) != 0x80
    head[offsets[:-1][np.diff(offsets) > 0]] = True
    character = np.cumsum(head) - 1
    return np.bincount(character, weights=gone)[character] > 0 if len(buffer) else gone


def remove_repeats(
    documents: DataFrame, key: str, text: str, keep: list[str], length: int = LENGTH, gram: int = GRAM, with_text: bool = True,
    whole_characters: bool = False, hot: int = HOT, **options,
) -> DataFrame:
    """``keep`` of each row, with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the remaining bytes as text; what is left of a cut
    character becomes U+FFFD; null for a null text, and without ``with_text``) and ``kept_sha256`` (of the remaining bytes).

    With ``whole_characters`` a character goes if one of its bytes does, so that what is kept is text.

    A byte goes if a ``length``-byte string that covers it also starts anywhere else, in the same row or another. Equal rows are
    each other's repeats. Null text: no bytes. The key is an integer; rows without key take part like others.
    """
    ranges = repeated_ranges(documents, key, text, items_of(gram), length, gram, shard_of(length), _repeat, hot=hot, whole=True, **options)
    marked = with_ranges(documents, key, text, ranges, keep)

    def run(columns):
        column = unpressed(columns[0])
        buffer, offsets = utf8(column)
        gone = unpack(columns[1].to_pylist(), offsets, len(buffer))
        if whole_characters:
            gone = _to_characters(buffer, offsets, gone)
        total = np.append(0, np.cumsum(gone))
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        fresh = offsets[:-1][np.diff(offsets) > 0]
        head[fresh] = gone[fresh]
        spans = np.append(0, np.cumsum(head))
        data, texts, digests = buffer[~gone].tobytes(), [], []
        left = offsets - total[offsets]
        absent = column.is_null().to_pylist()
        for a, b, none in zip(left[:-1].tolist(), left[1:].tolist(), absent):
            digests.append(hashlib.sha256(data[a:b]).hexdigest())
            if with_text:
                texts.append(None if none else data[a:b].decode("utf-8", "replace"))
        per_row = lambda sums: pa.array(sums[offsets[1:]] - sums[offsets[:-1]], pa.int64())
        return [
            pa.array(np.diff(offsets), pa.int64()),
            per_row(total),
            per_row(spans),
            pa.array(texts, pa.string()) if with_text else pa.nulls(len(digests), pa.string()),
            pa.array(digests, pa.string()),
        ]

    return extend(marked, [F.col("__text"), F.col("ranges")], FIELDS, run, keep, PRESSED_SLICE)


def without_repeats(documents: DataFrame, key: str, text: str, length: int = LENGTH) -> DataFrame:
    """``documents`` with repeats cut out of the texts, by whole characters, same columns; a null text stays null."""
    names = documents.columns
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    place = {name.lower(): f"c{i}" for i, name in enumerate(names)}
    id_, text_ = place[key.lower()], place[text.lower()]
    cut = remove_repeats(plain, id_, text_, [c for c in plain.columns if c != text_], length, whole_characters=True)
    return cut.select(*[F.col("kept" if c == text_ else c) for c in plain.columns]).toDF(*names)
