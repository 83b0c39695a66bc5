"""Word passages that an earlier document has, removed by suffix automata of reference shards.

The reference is the corpus itself. Its passages are dealt to shards by anchor (see ``repeats``), so each shard is bounded
and a passage meets only the automaton that can contain it; sending every shard's automaton to every document would cost the
square of the corpus. In a shard, documents stream past in the order of their keys: the automaton of the passages of smaller
keys gives, for each word, the length of the longest match that ends there (matching statistics); maximal spans of matches of
the wanted length go; then the document's own passages extend the automaton.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tableflow.llm.batches import NOT_BLANK, PrefixHashes, Words, extend, mix, utf8
from tableflow.llm.repeats import PRESSED_SLICE, Items, gather, repeated_ranges, unpack, unpressed, with_ranges

LENGTH = 13
GRAM = 5


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: list) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)

    def _extend(self, last: int, symbol) -> int:
        following, link, length = self.next, self.link, self.length
        if symbol in following[last]:
            found = following[last][symbol]
            if length[found] == length[last] + 1:
                return found
            return self._clone(last, found, symbol)
        state = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in following[at]:
            following[at][symbol] = state
            at = link[at]
        if at >= 0:
            found = following[at][symbol]
            link[state] = found if length[found] == length[at] + 1 else self._clone(at, found, symbol)
        return state

    def _clone(self, at: int, found: int, symbol) -> int:
        following, link, length = self.next, self.link, self.length
        copy = len(following)
        following.append(dict(following[found]))
        length.append(length[at] + 1)
        link.append(link[found])
        link[found] = copy
        while at >= 0 and following[at].get(symbol) == found:
            following[at][symbol] = copy
            at = link[at]
        return copy

    def statistics(self, sequence: list) -> list[int]:
        """For each symbol the length of the longest match that ends with it."""
        following, link, length = self.next, self.link, self.length
        out, state, n = [], 0, 0
        for symbol in sequence:
            while state and symbol not in following[state]:
                state = link[state]
                n = length[state]
            if symbol in following[state]:
                state = following[state][symbol]
                n += 1
            out.append(n)
        return out


def items(column: pa.Array) -> Items:
    buffer, offsets = utf8(column)
    words = Words(buffer, offsets, NOT_BLANK)
    hashes = PrefixHashes(words.hashes(buffer))
    n = max(0, len(words) - GRAM + 1)
    at = np.arange(n)

    def content(begin, end):
        data, lengths = gather(buffer, words.starts[begin], words.ends[end - 1])
        return data.tobytes(), lengths

    def plain():
        edges = np.append(0, np.cumsum(words.ends - words.starts + 1))  # a blank after each word
        data = np.full(edges[-1], 0x20, np.uint8)
        inside = np.ones(len(data), bool)
        inside[edges[1:] - 1] = False
        data[inside] = gather(buffer, words.starts, words.ends)[0]
        return data, edges

    def lies(begin, end):
        return buffer, words.starts[begin], words.ends[end - 1]

    return Items(len(words), words.rows, words.first, mix(hashes(at, at + GRAM)), lambda s: mix(hashes(s, s + LENGTH)), content, plain, lies)


def spans(statistics: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal ranges of symbols covered by matches of at least ``length``."""
    out: list[tuple[int, int]] = []
    for end, n in enumerate(statistics, 1):
        if n >= length:
            if out and out[-1][1] >= end - length:
                out[-1] = (out[-1][0], end)
            else:
                out.append((end - length, end))
    return out


def _stream(units: list[tuple[int, int, int, bytes]], length: int, out: list) -> None:
    """Units of one anchor, (key, row, first word, bytes) in key order; ranges go to ``out``."""
    automaton, seen, waiting, current = None, {}, [], None
    distinct = len({u[3] for u in units}) > 1
    for key, row, offset, content in units:
        if key != current:
            for text in waiting:
                if text not in seen:
                    seen[text] = len(text)
                    if distinct:
                        automaton = automaton or SuffixAutomaton()
                        automaton.add(text)
            waiting, current = [], key
        words = tuple(content.split())
        if words in seen:
            out.append((row, offset, offset + len(words)))
        elif automaton is not None:
            out += [(row, offset + a, offset + b) for a, b in spans(automaton.statistics(words), length)]
        waiting.append(words)


def shard_of(length: int):
    def shard(columns: list[np.ndarray], content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        token, row, key, offset, _, sizes, _ = columns
        begin = np.cumsum(sizes) - sizes
        order = np.lexsort((offset, row, key, token))
        edges = np.append(np.flatnonzero(np.append(True, token[order][1:] != token[order][:-1])), len(order)) if len(order) else np.zeros(1, int)
        keys, rows, offsets = key.tolist(), row.tolist(), offset.tolist()
        starts, ends, order = begin.tolist(), (begin + sizes).tolist(), order.tolist()
        out: list[tuple[int, int, int]] = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            group = order[a:b]
            if keys[group[0]] != keys[group[-1]]:
                _stream([(keys[i], rows[i], offsets[i], content[starts[i] : ends[i]]) for i in group], length, out)
        found = np.array(out, np.int64).reshape(-1, 3)
        return found[:, 0], found[:, 1], found[:, 2]

    return shard


def _earlier(keys, least, copies):
    return keys > least


FIELDS = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType()), StructField("kept_sha256", StringType())])


def remove_earlier(documents: DataFrame, key: str, text: str, keep: list[str], with_text: bool = True, **options) -> DataFrame:
    """``keep`` of each row, with ``n_words``, ``n_removed``, ``kept`` (the remaining words, one blank between; null without ``with_text``)
    and ``kept_sha256``.

    Words are runs of bytes other than ASCII white space. A word goes if it lies in a window of 13 words of its row whose words also
    stand, in this order, in a row with a smaller key (an integer). Rows without key are later than all others and
    not than each other. Null text: no words.
    """
    ranges = repeated_ranges(documents, key, text, items, LENGTH, GRAM, shard_of(LENGTH), _earlier, **options)
    marked = with_ranges(documents, key, text, ranges, keep)

    def run(columns):
        buffer, offsets = utf8(unpressed(columns[0]))
        words = Words(buffer, offsets, NOT_BLANK)
        gone = unpack(columns[1].to_pylist(), words.first, len(words))
        total = np.append(0, np.cumsum(gone))
        texts, digests = [], []
        raw, removed = buffer.tobytes(), (total[words.first[1:]] - total[words.first[:-1]]).tolist()
        ends, first = offsets.tolist(), words.first.tolist()
        for row, count in enumerate(removed):
            own = raw[ends[row] : ends[row + 1]].split()
            if count:
                own = [w for w, g in zip(own, gone[first[row] : first[row + 1]].tolist()) if not g]
            data = b" ".join(own)
            digests.append(hashlib.sha256(data).hexdigest())
            if with_text:
                texts.append(data.decode("utf-8", "replace"))
        return [
            pa.array(words.counts, pa.int64()),
            pa.array(removed, pa.int64()),
            pa.array(texts, pa.string()) if with_text else pa.nulls(len(digests), pa.string()),
            pa.array(digests, pa.string()),
        ]

    return extend(marked, [F.col("__text"), F.col("ranges")], FIELDS, run, keep, PRESSED_SLICE)
