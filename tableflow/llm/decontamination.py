"""Benchmark passages in documents: a prefix-filtered join of item windows with texts.

An item's windows are its runs of 13 words, or all its words if it has fewer. A window is contained in a text only
if each of its shingles (3 words) is, so one shingle is prefix enough: the one that is rarest over all documents. A text
shingle that is the prefix of a window proposes one place for it; the place must leave room for the words before and
after (position and length bounds), and then all words are compared.

Items come in blocks of bounded size; documents pass each block's index in one narrow stage after the other, so no
text is shuffled however large the benchmark is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from tableflow.llm.batches import ALPHANUMERIC, LOWER, Words, binaries, extend, utf8
from tableflow.llm.shared import written

WINDOW = 13
SHINGLE = 3
BLOCK_BYTES = 2 << 20  # benchmark text in one broadcast block
CHAIN = 16  # blocks that one plan holds, before documents are written with their marks
PAIRS = 1 << 20  # proposed places that are looked at together
_LOWER = np.frombuffer(LOWER, np.uint8)
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _words(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of a slice, their hashes, and the lower-case bytes."""
    buffer, offsets = utf8(column)
    buffer = _LOWER[buffer]
    words = Words(buffer, offsets, ALPHANUMERIC)
    return words, words.hashes(buffer), buffer


def _spelled(words: Words, buffer: np.ndarray) -> list[bytes]:
    raw = buffer.tobytes()
    return [raw[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())]


def _shingles(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Keys of the shingles that begin at ``starts``."""
    key = np.zeros(len(starts), np.uint64)
    for i in range(size):
        key += ids[starts + i].astype(np.uint64) * _FACTORS[i]
    return key


@dataclass
class Block:
    """Windows of a block of items; ``grams``: by shingle size, sorted keys and the windows' places in them."""

    vocabulary: np.ndarray  # word hashes, sorted; word number i + 1 is entry i
    spelling: list[bytes]  # the word of each entry
    exact: dict[bytes, int] | None  # word numbers, if two words share a hash
    ids: np.ndarray  # words of all items
    starts: np.ndarray  # of windows, in ids
    lengths: np.ndarray
    items: np.ndarray  # item of each window
    names: list[str | None]
    grams: dict[int, np.ndarray]
    postings: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # first posting of each key, window, place in it

    def numbers(self, words: Words, hashes: np.ndarray, buffer: np.ndarray) -> np.ndarray:
        """Word numbers of the block; 0 for a word whose hash no item's word has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        if self.exact is not None:
            return np.array([self.exact.get(w, 0) for w in _spelled(words, buffer)], np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def confirmed(self, ids: np.ndarray, words: Words, buffer: np.ndarray, window: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which of the windows' places hold the items' words, byte by byte, and not others of the same hash."""
        length = self.lengths[window]
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + length, -1)
        at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        wrong = np.zeros(len(words) + 1, np.int64)
        for i, a, b, number in zip(at.tolist(), words.starts[at].tolist(), words.ends[at].tolist(), ids[at].tolist()):
            wrong[i + 1] = buffer[a:b].tobytes() != self.spelling[number - 1]
        wrong = np.cumsum(wrong)
        return wrong[start + length] == wrong[start]

    def found(self, ids: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in a slice, and the number there of a shingle of this size."""
        keys = self.grams[size]
        n = len(ids) - size + 1
        if n <= 0 or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        good = rows[:n] == rows[size - 1 :]
        for i in range(size):
            good &= ids[i : n + i] > 0
        at = np.flatnonzero(good)
        key = _shingles(ids, at, size)
        number = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        same = keys[number] == key
        return at[same], number[same]


def make_block(rows: list, window: int, shingle: int) -> Block:
    """Index of (name, text) rows, without postings yet."""
    words, hashes, buffer = _words(pa.array([r[1] for r in rows], pa.string()))
    spelled = _spelled(words, buffer)
    numbers: dict[bytes, int] = {}
    hash_of: dict[bytes, int] = dict(zip(spelled, hashes.tolist()))
    for word in sorted(hash_of, key=hash_of.__getitem__):
        numbers[word] = len(numbers) + 1
    vocabulary = np.array([hash_of[word] for word in numbers], np.uint64)
    ids = np.array([numbers[word] for word in spelled], np.int64)
    exact = numbers if len(np.unique(vocabulary)) < len(vocabulary) else None
    starts, lengths, items = [], [], []
    for item, (first, count) in enumerate(zip(words.first[:-1].tolist(), words.counts.tolist())):
        length = min(window, count)
        for start in range(first, first + count - length + 1) if count else ():
            starts.append(start)
            lengths.append(length)
            items.append(item)
    block = Block(vocabulary, list(numbers), exact, ids, np.array(starts, np.int64), np.array(lengths, np.int64), np.array(items, np.int64), [r[0] for r in rows], {}, {})
    for size in range(1, shingle + 1):
        own = block.starts[np.minimum(block.lengths, shingle) == size]
        span = block.lengths[np.minimum(block.lengths, shingle) == size]
        places = np.concatenate([s + np.arange(n - size + 1) for s, n in zip(own, span)]) if len(own) else np.zeros(0, np.int64)
        block.grams[size] = np.unique(_shingles(ids, places, size))
    return block


def add_postings(block: Block, frequencies: dict[int, np.ndarray], shingle: int) -> None:
    """The prefix of each window: its rarest shingle, the first of equally rare ones."""
    sizes = np.minimum(block.lengths, shingle)
    for size, keys in block.grams.items():
        which = np.flatnonzero(sizes == size)
        numbers, places = [], []
        for window in which.tolist():
            at = block.starts[window] + np.arange(block.lengths[window] - size + 1)
            number = np.searchsorted(keys, _shingles(block.ids, at, size))
            place = int(np.argmin(frequencies[size][number]))
            numbers.append(int(number[place]))
            places.append(place)
        order = np.argsort(numbers, kind="stable") if numbers else np.zeros(0, np.int64)
        numbers = np.array(numbers, np.int64)[order]
        first = np.searchsorted(numbers, np.arange(len(keys) + 1))
        block.postings[size] = (first, which[order], np.array(places, np.int64)[order])


def _matches(block: Block, ids: np.ndarray, words: Words):
    """Verified (window, first word) pairs of a slice."""
    for size, (first, windows, places) in block.postings.items():
        at, number = block.found(ids, words.rows, size)
        counts = first[number + 1] - first[number]
        at, number, counts = at[counts > 0], number[counts > 0], counts[counts > 0]
        edges = np.append(0, np.cumsum(counts))
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + PAIRS, "right")) - 1)
            n = counts[begin:end]
            posting = np.repeat(first[number[begin:end]] - (edges[begin:end] - edges[begin]), n) + np.arange(int(n.sum()))
            window = windows[posting]
            row = np.repeat(words.rows[at[begin:end]], n)
            start = np.repeat(at[begin:end], n) - places[posting]
            fits = (start >= words.first[row]) & (start + block.lengths[window] <= words.first[row + 1])
            window, start = window[fits], start[fits]
            for i in range(int(block.lengths.max(initial=0))):
                long = i < block.lengths[window]
                same = ~long
                same[long] = ids[start[long] + i] == block.ids[block.starts[window[long]] + i]
                window, start = window[same], start[same]
            yield window, start
            begin = end


FIELDS = StructType(
    [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("hit_items", ArrayType(StringType())), StructField("hit_ranges", BinaryType())]
)


def _mark(df: DataFrame, text: str, shared, keep: list[str] | None, more: bool) -> DataFrame:
    """One block's pass: hit words and items, together with those of the blocks before."""

    def run(columns):
        block = shared.value
        words, hashes, buffer = _words(columns[0])
        ids = block.numbers(words, hashes, buffer)
        hit = np.zeros(len(words) + 1, np.int64)
        items = [set(x or ()) for x in columns[2].to_pylist()] if more else [set() for _ in range(len(columns[0]))]
        if more:
            for row, ranges in enumerate(columns[1].to_pylist()):
                pairs = np.frombuffer(ranges or b"", np.int64)
                np.add.at(hit, words.first[row] + pairs[0::2], 1)
                np.add.at(hit, words.first[row] + pairs[1::2], -1)
        for window, start in _matches(block, ids, words):
            sure = block.confirmed(ids, words, buffer, window, start)
            window, start = window[sure], start[sure]
            np.add.at(hit, start, 1)
            np.add.at(hit, start + block.lengths[window], -1)
            pairs = np.unique(words.rows[start] * len(block.names) + block.items[window])
            for pair in pairs.tolist():
                if (name := block.names[pair % len(block.names)]) is not None:
                    items[pair // len(block.names)].add(name)
        inside = np.cumsum(hit[:-1]) > 0
        total = np.append(0, np.cumsum(inside))
        n_hit = total[words.first[1:]] - total[words.first[:-1]]
        packed, ends = [], [0]
        for row in range(len(n_hit)):
            if n_hit[row]:
                part = np.diff(inside[words.first[row] : words.first[row + 1]].astype(np.int8), prepend=0, append=0)
                packed.append(np.stack([np.flatnonzero(part > 0), np.flatnonzero(part < 0)], 1).astype(np.int64).tobytes())
            ends.append(ends[-1] + (len(packed[-1]) if n_hit[row] else 0))
        return [
            pa.array(words.counts, pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            binaries(b"".join(packed), np.array(ends)),
        ]

    inputs = [F.col(text)] + ([F.col("hit_ranges"), F.col("hit_items")] if more else [])
    return extend(df, inputs, FIELDS, run, keep)


def _frequencies(documents: DataFrame, text: str, shared, grams: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How many documents have each shingle of a block; at most one row per shingle and task is shuffled."""

    def run(batches):
        from tableflow.llm.batches import slices

        block = shared.value
        counts = {size: np.zeros(len(keys), np.int64) for size, keys in block.grams.items()}
        for batch in batches:
            for first, rows in slices(batch.column(0)):
                words, hashes, buffer = _words(batch.column(0).slice(first, rows))
                ids = block.numbers(words, hashes, buffer)
                for size, keys in block.grams.items():
                    at, number = block.found(ids, words.rows, size)
                    pairs = np.unique(words.rows[at] * max(1, len(keys)) + number)
                    counts[size] += np.bincount(pairs % max(1, len(keys)), minlength=len(keys))[: len(keys)]
        for size, count in counts.items():
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), size), pa.int32()), pa.array(some, pa.int64()), pa.array(count[some], pa.int64())], names=["size", "number", "n"]
            )

    rows = documents.select(F.col(text)).mapInArrow(run, "size int, number long, n long").groupBy("size", "number").agg(F.sum("n").alias("n")).collect()
    out = {size: np.zeros(len(keys), np.int64) for size, keys in grams.items()}
    for size, number, n in rows:
        out[size][number] = n
    return out


def benchmark_hits(
    documents: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str,
    keep: list[str] | None = None, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``documents`` with ``n_words``, ``n_hit`` (words in an occurrence of a window), ``hit_items`` (names of the items
    with one, distinct and sorted as text) and ``hit_ranges`` (packed word ranges).

    Words are lower-case runs of ASCII letters, digits and non-ASCII characters. Null or empty texts have no words, and
    items without words take no part; rows of one name count as one item, and an item without a name hits words but is not
    listed. Words that match are compared byte by byte. The driver holds one block of items and its shingle counts at a time.
    """
    spark = documents.sparkSession
    # Each item once: repeated rows would all fall into one block.
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).cast("string").alias("name"), F.col(item_text).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    marked, more = documents, False
    kept = list(documents.columns if keep is None else keep)
    for number in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == number).collect()
        block = make_block([tuple(r) for r in rows], window, shingle)
        add_postings(block, _frequencies(documents, text, spark.sparkContext.broadcast(block), block.grams), shingle)
        last = number == blocks - 1
        carried = kept if last else list(dict.fromkeys([*kept, text]))
        marked = _mark(marked, text, spark.sparkContext.broadcast(block), carried, more)
        more = True
        if number % CHAIN == CHAIN - 1 and not last:
            marked = written(marked, "marked")
    return marked


def contaminated(words: str = "n_words", hit: str = "n_hit"):
    """At least one twentieth of the words is hit."""
    return (F.col(hit) > 0) & (20 * F.col(hit) >= F.col(words))


def decontaminate(documents: DataFrame, text: str, benchmark: DataFrame, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``documents`` without contaminated rows, same columns."""
    names = documents.columns
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    at = next(i for i, name in enumerate(names) if name.lower() == text.lower())
    hits = benchmark_hits(plain, f"c{at}", benchmark, item, item_text)
    return hits.where(~contaminated()).select(*plain.columns).toDF(*names)
