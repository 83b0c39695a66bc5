"""How five text filters overlap: what each removes in every order, alone, and again.

Filter E, equality with a smaller id's text, is decided in radix tries. Each task first inserts its texts into a trie of
its own: a terminal keeps the rows of its smallest id, every other row there is a known duplicate, and only the
kept ones travel, with their whole text. They are dealt by prefix ranges: prefixes that hold too much of the corpus are
replaced by longer ones, up to ``HEAD`` bytes. Where even such a head is too heavy (copies, a common opening), its rows are
dealt over several tasks first, and what those keep meets by the hash of its text. Texts are compared as whole bytes in the
tries; hashes only deal rows. The rest is a sum of failure masks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.llm.batches import SLICE_BYTES, slices, utf8
from tableflow.llm.shared import written

FILTERS = "ABCDE"
DUPLICATE = 1 << 4
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"
DEPTHS = (2, 4, 8, 16, 32, 64)  # prefix lengths that a range may have
HEAD = DEPTHS[-1]
HELD = 16 << 20  # bytes of texts in one trie
PENDING = 50_000  # decided rows that wait for the next batch
RANGE_BYTES = 256 << 20
_CAPITALS = bytes(range(0x41, 0x5B))
_CONTINUED = bytes(range(0x80, 0xC0))

_ROWS = pa.schema([("deal", pa.binary()), ("text", pa.binary()), ("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])
_DDL = "deal binary, text binary, id long, part string, mask int, n long"


def failures(text: bytes) -> int:
    """The bits of filters A to D that ``text`` fails."""
    words = text.split()  # bytes split at ASCII white space: words are [^\x20\x09-\x0D]+
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUED))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
        | (100 * capitals > MAX_CAPITALS * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


class Node:
    """A place in a trie; as a terminal it has the smallest id of its text, and the rows of that id by part."""

    __slots__ = ("edges", "least", "rows", "mask")

    def __init__(self):
        self.edges: dict[int, list] = {}
        self.least: int | None = None
        self.rows: dict | None = None
        self.mask = 0


def _common(label: bytes, text: bytes, start: int) -> int:
    """How many first bytes of ``label`` stand in ``text`` at ``start``; the first one does."""
    low, high = 1, min(len(label), len(text) - start)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if text.startswith(label[:middle], start) else (low, middle - 1)
    return low


class Trie:
    """A compressed trie of byte strings."""

    def __init__(self):
        self.root, self.held = Node(), 0

    def terminal(self, text: bytes) -> Node:
        """The node of ``text``, made if it is not there."""
        node, at, end = self.root, 0, len(text)
        while at < end:
            edge = node.edges.get(text[at])
            if edge is None:
                new = Node()
                node.edges[text[at]] = [text[at:], new]
                self.held += end - at
                return new
            label = edge[0]
            if not text.startswith(label, at):
                cut = _common(label, text, at)
                between = Node()
                between.edges[label[cut]] = [label[cut:], edge[1]]
                edge[0], edge[1] = label[:cut], between
            node, at = edge[1], at + len(edge[0])
        return node

    def terminals(self):
        """(text, node) of all texts, in no order."""
        waiting = [(b"", self.root)]
        while waiting:
            text, node = waiting.pop()
            if node.rows is not None:
                yield text, node
            waiting.extend((text + label, below) for label, below in node.edges.values())


class Settling:
    """Rows that go through one trie after the other; ``out`` holds what is decided."""

    def __init__(self, deal=None):
        self.trie, self.deal = Trie(), deal
        self.out: Counter = Counter()

    def add(self, text: bytes, key: int, part: str, n: int, mask: int | None) -> None:
        node = self.trie.terminal(text)
        if node.rows is None:
            node.least, node.rows, node.mask = key, {}, failures(text) if mask is None else mask
        if key > node.least:
            self.out[key, part, node.mask | DUPLICATE] += n
            return
        if key < node.least:
            for other, count in node.rows.items():
                self.out[node.least, other, node.mask | DUPLICATE] += count
            node.least, node.rows = key, {}
        node.rows[part] = node.rows.get(part, 0) + n

    def empty(self, final) -> list[tuple]:
        """The trie's kept rows, with their texts unless ``final(text)``; the trie is new after it."""
        found = []
        for text, node in self.trie.terminals():
            for part, n in node.rows.items():
                if final(text):
                    self.out[node.least, part, node.mask] += n
                else:
                    found.append((self.deal(text, node.least), text, node.least, part, node.mask, n))
        self.trie = Trie()
        return found

    def decided(self) -> list[tuple]:
        found = [(key.to_bytes(8, "little", signed=True) if key is not None else None, None, key, part, mask, n) for (key, part, mask), n in self.out.items()]
        self.out = Counter()
        return found


def _batches(rows: list[tuple]):
    """Arrow batches of the rows, each of at most a slice of text or one longer text."""
    first, held = 0, 0
    for i, row in enumerate(rows):
        size = len(row[1] or b"") + 64
        if i > first and held + size > 4 * SLICE_BYTES:
            yield _batch(rows[first:i])
            first, held = i, 0
        held += size
    if rows[first:]:
        yield _batch(rows[first:])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ROWS)], schema=_ROWS)


def _prefix(text: bytes, heavy: dict[int, set]) -> tuple[bytes, bool]:
    """The range of a text, and whether even its longest prefix is heavy."""
    for depth in DEPTHS:
        if text[:depth] not in heavy[depth]:
            return text[:depth], False
    return text[:HEAD], True


def _read(batches, read_masks: bool):
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for first, rows in slices(batch.column(at)):
            part = batch.slice(first, rows)
            buffer, offsets = utf8(part.column(at))
            data, ends = memoryview(buffer), offsets.tolist()
            keys, parts = part.column("id").to_pylist(), part.column("part").to_pylist()
            absent = part.column(at).is_null().to_pylist() if read_masks else [False] * rows
            masks = part.column("mask").to_pylist() if read_masks else [None] * rows
            counts = part.column("n").to_pylist() if read_masks else [1] * rows
            for i in range(rows):
                yield None if absent[i] else bytes(data[ends[i] : ends[i + 1]]), keys[i], parts[i], masks[i], counts[i]
        pa.default_memory_pool().release_unused()


def _heavy_prefixes(texts: DataFrame, pieces: int) -> tuple[dict[int, set], dict[bytes, int]]:
    """Per depth the prefixes that hold more than a share of all bytes, and how many tasks a heavy head needs.

    Counted over all texts. Of each depth at most ``total / share`` prefixes come to the driver.
    """
    size = F.octet_length("text") + F.lit(64)
    heads = written(texts.groupBy(F.substring("text", 1, HEAD).alias("head")).agg(F.sum(size).alias("size")), "heads")
    total = heads.agg(F.sum("size")).first()[0] or 0
    share = max(1, total / max(pieces, total / RANGE_BYTES)) if total else 1
    heavy: dict[int, set] = {}
    salts = {}
    for depth in DEPTHS:
        prefix = F.substring("head", 1, depth)
        found = heads.groupBy(prefix.alias("p")).agg(F.sum("size").alias("size")).where(F.col("size") > share).collect()
        heavy[depth] = {bytes(r["p"]) for r in found}
        if depth == HEAD:
            salts = {bytes(r["p"]): int(r["size"] // share) + 1 for r in found}
    return heavy, salts


def failure_masks(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """``id``, ``part``, ``mask``, ``n``: rows of an id and part that fail the same filters (bit 0 is A).

    A null text is empty, a null part the empty text. A row without a key is neither a duplicate nor makes one. Rows that share
    key and text are no duplicates of each other: neither has the smaller key.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
        F.col(key).cast("long").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
    )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heavy, salts = _heavy_prefixes(rows.select("text"), 4 * partitions)
    shared = spark.sparkContext.broadcast((heavy, salts))

    def own(batches):
        heavy, salts = shared.value

        def deal(content, key):
            prefix, hot = _prefix(content, heavy)
            return prefix + (zlib.crc32(key.to_bytes(8, "little", signed=True)) % salts[prefix]).to_bytes(4, "little") if hot else prefix

        settling, seen = Settling(deal), None
        for content, key, part, _, n in _read(batches, False):
            if key is None:
                settling.out[None, part, failures(content)] += n
            else:
                settling.add(content, key, part, n, None)
            if settling.trie.held > HELD:
                yield from _batches(settling.empty(lambda _: False))
            if len(settling.out) > PENDING:
                yield from _batches(settling.decided())
        yield from _batches(settling.empty(lambda _: False) + settling.decided())

    def meet(last):
        def run(batches):
            heavy, _ = shared.value
            final = (lambda _: True) if last else lambda content: not _prefix(content, heavy)[1]
            settling, before = Settling(lambda content, _: zlib.crc32(content).to_bytes(4, "little") + content[:HEAD]), None
            for content, key, part, mask, n in _read(batches, True):
                if content is None:
                    settling.out[key, part, mask] += n
                else:
                    # Texts come sorted, so a new one says that those before it are complete.
                    if settling.trie.held > HELD and content != before:
                        yield from _batches(settling.empty(final))
                    settling.add(content, key, part, n, mask)
                    before = content
                if len(settling.out) > PENDING:
                    yield from _batches(settling.decided())
            yield from _batches(settling.empty(final) + settling.decided())

        return run

    found = rows.mapInArrow(own, _DDL)
    for last in (False, True) if salts else (True,):
        found = found.repartition(partitions, "deal").sortWithinPartitions("text").mapInArrow(meet(last), _DDL)
    return found.select("id", "part", "mask", "n")


def _effects() -> list[tuple]:
    """(mask, order, step, kept, removed, redundant, unique, shapley) of one document with that mask."""
    found = []
    for mask in range(1 << len(FILTERS)):
        share = 120 // mask.bit_count() if mask else 0
        for order in permutations(FILTERS):
            gone = False
            for step, letter in enumerate(order, 1):
                fails = bool(mask >> FILTERS.index(letter) & 1)
                removed, redundant = fails and not gone, fails and gone
                gone = gone or fails
                unique = mask == 1 << FILTERS.index(letter)
                found.append((mask, "".join(order), step, int(not gone), int(removed), int(redundant), int(unique), share if fails else 0))
    return found


def audit(docs: DataFrame, key: str, text: str, part: str, labels: DataFrame) -> DataFrame:
    """A row per part, order of the five filters and step; no row without documents.

    ``labels`` has the key, ``quality`` and ``toxic``; a document with several labels is good, or toxic, if one says so.
    """
    masks = failure_masks(docs, key, text, part).groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    told = labels.groupBy(F.col(key).cast("long").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    counts = written(
        masks.join(told, "id", "left").groupBy("part", "mask").agg(
            F.sum("n").alias("n"),
            F.sum(F.coalesce("good", F.lit(0)) * F.col("n")).alias("good"),
            F.sum(F.coalesce("toxic", F.lit(0)) * F.col("n")).alias("toxic"),
        ),
        "masks",
    )
    ddl = "mask int, filter_order string, step int, kept int, removed int, redundant int, alone int, shapley int"
    effects = docs.sparkSession.createDataFrame(_effects(), ddl)

    def total(effect: str, of: str = "n"):
        return F.sum(F.col(effect) * F.col(of))

    return counts.join(effects, "mask").groupBy("part", "filter_order", "step").agg(
        total("kept").alias("kept"),
        total("removed").alias("removed"),
        total("redundant").alias("redundant"),
        total("alone").alias("unique_fails"),
        total("removed", "good").alias("good_lost"),
        total("removed", "toxic").alias("toxic_lost"),
        total("shapley").alias("shapley"),
    )
