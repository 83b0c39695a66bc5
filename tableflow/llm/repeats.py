"""Where texts repeat, at scale: sampled places (anchors) bring equal windows together.

A window is a fixed number of consecutive items (words or bytes). Its anchor is the gram in it whose hash is least, the
first of equal ones, so equal windows have equal anchors at equal places. A run of windows with one anchor, together with
the text that they span, is a unit. The steps:

1. Count anchors in a table of fixed size (16 MB), over all documents; where keys decide nothing, in 32 times as many slots, of
   which the driver gets a bit (more than one) and the few that reach ``hot``.
2. Deal (anchor, row) pairs by anchor and keep anchors that occur more than once. Where keys decide nothing the pairs have a
   digest of their unit: equal units go as a whole, and only one of them sends its bytes, if the anchor has other units.
3. Bring each row's kept anchors to its text, and deal the units of these anchors by anchor to shards. A
   shard compares the units of each anchor (this is the operator's own part). A task sends the bytes of equal units once, told
   by a cryptographic digest (64 bits of BLAKE2, looked up within one anchor and length); their other places are a few numbers.
4. Anchors with ``HOT`` occurrences, counted one by one where the table reaches ``HOT``, may be those of very common passages.
   Their windows travel one by one with their bytes, dealt by hash; a slice of a task sends equal windows once. So no
   shard holds all occurrences of a common passage. Windows are equal if their bytes are; a second table of counts keeps those
   back that occur once.

Rows are known by a 64-bit hash of key and text; two rows with one hash but different keys fail the job. Equal rows
count as often as they occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tableflow.llm.batches import SLICE_BYTES, binaries, extend, mix, slices
from tableflow.llm.shared import written

TABLE_BITS = 22
SLOT_BITS = 27  # 16 MB as a bitmap
HOT = 512
PART_BYTES = 4 << 20  # text for one shard
PRESSED_SLICE = SLICE_BYTES // 3
_DONE = 1 << 40  # parts from here on hold results
COMMON_BITS = 22  # at most so many anchors are common (32 MB); beyond that HOT grows with the corpus
HELD_BYTES = 8 << 20  # units that a task holds before it deals them to parts
CHUNK = 1 << 14  # windows whose bytes are held at once
SENT = 1 << 19  # digests of sent units that a task remembers
COUNTED = 1 << 20  # hashes that a task holds before it sends their slots
_GOES, _SENT = 1, 2  # what becomes of a unit: it goes as a whole, it is sent and compared


@dataclass
class Items:
    """The items of a slice, as an operator sees them."""

    count: int
    rows: np.ndarray  # row of each item
    first: np.ndarray  # first item of each row, rows + 1 entries
    grams: np.ndarray  # hash of the gram at each item; only those inside a window are looked at
    window: Callable[[np.ndarray], np.ndarray]  # hashes of the windows at these items
    content: Callable[[np.ndarray, np.ndarray], tuple[bytes, np.ndarray]]  # bytes of item ranges, and their lengths
    plain: Callable[[], tuple[np.ndarray, np.ndarray]]  # bytes of all items, equal for equal items, and where each begins, items + 1 entries
    lies: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]  # the slice's bytes, and where item ranges begin and end there


@dataclass
class Anchors:
    """Runs of windows with one anchor: hash, row, first and last window."""

    hashes: np.ndarray
    rows: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    place: np.ndarray  # item at which the anchor's gram begins


def anchors_of(items: Items, length: int, gram: int) -> Anchors:
    """Every window of ``length`` items of one row belongs to one run."""
    n = items.count - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return Anchors(np.zeros(0, np.uint64), none, none, none, none)
    starts = np.flatnonzero(items.rows[:n] == items.rows[length - 1 :])
    if not len(starts):
        return Anchors(np.zeros(0, np.uint64), none, none, none, none)
    # The hash's upper half, then the position: the least is the first gram of least hash.
    value = (items.grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(items.grams), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        value = np.minimum(value[:-have], value[have:])
        have *= 2
    if have < width:
        value = np.minimum(value[: len(value) - (width - have)], value[width - have :])
    place = (value[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(starts)) - 1
    return Anchors(items.grams[place[at]], items.rows[starts[at]], starts[at], starts[last], place[at])


_PACKED = "part long, a binary, b binary, c binary, d binary, e binary, f binary, g binary, content binary"
_NAMES = [f.split()[0] for f in _PACKED.split(", ")]


def _rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(text).alias("text"), F.col(key).cast("bigint").alias("key"), F.xxhash64(key, text).alias("row"))


def _pressed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the text column compressed: texts are what these joins move, and a row is its own block."""

    def press(columns):
        packer = zstandard.ZstdCompressor(level=3)
        return [pa.array([None if t is None else packer.compress(t) for t in columns[0].cast(pa.binary()).to_pylist()], pa.binary())]

    return extend(df, [F.col(text)], StructType([StructField(text, BinaryType())]), press)


def unpressed(column: pa.Array) -> pa.Array:
    """The texts, as binary."""
    opener = zstandard.ZstdDecompressor()
    return pa.array([None if t is None else opener.decompress(t) for t in column.to_pylist()], pa.large_binary())


def _table(rows: DataFrame, found: Callable[[pa.Array], np.ndarray], bits: int) -> np.ndarray:
    """How many of the hashes that ``found`` has of each slice of texts fall into each slot."""
    width = min(1 << 16, 1 << bits)

    def count(batches):
        table = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for first, n in slices(batch.column(0)):
                at, times = np.unique(slot(found(batch.column(0).slice(first, n)), table), return_counts=True)
                table[at] += times.astype(np.uint32)
        numbers = [i for i, part in enumerate(table.reshape(-1, width)) if part.any()]
        kinds = [next(k for k, top in (("<u1", 256), ("<u2", 65536), ("<u4", 1 << 33)) if table.reshape(-1, width)[i].max() < top) for i in numbers]
        data = [table.reshape(-1, width)[i].astype(k).tobytes() for i, k in zip(numbers, kinds)]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(data, pa.binary())], names=["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                part = np.frombuffer(data, {width: "<u1", 2 * width: "<u2", 4 * width: "<u4"}[len(data)])
                sums[number] = sums.get(number, 0) + part.astype(np.int64)
        data = [np.minimum(v, 2**32 - 1).astype("<u4").tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(data, pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    table = np.zeros(1 << bits, np.uint32)
    for number, data in rows.select("text").mapInArrow(count, schema).repartition(16, "slice").mapInArrow(add, schema).collect():
        table[number * width : (number + 1) * width] = np.frombuffer(data, "<u4")
    return table


class Slots:
    """Some of a number of slots, a bit for each of them."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    @classmethod
    def of(cls, chosen: np.ndarray, count: int) -> Slots:
        packed = np.zeros(count // 8, np.uint8)
        np.bitwise_or.at(packed, chosen >> 3, np.uint8(1) << (chosen & 7).astype(np.uint8))
        return cls(packed)

    def __len__(self) -> int:
        return 8 * len(self.packed)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def any(self) -> bool:
        return bool(self.packed.any())


def _slots(rows: DataFrame, found: Callable[[pa.Array], np.ndarray], bits: int, hot: int) -> tuple[Slots, np.ndarray, np.ndarray, int]:
    """The slots that several of the hashes which ``found`` has of each slice of texts fall into, those that ``hot`` of them do, how many
    those have, and the number of all hashes. A task sends slots as steps to the next one, byte by byte: hardly more than a byte each."""
    count = 1 << bits
    width = max(8, count >> 6)

    def planes(values):
        return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()

    def values(data):
        return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()

    def sent(held):
        at, times = np.unique(np.concatenate(held), return_counts=True)
        names, begin = np.unique(at // width, return_index=True)
        edges, codec = np.append(begin, len(at)).tolist(), pa.Codec("zstd")
        data = [
            codec.compress(planes(np.diff(at[a:b], prepend=name * width)) + planes(times[a:b]), asbytes=True)
            for name, a, b in zip(names.tolist(), edges, edges[1:])
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int32()), pa.array(np.diff(edges), pa.int64()), pa.array(data, pa.binary())], names=["slice", "n", "data"]
        )

    def counted(batches):
        held, size = [], 0
        for batch in batches:
            for first, n in slices(batch.column(0)):
                held.append(_slot(found(batch.column(0).slice(first, n)), bits))
                size += len(held[-1])
                if size > COUNTED:
                    yield sent(held)
                    held, size = [], 0
        if size:
            yield sent(held)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        totals: dict[int, int] = {}
        codec = pa.Codec("zstd")
        for batch in batches:
            for number, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                data = codec.decompress(data, 8 * n, asbytes=True)
                at, times = np.cumsum(values(data[: 4 * n]), dtype=np.int64), values(data[4 * n :]).astype(np.int64)
                part = sums.setdefault(number, np.zeros(width, np.uint32))
                part[at] = np.minimum(part[at] + times, 2**32 - 1)
                totals[number] = totals.get(number, 0) + int(times.sum())
        full = {number: np.flatnonzero(part >= hot) for number, part in sums.items()}
        columns = [
            pa.array(list(sums), pa.int32()),
            pa.array([codec.compress(np.packbits(part > 1, bitorder="little").tobytes(), asbytes=True) for part in sums.values()], pa.binary()),
            pa.array([(full[number] + number * width).tobytes() for number in sums], pa.binary()),
            pa.array([part[full[number]].astype(np.int64).tobytes() for number, part in sums.items()], pa.binary()),
            pa.array([totals[number] for number in sums], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["slice", "several", "hot", "times", "total"])

    packed, full, often, total = np.zeros(count // 8, np.uint8), [], [], 0
    sums = rows.select("text").mapInArrow(counted, "slice int, n long, data binary").repartition(16, "slice")
    for number, several, hots, times, n in sums.mapInArrow(add, "slice int, several binary, hot binary, times binary, total long").collect():
        several = pa.Codec("zstd").decompress(several, width // 8, asbytes=True)
        packed[number * width // 8 : (number + 1) * width // 8] = np.frombuffer(several, np.uint8)
        full.append(np.frombuffer(hots, np.int64))
        often.append(np.frombuffer(times, np.int64))
        total += n
    none = [np.zeros(0, np.int64)]
    return Slots(packed), np.concatenate(none + full), np.concatenate(none + often), total


def slot(hashes: np.ndarray, table: np.ndarray | Slots) -> np.ndarray:
    return _slot(hashes, int(np.log2(len(table))))


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    # Mixed again: anchors are least hashes, so their own upper bits would leave most slots empty.
    return (mix(hashes) >> np.uint64(64 - bits)).astype(np.int64)


def among(hashes: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the hashes are in an ascending array."""
    if not len(ordered):
        return np.zeros(len(hashes), bool)
    return ordered[np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)] == hashes


def common_anchors(rows: DataFrame, items, length: int, gram: int, table: np.ndarray | Slots, parts: int, hot: int) -> np.ndarray:
    """Ascending hashes of the anchors that occur ``hot`` times: counted each, as a slot of the table (or of those given) holds more of them
    the larger the corpus."""
    reached = table if isinstance(table, Slots) else table >= hot
    if not reached.any():
        return np.zeros(0, np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(reached)

    def count(batches):
        def packed():
            token, times = np.unique(np.concatenate(held), return_counts=True)
            part = (mix(token) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            return _pack(part[order], [token[order], times[order].astype(np.int64)])

        full, held, size = shared.value, [], 0
        for batch in batches:
            for first, n in slices(batch.column(0)):
                hashes = anchors_of(items(batch.column(0).slice(first, n)), length, gram).hashes
                held.append(hashes[full[slot(hashes, full)]])
                size += len(held[-1])
                if size > 1 << 20:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    def add(group: pa.Table) -> pa.Table:
        token, which = np.unique(_column(group, "a", np.uint64), return_inverse=True)
        times = np.zeros(len(token), np.int64)
        np.add.at(times, which, _column(group, "b", np.int64))
        return pa.table({"tokens": pa.array([token[times >= hot].tobytes()], pa.binary())})

    found = rows.select("text").mapInArrow(count, _PACKED).groupBy("part").applyInArrow(add, "tokens binary").collect()
    shared.unpersist()
    return np.sort(np.frombuffer(b"".join(r["tokens"] for r in found), np.uint64))


def _windows_of(found: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all runs, and the run of each."""
    count = found.end - found.begin + 1
    edge = np.cumsum(count) - count
    return np.repeat(found.begin - edge, count) + np.arange(int(count.sum())), np.repeat(np.arange(len(count)), count)


def _only(found: Anchors, keep: np.ndarray) -> Anchors:
    return Anchors(*(x[keep] for x in (found.hashes, found.rows, found.begin, found.end, found.place)))


def gather(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ranges, one after the other, and their lengths."""
    lengths = end - begin
    edge = np.cumsum(lengths) - lengths
    return buffer[np.repeat(begin - edge, lengths) + np.arange(int(lengths.sum()))], lengths


def alike(hashes: np.ndarray, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each byte range, the same for equal bytes only (0 up to the largest, none left out); equal ranges have equal hashes."""
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    head = first[which]
    same = end - begin == (end - begin)[head]
    at = np.flatnonzero(same & (head != np.arange(len(head))))
    for i in range(0, len(at), CHUNK):
        part = at[i : i + CHUNK]
        left, lengths = gather(buffer, begin[part], end[part])
        differ = np.flatnonzero(left != gather(buffer, begin[head[part]], end[head[part]])[0])
        same[part[np.searchsorted(np.cumsum(lengths), differ, "right")]] = False
    names: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():  # one hash, other bytes than the first
        which[i] = names.setdefault(buffer[begin[i] : end[i]].tobytes(), len(first) + len(names))
    return which


def _pack(part: np.ndarray, columns: list[np.ndarray], contents: tuple[bytes, np.ndarray] | None = None) -> pa.RecordBatch:
    """Rows of equal part as one row of packed columns; contents (bytes, lengths) must be in order of part."""
    names, begin = np.unique(part, return_index=True)
    edges = np.append(begin, len(part))
    codec = pa.Codec("zstd")
    out = [pa.array(names, pa.int64())]
    for i, column in enumerate(columns):
        data = np.ascontiguousarray(column).tobytes()
        if contents is None or i < 2:
            out.append(binaries(data, edges * column.itemsize))
        else:  # small numbers
            at = (edges * column.itemsize).tolist()
            out.append(pa.array([codec.compress(data[a:b], asbytes=True) for a, b in zip(at, at[1:])], pa.binary()))
    while len(out) < len(_NAMES) - 1:
        out.append(pa.nulls(len(names), pa.binary()))
    if contents is None:
        out.append(pa.nulls(len(names), pa.binary()))
    else:
        ends = np.append(0, np.cumsum(contents[1]))[edges]
        parts = [codec.compress(contents[0][a:b], asbytes=True) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        out.append(pa.array(parts, pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=_NAMES)


def _column(group: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(group[name].to_pylist()), kind)


def _opened(group: pa.Table, kinds: list) -> tuple[list[np.ndarray], bytes]:
    """Columns and contents as ``_pack`` had them; the last column has the contents' lengths, negative where none was sent."""
    codec = pa.Codec("zstd")
    sizes = [len(x) // 8 for x in group["a"].to_pylist()]
    columns = [_column(group, "a", kinds[0]), _column(group, "b", kinds[1])]
    for name, kind in zip("cdefg", map(np.dtype, kinds[2:])):
        cells = zip(group[name].to_pylist(), sizes)
        data = b"".join(codec.decompress(x, n * kind.itemsize, asbytes=True) for x, n in cells)
        columns.append(np.frombuffer(data, kind).astype(np.int64))
    ends = np.cumsum(sizes)
    totals = [int(np.maximum(columns[-1][e - s : e], 0).sum()) for s, e in zip(sizes, ends)]
    return columns, b"".join(codec.decompress(x, n, asbytes=True) for x, n in zip(group["content"].to_pylist(), totals))


def _digests(data: bytes, lengths: np.ndarray, token: np.ndarray, sent: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """A digest of each unit's bytes, and which units' bytes this task has not sent yet; ``sent`` gets those."""
    ends = np.cumsum(lengths).tolist()
    digest, fresh, at = [], [], 0
    for end, anchor in zip(ends, token.tolist()):
        own = int.from_bytes(hashlib.blake2b(data[at:end], digest_size=8).digest(), "little", signed=True)
        name = own ^ anchor
        digest.append(own)
        fresh.append(name not in sent)
        sent.add(name)
        at = end
    return np.array(digest, np.int64), np.array(fresh, bool)


def _digests_at(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A digest of each byte range."""
    view = memoryview(buffer)
    return np.frombuffer(b"".join(hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(begin.tolist(), end.tolist())), "<i8")


def _whole_units(columns: list[np.ndarray], content: bytes) -> tuple[list[np.ndarray], bytes]:
    """The units of a shard with all their bytes: those sent without get them from a unit of the same anchor and digest."""
    token, row, owner, offset, lead, digest, told = columns
    sizes = np.abs(told)
    ends = np.cumsum(np.maximum(told, 0))
    order = np.lexsort((told <= 0, digest, token))  # of equal units, one with bytes first
    new = np.ones(len(order), bool)
    new[1:] = (token[order][1:] != token[order][:-1]) | (digest[order][1:] != digest[order][:-1])
    source = np.empty(len(order), np.int64)
    source[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    if (told[source] != sizes).any():
        raise ArithmeticError("two units of different lengths have one digest, or a unit's bytes are missing")
    begin, stop = (ends - np.maximum(told, 0))[source].tolist(), ends[source].tolist()
    return [token, row, owner, offset, lead, sizes, digest], b"".join([content[a:b] for a, b in zip(begin, stop)])


def _names(token: np.ndarray, digest: np.ndarray) -> np.ndarray:
    return mix(token ^ mix(digest.view(np.uint64)))


def _fates(token: np.ndarray, row: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, rows and fates of the units of some anchors."""
    order = np.lexsort((row, digest, token))
    token, row, digest = token[order], row[order], digest[order]
    anchor, unit = np.ones(len(order), bool), np.ones(len(order), bool)
    anchor[1:] = token[1:] != token[:-1]
    unit[1:] = anchor[1:] | (digest[1:] != digest[:-1])
    of_anchor, of_unit = np.cumsum(anchor) - 1, np.cumsum(unit) - 1
    several = np.bincount(of_unit)[of_unit] > 1
    differ = np.bincount(of_anchor[unit])[of_anchor] > 1
    first = row == row[np.flatnonzero(unit)][of_unit]
    return _names(token, digest), row, (several * _GOES | (differ & first) * _SENT).astype(np.uint8)


def _repeated(rows: DataFrame, items, length: int, gram: int, shared, parts: int, whole: bool = False) -> DataFrame:
    """``row``, the packed hashes of its anchors that occur more than once (or may do so, if hot), and for each of them a byte: ``_SENT``
    if its units are to be compared. With ``whole``, units of anchors that are not hot are named one by one, and ``_GOES`` is for those
    that occur more than once; one of equal ones is to be compared, if the anchor has other units."""

    def pairs(batches):
        several, common, _ = shared.value
        for batch in batches:
            for first, n in slices(batch.column(0)):
                own = items(batch.column(0).slice(first, n))
                found = anchors_of(own, length, gram)
                found = _only(found, several[slot(found.hashes, several)])
                token, row = found.hashes, batch.column(2).slice(first, n).to_numpy(zero_copy_only=False)[found.rows]
                often = among(token, common)
                columns = [token, row]
                if whole:
                    digest = np.zeros(len(token), np.int64)
                    digest[~often] = _digests_at(*own.lies(found.begin[~often], found.end[~often] + length))
                    columns.append(digest)
                part = (np.where(often, mix(token ^ mix(row.view(np.uint64))), mix(token)) % np.uint64(parts)).astype(np.int64)
                part[often] = -1 - part[often]
                order = np.argsort(part, kind="stable")
                if len(order):
                    yield _pack(part[order], [x[order] for x in columns])

    def many(group: pa.Table) -> pa.Table:
        token, row = _column(group, "a", np.uint64), _column(group, "b", np.int64)
        fate = np.full(len(token), _SENT, np.uint8)
        if group["part"][0].as_py() >= 0:
            _, which, count = np.unique(token, return_inverse=True, return_counts=True)
            keep = count[which] > 1
            token, row = token[keep], row[keep]
            fate = fate[keep]
            if whole:
                token, row, fate = _fates(token, row, _column(group, "c", np.int64)[keep])
        # Each pair once: equal rows share a hash, and each of them gets this list.
        order = np.lexsort((token, row))
        token, row, fate = token[order], row[order], fate[order]
        new = np.ones(len(order), bool)
        new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
        token, row, fate = token[new], row[new], fate[new]
        names, begin = np.unique(row, return_index=True)
        edges = np.append(begin, len(row))
        return pa.table({"row": names, "anchors": binaries(token.tobytes(), edges * 8), "fates": binaries(fate.tobytes(), edges)})

    found = rows.mapInArrow(pairs, _PACKED).groupBy("part").applyInArrow(many, "row long, anchors binary, fates binary")
    lists = found.groupBy("row").agg(F.collect_list(F.struct("anchors", "fates")).alias("lists"))
    return lists.select("row", F.col("lists.anchors").alias("anchors"), F.col("lists.fates").alias("fates"))


def repeated_ranges(
    documents: DataFrame, key: str, text: str, items: Callable[[pa.Array], Items], length: int, gram: int,
    shard: Callable, decide: Callable, bits: int = TABLE_BITS, hot: int = HOT, part_bytes: int = PART_BYTES, whole: bool = False,
) -> DataFrame:
    """``row`` and ``ranges``: packed (start, end) item ranges to remove, for the rows that have any.

    ``shard(units, contents)`` gets one shard's units as columns sorted by anchor (anchor, row, key, offset, place of the anchor, bytes,
    digest of the bytes), and returns rows of (row, start, end).
    ``decide(keys, least, copies)`` tells which of the windows of common anchors are to be removed: ``least`` is the
    least key of a row with the same window, ``copies`` how often it occurs. ``whole``: all of several equal units go, whatever
    their keys.
    """
    source = _rows(documents, key, text)
    hashes = lambda column: anchors_of(items(column), length, gram).hashes
    total = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(64, total // part_bytes)
    if whole:
        several, reached, times, n = _slots(source, hashes, SLOT_BITS, max(hot, 2))
        hot = max(hot, 2, -(-n >> COMMON_BITS))
        reached = Slots.of(reached[times >= hot], len(several))
    else:
        reached = _table(source, hashes, bits)
        several = reached > 1
        hot = max(hot, 2, -(-int(reached.sum(dtype=np.int64)) >> COMMON_BITS))
    common = common_anchors(source, items, length, gram, reached, parts, hot)

    def common_windows(column):
        own = items(column)
        found = anchors_of(own, length, gram)
        return own.window(_windows_of(_only(found, among(found.hashes, listed.value)))[0])

    listed = documents.sparkSession.sparkContext.broadcast(common)
    again = _table(source, common_windows, bits) > 1 if len(common) else None
    shared = documents.sparkSession.sparkContext.broadcast((several, common, again))
    kept = written(_repeated(source, items, length, gram, shared, parts, whole), "anchors")

    def units(batches):
        _, common, again = shared.value
        sent: set[int] = set()
        held, size = [], 0
        for batch in batches:
            for first, n in slices(batch.column(0), PRESSED_SLICE):
                part = batch.slice(first, n)
                own = items(unpressed(part.column(0)))
                found = anchors_of(own, length, gram)
                lists = part.column(3).to_pylist()
                sizes = [sum(map(len, x)) // 8 for x in lists]
                wanted = np.frombuffer(b"".join(b for x in lists for b in x), np.uint64)
                fates = np.frombuffer(b"".join(b for x in part.column(4).to_pylist() for b in x), np.uint8)
                pairs = mix(wanted ^ mix(np.repeat(np.arange(n), sizes).astype(np.uint64)))
                order = np.argsort(pairs)
                pairs, fates = pairs[order], fates[order]
                name = found.hashes.copy()
                if whole:
                    cold = np.flatnonzero(~among(name, common))
                    name[cold] = _names(name[cold], _digests_at(*own.lies(found.begin[cold], found.end[cold] + length)))
                mine = mix(name ^ mix(found.rows.astype(np.uint64)))
                at = np.minimum(np.searchsorted(pairs, mine), max(0, len(pairs) - 1))
                keep = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)
                fate = np.zeros(len(mine), np.uint8)
                fate[keep] = fates[at[keep]]
                done = np.flatnonzero(fate & _GOES)
                if len(done):
                    row = part.column(2).to_numpy(zero_copy_only=False)[found.rows[done]]
                    base = own.first[found.rows[done]]
                    yield _settled(row, found.begin[done] - base, found.end[done] - base + length)
                found = _only(found, fate & _SENT > 0)
                token, local, begin, end, place = found.hashes, found.rows, found.begin, found.end, found.place
                row = part.column(2).to_numpy(zero_copy_only=False)[local]
                owner = part.column(1).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)[local]
                often = among(token, common)
                cold = np.flatnonzero(~often)
                if len(cold):
                    data, lengths = own.content(begin[cold], end[cold] + length)
                    offset = begin[cold] - own.first[local[cold]]
                    lead = place[cold] - begin[cold]
                    digest, fresh = _digests(data, lengths, token[cold], sent)
                    if len(sent) > SENT:
                        sent.clear()
                    edge = np.cumsum(lengths)
                    kept_bytes = b"".join([data[a:b] for a, b in zip((edge - lengths)[fresh].tolist(), edge[fresh].tolist())])
                    told = np.where(fresh, lengths, -lengths)
                    columns = [token[cold], row[cold], owner[cold], offset.astype(np.int32), lead.astype(np.int32), digest, told.astype(np.int32)]
                    held.append((columns, kept_bytes))
                    size += len(kept_bytes) + 40 * len(cold)
                    if size > HELD_BYTES:
                        yield _dealt(held)
                        held, size = [], 0
                if often.any():
                    yield from _hot(own, row[often], owner[often], _only(found, often), again)
        if held:
            yield _dealt(held)

    def _dealt(held):
        """Units of several slices by part: the more of them in a row, the better they are compressed."""
        columns = [np.concatenate(x) for x in zip(*(columns for columns, _ in held))]
        data, told = b"".join(data for _, data in held), columns[-1].astype(np.int64)
        deal = (mix(columns[0]) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((columns[0], deal))
        stop = np.cumsum(np.maximum(told, 0))
        begin = stop - np.maximum(told, 0)
        contents = b"".join([data[a:b] for a, b in zip(begin[order].tolist(), stop[order].tolist())])
        return _pack(deal[order], [x[order] for x in columns], (contents, np.maximum(told[order], 0)))

    def _settled(row, start, end):
        names, first, last = _ranges(row, start, end)
        deal = _DONE + (mix(names.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(deal, kind="stable")
        return _pack(deal[by], [names[by], first[by], last[by]])

    def _hot(own, row, owner, found, again):
        start, run = _windows_of(found)
        one = own.window(start)
        several = again[slot(one, again)]
        start, run, one = start[several], run[several], one[several]
        if not len(start):
            return
        row, owner, offset = row[run], owner[run], start - own.first[found.rows[run]]
        buffer, edges = own.plain()
        which = alike(one, buffer, edges[start], edges[start + length])
        copies = np.bincount(which)
        least = np.full(len(copies), np.iinfo(np.int64).max)
        np.minimum.at(least, which, owner)
        sure = decide(owner, least[which], copies[which])
        if sure.any():
            yield _settled(row[sure], offset[sure], offset[sure] + length)
        # Of each window, one occurrence goes on, or all in the row of the least key.
        order = np.lexsort((owner, which))
        head = np.ones(len(order), bool)
        head[1:] = which[order][1:] != which[order][:-1]
        send = order[head | ~sure[order]]
        for i in range(0, len(send), CHUNK):
            part = send[i : i + CHUNK]
            deal = -1 - (mix(one[part]) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(deal, kind="stable")
            part, deal = part[by], deal[by]
            data, lengths = gather(buffer, edges[start[part]], edges[start[part] + length])
            columns = [row[part], owner[part], offset[part].astype(np.int64), copies[which[part]].astype(np.int64), lengths.astype(np.int32)]
            yield _pack(deal, [one[part], *columns], (data.tobytes(), lengths))

    def compare(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        if part >= _DONE:
            row, start, end = (_column(group, c, np.int64) for c in "abc")
        elif part < 0:
            (one, row, owner, offset, copies, lengths), content = _opened(group, [np.uint64, *[np.int64] * 4, np.int32])
            end = np.cumsum(lengths)
            which = alike(one, np.frombuffer(content, np.uint8), end - lengths, end)
            total = np.bincount(which, weights=copies).astype(np.int64)
            least = np.full(len(total), np.iinfo(np.int64).max)
            np.minimum.at(least, which, owner)
            chosen = decide(owner, least[which], total[which])
            row, start, end = row[chosen], offset[chosen], offset[chosen] + length
        else:
            columns, content = _opened(group, [np.uint64, *[np.int64] * 2, *[np.int32] * 2, np.int64, np.int32])
            row, start, end = shard(*_whole_units(columns, content))
        names, start, end = _ranges(row, start, end)
        names, begin = np.unique(names, return_index=True)
        data = np.stack([start, end], 1).astype(np.int64).tobytes() if len(start) else b""
        return pa.table({"row": names, "ranges": binaries(data, np.append(begin, len(start)) * 16)})

    joined = _pressed(source, "text").join(kept, "row").select("text", "key", "row", "anchors", "fates")
    found = joined.mapInArrow(units, _PACKED).groupBy("part").applyInArrow(compare, "row long, ranges binary")
    return written(found.groupBy("row").agg(F.collect_list("ranges").alias("ranges")), "ranges")


def _ranges(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges by row and start, those that touch or overlap merged."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    # Running maximum of ends within a row: rows are numbered so that they do not mix.
    number = np.cumsum(np.append(0, row[1:] != row[:-1]))
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * step) - number * step
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return row[at], start[at], np.maximum.reduceat(end, at)


def with_ranges(documents: DataFrame, key: str, text: str, ranges: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, the compressed text as ``__text`` and each row's list of packed ranges (null without any)."""
    marked = documents.select(*keep, F.col(text).alias("__text"), F.xxhash64(key, text).alias("row"))
    keys = documents.select(F.xxhash64(key, text).alias("row"), F.col(key).alias("__key"))
    clash = keys.groupBy("row").agg(F.min("__key").alias("low"), F.max("__key").alias("high"), F.count("__key").alias("n"), F.count("*").alias("m"))
    clash = clash.where((F.col("low") != F.col("high")) | ((F.col("n") > 0) & (F.col("n") < F.col("m"))))
    clash = clash.where(F.raise_error(F.lit("two rows have one fingerprint")).cast("boolean")).select("row")
    return _pressed(marked, "__text").join(ranges.union(clash.select("row", F.lit(None).cast(ranges.schema["ranges"].dataType))), "row", "left")


def unpack(lists: list[list[bytes] | None], first: np.ndarray, total: int) -> np.ndarray:
    """Which of ``total`` items of a slice lie in the rows' ranges."""
    change = np.zeros(total + 1, np.int64)
    for row, parts in enumerate(lists):
        for part in parts or ():
            pairs = np.frombuffer(part, np.int64) + first[row]
            np.add.at(change, pairs[0::2], 1)
            np.add.at(change, pairs[1::2], -1)
    return np.cumsum(change[:-1]) > 0
