"""Byte-level BPE with the tokenizers library: encoding with character offsets, and decoding.

Ids follow a rank file (``base64 rank`` per line). Text is cut where a non-blank character is followed by
white space: no match of the splitting pattern crosses such a place, so the parts can be encoded alone or in any
order, each distinct part once per worker for as long as it is remembered.

Nulls and empty texts have no ids. No special tokens: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from tableflow.llm.batches import binaries, byte_hashes, extend, utf8
from tableflow.llm.repeats import CHUNK, alike, gather

REMEMBERED = 16 << 20  # bytes of each of the two generations of distinct parts that a worker remembers
REMEMBERED_BYTES = 256  # of a part; longer ones are encoded whenever they come
ENTRY_BYTES = 24  # that a remembered part takes beside its own bytes and ids
SLICE = 1 << 20
BATCH = 2000  # parts that the tokenizer holds at once
JOINED = 100  # of them in one string, where they may stand side by side


@lru_cache(1)
def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


@lru_cache(4)
def byte_table(path: str) -> list[bytes]:
    """The bytes of each id; an id that the file leaves out has none."""
    words = {rank: token for token, rank in read_ranks(path).items()}
    return [words.get(i, b"") for i in range(max(words) + 1)]


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts from which the token is merged: merging by rank, stopped one step before the whole."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


@lru_cache(4)
def tokenizer_json(path: str, pattern: str) -> str:
    """A tokenizers definition with the ids, merges and splitting pattern of a rank file."""
    ranks = read_ranks(path)
    letters = byte_characters()
    spell = lambda token: "".join(letters[b] for b in token)
    merges = [[spell(a), spell(b)] for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1 for a, b in [_last_merge(t, ranks)]]
    return json.dumps(
        {
            "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None,
            "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]},
            "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
            "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
                      "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {spell(t): r for t, r in ranks.items()}, "merges": merges},
        }
    )


class _Parts:
    """Distinct parts and their ids in a few arrays, found by hash; bytes are compared. Of parts with one hash only the first is held."""

    def __init__(self):
        self.hashes = np.zeros(0, np.uint64)  # in order
        self.places = np.zeros((4, 0), np.int32)  # of each: the range of its bytes in ``keys``, and of its ids in ``ids``
        self.keys, self.ids = np.zeros(0, np.uint8), np.zeros(0, "<u4")

    def __len__(self) -> int:
        return len(self.hashes)

    def __iter__(self):
        return (self.keys[a:b].tobytes() for a, b in self.places[:2].T.tolist())

    @property
    def held(self) -> int:
        return self.hashes.nbytes + self.places.nbytes + self.keys.nbytes + self.ids.nbytes

    def find(self, hashes: np.ndarray, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the parts are held, and for those their ids and how many each has."""
        if not len(self):
            return np.zeros(len(hashes), bool), self.ids[:0], np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        begin, end = self.places[:2, at].astype(np.int64)
        same = (self.hashes[at] == hashes) & (end - begin == ends - starts)
        check = np.flatnonzero(same)
        for i in range(0, len(check), CHUNK):
            part = check[i : i + CHUNK]
            left, lengths = gather(buffer, starts[part], ends[part])
            differ = np.flatnonzero(left != gather(self.keys, begin[part], end[part])[0])
            same[part[np.searchsorted(np.cumsum(lengths), differ, "right")]] = False
        return same, *gather(self.ids, *self.places[2:, at[same]].astype(np.int64))

    def add(self, hashes: np.ndarray, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Parts, their bytes and ids one after the other."""
        key_ends, id_ends = np.cumsum(lengths) + len(self.keys), np.cumsum(sizes) + len(self.ids)
        places = np.stack([key_ends - lengths, key_ends, id_ends - sizes, id_ends]).astype(np.int32)
        fresh, first = np.unique(hashes, return_index=True)
        at = np.searchsorted(self.hashes, fresh)
        new = np.ones(len(fresh), bool)
        inside = at < len(self)
        new[inside] = self.hashes[at[inside]] != fresh[inside]
        self.hashes = np.insert(self.hashes, at[new], fresh[new])
        self.places = np.insert(self.places, at[new], places[:, first[new]], axis=1)
        self.keys, self.ids = np.concatenate([self.keys, keys]), np.concatenate([self.ids, ids])


class _Coder:
    """A worker's tokenizer, and the parts it has seen."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id; a character of the vocabulary is a byte
        self.lengths[list(vocabulary.values())] = list(map(len, vocabulary))
        self.seen, self.older = _Parts(), _Parts()

    @property
    def held(self) -> int:
        return self.seen.held

    def remember(self, hashes: np.ndarray, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Parts and their ids; those of a full generation stay for one more."""
        short = ends - starts <= REMEMBERED_BYTES
        needed = np.cumsum(np.where(short, ends - starts + 4 * sizes + ENTRY_BYTES, 0))
        short &= needed <= REMEMBERED
        if not short.any():
            return
        if self.seen.held + needed[short][-1] > REMEMBERED:
            self.seen, self.older = _Parts(), self.seen
        self.seen.add(hashes[short], *gather(buffer, starts[short], ends[short]), ids[np.repeat(short, sizes)], sizes[short])

    def ids_of(self, hashes: np.ndarray, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct parts in any order: the ids, and for each part the place of its first one and how many it has."""
        order, ids, sizes = [], [], []
        left = np.arange(len(starts))
        for parts in (self.seen, self.older):
            known, found, n = parts.find(hashes[left], buffer, starts[left], ends[left])
            order, ids, sizes = [*order, left[known]], [*ids, found], [*sizes, n]
            left = left[~known]
        at, found, n = self.encode(buffer, starts[left], ends[left], free[left])
        # Parts in use move on to the newer generation.
        moved, moved_ids, moved_sizes = (np.concatenate(x) for x in ((order[1], left[at]), (ids[1], found), (sizes[1], n)))
        self.remember(hashes[moved], buffer, starts[moved], ends[moved], moved_ids, moved_sizes)
        at, n = np.append(order[0], moved), np.append(sizes[0], moved_sizes)
        first, lengths = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        first[at], lengths[at] = np.cumsum(n) - n, n
        return np.append(ids[0], moved_ids), first, lengths

    def encode(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parts in another order, their ids and how many each has. ``free`` ones begin with ASCII white space and end in a solid byte, so
        no match crosses from one to the next: they go to the tokenizer side by side."""
        many, alone = np.flatnonzero(free), np.flatnonzero(~free)
        data, lengths = gather(buffer, starts[many], ends[many])
        edges = np.append(0, np.cumsum(lengths))
        ids, _ = self._tokenized(data.tobytes(), np.append(edges[:-1:JOINED], edges[-1]), BATCH // JOINED)
        reached = np.append(0, np.cumsum(self.lengths[ids]))
        at = np.searchsorted(reached, edges)
        if reached[-1] != edges[-1] or (reached[at] != edges).any():  # bytes that are no text and were replaced
            ids, at, many, alone = ids[:0], at[:1], many[:0], np.arange(len(starts))
        data, lengths = gather(buffer, starts[alone], ends[alone])
        more, sizes = self._tokenized(data.tobytes(), np.append(0, np.cumsum(lengths)), BATCH)
        return np.append(many, alone), np.append(ids, more), np.append(np.diff(at), sizes)

    def _tokenized(self, data: bytes, edges: np.ndarray, batch: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each range between two edges, and how many it has."""
        edges = edges.tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:])]
        found = [np.zeros(0, "<u4")]
        for at in range(0, len(texts), batch):
            found += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts[at : at + batch], add_special_tokens=False)]
        return np.concatenate(found), np.fromiter(map(len, found[1:]), np.int64, len(texts))


@lru_cache(2)
def _coder(definition: str) -> _Coder:
    return _Coder(definition)


_BLANK = np.zeros(256, bool)
_BLANK[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True


def _solid(buffer: np.ndarray) -> np.ndarray:
    """Bytes that end a character that is surely not white space.

    White space beyond ASCII begins with the bytes C2, E1, E2 or E3; after such a character there is no cut.
    """
    solid = (buffer > 0x20) & (buffer < 0x7F)
    high = buffer >= 0x80
    if len(buffer) > 2:
        two = high[1:] & (buffer[:-1] > 0xC2) & (buffer[:-1] < 0xE0)
        solid[1:] |= two
        solid[2:] |= high[2:] & (buffer[:-2] > 0xE3) & (buffer[:-2] < 0xF0)
    return solid


def _cuts(buffer: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> np.ndarray:
    """Starts of parts: of rows, and ASCII white space after a solid byte."""
    cut = np.zeros(len(buffer), bool)
    cut[1:] = _BLANK[buffer[1:]] & solid[:-1]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


def _encode(coder: _Coder, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows and the rows' offsets in them."""
    buffer, offsets = utf8(column)
    if not len(buffer):
        return np.zeros(0, "<u4"), np.zeros(len(column) + 1, np.int64)
    solid = _solid(buffer)
    starts = _cuts(buffer, offsets, solid)
    ends = np.append(starts[1:], len(buffer))
    # Hashes find equal parts, and their bytes are compared.
    hashes = byte_hashes(buffer)(starts, ends)
    which = alike(hashes, buffer, starts, ends)
    first = np.zeros(int(which.max()) + 1, np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    begin, end = starts[first], ends[first]
    pool, at, sizes = coder.ids_of(hashes[first], buffer, begin, end, _BLANK[buffer[begin]] & solid[end - 1])
    lengths = sizes[which]
    begin = np.cumsum(lengths) - lengths
    out = pool[np.repeat(at[which] - begin, lengths) + np.arange(int(lengths.sum()))]
    return out, np.append(begin, len(out))[np.searchsorted(starts, offsets)]


def _offsets(lengths: np.ndarray, column: pa.Array, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each id's text, start and end. An id that ends inside a character counts it wholly."""
    buffer, offsets = utf8(column)
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    heads = np.zeros(len(buffer) + 1, np.int64)
    np.cumsum((buffer & 0xC0) != 0x80, out=heads[1:])
    base = np.repeat(heads[offsets[:-1]], np.diff(rows))
    return heads[starts + 1] - 1 - base, heads[ends] - base


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(
    df: DataFrame, text: Column | str, path: str, pattern: str, packed: bool = False, offsets: bool = False,
    decoded: bool = False, keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with ``ids``: an array, or with ``packed`` little-endian unsigned 32-bit integers as binary.

    ``offsets`` adds ``starts`` and ``ends``: the characters of the text that each id stands for. A
    character that two ids share is in both ranges. ``decoded`` adds the bytes that the ids decode to, see ``decode``, in the
    same pass. Null and empty texts: an empty value.
    """
    context = df.sparkSession.sparkContext
    shared = context.broadcast(tokenizer_json(path, pattern))
    lengths = np.array([len(w) for w in byte_table(path)], np.int64) if offsets else None
    fields = [StructField("ids", BinaryType() if packed else ArrayType(IntegerType()))]
    if offsets:
        fields += [StructField("starts", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType()))]

    table = context.broadcast(_words(path)) if decoded else None
    if decoded:
        fields.append(StructField("decoded", BinaryType()))

    def run(columns):
        coder = _coder(shared.value)
        ids, rows = _encode(coder, columns[0])
        out = [binaries(ids.tobytes(), rows * 4) if packed else _lists(ids, rows)]
        out += [_lists(v, rows) for v in _offsets(lengths, columns[0], ids, rows)] if offsets else []
        return out + ([_decode(table.value, ids, rows)] if decoded else [])

    return extend(df, [F.col(text) if isinstance(text, str) else text], StructType(fields), run, keep, SLICE)


def _words(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids one after the other, and their edges; the last entry is for unknown ids."""
    words = [*byte_table(path), b""]
    return np.frombuffer(b"".join(words), np.uint8), np.append(0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))


def _decode(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, rows: np.ndarray) -> pa.Array:
    """The bytes of each row's ids."""
    words, edges = table
    parts, sizes = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)]
    for i in range(0, len(ids), CHUNK):
        at = np.minimum(ids[i : i + CHUNK], len(edges) - 2).astype(np.int64)
        data, lengths = gather(words, edges[at], edges[at + 1])
        parts.append(data)
        sizes.append(lengths)
    return binaries(np.concatenate(parts), np.cumsum(np.concatenate(sizes))[rows])


def decode(df: DataFrame, ids: str, path: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``decoded``: the bytes of packed ids. Ids that end inside a character meet in the bytes, so
    nothing is replaced; ``text_of`` makes text of them. An id without entry has no bytes; null: empty."""
    shared = df.sparkSession.sparkContext.broadcast(_words(path))

    def run(columns):
        buffer, offsets = utf8(columns[0])
        return [_decode(shared.value, np.frombuffer(buffer.tobytes(), "<u4"), offsets // 4)]

    return extend(df, [F.col(ids)], StructType([StructField("decoded", BinaryType())]), run, keep)


def text_of(decoded: bytes) -> str:
    """Text of decoded bytes; what is no character (a cut sequence of ids) becomes U+FFFD."""
    return decoded.decode("utf-8", "replace")
