"""Links between documents whose sets of word shingles are alike, and their components.

Equal sets are one node. A node's prefix are its rarest shingles, so many that two sets which reach the similarity share one.
Nodes that share a prefix shingle and lie in the same or the next band of set sizes form a tile. Each node
has a bitmap in which every shingle flips one bit: the bits in which two bitmaps differ bound the overlap from above,
and only pairs that pass this bound are compared element by element, as sorted arrays.

Pairs are looked at in two rounds. First every node of a tile meets one other, chosen by hash. Then the nodes of a
tile that are still in different components meet. So a large group of copies costs about one comparison per node and shared
shingle, and no link between components is lost. Lists of up to ``SHORT`` nodes give all their pairs in the first round.

Rarity comes from a table of counts by hash (``TABLE_BITS``, a fixed 16 MB), summed over all documents. Any order gives
the same links; a table that is too full for a corpus only makes more candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tableflow.llm.batches import LOWER, NOT_BLANK, PrefixHashes, Words, binaries, extend, mix, slices, utf8
from tableflow.llm.shared import components, written

SHINGLE = 4
PERCENT = 85
TABLE_BITS = 23
MOST = 2**16 - 1  # counts end here
BITS = 2048
FIRST_BITS = 512  # of these, the bits that the first round compares
BITMAP_ROWS = 64
SHORT = 64  # a list of so many nodes, or fewer, gives all its pairs at once
FILTER_BITS = 1 << 24
HOT = 1 << 15  # a shingle with this count may have a long list: it is dealt by shingle and node
PART_BYTES = 4 << 20  # text for one part of the prefix lists
_LOWER = np.frombuffer(LOWER, np.uint8)
_OTHER = np.uint64(0x5851F42D4C957F2D)


class Sets:
    """The shingle sets of a slice: elements sorted within each row, no repeats."""

    def __init__(self, column: pa.Array, size: int):
        buffer, offsets = utf8(column)
        buffer = _LOWER[buffer]
        words = Words(buffer, offsets, NOT_BLANK)
        hashes = PrefixHashes(words.hashes(buffer))
        starts = words.windows(size)
        rows = words.rows[starts]
        short = np.flatnonzero((words.counts > 0) & (words.counts < size))
        values = np.concatenate([hashes(starts, starts + size), hashes(words.first[short], words.first[short + 1])])
        values, rows = mix(values), np.concatenate([rows, short])
        order = np.lexsort((values, rows))
        values, rows = values[order], rows[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        self.values, self.rows = values[new], rows[new]
        self.first = np.searchsorted(self.rows, np.arange(len(column) + 1))
        self.sizes = np.diff(self.first)
        self.nodes = self._fingerprint(mix(self.values))
        self.checks = self._fingerprint(mix(self.values ^ _OTHER))

    def _fingerprint(self, values: np.ndarray) -> np.ndarray:
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64))
        return mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.sizes.astype(np.uint64)).view(np.int64)

    def firsts(self) -> np.ndarray:
        """One row for each set of the slice; empty sets are left out."""
        _, at = np.unique(self.nodes, return_index=True)
        return at[self.sizes[at] > 0]

    def bitmaps(self) -> np.ndarray:
        """BITS bits for each row, as 64-bit integers: element e flips bit e mod BITS."""
        spot = self.rows * BITS + (self.values % np.uint64(BITS)).astype(np.int64)
        out = np.zeros((len(self.sizes), BITS // 64), np.int64)
        for row in range(0, len(out), BITMAP_ROWS):  # so many rows at a time: a count takes eight bytes
            part = out[row : row + BITMAP_ROWS]
            own = spot[self.first[row] : self.first[row + len(part)]] - row * BITS
            odd = (np.bincount(own, minlength=len(part) * BITS) & 1).astype(np.uint8)
            part[:] = np.packbits(odd, bitorder="little").view(np.int64).reshape(part.shape)
        return out


def least_own_overlap(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The elements that any similar set shares with a set of this size, at least."""
    return -(-percent * sizes // 100)


def _count(documents: DataFrame, key: str, text: str, size: int, bits: int) -> DataFrame:
    """Rows of counts (parts of each task's table) and one row per document, written in one pass."""
    key_type = documents.schema[key].dataType
    schema = StructType([StructField("key", key_type)]).add("mark", "long").add("slice", "integer").add("counts", "binary")
    schema = schema.add("node", "long").add("check", "long").add("n", "long")
    for i in range(BITS // 64):
        schema = schema.add(f"b{i}", "long")
    source = documents.select(F.col(text).alias("text"), F.xxhash64(text).alias("mark"), F.col(key).alias("key"))
    width = 1 << 16

    def run(batches):
        table = np.zeros(1 << bits, np.uint32)
        key_kind = None
        for batch in batches:
            key_kind = batch.column(2).type
            for first, rows in slices(batch.column(0)):
                part = batch.slice(first, rows)
                sets = Sets(part.column(0), size)
                at, times = np.unique(sets.values >> np.uint64(64 - bits), return_counts=True)
                table[at.astype(np.int64)] += times.astype(np.uint32)
                none = pa.nulls(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), part.column(1), none.cast(pa.int32()), none.cast(pa.binary()), pa.array(sets.nodes), pa.array(sets.checks), pa.array(sets.sizes, pa.int64())]
                    + [pa.array(b) for b in sets.bitmaps().T.copy()],
                    names=schema.names,
                )
        if key_kind is not None:
            for number, part in enumerate(table.reshape(-1, min(width, 1 << bits))):
                if part.any():
                    kind = "<u1" if part.max() < 256 else "<u2" if part.max() < 65536 else "<u4"
                    none = pa.nulls(1, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(1, key_kind), none, pa.array([number], pa.int32()), pa.array([part.astype(kind).tobytes()], pa.binary())] + [none] * (3 + BITS // 64), names=schema.names
                    )

    return written(source.mapInArrow(run, schema), "sets")


def _table(counted: DataFrame, bits: int) -> np.ndarray:
    """The summed table. Tasks add up what streams past them, so no task holds more than its slices."""
    width = min(1 << 16, 1 << bits)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                part = np.frombuffer(data, {width: "<u1", 2 * width: "<u2", 4 * width: "<u4"}[len(data)])
                sums[number] = sums.get(number, 0) + part.astype(np.int64)
        if sums:
            data = [np.minimum(v, MOST).astype("<u2").tobytes() for v in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(data, pa.binary())], names=["slice", "counts"])

    rows = counted.where("slice is not null").select("slice", "counts").repartition(16, "slice").mapInArrow(run, "slice int, counts binary").collect()
    table = np.zeros(1 << bits, np.uint16)
    for number, data in rows:
        table[number * width : (number + 1) * width] = np.frombuffer(data, "<u2")
    return table


def _lists(documents: DataFrame, text: str, table: np.ndarray, size: int, percent: int, parts: int, hot: int, short: int) -> DataFrame:
    """Of prefix shingles that two nodes have (or may have, if hot): pairs ``node``, ``other`` of short lists, where the sizes allow
    the similarity, and ``token``, ``node``, ``n`` of the entries of long ones."""
    shared = documents.sparkSession.sparkContext.broadcast(table)
    shift = np.uint64(64 - int(np.log2(len(table))))

    def prefixes(batches):
        counts = shared.value
        for batch in batches:
            for first, rows in slices(batch.column(0)):
                sets = Sets(batch.column(0).slice(first, rows), size)
                chosen = np.zeros(rows, bool)
                chosen[sets.firsts()] = True
                count = counts[(sets.values >> shift).astype(np.int64)]
                order = np.lexsort((sets.values, count, sets.rows))
                place = np.arange(len(order)) - sets.first[sets.rows]
                length = sets.sizes - least_own_overlap(sets.sizes, percent) + 1
                order = order[(place < length[sets.rows]) & chosen[sets.rows]]
                token, row = sets.values[order], sets.rows[order]
                node, n = sets.nodes[row], sets.sizes[row]
                often = count[order] >= hot
                part = np.where(often, mix(token ^ mix(node.view(np.uint64))), mix(token)) % np.uint64(parts)
                part = part.astype(np.int64)
                part[often] = -1 - part[often]
                order = np.argsort(part, kind="stable")
                part, token, node, n = part[order], token[order], node[order], n[order]
                names, begin = np.unique(part, return_index=True)
                ends = np.append(begin, len(part)) * 8
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), binaries(token.tobytes(), ends), binaries(node.tobytes(), ends), binaries(n.astype(np.int64).tobytes(), ends)],
                    names=["part", "tokens", "nodes", "sizes"],
                )

    def repeated(group: pa.Table) -> pa.Table:
        join = lambda i: np.frombuffer(b"".join(group.column(i).to_pylist()), np.int64)
        token, node, n = join(1), join(2), join(3)
        order = np.lexsort((node, token))
        token, node, n = token[order], node[order], n[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, n = token[new], node[new], n[new]
        left = right = np.zeros(0, np.int64)
        if group.column(0)[0].as_py() >= 0:
            _, which, count = np.unique(token, return_inverse=True, return_counts=True)
            few = (count[which] > 1) & (count[which] <= short)
            many = count[which] > short
            t, v, m = token[few], node[few], n[few]
            found = []
            for step in range(1, short):
                at = np.flatnonzero(t[step:] == t[:-step])
                if not len(at):
                    break
                near = at[100 * np.minimum(m[at], m[at + step]) >= percent * np.maximum(m[at], m[at + step])]
                found.append(np.stack([v[near], v[near + step]]))
            if found:
                left, right = np.unique(np.concatenate(found, axis=1), axis=1)
            token, node, n = token[many], node[many], n[many]
        none = lambda k, kind=pa.int64(): pa.nulls(k, kind)
        return pa.table(
            {
                "token": pa.concat_arrays([none(len(left)), pa.array(token)]),
                "node": np.concatenate([left, node]),
                "n": pa.concat_arrays([none(len(left)), pa.array(n)]),
                "other": pa.concat_arrays([pa.array(right), none(len(token))]),
            }
        )

    packed = documents.select(F.col(text)).mapInArrow(prefixes, "part long, tokens binary, nodes binary, sizes binary")
    return packed.groupBy("part").applyInArrow(repeated, "token long, node long, n long, other long")


def _filter(nodes: DataFrame) -> np.ndarray:
    """A fixed 2 MB of bits in which each node has one set."""

    def run(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = (mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        parts = [(i, part.tobytes()) for i, part in enumerate(bits.reshape(-1, width)) if part.any()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([d for _, d in parts], pa.binary())], names=["part", "bits"])

    def either(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found[number] = found.get(number, np.uint8(0)) | np.frombuffer(data.as_py(), np.uint8)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["part", "bits"])

    schema, width = "part int, bits binary", 1 << 16
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for number, data in nodes.mapInArrow(run, schema).repartition(16, "part").mapInArrow(either, schema).collect():
        bits[number * width : (number + 1) * width] = np.frombuffer(data, np.uint8)
    return bits


def _texts(documents: DataFrame, text: str, nodes: DataFrame, size: int) -> DataFrame:
    """``node`` and a text for the given nodes. A task sends a set once per slice, and only if the nodes' filter has it."""
    shared = documents.sparkSession.sparkContext.broadcast(_filter(nodes))

    def run(batches):
        for batch in batches:
            for first, rows in slices(batch.column(0)):
                column = batch.column(0).slice(first, rows)
                sets = Sets(column, size)
                at = np.sort(sets.firsts())
                bit = (mix(sets.nodes[at].view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
                at = at[(shared.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0]
                yield pa.RecordBatch.from_arrays([pa.array(sets.nodes[at]), column.take(pa.array(at))], names=["node", "text"])

    rows = documents.select(F.col(text)).mapInArrow(run, "node long, text string").join(nodes, "node", "left_semi")
    return rows.groupBy("node").agg(F.first("text").alias("text"))


def _passes(left: str, right: str, percent: int, bits: int) -> Column:
    """The sizes, and the bound from the first bits of the bitmaps, allow the similarity."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    differ = sum((F.bit_count(F.col(f"{left}.b{i}").bitwiseXOR(F.col(f"{right}.b{i}"))) for i in range(bits // 64)), F.lit(0))
    sizes = (100 * n >= percent * m) & (100 * m >= percent * n)
    return sizes & ((100 + percent) * (n + m - differ) >= 2 * percent * (n + m))


def _links(pairs: DataFrame, documents: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) that are similar, by intersecting their sorted sets."""
    pairs = written(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = written(_texts(documents, text, nodes, size), "texts")
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("left_text"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("right_text"))

    def run(batches):
        for batch in batches:
            for first, rows in slices(batch.column(2), 1 << 20):
                part = batch.slice(first, rows)
                left, right = Sets(part.column(2), size), Sets(part.column(3), size)
                values, which = np.concatenate([left.values, right.values]), np.concatenate([left.rows, right.rows])
                order = np.lexsort((values, which))
                values, which = values[order], which[order]
                twice = np.flatnonzero((values[1:] == values[:-1]) & (which[1:] == which[:-1]))
                overlap = np.bincount(which[twice], minlength=rows)
                good = pa.array(100 * overlap >= percent * (left.sizes + right.sizes - overlap))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], names=["a", "b"])

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "left_text", "right_text")
    return written(both.mapInArrow(run, "a long, b long"), "links")


def _band(percent: int) -> Column:
    return F.floor(F.ln("n") / F.lit(float(np.log(100 / percent)))).cast("int")


def set_components(documents: DataFrame, key: str, text: str, size: int = SHINGLE, percent: int = PERCENT, bits: int = TABLE_BITS, hot: int = HOT, short: int = SHORT) -> DataFrame:
    """One row per document: ``key``, ``mark`` (xxhash64 of the text), ``n_shingles``, ``component`` and ``first_mark``.

    A set are the distinct shingles of ``size`` lower-case words; fewer words are one shingle, none the empty set. Sets are
    linked if their overlap is ``percent`` per cent of their union or more; ``component`` is the smallest key
    in a document's component, ``first_mark`` the smallest mark with it. Empty sets (also null texts) are linked with nothing. A null key is
    larger than all others. Different sets with one 64-bit fingerprint fail the job (a second one is compared).
    """
    documents = documents.select(F.col(key), F.col(text))
    counted = _count(documents, key, text, size, bits)
    rows = counted.where("slice is null")
    table = _table(counted, bits)
    total = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    found = written(_lists(documents, text, table, size, percent, max(64, total // PART_BYTES), hot, short), "lists")
    words = [f"b{i}" for i in range(BITS // 64)]
    bitmaps = written(rows.where("n > 0").select("node", "n", *words).dropDuplicates(["node"]), "bitmaps")
    lists = found.where("other is null").select("token", "node", "n").withColumn("band", _band(percent))

    # First round: the pairs of short lists, and each node of a tile of a long one with one that the tile's hash chooses.
    chosen = lists.groupBy("token", "band").agg(F.min(F.struct(F.xxhash64("token", "node").alias("h"), "node"))["node"].alias("center"))
    stars = lists.join(chosen, ["token", "band"]).where("node <> center").select("node", F.col("center").alias("other"))
    pairs = found.where("other is not null").select("node", "other").union(stars)
    pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    slim = bitmaps.select("node", "n", *words[: FIRST_BITS // 64])
    named = lambda name, column: slim.withColumnRenamed("node", column).alias(name)
    near = pairs.join(named("x", "a"), "a").join(named("y", "b"), "b").where(_passes("x", "y", percent, FIRST_BITS)).select("a", "b")
    first_links = _links(near, documents, text, size, percent)
    labels = written(components(first_links), "labels")

    # Second round: nodes of one tile in different components.
    labelled = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    open_lists = labelled.join(mixed, "token")
    tokens = open_lists.groupBy("node").agg(F.collect_set("token").alias("tokens"))
    entries = written(open_lists.join(bitmaps.drop("n"), "node").join(tokens, "node"), "tiles")
    smaller = entries.alias("x")
    larger = entries.withColumn("band", F.explode(F.array("band", F.col("band") - 1))).alias("y")
    tile = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band"))
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    bound = _passes("x", "y", percent, FIRST_BITS) & _passes("x", "y", percent, BITS)
    # A pair that passes counts in the tile of the smallest of its common shingles only.
    once = F.array_min(F.array_intersect("x.tokens", "y.tokens")) == F.col("x.token")
    pairs = smaller.join(larger, tile & ordered & (F.col("x.label") != F.col("y.label")) & bound & once)
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    found = _links(pairs, documents, text, size, percent)
    group = components(first_links.union(found))

    named_rows = rows.join(group, "node", "left").withColumn("group", F.when(F.col("n") > 0, F.coalesce("label", "node")))
    rank = F.struct(F.col("key").isNull().alias("none"), "key", "mark")
    smallest = named_rows.where("n > 0").groupBy("group").agg(F.min(rank).alias("least"), F.count("*").alias("members"))
    sets = rows.where("n > 0").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    clash = F.raise_error(F.lit("two different sets have one fingerprint")).cast("boolean")
    sound = sets.where("low <> high").limit(1).where(clash)
    return (
        named_rows.join(smallest, "group", "left")
        .join(sound.select(F.col("node").alias("__none")), F.col("node") == F.col("__none"), "left_anti")
        .select(
            F.col("key").alias(key),
            "mark",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("least.key")).otherwise(F.col("key")).alias("component"),
            F.when(F.col("n") > 0, F.col("least.mark")).otherwise(F.col("mark")).alias("first_mark"),
        )
    )


def keep_first(documents: DataFrame, key: str, text: str, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component stays (smallest key, then smallest mark), as do all rows with empty sets; same columns."""
    names = documents.columns
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    place = {name.lower(): f"c{i}" for i, name in enumerate(names)}
    id_, text_ = place[key.lower()], place[text.lower()]
    found = set_components(plain, id_, text_, size, percent).where(F.col(id_).eqNullSafe(F.col("component")) & (F.col("mark") == F.col("first_mark")))
    chosen = found.groupBy(F.col(id_).alias("k"), "mark").agg(F.max("n_shingles").alias("n"))
    marked = plain.withColumn("mark", F.xxhash64(text_))
    kept = marked.join(chosen.withColumnRenamed("mark", "m"), F.col(id_).eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m")))
    filled = kept.where("n > 0").dropDuplicates([id_, "mark"]).select(*plain.columns)
    return filled.union(kept.where("n = 0").select(*plain.columns)).toDF(*names)
