"""Shards by a weighted hash tree: region, rack, shard.

A row descends level by level. On each, every child of the node it is in draws an exponential variate from a hash of the row's key and
the child, divided by the weight of the shards below, and the least draw wins. So a child gets rows in proportion to its weight, and
a row costs a hash per child on its way (11 for 40 shards), not one per shard. Draws of different levels are independent. A changed
weight moves rows only into or out of the nodes above it, and among the children there: never between two nodes that both kept their
weights. A new shard comes as a subtree of its own at the top (:func:`grown`), and so takes rows from all others and moves none between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256  # parts of a shard that are numbered apart from each other


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, per_rack: int = 5, racks_per_region: int = 4) -> list[Leaf]:
    """``shards`` shards of weight 1, dealt to racks and regions in order."""
    return [Leaf(s // (per_rack * racks_per_region), s // per_rack, s) for s in range(shards)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region and rack of its own: it takes rows only into itself."""
    last = lambda level: max((getattr(leaf, level) for leaf in leaves), default=-1) + 1
    return [*leaves, Leaf(last("region"), last("rack"), last("shard"), weight)]


def _hash_unit(key: Column, node: Column) -> Column:
    """A number in (0, 1] from the first 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(key, node).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(1)) / F.lit(float(1 << 52))


LEVELS = ("region", "rack", "shard")


def _children(leaves: list[Leaf], level: int) -> dict[int, list[tuple[int, float]]]:
    """Below each node of the level above (the root is 0): the nodes of this level and their weights."""
    sums: dict[int, dict[int, float]] = {}
    for leaf in leaves:
        if leaf.weight > 0:
            above = getattr(leaf, LEVELS[level - 1]) if level else 0
            node = getattr(leaf, LEVELS[level])
            own = sums.setdefault(above, {})
            own[node] = own.get(node, 0.0) + float(leaf.weight)
    return {above: sorted(own.items()) for above, own in sums.items()}


def descend(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a text key: on each level the child of least draw.

    A null key is the key ``null``. Nodes of no weight get nothing; a tree without weight gives null. Equal draws: the smaller number.
    """
    key = F.coalesce(key, F.lit("null"))
    place = F.lit(0)
    for level, name in enumerate(LEVELS):
        below = _children(leaves, level)
        if not below:
            return F.lit(None).cast("int")
        pairs = [(F.lit(above), F.array(*[F.struct(F.lit(n).alias("node"), F.lit(w).alias("weight")) for n, w in own])) for above, own in below.items()]
        own = F.element_at(F.create_map(*[c for pair in pairs for c in pair]), place)
        place = F.array_min(F.transform(own, _draw(key, name)))["node"]
    return place


def _draw(key: Column, level: str):
    def draw(child: Column) -> Column:
        unit = _hash_unit(key, F.concat(F.lit(f"/{level}/"), child["node"].cast("string")))
        return F.struct((-F.ln(unit) / child["weight"]).alias("draw"), child["node"].alias("node"))

    return draw


def shard_documents(df: DataFrame, key: str, text: str, leaves: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """One row per row: key, ``size`` (UTF-8 bytes of the text, plus 16), ``text_crc32``, ``law``, ``shard``,
    ``slot`` and ``grown_shard`` (the shard in the tree ``grown``, if given).

    Slots count the rows of a shard from 0 without gaps, by bucket of the key's hash, then key, then text
    checksum and size; equal rows get slots in any order. Null text: no bytes. Rows with one key share a shard.
    No task sees a whole shard: buckets are numbered apart and shifted by the rows in the buckets before.
    """
    word = F.col(key).cast("string")
    rows = df.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(word, leaves).alias("shard"),
        (descend(word, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.conv(F.substring(F.md5(F.coalesce(word, F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("bigint").alias("__b"),
    ).withColumn("__b", (F.col("__b") % BUCKETS).cast("int"))
    counts = rows.groupBy("shard", "__b").agg(F.count("*").alias("__n"))
    # At most shards x BUCKETS rows.
    before = F.sum("__n").over(Window.partitionBy("shard").orderBy("__b")) - F.col("__n")
    starts = counts.select("shard", "__b", before.alias("__start"))
    order = Window.partitionBy("shard", "__b").orderBy(key, "text_crc32", "size")
    return (
        rows.withColumn("__at", F.row_number().over(order) - 1)
        .join(starts, ["shard", "__b"])
        .select(key, "size", "text_crc32", "law", "shard", (F.col("__start") + F.col("__at")).alias("slot"), "grown_shard")
    )
