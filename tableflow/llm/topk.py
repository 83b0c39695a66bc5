"""Exact nearest vectors by inner product, without random access.

Each dimension of a block of candidates is a sorted list; a query reads it from the end that its sign favours. Lists are read in
rounds of growing depth. After a round a candidate's score has an upper bound (each value not yet read is the list's next), and a
candidate whose upper bound is below the query's k-th score is out. That score comes from the candidates before; a query that has none
yet takes the k-th lower bound (each value not yet read is the list's last). A candidate that no list has shown has the least upper bound: while that
one is not below the k-th score, the round can close nothing for the query, and its other bounds are not computed; nor are they if a part of the candidates
shows that many would stay open. When few are left, or the lists end, the
remaining scores are computed. All queries of a block go through a round together, as matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 2**18  # components of a candidate block, on average
QUERIES = 2**15
ROWS = (2048, 512)  # candidates and queries that are read together at most
FIRST = 512  # candidates that give a query its first k-th score
ROUNDS = (16, 8, 4, 2)  # depths as parts of a list
FEW, SHARE = 32, 32  # a query's remaining scores are computed one by one if they are so few, or such a part
PAIRS = 4096  # of them at once
TRIED = 128  # candidates on which a round is tried first; queries that keep many of them open skip it
GROUPS = 64  # groups of candidate blocks
GROUP = 2**24  # components that a group holds at most, on average
LARGEST = 2.0**63


def scaled(embedding: str, factor: int = 256) -> Column:
    """``floor(factor * x)`` of each component, as long; one that is no long fails the job."""

    def whole(x):
        value = F.lit(float(factor)) * x.cast("double")
        fits = (value < F.lit(LARGEST)) & (value >= F.lit(-LARGEST))
        return F.when(fits, F.floor(value)).otherwise(F.raise_error(F.lit("a scaled component does not fit 64 bits")).cast("bigint"))

    return F.transform(F.col(embedding), whole)


def usable(embedding: str) -> Column:
    """No null, NaN or infinite component."""
    good = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.col(embedding).isNotNull() & good


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.min())), abs(int(values.max()))) if values.size else 0


class Best:
    """The ``k`` best candidates of each query so far; equal scores go by smaller id."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int):
        self.queries, self.own, self.k, self.largest = queries, own, k, _largest(queries)
        self.query = self.score = self.id = np.empty(0, np.int64)
        # The k-th score and its id: what is worse needs no look.
        self.limit, self.last = np.full(len(own), -np.inf), np.full(len(own), np.iinfo(np.int64).max)
        self.wide: dict[int, list[tuple[int, int]]] = {}  # where doubles are not exact
        self.computed = 0  # scores, but those of the few

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Take candidates whose score is not below ``limit``; a query's own key is left out."""
        better = (ids != self.own[query]) & ((score > self.limit[query]) | (ids < self.last[query]))
        if not better.any():
            return
        query = np.concatenate([self.query, query[better]])
        score = np.concatenate([self.score, score[better].astype(np.int64)])
        ids = np.concatenate([self.id, ids[better]])
        order = np.lexsort((ids, -score, query))
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[rank < self.k]
        self.query, self.score, self.id = query[order], score[order], ids[order]
        full = rank[rank < self.k] == self.k - 1
        self.limit[self.query[full]], self.last[self.query[full]] = self.score[full], self.id[full]

    def add_wide(self, values: np.ndarray, ids: np.ndarray) -> None:
        rows = values.tolist()
        for query, (own, weights) in enumerate(zip(self.own.tolist(), self.queries.tolist())):
            found = [(-sum(a * b for a, b in zip(row, weights)), i) for row, i in zip(rows, ids.tolist()) if i != own]
            self.wide[query] = sorted(self.wide.get(query, []) + found)[: self.k]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, ids and scores, best first."""
        if not self.wide:
            return self.query, self.id, self.score
        found = [self.wide.get(query, []) for query in range(len(self.own))]
        for query, i, score in zip(self.query.tolist(), self.id.tolist(), self.score.tolist()):
            found[query] = [*found[query], (-score, i)]
        best = [(query, i, -score) for query, each in enumerate(found) for score, i in sorted(each)[: self.k]]
        return tuple(np.array([x[n] for x in best], np.int64) for n in range(3))


def meet(best: Best, values: np.ndarray, lists: np.ndarray, ids: np.ndarray) -> None:
    """Some candidates, of which ``lists`` has each dimension sorted, against some queries."""
    n, width = values.shape
    bound = max(width, 1) * _largest(values) * best.largest
    if bound >= 2**53:
        best.add_wide(values, ids)
        return
    kind = np.float32 if bound < 2**24 else np.float64  # sums of whole numbers up to there are exact
    values, lists, queries = values.astype(kind), lists.astype(kind), best.queries.astype(kind)
    signed = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
    limit, active = best.limit.astype(kind), np.arange(len(queries))

    def kth(scores: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The k-th largest of each row without the query's own, or the least."""
        for i in np.flatnonzero(np.isin(ids, best.own[rows])):
            scores[best.own[rows] == ids[i], i] = -np.inf
        place = n - min(best.k, n)
        return np.partition(scores, place, axis=1)[:, place]

    def take(rows: np.ndarray, open_: np.ndarray, scores: np.ndarray | None = None) -> None:
        query, i = np.divmod(np.flatnonzero(open_), n)
        if scores is None:
            pairs = [(rows[query[j : j + PAIRS]], i[j : j + PAIRS]) for j in range(0, len(i), PAIRS)]
            found = np.concatenate([np.einsum("ij,ij->i", queries.take(a, axis=0), values.take(b, axis=0)) for a, b in pairs] or [np.empty(0, kind)])
        else:
            found = scores[query, i]
        enough = found >= best.limit[rows[query]]
        best.add(rows[query[enough]], ids[i[enough]], found[enough])

    for depth in (0, *(max(best.k + 1, n // part) for part in ROUNDS)) if n > FEW and width else ():
        low, high = lists[:, min(depth, n - 1)], lists[:, max(n - 1 - depth, 0)]
        unseen = signed[active] @ np.hstack([high, low])
        rows = active[np.isneginf(best.limit[active])] if depth else ()
        if len(rows):
            known = np.hstack([np.where(values >= high, values, lists[:, 0]), np.where(values <= low, values, lists[:, -1])])
            limit[rows] = np.maximum(limit[rows], kth(signed[rows] @ known.T, rows))
        closing = np.flatnonzero(unseen < limit[active])
        if not len(closing):
            continue
        if depth:
            most, enough = np.hstack([np.maximum(values, high), np.minimum(values, low)]), max(FEW, n // SHARE)
            for step in (max(1, n // TRIED), 1):
                rows = active[closing]
                open_ = signed[rows] @ most[::step].T >= limit[rows, None]
                few = np.count_nonzero(open_, axis=1) * step <= enough
                closing = closing[few]
            take(rows[few], open_[few])
        active = np.delete(active, closing)
        if not len(active):
            return
    best.computed += len(active) * n
    scores = queries[active] @ values.T
    new = np.flatnonzero(np.isneginf(best.limit[active]))
    if len(new):
        limit[active[new]] = kth(scores[new], active[new])
    take(active, scores >= limit[active, None], scores)


def best_of(candidates: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, id and score of each query's k best of the candidates but its own; equal scores by smaller id."""
    width = max(1, candidates.shape[1])
    rows, asked = (max(1, min(most, parts // width)) for most, parts in zip(ROWS, (4 * CANDIDATES, 8 * QUERIES)))
    found = [Best(queries[i : i + asked], own[i : i + asked], k) for i in range(0, max(1, len(own)), asked)]
    ends = sorted({0, *range(min(FIRST, rows), len(ids), rows), len(ids)})
    for start, end in zip(ends, ends[1:]):
        values = candidates[start:end]
        lists = np.sort(values.T, axis=1)
        for best in found:
            meet(best, values, lists, ids[start:end])
    query, i, score = zip(*(best.result() for best in found))
    return np.concatenate([n * asked + each for n, each in enumerate(query)]), np.concatenate(i), np.concatenate(score)


def nearest(candidates: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    return list(zip(*(x.tolist() for x in best_of(candidates, ids, queries, own, k))))


def _packed(rows: DataFrame, block: Column) -> DataFrame:
    """Blocks of rows of one width: ids, and components in as few bytes each as all of them fit, as binary."""

    def pack(group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        values = pc.list_flatten(group["v"]).to_numpy().reshape(len(ids), -1)[order] if group["width"][0].as_py() else np.empty(0, np.int64)
        kind = next(x for x in ("<i1", "<i2", "<i4", "<i8") if _largest(values) <= np.iinfo(x).max or x == "<i8")
        return pa.table({"width": group["width"][:1], "block": group["block"][:1], "ids": pa.array([ids[order].tobytes()]), "data": pa.array([values.astype(kind).tobytes()])})

    return rows.withColumn("block", block).groupBy("width", "block").applyInArrow(pack, "width int, block long, ids binary, data binary")


def _unpacked(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components of all blocks."""
    width, ids, values = blocks["width"][0].as_py(), [], []
    for block in blocks.select(["ids", "data"]).to_pylist():
        ids.append(np.frombuffer(block["ids"], np.int64))
        each = len(block["data"]) // (len(ids[-1]) * width) if width else 8
        values.append(np.frombuffer(block["data"], f"<i{each}").reshape(len(ids[-1]), width))
    return np.concatenate(ids), np.concatenate(values)


def search(vectors: DataFrame, key: str, embedding: str, queries: Column, k: int, factor: int = 256) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k best rows for every row that ``queries`` picks.

    Scores are inner products of components scaled to integers; equal scores go by smaller key (an integer). A query meets all
    rows of its width but those with its own key. Rows without key, or with null, NaN or infinite components take no part; a scaled component, or
    a score among the best, that does not fit 64 bits fails the job. A group of candidates meets a strip of queries in one call, which
    returns k rows per query, of which the best are taken with a limit before the shuffle. A query is copied once per group, and a candidate once per strip.
    """
    parts = F.greatest(F.size(embedding), F.lit(16)).cast("bigint")  # also of rows that take no part: the sums only set the number of blocks
    total, asked = (x or 0 for x in vectors.agg(F.sum(parts), F.sum(F.when(queries, parts))).first())
    blocks = max(1, -(-total // CANDIDATES))
    groups, strips = max(min(GROUPS, blocks), -(-total // GROUP)), max(1, -(-asked // GROUP))

    def packed(some: DataFrame, n: int) -> DataFrame:
        rows = some.where(F.col(key).isNotNull() & usable(embedding))
        rows = rows.select(F.col(key).cast("bigint").alias("id"), scaled(embedding, factor).alias("v"), F.size(embedding).alias("width"))
        return _packed(rows, F.pmod(F.xxhash64("id"), F.lit(n)))

    candidates, wanted = packed(vectors, blocks), packed(vectors.where(queries), max(strips, -(-asked // QUERIES)))

    def dealt(packed: DataFrame, own: str, n: int, other: str, copies: int) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint")))
        packed = packed.withColumn(own, F.pmod("block", F.lit(n).cast("bigint"))).withColumn(other, each)
        return packed.repartition(groups * strips, "width", "group", "strip").groupBy("width", "group", "strip")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("query_id", "vec_id", "score")
        if not left.num_rows or not right.num_rows:
            return pa.table({name: pa.array([], pa.int64()) for name in names})
        ids, values = _unpacked(left)
        own, asked = _unpacked(right)
        query, *found = best_of(values, ids, asked, own, k)
        return pa.table(dict(zip(names, (own[query], *found))))

    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    tiles = dealt(candidates, "group", groups, "strip", strips).cogroup(dealt(wanted, "strip", strips, "group", groups))
    scored = tiles.applyInArrow(run, "query_id long, vec_id long, score long")
    return scored.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
