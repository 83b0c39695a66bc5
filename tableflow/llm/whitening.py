"""Principal components and whitened coordinates by Golub-Kahan-Lanczos bidiagonalisation.

With A the centred rows over the root of their number, each step multiplies A by a vector and its transpose by the
result, and makes both new vectors orthogonal to all earlier ones. The left vectors are as long as the table; they are never
stored: each is A times a short vector that the driver keeps, so one pass over the rows gives the two products and the
inner products with all left vectors. The singular values of the small bidiagonal matrix are the deviations, and its right
singular vectors, turned back, the components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Relative size under which a new direction is rounding.
NOTHING = 1e-13
BATCH_VALUES = 1 << 18
_LONG = 2.0**63
_LOW = (1 << 31) - 1


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are whole vectors of finite numbers, and those rows as integers ``floor(SCALE * c) + SHIFT``.

    Vectors of different lengths, and entries that are no 64-bit integer, are errors.
    """
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: NaN
    good = lengths >= 0
    ends = np.cumsum(np.maximum(lengths, 0))
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good &= wrong[ends] == wrong[ends - np.maximum(lengths, 0)]
    sizes = np.unique(lengths[good])
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes[:5].tolist()}")
    wide = int(sizes[0]) if len(sizes) else 0
    rows = values[(ends[good] - wide)[:, None] + np.arange(wide)] if wide else np.zeros((int(good.sum()), 0))
    scaled = np.floor(SCALE * rows)
    if scaled.size and np.abs(scaled).max() >= _LONG / 2:
        raise ValueError("a vector entry does not fit 64 bits")
    return good, scaled.astype(np.int64) + SHIFT


def _parts(column: pa.Array):
    """The column in parts of a bounded number of values, or one longer row."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > first and held + n > BATCH_VALUES:
            yield first, i - first
            first, held = i, 0
        held += n
    if len(lengths):
        yield first, len(lengths) - first


def _totals(vectors: DataFrame, function, kind: str = "double") -> np.ndarray:
    """The sum over all rows of ``function(integer rows)``, added up inside each task and then by position."""

    def run(batches):
        total = None
        for batch in batches:
            for first, rows in _parts(batch.column(0)):
                good, x = integers(batch.column(0).slice(first, rows))
                if len(x):
                    found = function(x)
                    if total is not None and len(total) != len(found):
                        raise ValueError("vectors of different lengths")
                    total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], ["sums"])

    wide = "decimal(38,0)" if kind == "long" else "double"
    sums = vectors.mapInArrow(run, f"sums array<{kind}>").select(F.size("sums").alias("size"), F.posexplode("sums").alias("at", "value"))
    found = sums.groupBy("at").agg(F.sum(F.col("value").cast(wide)).alias("value"), F.max("size").alias("most"), F.min("size").alias("least")).collect()
    if any(r["most"] != r["least"] for r in found):
        raise ValueError("vectors of different lengths")
    found.sort(key=lambda r: r["at"])
    return np.array([int(r["value"]) if kind == "long" else r["value"] for r in found], object if kind == "long" else float)


@dataclass
class Whitening:
    """The number of vectors, their sums, and per component its unit vector and variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n``. The whole part of the mean is taken off in integers, so no digit is lost to the shift."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - np.array(whole, np.int64)).astype(float) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.variances)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of ``(n * x - sums) ** 2``, exact; an error where it is no 64-bit integer."""
        largest = max(abs(self.n * int(x.max(initial=0))), abs(self.n * int(x.min(initial=0)))) + max(map(abs, self.sums), default=0)
        if largest < 1 << 62:
            away = self.n * x - np.array(self.sums, np.int64)
            if float(np.abs(away).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2**62:
                return (away * away).sum(1).tolist()
        found = [sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums)) for row in x.tolist()]
        if max(found, default=0) >= 1 << 63:
            raise OverflowError("a deviation does not fit 64 bits")
        return found


def _orthogonal(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in others:
            v = v - (other @ v) * other
    return v


def fit(vectors: DataFrame, count: int = COMPONENTS) -> Whitening | None:
    """Components of a table's only column, a list of numbers; ``None`` without usable vectors.

    A pass over the rows per step: at most as many steps as dimensions, fewer once the wanted components have settled to double
    precision. Directions without variance are no components.
    """
    # Low and high halves apart: no sum of a task leaves 64 bits.
    first = _totals(vectors, lambda x: np.concatenate([[len(x)], (x & _LOW).sum(0), (x >> 31).sum(0)]), "long")
    if not len(first) or first[0] == 0:
        return None
    n, wide = int(first[0]), (len(first) - 1) // 2
    sums = [int(low) + (int(high) << 31) for low, high in zip(first[1 : 1 + wide], first[1 + wide :])]
    base = Whitening(n, sums, np.zeros((0, wide)), np.zeros(0), 0.0)
    trace = float(_totals(vectors, lambda x: np.array([(base.centred(x) ** 2).sum()]))[0]) / n
    size = np.sqrt(trace)
    if not wide or size == 0:
        return base
    wanted = min(count, wide)
    random = np.random.default_rng(11)

    def fresh(known):
        """A random direction orthogonal to the known ones, after the space of the last one is used up."""
        while True:
            v = _orthogonal(random.standard_normal(wide), known)
            if np.linalg.norm(v) > 1e-6:
                return v / np.linalg.norm(v)

    right, short, images = [], [], []  # v_j; w_j with u_j = A w_j; A' u_j
    alphas, betas = [], []  # the bidiagonal matrix: B[j, j] and B[j, j + 1]
    v, beta = fresh([]), 0.0
    while True:
        w = v - beta * short[-1] if right and beta else v
        right.append(v)
        image, norm = None, None
        # Twice is enough: the second pass takes off what rounding left of the earlier left vectors in the first.
        for _ in range(2):
            known = np.array(short).reshape(len(short), wide)

            def products(x, w=w, known=known):
                a = base.centred(x)
                u = a @ w
                return np.concatenate([[u @ u], a.T @ u, (a @ known.T).T @ u])

            found = _totals(vectors, products)
            squared, image, inner = found[0] / n, found[1 : 1 + wide] / n, found[1 + wide :] / n
            norm = np.sqrt(max(0.0, squared - inner @ inner))
            w = w - inner @ known if len(known) else w
            image = image - inner @ np.array(images).reshape(len(images), wide) if len(known) else image
            if len(known) == 0 or np.abs(inner).max() <= 1e-9 * max(norm, size * NOTHING):
                break
        if norm > size * NOTHING:
            alphas.append(float(norm))
            short.append(w / norm)
            images.append(image / norm)
        else:
            alphas.append(0.0)
            short.append(np.zeros(wide))
            images.append(np.zeros(wide))
        if len(right) == wide:
            break
        # The image already lacks nothing but rounding along earlier right vectors.
        v = _orthogonal(images[-1] - alphas[-1] * right[-1], right)
        beta = float(np.linalg.norm(v))
        settled = beta <= size * NOTHING
        betas.append(0.0 if settled else beta)
        if settled:
            v, beta = fresh(right), 0.0
        else:
            v = v / beta
        if not settled and len(right) >= wanted + 1:
            left, values, _ = np.linalg.svd(_bidiagonal(alphas, betas[:-1]))
            if np.abs(betas[-1] * left[-1, :wanted]).max() <= 1e-15 * values[0] and values[wanted - 1] > size * 1e-6:
                betas.pop()
                break
    _, values, turned = np.linalg.svd(_bidiagonal(alphas, betas))
    keep = int((values[:wanted] > size * 1e-7).sum())
    components = turned[:keep] @ np.array(right)
    model = Whitening(n, sums, components, values[:keep] ** 2, trace)
    if keep:
        means = _totals(vectors, lambda x: model.whitened(x).sum(0)) / n

        def spread(x):
            z = model.whitened(x) - means
            return (z.T @ z).ravel()

        model.identity_error = float(np.abs(_totals(vectors, spread).reshape(keep, keep) / n - np.eye(keep)).max())
    return model


def _bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    return np.diag(alphas) + (np.diag(betas, 1) if betas else 0)


_OUT = "{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, key: str, vector: str, count: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component, numbered from 1 by falling variance.

    Vectors that are null or hold null or non-finite entries take no part. Repeated rows count as often as they are there, a null
    key is kept. Without variance there are no components and so no rows. Other columns are ignored.
    """
    model = fit(df.select(F.col(vector)), count)
    schema = _OUT.format(key=key)
    if model is None or not len(model.variances):
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        kept = len(model.variances)
        share = model.variances / model.trace
        for batch in batches:
            for first, rows in _parts(batch.column(1)):
                good, x = integers(batch.column(1).slice(first, rows))
                if not len(x):
                    continue
                keys = batch.column(0).slice(first, rows).filter(pa.array(good))
                again = np.repeat(np.arange(len(x)), kept)
                deviation = np.array(model.deviation(x), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(again)),
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(again), model.n, np.int64)),
                        pa.array(deviation[again]),
                        pa.array(model.whitened(x).ravel()),
                        pa.array(np.tile(share, len(x))),
                        pa.array(np.full(len(again), model.identity_error)),
                    ],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return df.select(F.col(key).cast("long").alias(key), F.col(vector)).mapInArrow(run, schema)
