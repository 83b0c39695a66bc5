"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its evidence are counts over its own bytes and words and over its neighbours'; the
chain's transition weights make neighbouring labels agree. Forward-backward gives each line's probability of being
good, and the document's score is their mean, weighted by the lines' bytes, brought to the scale of the labels. The weights are fitted here, by gradient
steps on the conditional likelihood of a bounded sample of labelled documents.

Labels are known for documents only. Fitting begins with every line labelled like its document; then lines are labelled anew, by
the chain's own marginals together with how many lines of a good and of a bad document are expected to be good (``GOOD_LINES``), and the
weights are fitted to these (expectation and maximisation, ``ROUNDS`` times). So a bad document may have good lines, and the
transition weights learn how often the label changes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from tableflow.llm.batches import NOT_BLANK, Words, binaries, extend, utf8

SAMPLE = 3000  # labelled documents to fit on
STEPS = 60
ROUNDS, ROUND_STEPS = 6, 40
GOOD_LINES = {1: 0.97, 0: 0.7}
RIDGE = 1e-3

_UPPER, _LOWER, _DIGIT, _BANG, _BAR, _SYMBOL, _MARK, _BLANK, _HIGH, _REST = range(10)
_CLASS = np.full(256, _REST, np.int64)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = _UPPER, _LOWER, _DIGIT, _HIGH
_CLASS[list(b"#$%&*@^~<>=_+`\\{}[]/")] = _SYMBOL
_CLASS[list(b".,;:?'\"()-")] = _MARK
_CLASS[list(b" \t\r\v\f")] = _BLANK
_CLASS[ord("!")], _CLASS[ord("|")] = _BANG, _BAR
OWN = 14  # features of one line
FEATURES = 3 * OWN + 1  # its own, both neighbours', and a constant


@dataclass
class Lines:
    """Lines of a slice that are not empty: features, bytes, and each row's first line."""

    features: np.ndarray
    sizes: np.ndarray
    first: np.ndarray


def lines_of(column: pa.Array) -> Lines:
    buffer, offsets = utf8(column)
    if not len(buffer):
        return Lines(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(len(column) + 1, np.int64))
    cuts = np.zeros(len(buffer), bool)
    cuts[1:] = buffer[:-1] == 0x0A
    cuts[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cuts)
    ends = np.append(starts[1:], len(buffer))
    sizes = ends - starts - (buffer[ends - 1] == 0x0A)
    kind = _CLASS[buffer]
    # The two bytes of Latin capitals and small letters beyond ASCII.
    latin = np.flatnonzero(buffer[:-1] == 0xC3) + 1
    kind[latin] = np.where(buffer[latin] < 0x9F, _UPPER, _LOWER)
    line = np.cumsum(cuts) - 1
    counts = np.bincount(line * 10 + kind, minlength=10 * len(starts)).reshape(-1, 10)
    words = Words(buffer, offsets, NOT_BLANK)
    of = line[words.starts]
    hashes = words.hashes(buffer)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])) if len(words) else np.zeros(0, np.int64)
    n_words = np.bincount(of, minlength=len(starts))
    repeats = np.bincount(of[again], minlength=len(starts))
    capital = np.bincount(of[kind[words.starts] == _UPPER], minlength=len(starts))
    some = sizes > 0
    counts, sizes, n_words, repeats, capital, starts = (x[some] for x in (counts, sizes, n_words, repeats, capital, starts))
    length = np.maximum(sizes, 1)
    own = np.column_stack(
        [counts[:, :9] / length[:, None], np.log1p(sizes), np.log1p(n_words), repeats / np.maximum(n_words, 1), capital / np.maximum(n_words, 1), length / np.maximum(n_words, 1) / 10]
    )
    first = np.searchsorted(starts, offsets)
    features = np.zeros((len(own), FEATURES))
    features[:, :OWN], features[:, -1] = own, 1
    inner = np.ones(len(own), bool)
    inner[first[:-1][np.diff(first) > 0]] = False  # lines with a line before them in their document
    at = np.flatnonzero(inner)
    features[at, OWN : 2 * OWN] = own[at - 1]
    features[at - 1, 2 * OWN : 3 * OWN] = own[at]
    return Lines(features, sizes.astype(float), first)


def forward_backward(scores: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of being good, and the expected numbers of transitions.

    ``scores``: log-odds of good from each line's own evidence; ``steps``: log weights of the 2 x 2 transitions. The
    chains go on together, line by line; a chain leaves when it ends.
    """
    weight = np.exp(steps)
    evidence = np.column_stack([np.ones(len(scores)), np.exp(np.clip(scores, -30, 30))])
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = first[:-1][order], lengths[order]
    alive = [int(n) for n in np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), "left")]
    ahead, back = np.zeros_like(evidence), np.ones_like(evidence)
    for t, n in enumerate(alive):
        at = begin[:n] + t
        here = evidence[at] if t == 0 else ahead[at - 1] @ weight * evidence[at]
        ahead[at] = here / here.sum(1, keepdims=True)
    for t in range(len(alive) - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        here = (evidence[at + 1] * back[at + 1]) @ weight.T
        back[at] = here / here.sum(1, keepdims=True)
    both = ahead * back
    good = both[:, 1] / both.sum(1)
    inner = np.ones(len(scores), bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False
    at = np.flatnonzero(inner)
    pair = ahead[at][:, :, None] * weight * (evidence[at + 1] * back[at + 1])[:, None, :]
    return good, (pair / pair.sum((1, 2), keepdims=True)).sum(0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    empty: float  # score of a text without lines: the share of good documents in the sample
    slope: float = 1.0  # of the document's log-odds over those of the mean
    shift: float = 0.0

    def marginals(self, lines: Lines) -> np.ndarray:
        """Each line's probability of being good."""
        return forward_backward((lines.features - self.mean) / self.scale @ self.weights, lines.first, self.steps)[0]

    def score(self, lines: Lines) -> np.ndarray:
        good = self.marginals(lines)
        totals = np.concatenate([[[0, 0]], np.cumsum(np.column_stack([good * lines.sizes, lines.sizes]), 0)])
        part = totals[lines.first[1:]] - totals[lines.first[:-1]]
        mean = part[:, 0] / np.maximum(part[:, 1], 1)
        return np.where(np.diff(lines.first) > 0, 1 / (1 + np.exp(-(self.slope * _log_odds(mean) + self.shift))), self.empty)


def _log_odds(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def _scale(odds: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic regression with one input, by Newton's steps, halved until they improve it."""
    x, start = np.column_stack([odds, np.ones(len(odds))]), np.array([1.0, 0.0])

    def loss(at):
        signed = np.where(labels == 1, -1, 1) * (x @ at)
        return np.logaddexp(0, signed).mean() + RIDGE / 2 * ((at - start) ** 2).sum()

    found = start
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + RIDGE * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (labels - p) / len(x) - RIDGE * (found - start))
        while np.abs(step).max() > 1e-9 and loss(found + step) > loss(found):
            step = step / 2
        found = found + step
    return (float(found[0]), float(found[1])) if found[0] > 0 else (1.0, 0.0)


def train(documents: list[Lines], labels: list[int]) -> Model:
    """Weights by Adam steps; without documents, or with one label only, a constant score."""
    share = float(np.mean(labels)) if labels else 0.5
    if not documents or share in (0.0, 1.0) or not sum(len(d.sizes) for d in documents):
        odds = 0.0 if not labels or 0 < share < 1 else (8.0 if share else -8.0)
        weights = np.zeros(FEATURES)
        weights[-1] = odds
        return Model(np.zeros(FEATURES), np.ones(FEATURES), weights, np.zeros((2, 2)), share)
    x = np.concatenate([d.features for d in documents])
    counts = [len(d.sizes) for d in documents]
    first = np.append(0, np.cumsum(counts))
    y = np.repeat(np.array(labels, float), counts)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    observed = np.zeros((2, 2))
    for label, n in zip(labels, counts):
        observed[label, label] += max(0, n - 1)
    n = len(documents)
    params = np.zeros(FEATURES + 4)

    def improved(params, y, observed, steps):
        m, v = 0.0, 0.0
        for step in range(1, steps + 1):
            good, pairs = forward_backward(x @ params[:FEATURES], first, params[FEATURES:].reshape(2, 2))
            gradient = np.concatenate([x.T @ (y - good), (observed - pairs).ravel()]) / n - RIDGE * params
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            params = params + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return params

    params = improved(params, y, observed, STEPS)
    prior = _log_odds(np.where(y == 1, GOOD_LINES[1], GOOD_LINES[0]))
    for _ in range(ROUNDS):
        guessed, changes = forward_backward(x @ params[:FEATURES] + prior, first, params[FEATURES:].reshape(2, 2))
        params = improved(params, guessed, changes, ROUND_STEPS)
    model = Model(mean, scale, params[:FEATURES], params[FEATURES:].reshape(2, 2), share)
    whole = Lines(np.concatenate([d.features for d in documents]), np.concatenate([d.sizes for d in documents]), first)
    some = np.diff(first) > 0
    model.slope, model.shift = _scale(_log_odds(model.score(whole)[some]), np.array(labels, float)[some])
    return model


def remainder(key: str) -> Column:
    """crc32 of the key as text, modulo 3; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3


def fit(documents: DataFrame, key: str, text: str, labels: DataFrame, label: str, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents whose remainder is not 1, the first by a hash of the key.

    The sampled keys (at most ``sample``, so they can be broadcast) pick the documents; line features come to the
    driver. Labels that are null or neither 0 nor 1 are left out; several labels of one key: the smallest.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (remainder(key) != 1))
        .groupBy(F.col(key).alias("__key"))
        .agg(F.min(label).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__key"), "__key")
        .limit(sample)
    )
    rows = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__key")
    fields = StructType([StructField("__features", BinaryType()), StructField("__sizes", BinaryType())])

    def features(columns):
        lines = lines_of(columns[0])
        return [
            binaries(np.ascontiguousarray(lines.features, np.float32).tobytes(), lines.first * FEATURES * 4),
            binaries(np.ascontiguousarray(lines.sizes, np.float64).tobytes(), lines.first * 8),
        ]

    found = extend(rows, [F.col("__text")], fields, features, ["__label", "__key"]).collect()
    found.sort(key=lambda r: (r["__key"], bytes(r["__features"])))
    parts = []
    for row in found:
        own = np.frombuffer(row["__features"], np.float32).reshape(-1, FEATURES).astype(float)
        parts.append(Lines(own, np.frombuffer(row["__sizes"]), np.array([0, len(own)])))
    return train(parts, [row["__label"] for row in found])


def score(documents: DataFrame, text: str, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``documents`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on). Texts without lines, also nulls, get
    the share of good documents in the sample."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(columns):
        value = shared.value.score(lines_of(columns[0]))
        return [pa.array(value), pa.array((value >= 0.5).astype(np.int32))]

    return extend(documents, [F.col(text)], StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())]), run, keep)


def keep_good(documents: DataFrame, key: str, text: str, labels: DataFrame, label: str) -> DataFrame:
    """The rows of ``documents`` that are predicted good, same columns."""
    names = documents.columns
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    place = {name.lower(): f"c{i}" for i, name in enumerate(names)}
    model = fit(plain.withColumnRenamed(place[key.lower()], key), key, place[text.lower()], labels, label)
    return score(plain, place[text.lower()], model).where("predicted = 1").select(*plain.columns).toDF(*names)
