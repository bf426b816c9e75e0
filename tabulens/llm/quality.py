"""Quality rules: counts against fixed bounds, then a calibrated classifier over hashed n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import map_rows, map_stream, one_text_each, ship, text_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PCT = 30
# Labelled rows the classifier is fitted on at most, those with the least hash of their id, and
# characters of their texts; beyond these the longest texts are left out.
SAMPLE, SAMPLE_CHARS = 3000, 24_000_000
# N-grams of fewer texts of the sample have no weight.
LEAST_TEXTS = 4
# Texts whose calibrated probability of being good is below this are rejected.
THRESHOLD = 0.3
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
FAMILIES = ("byte pairs", "byte fours", "words", "word pairs")
ODD = np.uint64(0x9E3779B97F4A7C15)
CELLS = 1 << 20


class Counts(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED_PCT * self.n_words


class Read(NamedTuple):
    """A text's bytes, its distinct words, and its words as their numbers among these."""

    data: bytes
    distinct: list[bytes]
    words: np.ndarray


def read(text: str) -> Read:
    data = text.encode("utf-8", "surrogatepass")
    seen: dict[bytes, int] = {}
    words = [seen.setdefault(w, len(seen)) for w in data.split()]
    return Read(data, list(seen), np.array(words, np.int64))


def counts(text: str, found: Read) -> Counts:
    """What the rules count; words are runs without ASCII white space."""
    lines = [line for line in found.data.split(b"\n") if line.strip()]
    return Counts(
        len(found.words),
        len(text) - sum(text.count(c) for c in " \t\n\v\f\r"),
        sum(found.data.count(bytes([s])) for s in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(found.words),
    )


def repeated_words(words: np.ndarray) -> int:
    """Words that lie in a window of ``WINDOW`` words which the text has more than once."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    # Windows of four levels: each level numbers the pairs of the one before, so equality is exact.
    level, width = words, 1
    while width < WINDOW:
        pairs = level[:-width] * np.int64(len(words) + 1) + level[width:]
        _, level = np.unique(pairs, return_inverse=True)
        width *= 2
    often = np.bincount(level)[level] > 1
    if not often.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _bucket(values: np.ndarray) -> np.ndarray:
    return ((values * ODD) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def grams(found: Read) -> list[np.ndarray]:
    """The bucket of every n-gram of a text, family by family."""
    b = np.frombuffer(found.data, np.uint8).astype(np.uint64)
    two = b[:-1] | b[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16) if len(two) > 2 else two[:0]
    own = np.fromiter(map(zlib.crc32, found.distinct), np.uint64, len(found.distinct))
    words = own[found.words] + np.uint64(1)
    # All pairs of a word and itself share a bucket.
    pairs = np.where(words[:-1] == words[1:], 0, words[:-1] * np.uint64(0x2545F4914F6CDD1D) + words[1:])
    return [_bucket(two + np.uint64(1)), _bucket(four + np.uint64(1)), _bucket(words), _bucket(pairs)]


@dataclass(frozen=True)
class Classifier:
    """Weights by family and bucket: a score is the sum over families of the mean weight of a text."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, found: Read) -> float:
        score = self.bias + sum(
            float(w[g].mean()) for w, g in zip(self.weights, grams(found), strict=True) if len(g)
        )
        return float(1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -30, 30))))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """``id, label, text`` of at most ``most`` labelled ids, those of least hash.

    An id labelled twice has its least label; of several texts of an id that of least hash is taken.
    """
    picked = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .dropna()
        .groupBy("id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_of("text").alias("text"))
    rows = one_text_each(texts.join(F.broadcast(picked), "id"))
    # At most ``most`` rows: one small group.
    upto = Window.orderBy(F.length("text"), "id")
    return rows.withColumn("chars", F.sum(F.length("text")).over(upto)).where(F.col("chars") <= SAMPLE_CHARS).drop("chars")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", most: int = SAMPLE) -> Classifier | None:
    """A classifier of ``labels.quality``, or None where the labelled rows have one class only.

    Four fifths of a sample of at most ``most`` labelled rows fit the weights, the others calibrate
    the probabilities (a logistic curve over their scores). The bounded sample is fitted in one task;
    only its weights come to the driver.
    """

    def features(columns: list) -> Iterator[tuple]:
        for key, label, text in zip(*columns, strict=True):
            buckets, shares = [], []
            for k, family in enumerate(grams(read(text))):
                values, times = np.unique(family, return_counts=True)
                buckets.append((k * BUCKETS + values).astype(np.int32))
                shares.append((times / max(1, len(family))).astype(np.float32))
            yield key, label, np.concatenate(buckets).tobytes(), np.concatenate(shares).tobytes()

    def learn(batches: Iterator[list]) -> Iterator[tuple]:
        labelled, folds, buckets, shares = [], [], [], []
        for label, fold, columns, values in batches:
            labelled += label
            folds += fold
            buckets += [np.frombuffer(c, np.int32) for c in columns]
            shares += [np.frombuffer(v, np.float32) for v in values]
        y, fold = np.array(labelled, float), np.array(folds)
        if len(set(labelled)) == 2:
            model = _learnt(buckets, shares, y, fold != 0)
            yield model.weights.tobytes(), model.bias, model.slope, model.shift

    sample = labelled_sample(docs, labels, id_col, "quality", most)
    kind = dict(sample.dtypes)["id"]
    rows = map_rows(sample, features, f"id {kind}, label int, buckets binary, shares binary")
    fold = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(5)).cast("int")
    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").select("label", fold, "buckets", "shares")
    found = map_stream(one, learn, "weights binary, bias double, slope double, shift double").first()
    if found is None:
        return None
    weights = np.frombuffer(found.weights, np.float32).reshape(len(FAMILIES), BUCKETS)
    return Classifier(weights, found.bias, found.slope, found.shift)


def _learnt(buckets: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, train: np.ndarray) -> Classifier:
    """The classifier of texts given by their buckets and the shares of these."""
    size = len(FAMILIES) * BUCKETS
    texts = np.zeros(size, np.int64)
    for columns in buckets:
        texts[columns] += 1
    often = texts >= min(LEAST_TEXTS, len(y))
    for k, columns in enumerate(buckets):
        kept = often[columns]
        buckets[k], shares[k] = columns[kept], shares[k][kept]
    row = np.repeat(np.arange(len(y), dtype=np.int32), [len(c) for c in buckets])
    column, value = np.concatenate(buckets), np.concatenate(shares)
    buckets.clear()
    shares.clear()
    x = Sparse(row, column, value, len(y))
    if len(set(y[train].tolist())) < 2:
        train[:] = True
    weights, bias, usual = _logistic(x, y, train)
    score = x.dot(weights) + bias
    weights /= usual
    held = ~train if len(set(y[~train].tolist())) == 2 else train
    slope, shift = _curve(score[held], y[held])
    return Classifier(weights.reshape(len(FAMILIES), BUCKETS).astype(np.float32), bias, slope, shift)


@dataclass
class Sparse:
    """Cells of a matrix with a row per text and a column per bucket."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    rows: int

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The cells, some at a time, so that nothing of their number is made of them."""
        for k in range(0, len(self.row), CELLS):
            yield self.row[k : k + CELLS], self.column[k : k + CELLS], self.value[k : k + CELLS]

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return sum(
            (np.bincount(row, weights[column] * value, self.rows) for row, column, value in self.slices()),
            np.zeros(self.rows),
        )

    def back(self, errors: np.ndarray, size: int) -> np.ndarray:
        return sum(
            (np.bincount(column, errors[row] * value, size) for row, column, value in self.slices()),
            np.zeros(size),
        )

    def divide(self, by: np.ndarray) -> None:
        for _, column, value in self.slices():
            value /= by[column]


def _logistic(x: Sparse, y: np.ndarray, train: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights by gradient steps that adapt to each bucket; classes count alike.

    Divides the cells of ``x`` by the usual size of their bucket, which comes third.
    """
    size = len(FAMILIES) * BUCKETS
    part = np.where(y == 1, 0.5 / max(1, (y[train] == 1).sum()), 0.5 / max(1, (y[train] == 0).sum())) * train
    # A bucket's share is taken against its usual size, so rare and common n-grams can weigh alike.
    usual = np.sqrt(x.back(part, size) + 1e-3)
    x.divide(usual)
    weights, bias = np.zeros(size), 0.0
    power, bias_power = np.full(size, 1e-10), 1e-10
    for _ in range(rounds):
        guess = 1 / (1 + np.exp(-np.clip(x.dot(weights) + bias, -30, 30)))
        errors = (guess - y) * part
        step = x.back(errors, size) + 1e-5 * weights
        power += step**2
        bias_power += errors.sum() ** 2
        weights -= 0.1 * step / np.sqrt(power)
        bias -= 0.1 * errors.sum() / np.sqrt(bias_power)
    return weights, float(bias), usual


def _curve(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through 0/1 labels, with smoothed targets."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    middle, width = score.mean(), score.std() + 1e-9
    basis = np.stack([(score - middle) / width, np.ones_like(score)])
    at = np.zeros(2)
    for _ in range(200):
        guess = 1 / (1 + np.exp(-np.clip(at @ basis, -30, 30)))
        slope = basis @ (guess - target) + 0.5 * at
        bend = (basis * (guess * (1 - guess))) @ basis.T + 0.5 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        at = at - move * min(1.0, 1.0 / (np.abs(move).max() + 1e-12))
    return float(at[0] / width), float(at[1] - at[0] * middle / width)


def verdict(text: str, model: Classifier | None, threshold: float) -> tuple[Counts, bool, float, bool]:
    """The counts of a text, whether they fail it, its probability of being good, and the verdict."""
    found = read(text)
    told = counts(text, found)
    failed = told.failed()
    probability = model.probability(found) if model else 1.0
    return told, failed, probability, not failed and probability >= threshold


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    most: int = SAMPLE,
) -> DataFrame:
    """Counts, ``base_failed``, ``probability`` and ``kept`` of each text.

    A null or empty text has no words and so fails the bounds. Without labels of both classes the
    bounds decide alone and probabilities are 1. One row per row, repeated rows and null ids
    included; other columns are not read; an empty table gives an empty result.
    """
    model = fit(docs.select(F.col(f"`{id_col}`"), text_of(text_col).alias("text")), labels, id_col, most)

    def rows(columns: list) -> Iterator[tuple]:
        for key, text in zip(*columns, strict=True):
            told, failed, probability, kept = verdict(text, model, threshold)
            yield key, *told, failed, kept, probability

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(f"`{id_col}`"), text_of(text_col).alias("text"))
    return map_rows(
        picked,
        rows,
        f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
        " n_repeat_words long, base_failed boolean, kept boolean, probability double",
    )


def keep_good(
    docs: DataFrame,
    labelled: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns as they are.

    The classifier is fitted on the texts of ``labelled`` that ``labels`` names.
    """
    model = fit(labelled.select(F.col(f"`{id_col}`"), text_of(text_col).alias("text")), labels, id_col)
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t or "" for t in batch.column(at).to_pylist())
            yield batch.filter(pa.array([verdict(t, model, threshold)[3] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
