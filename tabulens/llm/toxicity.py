"""Toxic spans by a linear-chain conditional random field, summed up to document scores."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import map_rows, one_text_each, text_of

# Labelled rows of each class that the tagger is fitted on at most (those with the least hash of
# their id), and the characters of them at most.
SAMPLE = 2000
SAMPLE_CHARS = 16_000_000
FOLDS = 5
BUCKETS = 1 << 18
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7), (3, 4)
# Evidence (log likelihood ratio over the labelled texts) from which a word or beginning of words
# marks a token of a toxic text as toxic.
EVIDENCE = 10.0
CHAIN = 128
MEMO = 400_000
EDGE = b".,;:!?\"'()[]{}#*$%&|<>-_/\\"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def patterns(word: bytes) -> list[bytes]:
    """The word itself and the beginnings of it that are shorter."""
    return [word + b"$", *[word[:n] for n in PREFIXES if n < len(word)]]


def buckets(token: bytes) -> list[int]:
    """Features of a token: its bare word, beginnings and endings, whether it is bare, and a constant."""
    word = token.strip(EDGE)
    names = [
        b"w" + word,
        *[b"p" + word[:n] for n in PREFIXES if len(word) >= n],
        *[b"s" + word[-n:] for n in SUFFIXES if len(word) >= n],
        b"bare" if word == token else b"edged",
        b"one",
    ]
    return [zlib.crc32(name) % BUCKETS for name in names]


def chain(
    emission: np.ndarray, sizes: np.ndarray, turn: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Forward and backward passes over many chains at once, for two tags.

    ``emission`` holds, chain after chain, the score of tag 1 against tag 0; ``turn[a, b]`` scores tag
    b after tag a. Returns the probability of tag 1 of each token, of the four tag pairs of each token
    and the one before it (zero at the first), and the total log normaliser.
    """
    n = len(emission)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left") if longest else np.zeros(0, int)
    forward, backward = np.zeros((2, n))
    w = np.exp(turn)
    total = 0.0
    # Messages are log odds of tag 1; the normaliser is gathered on the way.
    for t in range(longest):
        at = starts[: active[t]] + t
        if t == 0:
            odds = np.zeros(len(at))
        else:
            m = forward[at - 1]
            p = 1 / (1 + np.exp(-m))
            one, zero = p * w[1, 1] + (1 - p) * w[0, 1], p * w[1, 0] + (1 - p) * w[0, 0]
            total += np.log(zero).sum() + np.logaddexp(0, m).sum()
            odds = np.log(one) - np.log(zero)
        forward[at] = odds + emission[at]
        ended = at[sizes[: active[t]] == t + 1]
        total += np.logaddexp(0, forward[ended]).sum()
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        m = backward[at + 1] + emission[at + 1]
        p = 1 / (1 + np.exp(-m))
        backward[at] = np.log(w[1, 0] * (1 - p) + w[1, 1] * p) - np.log(w[0, 0] * (1 - p) + w[0, 1] * p)
    marginal = 1 / (1 + np.exp(-(forward + backward)))
    pairs = np.zeros((n, 2, 2))
    later = np.ones(n, bool)
    later[starts[sizes > 0]] = False
    at = np.flatnonzero(later)
    before, after = forward[at - 1], emission[at] + backward[at]
    score = np.stack(
        [[np.zeros(len(at)) + turn[0, 0], turn[0, 1] + after], [before + turn[1, 0], before + after + turn[1, 1]]]
    )
    score = np.exp(score - score.max(axis=(0, 1)))
    pairs[at] = np.moveaxis(score / score.sum(axis=(0, 1)), -1, 0)
    return marginal, pairs, forward + backward, total


class Emissions(dict):
    """Scores of tag 1 by token, worked out when first asked for; started anew when full."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights.tolist()

    def __missing__(self, token: bytes) -> float:
        if len(self) >= MEMO:
            self.clear()
        weights = self.weights
        score = self[token] = sum([weights[b] for b in buckets(token)])
        return score


@dataclass(frozen=True)
class Tagger:
    """Feature weights and tag transitions, and the curve from tags to a document's score."""

    weights: np.ndarray
    turn: np.ndarray
    curve: np.ndarray

    def tag(self, texts: list[list[bytes]], known: Emissions) -> tuple[np.ndarray, np.ndarray]:
        """The tag probability of every token and the score of every text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        emission = np.fromiter((known[w] for words in texts for w in words), float, int(sizes.sum()))
        marginal, _, odds, _ = chain(emission, sizes, self.turn)
        told = summaries(marginal, odds, sizes)
        return marginal, 1 / (1 + np.exp(-np.clip(told @ self.curve, -30, 30)))


def summaries(marginal: np.ndarray, odds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text: a constant, its highest log odds, and the log of its expected toxic tokens."""
    out = np.tile(np.array([1.0, -8.0, np.log(1e-3)]), (len(sizes), 1))
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full, 1] = np.clip(np.maximum.reduceat(odds, starts), -8, 8)
        out[full, 2] = np.log(1e-3 + np.add.reduceat(marginal, starts))
    return out


def labelled_texts(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, chars: int
) -> list[tuple[int, str]]:
    """``(label, text)`` of a bounded sample of the labelled rows outside the held-out fold.

    Repeated rows count once; of several texts of one id that of least hash is taken.
    """
    key = F.col(f"`{id_col}`")
    chosen = (
        labels.select(key.alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .dropna()
        .where(~held_out("id"))
        .distinct()
    )
    order = (F.xxhash64(F.lit(3), "id"), "id")
    chosen = chosen.where("label = 1").orderBy(*order).limit(most).union(
        chosen.where("label = 0").orderBy(*order).limit(most)
    )
    texts = docs.select(key.alias("id"), text_of(text_col).alias("text"))
    rows = one_text_each(texts.join(F.broadcast(chosen), "id"))
    # At most 2 * most rows: one small group.
    upto = Window.partitionBy("label").orderBy(F.length("text"), "id")
    rows = rows.withColumn("chars", F.sum(F.length("text")).over(upto)).where(F.col("chars") <= chars)
    table = rows.select("label", "text").toArrow()
    return list(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(FOLDS)) == 0


def without_copies(docs: list[tuple[int, np.ndarray]], distinct: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """One text of each group that shares half of the eight least hashes of its words."""
    marks = np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct))
    seen: dict[int, set[int]] = {}
    out = []
    for label, words in docs:
        least = np.unique(marks[words])[:8].tolist()
        shared = Counter(k for m in least for k in seen.get(m, ()))
        if least and any(n * 2 >= len(least) for n in shared.values()):
            continue
        for m in least:
            seen.setdefault(m, set()).add(len(out))
        out.append((label, words))
    return out


def toxic_patterns(docs: list[tuple[int, np.ndarray]], distinct: list[bytes]) -> set[bytes]:
    """Words and beginnings of words found so much more in toxic texts that chance is ruled out."""
    found: tuple[Counter, Counter] = (Counter(), Counter())
    for label, words in docs:
        bare = {distinct[k].strip(EDGE) for k in set(words.tolist())}
        found[label].update({p for w in bare for p in patterns(w) if len(p) > 3})
    share = sum(label for label, _ in docs) / max(1, len(docs))
    out = set()
    for pattern, n in found[1].items():
        other = found[0][pattern]
        if n > (n + other) * share:
            evidence = n * np.log(n / ((n + other) * share))
            if other:
                evidence += other * np.log(other / ((n + other) * (1 - share)))
            # A pattern must also be rare outside toxic texts, or it would mark common words.
            if evidence >= EVIDENCE and n >= 4 * other:
                out.add(pattern)
    return out


def fit(sample: list[tuple[int, str]], rounds: int = 40) -> Tagger | None:
    """A tagger from texts labelled toxic or not, or None without both.

    The tokens' labels come from the texts': in a toxic text the tokens that show a toxic pattern are
    toxic, all others are not. The field is then fitted to these tags by its likelihood, on chains of
    ``CHAIN`` tokens, and the document curve to the labels of the texts.
    """
    seen: dict[bytes, int] = {}
    docs = [
        (label, np.array([seen.setdefault(w, len(seen)) for w in tokens(text)], np.int64))
        for label, text in sample
    ]
    distinct = list(seen)
    docs = without_copies(docs, distinct)
    if len({label for label, _ in docs}) < 2:
        return None
    marks = toxic_patterns(docs, distinct)
    words = np.concatenate([doc for _, doc in docs])
    shown = np.array([any(p in marks for p in patterns(w.strip(EDGE))) for w in distinct], bool)
    sizes = np.array([len(doc) for _, doc in docs], np.int64)
    label = np.array([label for label, _ in docs], float)
    gold = shown[words] & (np.repeat(label, sizes) == 1)
    features = [np.array(buckets(w), np.int32) for w in distinct]
    row = np.repeat(np.arange(len(distinct), dtype=np.int32), [len(f) for f in features])
    column = np.concatenate(features)
    del features
    parts = np.concatenate([np.full(n // CHAIN, CHAIN).tolist() + [n % CHAIN] * (n % CHAIN > 0) for n in sizes.tolist()])
    parts = parts.astype(np.int64)
    first = np.zeros(len(words), bool)
    first[(np.cumsum(parts) - parts)[parts > 0]] = True
    later = np.flatnonzero(~first)
    told = np.zeros((2, 2))
    np.add.at(told, (gold[later - 1].astype(int), gold[later].astype(int)), 1)
    weights, turn = np.zeros(BUCKETS), np.zeros((2, 2))
    power, turn_power = np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        emission = np.bincount(row, weights[column], len(distinct))[words]
        marginal, pairs, _, _ = chain(emission, parts, turn)
        error = np.bincount(words, marginal - gold, len(distinct))
        step = np.bincount(column, error[row], BUCKETS) + 0.05 * weights
        turn_step = pairs.sum(axis=0) - told + 0.05 * turn
        power += step**2
        turn_power += turn_step**2
        weights -= 0.5 * step / np.sqrt(power)
        turn -= 0.5 * turn_step / np.sqrt(turn_power)
    emission = np.bincount(row, weights[column], len(distinct))[words]
    marginal, _, odds, _ = chain(emission, sizes, turn)
    return Tagger(weights.astype(np.float32), turn, _curve(summaries(marginal, odds, sizes), label))


def _curve(told: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic weights from text summaries to labels."""
    at = np.zeros(told.shape[1])
    for _ in range(100):
        guess = 1 / (1 + np.exp(-np.clip(told @ at, -30, 30)))
        bend = (told * (guess * (1 - guess))[:, None]).T @ told + 0.1 * np.eye(len(at))
        move = np.linalg.solve(bend, told.T @ (guess - label) + 0.1 * at)
        at = at - move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
    return at


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most: int = SAMPLE,
    chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """``held_out``, ``score``, ``predicted`` and the toxic ``spans`` of each text.

    The tagger is fitted on labelled rows whose id is not in the held-out fold, at most ``most`` of
    each class and ``chars`` characters of a class. Spans are character ranges of tokens that are
    toxic with a probability of a half or more. A null text is empty; an empty text has a score too,
    and no spans. Without labels of both classes all scores are 0. One row per row, repeated rows
    included; a null id is not held out; other columns are not read.
    """
    tagger = fit(labelled_texts(docs, labels, id_col, text_col, label_col, most, chars))

    def rows(columns: list) -> Iterator[tuple]:
        known = Emissions(tagger.weights) if tagger else None
        for begin in range(0, len(columns[0]), 4096):
            keys, held, texts = (c[begin : begin + 4096] for c in columns)
            if known is None:
                for key, one in zip(keys, held, strict=True):
                    yield key, one, 0.0, 0, []
                continue
            parts = [tokens(t) for t in texts]
            marginal, scores = tagger.tag(parts, known)
            ends = np.cumsum([len(p) for p in parts])
            starts = ends - np.array([len(p) for p in parts], np.int64)
            for k, (key, one, score) in enumerate(zip(keys, held, scores.tolist(), strict=True)):
                hot = np.flatnonzero(marginal[starts[k] : ends[k]] >= 0.5)
                spans = _spans(texts[k], hot) if len(hot) else []
                yield key, one, score, int(score >= 0.5), spans

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(
        F.col(f"`{id_col}`"), F.coalesce(held_out(id_col), F.lit(False)), text_of(text_col).alias("text")
    )
    return map_rows(
        picked,
        rows,
        f"`{id_col}` {kind}, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>",
    )


def _spans(text: str, hot: np.ndarray) -> list[dict[str, int]]:
    """Character ranges of the tokens numbered ``hot``; neighbours are one range."""
    wanted = set(hot.tolist())
    out: list[dict[str, int]] = []
    last = -2
    for k, match in enumerate(WORD.finditer(text)):
        if k in wanted:
            if k == last + 1:
                out[-1]["end"] = match.end()
            else:
                out.append({"start": match.start(), "end": match.end()})
            last = k
    return out
