"""Quality classifier from weak labels (operator 8).

Seven heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the
counts of their vote patterns (at most 3^7 rows, counted over all documents) estimates each labeller's
accuracy and the share of bad documents; the posterior of a pattern is the label of its documents. A
logistic scorer on hashed features (4-grams of character classes, bins of word and line repetition) is
trained on the posteriors of a bounded sample and scores every document.
"""

from __future__ import annotations

import hashlib
import re
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import least_by_hash, pieces, spread, staged, table

SAMPLE = 4096  # documents that the scorer is trained on, those with the least hash
HASHED = 1024  # hashed 4-gram features
BINS = 16      # bins of each repetition feature
KEEP = 0.5

_LABELLERS = 7
_WORD, _LINE = re.compile(r"\S+"), re.compile(r"[^\n]+")
# Character classes of a byte: 0 letters and bytes of multi-byte characters, then one class each.
_CLASS = np.zeros(256, np.uint8)
for _n, _chars in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\f\v", "\n", ".,;:", "!?", "|", "#", "$",
                             "%", "&", "*", "()[]{}<>", "'\"-_/\\", "=+~^`@"], 1):
    _CLASS[list(_chars.encode())] = _n
_UPPER, _SYMBOLS, _PIPE = 1, np.isin(np.arange(16), [6, 7, 8, 9, 10, 11, 12, 15]), 7


# Bin of each 4-gram of classes, a number of 16 bits.
_BIN = (np.arange(1 << 16, dtype=np.int64) * 2654435761 >> 16) % HASHED
PIECE = 1_000_000  # bytes of text whose arrays are in memory together


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of each stretch between edges, 0 for an empty one."""
    out = np.zeros(len(edges) - 1)
    some = np.flatnonzero(np.diff(edges))
    if len(some):
        out[some] = np.add.reduceat(values, edges[some], dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    return out


def _word_counts(text: str) -> tuple[int, int, int]:
    """Words, distinct words and words that repeat the one before."""
    if len(text) <= PIECE:
        w = text.split()
        return len(w), len(set(w)), sum(map(eq, w, w[1:]))
    n, echo, last, seen = 0, 0, None, set()
    for m in _WORD.finditer(text):  # a long text is never cut into all its words at once
        word = m[0]
        n, echo, last = n + 1, echo + (word == last), word
        seen.add(word)
    return n, len(seen), echo


def _line_counts(text: str) -> tuple[int, int]:
    """Lines that are not empty, and how many are distinct."""
    if len(text) <= PIECE:
        lines = [x for x in text.split("\n") if x]
        return len(lines), len(set(lines))
    n, seen = 0, set()
    for m in _LINE.finditer(text):
        n += 1
        seen.add(hashlib.blake2b(m[0].encode("utf-8", "replace"), digest_size=16).digest())
    return n, len(seen)


def _grams(data: np.ndarray) -> np.ndarray:
    """4-gram of classes that begins at each byte but the last three, 16 bits each."""
    kind = _CLASS[data].astype(np.uint16)
    gram = kind[:-3].copy() if len(kind) > 3 else np.zeros(0, np.uint16)
    for j in range(1, 4):
        gram |= kind[j:len(kind) - 3 + j] << np.uint16(4 * j)
    return gram


def _gram_sums(data: np.ndarray, edges: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights (by 4-gram) of each text's 4-grams; those that reach into the next text count nowhere."""
    out = np.zeros(len(edges) - 1)
    lo = 0
    while lo < len(data):  # overlapping stretches of bytes
        hi = min(lo + PIECE, len(data))
        first = int(np.searchsorted(edges, lo, side="right")) - 1
        last = int(np.searchsorted(edges, hi, side="left"))
        value = weights[_grams(data[lo:min(hi + 3, len(data))])]
        own = edges[first:last + 1]
        for j in range(1, 4):
            at = own[1:] - j - lo
            value[at[(at >= 0) & (at < len(value)) & (own[1:] - j >= own[:-1])]] = 0.0
        out[first:last] += _sums(value, np.clip(own - lo, 0, len(value)))
        lo = hi
    return out


def _read(texts: pa.Array):
    """Of a batch: the bytes with the edges of each text, repetition bins, votes, and word counts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    edges = edges - edges[0] if len(edges) else np.zeros(1, np.int64)
    words, distinct, echo, lines, unique = np.zeros((5, len(texts)))
    for i in range(len(texts)):
        t = texts[i].as_py()
        words[i], distinct[i], echo[i] = _word_counts(t)
        lines[i], unique[i] = _line_counts(t)
    size = np.maximum(np.diff(edges), 1)
    some = np.maximum(words, 1)
    kind = _CLASS[data]
    letters = np.maximum(_sums(kind <= _UPPER, edges), 1)
    upper = _sums(kind == _UPPER, edges) / letters
    symbols = _sums(_SYMBOLS[kind], edges) / size
    pipes = _sums(kind == _PIPE, edges) / some
    pair = np.zeros(len(data), bool)
    pair[1:] = (data[1:] == data[:-1]) & _SYMBOLS[kind[1:]]
    runs = _sums(pair, edges) / some
    del kind, pair
    fresh = distinct / np.maximum(np.minimum(words, 400), 1)
    echo = echo / some
    same = 1 - unique / np.maximum(lines, 1)

    def vote(bad, good, known=True):
        """2 bad, 1 good, 0 nothing."""
        return np.where(known, np.where(bad, 2, np.where(good, 1, 0)), 0)

    votes = [vote(upper > 0.4, upper < 0.25), vote(symbols > 0.04, symbols < 0.01),
             vote(pipes > 0.03, pipes < 0.005), vote(runs > 0.1, runs < 0.02),
             vote(fresh < 0.35, fresh > 0.45, words >= 20), vote(same > 0.5, same < 0.35, lines >= 3), vote(echo > 0.15, echo < 0.05)]
    pattern = sum(v * 3 ** k for k, v in enumerate(votes))
    bins = np.stack([np.minimum(v * BINS, BINS - 1) for v in (fresh, same, echo)]).astype(np.int64)
    return data, edges, bins, pattern, words


def _votes(batches):
    for piece in pieces(batches, "text", PIECE):
        *_, pattern, words = _read(piece.column("text"))
        pattern = np.where(words > 0, pattern, -1)
        yield pa.RecordBatch.from_arrays([pa.array(pattern.astype(np.int32))], names=["pattern"])


def _feature_rows(batches):
    """Bounded sample only: the whole feature vector of each document."""
    for piece in pieces(batches, "text", 500_000):
        data, edges, bins, pattern, words = _read(piece.column("text"))
        x = np.zeros((piece.num_rows, HASHED + 3 * BINS), np.float32)
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            count = np.zeros(HASHED)
            for at in range(lo, hi, PIECE):
                count += np.bincount(_BIN[_grams(data[at:min(at + PIECE + 3, hi)])], minlength=HASHED)
            x[i, :HASHED] = count / max(hi - lo - 3, 1)
        for k in range(3):
            x[np.arange(len(x)), HASHED + k * BINS + bins[k]] = 1
        yield pa.RecordBatch.from_arrays([pa.array(pattern.astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())],
                                         names=["pattern", "x"])


def _scores(weights: np.ndarray, bias: float, posterior: np.ndarray):
    by_gram = weights[_BIN]

    def run(batches):
        for piece in pieces(batches, "text", PIECE):
            data, edges, bins, pattern, words = _read(piece.column("text"))
            z = _gram_sums(data, edges, by_gram) / np.maximum(np.diff(edges) - 3, 1) + bias
            for k in range(3):
                z += weights[HASHED + k * BINS + bins[k]]
            good = np.where(words > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            label = np.where(words > 0, posterior[pattern], 0.0)
            yield pa.RecordBatch.from_arrays([piece.column("carry"), pa.array(good), pa.array(label)],
                                             names=["carry", "score", "label"])
    return run


def estimate(counts: np.ndarray, labellers: int = _LABELLERS, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior probability of good for each vote pattern, and P(vote | class) of each labeller, by
    expectation-maximisation with votes independent given the class. Starts from: any bad vote is bad."""
    votes = np.arange(3 ** labellers)[:, None] // 3 ** np.arange(labellers) % 3
    good = np.where((votes == 2).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        mass = np.stack([counts * (1 - good), counts * good])
        prior = (mass.sum(axis=1) + 1) / (counts.sum() + 2)
        table_ = np.array([[[mass[c, votes[:, k] == v].sum() for v in range(3)] for k in range(labellers)] for c in range(2)]) + 0.1
        table_ /= table_.sum(axis=2, keepdims=True)
        log = np.log(prior)[:, None] + sum(np.log(table_[:, k, :])[:, votes[:, k]] for k in range(labellers))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return good, table_


def train(x: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; columns are scaled to equal spread for the descent only."""
    scale = np.maximum(x.std(axis=0), 1e-4)
    mean = x.mean(axis=0)
    z = (x - mean) / scale
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        e = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y
        g = np.r_[z.T @ e / len(y) + 1e-3 * w, e.mean()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    w = w / scale
    return w, float(b - w @ mean)


def scored(docs: DataFrame, carry, sample: int = SAMPLE) -> DataFrame:
    """(carry, score, label) of every row of `docs` (doc_id, text): score is the scorer's probability that the
    text is good, label the posterior of its votes. Null and wordless texts score 0. Equal texts score
    alike. An empty table gives no rows."""
    text = docs.select("text")
    counts = np.zeros(3 ** _LABELLERS)
    for pattern, n in text.mapInArrow(_votes, "pattern int").filter("pattern >= 0").groupBy("pattern").count().collect():
        counts[pattern] = n  # at most 3^7 rows
    posterior, _ = estimate(counts)
    chosen = docs.select("text", spread(F.col("doc_id"), F.col("text")).alias("h")).filter("text IS NOT NULL")
    chosen = staged(least_by_hash(chosen, "h", sample).select("text"))
    rows = chosen.mapInArrow(_feature_rows, "pattern int, x binary").collect()  # at most `sample` rows
    if rows:
        x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(len(rows), -1).astype(np.float64)
        weights, bias = train(x, posterior[[r.pattern for r in rows]])
    else:
        weights, bias = np.zeros(HASHED + 3 * BINS), 0.0
    return docs.select(carry.alias("carry"), "text").mapInArrow(
        _scores(weights, bias, posterior), docs.select(carry.alias("carry")).schema.add("score", "double").add("label", "double"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents that the classifier rejects go. All columns are returned."""
    return scored(docs, F.struct(*[F.col(c) for c in docs.columns])).filter(F.col("score") >= KEEP).select("carry.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score, weak label and verdict."""
    return scored(table(spark, sf_dir, "documents"), F.col("doc_id")).select(
        F.col("carry").alias("doc_id"), "score", "label", (F.col("score") >= KEEP).alias("kept"))
