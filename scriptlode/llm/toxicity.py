"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks (operator 10).

A unit is a word, also without its punctuation, or a run of single characters read as one word. The kernel of two units is the gap-weighted
subsequence kernel: every common subsequence of three characters counts, weighted by LAMBDA to the power
of the lengths it spans, and normalised. Inserted characters and gaps only lower it. Landmarks are strings
that tell toxic from clean training documents (chosen by greedy cover) and frequent clean words. In the
landmark space a squared-hinge support vector machine is trained on labelled documents as bags: the
highest unit of a toxic document is its witness, all units of clean documents are negative. A document
scores by its highest unit, mapped to a probability on the training documents.

The decision of a unit is a sum over landmarks of kernel values, so it is folded into one weight for each
subsequence of three characters; scoring reads whole texts in numpy batches.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import least_by_hash, pieces, spread, staged, table, word_lists

LAMBDA = 0.7
LONGEST = 24     # longer words are read in pieces that overlap by half
TOXIC, CLEAN = 1500, 3000  # labelled documents that the model is fitted on, at most; those with the least hash
SAMPLE_BYTES = 32_000_000  # and bytes of their texts
COVER, PLAIN = 64, 64      # landmarks of either kind, at most

_LETTERS = 64    # characters fold to so many codes: a-z, then others by code point
_SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")


def _joined(text: str) -> str:
    """Runs of three or more single characters become one word."""
    return _SPACED.sub(lambda m: "".join(m[0].split()), text)


def _parts(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    step = LONGEST // 2
    return [word[i:i + LONGEST] for i in range(0, len(word) - step, step)]


def _codes(units: list[str], length: int) -> np.ndarray:
    points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(len(units), length).astype(np.int64)
    plain = points - ord("a")
    return np.where((plain >= 0) & (plain < 26), plain, 26 + points % (_LETTERS - 26))


def _by_length(units: list[str], most: int = 2048):
    """Blocks of units of one length: places and character codes."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    order = np.argsort(lengths, kind="stable")
    cut = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for lo, hi in zip(cut, [*cut[1:], len(units)]):
        length = int(lengths[order[lo]])
        if length < 3:
            continue
        for at in range(lo, hi, most):
            where = order[at:min(hi, at + most)]
            yield where, _codes([units[i] for i in where], length)


def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    places = np.array(list(combinations(range(length), 3)))
    return places, LAMBDA ** (places[:, 2] - places[:, 0] + 1.0)


def _subsequences(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (codes[:, places[:, 0]] * _LETTERS + codes[:, places[:, 1]]) * _LETTERS + codes[:, places[:, 2]]


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """K(u, u) of units of one length by dynamic programming over both copies."""
    n, size = codes.shape
    lam = LAMBDA
    same = (codes[:, :, None] == codes[:, None, :]).astype(np.float64)
    before = np.ones((n, size + 1, size + 1))
    for _ in range(2):
        now = np.zeros_like(before)
        for a in range(1, size + 1):
            run = np.zeros(n)
            for b in range(1, size + 1):
                run = lam * run + lam * lam * same[:, a - 1, b - 1] * before[:, a - 1, b - 1]
                now[:, a, b] = lam * now[:, a - 1, b] + run
        before = now
    return lam * lam * (same * before[:, :-1, :-1]).sum(axis=(1, 2))


def kernel_sums(units: list[str], weights: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Inner products of each normalised unit with the columns of `weights` (subsequences x columns); `rows` has the row of each
    subsequence if only some have one."""
    out = np.zeros((len(units), weights.shape[1]))
    ways = {}
    for where, codes in _by_length(units):
        places, decay = ways.setdefault(codes.shape[1], _triples(codes.shape[1]))
        norm = np.sqrt(self_kernel(codes))
        step = max(1, 1_000_000 // (len(places) * weights.shape[1]))
        for at in range(0, len(codes), step):
            sub = _subsequences(codes[at:at + step], places)
            got = weights[sub if rows is None else rows[sub]]
            out[where[at:at + step]] = np.einsum("ntm,t->nm", got, decay) / norm[at:at + step, None]
    return out


def _landmark_table(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised weight of each subsequence in each landmark, for the subsequences that some landmark holds, and the row of
    every subsequence (row 0 for one that none holds)."""
    found, held = [], []
    for where, codes in _by_length(landmarks):
        places, decay = _triples(codes.shape[1])
        norm = np.sqrt(self_kernel(codes))
        for at, sub, n in zip(where, _subsequences(codes, places), norm):
            found.append((at, sub, (decay / n).astype(np.float32)))
            held.append(sub)
    rows = np.zeros(_LETTERS ** 3, np.int32)
    known = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
    rows[known] = np.arange(1, len(known) + 1)
    table_ = np.zeros((len(known) + 1, len(landmarks)), np.float32)
    for at, sub, weight in found:
        np.add.at(table_[:, at], rows[sub], weight)
    return table_, rows


def _plain(word: str) -> str:
    return "".join(filter(str.isalnum, word))


def _units(text: str) -> list[str]:
    """Words of a text, also without what is no letter or digit."""
    found = dict.fromkeys(_joined((text or "").lower()).split())
    found.update(dict.fromkeys(p for p in map(_plain, found) if p))
    return [p for w in found for p in _parts(w)]


def _cover(toxic: list[list[str]], clean_words: list[str]) -> list[str]:
    """Strings of 4 to 8 characters that clean documents lack, chosen greedily until they explain too few toxic ones. `toxic` has the
    words of each toxic document that no clean one has."""
    grams = lambda words: {w[i:i + k] for w in words for k in range(4, 9) for i in range(len(w) - k + 1)}
    least = max(3, len(toxic) // 100)
    # Substrings of a document are made twice and not kept; only those in enough documents are.
    often = Counter()
    for words in toxic:
        often.update(grams(words))
    often = {g: n for g, n in often.items() if n >= least}
    for w in clean_words:
        for k in range(4, 9):
            for i in range(len(w) - k + 1):
                often.pop(w[i:i + k], None)
    own = [grams(words) & often.keys() for words in toxic]
    chosen = []
    while len(chosen) < COVER:
        count = Counter(g for gs in own for g in gs)
        if not count:
            break
        best = max(count, key=lambda g: (count[g], len(g), g))
        if count[best] < least:
            break
        chosen.append(best)
        own = [gs for gs in own if best not in gs]
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Squared-hinge linear support vector machine by Newton steps on its support vectors."""
    x1 = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x1.shape[1]), np.r_[np.ones(x.shape[1]), 1e-6]
    for _ in range(30):
        on = y * (x1 @ w) < 1
        xs, ws = x1[on], weight[on] * cost
        new = np.linalg.solve((xs * ws[:, None]).T @ xs + np.diag(ridge), xs.T @ (ws * y[on]))
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w[:-1], float(w[-1])


class Model:
    """Folded weights of the units, and the line that maps a document's highest unit to a probability."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -40, 40)))


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Fit on labelled texts (bounded by the caller)."""
    y, place, at = np.array(toxic), {}, []
    for t in texts:  # every document as numbers of its units; a unit is kept once
        at.append(np.array([place.setdefault(u, len(place)) for u in _units(t)], np.int64))
    units = list(place)
    of_clean = np.concatenate([a for a, t in zip(at, y) if t == 0] or [np.zeros(0, np.int64)])
    negative, first, often = np.unique(of_clean, return_index=True, return_counts=True)
    clean = np.zeros(len(units), bool)
    clean[negative] = True
    bad_at = [a for a, t in zip(at, y) if t == 1]
    cover = _cover([[units[i] for i in a if not clean[i]] for a in bad_at], [units[i] for i in negative])
    if not cover:
        rate = np.clip(y.mean() if len(y) else 0.0, 0.01, 0.49)
        return Model(np.zeros((_LETTERS ** 3, 1), np.float32), 0.0, 0.0, float(np.log(rate / (1 - rate))))
    negative, often = negative[np.argsort(first)], often[np.argsort(first)]
    usual = negative[np.argsort(-often, kind="stable")[:8 * PLAIN]]
    landmarks = cover + [units[i] for i in usual if len(units[i]) >= 3][:PLAIN]
    table_, rows = _landmark_table(landmarks)
    gram = kernel_sums(landmarks, table_, rows)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T

    def noisy(u):
        return [u] + [u[:i] + c + u[i:] for c in "*.-" for i in range(1, len(u))]


    def sums(ids, weights):  # in parts: the sums of all units and landmarks are never in memory together
        parts = [kernel_sums([units[i] for i in ids[lo:lo + 4096]], weights, rows) for lo in range(0, len(ids), 4096)]
        return np.concatenate(parts) if parts else np.zeros((0, weights.shape[1]))

    reach = np.concatenate([sums(negative[lo:lo + 4096], table_[:, :len(cover)]).max(axis=1) for lo in range(0, len(negative), 4096)] or [np.zeros(0)])
    witness = [next((int(i) for i in a if any(c in units[i] for c in cover)), None) for a in bad_at]
    inserted = kernel_sums([n for c in cover for n in noisy(c)], table_, rows) @ root
    # Hard negatives only: the farther ones never become support vectors.
    negative = negative[np.argsort(-reach, kind="stable")[:20000]]
    far = sums(negative, table_) @ root
    for _ in range(3):
        positive = np.array([w for w in witness if w is not None], np.int64)
        xs = np.r_[sums(positive, table_) @ root, inserted, far]
        ys = np.r_[np.ones(len(positive) + len(inserted)), -np.ones(len(negative))]
        w, b = _svm(xs, ys, np.where(ys > 0, len(negative) / max(1, len(positive) + len(inserted)), 1.0))
        folded = table_ @ (root @ w)
        f = sums(np.arange(len(units)), folded[:, None])[:, 0] + b
        witness = [int(a[np.argmax(f[a])]) if len(a) and f[a].max() > 0 else None for a in bad_at]
    best = np.array([f[a].max() if len(a) else -2.0 for a in at])
    # Platt's line, positive and negative documents weighing alike.
    s, c = 1.0, 0.0
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(s * best + c, -40, 40)))
        e = share * (p - np.where(y == 1, 0.99, 0.01))
        s, c = max(0.1, s - 2.0 * (e @ best)), c - 2.0 * e.sum()
    return Model(folded.astype(np.float32)[rows][:, None], b, float(s), float(c))


def _scores(model: Model):
    def run(batches):
        for piece in pieces(batches, "text", 12_000_000):
            texts = piece.column("text").cast(pa.string()).to_pylist()
            texts = pa.array([_joined(t) if t and _SPACED.search(t) else t for t in texts], pa.string())
            words, counts = word_lists(texts)
            best = np.full(len(counts), -2.0)
            if len(words):
                coded = words.dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                forms = [(i, p) for i, w in enumerate(distinct) for f in ((w,) if w.isalnum() else (w, _plain(w))) for p in _parts(f)]
                values = np.full(len(distinct), -np.inf)
                np.maximum.at(values, [i for i, _ in forms], kernel_sums([p for _, p in forms], model.weights)[:, 0])
                each = values[coded.indices.to_numpy(zero_copy_only=False)] + model.bias
                some = counts > 0
                best[some] = np.maximum.reduceat(each, (np.cumsum(counts) - counts)[some])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(model.probability(best))], names=["doc_id", "score"])
    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Model:
    """Model fitted on at most `toxic` + `clean` labelled documents that are not held out, and SAMPLE_BYTES of their texts. Null
    labels are unlabelled."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter(
        "y IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).withColumn("h", spread(F.col("doc_id")))
    chosen = least_by_hash(usable.filter("y = 1"), "h", toxic, "doc_id").unionByName(
        least_by_hash(usable.filter("y = 0"), "h", clean, "doc_id"))
    rows = docs.select("doc_id", "text").join(F.broadcast(staged(chosen)), "doc_id").select(
        "doc_id", "h", "text", "y", F.octet_length("text").alias("size")).orderBy("h", "doc_id", "text").limit(2 * (toxic + clean))
    before = Window.orderBy("h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)  # of at most that many rows
    rows = rows.withColumn("read", F.sum(F.coalesce("size", F.lit(0))).over(before)).filter(F.col("read") <= SAMPLE_BYTES).select("text", "y").collect()
    return fit([r.text for r in rows], [r.y for r in rows])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every row of `docs` (doc_id, text; other columns are ignored), learnt from `labels` (doc_id,
    toxic). Null, empty and wordless texts score as having no toxic unit; equal texts score alike; without
    toxic training rows all scores are the same and below 0.5; an empty table gives no rows."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scores(trained(docs, labels)), "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity."""
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
