"""Language-model scoring with a hashed, class-factored maximum-entropy model (operator 4).

The probability of a token is P(class | context) * P(token | class). Classes are the most frequent
training tokens, each alone, and a fixed number of hash classes for the rest. P(class | context) is a softmax over
hashed features of the context: the previous token, the previous two (n-grams), and the second and
third previous ones alone (skips), with weights trained by distributed gradient steps over all training
documents. Within a class the softmax has one weight for each token and one for each token after a
context, whose optimum under a Dirichlet prior is a smoothed frequency: that of the token in its class, then that of
the token after the context among the tokens of its class after it. These weights are as many as the pairs
that occur; their counts are added up over all blocks, in parts by key.
Tokens are read once: a staged table holds blocks of documents, each block with its token
hashes and the numbers of its tokens, so every pass works on sparse numpy batches.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import hashed, mix, pieces, staged, table, word_lists

ALONE, GROUPS = 31, 17          # classes: tokens with a class of their own, hash classes
CELLS = 1 << 13                 # hashed feature cells for each kind of feature
PASSES = 2                      # gradient passes over all training documents
STEP = 1 << 12                  # tokens whose class probabilities are worked out together
SHARE = 1 << 15                 # and summed by cell together
STRETCH = 1 << 18               # tokens whose features are in memory together
BLOCK_BYTES = 6_000_000         # text in a block; a longer text is a block alone
_END = np.uint64(0x9E3779B97F4A7C15)  # the token that ends a text
_KINDS = 4
ORDERS = (1, 2)                 # contexts inside a class: so many previous tokens, the longest last
PRIOR = 16.0                    # a context counts as if it had so many tokens more, shared out as the shorter context says
CELL_BITS, TOKEN_BITS = 32, 20  # of a pair's key: context with class, token
BLOCKS_A_PART = 8               # counts are added up in parts, each as large as those of so many blocks,
LEAST_PARTS = 128               # or smaller
_SENT = "block long, part int, keys binary, n binary"
_FOUND = _SENT + ", found binary, cells binary"
_BLOCK = "block long, doc_ids array<long>, rows array<int>, train array<boolean>, codes binary, tokens binary"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of all: their high bytes are mostly equal."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 3)


def _unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _blocks(batches):
    """Documents to blocks: local token numbers and the hashes they stand for."""
    for piece in pieces(batches, "text", BLOCK_BYTES):
        ids = piece.column("doc_id").to_pylist()
        words, counts = word_lists(piece.column("text"), ascii_only=True)
        codes = hashed(words)
        ends = np.cumsum(counts + 1) - 1
        full = np.empty(len(codes) + len(counts), np.uint64)
        full[ends] = _END
        inner = np.ones(len(full), bool)
        inner[ends] = False
        full[inner] = codes
        vocabulary, local, n = np.unique(full, return_inverse=True, return_counts=True)
        often = np.argsort(-n, kind="stable")  # frequent tokens get small numbers, which pack well
        number = np.empty(len(often), np.int32)
        number[often] = np.arange(len(often))
        held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in ids]
        # Blocks of the same name hold the same texts under the same ids in the same order.
        name = int(np.uint64(xxhash.xxh3_64_intdigest(full.tobytes() + counts.tobytes() + repr(ids).encode())).astype(np.int64))
        yield pa.RecordBatch.from_arrays([
            pa.array([name], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([(counts + 1).astype(np.int32)], pa.list_(pa.int32())),
            pa.array([[not h for h in held]]), pa.array([_packed(number[local])], pa.binary()),
            pa.array([vocabulary[often].tobytes()], pa.binary())], names=["block", "doc_ids", "rows", "train", "codes", "vocabulary"])


def _tokens(vocabulary: np.ndarray) -> bytes:
    """A vocabulary in few bytes: tokens that are as frequent are in the order of their hashes."""
    return _packed(np.diff(vocabulary, prepend=np.uint64(0)))


def _stored(batches):
    """Blocks as they are kept, with packed vocabularies."""
    for block in _blocks(batches):
        vocabulary = np.frombuffer(block.column("vocabulary")[0].as_py(), np.uint64)
        yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array([_tokens(vocabulary)], pa.binary())], names=[*block.schema.names[:-1], "tokens"])


def _open(batches):
    for batch in batches:
        for i in range(batch.num_rows):  # one block in memory at a time
            r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            rows = np.array(r["rows"], np.int64)
            train = np.repeat(np.array(r["train"], bool), rows)
            vocabulary = np.cumsum(_unpacked(r["tokens"], np.uint64), dtype=np.uint64) if "tokens" in r else np.frombuffer(r["vocabulary"] or b"", np.uint64)
            yield r, rows, train, _unpacked(r["codes"], np.int32), vocabulary


def _dealt(block: int, keys: np.ndarray, n: np.ndarray, bits: int, parts: int):
    """The sorted keys of a block (numbers of so many bits) and their training counts, cut into parts by their first bits."""
    first = np.arange(parts, dtype=np.uint64) << np.uint64(bits - parts.bit_length() + 1)
    edges = np.r_[np.searchsorted(keys, first), len(keys)]
    some = np.flatnonzero(np.diff(edges))
    cut = [slice(edges[k], edges[k + 1]) for k in some]
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(len(some), block, np.int64)), pa.array(some.astype(np.int32)),
        pa.array([_packed(np.diff(keys[c], prepend=np.uint64(0))) for c in cut], pa.binary()),
        pa.array([_packed(n[c].astype(np.int64)) for c in cut], pa.binary())], names=["block", "part", "keys", "n"])


def _types(parts: int):
    """Each block's vocabulary with its training counts."""
    def run(batches):
        for r, _, train, codes, vocabulary in _open(batches):
            order = np.argsort(vocabulary)
            yield from _dealt(r["block"], vocabulary[order], np.bincount(codes[train], minlength=len(vocabulary))[order], 64, parts)
    return run


def pair_keys(vocabulary: np.ndarray, codes: np.ndarray, starts: np.ndarray, kind: np.ndarray, alone: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens that share their class with others, and of each the key of its pair with the `order` tokens before it: a
    hash of context and class, then one of the token. Before a text stands its end token."""
    at = np.flatnonzero(kind[codes] >= alone)
    place = at - starts[np.searchsorted(starts, at, side="right") - 1]
    cell = kind[codes[at]].astype(np.uint64)
    for k in range(1, order + 1):
        cell = mix(cell + np.where(place >= k, vocabulary[codes[at - k]], _END) + np.uint64(k))
    return at, cell >> np.uint64(64 - CELL_BITS) << np.uint64(TOKEN_BITS) | mix(vocabulary + np.uint64(29))[codes[at]] >> np.uint64(64 - TOKEN_BITS)


def _pairs(alone: np.ndarray, order: int, parts: int):
    """Each block's pairs of context and token with their training counts."""
    def run(batches):
        for r, rows, train, codes, vocabulary in _open(batches):
            at, keys = pair_keys(vocabulary, codes, np.cumsum(rows) - rows, classes_of(vocabulary, alone), len(alone), order)
            keys, local = np.unique(keys, return_inverse=True)
            yield from _dealt(r["block"], keys, np.bincount(local[train[at]], minlength=len(keys)), CELL_BITS + TOKEN_BITS, parts)
    return run


def _runs(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted values: where the runs of equal ones begin, the sum of `n` in each, and the run of each value."""
    new = np.r_[True, values[1:] != values[:-1]]
    at = np.flatnonzero(new)
    return at, np.add.reduceat(n, at, dtype=np.int64), np.cumsum(new, dtype=np.int32) - 1


def _totals(summary: bool):
    """Adds up one part's counts over all blocks. Each block gets the sums of its keys, and those of their cells if no `summary`
    is asked for; that is a row without block: the keys that occur in training, with their sums."""
    def run(part: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpacked(k.as_py(), np.uint64), dtype=np.uint64) for k in part["keys"]]
        ends = np.cumsum([len(k) for k in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable").astype(np.int32)  # the keys of a block are sorted already
        keys, n = keys[order], np.concatenate([_unpacked(x.as_py()).astype(np.int32) for x in part["n"]])[order]

        def of_blocks(sums, run):
            out = np.empty(len(order), np.int64)
            out[order] = sums[run]
            return [_packed(x) for x in np.split(out, ends[:-1])]

        at, sums, run = _runs(keys, n)
        found, cells = of_blocks(sums, run), None
        if not summary:
            _, within, cell = _runs(keys >> np.uint64(TOKEN_BITS), n)
            cells = of_blocks(within, cell)
        columns = [part["block"].combine_chunks(), part["part"].combine_chunks(), *(pa.array(x or [None] * len(ends), pa.binary()) for x in (None, None, found, cells))]
        out = pa.Table.from_arrays(columns, names=["block", "part", "keys", "n", "found", "cells"])
        if summary:
            some = np.flatnonzero(sums)
            row = [[None], [part["part"][0].as_py()], [_packed(keys[at[some]])], [_packed(sums[some])], [None], [None]]
            out = pa.concat_tables([out, pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(row, out.schema)], schema=out.schema)])
        return out
    return run


def _leading(batches):
    """Of each part the tokens that occur most."""
    for batch in batches:
        for keys, n in zip(batch.column("keys"), batch.column("n")):
            token, c = _unpacked(keys.as_py()), _unpacked(n.as_py())
            most = np.lexsort((token, -c))[:ALONE]
            yield pa.RecordBatch.from_arrays([pa.array(token[most]), pa.array(c[most])], names=["token", "c"])


def _joined(parts) -> np.ndarray:
    """The numbers of all parts of a block, in the order of its keys. Blocks of one name have the same numbers."""
    return np.concatenate([_unpacked(x) for _, x in sorted(dict(parts).items())] or [np.zeros(0, np.int64)])


def classes_of(tokens: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Class of each token hash; `alone` are the sorted hashes of the tokens with their own class."""
    out = len(alone) + (mix(tokens + np.uint64(1)) % np.uint64(GROUPS)).astype(np.int64)
    if len(alone):
        at = np.minimum(np.searchsorted(alone, tokens), len(alone) - 1)
        out = np.where(alone[at] == tokens, at, out)
    return out


def features(vocabulary: np.ndarray, codes: np.ndarray, starts: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Hashed cells of the context of the tokens lo to hi of a block, one column for each kind of feature. `starts` are the
    places where its texts begin; before a text stands its end token."""
    hi = len(codes) if hi is None else hi
    at = np.arange(lo, hi)
    place = at - starts[np.searchsorted(starts, at, side="right") - 1]
    back = []
    for k in (1, 2, 3):
        shifted = np.full(hi - lo, _END)
        skip = max(k - lo, 0)
        shifted[skip:] = vocabulary[codes[lo + skip - k:hi - k]]
        back.append(np.where(place >= k, shifted, _END))
    out = np.empty((hi - lo, _KINDS), np.int32)
    for i, of in enumerate((lambda: back[0], lambda: back[0] + mix(back[1] + np.uint64(7)), lambda: back[1] + np.uint64(11), lambda: back[2] + np.uint64(13))):
        out[:, i] = mix(of()) % np.uint64(CELLS)
        out[:, i] += i * CELLS
    return out


def _stretches(n: int):
    for lo in range(0, n, STRETCH):
        yield lo, min(lo + STRETCH, n)


def _exponentials(weights: np.ndarray, cells: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Exponentials of the logits. A step moves a weight by 1 at most, so they need no shift to stay in range."""
    z = np.empty((len(cells), weights.shape[1]), np.float32) if out is None else out
    part = np.empty_like(z)
    np.take(weights, cells[:, 0], axis=0, out=z, mode="clip")
    z += weights[-1]
    for k in range(1, _KINDS):
        z += np.take(weights, cells[:, k], axis=0, out=part, mode="clip")
    return np.exp(z, out=z)


def _row_sums(z: np.ndarray) -> np.ndarray:
    """Sums of the rows, added as doubles; a product with ones is far faster than a sum along short rows."""
    return z.astype(np.float64) @ np.ones(z.shape[1])


def _probabilities(weights: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Class probabilities, one row for each class and one column for each token."""
    out = np.empty((weights.shape[1], len(cells)))
    for lo in range(0, len(cells), STEP):
        z = _exponentials(weights, cells[lo:lo + STEP])
        np.divide(z.T, _row_sums(z), out=out[:, lo:lo + STEP])
    return out


def _add_by_cell(total: np.ndarray, values: np.ndarray, cells: np.ndarray) -> None:
    """Add each column of `values` (classes, tokens) to the column of `total` (classes, cells) that its token's cell of each kind names."""
    for k in range(_KINDS):
        own, at = slice(k * CELLS, (k + 1) * CELLS), cells[:, k].astype(np.intp) - k * CELLS
        for c in range(len(values)):
            total[c, own] += np.bincount(at, values[c], CELLS)


def _gradients(weights: np.ndarray, alone: np.ndarray):
    """Summed gradient of the log-likelihood and visits of every feature cell, over one task's training texts."""
    n_classes = weights.shape[1]
    plain = not weights[:-1].any()  # only the bias yet: every context has the same probabilities
    bias = weights[-1].astype(np.float64)
    same = np.exp(bias - bias.max()) / np.exp(bias - bias.max()).sum()

    def run(batches):
        gradient = np.zeros(weights.shape, np.float64)
        expected = None if plain else np.zeros((n_classes, len(weights)))
        visits = np.zeros(len(weights))
        for _, rows, train, codes, vocabulary in _open(batches):
            starts, kind = np.cumsum(rows) - rows, classes_of(vocabulary, alone)
            for at, end in _stretches(len(codes)):
                learn = train[at:end]
                cells = features(vocabulary, codes, starts, at, end)[learn]
                target = kind[codes[at:end][learn]]
                for k in range(_KINDS):
                    own = slice(k * CELLS, (k + 1) * CELLS)  # the cells of this kind
                    at_ = cells[:, k] - k * CELLS
                    seen = np.bincount(at_, minlength=CELLS)
                    visits[own] += seen
                    gradient[own] += np.bincount(at_ * n_classes + target, minlength=CELLS * n_classes).reshape(CELLS, n_classes)
                    if plain:
                        gradient[own] -= seen[:, None] * same
                visits[-1] += len(target)
                gradient[-1] += np.bincount(target, minlength=n_classes)
                if plain:
                    gradient[-1] -= len(target) * same
                    continue
                for lo in range(0, len(target), SHARE):
                    c = cells[lo:lo + SHARE]
                    share = _probabilities(weights, c)
                    expected[:, -1] += share.sum(axis=1)
                    _add_by_cell(expected, share, c)
        if not plain:
            gradient -= expected.T
        some = np.flatnonzero(visits)
        for at in np.array_split(some, max(1, len(some) // 2048)):
            yield pa.RecordBatch.from_arrays([
                pa.array(at.astype(np.int32)), pa.array(visits[at]),
                pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * n_classes), pa.array(gradient[at].astype(np.float32).ravel()))],
                names=["cell", "visits", "g"])
    return run


def _summed(parts):
    """Sum of the partial gradients of one share of the cells."""
    total: dict[int, list] = {}
    for batch in parts:
        cells, visits, g = batch.column("cell").to_numpy(), batch.column("visits").to_numpy(), batch.column("g")
        rows = g.flatten().to_numpy().reshape(len(cells), -1) if len(cells) else np.zeros((0, 1))
        for c, v, x in zip(cells.tolist(), visits.tolist(), rows):
            if c in total:
                total[c][0] += v
                total[c][1] += x
            else:
                total[c] = [v, x.astype(np.float64)]
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t[0] for t in total.values()]),
                                          pa.array([t[1].astype(np.float32).tolist() for t in total.values()], pa.list_(pa.float32()))], names=["cell", "visits", "g"])


def _train(blocks: DataFrame, alone: np.ndarray, prior: np.ndarray, passes: int) -> np.ndarray:
    """Gradient steps from the class frequencies. One step moves each cell by its mean gradient; the bound on
    the curvature of a softmax with one bias and four features gives the step length."""
    weights = np.zeros((_KINDS * CELLS + 1, len(prior)), np.float32)
    weights[-1] = np.log(prior)
    schema = "cell int, visits double, g array<float>"
    # A task sends one row for each cell whatever it has read, so there are few tasks for each core.
    few = blocks.select("block", "rows", "train", "codes", "tokens").coalesce(2 * blocks.sparkSession.sparkContext.defaultParallelism)
    for _ in range(passes):
        parts = few.mapInArrow(_gradients(weights, alone), schema)
        parts = parts.repartition(F.col("cell")).mapInArrow(_summed, schema)
        got = parts.toArrow()  # at most one row for each feature cell
        if not got.num_rows:
            break
        cells = got.column("cell").to_numpy()
        mean = got.column("g").combine_chunks().flatten().to_numpy().reshape(len(cells), -1)
        visits = got.column("visits").to_numpy()
        share = np.maximum(prior, 1e-6)
        # Newton-like: the gradient divided by each class's variance, shrunk for rarely seen cells.
        step = mean / ((visits[:, None] + 20.0) * share * (1 - share) + 2.0) / (_KINDS / 2)
        weights[cells] += np.clip(step, -1.0, 1.0).astype(np.float32)
    return weights


def _class_parts(weights: np.ndarray, alone: np.ndarray, inside: np.ndarray):
    """For each block the sum of log10 P(class | context) and of the classes' masses for each text. Counts of single tokens are
    not needed for this."""
    def run(batches):
        for r, rows, _, codes, vocabulary in _open(batches):
            kind = classes_of(vocabulary, alone)
            starts = np.cumsum(rows) - rows
            mass = np.where(np.arange(len(inside)) < len(alone), 0.0, np.log10(inside))
            log = np.empty(len(codes))
            for at, end in _stretches(len(codes)):
                cells, target = features(vocabulary, codes, starts, at, end), kind[codes[at:end]]
                for lo in range(0, end - at, STEP):
                    z = _exponentials(weights, cells[lo:lo + STEP])
                    t = target[lo:lo + STEP]
                    log[at + lo:at + lo + len(t)] = np.log10(z[np.arange(len(t)), t].astype(np.float64)) - np.log10(_row_sums(z))
                log[at:end] -= mass[target]
            parts = np.add.reduceat(log, starts)  # every text has its end token
            yield pa.RecordBatch.from_arrays([
                pa.array([r["block"]], pa.int64()), pa.array([r["doc_ids"]], pa.list_(pa.int64())), pa.array([r["rows"]], pa.list_(pa.int32())),
                pa.array([r["train"]]), pa.array([r["codes"]], pa.binary()), pa.array([_tokens(vocabulary)], pa.binary()),
                pa.array([parts], pa.list_(pa.float64()))], names=_PARTS_NAMES)
    return run


_PARTS = "block long, doc_ids array<long>, rows array<int>, train array<boolean>, codes binary, tokens binary, parts array<double>"
_PARTS_NAMES = [column.split()[0] for column in _PARTS.split(", ")]


def _inside(known: np.ndarray, kind: np.ndarray, inside: np.ndarray, contexts) -> np.ndarray:
    """log10 of P(token | class, context) / P(token | class) of tokens, by their training counts, their classes and, for
    each context from the shortest on, the counts of their pairs and of the context in their class."""
    first = (known + 1.0) / inside[kind]
    share = first
    for pairs, cells in contexts:
        share = (pairs + PRIOR * share) / (cells + PRIOR)
    return np.log10(share / first)


def _scored(total: int, distinct: int, alone: np.ndarray, inside: np.ndarray):
    """Scores of blocks from the training counts of their tokens (`counts`) and of their pairs for each context."""
    floor = total + distinct + 1

    def run(batches):
        for r, rows, _, codes, vocabulary in _open(batches):
            starts, kind = np.cumsum(rows) - rows, classes_of(vocabulary, alone)
            known = np.empty(len(vocabulary), np.int64)
            known[np.argsort(vocabulary)] = _joined((x["part"], x["found"]) for x in r["counts"])
            log = np.log10(known + 1.0)
            within = np.where(kind < len(alone), 0.0, log)[codes]
            contexts = []
            for order in ORDERS:
                at, keys = pair_keys(vocabulary, codes, starts, kind, len(alone), order)
                local = np.unique(keys, return_inverse=True)[1]
                contexts.append([_joined((x["part"], x[name]) for x in r[f"pairs{order}"] or [])[local] for name in ("found", "cells")])
            within[at] += _inside(known[codes[at]], kind[codes[at]], inside, contexts)
            sums = lambda v: np.add.reduceat(v, starts)
            yield pa.RecordBatch.from_arrays([
                pa.array(r["doc_ids"], pa.int64()), pa.array([not t for t in r["train"]], pa.bool_()), pa.array(rows),
                pa.array(sums((known > 0).astype(np.int64)[codes])), pa.array(np.full(len(rows), total, np.int64)),
                pa.array(sums((log - np.log10(floor))[codes])), pa.array(sums(within) + np.array(r["parts"]))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def scores(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """Base and model scores (log10 probabilities) of every row of `docs` (doc_id, text; other columns are ignored).

    Null and empty texts have one token, their end; a null doc_id counts as the empty string for the
    fold; repeated rows are learnt from and scored as often as they occur. Without training documents all counts
    are 0 and the model is uniform over classes; an empty table gives no rows. A token unknown to training has
    the smoothing mass of its class.
    """
    blocks = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_stored, _BLOCK))
    parts = 1 << int(np.ceil(np.log2(max(LEAST_PARTS, blocks.count() / BLOCKS_A_PART))))
    sent = blocks.select("block", "rows", "train", "codes", "tokens")
    counted = staged(sent.mapInArrow(_types(parts), _SENT).groupBy("part").applyInArrow(_totals(True), _FOUND))
    tokens = counted.filter("block is null").select("keys", "n")
    top = tokens.mapInArrow(_leading, "token long, c long").orderBy(F.desc("c"), "token").limit(ALONE).collect()
    alone = np.sort(np.array([r.token for r in top], np.int64).view(np.uint64)) if top else np.zeros(0, np.uint64)
    n_classes = len(alone) + GROUPS

    def grouped(batches):
        for keys, n in (pair for batch in batches for pair in zip(batch.column("keys"), batch.column("n"))):
            kind, c = classes_of(_unpacked(keys.as_py(), np.uint64), alone), _unpacked(n.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_classes, dtype=np.int32)), pa.array(np.bincount(kind, c, n_classes)),
                                              pa.array(np.bincount(kind, minlength=n_classes).astype(np.float64))], names=["kind", "c", "v"])

    rows = tokens.mapInArrow(grouped, "kind int, c double, v double").groupBy("kind").agg(F.sum("c"), F.sum("v")).collect()
    count, types = np.zeros(n_classes), np.zeros(n_classes)
    for kind, c, v in rows:
        count[kind], types[kind] = c, v
    total, distinct = int(count.sum()), int(types.sum())
    inside = count + types + 1  # one more for all unknown tokens of the class
    prior = (count + 1) / (count.sum() + n_classes)
    weights = _train(blocks, alone, prior, passes)

    def of_block(found, *columns):  # all parts of one block, in any order
        return found.groupBy("block").agg(F.collect_list(F.struct("part", *columns)))

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = blocks.mapInArrow(_class_parts(weights, alone, inside), _PARTS)
    scored = scored.join(of_block(counted.filter("block is not null"), "found").toDF("block", "counts"), "block")
    for order in ORDERS:
        pairs = sent.mapInArrow(_pairs(alone, order, parts), _SENT).groupBy("part").applyInArrow(_totals(False), _FOUND)
        scored = scored.join(of_block(pairs, "found", "cells").toDF("block", f"pairs{order}"), "block", "left")
    return scored.mapInArrow(_scored(total, distinct, alone, inside), out)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return scores(table(spark, sf_dir, "documents"))
