"""The operators on training text against brute force, and their edge cases."""

import functools
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scriptlode.llm import (common, decontaminate, fingerprint, licenses, line_dedup, lm_scoring, mixing, near_dup, quality, registered,
                            sharding, toxicity)

from ..conftest import spark  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, key string"


def make_docs(spark, rows):  # noqa: F811
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 9, "k") for i, t, s in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Random texts with exact and near copies, ties, null and empty texts, repeated rows and a null id."""
    rng = random.Random(7)
    out = []
    for i in range(60):
        out.append((i, "\n".join(words(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 5))), f"s{i % 3}"))
    for i in range(60, 90):
        base = out[rng.randrange(20)][1].split(" ")
        for _ in range(rng.randint(0, 2)):
            base[rng.randrange(len(base))] = f"new{rng.randrange(99)}"
        out.append((i, " ".join(base), "s0"))
    return out + [(90, None, None), (91, "", "s1"), (92, "   \n ", "s1"), (93, "two words", "s2"), (94, "two words", "s2"),
                  out[3], out[3], (None, "a text without an id here", None), (95, words(rng, 3000), "s1")]


@pytest.fixture(scope="module")
def docs(spark, rows):  # noqa: F811
    return make_docs(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):  # noqa: F811
    return make_docs(spark, [])


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum((a | b).values()))


def test_near_duplicates(docs, rows, nothing):
    bags = [bag(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is not None and rows[j][1] is not None and (jaccard(bags[i], bags[j]) >= 0.8 or not bags[i] and not bags[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    want = sorted((str(rows[i][0]), str(min((rows[j][0] for j in g if rows[j][0] is not None), default=None)), len(g))
                  for g in groups.values() for i in g)
    got = near_dup.classes(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == want
    assert near_dup.classes(nothing).count() == 0
    kept = near_dup.drop_near_duplicates(docs.sparkSession, docs, "")
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2 ** 63, 60).astype(np.uint64)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    hashes, owner = np.r_[h[a > 0], h[b > 0]], np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
    s = near_dup.signatures(hashes, owner, np.r_[a[a > 0], b[b > 0]], 2, 4096)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_pairs_at_the_threshold_share_a_bucket():
    """4,000 pairs of 90 shingles with 80 in common, which is a similarity of 0.8."""
    n = 4000
    h = np.random.default_rng(3).integers(1, 2 ** 63, (n, 100)).astype(np.uint64)
    hashes = np.concatenate([h[:, :90], h[:, 10:]]).ravel()
    s = near_dup.signatures(hashes, np.repeat(np.arange(2 * n), 90), np.ones(len(hashes), np.int64), 2 * n, near_dup.BANDS * near_dup.ROWS)
    s = s.reshape(2, n, near_dup.BANDS, near_dup.ROWS)
    assert (s[0] == s[1]).all(axis=2).any(axis=1).all()
    assert (1 - 0.8 ** near_dup.ROWS) ** near_dup.BANDS < 0.0001


def test_decontamination(spark, docs, rows, nothing):  # noqa: F811
    rng = random.Random(3)
    items = [(k, words(rng, rng.randint(12, 40), 5000).replace("w", "q")) for k in range(12)] + [(12, None), (13, "..."), (14, "zz yy")]
    planted = [(1000, words(rng, 50) + " " + items[0][1] + " " + words(rng, 20), "s"), (1001, items[1][1].upper().replace(" ", ",  "), "s"),
               (1002, " ".join(items[2][1].split()[2:]) + " " + words(rng, 9), "s"), (1003, words(rng, 9) + " zz. Yy!", "s"),
               (1004, items[3][1][: len(items[3][1]) // 2], "s"), (1005, items[4][1] + "\n" + items[5][1], "s")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    all_rows = rows + planted
    norm = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    want = set()
    for i, t, _ in all_rows:
        w = norm(t)
        for k, item in items:
            m = norm(item)
            width = min(5, len(m))
            grams = lambda x: Counter(tuple(x[j:j + width]) for j in range(len(x) - width + 1))  # noqa: E731,B023
            if m and any(jaccard(grams(w[max(0, s):s + len(m)]), grams(m)) >= 0.8 for s in range(-len(m), len(w))):
                want.add((i, k))
    got = decontaminate.leaks(make_docs(spark, all_rows), benchmark)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and {1000, 1001, 1002, 1003, 1005} <= {i for i, _ in want}
    assert decontaminate.leaks(nothing, benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.filter("false")).count() == 0


def test_decontamination_at_the_beginning(spark):  # noqa: F811
    """Windows cut at the beginning of a text stay apart: an item with a repeated phrase, and items that share one."""
    rng = random.Random(6)
    phrase = [f"p{k}" for k in range(5)]

    def item(places):
        w = [f"q{rng.randrange(10 ** 6)}" for _ in range(60)]
        for at in places:
            w[at:at + 5] = phrase
        return " ".join(w)
    items = [(0, item((5, 40))), (1, item((30,))), (2, item((50,)))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    tail = " " + words(rng, 40)
    texts = [(k, t, "s") for k, t in items] + [(10 + k, t + tail, "s") for k, t in items] + [(20 + k, " ".join(t.split()[4:]) + tail, "s") for k, t in items]
    got = {(r.doc_id, r.item_id, round(r.similarity, 6), r.start) for r in decontaminate.leaks(make_docs(spark, texts), benchmark).collect()}
    assert got == {(d + k, k, s, 0) for k in range(3) for d, s in ((0, 1.0), (10, 1.0), (20, round(52 / 56, 6)))}


def test_hamming_blocks_find_all_within_radius(spark):  # noqa: F811
    rng = random.Random(5)
    items = [(k, 9, rng.getrandbits(64) - 2 ** 63) for k in range(10)]
    windows = []
    for n in range(200):
        fp = (items[n % 10][2] + 2 ** 63)
        for b in rng.sample(range(64), rng.randint(0, 20)):
            fp ^= 1 << b
        windows.append((f"k{n}", n, 9, fp - 2 ** 63))
    got = decontaminate._within(spark.createDataFrame(windows, "key string, start int, m int, fp long"),
                                spark.createDataFrame(items, "item_id long, m int, fp long"), 15)
    want = {(w[0], i[0]) for w in windows for i in items if ((w[3] ^ i[2]) & (2 ** 64 - 1)).bit_count() <= 15}
    assert {(r.key, r.item_id) for r in got.collect()} == want


def test_sharding(docs, rows, nothing):
    got = sharding.sharded(docs, shards=4).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), size(t)) for i, t, _ in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    of = {}
    for r in got:
        of.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(v) == 1 for v in of.values())
    groups = Counter()
    for _, t, _ in rows:
        groups[t] += size(t)
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    sizes = sorted(groups.values(), reverse=True)
    least = max(sizes[0], -(-sum(sizes) // 4))

    def plain(capacity):  # best fit decreasing by scanning all bins
        bins = []
        for x in sizes:
            fits = [b for b in bins if b >= x]
            if fits:
                bins.remove(min(fits))
                bins.append(min(fits) - x)
            else:
                bins.append(max(capacity, x) - x)
        return len(bins)
    while plain(least) > 4:
        least += 1
    assert max(loads.values()) <= least
    assert sharding.sharded(nothing, shards=8).count() == 0
    assert len({r.shard for r in sharding.sharded(docs, capacity=5000).collect()}) == plain(5000)
    assert sharding.shard(docs.sparkSession, docs, "").columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]


def test_bundled_units_stay_balanced(docs):
    loads = Counter()
    for r in sharding.sharded(docs, shards=2, units=16).collect():
        loads[r.shard] += r.size
    assert len(loads) == 2


def test_more_shards_than_bundles(spark):  # noqa: F811
    """With a given capacity no shard of several groups is overfull, however many capacities of data there are."""
    rng = random.Random(12)
    d = make_docs(spark, [(i, f"{i} " + "x" * rng.randint(20, 180) * (30 if i % 500 == 7 else 1), "s") for i in range(3000)])
    got = sharding.sharded(d, capacity=2000, units=64).collect()
    loads, groups = Counter(), {}
    for r in got:
        loads[r.shard] += r.size
        groups.setdefault(r.shard, set()).add((r.text_crc32, r.size))
    assert len(got) == 3000 and set(loads) == set(range(len(loads)))
    assert all(n <= 2000 or len(groups[s]) == 1 for s, n in loads.items())
    assert len(loads) <= 1.4 * sum(loads.values()) / 2000
    for s in loads:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_sql_counterparts(spark, docs, nothing):  # noqa: F811
    for name, op in (("op6_mixing", lambda d: mixing.mixed(d).select("doc_id", "size", "source_size", "target", "taken")), ("op3_license_scan", licenses.scan)):
        for d in (docs, nothing):
            con = duckdb.connect()
            con.register("documents", d.toArrow())
            want = con.sql(registered.SQL[name]).fetchall()
            assert sorted(map(str, map(tuple, op(d).collect()))) == sorted(map(str, want))


def test_mixing_of_many_sources(spark, docs, monkeypatch):  # noqa: F811
    """Without a broadcast the mix is the same, and ten thousand sources, one of them with a third of the rows, equal the SQL."""
    few = sorted(map(str, mixing.mixed(docs).collect()))
    rng = random.Random(3)
    many = make_docs(spark, [(i, words(rng, rng.randint(0, 9)), None if i % 3 == 0 else f"s{i % 14999}") for i in range(15000)])
    con = duckdb.connect()
    con.register("documents", many.toArrow())
    want = sorted(map(str, con.sql(registered.SQL["op6_mixing"]).fetchall()))
    out = mixing.mixed(many).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(str, map(tuple, out.collect()))) == want
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert sorted(map(str, mixing.mixed(docs).collect())) == few


def test_mixing_stage(docs, rows):
    taken = mixing.mixed(docs).collect()
    for s in {r.source for r in taken}:
        mine = [r for r in taken if r.source == s]
        assert sum(r.taken for r in mine) == int(mine[0].target) and all(r.taken <= 3 * r.size for r in mine)
    out = mixing.mix_sources(docs.sparkSession, docs, "")
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in taken)


def test_licences(spark):  # noqa: F811
    body = licenses.TEMPLATES["MIT"]
    half = body.rfind(" ", 0, len(body) // 2)
    d = make_docs(spark, [(1, "hello\n" + body[:half] + "\n" + body[half:] + "\nbye", "s"), (2, "RELEASED under -- the mit license", "s"), (3, "no such thing", "s")])
    assert {(r.doc_id, r.first_line, r.last_line, r.license) for r in licenses.scan(d).collect()} == {(1, 1, 2, "MIT"), (2, 0, 0, "MIT notice")}


def test_licences_beside_long_lines(spark):  # noqa: F811
    """A line above the size bound is no match, spoils the run it stands in and nothing else."""
    notice = licenses.TEMPLATES["MIT notice"]
    long_ = "under the " + " ".join(f"x{k}" for k in range(5000))
    body = licenses.TEMPLATES["ISC"]
    half = body.rfind(" ", 0, len(body) // 2)
    parts = body[:half] + "\n" + body[half:]
    d = make_docs(spark, [(1, long_ + "\n" + notice, "s"), (2, long_, "s"), (3, parts + "\n" + long_, "s"), (4, parts + "\n\n" + long_, "s")])
    assert {(r.doc_id, r.first_line, r.last_line, r.license) for r in licenses.scan(d).collect()} == {
        (1, 1, 1, "MIT notice"), (4, 0, 1, "ISC")}
    assert licenses.scan(d, {}).count() == 0


def test_least_by_hash(spark):  # noqa: F811
    """The bound before the sort changes nothing, also if the keys are not even."""
    for keys in ([k * 2654435761 % 2 ** 32 for k in range(3000)], [2 ** 32 - 1 - k for k in range(3000)], [5] * 3000, [], [9]):
        df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "h long, i int")
        got = [r.h for r in common.least_by_hash(df, "h", 20, "i").collect()]
        assert sorted(got) == sorted(keys)[:20]


def test_fingerprints(docs, rows, nothing):
    order = sorted((r for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((str(i), len(t), hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()))
    got = fingerprint.fingerprints(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[93].fingerprint == by_id[94].fingerprint != "" and by_id[93].near_next == 1.0
    assert fingerprint.fingerprints(nothing).count() == 0


def _plain_sketch(text):
    """Sketch of a text by definition: chained 64-bit hashes of five words each, below an eighth of the range."""
    chained = lambda values: functools.reduce(lambda seed, v: xxhash.xxh64(v, seed=seed).intdigest(), values, 42)
    split = [w for w in re.split("[ \t-\r]+", (text or "").lower()) if w]
    codes = [struct.pack("<Q", chained([w.encode()])) for w in split]
    every = {chained(codes[i:i + 5]) for i in range(max(1, len(codes) - 4))} if codes else set()
    low = {h for h in every if h < 1 << 61}
    return low or ({min(every)} if every else set())


def test_sketches(spark, docs, rows):  # noqa: F811
    """Sketches, likeness, containment and merged sketches against plain sets."""
    texts = sorted({t or "" for _, t, _ in rows}) + ["a b c d", "one two three four five six", "Ä ß ü ö é x y z"]
    pairs = list(zip(texts, texts[7:] + texts[:7])) + list(zip(texts, texts))
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    d = d.select("i", fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"))
    got = d.select("i", "a", "b", fingerprint.merge(F.col("a"), F.col("b")).alias("both"), fingerprint.likeness(F.col("a"), F.col("b")).alias("like"),
                   fingerprint.containment(F.col("a"), F.col("b")).alias("held")).collect()
    unsigned = lambda hs: [h % (1 << 64) for h in hs]
    for r in got:
        a, b = map(_plain_sketch, pairs[r.i])
        assert unsigned(r.a) == sorted(a) and unsigned(r.b) == sorted(b)
        low = {h for h in a | b if h < 1 << 61}
        assert unsigned(r.both) == sorted(low or ({min(a | b)} if a | b else set()))
        assert r.like == (len(a & b) / len(a | b) if a | b else 1.0)
        assert r.held == (len(a & b) / len(a) if a else 1.0)
    by_id = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    for i, t, _ in rows:
        if i is not None and sum(j == i for j, *_ in rows) == 1:
            assert by_id[i].fingerprint == ",".join(f"{h:x}" for h in sorted(_plain_sketch(t)))


def test_fingerprint_ranges(docs, monkeypatch):
    whole = sorted(map(str, fingerprint.fingerprints(docs).collect()))
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 7)
    assert sorted(map(str, fingerprint.fingerprints(docs).collect())) == whole


def test_line_dedup(docs, rows, nothing):
    lines = sorted({((i is not None, i or 0, k), frozenset(line.lower().split())) for i, t, _ in rows if t
                    for k, line in enumerate(t.split("\n")) if line.split()}, key=lambda x: x[0])
    want = set()
    for p, a in lines:
        first = min((q for q, b in lines if q < p and len(a & b) >= 0.8 * len(a | b)), default=None)
        if first:
            want.add((p[1], p[2], first[1], first[2]))
    got = line_dedup.removed_lines(docs)
    assert {(r[0] or 0, r[1], r[2] or 0, r[3]) for r in map(tuple, got.collect())} == want
    assert line_dedup.removed_lines(nothing).count() == 0
    cleaned = line_dedup.without_lines(docs, got)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)


def test_line_dedup_at_the_threshold(spark):  # noqa: F811
    """Random lines with edits around the similarity of 0.8, of 1 to 200 words, with copies, against brute force."""
    rng = np.random.default_rng(5)
    lines = []
    for k in range(60):
        n = int(rng.choice([1, 2, 4, 9, 10, 18, 45, 200]))
        base = [f"w{int(x)}" for x in rng.zipf(1.3, n) % 5000]
        for _ in range(int(rng.integers(1, 5))):
            edits = int(rng.integers(0, n // 4 + 2))
            line = base[edits // 2:] + [f"e{k}x{int(x)}" for x in rng.integers(0, 9, edits - edits // 2)]
            lines += [" ".join(map(str, rng.permutation(line)))] * int(rng.integers(1, 4))
    order = rng.permutation(len(lines))
    texts = ["\n".join(lines[j] for j in order[i::40]) for i in range(40)]
    at = [((i, k), frozenset(line.split())) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n")) if line.split()]
    want = {}
    for p, a in at:
        first = min((q for q, b in at if q < p and len(a & b) >= 0.8 * len(a | b) - 1e-9), default=None)
        if first:
            want[p] = first
    got = line_dedup.removed_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["line_no"]): (r["first_doc_id"], r["first_line_no"]) for r in got} == want and len(got) == len(want) > 100


def test_line_dedup_verifies_the_earliest_first(spark, monkeypatch):  # noqa: F811
    """Of a group of near copies each line is held against the earliest one, not against all."""
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1:]]) for k in range(30)]
    asked, verify = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *rest: asked.append(pairs.count()) or verify(pairs, *rest))
    got = line_dedup.removed_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["first_doc_id"] for r in got} == {k: 0 for k in range(1, 30)} and asked == [29]


def test_lm_scores(docs, rows, nothing):
    count, total = Counter(), 0
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["\0"]
    for i, t, _ in rows:
        if not fold(i):
            count.update(tokens(t))
            total += len(tokens(t))
    want = sorted((str(i), fold(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), total,
                   round(sum(np.log10((count[w] + 1) / (total + len(count) + 1)) for w in tokens(t)), 6)) for i, t, _ in rows)
    got = lm_scoring.scores(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm_scoring.scores(nothing).count() == 0


def test_lm_learns_context(spark):  # noqa: F811
    rng = random.Random(2)
    cycle = [f"t{k}" for k in range(12)]
    text = lambda: " ".join(cycle[(s + k) % 12] for s in [rng.randrange(12)] for k in range(60))
    d = make_docs(spark, [(i, text(), "s") for i in range(200)])
    held = [r for r in lm_scoring.scores(d).collect() if r.held_out]
    assert held and all(r.score > r.base_score + 0.3 * r.n_tokens for r in held)


def test_lm_learns_from_the_third_previous_token(spark):  # noqa: F811
    """Three woven cycles of 30 tokens: only the third previous token tells the next one."""
    rng = random.Random(8)

    def text():
        starts = [rng.randrange(30) for _ in range(3)]
        return " ".join(f"t{(starts[k % 3] + k // 3) % 30}" for k in range(60))
    d = make_docs(spark, [(i, text(), "s") for i in range(300)])
    held = [r for r in lm_scoring.scores(d).collect() if r.held_out]
    assert held and all(r.score > r.base_score + 0.3 * r.n_tokens for r in held)


def lm_brute_force(rows):
    """Scores of a model whose classes do not look at the context: of each token its class's share, its frequency in the class, and what
    the previous token and the previous two make of that."""
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    lists = [[lm_scoring._END if w is None else np.uint64(xxhash.xxh3_64_intdigest(w)) for w in
              [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]] for _, t in rows]
    count = Counter(w for (i, _), ws in zip(rows, lists) if not fold(i) for w in ws)
    alone = np.sort(np.array(sorted(count, key=lambda w: (-count[w], w.astype(np.int64)))[:lm_scoring.ALONE], np.uint64))
    kind = {w: int(lm_scoring.classes_of(np.array([w]), alone)[0]) for ws in lists for w in ws}
    sums, types = Counter(), Counter()
    for w, c in count.items():
        sums[kind[w]] += c
        types[kind[w]] += 1
    pairs, cells = Counter(), Counter()
    before = lambda ws, p, k: tuple(ws[p - j] if p >= j else lm_scoring._END for j in range(1, k + 1))
    for (i, _), ws in zip(rows, lists):
        for p, w in enumerate(ws):
            if not fold(i) and kind[w] >= len(alone):
                for k in (1, 2):
                    pairs[before(ws, p, k), w] += 1
                    cells[before(ws, p, k), kind[w]] += 1
    out = []
    for (i, _), ws in zip(rows, lists):
        log = 0.0
        for p, w in enumerate(ws):
            log += np.log10((sums[kind[w]] + 1) / (sum(sums.values()) + len(alone) + lm_scoring.GROUPS))
            if kind[w] >= len(alone):
                share = (count[w] + 1) / (sums[kind[w]] + types[kind[w]] + 1)
                for k in (1, 2):
                    share = (pairs[before(ws, p, k), w] + lm_scoring.PRIOR * share) / (cells[before(ws, p, k), kind[w]] + lm_scoring.PRIOR)
                log += np.log10(share)
        out.append((str(i), round(log, 3)))
    return sorted(out)


def test_lm_context_inside_a_class(spark):  # noqa: F811
    """Also the token inside its class depends on the tokens before it, counted over all blocks: against brute force, with repeated
    rows, null ids and texts, texts of other blocks and two blocks that are the same."""
    rng = random.Random(21)
    some = [(i, words(rng, rng.randint(1, 60), 150)) for i in range(60)]
    some += [(None, None), (3, ""), (7, None), (None, "w1 w2 w1 w2"), *some[:5], (200, "w3 W3 never\tseen")]
    d = spark.createDataFrame(some, "doc_id long, text string").repartition(4)
    d = d.union(spark.createDataFrame([(9, "w5 w6 w7"), (10, "w6 w5")], "doc_id long, text string").coalesce(1))
    d = d.union(spark.createDataFrame([(9, "w5 w6 w7"), (10, "w6 w5")], "doc_id long, text string").coalesce(1))
    rows = some + 2 * [(9, "w5 w6 w7"), (10, "w6 w5")]
    got = lm_scoring.scores(d, passes=0).collect()
    assert len(got) == len(rows)
    for (i, a), (j, b) in zip(sorted((str(r.doc_id), round(r.score, 3)) for r in got), lm_brute_force(rows)):
        assert i == j and abs(a - b) < 0.01


def test_lm_shares_inside_a_class_add_up():
    """After any context the tokens of a class and its unknown token have all of its probability."""
    counts, kind = np.array([5, 1, 9, 0]), np.zeros(4, int)  # the last one is unknown
    inside = np.array([counts.sum() + 3 + 1.0])
    contexts = [(np.array([4, 0, 2, 0]), np.full(4, 6)), (np.array([1, 0, 0, 0]), np.full(4, 1))]
    for given in ([], contexts[:1], contexts):
        share = 10 ** lm_scoring._inside(counts, kind, inside, given) * (counts + 1) / inside[0]
        assert abs(share.sum() - 1) < 1e-12


def test_quality(spark, nothing):  # noqa: F811
    rng = random.Random(4)
    good = lambda: ". ".join(words(rng, 9, 3000).capitalize() for _ in range(8)) + "."
    bad = [lambda: "!! ".join(words(rng, 1).upper() for _ in range(60)), lambda: " | ".join(words(rng, 1) for _ in range(60)),
           lambda: "*** ".join(words(rng, 1, 3000) for _ in range(60)), lambda: " ".join(f"w{k}" for k in range(5) for _ in range(20))]
    d = make_docs(spark, [(i, bad[i % 4]() if i % 8 < 2 else good(), "s") for i in range(400)] + [(500, None, "s"), (501, "", "s")])
    kept = {r.doc_id for r in quality.keep_good(spark, d, "").collect()}
    assert kept == {i for i in range(400) if i % 8 >= 2}
    assert quality.keep_good(spark, nothing, "").count() == 0


def test_subsequence_kernel():
    unit, other = "banana", "bandana"

    def phi(u):
        out = Counter()
        for i in range(len(u)):
            for j in range(i + 1, len(u)):
                for k in range(j + 1, len(u)):
                    out[u[i] + u[j] + u[k]] += toxicity.LAMBDA ** (k - i + 1)
        return out
    dot = lambda a, b: sum(v * b[k] for k, v in a.items())
    want = dot(phi(unit), phi(other)) / (dot(phi(unit), phi(unit)) * dot(phi(other), phi(other))) ** 0.5
    assert abs(toxicity.kernel_sums([unit], *toxicity._landmark_table([other]))[0, 0] - want) < 1e-5


def test_toxicity(spark, nothing):  # noqa: F811
    rng = random.Random(9)
    syllables = ["ra", "ti", "mo", "len", "sur", "pa", "ged", "win", "tor", "bel"]
    text = lambda: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(60))
    slurs = ["zugwump", "hakfink"]
    rows = [(i, text() + (" " + slurs[i % 2] if i % 5 == 0 else "") + " " + text(), "s") for i in range(600)]
    odd = [(1001, text() + " z.u.g.w.u.m.p " + text(), "s"), (1002, text() + " h a k f i n k " + text(), "s"), (1003, text() + " zug*wump", "s"),
           (1004, text(), "s"), (1005, None, "s"), (1006, "", "s")]
    d = make_docs(spark, rows + odd)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _, _ in rows] + [(None, 1, 1), (1004, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(d, labels).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i, _, _ in rows)
    assert [got[i] >= 0.5 for i in range(1001, 1007)] == [True, True, True, False, False, False]
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert all(r.score < 0.5 for r in toxicity.toxicity(d, labels.filter("toxic = 0")).collect())


def test_pipeline(spark):  # noqa: F811
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} == set(out.columns) and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_long_texts_are_read_in_stretches(monkeypatch):
    """Quality and language-model features of texts far longer than the arrays in memory equal those of a single stretch."""
    import pyarrow as pa
    rng = random.Random(12)
    texts = [None, "", "ab\nc", "x", *("\n".join(words(rng, rng.randint(1, 40)) + rng.choice([" !!", " a|b|c", "", "é é"])
                                              for _ in range(n)) for n in (1, 400, 3, 60))]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "carry": texts})
    weights, posterior = np.random.default_rng(1).normal(size=quality.HASHED + 3 * quality.BINS), np.arange(3 ** 7) / 3 ** 7
    blocks = list(lm_scoring._blocks(iter([batch])))
    alone = np.sort(np.frombuffer(blocks[0]["vocabulary"][0].as_py(), np.uint64)[::40])
    table = np.random.default_rng(2).normal(size=(lm_scoring._KINDS * lm_scoring.CELLS + 1, len(alone) + lm_scoring.GROUPS)).astype(np.float32)
    inside = np.ones(table.shape[1])

    def all_of():
        scored = list(quality._scores(weights, 0.1, posterior)(iter([batch])))
        rows = list(quality._feature_rows(iter([batch])))
        gradient = list(lm_scoring._gradients(table, alone)(iter(blocks)))
        parts = list(lm_scoring._class_parts(table, alone, inside)(iter(blocks)))
        return [np.concatenate([np.asarray(b[c].flatten() if hasattr(b[c], "flatten") else b[c]) for b in bs]) for bs, c in (
            (scored, "score"), (scored, "label"), (rows, "pattern"), (gradient, "visits"), (gradient, "g"), (parts, "parts"))]

    whole = all_of()
    monkeypatch.setattr(quality, "PIECE", 100)
    monkeypatch.setattr(lm_scoring, "STRETCH", 77)
    monkeypatch.setattr(lm_scoring, "STEP", 13)
    for a, b in zip(whole, all_of()):
        assert a.shape == b.shape and np.allclose(a, b, rtol=1e-4, atol=1e-3)


def test_estimate_finds_planted_accuracies():
    """Votes drawn from known accuracies: expectation-maximisation gets them back, and the posterior of every pattern."""
    rng = np.random.default_rng(5)
    n, share = 200_000, 0.7
    good = rng.random(n) < share
    hit = np.array([0.9, 0.85, 0.8, 0.75, 0.9, 0.7, 0.8])
    silent = 0.2
    right = np.where(good, 1, 2)[:, None]
    votes = np.where(rng.random((n, 7)) < silent, 0, np.where(rng.random((n, 7)) < hit, right, 3 - right))
    pattern = (votes * 3 ** np.arange(7)).sum(axis=1)
    posterior, tables = quality.estimate(np.bincount(pattern, minlength=3 ** 7).astype(float))
    for k in range(7):
        assert abs(tables[1, k, 1] - (1 - silent) * hit[k]) < 0.02 and abs(tables[0, k, 2] - (1 - silent) * hit[k]) < 0.02
    every = np.arange(3 ** 7)[:, None] // 3 ** np.arange(7) % 3
    odds = np.log(share / (1 - share)) + np.where(every == 1, 1, np.where(every == 2, -1, 0)) @ np.log(hit / (1 - hit))
    seen = np.bincount(pattern, minlength=3 ** 7) > 50
    assert np.abs(posterior - 1 / (1 + np.exp(-odds)))[seen].max() < 0.1


def test_expected_counts_by_cell():
    """The sums by feature cell equal one addition for each token and kind, and a column of probabilities adds up to one."""
    from scriptlode.llm import lm_scoring as lm
    rng = np.random.default_rng(3)
    weights = rng.normal(0, 0.5, (4 * lm.CELLS + 1, 6)).astype(np.float32)
    cells = (rng.integers(0, 5, (500, 4)) + np.arange(4) * lm.CELLS).astype(np.int32)
    share = lm._probabilities(weights, cells)
    logits = weights[cells].sum(axis=1, dtype=np.float64) + weights[-1]
    plain = (np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)).T
    assert np.allclose(share, plain, atol=1e-6) and np.allclose(share.sum(axis=0), 1, atol=1e-12)
    total, slow = np.zeros((6, 4 * lm.CELLS + 1)), np.zeros((6, 4 * lm.CELLS + 1))
    lm._add_by_cell(total, share, cells)
    for k in range(4):
        np.add.at(slow.T, cells[:, k], share.T)
    assert np.allclose(total, slow, atol=1e-9)
