"""Merkle manifest, source audit and exact dedup against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptlode.llm import divergence, exact_dedup, merkle

from ..conftest import spark  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, tree string, at int, copies int, batch int, n int, p int"


def make(spark, rows):  # noqa: F811
    """Documents (doc_id, text, lang, source) with extra columns named like the operators' own."""
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, "h", "t", 1, 2, 3, 4, 5) for r in rows], SCHEMA)


def sample(rng, n, langs=("en", "de", None)):
    words = ["Alpha", "beta", "GAMMA", "delta", "Straße", "naïve", "ÀB", "Donaudampfschifffahrt", "x" * 40, "Y" * 17, "eightsix", "nine99nin", "sixteenletterswo"]
    out = []
    for i in range(n):
        text = rng.choice([None, "", " \t\n"]) if rng.random() < 0.1 else rng.choice([" ", "\n", "1", "\t "]).join(rng.choices(words, k=rng.randint(1, 30)))
        out.append((rng.choice([None, i, i, i, i // 2]), text, rng.choice(langs), rng.choice(["a", "b", "c", None, ""])))
    return out + [out[0], out[0]]


# -- Merkle manifest ----------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def reference_manifest(rows):
    def leaf(doc_id, text, lang, source):
        fields = (doc_id, source, lang, len(text) if text else None, text)
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def climb(tree, at, node):
        proof = ""
        for level in tree[:-1]:
            run, i = level[at // 8 * 8:at // 8 * 8 + 8], at % 8
            proof += "".join(run[:i] + run[i + 1:])
            node = sha("".join(run[:i]) + node + "".join(run[i + 1:]))
            at //= 8
        return node, proof

    by = defaultdict(list)
    for doc_id, text, lang, source in rows:
        now = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            now = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        # The changed text has as many characters, so n_chars stays.
        by[lang].append((doc_id, leaf(doc_id, text, lang, source), leaf(doc_id, now, lang, source)))
    trees = []
    for lang in sorted(by, key=lambda x: (x is not None, (x or "").encode())):
        rows = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append((rows, levels([r[1] for r in rows])))
    top = levels([tree[-1][0] for _, tree in trees])
    out = []
    for no, (rows, tree) in enumerate(trees):
        for at, (doc_id, own, now) in enumerate(rows):
            node, proof = climb(tree, at, now)
            root, more = climb(top, no, node)
            out.append((doc_id, own, tree[-1][0], top[-1][0], sha(proof + more), root, root == top[-1][0]))
    return out


def manifest(spark, rows):  # noqa: F811
    docs = make(spark, rows)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return [tuple(r) for r in merkle.manifest(docs, F.translate("text", capitals, capitals.lower()), F.crc32(F.col("doc_id").cast("string")) % 3 == 0).collect()]


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("n, langs", [(700, ("en", "de", None, "fr")), (60, tuple(f"l{i}" for i in range(20))), (9, ("en",)), (65, (None,))])
def test_manifest(spark, n, langs):  # noqa: F811
    rows = sample(random.Random(n), n, langs)
    want = reference_manifest(rows)
    assert sorted(manifest(spark, rows), key=key) == sorted(want, key=key)
    if n == 700:
        assert {r[-1] for r in want} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):  # noqa: F811
    row = [(1, "Text", "en", "a")]
    assert manifest(spark, row) == reference_manifest(row)
    assert manifest(spark, []) == []


def test_any_changed_field_breaks_the_proof(spark):  # noqa: F811
    rows = [(i, f"text {i}", "en", "a") for i in range(20)]
    docs = make(spark, rows)
    got = {r["doc_id"]: r["verified"] for r in merkle.manifest(docs, F.lit("another"), F.col("doc_id") == 13).collect()}
    assert got == {i: i != 13 for i in range(20)}


def test_limit_of_recursion_is_put_back(spark):  # noqa: F811
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    manifest(spark, [(i, "t", "en", "a") for i in range(10)])
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


# -- source audit -------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def reference_audit(rows, least=3, top=200):
    seen, groups, count, lang_count = defaultdict(set), set(), Counter(), Counter()
    for at, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for term in TERM.findall(text or ""):
            term = re.sub("[A-Z]", lambda m: m[0].lower(), term)
            seen[lang, term].add(at)
            count[lang, source, term] += 1
            lang_count[lang, term] += 1
    kept = defaultdict(list)
    for (lang, term), docs in seen.items():
        if len(docs) >= least:
            kept[lang].append(term)
    share = lambda n, total, v: 1 + 10 ** 9 * (n + 1) // (total + v)
    gap = lambda p, q: (p - q) ** 2 // q
    out = []
    for lang, source in groups:
        terms = kept[lang]
        total = {s: sum(count[lang, s, t] for t in terms) for lg, s in groups if lg == lang}
        whole = sum(lang_count[lang, t] for t in terms)
        p = {s: [share(count[lang, s, t], n, len(terms)) for t in terms] for s, n in total.items()}
        pairs = [(sum(map(gap, p[source], p[s])), s) for s in total if s != source]
        own = [(gap(a, b), t) for t, a in zip(terms, p[source]) if count[lang, source, t] and a > (b := share(lang_count[lang, t], whole, len(terms)))]
        for part, found in (("pair", pairs), ("term", own)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top]
    return out


@pytest.mark.parametrize("n", [3, 40, 400])
def test_audit(spark, n):  # noqa: F811
    rows = sample(random.Random(n), n) + [(None, "word " * 9, "zz", "only"), (None, None, "yy", "a"), (None, "", "yy", "b")]
    got = [tuple(r) for r in divergence.audit(make(spark, rows).repartition(3)).collect()]
    assert sorted(got) == sorted(reference_audit(rows))


def test_audit_of_many_words(spark):  # noqa: F811
    """More terms than the report lists, and words of every length class with a shared beginning."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcXYZéß", k=rng.randint(1, 40))) for _ in range(1500)]
    words += ["q" * n for n in range(1, 40)] + ["q" * n + "r" for n in range(1, 40)]
    rows = [(i, " ".join(rng.choices(words, k=400)), "en", f"s{i % 3}") for i in range(30)]
    got = [tuple(r) for r in divergence.audit(make(spark, rows)).collect()]
    assert sorted(got) == sorted(reference_audit(rows))
    assert max(r[5] for r in got) == 200


def test_long_texts_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 1000)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abé", k=rng.randint(1, 30))) for _ in range(n)) for n in (3, 2000, 1, 500)] + ["z" * 5000, ""]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 6, "source": ["s"] * 6, "text": texts})
    n, docs = Counter(), Counter()
    for out in divergence._count(iter([batch])):
        for term, a, b in zip(out["term"].to_pylist(), out["n"].to_pylist(), out["docs"].to_pylist()):
            n[term] += a
            docs[term] += b
    want, have = Counter(), Counter()
    for t in texts:
        want.update(TERM.findall(t))
        have.update(set(TERM.findall(t)))
    assert n.pop(None) == 0 and docs.pop(None) == 0
    assert n == want and docs == have


def test_radix_order():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3, 5000).astype(np.uint32), rng.integers(0, 2 ** 63, 5000).astype(np.uint64) >> np.uint64(50)
    order = divergence.radix_order([b, a])
    assert (order == np.lexsort((np.arange(5000), a, b))).all()


def test_audit_of_nothing(spark):  # noqa: F811
    assert divergence.audit(make(spark, [])).collect() == []


# -- exact dedup --------------------------------------------------------------------------------

def norm(text):
    return re.sub("[ \t-\r]+", " ", text or "")


def reference_groups(rows):
    by = defaultdict(list)
    for doc_id, text, *_ in rows:
        by[norm(text)].append(doc_id)
    out = []
    for text, ids in by.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        out += [(i, ids[0], len(ids), at == 0, hashlib.sha256(text.encode()).hexdigest()) for at, i in enumerate(ids)]
    return sorted(out, key=key)


def groups(index):
    return sorted(map(tuple, index.groups().collect()), key=key)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(5)
    rows = [(i, f"text  number {rng.randrange(60)}\n", "en", "a") for i in range(300)] + [(1000 + i, "one hot text", "en", "a") for i in range(400)]
    rng.shuffle(rows)
    return rows + sample(rng, 50) + [(None, "no id", "en", "a"), (None, "no id", "en", "b"), (7, "No id", "en", "b"), (2000, "word " * 200_000, "en", "a")]


def test_exact_groups(spark, copies):  # noqa: F811
    got = sorted(map(tuple, exact_dedup.exact_groups(make(spark, copies).repartition(5)).collect()), key=key)
    assert got == reference_groups(copies)
    assert sum(r[3] for r in got) == len({norm(r[1]) for r in copies})


def test_exact_groups_of_nothing(spark):  # noqa: F811
    assert exact_dedup.exact_groups(make(spark, [])).collect() == []


def test_batches_and_deletion(spark, copies, monkeypatch):  # noqa: F811
    monkeypatch.setattr(exact_dedup, "PER_PART", 4)  # parts are dealt anew as the index grows
    rows = [r for r in copies if r[0] is not None]
    a, b = rows[:100], rows[100:]
    index = exact_dedup.CuckooIndex.build(make(spark, a)).insert(make(spark, b))
    assert index.parts > 1
    assert groups(index) == reference_groups(rows)
    rng = random.Random(6)
    gone = rng.sample(rows, 250) + [r for r in rows if norm(r[1]) == "one hot text"]
    stay = [r for r in rows if (r[0], norm(r[1])) not in {(g[0], norm(g[1])) for g in gone}]
    index = index.delete(make(spark, gone + [(5, "never inserted", "en", "a")]))
    assert groups(index) == reference_groups(stay)
    live = {norm(r[1]): min(x[0] for x in stay if norm(x[1]) == norm(r[1])) for r in stay}
    seen = index.seen(make(spark, rows[:60]))
    assert sorted(map(tuple, seen.select("doc_id", "keep_id").collect()), key=key) == sorted(((r[0], live.get(norm(r[1]))) for r in rows[:60]), key=key)
    again = index.insert(make(spark, gone))
    assert groups(again) == reference_groups(stay + gone)


def test_filter_resizes_and_forgets():
    cuckoo = exact_dedup.CuckooFilter([], buckets=1)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for d in digests[:4000]:
        assert cuckoo.find(d) < 0
        cuckoo.add([d, 0, 0, 0, 1])
    assert cuckoo.buckets * exact_dedup.SLOTS < 4 * 4000
    assert all(cuckoo.find(d) >= 0 for d in digests[:4000]) and all(cuckoo.find(d) < 0 for d in digests[4000:])
    for d in digests[:4000:2]:
        cuckoo.remove(cuckoo.find(d))
    assert all((cuckoo.find(d) >= 0) == (i % 2 == 1) for i, d in enumerate(digests[:4000]))
    copy = exact_dedup.CuckooFilter.loaded(cuckoo.keys, cuckoo.slots.tobytes(), cuckoo.owners.tobytes())
    assert all(copy.find(d) == cuckoo.find(d) for d in digests)
