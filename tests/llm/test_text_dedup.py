"""Substring, suffix-array and near-duplicate removal against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from quiver.llm import common as C
from quiver.llm import minhash_dedup, spotsigs, substring_dedup, suffix_array_dedup
from quiver.llm.components import components

SCHEMA = "doc_id long, text string, bucket string, hits int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def corpus(seed=5, n=60):
    """Prose with copies, near copies, shared passages, repeats within a text, nulls and odd characters."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 160))]
        kind = i % 6
        if kind == 1 and rows:
            words = (rows[rng.randrange(len(rows))][1] or "a").split(" ")
            words[rng.randrange(len(words))] = "edited"
        if kind == 2:
            words[rng.randint(0, len(words)):0] = passage.split(" ")
        if kind == 3:
            words = words + words
        text = rng.choice([" ", "\n", " \t"]).join(words)
        if kind == 4 and rows:
            text = rows[rng.randrange(len(rows))][1]
        rows.append((i * 7 % 1000 - 20, text))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "x" * 99), (2004, "x" * 350), (2005, "ab" * 200), (2006, "one"), (2007, "one")]
    rng.shuffle(rows)
    return rows


def brute_substring(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest())
    return out


def brute_suffix(rows, length):
    seen, out = set(), {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            s = t[k:k + length]
            if s in seen:
                gone[k:k + length] = b"\x01" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), kept)
    return out


def word_sets(rows, size):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def brute_components(sets, share):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and share[1] * both >= share[0] * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("window", [3, 13])
def test_substring_removal_equals_brute_force(spark, window):
    rows = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, rows), window).collect()}
    assert got == brute_substring(rows, window)


def test_substring_repeated_ids_are_not_smaller_than_each_other(spark):
    text = " ".join(f"w{k}" for k in range(20))
    got = [(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, [(1, text), (1, text), (2, text)])).collect()]
    assert sorted(got) == [(1, 0), (1, 0), (2, 20)]


BIG = (1 << 53) + 1


def null_id_rows():
    """Rows without a doc_id: a copy of an id's text, two copies of each other, a text of its own, a null."""
    rng = random.Random(21)
    a, b, c = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40)) for _ in range(3))
    return [(BIG, a), (BIG + 1, "some words " + a), (None, a), (None, b), (None, b), (None, c), (None, None)], a, b, c


def test_null_ids_come_after_all_ids(spark):
    rows, a, b, c = null_id_rows()
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(BIG, 40, 0), (BIG + 1, 42, 40), (None, 40, 40), (None, 40, 0), (None, 40, 40), (None, 40, 0), (None, 0, 0)], key=repr)
    n = len(a)
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_array_dedup.remove_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(BIG, n, 0), (BIG + 1, n + 11, n), (None, n, n), (None, n, 0), (None, n, n), (None, n, 0), (None, 0, 0)], key=repr)
    got = [(r.doc_id, r.n_chars) for r in spotsigs.compare_with_edits(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(i, len(t or "")) for i, t in rows], key=repr)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.suffix_dedup(spark, frame(spark, rows), "").collect()]
    assert sorted(kept, key=repr) == sorted([(BIG, a), (BIG + 1, "some words "), (None, b), (None, c), (None, None)], key=repr)


def test_difference_cover_is_perfect():
    d, v = suffix_array_dedup.COVER, suffix_array_dedup.COVER_MODULUS
    assert sorted((a - b) % v for a in d for b in d if a != b) == list(range(1, v))


@pytest.mark.parametrize("length", [40, 100])
def test_suffix_removal_equals_brute_force(spark, length):
    rows = corpus(seed=length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_array_dedup.remove_duplicates(frame(spark, rows), length).collect()}
    assert got == brute_suffix(rows, length)


def test_suffix_repeated_ids_count_once(spark):
    text = "".join(random.Random(4).choices("abcdefghij", k=300))
    got = [(r.doc_id, r.n_removed) for r in suffix_array_dedup.remove_duplicates(frame(spark, [(5, text), (5, text), (9, text)])).collect()]
    assert sorted(got) == [(5, 0), (9, 300)]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rows = corpus(seed=9 + size, n=90)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(frame(spark, rows), size).collect()}
    sets = word_sets(rows, size)
    roots = brute_components(sets, (80, 100))
    assert got == {i: (len(sets[i]), roots[i], roots[i] == i) for i in sets}


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rng = random.Random(11)
    a, b, c, d = (" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(4))
    big = (1 << 53) + 1
    rows = [(5, a), (5, b), (5, b), (7, b), (7, c), (3, c + " x"), (None, a + " y"), (None, d), (None, d + " z"), (None, None), (big, "lone text here now")]
    want = [(5, 5, True), (5, 5, True), (5, 5, True), (7, 5, False), (7, 3, False), (3, 3, True), (None, 5, False), (None, None, True), (None, None, True),
            (None, None, True), (big, big, True)]
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = corpus_pipeline.near_dedup(spark, frame(spark, [*rows, (7, "of its own")]), "").collect()
    gone = [(7, b), (7, c), (None, a + " y")]
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([x for x in rows if x not in gone] + [(7, "of its own")], key=repr)


def test_chains_of_near_copies_share_a_component(spark):
    """Each text is close to the next only: links must not be lost although no text is close to all."""
    words = [f"w{k}" for k in range(200)]
    rows = [(100 - k, " ".join([f"v{k}x{j}" for j in range(0)] + words[:200 - 0] if k == 0 else [f"e{j}" for j in range(k * 6)] + words[k * 6:])) for k in range(12)]
    sets = word_sets(rows, 4)
    roots = brute_components(sets, (80, 100))
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == roots and set(roots.values()) == {89}


def test_register_agreement_estimates_jaccard(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)

    def sketch(x):
        return minhash_dedup.registers(np.array([((x * m + a) >> np.uint64(32)).astype(np.uint32).min() for m, a in zip(minhash_dedup._MUL, minhash_dedup._ADD)]))

    a, b = sketch(h[:2700]), sketch(h[300:])  # Jaccard 0.8
    more, same = int((a > b).sum()), int((a == b).sum())
    from pyspark.sql import functions as F

    lit = lambda x: F.lit(float(x))
    got = spark.range(1).select(minhash_dedup.likelihood_estimate(lit(more), lit(same), lit(2700), lit(2700)).alias("j")).first()["j"]
    assert abs(got - 0.8) < 0.12
    # registers merge by maximum
    assert (np.maximum(sketch(h[:1000]), sketch(h[1000:])) == sketch(h)).all()


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 240)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("run", [substring_dedup.remove_repeats, suffix_array_dedup.remove_duplicates, minhash_dedup.near_duplicates])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).count() == 0


def test_bitmap_split_never_misses(spark):
    docs = spark.range(5000).withColumnRenamed("id", "doc_id")
    ids = docs.where("doc_id % 7 = 0")
    maybe, surely_not = C.split_by(docs, ids)
    assert maybe.count() + surely_not.count() == 5000
    assert surely_not.where("doc_id % 7 = 0").count() == 0
    assert C.split_by(docs, ids.where("false"))[0].count() == 0


def crowd(seed, n=160, words=60, base=False):
    """Copies of one text with one to seven words replaced - some by words that several copies share -, cut or
    lengthened; most pairs of them stand near the threshold."""
    rnd = random.Random(seed)
    text = [f"w{seed}x{i}" for i in range(words)]
    out = [" ".join(text)] if base else []
    for c in range(n):
        w = list(text)
        for _ in range(rnd.randint(1, 7)):
            w[rnd.randrange(len(w))] = f"s{rnd.randrange(6)}" if rnd.random() < 0.3 else f"own{c}x{rnd.randrange(99)}"
        w = w[rnd.choice([0, 0, 0, 2]):] if rnd.random() < 0.5 else w + [f"tail{c}"] * rnd.choice([0, 0, 3])
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("few", [1, 8, 10_000], ids=["base only", "both", "sketches only"])
@pytest.mark.parametrize("share", [(80, 100), (9, 10)])
def test_crowds_of_near_copies(spark, monkeypatch, few, share):
    monkeypatch.setattr(minhash_dedup, "FEW_ROOTS", few)
    texts = [*crowd(1, words=150), *crowd(2, 60, 120, base=True), *crowd(3, 30, 30), "one two", "one two", "", None]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = word_sets(rows, 4)
    roots = brute_components(sets, share)
    assert len(set(roots.values())) > 60 and len(roots) - len(set(roots.values())) > 20
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, 4, share).collect()}
    assert got == roots


@pytest.mark.parametrize("seed", range(3))
def test_differences_from_a_base_join_what_is_linked(spark, seed):
    """Whatever sets the base is made of - also of strangers, and one text - the same components come out."""
    rnd = random.Random(seed)
    texts = crowd(seed, 50, 20) + [" ".join(f"z{rnd.randrange(9)}" for _ in range(rnd.randint(1, 12))) for _ in range(20)]
    sets = word_sets(list(enumerate(texts)), 4)
    number = {}
    rows = [(g, i, i, sorted(number.setdefault(x, len(number)) for x in s)) for g in (0, 1) for i, s in sets.items() if g == 0 or i % 3 == 0]
    members = spark.createDataFrame(rows, "group long, key long, root long, shingles array<long>")
    for share in ((80, 100), (1, 2)):
        links = {frozenset((r.a, r.b)) for r in minhash_dedup.apart(members, share).collect()}
        linked = lambda x, y: share[1] * len(x & y) >= share[0] * len(x | y)
        assert all(linked(sets[min(p)], sets[max(p)]) for p in links)
        root = {i: i for i in sets}
        for p in links:
            a, b = root[min(p)], root[max(p)]
            root = {i: min(a, b) if r in (a, b) else r for i, r in root.items()}
        assert root == brute_components(sets, share)
    assert minhash_dedup.apart(members.limit(0), (80, 100)).count() == 0


def test_samples_of_a_large_batch_take_bounded_memory():
    """A batch of texts is sampled in pieces, whose arrays and power tables stay small, and no piece changes a sample."""
    import tracemalloc

    import numpy as np

    from quiver.llm import common as C
    from quiver.llm.suffix_array_dedup import Cover

    buf = np.random.default_rng(1).integers(97, 123, 6 << 20).astype(np.uint8)
    offsets = np.arange(0, len(buf) + 1, 4096)
    cover, hash_of = Cover(100), C.Poly(301)
    fresh, C.POLY = C.POLY, hash_of
    try:
        tracemalloc.start()
        got = []
        for lo, hi in C.pieces(offsets):
            _, row, bucket, name = cover.samples(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], 7)
            got.append((row + lo, bucket, name))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100 << 20
        _, row, bucket, name = cover.samples(buf, offsets, 7)
    finally:
        C.POLY = fresh
    for a, b in zip((row, bucket, name), map(np.concatenate, zip(*got))):
        assert (a == b).all()
