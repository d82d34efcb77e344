"""Toxicity network, decontamination and fingerprints."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quiver.llm import common as C
from quiver.llm import decontamination as decon
from quiver.llm import spotsigs
from quiver.llm import toxicity as tox

# -------------------------------------------------------------------- toxicity


def toxic_corpus(n=400, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 260))]
        toxic = i % 4 == 0
        if toxic:  # one whole word, or one word start with any ending
            words.insert(rng.randint(0, len(words)), rng.choice(["Idiot,", "scumbag", "zzqx" + rng.choice(vocabulary)]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_gradients_are_right():
    """Analytic gradients against central differences, in double precision."""
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in tox.init(5, np.linspace(-1, 1, 5), rng).items()}
    x = rng.normal(0, 1, (6, 3, tox.EMBED))
    mask = (np.arange(6)[:, None] < np.array([6, 4, 1])).astype(np.float64)
    x *= mask[:, :, None]
    y, w = np.array([1, 0, 1]), np.ones(3)

    def loss(q, x=x):
        s = [tox.gru(x @ q["w" + d] + q["b" + d], mask, q["u" + d], d == "b", False)[0].astype(np.float64) for d in "fb"]
        z = tox.pool(np.concatenate(s, 2), mask, q)[3]
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    g, dx = tox.gradients(x, mask, y, w, p)
    for k in ("wf", "uf", "ub", "bb", "wa", "ba", "va", "out", "c"):
        for _ in range(3):
            i = tuple(rng.integers(0, s) for s in p[k].shape)
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][i] += 1e-2
            down[k][i] -= 1e-2
            assert abs((loss(up) - loss(down)) / 2e-2 - g[k][i]) < 2e-3, k
    i = (2, 1, 3)
    up, down = x.copy(), x.copy()
    up[i] += 1e-2
    down[i] -= 1e-2
    assert abs((loss(p, up) - loss(p, down)) / 2e-2 - dx[i]) < 2e-3


def test_windows_overlap_and_cover():
    doc, first, size = tox.windows(np.array([0, 5, 64, 65, 200]))
    for d, n in enumerate([0, 5, 64, 65, 200]):
        spans = [(f, f + s) for i, f, s in zip(doc, first, size) if i == d]
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(b[0] - a[0] == tox.STRIDE for a, b in zip(spans, spans[1:]))
        assert all(s <= tox.WORDS for _, _, s in [(0, 0, e - f) for f, e in spans])


def test_features_do_not_depend_on_neighbours():
    texts = [b"abcdef ghi", b"xyzzy", b"", b"abcdef ghi"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    doc, word, owner, gram = tox.tokens(np.frombuffer(b"".join(texts), np.uint8), offsets)
    of = lambda d: (word[doc == d].tolist(), gram[doc[owner] == d].tolist())
    assert of(0) == of(3) and of(0)[1]
    alone = tox.tokens(np.frombuffer(texts[1], np.uint8), np.array([0, 5]))
    assert of(1) == (alone[1].tolist(), alone[3].tolist())


def test_held_out_accuracy(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (902, "word " * 30000 + "idiot", "x"), (3, rows[3][1], "x")],
                                 "doc_id long, text string, toxicity2 string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5, 0, None), (7000, 0, 1), (6, 0, 5), (0, 0, 0)], "doc_id long, quality int, toxic int")
    got = tox.scores(docs, tox.fit(docs, labels)).collect()
    assert len(got) == 404 and all(0 <= r.toxicity <= 1 for r in got)
    score = {r.doc_id: r.toxicity for r in got}
    held = [(y, score[i] >= 0.5) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert score[900] == score[901] < 0.5 <= score[902]  # every window of a long text counts


def test_scores_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.toxicity for r in tox.scores(docs, tox.fit(docs, labels)).collect()] == [0.0]
    assert tox.scores(docs.where("false"), tox.fit(docs.where("false"), labels)).count() == 0


# ------------------------------------------------------------ decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bench_case(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcé漢1") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, item(rng.randint(10, 30))) for k in range(12)] + [(20, item(3)), (21, item(7)), (22, ""), (23, None), (24, "..."), (5, "x " * 15), (25, "a a a a a a a a a a a a")]
    items.append((26, items[0][1]))
    docs = []
    for i in range(60):
        text = item(rng.randint(0, 60))
        if i % 3 == 0:
            source = rng.choice([t for _, t in items if t])
            part = words(source)
            lo = rng.randint(0, max(0, len(part) - 10))
            text += " " + "!".join(part[lo:lo + rng.randint(8, 20)]).upper() + " , " + item(5)
        docs.append((i, text))
    return docs + [(100, None), (101, ""), (102, "a " * 40), (103, items[0][1])], items


def brute_hits(docs, items, window=10):
    grams = {}
    for k, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1)) if w else []:
            grams.setdefault(tuple(w[s:s + window]), set()).add(k)
    out = {}
    for i, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for size in {len(g) for g in grams}:
            for s in range(len(w) - size + 1):
                g = grams.get(tuple(w[s:s + size]))
                if g:
                    found |= g
                    hit[s:s + size] = [True] * size
        out[i] = (len(w), hit, sorted(found))
    return out


def hits_of(rows):
    return {r.doc_id: (r.n_words, np.unpackbits(np.frombuffer(r.hit, np.uint8))[: r.n_words].astype(bool).tolist() if r.hit is not None else [False] * r.n_words,
                       sorted(r["items"])) for r in rows}


@pytest.mark.parametrize("shard", [400_000, 60])
def test_hits_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(decon, "SHARD_WORDS", shard)  # 60: several shards, each a pass
    docs, items = bench_case()
    df = decon._rows(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, items int"))
    got = hits_of(decon.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == brute_hits(docs, items)


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(decon, "SHARD_WORDS", 30)
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(150))
    docs, items = [(1, text), (2, " ".join(text.split()[24:40])), (3, "w1")], [(9, text)]
    got = hits_of(decon.contamination(decon._rows(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == brute_hits(docs, items)


@pytest.mark.parametrize("shard", [400_000, 30])
def test_repeated_rows_stay_whatever_the_number_of_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(decon, "SHARD_WORDS", shard)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(14))) for k in range(8)]
    docs = [(1, items[0][1]), (1, items[0][1]), (1, "other"), (2, None), (2, None), (None, items[3][1]), (None, items[3][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r["items"], r.hit is not None) for r in decon.contamination(decon._rows(df), bench).collect()]
    want = [(1, 14, [0], True)] * 2 + [(1, 1, [], False)] + [(2, 0, [], False)] * 2 + [(None, 14, [3], True)] * 2
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = decon.decontaminate(df, bench).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.text) == [(1, "other")] and sum(r.text is None for r in kept) == 2


def test_long_items_lower_only_ascii_letters(spark, monkeypatch):
    monkeypatch.setattr(decon, "SHARD_WORDS", 30)
    text = " ".join(f"Éw{k}Ü" for k in range(100))
    got = hits_of(decon.contamination(decon._rows(spark.createDataFrame([(1, text)], "doc_id long, text string")),
                                      spark.createDataFrame([(9, text)], "item_id long, text string")).collect())
    assert got == brute_hits([(1, text)], [(9, text)]) and all(got[1][1])


def test_automaton_tracks_longest_matches():
    rng = random.Random(2)
    items = [(k, [rng.randrange(3) for _ in range(rng.randint(1, 12))]) for k in range(8)]
    a = decon.SuffixAutomaton(items, 4)
    grams = {tuple(w[s:e]) for _, w in items for s in range(len(w)) for e in range(s + 1, len(w) + 1)}
    stream = [rng.randrange(4) for _ in range(300)]
    state, length = 0, 0
    for k, w in enumerate(stream):
        state, length = a.step(state, length, w)
        longest = max([n for n in range(0, 13) if n <= k + 1 and (n == 0 or tuple(stream[k + 1 - n:k + 1]) in grams)])
        assert length == longest


def test_decontaminated_documents(spark):
    item = " ".join(f"q{k}" for k in range(12))
    clean = "a clean text\nwith lines"
    docs = [(1, f"Before, {item.upper()}! after " + "x " * 30, 7), (2, item, 7), (3, clean, 7), (4, None, 7), (3, clean, 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    got = sorted((r.doc_id, r.text, r.n_chars) for r in decon.decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect() if r.text is not None)
    cut = "Before, ! after " + "x " * 30
    assert got == [(1, cut, len(cut)), (3, clean, 7), (3, clean, 7)]
    assert decon.decontaminate(df, spark.createDataFrame([], "item_id long, text string")).count() == 5
    assert decon.removed_spans(np.packbits([1, 1, 0, 1]).tobytes(), 4, 2) == [(0, 2)]


# --------------------------------------------------------------- fingerprints


def brute_signatures(text):
    anchors = set(spotsigs.ANCHORS)
    w = words(text)
    out = set()
    for k, x in enumerate(w):
        if x in anchors:
            content = [y for y in w[k + 1:] if y not in anchors][: spotsigs.CHAIN]
            if len(content) == spotsigs.CHAIN:
                out.add((x, *content))
    return out


def prose(n=50, seed=12):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + spotsigs.ANCHORS[:12] * 12
    rows = [(i * 3 - 9, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 150)))) for i in range(n)]
    for i in range(0, n, 5):  # near copies
        w = rows[i][1].split(" ")
        w[rng.randrange(len(w))] = "edit"
        rows.append((1000 + i, " ".join(w)))
    return rows + [(2000, None), (2001, ""), (2002, "..."), (2003, "word"), (2004, "The the the"), (2005, "é" * 5)]


def test_signature_sets_equal_brute_force():
    texts = [t or "" for _, t in prose()]
    got = spotsigs.signatures([t.encode() for t in texts], spotsigs._anchor_hashes(spotsigs.ANCHORS))
    for t, s in zip(texts, got):
        assert len(s) == max(1, len(brute_signatures(t)))
    for a, x in zip(texts, got):
        for b, y in zip(texts, got):
            p, q = brute_signatures(a), brute_signatures(b)
            if p and q:
                assert spotsigs.jaccard(x, y) == len(p & q) / len(p | q)


@pytest.mark.parametrize("slices", [1, 5, 400])
def test_edited_texts_and_neighbours(spark, monkeypatch, slices):
    monkeypatch.setattr(C, "shuffle_buckets", lambda *a, **k: slices)
    rows = prose()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in spotsigs.compare_with_edits(df).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(order)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edit = t[: len(t) - half] + following[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        p, q, n = (brute_signatures(x) for x in (t, edit, following))
        if p and q and n:
            assert got[i].near_edited == len(p & q) / len(p | q) and got[i].near_next == len(p & n) / len(p | n)
    for a in got.values():
        for b in got.values():
            if dict(order)[a.doc_id] == dict(order)[b.doc_id]:
                assert a.fingerprint == b.fingerprint
    assert spotsigs.compare_with_edits(df.where("false")).count() == 0


def test_one_document_is_its_own_neighbour(spark):
    df = spark.createDataFrame([(1, "the word stands of itself")], "doc_id long, text string")
    assert [r.near_next for r in spotsigs.compare_with_edits(df).collect()] == [1.0]


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_similar_pairs_equal_brute_force(spark, threshold):
    rows = prose(80)
    prints = spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.a, r.b): r.likeness for r in spotsigs.similar_pairs(prints, threshold).collect()}
    sets = {}
    for r in prints.orderBy("doc_id").collect():
        sets.setdefault(r.fingerprint, r.doc_id)
    cells = {i: {f[k:k + 8] for k in range(0, len(f), 8)} for f, i in sets.items()}
    want = {}
    for a in cells:
        for b in cells:
            if a < b:
                j = len(cells[a] & cells[b]) / len(cells[a] | cells[b])
                if j >= threshold:
                    want[(a, b)] = j
    assert got.keys() == want.keys() and want
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
