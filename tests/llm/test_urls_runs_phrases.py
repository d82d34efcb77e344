"""URL filters, periodic runs and phrase collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.llm import periodic_runs as runs
from quiver.llm import phrases
from quiver.llm import queries, url_filters

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- URL filters

SITES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
         ("allow", "A.Example.NET", ""), ("block", "", "/private"), ("block", "x.net", "/q*/"), ("allow", "b.net", "/e\\E.n")]
PATTERNS = [("block", "^casino^"), ("block", "track*pixel"), ("allow", "^casino^*news"), ("block", "^ends^")]
URLS = ["http://example.net/en/1", "http://www.example.net/en", "http://Example.NET/EN/1", "https://a.example.net", "https://a.example.net?x", "ftp://notnet/",
        "http://fakeexample.net/en/", "http://net/", "http://net", "http://a.b.org/fr/#x", "http://a.b.org/frx", "http://s.example.com/de/?q=1",
        "http://s.example.com/private/1", "http://x.net/q*/1", "http://x.net/qq/1", "http://b.net/e\\E.n", "http://www.casino.com/a", "http://mycasino.com/a",
        "http://casino-x.com/the/news", "http://t.com/track/9/pixel", "http://t.com/pixel/track", "http://t.com/ends", "no scheme.net/en/", "", None,
        "http://user@net/x", "http://h.net:80/en/", "http://é.net/é", "http:///fr/", "a://b://c.net/", "http://t.com/casino\nx"]


def brute_verdict(url, sites, patterns, default="allow"):
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    head = re.split("[?#]", rest)[0]
    host = low(head.split("/")[0])
    path = head[len(host):]
    fit = [(-len(h + p), h + p, v) for v, h, p in sites
           if (not low(h) or host == low(h) or host.endswith("." + low(h))) and path.startswith(p)]
    if fit:
        return host, path, min(fit)[1], None, min(fit)[2]
    as_regex = lambda p: "".join({"*": ".*", "^": r"(?:[^a-z0-9]|\Z)"}.get(c, re.escape(c)) for c in low(p))
    fit = [(-len(p), p, v) for v, p in patterns if url and re.search(as_regex(p), low(url), re.S)]
    return (host, path, None, *((min(fit)[1], min(fit)[2]) if fit else (None, default)))


@pytest.mark.parametrize("small", [None, False], ids=["broadcast", "shuffled"])
def test_url_rules(spark, small):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "y"), (0, URLS[1], "z"), (None, URLS[3], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, token string").repartition(3)
    pages = pages.withColumn("id", F.lit(1)).withColumn("rule", F.lit("clash")).withColumn("part", F.lit(0))
    got = url_filters.filter_urls(pages, url_filters.rule_table(spark, SITES, PATTERNS), small=small).collect()
    want = [(i, *brute_verdict(u, SITES, PATTERNS)) for i, u, _ in rows]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_url_rules_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = url_filters.rule_table(spark, [], [])
    assert [tuple(r) for r in url_filters.filter_urls(pages, none, default="block").collect()] == [(1, "a.net", "/", None, None, "block")]
    assert url_filters.filter_urls(pages.limit(0), url_filters.rule_table(spark)).count() == 0
    odd = spark.sql("select * from values ('a', cast(null as string), 'net', '/', cast(null as string)), "
                    "('b', 'block', cast(null as string), '/', cast(null as string)) as t(rule, verdict, host, path, pattern)")
    assert url_filters.filter_urls(pages, odd).first()["verdict"] == "allow"


def test_rules_stand_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(i, f"http://h{i}.example.net/en/{'deep' if i == 0 else 'x'}/") for i in range(9)], "page_id long, url string")
    rules = url_filters.compiled(url_filters.rule_table(spark, [("block", "example.net", "/en/deep/"), ("block", "net", "/de"), ("allow", "", "/x")], []))
    found = {r["regex"]: r["token"] for r in url_filters.rule_index(urls, rules, True).collect()}
    assert sorted(found.values()) == ["", "deep", "net"]


# ---------------------------------------------------------------- periodic runs

def brute_lyndon(s):
    return [next((j for j in range(i + 1, len(s) + 1) if s[j:] < s[i:]), len(s)) - i for i in range(len(s))]


def brute_runs(w, exponent=4, shortest=6):
    n, out = len(w), []
    for i in range(n):
        for p in range(1, n // 2 + 1):
            if i and i + p - 1 < n and w[i - 1] == w[i + p - 1]:
                continue
            j = i + p
            while j < n and w[j] == w[j - p]:
                j += 1
            if j - i >= max(shortest, exponent * p) and not any(all(w[k] == w[k - q] for k in range(i + q, j)) for q in range(1, p)):
                out.append((i, j - i, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, edit=False):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if edit and doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_lyndon_arrays_and_runs_of_random_texts():
    rnd = random.Random(3)
    for _ in range(600):
        n, k = rnd.randint(0, 50), rnd.choice([1, 2, 3, 5])
        w = [rnd.randrange(k) for _ in range(n)]
        if rnd.random() < 0.5 and n:
            p, a = rnd.randint(1, 6), rnd.randrange(n)
            w = w[:a] + [w[a + i % min(p, n - a)] for i in range(n - a)]
        order = sorted(set(w))
        symbols = [order.index(x) for x in w]
        assert list(runs.lyndon_array(symbols)) == brute_lyndon(symbols)
        for exponent, shortest in ((4, 6), (2, 2), (3, 4)):
            assert runs.text_runs(np.array(w, np.int32), exponent, shortest) == brute_runs(w, exponent, shortest)


def test_long_runs_take_linear_time():
    base = np.random.default_rng(0).integers(0, 300, 4000)
    for words, want in ((np.zeros(60_000), [(0, 60_000, 1)]), (np.tile(base, 15), [(0, 60_000, 4000)])):
        assert runs.text_runs(words.astype(np.int32)) == want


def test_words_of_long_texts_are_cut_at_slices(monkeypatch):
    monkeypatch.setattr(runs, "SLICE", 7)
    text = "ab  cdefghijklm\n\x0bé\u2003x \u00a0 ab\t\tab ".encode()
    words, distinct = runs.word_numbers(text)
    assert [distinct[i] for i in words] == re.findall(rb"[^\x20\x09-\x0D]+", text)
    assert b"".join(runs.joined(words, distinct)) == b" ".join(re.findall(rb"[^\x20\x09-\x0D]+", text))


def test_periodic_rows(spark):
    rnd = random.Random(5)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x b c b c b c b c y", "a b a b a b a b c c c c c c a b a b a b a b", "é É é É é É é É",
             "z " * 40 + "y z " * 30 + "q", " ".join(rnd.choice("ab") for _ in range(300))]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(5, texts[6], None, None), (None, texts[7], "n", 2), (-3, texts[9], "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int").repartition(4)
    out = runs.periodic_runs(docs, texts=True).collect()
    want = {}
    for i, t, *_ in rows:
        want.setdefault(brute_row(i, t)[0::1], 0)
        want[brute_row(i, t)] += 1
    got = Counter((r.doc_id, len(r.runs), *(tuple(r.strongest) if r.strongest else (None,) * 3),
                   r.strongest and 1000 * r.strongest.length // r.strongest.period, r.runs_sha256, r.collapsed_sha256) for r in out)
    assert got == Counter(want)
    assert all(hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 for r in out)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_periodic_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").collect()]
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    want = [brute_row(i, t, edit=True) for i, t in docs]
    assert sum(w[1] > 0 for w in want) > 3
    assert all(got[w[0]] == w for w in want)


# ---------------------------------------------------------------- phrases

def brute_phrases(rows, least=10, longest=3, first=2000, share=50):
    f, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:first])]
    return sorted(out)


def phrase_rows(seed=7, n=300):
    rnd = random.Random(seed)
    vocabulary = ["la", "De", "é", "ÉA", "x-y", "new", "york", "city", "a\u00a0b", "\u3000z"]
    text = lambda: "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", "  ", "\t", ". ", "\n", "\r", ","]) for _ in range(rnd.randint(0, 30)))
    return [(rnd.choice(["en", "fr", None, "und", ""]), text()) for _ in range(n)] + [("en", None), ("en", ""), (None, "new york " * 50), ("xx", "rare words here")]


@pytest.mark.parametrize("setting", ["plain", "small slabs", "full bitmap", "collisions"])
def test_phrases(spark, monkeypatch, setting):
    rows = phrase_rows()
    docs = spark.createDataFrame([(1, l, t, "x", 1) for l, t in rows], "doc_id long, lang string, text string, phrase string, n int").repartition(3)
    # the tasks see these settings through the functions that the driver pickles by value; so slabs are tested directly
    for longest, first in ((3, 2000), (4, 5)):
        if setting == "plain":
            got = phrases.first_phrases(phrases.frequent_phrases(docs, longest=longest), first)
            assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, longest=longest, first=first)
    if setting == "small slabs":
        batch = phrases.pa.RecordBatch.from_arrays([phrases.pa.array([l or "und" for l, _ in rows]), phrases.pa.array([t for _, t in rows])], names=["lang", "text"])
        counts = []
        for size in (16, 200, 1 << 20):
            all_grams = Counter()
            for buf, offsets, langs in phrases.slabs(iter([batch, batch]), size):
                g = phrases.Grams(buf, offsets, langs)
                same = g.same_words()
                for n in (1, 2, 3):
                    at = g.places(n)
                    pointer, _, times = phrases.grouped(at, n, g.fingerprints(at, n), same)
                    for p, c in zip(pointer.tolist(), times.tolist()):
                        all_grams[g.langs[g.lang[p]], n, b" ".join(buf[g.start[p + k]:g.end[p + k]].tobytes() for k in range(n))] += c
            counts.append(all_grams)
        assert counts[0] == counts[1] == counts[2] and counts[0]
    if setting == "full bitmap":
        assert phrases.admitted(np.arange(1 << 40, (1 << 40) + 99, dtype=np.uint64), np.full(phrases.CELLS // 8, 255, np.uint8)).all()
        bits = np.zeros(phrases.CELLS // 8, np.uint8)
        prints = np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64)
        np.bitwise_or.at(bits, (phrases.cells(prints) >> np.uint64(3)).astype(int), np.uint8(1) << (phrases.cells(prints) & np.uint64(7)).astype(np.uint8))
        assert phrases.admitted(prints, bits).all()
    if setting == "collisions":  # equal fingerprints of different texts stay apart
        buf = np.frombuffer(b"ab cd ab ef cd abc", np.uint8)
        g = phrases.Grams(buf, np.array([0, len(buf)]), ["en"])
        g.words = np.zeros(len(g.words), np.uint64)
        same = g.same_words()
        assert same.tolist() == [0, 1, 0, 3, 1, 5]
        at = g.places(2)
        pointer, _, times = phrases.grouped(at, 2, np.zeros(len(at), np.uint64), same)
        assert sorted(zip(pointer.tolist(), times.tolist())) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1)]


def test_phrases_of_nothing(spark):
    schema = "doc_id long, lang string, text string"
    for rows in ([], [(1, None, None), (2, "en", "")], [(1, "en", "one two three")]):
        assert phrases.first_phrases(phrases.frequent_phrases(spark.createDataFrame(rows, schema))).count() == 0


def test_counts_beyond_sixteen_bits(spark):
    rows = [("en", "la la " * 40_000 + "."), ("en", "y z")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert [tuple(r) for r in phrases.first_phrases(phrases.frequent_phrases(docs)).collect()] == brute_phrases(rows)
