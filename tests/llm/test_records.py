"""WARC round trips and salvage, chat formatting, licences and mixing."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quiver.llm import chat_format, licenses, mixing, warc


# ------------------------------------------------------------------------ WARC

def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, archive string")


def sample_pages():
    rng = random.Random(2)
    same = "<p>" + "same text é " * 30
    rows = [(k, f"http://e.example/{k}", "".join(rng.choice("abc <>é\r\n") for _ in range(rng.randint(0, 900)))) for k in range(40)]
    rows += [(100, "u", same), (90, "u 1\r\n2", same), (110, None, same), (120, "u", None), (121, "u", ""), (122, "u", "short"), (123, "u", "short"), (-5, "u", "negative")]
    return rows


def test_archives_round_trip(spark):
    rows = sample_pages()
    found = warc.read_archives(warc.write_archives(pages(spark, rows), archive_bytes=4000)).collect()
    assert not [r for r in found if r.gap]
    back = {warc.page_of(r.record_id): r for r in found if r.record_type != "warcinfo"}
    assert set(back) == {i for i, _, _ in rows}
    for i, _, html in rows:
        r, payload = back[i], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        revisit = i in (100, 110)
        assert r.record_type == ("revisit" if revisit else "response")
        assert warc.page_of(r.refers_to) == (90 if revisit else None)
        assert bytes(r.payload) == (b"" if revisit else payload)
    assert len({r.archive for r in found}) > 2


def test_null_page_ids_and_no_pages(spark):
    found = warc.read_archives(warc.write_archives(pages(spark, [(None, "u", "y" * 200), (None, "u", "y" * 200)]))).where("record_type = 'response'").collect()
    assert [warc.page_of(r.record_id) for r in found] == [None, None]
    assert warc.write_archives(pages(spark, [])).count() == 0


def records(n=6):
    return [warc.page_record(k, f"http://x/{k}", f"payload {k} ".encode() * 40, None) for k in range(n)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_after_damage(packed):
    parts = [warc.member(r) if packed else r for r in records()]
    data = bytearray(b"".join(parts))
    at = len(parts[0]) + len(parts[1]) + len(parts[2]) // 2
    data[at:at + 4] = b"\xff\x00\xff\x00"  # record 2 damaged
    found = list(warc.salvage(bytes(data)))
    kept = [warc.page_of(x.headers["warc-record-id"]) for x in found if isinstance(x, warc.Record)]
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    assert kept == [0, 1, 3, 4, 5]
    assert [(g.offset, g.length) for g in gaps] == [(len(parts[0]) + len(parts[1]), len(parts[2]))]
    # every byte is in a record or in a gap
    assert sum(len(p) for k, p in enumerate(parts) if k != 2) + gaps[0].length == len(data)


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_of_truncated_and_garbage_bytes(packed):
    parts = [warc.member(r) if packed else r for r in records(3)]
    whole = b"".join(parts)
    cut = whole[: len(whole) - 20]
    found = list(warc.salvage(cut))
    assert [type(x).__name__ for x in found] == ["Record", "Record", "Gap"]
    found = list(warc.salvage(b"\x1f\x8b\x08junk" + whole + b"tail"))
    assert [type(x).__name__ for x in found] == ["Gap", "Record", "Record", "Record", "Gap"]
    assert list(warc.salvage(b"")) == []
    assert [x.reason for x in warc.salvage(b"nothing here")] == ["no version line"]


def test_salvage_checks_digests():
    good = warc.page_record(1, "u", b"a" * 50, None)
    bad = good.replace(b"a" * 50, b"a" * 49 + b"b")
    found = list(warc.salvage(good + bad + good))
    assert [type(x).__name__ for x in found] == ["Record", "Gap", "Record"]
    assert found[1].reason == "block digest"


def salvaged(data):
    found = list(warc.salvage(data))
    return [warc.page_of(x.headers["warc-record-id"]) for x in found if isinstance(x, warc.Record)], [x for x in found if isinstance(x, warc.Gap)]


def test_salvage_inside_a_member():
    parts = records()
    parts[2] = parts[2].replace(b"payload 2", b"payload X", 1)
    one = warc.member(b"".join(parts))
    kept, gaps = salvaged(warc.member(records(1)[0]) + one)
    assert kept == [0, 0, 1, 3, 4, 5]
    assert [(g.offset, g.length, g.reason) for g in gaps] == [(len(warc.member(records(1)[0])), len(parts[2]), f"in member at {len(parts[0]) + len(parts[1])}: block digest")]


def test_salvage_of_broken_members():
    rng = random.Random(8)
    parts = [warc.page_record(k, "u", rng.randbytes(3000), None) for k in range(30)]
    one, after = warc.member(b"".join(parts)), warc.member(warc.page_record(99, "u", b"z" * 90, None))
    for trailer in (-8, -4):  # CRC, length
        bad = bytearray(one)
        bad[trailer] ^= 1
        kept, gaps = salvaged(bytes(bad) + after)
        assert kept == [*range(30), 99] and [(g.offset, g.length, g.reason) for g in gaps] == [(len(one) - 8, 8, "gzip: crc")]
    kept, gaps = salvaged(one[:75_000])  # truncated beyond one read of the inflater
    assert kept == list(range(len(kept))) and len(kept) >= 22 and gaps[-1].reason.endswith("truncated member")
    assert salvaged(one[:-8])[0] == list(range(30)) and salvaged(one[:-8])[1] == [warc.Gap(len(one) - 8, 0, "truncated member")]
    text = [warc.page_record(k, "u", " ".join(rng.choices(["some", "words", "of", "a", "page", str(k)], k=900)).encode(), None) for k in range(40)]
    one = bytearray(warc.member(b"".join(text)))
    one[len(one) // 2:len(one) // 2 + 400] = b"\xff" * 400
    kept, gaps = salvaged(bytes(one) + after)
    assert kept[-1] == 99 and kept[:-1] == list(range(len(kept) - 1)) and len(kept) > 10 and gaps[-1].offset + gaps[-1].length == len(one)


def test_damaged_rows_are_quarantined(spark):
    data = b"".join(warc.member(r) for r in records(3))
    got = warc.read_archives(spark.createDataFrame([("a", bytearray(b"xx" + data)), ("b", None)], "archive string, content binary"))
    assert [(r.gap, r.offset, r.length) for r in got.where("gap").collect()] == [(True, 0, 2)]
    assert got.where("not gap").count() == 3


# ------------------------------------------------------------------------ chat

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<", "[", "<|turn|>\\", "", "a\nb", "\\n<\\s>", "<<SYS>>é漢", "[\\INST]", "<s", ">"]


def chat_rows():
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "to<|im_end|>ol"]), rng.choice([*NASTY, None])) for c in range(40) for t in range(rng.randint(1, 9))]
    return rows + [(50, 0, "user", "x"), (50, 0, "assistant", "y"), (50, 0, "user", "x")]


def test_chat_round_trip(spark):
    rows = chat_rows()
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_conversations(df)
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.formatted) for r in out.select("conv_id", "formatted", chat_format.parse(F.col("formatted")).alias("turns")).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((t, r or "", x or "") for i, t, r, x in rows if i == c)
        assert got[c][0] == [(r, x) for _, r, x in turns]
        blocks = sum(1 for k, (_, r, _) in enumerate(turns) if k == 0 or r != turns[k - 1][1])
        assert got[c][1].count("<|im_start|>") == got[c][1].count("<|im_end|>") == blocks  # texts cannot add markers
    assert chat_format.format_conversations(df.where("false")).count() == 0


def test_chat_plan_has_no_python(spark):
    df = spark.createDataFrame(chat_rows(), "conv_id long, turn long, role string, text string")
    plan = chat_format.format_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -------------------------------------------------------------------- licences

def license_rows():
    filler = "lorem ipsum dolor sit amet consectetur"
    return [
        (0, "Released under the MIT License", "en", "a"),  # a licence file of a/en/d0
        (1, filler, "en", "a"),
        (2, f"{filler}\nLicensed under the Apache License, Version 2.0.\n{filler} {filler} {filler}", "en", "a"),
        (70, filler, "en", "a"),  # another directory without a licence file
        (3, None, "en", "a"), (4, "", None, None), (5, "the license of the license", "en", "b"),
        (6, "Licensed under CC BY-NC 4.0\nReleased under the MIT License", "en", "b"), (7, filler, "en", "b"), (7, filler, "en", "b"),
        *((k, f"{filler} {k}", "en", "c") for k in range(200, 240)),
    ]


def brute_licenses(rows):
    split = lambda t: [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w]
    terms = {n: split(t) for n, t in licenses.TEMPLATES.items()}
    vocabulary = {w for t in terms.values() for w in t}
    df = {w: sum(w in split(t or "") for _, t, _, _ in rows) for w in vocabulary}
    idf = {w: max(0.01, math.log((1 + len(rows)) / (1 + df[w]))) for w in vocabulary}
    out = {}
    for i, t, _, _ in rows:
        best = (0.0, None)
        for line in (t or "").split("\n"):
            w = split(line)
            norm = math.sqrt(sum((w.count(x) * idf[x]) ** 2 for x in set(w) & vocabulary) + sum(x not in vocabulary for x in w) * max(idf.values()) ** 2)
            for name in sorted(terms):
                v = {x: terms[name].count(x) * idf[x] for x in set(terms[name])}
                dot = sum(w.count(x) * idf[x] * v[x] for x in v if x in w)
                s = round(dot / norm / math.sqrt(sum(x * x for x in v.values())), 9) if w else 0.0
                if s >= licenses.THRESHOLD and s > best[0]:
                    best = (s, name)
        out[i] = best
    return out


def test_licenses_equal_brute_force(spark):
    rows = license_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, license string")
    got = licenses.scan(df).collect()
    assert len(got) == len(rows)
    own = brute_licenses(rows)
    for r in got:
        assert (r.own_license, round(r.score, 6)) == (own[r.doc_id][1], round(own[r.doc_id][0], 6))
    by = {r.doc_id: r for r in got}
    assert [by[0].is_license_file, by[2].is_license_file] == [True, False]
    assert (by[1].license, by[1].origin, by[1].license_dir) == ("MIT", "inherited", "a/en/d0")
    assert (by[2].license, by[3].license, by[70].license) == ("Apache-2.0", "MIT", None)
    assert by[7].origin == "inherited" and by[4].path.startswith("none/none/")
    assert licenses.scan(df.where("false")).count() == 0


def test_inheritance_takes_the_nearest_ancestor(spark):
    df = spark.createDataFrame([("a/b/c/f",), ("/a/f",), ("f",)], "path string")
    assert [r[0] for r in df.select(licenses.directory(F.col("path"))).collect()] == ["a/b/c", "a", ""]
    got = df.limit(1).select(licenses.ancestors(licenses.directory(F.col("path"))).alias("x")).first().x
    assert [(x.depth, x.dir) for x in got] == [(0, ""), (1, "a"), (2, "a/b"), (3, "a/b/c")]


def test_signal_words_are_enough():
    weights = {n: {w: 1.0 + len(w) for w in t.lower().split()} for n, t in licenses.TEMPLATES.items()}
    signals = set(licenses._signals(weights, 0.6))
    for w in weights.values():
        rest = math.sqrt(sum(x * x for k, x in w.items() if k not in signals) / sum(x * x for x in w.values()))
        assert rest < 0.6


# ---------------------------------------------------------------------- mixing

def mix_rows():
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(150):
        kind = i % 3
        words = [rng.choice([["fine", "prose", "essay"], ["buy", "click", "win"], ["awful", "insult", "nasty"]][kind]) for _ in range(4)]
        words += [f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(words), f"s{i % 2}"))
        if i % 2:
            labels.append((i, [1, 0, rng.randint(0, 1)][kind], int(kind == 2)))
    return rows + [(900, None, None), (901, "", "s"), (0, rows[0][1], "s0")], labels + [(1, None, 1), (5000, 1, 0), (2, 7, 7)]


def test_mixing_meets_targets(spark):
    rows, labels = mix_rows()
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, rate int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    targets = {"good": 0.6, "plain": 0.3, "toxic": 0.1}
    got = mixing.mix(docs, marks, targets).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in got)
    total = sum(r.n_tokens for r in got)
    for k, share in targets.items():
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{k}"] for r in got) / total - share) < 1e-4
        assert all(abs(sum(r[f"p_{d}"] for d in targets) - 1) < 1e-9 for r in got)
    right = sum(r.domain == ["good", "plain", "toxic"][r.doc_id % 3] for r in got if r.doc_id < 900)
    assert right >= 0.95 * len([r for r in got if r.doc_id < 900])


def test_mixing_rates_equal_projected_gradient_in_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 80)
    n = rng.integers(0, 50, 80)
    members = spark.createDataFrame([(int(i), int(n[i]), [float(x) for x in p[i]]) for i in range(80)], "doc_id long, n_tokens long, p array<double>")
    goal = np.array([0.9, 0.08, 0.02])
    steps = mixing.fit(members, goal.tolist(), iterations=6, tolerance=0)
    w = n / n.sum()
    m = (p * w[:, None]).T @ p
    m += np.eye(3) * 1e-9 * np.trace(m)
    r = y = np.ones(80)
    t = 1.0
    for _ in range(6):
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        new = np.maximum(0, y - p @ np.linalg.solve(m, p.T @ (w * y) - goal))
        y, r, t = new + (t - 1) / after * (new - r), new, after
    got = [x.r for x in members.orderBy("doc_id").select(mixing.rates(F.col("p"), steps)["r"].alias("r")).collect()]
    assert np.allclose(got, r, atol=1e-9)


def test_mixing_without_rows_labels_or_tokens(spark):
    docs = spark.createDataFrame([(1, None, "s")], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.rate for r in mixing.mix(docs, marks).collect()] == [1.0]
    assert mixing.mix(docs.where("false"), marks).count() == 0


def test_mixing_plan_has_no_python(spark):
    rows, labels = mix_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
