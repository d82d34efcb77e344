r"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces, and
those at spaces and tabs into words.  Per language, phrases of two to ``longest``
words that occur ``least`` times are scored by how much more often they occur than
their parts:

1. *fingerprints*: numpy prefix polynomials over the bytes give every word, and
   prefix polynomials over the words every n-gram, a fingerprint; a slab of some
   MB of text sends (fingerprint, count) once a distinct n-gram.  Longer n-grams
   are only sent where both n-grams that they begin and end with are frequent;
2. *counts*: the shuffle adds the counts.  Frequent fingerprints are hashed into a
   bitmap of a fixed size, the only thing broadcast; a full bitmap merely prunes less;
3. *pointers and texts*: in a last pass the occurrences of frequent fingerprints
   are grouped in every slab under a pointer to their first one.  Each occurrence is
   compared with the text at its pointer, word by word and byte by byte, so that
   equal fingerprints of different texts are told apart; the text behind the
   pointer is materialised, and the shuffle counts by text.

A collision can only add to a fingerprint's count, so no frequent phrase is lost,
and the counts of the third step are exact.  Parts of frequent phrases are
frequent, so the third step counts them too; scores are plain joins and decimals.

Hot words and languages: every slab pre-aggregates; buckets go by fingerprint, not by
language; joins on single words are salted; the first phrases of a language are
found among parts of it before they meet.

Defined cases: a null text is empty; a null lang is ``und``, together with the rows
that say so; spaces of any length count as one; rows that repeat count again, also
under one doc_id (which is not used); extra columns are ignored; an empty table, or
one without frequent phrases, gives an empty result.  A text longer than a slab is
cut where a piece ends; a piece is worked on whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiver.llm import common as C

LEAST = 10
LONGEST = 3
FIRST = 2000
#: A phrase is dropped for a longer one that has this share (in hundredths) of its occurrences.
SHARE = 50
#: Bytes of text whose n-grams are grouped at once.
SLAB = (2 << 20) - 1
#: Words whose bytes are compared at once.
COMPARED = 1 << 16
#: Bits of the broadcast bitmap of frequent fingerprints, one bitmap a length.
CELLS = 1 << 25
#: Text behind one bucket of the shuffle.
BUCKET_BYTES = 48 << 20
#: Parts of a hot word's joins, and of a language's first phrases.
SALTS, PARTS = 8, 64

# The bytes that end a piece, and those between its words.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \t"
IS_END = C.word_table(lambda b: b in ENDS)
IS_WORD = C.word_table(lambda b: b not in ENDS and b not in BLANKS)

COUNTED = np.dtype([("f", "<u4"), ("n", "<u2")])


# ------------------------------------------------------------- slabs of text

def cut_text(text: np.ndarray, size: int = SLAB) -> Iterator[np.ndarray]:
    """Parts of about ``size`` bytes that end where a piece ends."""
    while len(text) > size:
        ends = np.flatnonzero(IS_END[text[:size]])
        if not len(ends):
            ends = size + np.flatnonzero(IS_END[text[size:]])[:1]
        at = int(ends[-1]) + 1 if len(ends) else len(text)
        yield text[:at]
        text = text[at:]
    yield text


def slabs(batches: Iterator[pa.RecordBatch], size: int = SLAB) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(lower-cased bytes, offsets of texts, their languages) of about ``size`` bytes each, from (lang, text) rows."""
    parts, langs, held = [], [], 0

    def slab():
        return C.LOWER[np.concatenate(parts)], np.concatenate([[0], np.cumsum([len(p) for p in parts])]), langs

    for batch in batches:
        buf, offsets = C.strings(batch.column(1))
        for lang, lo, hi in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            for part in cut_text(buf[lo:hi], size):
                if held + len(part) > size and held:
                    yield slab()
                    parts, langs, held = [], [], 0
                parts.append(part)
                langs.append(lang)
                held += len(part)
    if held:
        yield slab()


class Grams:
    """The words of a slab and the fingerprints of its n-grams."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, langs: list[str]):
        self.buf = buf
        self.start, self.end, doc = C.find_words(buf, offsets, IS_WORD)
        self.langs = sorted(set(langs))
        number = {lang: i for i, lang in enumerate(self.langs)}
        self.lang = np.array([number[x] for x in langs], np.int32)[doc]
        seed = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs]
        self._seed = np.array(seed, np.uint64)[self.lang]
        self.words = C.POLY.span(C.POLY.prefix_bytes(buf), self.start, self.end)
        self._prefix = C.POLY2.prefix_symbols(self.words)
        piece = np.cumsum(IS_END[buf], dtype=np.int32)[self.start]
        #: Whether the next word stands in the same piece.
        self.goes_on = np.concatenate([(doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1]), np.zeros(min(1, len(doc)), bool)])

    def places(self, n: int) -> np.ndarray:
        """First words of all n-grams."""
        ok = np.ones(len(self.words), bool)
        for k in range(n - 1):
            ok[:len(ok) - k] &= self.goes_on[k:]
            ok[len(ok) - k:] = False
        return np.flatnonzero(ok)

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of the n-grams from the words ``at`` on, together with their language."""
        one = self.words[at] if n == 1 else C.POLY2.span(self._prefix, at, at + n)
        return C.mix(one ^ self._seed[at])

    def frequent_places(self, n: int, frequent: dict[int, np.ndarray]) -> np.ndarray:
        """First words of the n-grams that ``frequent`` admits: themselves, or those they begin and end with."""
        at = self.places(n)
        if n in frequent:
            return at[admitted(self.fingerprints(at, n), frequent[n])]
        if n - 1 in frequent:
            for shift in (0, 1):
                at = at[admitted(self.fingerprints(at + shift, n - 1), frequent[n - 1])]
        return at

    def same_words(self) -> np.ndarray:
        """For every word the first equal one, compared byte by byte."""
        first = np.arange(len(self.words))
        left = first
        while len(left):
            _, at, key = np.unique(self.words[left], return_index=True, return_inverse=True)
            pointer = left[at][key]
            size = self.end[left] - self.start[left]
            equal = size == self.end[pointer] - self.start[pointer]
            compared = np.flatnonzero(equal & (pointer != left))
            for lo in range(0, len(compared), COMPARED):
                a = compared[lo:lo + COMPARED]
                b = size[a]
                within = np.arange(int(b.sum())) - np.repeat(np.cumsum(b) - b, b)
                differ = self.buf[np.repeat(self.start[left[a]], b) + within] != self.buf[np.repeat(self.start[pointer[a]], b) + within]
                equal[np.repeat(a, b)[differ]] = False
            first[left[equal]] = pointer[equal]
            left = left[~equal]  # a collision: grouped again among themselves
        return first

    def texts(self, at: np.ndarray, n: int, text: bytes) -> list[bytes]:
        """The n-grams from the words ``at`` on, their words joined by one space."""
        spaced = np.ones(len(at), bool)
        for k in range(n - 1):
            end = self.end[at + k]
            spaced &= (self.start[at + k + 1] - end == 1) & (self.buf[end] == 0x20)
        out = [text[lo:hi] for lo, hi in zip(self.start[at].tolist(), self.end[at + n - 1].tolist())]
        for i in np.flatnonzero(~spaced).tolist():
            out[i] = b" ".join(out[i].split())
        return out


def cells(fingerprints: np.ndarray) -> np.ndarray:
    return (fingerprints >> np.uint64(32)) % np.uint64(CELLS)


def admitted(fingerprints: np.ndarray, bits: np.ndarray) -> np.ndarray:
    cell = cells(fingerprints)
    return (bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def grouped(at: np.ndarray, n: int, keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pointer to the first occurrence, fingerprint, count) of the distinct n-grams ``at``: occurrences are
    grouped by fingerprint and compared with their pointer's words (given as the first equal words)."""
    pointers, prints, counts = [], [], []
    while len(at):
        _, first, key = np.unique(keys, return_index=True, return_inverse=True)
        pointer = at[first]
        equal = np.ones(len(at), bool)
        for k in range(n):
            equal &= words[at + k] == words[pointer[key] + k]
        pointers.append(pointer)
        prints.append(keys[first])
        counts.append(np.bincount(key[equal], minlength=len(first)))
        at, keys = at[~equal], keys[~equal]
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((pointers, np.int64), (prints, np.uint64), (counts, np.int64)))


def buckets_of(fingerprints: np.ndarray, buckets: int) -> np.ndarray:
    return ((fingerprints & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32)


def bounds(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where the groups of equal sorted keys begin, and the end."""
    n = len(sorted_keys[0])
    new = np.zeros(max(n - 1, 0), bool)
    for k in sorted_keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]]) if n else np.zeros(1, np.int64)


# -------------------------------------------------------- the three passes

def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def frequent_bitmaps(docs: DataFrame, lengths: tuple[int, ...], frequent: dict[int, np.ndarray], buckets: int, least: int) -> dict[int, np.ndarray]:
    """For each of ``lengths`` the bitmap of fingerprints that occur ``least`` times; ``frequent`` prunes longer ones."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches):
            grams = Grams(*slab)
            for n in lengths:
                prints, times = np.unique(grams.fingerprints(grams.frequent_places(n, known.value), n), return_counts=True)
                if (times > 0xFFFF).any():  # counts are sent in 16 bits: greater ones several times
                    again = -(-times // 0xFFFF)
                    prints, whole = np.repeat(prints, again), np.repeat(times, again)
                    times = np.minimum(whole - 0xFFFF * (np.arange(len(whole)) - np.repeat(np.cumsum(again) - again, again)), 0xFFFF)
                bucket = buckets_of(prints, buckets)
                order = np.argsort(bucket, kind="stable")
                body = np.zeros(len(prints), COUNTED)
                body["f"], body["n"] = prints[order] >> np.uint64(32), times[order]
                cut = bounds(bucket[order])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[order][cut[:-1]], pa.int32()), pa.array(np.full(len(cut) - 1, n), pa.int32()),
                     pa.array([body[lo:hi].tobytes() for lo, hi in zip(cut[:-1], cut[1:])], pa.binary())], names=["bucket", "n", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task may hold several buckets, and fingerprints are told apart within a bucket only
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for bucket, n, body in zip(batch.column("bucket").to_pylist(), batch.column("n").to_pylist(), batch.column("body")):
                held.setdefault((n, bucket), []).append(np.frombuffer(body.as_buffer(), COUNTED))
        for n, bucket in sorted(held):
            body = np.concatenate(held.pop((n, bucket)))
            prints, key = np.unique(body["f"], return_inverse=True)
            found = prints[np.bincount(key, weights=body["n"]) >= least]
            cell = np.unique(found % np.uint32(CELLS)).astype(np.int64)
            for lo in range(0, len(cell), 1 << 16):
                part = cell[lo:lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), n), pa.int32()), pa.array(part)], names=["n", "cell"])

    counted = _texts(docs).mapInArrow(count, "bucket int, n int, body binary").repartition(buckets, "bucket")
    cell = counted.mapInArrow(add, "n int, cell long").withColumn("c", F.col("cell") + 1)
    pages = cell.groupBy("n", F.bitmap_bucket_number("c").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits"))
    out = {n: np.zeros(CELLS // 8, np.uint8) for n in lengths}
    for row in pages.toLocalIterator():  # a fixed size, whatever the input: CELLS / 8 bytes a length
        bits = np.frombuffer(row["bits"], np.uint8)
        out[row["n"]][(row["page"] - 1) * len(bits):row["page"] * len(bits)] = bits
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, n (its words), a (its occurrences) of all phrases of one to ``longest`` words that occur
    ``least`` times in a language, and per language rows with a null phrase whose ``a`` add up to all its words."""
    buckets = C.shuffle_buckets(docs.sparkSession, C.text_bytes(docs), BUCKET_BYTES)
    frequent = frequent_bitmaps(docs, tuple(range(1, min(2, longest) + 1)), {}, buckets, least)
    for n in range(3, longest + 1):
        frequent |= frequent_bitmaps(docs, (n,), frequent, buckets, least)
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.binary(), pa.binary()))],
                                          names=["bucket", "lang", "phrases", "times"])

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches):
            grams = Grams(*slab)
            same, text = grams.same_words(), slab[0].tobytes()
            words = np.bincount(grams.lang, minlength=len(grams.langs))
            some = np.flatnonzero(words)
            yield rows(some % buckets, [grams.langs[i] for i in some], [None] * len(some), [words[i:i + 1].tobytes() for i in some])
            for n in range(1, longest + 1):
                at = grams.frequent_places(n, known.value)
                pointer, prints, times = grouped(at, n, grams.fingerprints(at, n), same)
                bucket, lang = buckets_of(prints, buckets), grams.lang[pointer]
                order = np.lexsort((lang, bucket))
                pointer, bucket, lang, times = (x[order] for x in (pointer, bucket, lang, times))
                phrases, cut = grams.texts(pointer, n, text), bounds(bucket, lang)
                yield rows(bucket[cut[:-1]], [grams.langs[i] for i in lang[cut[:-1]]], [b"\n".join(phrases[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:])],
                           [times[lo:hi].tobytes() for lo, hi in zip(cut[:-1], cut[1:])])

    def materialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        total: Counter = Counter()
        for batch in batches:
            for lang, phrases, times in zip(batch.column("lang").to_pylist(), batch.column("phrases").to_pylist(), batch.column("times")):
                counts = np.frombuffer(times.as_buffer(), np.int64).tolist()
                if phrases is None:
                    total[lang] += counts[0]
                    continue
                held = found.setdefault(lang, Counter())
                for phrase, n in zip(phrases.split(b"\n"), counts):
                    held[phrase] += n
        rows = [(lang, None, 0, n) for lang, n in sorted(total.items())]
        for lang in sorted(found):
            rows += [(lang, p.decode(), p.count(b" ") + 1, n) for p, n in found.pop(lang).items() if n >= least]
        for lo in range(0, len(rows), 1 << 16):
            columns = list(zip(*rows[lo:lo + (1 << 16)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()))],
                                             names=["lang", "phrase", "n", "a"])

    pointed = _texts(docs).mapInArrow(point, "bucket int, lang string, phrases binary, times binary")
    return pointed.repartition(buckets, "bucket").mapInArrow(materialise, "lang string, phrase string, n int, a long")


# ---------------------------------------------------------------- the scores

def _exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def scored(frequent: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one takes the place of."""
    phrases = frequent.where("phrase is not null")
    words = F.split("phrase", " ")
    salt = lambda c: F.when(F.instr(c, " ") > 0, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    copies = F.when(F.col("n") > 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"), F.explode(copies.cast("array<long>")).alias("salt"))
    cut = lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("first"),
                             F.array_join(F.slice(words, k + 1, F.size(words) - k), " ").alias("rest"))
    cuts = phrases.where("n > 1").select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - 1), cut)).alias("cut"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.withColumn("part", F.col(f"cut.{part}")).withColumn("salt", salt(F.col("part"))).join(
            known, ["lang", "part", "salt"]).withColumnRenamed("f", name).drop("part", "salt")
    ratio = F.expr("cast((cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)))"
                   " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(ratio.alias("score"), F.col("cut.k").alias("k"), "l", "r")).alias("cut"))
    inside = lambda m: F.transform(F.sequence(F.lit(1), F.size(words) - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))
    longer = phrases.where("n > 2").select("lang", "a", F.explode(F.array_distinct(F.flatten(
        F.transform(F.sequence(F.lit(2), F.col("n") - 1), inside)))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    out = lowest.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("a")) * F.lit(share)))
    return out.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def first_phrases(frequent: DataFrame, first: int = FIRST, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n (words of the language), score: each language's ``first`` phrases."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    out = scored(frequent, share).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for parts in (PARTS, 8, 1):  # the first of each part, then of the parts together
        out = out.withColumn("part", F.pmod("part", F.lit(parts)))
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    total = frequent.where("phrase is null").groupBy("lang").agg(F.sum("a").alias("n"))
    return out.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language of ``documents``."""
    C.prepare(spark)
    return first_phrases(C.written(frequent_phrases(C.table(spark, sf_dir, "documents")), "frequent-phrases"))


ORACLE_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM placed, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, phrase, k, count(*) AS a FROM grams GROUP BY lang, phrase, k HAVING count(*) >= {LEAST}),
cuts AS (SELECT lang, phrase, a, k, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS p, array_to_string(string_split(phrase, ' ')[cut + 1:k], ' ') AS q
    FROM f, (SELECT unnest([1, 2]) AS cut) WHERE cut < k),
parts AS (SELECT c.lang, c.phrase, c.a, c.k, c.cut, x.a AS l, y.a AS r,
    CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM parts) WHERE o = 1),
inside AS (SELECT lang, sub, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '),
    array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS sub FROM f WHERE k = 3) GROUP BY lang, sub),
kept AS (SELECT l.* FROM lowest l LEFT JOIN inside i ON i.lang = l.lang AND i.sub = l.phrase AND l.k = 2
    WHERE i.longer IS NULL OR 100 * i.longer < {SHARE} * l.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= {FIRST}"""
