"""SpotSigs document fingerprints.

A spot signature is an anchor (a common word) with the chain of the next two
content words after it.  A document's fingerprint is the set of its
signatures, written as sorted 32-bit hashes in hexadecimal; the likeness of two
fingerprints is the Jaccard similarity of their sets.

``similar_pairs`` partitions fingerprints by set length, so that only sets whose
lengths can reach the threshold meet, and prunes by prefixes: signatures are
ordered rarest first, and two sets at Jaccard t share one of their first
``n - ceil(t n) + 1`` signatures.  What survives is compared in full.

Anchors are common words of four languages, a parameter.  A text without any
signature (too few words, or no anchor) falls back to its whole word sequence
as one signature, or to the digest of the text when it has no words, so that
equal texts always have equal fingerprints and different short ones do not.

Defined cases: a null text is the empty text; two empty fingerprints cannot
occur; rows that repeat a doc_id are neighbours of each other in the order of
their texts; rows with a null doc_id follow all ids in the order of their texts'
hashes and are returned with the null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm import common as C

# Common function words of English, French, German and Spanish.
ANCHORS = (
    "a an and as at be by for from in is it of on or that the this to was with are "
    "au avec dans des du en et la le les ou par pas pour que qui un une "
    "auf das dem den der des die ein eine im in ist mit nicht sich und von zu "
    "al con de del el en es la las los para por que se su un una y"
).split()
CHAIN = 2

#: Words of a signature are letters, digits and non-ASCII characters; case of A-Z does not count.
_IS_WORD = C.ALNUM


def _anchor_hashes(anchors) -> np.ndarray:
    words = sorted(set(anchors))
    buf = np.frombuffer(" ".join(words).encode(), np.uint8)
    start, end, _ = C.find_words(buf, np.array([0, len(buf)]), _IS_WORD)
    return np.sort(C.POLY.span(C.POLY.prefix_bytes(buf), start, end))


def signatures(texts: list[bytes], anchors: np.ndarray, chain: int = CHAIN) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures of each text."""
    if not texts:
        return []
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    buf = C.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    start, end, doc = C.find_words(buf, offsets, _IS_WORD)
    h = C.POLY.span(C.POLY.prefix_bytes(buf), start, end) if len(start) else np.zeros(0, np.uint64)
    k = np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)
    spot = anchors[k] == h
    content = np.flatnonzero(~spot)
    spots = np.flatnonzero(spot)
    # the chain of each anchor: the next content words of the same document
    first = np.searchsorted(content, spots)
    whole = first + chain <= len(content)
    spots, first = spots[whole], first[whole]
    if len(spots):
        whole = doc[content[first + chain - 1]] == doc[spots]
        spots, first = spots[whole], first[whole]
    sig = h[spots]
    for j in range(chain):
        sig = C.mix(sig * np.uint64(0x9E3779B97F4A7C15) + h[content[first + j]])
    sig = (sig >> np.uint64(32)).astype(np.uint32)
    row = doc[spots]
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    bound = np.searchsorted(doc, np.arange(len(texts) + 1))
    prefix = C.POLY.prefix_symbols(h)
    out = []
    for r, text in enumerate(texts):
        s = np.unique(sig[cut[r]:cut[r + 1]])
        if not len(s):
            a, b = bound[r:r + 2]
            s = np.array([int(C.POLY.span(prefix, np.array([a]), np.array([b]))[0]) & 0xFFFFFFFF if b > a
                          else int.from_bytes(hashlib.sha256(text).digest()[:4], "big")], np.uint32)
        out.append(s)
    return out


def encode(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def fingerprints(docs: DataFrame, anchors=tuple(ANCHORS), chain: int = CHAIN) -> DataFrame:
    """doc_id, n_signatures, fingerprint of every row's whole text."""
    C.prepare(docs.sparkSession)
    table = _anchor_hashes(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            sets = signatures(texts, table, chain)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([encode(s) for s in sets], pa.string())], names=["doc_id", "n_signatures", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_signatures long, fingerprint string")


def similar_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness) of different fingerprints at or over ``threshold``: a and b
    are the smallest doc_ids with their fingerprint; equal fingerprints are one."""
    reps = C.written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.first("n_signatures").alias("n")), "fingerprints")
    at = F.sequence(F.lit(0), F.col("n").cast("int") - 1)
    spots = reps.select("id", "n", F.explode(F.transform(at, lambda i: F.substr("fingerprint", i * 8 + 1, F.lit(8)))).alias("sig"))
    rare = spots.groupBy("sig").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "sig")
    head = spots.join(rare.where("df > 1"), "sig").withColumn("rank", F.row_number().over(order))
    # signatures of df 1 sort first and meet nothing: ranks above count only shared ones, so add their number
    lone = F.col("n") - F.count("*").over(Window.partitionBy("id"))
    head = head.withColumn("lone", lone).where(F.col("rank") + F.col("lone") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1)
    # length partitions: powers of 1/threshold; a set meets its own partition and the next longer one
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1 / threshold))))
    a = head.select("sig", F.col("id").alias("a"), F.col("n").alias("n_a"), F.explode(F.array(part, part + 1)).alias("part"))
    b = head.select("sig", F.col("id").alias("b"), F.col("n").alias("n_b"), part.alias("part"))
    longer = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    pairs = a.join(b, ["sig", "part"]).where(longer & (F.col("n_a") >= F.col("n_b") * threshold - 1e-9)).select("a", "b").distinct()
    cells = lambda c: F.transform(F.sequence(F.lit(0), (F.length(c) / 8).cast("int") - 1), lambda i: F.substr(c, i * 8 + 1, F.lit(8)))
    for end in "ab":
        pairs = pairs.join(reps.select(F.col("id").alias(end), F.col("fingerprint").alias(f"f_{end}")), end)
    both = F.size(F.array_intersect(cells(F.col("f_a")), cells(F.col("f_b"))))
    likeness = both / ((F.length("f_a") + F.length("f_b")) / 8 - both)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness.alias("likeness")).where(F.col("likeness") >= threshold - 1e-12)


def with_next(docs: DataFrame, slices: int) -> DataFrame:
    """(slice, doc_id, text, guest): rows dealt by ranges of doc_id, sorted within tasks.

    The first row of each range also goes, as a guest, to the end of the range
    before (the very first one to the last), so that every row finds the next
    one in its own task and texts are shuffled once.  Range bounds are existing
    ids, at most ``slices`` of them."""
    ids = docs.agg(F.percentile_approx("doc_id", [i / slices for i in range(slices)], 100_000).alias("p"), F.min("doc_id").alias("least")).first()
    bounds = sorted({*(ids["p"] or []), *([ids["least"]] if ids["least"] is not None else [])})

    def slice_of(bounds: list[int]) -> Column:
        table = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
        return F.size(F.filter(table, lambda b: b <= F.col("doc_id"))) - 1

    # percentiles go through doubles, which miss ids over 2**53: the smallest id from each on is the bound
    bounds = sorted(r[0] for r in docs.groupBy(slice_of(bounds).alias("slice")).agg(F.min("doc_id").alias("b")).select("b").collect())
    own = slice_of(bounds)
    before = F.pmod(F.col("slice") - 1, F.lit(max(len(bounds), 1)))
    rows = docs.withColumn("slice", own)
    # of the rows of a bound's id the smallest text is the guest
    ends = rows.where(F.col("doc_id").isin([int(b) for b in bounds]) if bounds else F.lit(False)).groupBy("doc_id", "slice").agg(F.min("text").alias("text"))
    guests = ends.select("doc_id", "text", before.cast("int").alias("slice"), F.lit(True).alias("guest"))
    both = rows.select("doc_id", "text", "slice", F.lit(False).alias("guest")).unionByName(guests)
    return both.repartition(max(len(bounds), 1), "slice").sortWithinPartitions("slice", "guest", "doc_id", "text")


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare_with_edits(docs: DataFrame, anchors=tuple(ANCHORS), chain: int = CHAIN) -> DataFrame:
    """The contract's columns: fingerprints of each text and of its edited text, and both likenesses."""
    spark = docs.sparkSession
    C.prepare(spark)
    docs, first = C.with_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    table = _anchor_hashes(anchors)

    def block(rows: list[tuple[int, str]], following: str) -> pa.RecordBatch:
        texts = [t for _, t in rows] + [following]
        edits = [edited_text(a, b) for a, b in zip(texts, texts[1:])]
        raw = [t.encode() for t in edits]
        own, new = signatures([t.encode() for t in texts], table, chain), signatures(raw, table, chain)
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for _, t in rows], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string()),
            pa.array([encode(s) for s in own[:-1]], pa.string()), pa.array([encode(s) for s in new], pa.string()),
            pa.array([jaccard(a, b) for a, b in zip(own, new)], pa.float64()),
            pa.array([jaccard(a, b) for a, b in zip(own, own[1:])], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str]] = []
        size, current = 0, None
        for batch in batches:
            for s, i, t, guest in zip(*(batch.column(c).to_pylist() for c in ("slice", "doc_id", "text", "guest"))):
                if s != current and rows:  # a slice always ends with its guest
                    raise RuntimeError("a slice has no following document")
                current = s
                if guest:
                    if rows:
                        yield block(rows, t)
                    rows, size, current = [], 0, None
                    continue
                if size > C.CHUNK_BYTES:
                    yield block(rows, t)
                    rows, size = [], 0
                rows.append((i, t))
                size += len(t)

    slices = C.shuffle_buckets(spark, C.text_bytes(docs), per_bucket=16 << 20)
    return C.without_ids(with_next(docs, slices).mapInArrow(run, RESULT), first)


def op10_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The contract columns of ``compare_with_edits`` over all of ``documents``."""
    return compare_with_edits(C.table(spark, sf_dir, "documents"))
