"""Suffix-array deduplication by a difference cover, one bucket of suffixes at a time.

A difference cover D of v = 21 holds five residues such that any two positions
i, j have a shift s < v with (i + s) mod v and (j + s) mod v both in D.  Two
suffixes that agree on 100 bytes therefore agree, at some shift, on *cover
samples* of 100 - v + 1 = 80 bytes, and the order of long ties can be read off the
samples' ranks instead of the texts.  That gives three blockwise passes, each
of which sorts one bucket of suffixes per task:

1. cover samples (a quarter of all positions) are bucketed by their 80 bytes;
   a bucket's sort tells which samples have rank ties.  Suffixes whose samples
   are all unique are settled: nothing equals them on 100 bytes.
2. tied samples are ordered by their *context*, the 120 bytes any window
   holding the sample can touch.  All windows of a context that has an earlier
   (doc, position) are duplicates; only the first member of each context of a
   still ambiguous sample goes on.
3. the windows around those first members are sorted by their 100 bytes
   (80 bits of hashes); every window but the earliest is a duplicate.

Removed bytes are the union of the duplicate windows.  Whole copies of an
earlier text need none of this: they are found by digest and removed whole.

Bounds: a task sorts one bucket (bucket count follows the input); entries are
packed, and equal entries of one input batch are sent once, so that a passage
with very many copies adds one entry per batch.  Texts of documents without a
tied sample are never shuffled.

Defined cases: null is the empty text; a text under 100 bytes keeps
everything; a doc_id that repeats is one document and gives one row (of differing
texts under one doc_id, one is taken); rows with a null doc_id are documents of
their own that come after all ids, in the order of their texts' hashes, and are
returned with the null; other columns are ignored whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm import common as C

LENGTH = 100
# A perfect difference cover, every difference modulo 21 occurs once.
COVER_MODULUS = 21
COVER = (3, 6, 7, 12, 14)

# Samples and the samples of contexts need no more than 32 bits besides their
# bucket: a chance tie only keeps a suffix in the work.  What decides is longer:
# contexts have 64 bits and their sample's, windows 80.
CONTEXT = np.dtype([("h", "<u4"), ("c", "<u8"), ("p", "<u4"), ("d", "<u2")])
WINDOW = np.dtype([("h", "<u8"), ("g", "<u2"), ("p", "<u4"), ("d", "<u2")])

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf, offsets = C.strings(batch.column("text"))
    return batch.column("doc_id").to_numpy(zero_copy_only=False), buf, offsets


class Cover:
    """Sampling geometry for duplicates of ``length`` bytes."""

    def __init__(self, length: int):
        if length <= COVER_MODULUS:
            raise ValueError(f"length must exceed the cover's modulus, {COVER_MODULUS}")
        self.length, self.sample = length, length - COVER_MODULUS + 1
        self.in_cover = np.zeros(COVER_MODULUS, bool)
        self.in_cover[list(COVER)] = True

    def positions(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, row) of every cover sample of texts that can hold a window at all."""
        size = np.diff(offsets)
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(offsets[-1])
        local = at - offsets[row]
        ok = self.in_cover[local % COVER_MODULUS] & (local + self.sample <= size[row]) & (size[row] >= self.length)
        return at[ok], row[ok]

    def samples(self, buf, offsets, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(byte, row, bucket, 32-bit rank name) of every cover sample."""
        at, row = self.positions(offsets)
        h = C.POLY.span(C.POLY.prefix_bytes(buf), at, at + self.sample)
        return at, row, ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), h.astype(np.uint32)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the ranges [lo, hi), one after the other."""
    size = np.maximum(hi - lo, 0)
    start = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else np.zeros(0, np.int64)
    return start + np.arange(len(start))


def _tied_samples(docs: DataFrame, cover: Cover, buckets: int) -> DataFrame:
    """Pass 1: (doc_id, hits) with the rank names of samples that occur more than once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, buf, offsets = _columns(batch)
            hs, bs, ds = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for lo, hi in C.pieces(offsets):
                _, row, b, h = cover.samples(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], buckets)
                hs.append(h)
                bs.append(b)
                ds.append(row + lo)
            h, b, d = np.concatenate(hs), np.concatenate(bs), np.concatenate(ds)
            order = np.lexsort((d, h, b))
            h, b, d = h[order], b[order], d[order]
            same = (h[1:] == h[:-1]) & (b[1:] == b[:-1])
            head, single = np.ones(len(h), bool), np.ones(len(h), bool)
            head[1:] = ~same
            single[1:] &= ~same
            single[:-1] &= ~same
            # equal samples of this batch are tied as they are; one of them is sent on
            again = ~single
            again[1:] &= head[1:] | (d[1:] != d[:-1])
            if again.any():
                yield C.hit_rows(ids[d[again]], h[again], buckets, settled=True)
            yield C.pair_rows(ids[d[head]], h[head], b[head])

    def sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        through, work = C.split_settled(batches)
        yield from through
        # a task may hold several buckets: their names are told apart
        for rows in _rows_by_bucket(work).values():
            name = np.sort(np.concatenate([np.frombuffer(work[b].column("body")[i].as_buffer(), "<u4") for b, i in rows]))
            tied = np.unique(name[1:][name[1:] == name[:-1]])
            del name
            # documents are looked up some rows at a time, and held for the tied names only
            docs_at, names_at = [], []
            for lo in range(0, len(rows) if len(tied) else 0, 32):
                doc, name = C.pairs([work[b].slice(i, 1) for b, i in rows[lo:lo + 32]], "<u4")
                at = tied[np.minimum(np.searchsorted(tied, name), len(tied) - 1)] == name
                docs_at.append(doc[at])
                names_at.append(name[at])
            if len(tied):
                yield C.hit_rows(np.concatenate(docs_at), np.concatenate(names_at), buckets)

    return C.gathered(C.dealt(docs.mapInArrow(emit, C.BLOB_SCHEMA), buckets).mapInArrow(sort_bucket, C.BLOB_SCHEMA), buckets, "<u4")


def _rows_by_bucket(batches: list[pa.RecordBatch]) -> dict[int, list[tuple[int, int]]]:
    """(batch, row) of every blob, by bucket."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for b, batch in enumerate(batches):
        for i, bucket in enumerate(batch.column("bucket").to_pylist()):
            rows.setdefault(bucket, []).append((b, i))
    return rows


def _by_bucket(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if batches:
        table = pa.Table.from_batches(batches).sort_by("bucket").combine_chunks()
        bucket = table.column("bucket").to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
        for lo, hi in zip(cut[:-1], cut[1:]):
            yield from table.slice(lo, hi - lo).combine_chunks().to_batches()


def _order_contexts(docs: DataFrame, cover: Cover, buckets: int) -> DataFrame:
    """Pass 2, over documents with tied samples: hits are sample positions, ``2 p + 1`` where the
    whole context of sample p has an earlier member and ``2 p`` where it is the first of several contexts."""
    reach = COVER_MODULUS - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, buf, offsets = _columns(batch)
            hits = batch.column("hits")
            parts, where = [np.zeros(0, CONTEXT)], [np.zeros(0, np.int32)]
            for lo, hi in C.pieces(offsets):
                offs = offsets[lo:hi + 1] - offsets[lo]
                piece = buf[offsets[lo]:offsets[hi]]
                at, row, bucket, h = cover.samples(piece, offs, buckets)
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                keep = np.zeros(len(h), bool)
                for r in range(hi - lo):
                    if hits[lo + r].is_valid:
                        s = slice(edge[r], edge[r + 1])
                        keep[s] = np.isin(h[s], np.frombuffer(hits[lo + r].as_buffer(), np.uint32))
                at, row, h = at[keep], row[keep], h[keep]
                where.append(bucket[keep])
                left, right = np.maximum(at - reach, offs[row]), np.minimum(at + cover.length, offs[row + 1])
                part = np.zeros(len(at), CONTEXT)
                part["h"], part["p"], part["d"] = h, at - offs[row], row + lo
                part["c"] = C.mix(C.POLY2.span(C.POLY2.prefix_bytes(piece), left, right) + ((at - left) * 4096 + (right - at)).astype(np.uint64))
                parts.append(part)
            body, bucket = np.concatenate(parts), np.concatenate(where)
            # of equal contexts in this batch only the first is sent; the others are settled here
            order = np.lexsort((body["p"], ids[body["d"]], body["c"], body["h"], bucket))
            body, bucket = body[order], bucket[order]
            head = np.ones(len(body), bool)
            head[1:] = (body["h"][1:] != body["h"][:-1]) | (body["c"][1:] != body["c"][:-1]) | (bucket[1:] != bucket[:-1])
            rest = body[~head]
            if len(rest):
                yield C.hit_rows(ids[rest["d"]], rest["p"] * np.uint32(2) + np.uint32(1), buckets, settled=True)
            yield C.blobs(bucket[head], body[head], ids)

    def sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        through, work = C.split_settled(batches)
        yield from through
        for part in _by_bucket(work):
            body, doc = C.unblob(iter([part]), CONTEXT)
            order = np.lexsort((body["p"], doc, body["c"], body["h"]))
            body, doc = body[order], doc[order]
            new_h = np.ones(len(body), bool)
            new_h[1:] = body["h"][1:] != body["h"][:-1]
            first = new_h.copy()
            first[1:] |= body["c"][1:] != body["c"][:-1]
            group = np.cumsum(new_h) - 1
            several = np.bincount(group, weights=first)[group] > 1
            told = ~first | several
            if told.any():
                yield C.hit_rows(doc[told], (body["p"] * np.uint32(2) + ~first)[told].astype(np.uint32), buckets)

    return C.gathered(C.dealt(docs.mapInArrow(emit, C.BLOB_SCHEMA), buckets).mapInArrow(sort_bucket, C.BLOB_SCHEMA), buckets, "<u4")


def _window_starts(points: np.ndarray, size: int, length: int) -> np.ndarray:
    """Starts of the windows that hold one of the samples, once each."""
    lo = np.maximum(points - (COVER_MODULUS - 1), 0)
    return np.unique(_ranges(lo, np.minimum(points, size - length) + 1))


def _order_windows(docs: DataFrame, cover: Cover, buckets: int) -> DataFrame:
    """Pass 3: hits are the starts of windows, near ambiguous samples, that occur earlier."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, buf, offsets = _columns(batch)
            hits = batch.column("hits")
            parts = [np.zeros(0, WINDOW)]
            for lo, hi in C.pieces(offsets):
                piece, offs = buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                one, two = C.POLY.prefix_bytes(piece), C.POLY2.prefix_bytes(piece)
                for r in range(hi - lo):
                    if not hits[lo + r].is_valid:
                        continue
                    point = np.frombuffer(hits[lo + r].as_buffer(), np.uint32).astype(np.int64)
                    at = _window_starts(point[point % 2 == 0] // 2, offs[r + 1] - offs[r], cover.length) + offs[r]
                    part = np.zeros(len(at), WINDOW)
                    part["h"] = C.POLY.span(one, at, at + cover.length)
                    part["g"] = C.POLY2.span(two, at, at + cover.length).astype(np.uint16)
                    part["p"], part["d"] = at - offs[r], lo + r
                    parts.append(part)
            body = np.concatenate(parts)
            order = np.lexsort((body["p"], ids[body["d"]], body["g"], body["h"]))
            body = body[order]
            head = np.ones(len(body), bool)
            head[1:] = (body["h"][1:] != body["h"][:-1]) | (body["g"][1:] != body["g"][:-1])
            rest = body[~head]
            if len(rest):
                yield C.hit_rows(ids[rest["d"]], rest["p"].copy(), buckets, settled=True)
            body = body[head]
            yield C.blobs((C.mix(body["h"]) % np.uint64(buckets)).astype(np.int32), body, ids)

    def sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        through, work = C.split_settled(batches)
        yield from through
        body, doc = C.unblob(iter(work), WINDOW)
        if not len(body):
            return
        order = np.lexsort((body["p"], doc, body["g"], body["h"]))
        body, doc = body[order], doc[order]
        later = np.zeros(len(body), bool)
        later[1:] = (body["h"][1:] == body["h"][:-1]) & (body["g"][1:] == body["g"][:-1])
        if later.any():
            yield C.hit_rows(doc[later], body["p"][later].copy(), buckets)

    return C.gathered(C.dealt(docs.mapInArrow(emit, C.BLOB_SCHEMA), buckets).mapInArrow(sort_bucket, C.BLOB_SCHEMA), buckets, "<u4")


def _cut(length: int):
    """Bytes that no duplicate window covers, from sample hits (``hits``) and window hits (``windows``)."""
    reach = COVER_MODULUS - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, buf, offsets = _columns(batch)
            out = [[], [], [], [], []]
            for r in range(len(ids)):
                text = buf[offsets[r]:offsets[r + 1]]
                n = len(text)
                cover = np.zeros(n + 1, np.int32)
                for name in ("hits", "windows"):
                    x = batch.column(name)[r]
                    if not x.is_valid:
                        continue
                    p = np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64)
                    if name == "hits":  # every window that holds the sample is a duplicate
                        p = p[p % 2 == 1] // 2
                        lo, hi = np.maximum(p - reach, 0), np.minimum(p, n - length)
                        lo, hi = lo[hi >= lo], hi[hi >= lo] + length
                    else:
                        lo, hi = p, p + length
                    np.add.at(cover, lo, 1)
                    np.add.at(cover, hi, -1)
                gone = np.cumsum(cover)[:-1] > 0
                kept = text[~gone].tobytes()
                spans = int(np.sum(gone[1:] & ~gone[:-1]) + (gone[0] if n else 0))
                for o, v in zip(out, (n, int(gone.sum()), spans, kept, hashlib.sha256(kept).hexdigest())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.binary()), pa.array(out[4], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return cut


def _plain(docs: DataFrame, kept: Column, gone: Column) -> DataFrame:
    """Result rows of texts that stay or go as a whole."""
    size = F.octet_length("text").cast("long")
    return docs.select("doc_id", size.alias("n_bytes"), F.when(gone, size).otherwise(F.lit(0)).cast("long").alias("n_removed"),
                       F.when(gone & (size > 0), 1).otherwise(0).cast("long").alias("n_spans"),
                       kept.cast("binary").alias("kept"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def remove_duplicates(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans (maximal removed runs), kept
    (the remaining bytes) and kept_sha256.  See the module docstring."""
    spark = docs.sparkSession
    C.prepare(spark)
    cover = Cover(length)
    docs, first = C.with_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    buckets = C.shuffle_buckets(spark, C.text_bytes(docs))

    # whole copies: texts whose digest has a smaller doc_id
    digests = C.written(docs.select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("n")), "texts")
    least = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).where("c > 1")
    salts = 16  # a digest shared by very many documents is joined in 16 parts
    spread = least.select("digest", "least", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    copies = C.written(
        digests.where(F.col("n") >= length).withColumn("salt", F.pmod("doc_id", F.lit(salts)).cast("int"))
        .join(spread, ["digest", "salt"]).where("doc_id > least").select("doc_id").distinct(), "copies")

    tied = C.written(_tied_samples(docs, cover, buckets), "tied-samples", release=True)
    repeats = digests.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    suspects, clean = C.split_by(docs, tied.select("doc_id").unionByName(copies).unionByName(repeats))
    # one shuffle of the suspects' texts; whole copies leave with all their bytes removed
    facts = tied.join(copies.withColumn("whole", F.lit(True)), "doc_id", "full")
    joined = C.written(suspects.dropDuplicates(["doc_id"]).join(facts, "doc_id", "left").select(
        "doc_id", "text", "hits", F.coalesce("whole", F.lit(False)).alias("whole")), "suspects", release=True)
    gone = joined.where("whole").select("doc_id", "text")
    untied = joined.where("not whole and hits is null").select("doc_id", "text")
    work = joined.where("not whole and hits is not null").select("doc_id", "text", "hits")

    points = C.written(_order_contexts(work, cover, buckets), "contexts", release=True)
    work = work.drop("hits").join(points, "doc_id", "left")
    windows = C.written(_order_windows(work, cover, buckets).withColumnRenamed("hits", "windows"), "windows", release=True)
    done = work.join(windows, "doc_id", "left").mapInArrow(_cut(length), RESULT)
    whole, none = F.lit(""), F.lit(False)
    return C.without_ids(_plain(clean, F.col("text"), none).unionByName(_plain(untied, F.col("text"), none))
                         .unionByName(_plain(gone, whole, F.lit(True))).unionByName(done), first)


def whole_characters(kept: pd.Series) -> pd.Series:
    """Bytes as text; the halves of characters that a cut went through are dropped."""
    return kept.map(lambda x: None if x is None else bytes(x).decode("utf-8", "ignore")).astype(object)


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract digest of ``remove_duplicates`` over all of ``documents``."""
    return remove_duplicates(C.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
