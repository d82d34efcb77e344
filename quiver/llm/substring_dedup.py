"""Substring deduplication with prefix-partitioned suffix trees.

The suffixes of all documents (one per word) are split by *variable-length
prefixes*: a suffix belongs to the group of its first word, unless more than a
memory-sized number of suffixes start with that word; then its first 2, 4, 8
or all ``window`` words name the group.  Prefix frequencies come from one
counting pass over all texts (hashed into a fixed number of cells, so a cell
over-counts at worst, which only lengthens a prefix).  Each group is one
subtree: its suffixes are sorted, equal ``window``-word labels are the
subtree's internal nodes of that depth, and a node with occurrences in more
than one document is a repeat; neighbouring repeated windows of a document
join to maximal repeats.  Every window but those of the smallest doc_id at a
node is a hit, and the words under hits are removed.

Bounds: words and windows travel as 64-bit hashes, ten bytes a suffix, packed
per batch and group; a label that repeats within one batch is sent once and
its later documents are resolved where they are (so a hot passage adds one
entry per batch, not per copy).  Two different windows are confused with a
chance of 2**-64 a pair within a group.  Texts of documents without a hit are
never shuffled.

Defined cases: a null or empty text has no words (kept text empty); texts
shorter than the window keep everything; rows that repeat a doc_id are
judged one by one, and equal doc_ids are never "smaller" than each other; rows
with a null doc_id are documents of their own that come after all ids, in the
order of their texts' hashes, and are returned with the null; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm import common as C

WINDOW = 13
DEPTHS = (1, 2, 4, 8)
CELLS = 1 << 14
ENTRY = np.dtype([("h", "<u8"), ("d", "<u2")])


def _suffixes(buf: np.ndarray, offsets: np.ndarray, window: int):
    """(words, window starts, window hashes, prefix sums) of one piece."""
    words = C.find_words(buf, offsets, C.NON_SPACE)
    start, end, doc = words
    symbols = C.POLY.span(C.POLY.prefix_bytes(buf), start, end)
    prefix = C.POLY.prefix_symbols(symbols)
    at, full = C.word_windows(symbols, doc, C.POLY, window, prefix)
    return words, at, full, prefix


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf, offsets = C.strings(batch.column("text"))
    return batch.column("doc_id").to_numpy(zero_copy_only=False), buf, offsets


def _cells(prefix: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    return (C.POLY.span(prefix, at, at + depth) >> np.uint64(50)).astype(np.int64)


def prefix_counts(docs: DataFrame, window: int = WINDOW) -> np.ndarray:
    """Suffix counts by hashed prefix, one row of ``CELLS`` cells per depth: a fixed 0.5 MB."""
    depths = [d for d in DEPTHS if d < window]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(depths) * CELLS, np.int64)
        for batch in batches:
            _, buf, offsets = _columns(batch)
            for lo, hi in C.pieces(offsets):
                _, at, _, prefix = _suffixes(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], window)
                for k, depth in enumerate(depths):
                    total[k * CELLS:(k + 1) * CELLS] += np.bincount(_cells(prefix, at, depth), minlength=CELLS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total[cell], pa.int64())], names=["cell", "n"])

    out = np.zeros(len(depths) * CELLS, np.int64)
    for r in docs.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(len(depths), CELLS)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, hits): packed hashes of the document's windows that also start in a smaller doc_id."""
    spark = docs.sparkSession
    counts = prefix_counts(docs, window)
    total = int(counts[0].sum()) if len(counts) else 0
    groups = C.shuffle_buckets(spark, total * ENTRY.itemsize, per_bucket=12 << 20)
    # a group fills a quarter of a task at most
    limit = max(1, total // (4 * groups))
    long = counts > limit
    depths = [d for d in DEPTHS if d < window]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, buf, offsets = _columns(batch)
            hs, bs, ds = [], [], []
            for lo, hi in C.pieces(offsets):
                words, at, full, prefix = _suffixes(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], window)
                key, open_ = full.copy(), np.ones(len(at), bool)
                for k, depth in enumerate(depths):  # the shortest prefix that is rare enough
                    part = C.POLY.span(prefix, at, at + depth)
                    rare = open_ & ~long[k][(part >> np.uint64(50)).astype(np.int64)]
                    key[rare] = part[rare]
                    open_ &= ~rare
                hs.append(full)
                bs.append((C.mix(key) % np.uint64(groups)).astype(np.int32))
                ds.append(words[2][at] + lo)
            if not hs:
                continue
            h, b, d = np.concatenate(hs), np.concatenate(bs), np.concatenate(ds)
            order = np.lexsort((ids[d], h))
            h, b, d = h[order], b[order], d[order]
            head = np.ones(len(h), bool)
            head[1:] = h[1:] != h[:-1]
            first = ids[d][head][np.cumsum(head) - 1] if len(h) else ids[d]
            here = ids[d] > first
            if here.any():  # resolved within the batch
                yield C.hit_rows(ids[d][here], h[here], groups, settled=True)
            body = np.zeros(int(head.sum()), ENTRY)
            body["h"], body["d"] = h[head], d[head]
            yield C.blobs(b[head], body, ids)

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        through, trees = C.split_settled(batches)
        yield from through
        body, doc = C.unblob(iter(trees), ENTRY)
        if not len(body):
            return
        # internal nodes of the wanted depth: labels with more than one occurrence
        label = np.sort(body["h"])
        node = np.unique(label[1:][label[1:] == label[:-1]])
        if not len(node):
            return
        k = np.minimum(np.searchsorted(node, body["h"]), len(node) - 1)
        at = np.flatnonzero(node[k] == body["h"])
        k, doc, h = k[at], doc[at], body["h"][at]
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, k, doc)
        later = doc > least[k]
        if later.any():
            yield C.hit_rows(doc[later], h[later], groups)

    rows = docs.select("doc_id", "text").mapInArrow(emit, C.BLOB_SCHEMA)
    return C.gathered(C.dealt(rows, groups).mapInArrow(subtrees, C.BLOB_SCHEMA), groups, "<u8")


RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept string, kept_sha256 string"


def _cut(window: int, texts: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, buf, offsets = _columns(batch)
            hits = batch.column("hits").to_pylist() if "hits" in batch.schema.names else [None] * len(ids)
            for lo, hi in C.pieces(offsets):
                piece, offs = buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                n, out = hi - lo, [[], [], [], [], []]
                if any(hits[lo:hi]):
                    (start, end, doc), at, full, _ = _suffixes(piece, offs, window)
                else:
                    (start, end, doc), at, full = C.find_words(piece, offs, C.NON_SPACE), np.zeros(0, np.int64), np.zeros(0, np.uint64)
                gone = np.zeros(len(start) + 1, np.int32)
                edge = np.searchsorted(doc[at], np.arange(n + 1)) if len(at) else np.zeros(n + 1, np.int64)
                for r in range(n):
                    if hits[lo + r]:
                        w = slice(edge[r], edge[r + 1])
                        hit = at[w][np.isin(full[w], np.frombuffer(hits[lo + r], np.uint64))]
                        np.add.at(gone, hit, 1)
                        np.add.at(gone, hit + window, -1)
                gone = np.cumsum(gone)[:-1] > 0 if len(start) else np.zeros(0, bool)
                # kept words with one space after each, as one buffer
                data = np.where(C.NON_SPACE[piece], piece, np.uint8(0x20)) if len(piece) else piece
                stop = np.minimum(end + 1, offs[doc + 1]) if len(start) else end
                mark = np.zeros(len(piece) + 1, np.int8)
                mark[start[~gone]] += 1
                mark[stop[~gone]] -= 1
                keep = np.cumsum(mark)[:-1] > 0
                size = np.concatenate([[0], np.cumsum(keep)])[offs]
                kept = data[keep].tobytes()
                bound = np.searchsorted(doc, np.arange(n + 1)) if len(start) else np.zeros(n + 1, np.int64)
                for r in range(n):
                    text = kept[size[r]:size[r + 1]]
                    text = text[:-1] if text.endswith(b" ") else text
                    g = gone[bound[r]:bound[r + 1]]
                    spans = int(np.sum(g[1:] & ~g[:-1]) + (g[0] if len(g) else 0))
                    for o, v in zip(out, (len(g), int(g.sum()), spans, text.decode() if texts else None, hashlib.sha256(text).hexdigest())):
                        o.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi], pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                     pa.array(out[3], pa.string()), pa.array(out[4], pa.string())],
                    names=["doc_id", "n_words", "n_removed", "n_spans", "kept", "kept_sha256"])

    return cut


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_removed, n_spans (maximal
    repeats removed), kept (kept words joined by one space; null unless
    ``texts``) and kept_sha256.  See the module docstring."""
    C.prepare(docs.sparkSession)
    docs, first = C.with_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    hits = C.written(repeated_windows(docs, window), "substring-hits", release=True)
    suspect, clean = C.split_by(docs, hits)
    whole = clean.mapInArrow(_cut(window, texts), RESULT)
    part = suspect.join(hits, "doc_id", "left").mapInArrow(_cut(window, texts), RESULT)
    return C.without_ids(whole.unionByName(part), first)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract digest of ``remove_repeats`` over all of ``documents``."""
    out = remove_repeats(C.table(spark, sf_dir, "documents"), texts=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "n_spans")
