"""Helpers shared by the training-data operators.

* byte-level tokenising and rolling hashes over Arrow string columns, in numpy;
* *bucket blobs*: the compact form in which many (hash, document) entries are
  shuffled - one row per input batch and bucket, entries packed as numpy bytes;
* a bounded bitmap that keeps texts of untouched documents out of a shuffle;
* written tables in the shared scratch folder, to cut lineage.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.session import checkpoint_dir, scratch_path, ship_package

#: Rows of one Arrow batch sent to Python; keeps a worker's batch at a few MB of text.
BATCH_ROWS = "1024"
#: Bytes of text handled at once by the numpy helpers (a longer text is one piece).
CHUNK_BYTES = 1 << 19

# The bytes that separate words, space and \x09-\x0D.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def prepare(spark: SparkSession) -> None:
    """Shared folder, package on the executors, moderate Arrow batches."""
    checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: lineage ends here.

    ``release``: the job shuffled much, and its shuffle files shall go before the next one."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    # the job's shuffle files go when nothing in the driver refers to them any more; its
    # last listener events still do for a moment
    for _ in range(2 if release else 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.25)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_ids(docs: DataFrame) -> tuple[DataFrame, int | None]:
    """(docs, first): rows with a null doc_id get numbers of their own, from ``first`` on, above every
    doc_id and in the order of their texts' hashes; without such rows ``docs`` itself and None."""
    doc_id = F.col("doc_id").cast("long")
    most, nulls = docs.agg(F.max(doc_id), F.count_if(doc_id.isNull())).first()
    if not nulls:
        return docs, None
    first = 0 if most is None else most + 1
    if first + (1 << 56) >= 1 << 63:
        raise ValueError("doc_id leaves no numbers for rows without one")
    text = F.col("text").cast("string")
    number = F.lit(first) + F.monotonically_increasing_id()
    lone = written(docs.where(doc_id.isNull()).orderBy(F.xxhash64(text), text).withColumn("doc_id", number), "rows-without-id")
    return docs.where(doc_id.isNotNull()).withColumn("doc_id", doc_id).unionByName(lone.select(*docs.columns)), first


def without_ids(df: DataFrame, first: int | None, kind: str = "long") -> DataFrame:
    """``df`` with the numbers of ``with_ids`` taken back to null."""
    return df if first is None else df.withColumn("doc_id", F.when(F.col("doc_id") < first, F.col("doc_id")).cast(kind))


def shuffle_buckets(spark: SparkSession, total_bytes: int, per_bucket: int = 24 << 20) -> int:
    """Buckets for entries derived from ``total_bytes`` of text; grows with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total_bytes or 0) // per_bucket))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


# ---------------------------------------------------------------- numpy side

def word_table(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


#: Words are runs of anything but white space (bytes of a multi-byte character are never spaces).
NON_SPACE = word_table(lambda b: b not in SPACES)
#: Lower-case letters, digits and every non-ASCII character.
ALNUM = word_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Poly:
    """Rolling polynomial hash modulo 2**64 over bytes or 64-bit symbols.

    A window's hash is a difference of prefix sums times an inverse power, so
    that it does not depend on where the window stands; windows here are at
    most a few hundred symbols long and every hash is finalised with ``mix``."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.symbols = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._pw = np.ones(1, np.uint64)
        self._ipw = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._pw) < n:
            size = 1 << max(12, (n - 1).bit_length())
            for name, b in (("_pw", self.base), ("_ipw", self.inverse)):
                out = np.ones(1, np.uint64)
                while len(out) < size:  # doubling: powers k..2k-1 are powers 0..k-1 times b**k
                    out = np.concatenate([out, out * np.uint64(pow(b, len(out), 1 << 64))])
                setattr(self, name, out)
        return self._pw, self._ipw

    def prefix_bytes(self, buf: np.ndarray) -> np.ndarray:
        return self._prefix(self.symbols[buf])

    def _prefix(self, values: np.ndarray) -> np.ndarray:
        pw, _ = self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * pw[: len(values)], out=out[1:])
        return out

    def prefix_symbols(self, values: np.ndarray) -> np.ndarray:
        return self._prefix(values)

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, ipw = self._powers(len(prefix))
        return mix((prefix[end] - prefix[start]) * ipw[start])


#: Two independent hash functions; module-level, so that a Python worker keeps their power tables.
POLY, POLY2 = Poly(301), Poly(302)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null is empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) \
        if len(column) else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    buf = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return buf, offsets - lo


def pieces(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def find_words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word; words never cross documents."""
    ok = is_word[buf]
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = ok.copy()
    first[1:] &= ~ok[:-1] | edge[1:n]
    last = ok.copy()
    last[:-1] &= ~ok[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_windows(symbols: np.ndarray, doc: np.ndarray, poly: Poly, size: int,
                 prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``size`` words inside one document."""
    if len(symbols) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[size - 1:] == doc[: len(doc) - size + 1])
    prefix = poly.prefix_symbols(symbols) if prefix is None else prefix
    return at, poly.span(prefix, at, at + size)


# ------------------------------------------------------------- bucket blobs

BLOB_SCHEMA = "bucket int, ids binary, body binary"


def blobs(bucket: np.ndarray, body: np.ndarray, doc_ids: np.ndarray) -> pa.RecordBatch:
    """One row per bucket: the batch's document ids and this bucket's entries.

    ``body`` is a structured array; its field ``d`` (uint16) points into
    ``doc_ids``, so a batch holds at most 65,536 documents."""
    order = np.argsort(bucket, kind="stable")
    b, body = bucket[order], body[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]]) if len(b) else np.zeros(1, np.int64)
    rows_b, rows_i, rows_x = [], [], []
    for lo, hi in zip(cut[:-1], cut[1:]):
        part = body[lo:hi].copy()
        used, part["d"] = np.unique(part["d"], return_inverse=True)
        rows_b.append(int(b[lo]))
        rows_i.append(doc_ids[used].astype(np.int64).tobytes())
        rows_x.append(part.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows_b, pa.int32()), pa.array(rows_i, pa.binary()), pa.array(rows_x, pa.binary())],
                                      names=["bucket", "ids", "body"])


def unblob(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a task's buckets: (entries, document id of each)."""
    bodies, ids = [], []
    for batch in batches:
        for i, x in zip(batch.column("ids"), batch.column("body")):
            body = np.frombuffer(x.as_buffer(), dtype)
            bodies.append(body)
            ids.append(np.frombuffer(i.as_buffer(), np.int64)[body["d"]])
    if not bodies:
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    return np.concatenate(bodies), np.concatenate(ids)


#: Hits on their way to their documents travel as blobs too: of a group of documents
#: the ids with their numbers of values, and the values one after the other.
IDS = np.dtype([("i", "<i8"), ("n", "<u4")])


def packed(doc: np.ndarray, values: np.ndarray, group: np.ndarray) -> tuple[list[int], list[bytes], list[bytes]]:
    """(groups, ids, values of the documents in order) of pairs (document, value)."""
    order = np.lexsort((doc, group))
    group, doc, values = group[order], doc[order], values[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]) if len(group) else np.zeros(1, np.int64)
    ids, bodies = [], []
    for lo, hi in zip(cut[:-1], cut[1:]):
        i, n = np.unique(doc[lo:hi], return_counts=True)
        head = np.zeros(len(i), IDS)
        head["i"], head["n"] = i, n
        ids.append(head.tobytes())
        bodies.append(values[lo:hi].tobytes())
    return group[cut[:-1]].tolist() if len(group) else [], ids, bodies


def hit_rows(doc: np.ndarray, values: np.ndarray, groups: int, settled: bool = False) -> pa.RecordBatch:
    """Hits (document, value), one row per group of documents; hits that a batch
    resolved by itself stand among its blobs, with the bucket -1 - group."""
    group, ids, bodies = packed(doc, values, (mix(doc.astype(np.uint64)) % np.uint64(groups)).astype(np.int32))
    group = np.array(group, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(-1 - group if settled else group, pa.int32()), pa.array(ids, pa.binary()), pa.array(bodies, pa.binary())],
                                      names=["bucket", "ids", "body"])


def pair_rows(doc: np.ndarray, values: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """Pairs (document, value), one row per bucket; a document's id is sent once per row."""
    group, ids, bodies = packed(doc, values, bucket)
    return pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(ids, pa.binary()), pa.array(bodies, pa.binary())],
                                      names=["bucket", "ids", "body"])


def pairs(batches: Iterator[pa.RecordBatch], dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(documents, values) of such rows."""
    docs, values = [np.zeros(0, np.int64)], [np.zeros(0, dtype)]
    for batch in batches:
        for i, x in zip(batch.column("ids"), batch.column("body")):
            head = np.frombuffer(i.as_buffer(), IDS)
            docs.append(np.repeat(head["i"], head["n"]))
            values.append(np.frombuffer(x.as_buffer(), dtype))
    return np.concatenate(docs), np.concatenate(values)


def split_settled(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
    """(hit rows that only pass through, blobs to work on)."""
    through, work = [], []
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        if len(bucket) and bucket.min() >= 0:
            work.append(batch)
            continue
        passed = batch.filter(pa.array(bucket < 0))
        if passed.num_rows:
            through.append(pa.RecordBatch.from_arrays([pa.array(-1 - bucket[bucket < 0], pa.int32()), passed.column("ids"), passed.column("body")],
                                                      names=["bucket", "ids", "body"]))
        work.append(batch.filter(pa.array(bucket >= 0)))
    return through, work


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Blobs to the task of their bucket, settled hits to that of their group."""
    slot = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.col("bucket")).cast("int")
    return rows.repartition(buckets, slot)


def gathered(hits: DataFrame, groups: int, dtype: str) -> DataFrame:
    """(doc_id, hits): one row per document with all its values as packed bytes (at most its own windows)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, value = pairs(batches, dtype)
        if not len(doc):
            return
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
        for lo in range(0, len(cut) - 1, 1024):
            edge = cut[lo:lo + 1025]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[edge[:-1]], pa.int64()), pa.array([value[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())],
                names=["doc_id", "hits"])

    return hits.repartition(groups, "bucket").mapInArrow(gather, "doc_id long, hits binary")


# -------------------------------------------------- bounded document bitmap

CELLS = 1 << 23  # bits, 1 MB in all: the bound on what is broadcast


def split_by(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows that ``ids`` may name, rows that it surely does not name), without a shuffle of ``docs``.

    The ids are hashed into a bitmap of a fixed size, 256 rows of 4 KB, which is
    broadcast whatever the number of ids; with very many ids it merely prunes
    less, so an exact join of the first part must follow."""
    cell = F.pmod(F.xxhash64(F.col(key)), F.lit(CELLS)) + 1
    bits = ids.select(cell.alias("c")).groupBy(F.bitmap_bucket_number("c").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("__bits"))
    marked = docs.withColumn("__cell", cell)
    marked = marked.join(F.broadcast(bits), F.bitmap_bucket_number("__cell") == F.col("__bucket"), "left")
    at = F.bitmap_bit_position("__cell")
    byte = F.conv(F.hex(F.substr("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = marked.withColumn("__maybe", F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False)))
    return tuple(marked.where(c).select(*docs.columns) for c in (F.col("__maybe"), ~F.col("__maybe")))
