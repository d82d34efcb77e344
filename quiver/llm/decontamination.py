"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are put, word by word, into one generalised suffix
automaton; training texts are streamed through it and the longest matching
length is tracked at every word.  A match of ``window`` words (or of a whole
shorter item) marks its words as hit; spans of hit words that exceed a length
limit, or texts whose hit share exceeds a coverage limit, are removed.

The automaton is sent to every task, so its size is bounded: items are packed
into shards of about ``SHARD_WORDS // 2`` words, dealt by a hash, and one pass
over the texts is made per shard (benchmarks of usual size are one shard).  No more than one shard's items are ever collected, and an
item over the bound is cut into overlapping parts that hold all its windows.
Streaming is exact and cheap: words that no item has reset the automaton, so
only runs of item words long enough for a window are stepped through.

Defined cases: null or empty texts have no words and no hit; items without
words match nothing; repeated items each count; rows that repeat a doc_id, or
have a null one, are judged one by one; extra columns stay in ``decontaminate`` and are ignored in
``contamination``; an empty benchmark leaves every text clean.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm import common as C

WINDOW = 10
SHARD_WORDS = 400_000
#: ``decontaminate``: spans of at least so many hit words go; texts with more than this share of hit words go whole.
SPAN_LIMIT, COVERAGE_LIMIT = 1, 0.5

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return _WORD.findall(raw.lower())  # bytes.lower touches A-Z only


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers.

    ``long`` maps a state to the items that hold its ``window``-word suffix;
    ``short`` maps a state to (length, item) of shorter whole items."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.long: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for item, words in items:
            state, length = 0, 0
            for k, w in enumerate(words):
                state, length = self.step(state, length, w)
                if length > window:  # keep the last window words
                    state, length = self.cut(state, window)
                if length == window and k + 1 >= window:
                    self.long.setdefault(state, set()).add(item)
            if 0 < len(words) < window:
                self.short.setdefault(state, []).append((len(words), item))
        self.has_short = bool(self.short)

    def _clone(self, p: int, w: int, q: int) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, w, q)
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.size.append(self.size[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._clone(p, w, q)
        return cur

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """State and length of the longest match that ends at word ``w``."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.size[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, length + 1)

    def cut(self, state: int, length: int) -> tuple[int, int]:
        """The state of the match's last ``length`` words."""
        while self.link[state] >= 0 and self.size[self.link[state]] >= length:
            state = self.link[state]
        return state, length

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, set[int] | tuple[int, ...]]]:
        """(last word, words covered, items) of every window occurrence; the match is kept at most a window long."""
        state, length = 0, 0
        for k, w in enumerate(words):
            state, length = self.step(state, length, w)
            if length >= self.window:
                state, length = self.cut(state, self.window)
                found = self.long.get(state)
                if found:
                    yield k, self.window, found
            if self.has_short:
                s = state
                while s > 0:
                    for size, item in self.short.get(s, ()):
                        if size <= length:
                            yield k, size, (item,)
                    s = self.link[s]


HITS = "doc_id long, row long, key long, n_words long, hit binary, items array<long>"


def _prepare_items(rows: list[tuple[int, str]], window: int):
    """Word numbers by hash, items as numbers, and the automaton of one shard."""
    number: dict[bytes, int] = {}
    items = [(item, [number.setdefault(w, len(number)) for w in item_words(text)]) for item, text in rows]
    least = min([min(len(w), window) for _, w in items if w], default=window)
    vocabulary = list(number)
    joined = b" ".join(vocabulary)
    buf = np.frombuffer(joined, np.uint8)
    start, end, _ = C.find_words(buf, np.array([0, len(buf)]), C.ALNUM)
    h = C.POLY.span(C.POLY.prefix_bytes(buf), start, end) if len(buf) else np.zeros(0, np.uint64)
    order = np.argsort(h)
    return h[order], np.arange(len(h))[order], SuffixAutomaton(items, window), least


def _scan(shared, window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number, automaton, least = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            rows, keys = batch.column("row"), batch.column("key")
            buf, offsets = C.strings(batch.column("text"))
            for lo, hi in C.pieces(offsets):
                n = hi - lo
                offs = offsets[lo:hi + 1] - offsets[lo]
                low = C.LOWER[buf[offsets[lo]:offsets[hi]]]
                start, end, doc = C.find_words(low, offs, C.ALNUM)
                bound = np.searchsorted(doc, np.arange(n + 1))
                hits: list[np.ndarray | None] = [None] * n
                items: list[set[int]] = [set() for _ in range(n)]
                if len(start) and len(table):
                    h = C.POLY.span(C.POLY.prefix_bytes(low), start, end)
                    k = np.minimum(np.searchsorted(table, h), len(table) - 1)
                    known = np.where(table[k] == h, number[k], -1)
                    # runs of item words inside one document
                    inside = known >= 0
                    edge = np.ones(len(known) + 1, bool)
                    edge[1:-1] = (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])
                    cut = np.flatnonzero(edge)
                    long = np.flatnonzero(inside[cut[:-1]] & (np.diff(cut) >= least))
                    for r in long:
                        a, b = cut[r], cut[r + 1]
                        d = doc[a]
                        for last, size, found in automaton.stream(known[a:b].tolist()):
                            if hits[d] is None:
                                hits[d] = np.zeros(bound[d + 1] - bound[d] + 1, np.int32)
                            at = a + last - bound[d]
                            hits[d][at - size + 1] += 1
                            hits[d][at + 1] -= 1
                            items[d].update(found)
                packed = [None if x is None else np.packbits(np.cumsum(x)[:-1] > 0).tobytes() for x in hits]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), rows.slice(lo, n), keys.slice(lo, n), pa.array(np.diff(bound), pa.int64()), pa.array(packed, pa.binary()),
                     pa.array([sorted(x) for x in items], pa.list_(pa.int64()))], names=["doc_id", "row", "key", "n_words", "hit", "items"])

    return scan


def _shards(benchmark: DataFrame, window: int) -> DataFrame:
    """Items (item_id, part text) with a shard number; shards hold about SHARD_WORDS // 2 words.

    Items are numbered by ranges of a hash of their id, so that no task sees all of them."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)  # as texts: A-Z only
    words = F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = items.withColumn("w", F.size(words)).where("w > 0")
    # an item over the bound is cut into parts that overlap by window - 1 words
    step = SHARD_WORDS - window + 1
    starts = F.sequence(F.lit(0), F.greatest(F.col("w") - window, F.lit(0)), F.lit(step))
    big = items.where(F.col("w") > SHARD_WORDS).select("item_id", F.explode(starts).alias("s"), words.alias("words")).select(
        "item_id", F.array_join(F.slice("words", F.col("s") + 1, SHARD_WORDS), " ").alias("text"), F.lit(SHARD_WORDS).alias("w"))
    items = items.where(F.col("w") <= SHARD_WORDS).unionByName(big)
    total = items.agg(F.sum("w")).first()[0] or 0
    n = -(-total // (SHARD_WORDS // 2))
    return items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, row - any number, passed on): doc_id, row,
    n_words, hit (bit per word, null without hits), items (ids with occurring windows)."""
    spark = docs.sparkSession
    C.prepare(spark)
    shards = C.written(_shards(benchmark, window), "benchmark-shards")
    numbers = [r["shard"] for r in shards.select("shard").distinct().collect()] or [0]
    keyed = docs.select("doc_id", "row", "text", F.monotonically_increasing_id().alias("key"))
    if len(numbers) > 1:  # the passes must see one number per row
        keyed = C.written(keyed, "decontamination-rows")
    out = None
    for s in numbers:
        rows = [(r["item_id"], r["text"]) for r in shards.where(F.col("shard") == s).select("item_id", "text").toLocalIterator()]
        shared = spark.sparkContext.broadcast(_prepare_items(rows, window))
        found = keyed.mapInArrow(_scan(shared, window), HITS)
        out = found if out is None else out.unionByName(found)
    if len(numbers) == 1:
        return out.drop("key")
    merged = F.expr("""unhex(aggregate(collect_list(hex(hit)), '', (a, x) -> case when a = '' then x else
        array_join(transform(sequence(1, length(a) div 2), i -> lpad(hex(cast(conv(substring(a, 2 * i - 1, 2), 16, 10) as int)
        | cast(conv(substring(x, 2 * i - 1, 2), 16, 10) as int)), 2, '0')), '') end))""")
    return out.groupBy("doc_id", "row", "key").agg(
        F.max("n_words").alias("n_words"), F.when(F.count("hit") > 0, merged).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).drop("key")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and a number that tells apart rows of one doc_id (equal rows may share it)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "row", F.xxhash64("doc_id", "text"))


def removed_spans(hit: bytes | None, n: int, span_limit: int) -> list[tuple[int, int]]:
    """Runs [first, last] of at least ``span_limit`` hit words."""
    if hit is None:
        return []
    x = np.concatenate([[0], np.unpackbits(np.frombuffer(hit, np.uint8))[:n], [0]]).astype(np.int8)
    lo, hi = np.flatnonzero(np.diff(x) == 1), np.flatnonzero(np.diff(x) == -1)
    return [(int(a), int(b)) for a, b in zip(lo, hi) if b - a >= span_limit]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span_limit: int = SPAN_LIMIT,
                  coverage_limit: float = COVERAGE_LIMIT) -> DataFrame:
    """``docs`` without contaminated spans: text from the first to the last word of
    each span is cut out; a text with a hit share above ``coverage_limit`` is dropped.
    All columns stay; ``n_chars``, where present, is counted anew for changed texts."""
    found = contamination(_rows(docs), benchmark, window).where("hit is not null").select("doc_id", "row", "n_words", "hit").dropDuplicates(["doc_id", "row"])
    found = C.written(found, "contaminated")
    keyed = docs.withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    suspect, clean = C.split_by(keyed, found)
    facts = found.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row2"), F.col("n_words").alias("__n"), F.col("hit").alias("__hit"))
    suspect = suspect.join(facts, suspect["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (suspect["__row"] == F.col("__row2")), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, n: pd.Series, hit: pd.Series) -> pd.Series:
        out = []
        for t, words, bits in zip(text, n, hit):
            if bits is None or t is None:
                out.append(t)
                continue
            spans = removed_spans(bits, int(words), span_limit)
            share = np.unpackbits(np.frombuffer(bits, np.uint8))[: int(words)].mean()
            if share > coverage_limit:
                out.append(None)
                continue
            raw = t.encode()
            low = C.LOWER[np.frombuffer(raw, np.uint8)]
            start, end, _ = C.find_words(low, np.array([0, len(raw)]), C.ALNUM)
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:start[a]])
                at = end[b - 1]
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pd.Series(out, dtype=object)

    columns = docs.columns
    done = suspect.withColumn("__text", cut("text", F.coalesce("__n", F.lit(0)), "__hit")).where("__hit is null or __text is not null")
    changed = [F.when(F.col("__hit").isNull(), F.col(c)).otherwise(F.col("__text") if c == "text" else F.char_length("__text").cast(docs.schema[c].dataType)).alias(c)
               if c in ("text", "n_chars") else F.col(c) for c in columns]
    return clean.drop("__row").unionByName(done.select(*changed))


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract digest of ``contamination`` over all of ``documents`` and ``benchmark``."""
    docs = _rows(C.table(spark, sf_dir, "documents"))
    found = contamination(docs, C.table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    bits = F.transform(F.split(F.hex("hit"), ""), lambda x: F.bit_count(F.conv(x, 16, 10).cast("int")))
    n_hit = F.coalesce(F.aggregate(bits, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(0)).cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
