"""Near-duplicate documents with SetSketch registers.

A document's set is its distinct word shingles.  Its SetSketch has 128
registers: register j is the smallest of its shingles' exponential values
under hash j, on an exponentially spaced scale, truncated to 16 bits
(``K = clip(floor(1 - log_b(min)), 0, q + 1)``).  Registers merge by maximum,
and two sets agree in a register with a probability close to their Jaccard
similarity, so register values can be banded:

1. rows with equal word sequences are one text (grouped by digest);
2. 32 bands of four registers give buckets; a pair at similarity 0.8 shares no
   bucket with a chance of (1 - 0.8**4)**32 < 5e-8;
3. pairs are estimated from register comparisons by joint maximum likelihood
   and dropped below 0.62 (five standard deviations under the threshold);
4. the rest are verified on full shingle sets, and verified links joined to
   components.

No bucket is expanded to all its pairs: first each text is compared with the
smallest id of its buckets in the first four bands; in the other bands a
component is one row per bucket, compared with the bucket's smallest component;
then texts of one bucket that are still in different components are paired, each
pair once and by its sketches within the join, where the bucket has few components.

Buckets of many components come from groups of near copies around one text, of which
most pairs are near the threshold without reaching it, so that no sketch tells them
apart.  There (``apart``) texts are not compared with each other but with the group's
*base*, the shingles that most of its texts have: a text is its differences from the
base, and the intersection of two texts follows from the sizes of their differences and
the overlap of these.  Two texts whose differences are small are linked whatever they
are; they are all linked with the text of the smallest differences.  Any other link
needs an overlap of a known size, and leaves few differences of one text out of the other;
so the two share one of the first few (prefix filter), and only texts that do are looked at.
The base decides what is compared, never what is a link.  So a group of copies
costs a few comparisons per copy, while no link is lost.

Defined cases: a null, empty or wordless text has an empty set, is linked with
nothing and keeps its own doc_id as component; a text with fewer words than a
shingle is one shingle; rows that repeat a doc_id are returned once each, every
one with the component of its own text; a null doc_id takes part like any other
and sorts after all of them: its component_id is the smallest doc_id of its
component, and null, with the row kept, where no text of the component has one;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm import common as C
from quiver.llm.components import components

SHINGLE = 4
REGISTERS, BAND = 128, 4
# SetSketch parameters: base, rate and largest register value.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
ESTIMATE_FLOOR = 0.62
#: Bands of the first round of comparisons.
FIRST_BANDS = 4
#: Components of a bucket up to which its texts are paired by their sketches.
FEW_ROOTS = 8
#: Texts of a group that make its base, and parts of a group in joins with facts about it.
BASE_TEXTS, SALTS = 64, 32
#: A difference is common in a group if more than one text in so many has it.
COMMON = 50

_RNG = np.random.default_rng(808)
_MUL = (_RNG.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def registers(least: np.ndarray) -> np.ndarray:
    """Register values of the smallest 32-bit uniform hashes."""
    uniform = (least.astype(np.float64) + 0.5) / 2.0**32
    value = -np.log1p(-uniform) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def shingles(buf: np.ndarray, offsets: np.ndarray, size: int):
    """(document, 64-bit hash) of every shingle, and the words as (start, end, document)."""
    buf = C.LOWER[buf]
    start, end, doc = C.find_words(buf, offsets, C.NON_SPACE)
    symbols = C.POLY.span(C.POLY.prefix_bytes(buf), start, end)
    prefix = C.POLY.prefix_symbols(symbols)
    at, h = C.word_windows(symbols, doc, C.POLY, size, prefix)
    bound = np.searchsorted(doc, np.arange(len(offsets)))
    short = np.flatnonzero((np.diff(bound) > 0) & (np.diff(bound) < size))
    row, value = doc[at], h
    if len(short):
        whole = C.mix(C.POLY.span(prefix, bound[short], bound[short + 1]) + np.diff(bound)[short].astype(np.uint64))
        row, value = np.concatenate([row, short]), np.concatenate([value, whole])
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    return row, value, (buf, start, end, doc)


PROFILE = "doc_id long, row long, n_shingles long, digest string, sketch array<int>"


def _profile(size: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id"), batch.column("row")
            buf, offsets = C.strings(batch.column("text"))
            for lo, hi in C.pieces(offsets):
                n = hi - lo
                offs = offsets[lo:hi + 1] - offsets[lo]
                row, h, (low, start, end, doc) = shingles(buf[offsets[lo]:offsets[hi]], offs, size)
                bits = np.uint64(max(1, (n - 1).bit_length()))
                key = np.sort((row.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits))
                distinct = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
                count = np.bincount((distinct >> (np.uint64(64) - bits)).astype(np.int64), minlength=n)
                least = np.full((n, REGISTERS), 0xFFFFFFFF, np.uint32)
                cut = np.searchsorted(row, np.arange(n))
                some = np.flatnonzero(np.bincount(row, minlength=n)) if len(row) else np.zeros(0, np.int64)
                if len(some):
                    for j in range(REGISTERS):
                        least[some, j] = np.minimum.reduceat(((h * _MUL[j] + _ADD[j]) >> np.uint64(32)).astype(np.uint32), cut[some])
                sketch = registers(least).astype(np.int32)
                # normalised words: each followed by one space
                mark = np.zeros(len(low) + 1, np.int8)
                mark[start] += 1
                mark[np.minimum(end + 1, offs[doc + 1]) if len(end) else end] -= 1
                keep = np.cumsum(mark)[:-1] > 0
                edge = np.concatenate([[0], np.cumsum(keep)])[offs]
                words = np.where(C.NON_SPACE[low], low, np.uint8(0x20))[keep].tobytes()
                digest = [hashlib.sha256(words[edge[r]:edge[r + 1]].rstrip(b" ")).hexdigest() for r in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), rows.slice(lo, n), pa.array(count, pa.int64()), pa.array(digest, pa.string()),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * REGISTERS, pa.int32()), pa.array(sketch.ravel(), pa.int32()))],
                    names=["doc_id", "row", "n_shingles", "digest", "sketch"])

    return profile


def _compare(a: str, b: str) -> tuple[Column, Column]:
    """(registers where a is larger, registers where both are equal)."""
    more = F.aggregate(F.zip_with(a, b, lambda x, y: (x > y).cast("int")), F.lit(0), lambda s, x: s + x)
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return more, same


def likelihood_estimate(more: Column, same: Column, n_a: Column, n_b: Column) -> Column:
    """Maximum-likelihood Jaccard from register comparisons and both set sizes.

    With u, v the sizes' shares, a register of a is larger with probability
    u - v J, smaller with v - u J, equal with J (base near 1); the likelihood's
    derivative is zero at the smaller root of a quadratic."""
    m = F.lit(float(REGISTERS))
    u = n_a / (n_a + n_b)
    v = n_b / (n_a + n_b)
    less = m - more - same
    mid = same * (u * u + v * v) + more * v * v + less * u * u
    root = F.sqrt(F.greatest(mid * mid - 4 * u * u * v * v * m * same, F.lit(0.0)))
    return (mid - root) / (2 * u * v * m)


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingle set of every text."""
    buf, offsets = C.strings(column)
    for lo, hi in C.pieces(offsets):
        row, h, _ = shingles(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], size)
        cut = np.searchsorted(row, np.arange(hi - lo + 1))
        for r in range(hi - lo):
            yield np.unique(h[cut[r]:cut[r + 1]])


def _shingle_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.view(np.int64) for x in _sets(batch.column("text"), size)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["key", "shingles"])

    return run


def _salted(members: DataFrame, facts: DataFrame) -> DataFrame:
    """``members`` with the facts about their group; a group of any size is met in ``SALTS`` parts."""
    copies = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    return members.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).join(copies, ["group", "salt"]).drop("salt")


def differences(members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(group, key, root, diff, spare, weight, room) of (group, key, root, shingles) rows: what a text has and the
    group's base has not, and what it lacks of it; two texts are linked when
    (share[0] + share[1]) * overlap of their diffs >= the sum of their weights - room, and
    a linked text has all but ``spare`` of the differences too."""
    first = Window.partitionBy("group").orderBy(F.xxhash64("key"), "key")
    some = members.withColumn("i", F.row_number().over(first)).where(F.col("i") <= BASE_TEXTS)
    texts = some.groupBy("group").agg(F.count("*").alias("texts"))
    most = some.select("group", F.explode("shingles").alias("h")).groupBy("group", "h").agg(F.count("*").alias("c")).join(texts, "group").where("2 * c > texts")
    base = texts.join(most.groupBy("group").agg(F.collect_list("h").alias("base")), "group", "left").select(
        "group", F.coalesce("base", F.array().cast("array<long>")).alias("base"))
    more, less = F.array_except("shingles", "base"), F.array_except("base", "shingles")
    spare = F.floor((share[1] - share[0]) * F.size("shingles") / F.lit(share[0])).cast("int")
    return _salted(members, base).select("group", "key", "root", F.concat(more, less).alias("diff"), spare.alias("spare"),
                                         (share[1] * F.size(less) + share[0] * F.size(more)).cast("long").alias("weight"),
                                         ((share[1] - share[0]) * F.size("base")).cast("long").alias("room"))


def apart(members: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b): links that join the components of every group, given as (group, key, root, shingles) rows.

    Links of texts that are of one component already may be missing, no others."""
    total = share[0] + share[1]
    diffs = C.written(differences(members, share), "differences")
    groups = C.written(diffs.groupBy("group").agg(F.count("*").alias("texts"), F.min(F.struct("weight", "key")).alias("m")).select(
        "group", "texts", F.col("m.key").alias("centre"), F.col("m.weight").alias("least")), "groups")
    # differences that many texts of a group have stand last; those of over one in COMMON are few, whatever the group
    common = diffs.select("group", F.explode("diff").alias("h")).groupBy("group", "h").agg(F.count("*").alias("c")).where("c > 1").join(
        groups, "group").where(F.col("c") * COMMON > F.col("texts")).groupBy("group").agg(F.collect_list("h").alias("common"))
    facts = groups.join(common, "group", "left").select("group", "centre", "least", F.coalesce("common", F.array().cast("array<long>")).alias("common"))
    diffs = _salted(diffs, facts).withColumn("near", F.col("weight") + F.col("least") <= F.col("room")).withColumn("diff", F.concat(
        F.sort_array(F.array_except("diff", "common")), F.sort_array(F.array_intersect("diff", "common")))).drop("common")
    diffs = C.written(diffs, "differences")
    # no overlap needed: linked with the centre
    stars = diffs.where("near and key != centre").select(F.col("centre").alias("a"), F.col("key").alias("b"))

    def heads(rows: DataFrame, need: Column, end: str) -> DataFrame:
        """The first differences of each text, of which a link that needs ``need`` common ones shares one."""
        need = F.greatest(F.ceil(need / F.lit(total)), F.lit(1)).cast("int")
        length = F.greatest(F.least(F.size("diff") - need, F.col("spare")) + 1, F.lit(0))
        return rows.select("group", F.col("key").alias(end), F.col("root").alias(f"root_{end}"), F.explode(F.slice("diff", F.lit(1), length)).alias("h"))

    # every other pair has a text that is not near; against one of those a text needs this much
    against_far = F.col("weight") - F.col("least") + 1
    far = diffs.where("not near")
    pairs = heads(diffs.where("near"), against_far, "a").join(heads(far, F.col("weight") + F.col("least") - F.col("room"), "b"), ["group", "h"])
    pairs = pairs.unionByName(heads(far, against_far, "a").join(heads(far, against_far, "b"), ["group", "h"]).where("a < b"))
    # a pair of several groups is looked at in one of them
    pairs = pairs.where("root_a != root_b").select("group", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = C.written(pairs.groupBy("a", "b").agg(F.min("group").alias("group")), "sharing-pairs")
    for end in ("a", "b"):
        pairs = pairs.join(diffs.select("group", F.col("key").alias(end), F.col("diff").alias(f"d_{end}"), F.col("weight").alias(f"w_{end}"),
                                        *(["room"] if end == "a" else [])), ["group", end])
    linked = total * F.size(F.array_intersect("d_a", "d_b")) >= F.col("w_a") + F.col("w_b") - F.col("room")
    return stars.unionByName(pairs.where(linked).select("a", "b"))


def _verify(size: int, share: tuple[int, int]):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(_sets(batch.column("text_a"), size), _sets(batch.column("text_b"), size)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(share[1] * both >= share[0] * (len(x) + len(y) - both) and both > 0)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return verify


def row_hash() -> Column:
    """What tells apart the texts of one doc_id."""
    return F.xxhash64(F.col("text").cast("string"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept; see ``near_duplicate_rows``."""
    return near_duplicate_rows(docs, size, share).drop("row")


def near_duplicate_rows(docs: DataFrame, size: int = SHINGLE, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """Per row of ``docs``: doc_id, row (``row_hash`` of its text), n_shingles, component_id, kept.

    Two sets are linked when share[1] * intersection >= share[0] * union.  See
    the module docstring; for thresholds under 0.8 raise the number of bands."""
    spark = docs.sparkSession
    C.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_hash().alias("row"))
    prof = C.written(docs.mapInArrow(_profile(size), PROFILE), "sketches")
    # one row per distinct word sequence, under a number of its own: a doc_id may have several
    reps = prof.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    reps = C.written(reps.withColumn("key", F.monotonically_increasing_id()), "texts")

    likely = share[0] / share[1] - (0.8 - ESTIMATE_FLOOR)
    bands = REGISTERS // BAND

    def close(n_a: Column, n_b: Column) -> Column:
        return share[1] * F.least(n_a, n_b) >= share[0] * F.greatest(n_a, n_b)

    def slice_of(sketch: str, i: Column) -> Column:
        return F.slice(sketch, i * BAND + 1, BAND)

    def buckets(labels: DataFrame, first: int, last: int) -> DataFrame:
        """(key, n, sketch, root, band, bucket) of every text in the bands first..last - 1."""
        at = F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("band")
        rows = labels.select("key", "root", "n", "sketch", at)
        return rows.withColumn("bucket", F.xxhash64("band", slice_of("sketch", F.col("band"))))

    def stars(labels: DataFrame, first: int, last: int) -> DataFrame:
        """Pairs (a, b): of every bucket with texts of several components, the smallest text of the
        smallest component with the smallest text of each other one; a component is one row a bucket."""
        parts = buckets(labels, first, last).groupBy("bucket", "root").agg(F.min("key").alias("b"))
        heads = parts.groupBy("bucket").agg(F.min(F.struct("root", "b")).alias("x"), F.count("*").alias("c")).where("c > 1")
        return parts.join(heads.select("bucket", "x"), "bucket").where("root != x.root").select(F.col("x.b").alias("a"), "b").distinct()

    def checked(pairs: DataFrame) -> DataFrame:
        """Of written pairs (a, b), those that are links: estimated first, then verified on full sets."""
        def ends(p: DataFrame, a: str, b: str, name: str) -> DataFrame:
            return p.select(F.col(a).alias(name)).unionByName(p.select(F.col(b).alias(name)))

        facts = C.split_by(reps.select("key", "row", "n", "sketch"), ends(pairs, "a", "b", "key"), "key")[0]
        for end in ("a", "b"):
            pairs = pairs.join(facts.select(F.col("key").alias(end), F.col("row").alias(f"row_{end}"), F.col("n").alias(f"n_{end}"),
                                            F.col("sketch").alias(f"s_{end}")), end)
        more, same = _compare("s_a", "s_b")
        pairs = pairs.where(close(F.col("n_a"), F.col("n_b"))).select("a", "b", "row_a", "row_b", "n_a", "n_b", more.alias("more"), same.alias("same"))
        pairs = pairs.where(likelihood_estimate(F.col("more"), F.col("same"), F.col("n_a"), F.col("n_b")) >= likely).select("a", "b", "row_a", "row_b")
        pairs = C.written(pairs, "likely-pairs")
        texts = C.split_by(docs, ends(pairs, "row_a", "row_b", "row"), "row")[0].dropDuplicates(["row"])
        for end in ("a", "b"):
            pairs = pairs.join(texts.select(F.col("row").alias(f"row_{end}"), F.col("text").alias(f"text_{end}")), f"row_{end}")
        return pairs.select("a", "b", "text_a", "text_b").mapInArrow(_verify(size, share), "a long, b long")

    def labelled(links: DataFrame) -> DataFrame:
        found = components(links).withColumnRenamed("node", "key")
        return C.written(reps.join(found, "key", "left").select("key", "n", "sketch", F.coalesce("root", "key").alias("root")), "components")

    # the first bands join nearly all copies, one comparison each
    alone = reps.withColumn("root", F.col("key"))
    tried = C.written(stars(alone, 0, FIRST_BANDS), "stars")
    links = C.written(checked(tried), "links")
    labels = labelled(links)
    # the other bands, component by component
    second = C.written(stars(labels, FIRST_BANDS, bands), "stars")
    links = C.written(links.unionByName(checked(second)), "links")
    labels = labelled(links)
    # what is left: texts of one bucket in different components
    keys = buckets(labels, 0, bands).select("bucket", "band", "key", "n", "root")
    several = C.written(keys.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("bucket", "x"), "mixed-keys")
    mixed = C.written(C.split_by(keys, several, "bucket")[0].join(several, "bucket"), "mixed-buckets")
    # in buckets of many components, by their differences from a base; such buckets with one largest component are one group
    crowded = C.written(mixed.select("bucket", "root").distinct().groupBy("bucket").agg(F.count("*").alias("roots")).where(F.col("roots") > FEW_ROOTS)
                        .select("bucket"), "crowded-buckets")
    if crowded.limit(1).count():
        crowd = C.written(mixed.join(crowded, "bucket").select("bucket", "key", "root"), "crowd-texts")
        parts = crowd.select("key", "root").distinct().groupBy("root").agg(F.count("*").alias("texts"))
        largest = crowd.select("bucket", "root").distinct().join(parts, "root").groupBy("bucket").agg(
            F.max(F.struct("texts", (-F.col("root")).alias("least"))).alias("x")).select("bucket", (-F.col("x.least")).alias("group"))
        members = C.written(crowd.join(largest, "bucket").select("group", "key", "root").distinct(), "crowds")
        rows = C.split_by(reps.select("key", "row"), members, "key")[0].join(members.select("key").distinct(), "key")
        rows = C.written(rows, "crowd-rows")
        texts = C.split_by(docs, rows, "row")[0].dropDuplicates(["row"]).select("row", "text")
        sets = C.written(rows.join(texts, "row").select("key", "text").mapInArrow(_shingle_sets(size), "key long, shingles array<long>"), "crowd-sets")
        links = C.written(links.unionByName(apart(members.join(sets, "key"), share)), "links")
        labels = labelled(links)
        mixed = C.written(mixed.join(crowded, "bucket", "left_anti").drop("root").join(labels.select("key", "root"), "key"), "mixed-buckets")
    # in the others by their sketches within the join; a pair counts in the first band it shares
    sketches = C.split_by(reps.select("key", "sketch"), mixed, "key")[0]
    mixed = mixed.join(sketches, "key")
    x, y = (mixed.select("bucket", *(F.col(c).alias(f"{c}_{e}") for c in ("key", "n", "root", "sketch", "band"))) for e in "ab")
    _, same = _compare("sketch_a", "sketch_b")
    earlier = F.exists(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: (i < F.col("band_a")) & (
        slice_of("sketch_a", i) == slice_of("sketch_b", i)))
    cross = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("root_a") < F.col("root_b")) & close(F.col("n_a"), F.col("n_b"))
                   & (same >= int(REGISTERS * likely)) & ~earlier)
    cross = cross.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()
    before = tried.unionByName(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = C.written(cross.join(before, ["a", "b"], "left_anti"), "cross-pairs")
    late = C.written(checked(cross), "links")
    if late.limit(1).count():
        labels = labelled(links.unionByName(late))

    # the smallest doc_id of every component; most are one text
    texts = reps.select("key", "digest", "doc_id").join(labels.select("key", "root"), "key")
    least = texts.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    whole = texts.join(least, "root").select("digest", "component_id")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (prof.select("doc_id", "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(whole, "digest", "left")
            .select("doc_id", "row", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")))


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract columns of ``near_duplicates`` over all of ``documents``."""
    return near_duplicates(C.table(spark, sf_dir, "documents"))
