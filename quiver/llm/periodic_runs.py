r"""Periodic runs of words: Baier's grouping, Lyndon roots, and their extension.

A *run* of a text is a stretch of consecutive words with smallest period q, at
least ``exponent`` times q and ``shortest`` words long, that no neighbouring word
extends.  Every run has a root that is the longest Lyndon word from its place,
under an order of the words or under the reverse order.  So per stretch of words

1. the first phase of Baier's suffix sorter *groups* the suffixes: groups are
   taken from the greatest down, and a group moves the nearest unfinished suffix
   before each of its members up, lengthening that suffix's context by its own;
   when a group is taken, the context of its members is their longest Lyndon
   word, so the phase yields the Lyndon array without sorting any suffix;
2. both orders give one Lyndon array each;
3. a place that is followed by a copy of its Lyndon word is a *root*; roots are
   extended to both sides through longest common extensions (word numbers
   compared in growing blocks) into runs; a root inside a known run of its period
   is that run's.

Before that, words that cannot lie in a run are put aside, exactly: each word of
a run occurs in it ``exponent`` times at least, so rarer words of a stretch cut it,
and again for the shorter stretches.  What remains holds every run whole, so the
prose between repeated passages costs a count a word and no grouping.

Every text is worked on alone, in the task that reads it: there is no shuffle, and
a lost executor costs the texts of its tasks.  A text is cut into words a slice at
a time and kept as 32-bit word numbers, its distinct words, and a few 32-bit arrays
for the stretches that repeat.

Defined cases: a null or empty text has no words, no runs and the digests of the
empty string; a null doc_id is kept, and its text is never edited; rows that repeat
a doc_id are judged one by one; extra columns are ignored; of runs of one exponent
the first is the greatest, then that of the smaller period; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm import common as C

#: Least length of a run in periods, and in words.
EXPONENT = 4
SHORTEST = 6
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 20
#: Rounds of cutting at rare words; what more rounds would put aside is grouped instead.
ROUNDS = 8


# ------------------------------------------------------- words as numbers

def word_numbers(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """(number of every word, the distinct words), words in order of appearance."""
    number: dict[bytes, int] = {}
    parts, lo = [], 0
    while lo < len(text):
        hi = lo + SLICE
        while hi < len(text) and text[hi] not in C.SPACES:  # a slice ends before white space
            hi += 1
        words = text[lo:hi].split()  # at the six ASCII spaces
        for w in dict.fromkeys(words):
            number.setdefault(w, len(number))
        parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        lo = hi
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), list(number)


def joined(words: np.ndarray, distinct: list[bytes], separator: bytes = b" ") -> Iterator[bytes]:
    """The text of numbered words, a slice at a time."""
    for lo in range(0, len(words), SLICE):
        yield (separator if lo else b"") + separator.join(map(distinct.__getitem__, words[lo:lo + SLICE].tolist()))


# ------------------------------------------------------------ Lyndon arrays

def lyndon_array(symbols: list[int]) -> array:
    """Length of the longest Lyndon word from every place, by the first phase of Baier's suffix sorter.

    ``symbols`` are the numbers 0..m-1, each of which occurs; the end of the text is smaller than all."""
    n = len(symbols)
    group = array("i", symbols)                # of every suffix
    members: list[list[int]] = [[] for _ in range(max(symbols, default=-1) + 1)]
    for i, symbol in enumerate(symbols):
        members[symbol].append(i)
    context = [1] * len(members)               # length of the prefix that a group's suffixes share
    below = list(range(-1, len(members) - 1))  # the groups in their order, linked both ways
    above = [*range(1, len(members)), -1]
    length = array("i", bytes(4 * n))          # 0 while a suffix is unfinished
    left = array("i", range(-1, n - 1))        # towards the nearest unfinished suffix before
    top = len(members) - 1
    while top >= 0:
        g, shared, top = top, context[top], below[top]
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        if top >= 0:
            above[top] = -1
        for i in own:
            length[i] = shared
        moved: dict[int, int] = {}
        for i in own:
            p = left[i]
            while p >= 0 and length[p]:
                p = left[p]
            at = i
            while at >= 0 and left[at] != p and length[at]:  # later questions go this way in one step
                left[at], at = p, left[at]
            if p >= 0:
                moved[p] = moved.get(p, 0) + 1
        # suffixes of one group stay together as far as they precede equally many members;
        # the more copies of a greater word follow, the greater the suffix
        parts: dict[tuple[int, int], list[int]] = {}
        for p, times in moved.items():
            parts.setdefault((group[p], times), []).append(p)
        base = under = -1
        for old, times in sorted(parts):
            if old != base:
                base = under = old
            fresh, over = len(members), above[under]
            members.append(parts[old, times])
            context.append(context[old] + times * shared)
            below.append(under)
            above.append(over)
            above[under] = fresh
            if over >= 0:
                below[over] = fresh
            else:
                top = fresh
            for p in members[fresh]:
                group[p] = fresh
            under = fresh
    return length


# --------------------------------------------------------- runs of a text

def stretches(words: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Bounds of the stretches that hold every run whole: all of whose words occur ``exponent`` times in them."""
    at, stretch = np.arange(len(words)), np.zeros(len(words), np.int64)
    for _ in range(ROUNDS):
        if not len(at):
            break
        if stretch[-1]:
            _, key, times = np.unique(stretch * (int(words.max()) + 1) + words[at], return_inverse=True, return_counts=True)
            often = times[key] >= exponent
        else:
            often = np.bincount(words[at])[words[at]] >= exponent
        left = at[often]
        number = np.concatenate([[0], np.cumsum(np.diff(left) != 1)]) if len(left) else left
        long = np.bincount(number)[number] >= shortest if len(left) else np.zeros(0, bool)
        same, at, stretch = len(left) == len(at) and bool(long.all()), left[long], number[long]
        if same:
            break
        stretch = np.concatenate([[0], np.cumsum(np.diff(at) != 1)]) if len(at) else at
    if not len(at):
        return []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]])
    return [(int(at[lo]), int(at[hi - 1]) + 1) for lo, hi in zip(cut[:-1], cut[1:])]


def common_extension(words: np.ndarray, a: int, b: int) -> int:
    """How many words from ``a`` on equal those from ``b`` on (a < b)."""
    done, block = 0, 8
    while b + done < len(words):
        block = min(block, len(words) - b - done)
        same = words[a + done:a + done + block] == words[b + done:b + done + block]
        if not same.all():
            return done + int(np.argmin(same))
        done, block = done + block, min(2 * block, 1 << 16)
    return done


def stretch_runs(words: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> set[tuple[int, int, int]]:
    """(start, length, period) of every run of one stretch of word numbers."""
    _, symbols = np.unique(words, return_inverse=True)
    backwards = words[::-1]
    n, found = len(words), set()
    for order in (symbols, symbols.max() - symbols):
        period = np.frombuffer(lyndon_array(order.tolist()), np.int32).astype(np.int64)
        again = np.arange(n) + period
        roots = np.flatnonzero(again < n)
        to = again[roots]
        roots = roots[((period[to] == period[roots]) | (exponent < 3)) & (words[to] == words[roots])]
        known: dict[int, int] = {}  # end of the last run of a period
        for i, p in zip(roots.tolist(), period[roots].tolist()):
            if known.get(p, -1) >= i + 2 * p:
                continue
            start = i - common_extension(backwards, n - i - p, n - i)
            end = i + p + common_extension(words, i, i + p)
            if end - start >= 2 * p:
                known[p] = end
            if end - start >= max(shortest, exponent * p):
                found.add((start, end - start, p))
    return found


def text_runs(words: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text of word numbers, by start, then period."""
    return sorted(((lo + start, length, p) for lo, hi in stretches(words, exponent, shortest)
                   for start, length, p in stretch_runs(words[lo:hi], exponent, shortest)), key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay where every run is cut down to its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, p in runs:
        change[start + p] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exponent, compared as fractions; ties: smallest start, then period."""
    best = None
    for run in runs:  # by start, then period: only a greater exponent replaces
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


# ------------------------------------------------------------------ on Spark

RUNS_SCHEMA = ("doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
               "strongest struct<start: long, length: long, period: long>, runs_sha256 string, collapsed_sha256 string")


def planted(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """The query's edit: in every tenth text the words from a place on repeat with a period."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, shortest: int = SHORTEST, edit=None, texts: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), the strongest run, digests of the runs and of the text with
    every run cut down to its first period, and with ``texts`` that text as ``collapsed``; a row per row of ``docs``.

    ``edit`` (doc_id, word numbers) may change a text's words before they are searched."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                        ("strongest", pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])),
                        ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), *([("collapsed", pa.string())] if texts else [])])
    names = ("start", "length", "period")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, offsets = C.strings(batch.column(1))
            out = []
            for doc_id, lo, hi in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                words, distinct = word_numbers(text[lo:hi].tobytes())
                words = words if edit is None else edit(doc_id, words)
                runs = text_runs(words, exponent, shortest)
                digest, listed, kept = hashlib.sha256(), hashlib.sha256(), []
                for part in joined(words[kept_words(len(words), runs)] if runs else words, distinct):
                    digest.update(part)
                    if texts:
                        kept.append(part)
                for start, length, p in runs:
                    listed.update(f"{start},{length},{p}\n".encode())
                best = strongest(runs)
                row = {"doc_id": doc_id, "n_words": len(words), "runs": [dict(zip(names, r)) for r in runs],
                       "strongest": best and dict(zip(names, best)), "runs_sha256": listed.hexdigest(), "collapsed_sha256": digest.hexdigest()}
                out.append(row | ({"collapsed": b"".join(kept).decode()} if texts else {}))
            yield pa.RecordBatch.from_pylist(out, schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(rows, RUNS_SCHEMA + (", collapsed string" if texts else ""))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all ``documents``, every tenth of them edited to repeat itself."""
    C.prepare(spark)
    best = lambda c: F.col(f"strongest.{c}")
    out = periodic_runs(C.table(spark, sf_dir, "documents"), edit=planted)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best("start").alias("start"), best("length").alias("length"),
                      best("period").alias("period"), F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")
