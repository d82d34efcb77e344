"""L1, L4, L6 on a stream of log lines (stateless per line), and L2 with ordered state."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quiver.operators.logs import FIRSTLINE, enrich, json_source, namespace_filter
from quiver.session import ship_package

#: The state store that map states and timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECORDS = "file string, record_start long, lines long, text string"
#: Line numbers of a file that share a state.
STREAM_BUCKET_LINES = 1 << 16


def kube_log_stream(lines: DataFrame, hostname: str, node_name: str) -> DataFrame:
    parsed = json_source(lines).where(F.col("tag").startswith("kubernetes"))
    return enrich(namespace_filter(parsed), hostname, node_name)



class _Lines:
    """Lines in a list state, one Arrow stream per arrival, so that a line costs no call of the state store."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.state = handle.getListState("parts", "part binary")

    def add(self, lines: pd.DataFrame) -> None:
        self.state.appendValue((packed(lines),))

    def read(self, more: list[bytes] = ()) -> pd.DataFrame:
        """All lines (and those of ``more``) by number; of one that came again, the latest."""
        parts = [pa.ipc.open_stream(body).read_all() for body in (*(bytes(row[0]) for row in self.state.get()), *more)]
        lines = pa.concat_tables(parts).to_pandas() if parts else pd.DataFrame({"line_no": [], "raw": [], "ms": []})
        return lines.drop_duplicates("line_no", keep="last").sort_values("line_no", ignore_index=True)

    def keep(self, lines: pd.DataFrame) -> None:
        if len(lines):
            self.state.put([(packed(lines),)])
        else:
            self.state.clear()


def packed(lines: pd.DataFrame) -> bytes:
    """(line_no, raw, ms) rows as an Arrow stream."""
    table = pa.table({"line_no": pa.array(lines["line_no"], pa.int64()), "raw": pa.array(lines["raw"], pa.large_string()), "ms": pa.array(lines["ms"], pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _first_lines(lines: pd.DataFrame) -> list[int]:
    return [i for i, raw in enumerate(lines["raw"].tolist()) if re.match(FIRSTLINE, raw)]


def _records(file: str, lines: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
    """The records between consecutive ``cuts``."""
    raw, start = lines["raw"].tolist(), lines["line_no"].tolist()
    return pd.DataFrame([(file, start[lo], hi - lo, "\n".join(raw[lo:hi])) for lo, hi in zip(cuts[:-1], cuts[1:])],
                        columns=["file", "record_start", "lines", "text"], dtype=object)


class BucketLines(StatefulProcessor):
    """The unsettled lines of one bucket of line numbers of a file, and timers on the watermark.

    Lines of a file carry times that do not go down, but may arrive in any order.  Once the
    watermark has passed a line, every line before it is here.  Records that begin and end among the
    settled lines leave whole; the lines before the bucket's first first-line and those
    from its last one go to the file's ``OpenRecord`` (not ``whole``), as does the time of the latest line seen.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = _Lines(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for part in rows:
            part = part[part["raw"].notna() & part["line_no"].notna()]  # a row without a line only tells the time
            if len(part):
                latest = max(latest or 0, int(part["ms"].max()))
                self.lines.add(part)
        if latest is not None:
            self.handle.registerTimer(latest)
            yield pd.DataFrame([(key[0], None, None, None, False, 0, None, latest)], columns=_SETTLED, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lines = self.lines.read()
        past = (lines["ms"] <= timerValues.getCurrentWatermarkInMs()).to_numpy().nonzero()[0]
        if len(past):
            settled, rest = lines.iloc[:past[-1] + 1], lines.iloc[past[-1] + 1:]
            self.lines.keep(rest)
            firsts = _first_lines(settled) or [len(settled)]
            ends = pd.concat([settled.iloc[:firsts[0]], settled.iloc[firsts[-1]:]])
            yield _records(key[0], settled, firsts).assign(whole=True, bucket=key[1], part=None, seen=None)
            yield pd.DataFrame([(key[0], None, None, None, False, 0, packed(ends), None)], columns=_SETTLED, dtype=object)

    def close(self) -> None:
        pass


SETTLED = RECORDS + ", whole boolean, bucket long, part binary, seen long"
_SETTLED = ["file", "record_start", "lines", "text", "whole", "bucket", "part", "seen"]


class OpenRecord(StatefulProcessor):
    """The record of a file that is still open, put together from the ends of buckets.

    It leaves when a later first line is settled, or when the watermark is ``idle``
    past the latest line of the file.  Whole records pass through."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = _Lines(handle)
        self.seen = handle.getValueState("seen", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, seen = [], []
        for batch in rows:
            if key[1]:
                yield batch[["file", "record_start", "lines", "text"]].astype(object)
                continue
            parts += [bytes(p) for p in batch["part"].dropna()]
            seen += batch["seen"].dropna().astype("int64").tolist()
        if seen:
            last = self.seen.get()
            latest = max([*seen, *(last or ())])
            self.seen.update((latest,))
            self.handle.registerTimer(latest + self.idle_ms)
        if parts:
            lines = self.lines.read(parts)
            cuts = [0, *(i for i in _first_lines(lines) if i)]
            if len(cuts) > 1:
                yield _records(key[0], lines, cuts)
            self.lines.keep(lines.iloc[cuts[-1]:])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.seen.get()
        if last is not None and last[0] + self.idle_ms <= timerValues.getCurrentWatermarkInMs():
            lines = self.lines.read()
            if len(lines):
                yield _records(key[0], lines, [0, len(lines)])
            self.lines.keep(lines.iloc[:0])
            self.seen.clear()

    def close(self) -> None:
        pass


def multiline_stream(lines: DataFrame, file_col: str = "file", time_col: str = "ts", delay: str = "10 minutes", idle_ms: int = 3_600_000,
                     bucket_lines: int = STREAM_BUCKET_LINES) -> DataFrame:
    """L2 on a stream of (file, line_no, raw, time) rows: the records of the batch form, for lines that arrive up to
    ``delay`` late by the files' own time, in any order, with pauses of any length between arrivals.

    A row with a null line or line number is no line, and only moves the time on (a heartbeat).  An open record
    ends when the time is ``idle_ms`` past its last line; lines that come later than ``delay`` are dropped
    by the watermark.  A line that arrives again replaces itself while it is pending.  A file is worked on in buckets of
    ``bucket_lines`` line numbers, so a task holds some buckets' lines and the files' open records, never a file."""
    spark = lines.sparkSession
    ship_package(spark)
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STATE_STORE:
        raise RuntimeError(f"set spark.sql.streaming.stateStore.providerClass to {STATE_STORE}")
    at = F.col(time_col).cast("timestamp")
    rows = lines.select(F.col(file_col).cast("string").alias("file"), F.col("line_no").cast("long").alias("line_no"), F.col("raw").cast("string").alias("raw"),
                        at.alias("ts"), F.unix_millis(at).alias("ms")).where("ts is not null and file is not null")
    bucket = F.coalesce(F.floor(F.col("line_no") / bucket_lines), F.lit(0)).cast("long")
    settled = rows.withColumn("bucket", bucket).withWatermark("ts", delay).groupBy("file", "bucket").transformWithStateInPandas(
        BucketLines(), SETTLED, "Append", "EventTime")
    return settled.groupBy("file", "whole", "bucket").transformWithStateInPandas(OpenRecord(idle_ms), RECORDS, "Append", "EventTime")
