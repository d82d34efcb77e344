"""The best k rows of a large table for every row of a query table.

The query table may be small or of the corpus' own size; neither it nor its
probes are ever collected by the driver program.  Two routes, chosen by the
measured size of the queries with their results:

* **In place** (they fit ``broadcast_bytes``): Spark broadcasts the packed
  queries and joins them to the first row of every partition of the corpus scan,
  so each task meets all queries once and the corpus is neither shuffled nor
  joined row by row.
* **Grid** (beyond): queries and corpus rows are exchanged into cells
  (list, query slice, corpus slice).  A list of the index (or the whole corpus,
  for exact search) is cut into as many slices of either side as its counts call for,
  so a hot list becomes many cells.  In a cell the queries come first and stay in
  memory, within a slice's bound; the corpus rows stream past them.

Both keep the best k per query in a task and merge those of the tasks by query,
in two levels where there are many tasks.  No (query, row) pair becomes a row.

Rows without a vector are no hits and no queries; repeated queries and repeated rows count each,
so a query id that stands for several vectors gets the best k over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiver.functions.vector import ascending, normalize_metric
from quiver.operators.block import DEFAULT_BROADCAST_BYTES, _sort_key, arrow_vectors, id_array, topk_exact
from quiver.session import ship_package

#: Queries scored together, and corpus rows gathered before scoring.
QUERY_SLAB = 256
ROW_SLAB = 1 << 14
#: Corpus rows of one cell of the grid.
CELL_ROWS = 1 << 18
#: Candidate rows per query from which the merge takes two levels.
FLAT_PARTS = 64


class Best:
    """The best k (score, id) of each of ``m`` queries so far, with a pointer to the row each came from."""

    def __init__(self, m: int, k: int, asc: bool):
        self.k, self.asc = k, asc
        self.raw = np.full((m, k), np.nan)
        self.ids = np.zeros((m, k), np.int64)
        self.row = np.full((m, k), -1, np.int64)  # -1: no hit yet

    def add(self, queries: np.ndarray, raw: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        """Offer each of ``queries`` its own candidates (row -1: none)."""
        if self.ids.dtype.kind != ids.dtype.kind or self.ids.dtype.itemsize < ids.dtype.itemsize:
            self.ids = self.ids.astype(ids.dtype)
        raw, ids, row = (np.concatenate([a[queries], b], axis=1) for a, b in ((self.raw, raw), (self.ids, ids), (self.row, row)))
        order = np.lexsort((ids, _sort_key(raw, self.asc), row < 0), axis=1)[:, :self.k]
        self.raw[queries], self.ids[queries], self.row[queries] = (np.take_along_axis(a, order, 1) for a in (raw, ids, row))


class Search:
    """Queries held by a task, and the corpus rows that it shows them."""

    def __init__(self, query_ids: np.ndarray, vectors: np.ndarray, k: int, metric: str, extra: tuple[str, ...]):
        self.query_ids, self.vectors, self.metric, self.extra = query_ids, vectors, metric, extra
        self.best = Best(len(query_ids), k, ascending(metric))
        self.held: list[pa.RecordBatch] = []   # extra columns of rows that are or were among the best
        self.rows = 0

    def show(self, ids: np.ndarray, vectors: np.ndarray, batch: pa.RecordBatch | None, at: np.ndarray, queries: np.ndarray) -> None:
        """Score rows (``at``: their places in ``batch``) against ``queries``."""
        for lo in range(0, len(queries), QUERY_SLAB):
            part = queries[lo:lo + QUERY_SLAB]
            place, raw = topk_exact(self.vectors[part], vectors, ids, self.metric, self.best.k)
            hit = place >= 0
            row = np.where(hit, 0, -1)
            if self.extra:
                used, to = np.unique(place[hit], return_inverse=True)
                self.held.append(batch.select(list(self.extra)).take(pa.array(at[used])))
                row[hit] = self.rows + to
                self.rows += len(used)
            self.best.add(part, raw, ids[np.maximum(place, 0)], row)
        if self.rows > max(1 << 16, 4 * self.best.row.size):
            self._forget()

    def _forget(self) -> None:
        kept = self.best.row >= 0
        used, to = np.unique(self.best.row[kept], return_inverse=True)
        self.held = pa.Table.from_batches(self.held).take(pa.array(used)).combine_chunks().to_batches()
        self.best.row[kept] = to
        self.rows = len(used)

    def result(self, id_type: str, query_type: str) -> pa.RecordBatch | None:
        found = self.best.row >= 0
        if not found.any():
            return None
        query = np.repeat(np.arange(len(found)), found.sum(axis=1))
        columns = [pa.array(self.query_ids[query].tolist(), _arrow_type(query_type)), pa.array(self.best.ids[found].tolist(), _arrow_type(id_type)),
                   pa.array(self.best.raw[found])]
        if self.extra:
            table = pa.Table.from_batches(self.held).take(pa.array(self.best.row[found])).combine_chunks()
            columns += [table.column(c).chunk(0) for c in self.extra]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "_id", "raw", *self.extra])


def slabs(batches: Iterator[pa.RecordBatch], rows: int = ROW_SLAB) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield _together(held)
            held, n = [], 0
    if held:
        yield _together(held)


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of equal values."""
    if not len(values):
        return []
    cut = np.flatnonzero((values[1:] != values[:-1]).reshape(len(values) - 1, -1).any(axis=1)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(values)]))


def _arrow_type(kind: str) -> pa.DataType:
    return pa.string() if kind == "string" else pa.int64()


# ------------------------------------------------------------------ in place

def _packed(queries: DataFrame) -> DataFrame:
    """(head, queries): the query rows as Arrow streams, a few per partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([True]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["head", "queries"])

    return queries.mapInArrow(pack, "head boolean, queries binary")


def _after_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table | pa.RecordBatch]:
    """First the table of all queries, then the partition's rows.

    The first row of a partition comes once for every block of queries, before all others."""
    batches, blocks, rows = iter(batches), [], []
    for batch in batches:
        block, batch = batch.column("queries"), batch.drop_columns(["queries"])
        head = np.flatnonzero(block.is_valid().to_numpy(zero_copy_only=False))
        keep = np.ones(batch.num_rows, bool)
        keep[head] = False
        if len(head) and not blocks:
            keep[head[0]] = True
        blocks += [pa.ipc.open_stream(block[i].as_buffer()).read_all() for i in head.tolist()]
        rows.append(batch.filter(pa.array(keep)))
        if blocks and len(head) < len(keep):
            break
    if not blocks:
        return
    table = pa.concat_tables(blocks).combine_chunks()
    del blocks, block  # the queries are held once
    yield table
    del table
    yield from slabs(chain(rows, (batch.drop_columns(["queries"]) for batch in batches)))


def _in_place(scan: DataFrame, queries: DataFrame, k: int, metric: str, types: tuple[str, str], schema: str) -> DataFrame:
    probed, extra = "_list" in scan.columns, tuple(c for c in scan.columns if c.startswith("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _after_heads(batches)
        table = next(parts, None)
        if table is None:
            return
        search = Search(id_array(table.column("query_id")), arrow_vectors(table.column("qv")), k, metric, extra)
        by_list, everyone = {}, np.arange(len(search.query_ids))
        if probed:
            lists = table.column("probes").combine_chunks()
            query = np.repeat(everyone, np.diff(lists.offsets.to_numpy()))
            probe = lists.flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(probe, kind="stable")
            by_list = {int(probe[order[lo]]): query[order[lo:hi]] for lo, hi in _runs(probe[order])}
        for batch in parts:
            if not batch.num_rows:
                continue
            ids, vectors = id_array(batch.column("_id")), arrow_vectors(batch.column("_v"), search.vectors.shape[1])
            if not probed:
                search.show(ids, vectors, batch, np.arange(len(ids)), everyone)
                continue
            lists = batch.column("_list").to_numpy(zero_copy_only=False)
            order = np.argsort(lists, kind="stable")
            for lo, hi in _runs(lists[order]):
                at = order[lo:hi]
                asking = by_list.get(int(lists[at[0]]))
                if asking is not None:
                    search.show(ids[at], vectors[at], batch, at, asking)
        out = search.result(*types)
        if out is not None:
            yield out

    # the lower 33 bits of these ids number the rows of a partition
    head = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    met = scan.withColumn("head", head).join(F.broadcast(_packed(queries)), "head", "left")
    return met.select(*scan.columns, "queries").mapInArrow(run, schema)


# ---------------------------------------------------------------------- grid

CELL = ("_list", "_q", "_c")


def _grid(scan: DataFrame, asked: DataFrame, cells: DataFrame, n_cells: int, k: int, metric: str, types: tuple[str, str], schema: str) -> DataFrame:
    """``cells`` tells for every list into how many slices its queries (qs) and its rows (cs) are cut."""
    extra = [c for c in scan.columns if c.startswith("_x")]
    kinds = {f.name: f.dataType for f in scan.schema.fields}
    no_row = [F.lit(None).cast(kinds[c]).alias(c) for c in ("_id", *extra)]
    asking = asked.join(cells, "_list").select(
        "_list", F.pmod(F.xxhash64("query_id", "qv"), "qs").cast("int").alias("_q"), F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("_c"),
        F.lit(False).alias("_row"), "query_id", F.col("qv").alias("_v"), *no_row)
    shown = scan.join(cells, "_list").select(
        "_list", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("_q"), F.pmod(F.xxhash64("_id", "_v"), "cs").cast("int").alias("_c"),
        F.lit(True).alias("_row"), F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), F.col("_v").cast("array<double>").alias("_v"), "_id", *extra)
    rows = asking.unionByName(shown).repartition(n_cells, *CELL).sortWithinPartitions(*CELL, "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries, search = None, [], None
        for batch in slabs(batches):
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*CELL, "_row")], axis=1)
            for lo, hi in _runs(keys):
                part, key = batch.slice(lo, hi - lo), tuple(keys[lo, :3].tolist())
                if key != now:
                    if search is not None and (out := search.result(*types)) is not None:
                        yield out
                    now, queries, search = key, [], None
                if not keys[lo, 3]:
                    queries.append((id_array(part.column("query_id")), arrow_vectors(part.column("_v"))))
                    continue
                if search is None and queries:
                    search = Search(np.concatenate([i for i, _ in queries]), np.concatenate([v for _, v in queries]), k, metric, tuple(extra))
                    queries = []
                if search is not None:
                    search.show(id_array(part.column("_id")), arrow_vectors(part.column("_v"), search.vectors.shape[1]), part,
                                np.arange(hi - lo), np.arange(len(search.query_ids)))
        if search is not None and (out := search.result(*types)) is not None:
            yield out

    return rows.mapInArrow(run, schema)


# ------------------------------------------------------------------ the search

def id_kind(df: DataFrame, col: str) -> str:
    """``string`` for text ids, else ``long``."""
    return "string" if df.schema[col].dataType.simpleString() == "string" else "long"


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of a result."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def merged(candidates: DataFrame, k: int, metric: str, levels: int) -> DataFrame:
    """The best k candidates of every query with their rank; with two levels first in parts of a query's candidates."""
    order = [F.col("raw").asc_nulls_last() if ascending(metric) else F.col("raw").desc_nulls_first(), F.col("_id").asc()]
    keys = [["query_id"]]
    if levels > 1:
        candidates = candidates.withColumn("_part", F.pmod(F.xxhash64("_id", "raw"), F.lit(FLAT_PARTS)))
        keys.insert(0, ["query_id", "_part"])
    for key in keys:
        candidates = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
    return candidates


def block_topk(corpus: DataFrame, queries: DataFrame, k: int, metric: str, id_col: str = "vec_id", vec_col: str = "embedding",
               query_id_col: str = "query_id", query_vec_col: str | None = None, probes_col: str | None = None, list_col: str = "cluster_id",
               broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, keep_cols: list[str] | None = None, cell_rows: int = CELL_ROWS, query_size: tuple[int, int] | None = None) -> DataFrame:
    """Exact top-k rows of ``corpus`` for every row of ``queries``: ``(query_id, <id_col>, raw, rank, *keep_cols)``.

    Ids may be integers or text; kept columns are those of the very row that was hit.  With ``probes_col``,
    an array of list ids beside each query, only corpus rows whose ``list_col`` is among them are scored for
    that query (IVF search).  ``broadcast_bytes`` bounds the queries and results that a task holds: beyond it
    queries are exchanged with the corpus in cells.  ``query_size`` (queries, dimension) saves a
    job where it is known."""
    metric = normalize_metric(metric)
    spark: SparkSession = corpus.sparkSession
    ship_package(spark)
    extra = list(keep_cols or [])
    clash = {"query_id", "raw", "rank", id_col} & set(extra)
    if clash:
        raise ValueError(f"kept columns would stand twice in the result: {sorted(clash)}")
    types = id_kind(corpus, id_col), id_kind(queries, query_id_col)
    fields = "".join(f", _x{i} {corpus.schema[c].dataType.simpleString()}" for i, c in enumerate(extra))
    schema = f"query_id {types[1]}, _id {types[0]}, raw double{fields}"
    names = [F.col("query_id"), F.col("_id").alias(id_col), F.col("raw"), F.col("rank"), *[F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)]]
    q = queries.select(F.col(query_id_col).cast(types[1]).alias("query_id"), F.col(query_vec_col or vec_col).cast("array<double>").alias("qv"),
                       *([F.col(probes_col).cast("array<long>").alias("probes")] if probes_col else [])).where("qv is not null")
    if query_size is None:
        query_size = tuple(q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("qv")), F.lit(0))).first())
    n_queries, dim = query_size
    if k <= 0 or not n_queries:
        return spark.createDataFrame([], f"{schema}, rank int").select(*names)
    scan = corpus.select(F.col(id_col).cast(types[0]).alias("_id"), F.col(vec_col).alias("_v"), *([F.col(list_col).cast("long").alias("_list")] if probes_col else []),
                         *[F.col(c).alias(f"_x{i}") for i, c in enumerate(extra)]).where("_v is not null")
    # a query's vector, its results twice while they are merged, and its probes
    per_query = 8 * dim + 64 * k + (128 if probes_col else 0)
    if n_queries * per_query <= broadcast_bytes:
        found = _in_place(scan, q, k, metric, types, schema)
        levels = 2 if plan_bytes(scan) > FLAT_PARTS << 27 else 1
    else:
        asked = q.select("query_id", "qv", (F.explode("probes") if probes_col else F.lit(0).cast("long")).alias("_list"))
        scan = scan if probes_col else scan.withColumn("_list", F.lit(0).cast("long"))
        slices = lambda rows, per, name: rows.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / F.lit(per)).cast("int").alias(name))
        cells = slices(asked, max(1, broadcast_bytes // per_query), "qs").join(slices(scan, cell_rows, "cs"), "_list")
        total = cells.agg(F.count(F.lit(1)).alias("lists"), F.sum(F.col("qs").cast("long") * F.col("cs")).alias("cells")).first()
        n_cells = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total["cells"] or 1), 1 << 16)
        cells = F.broadcast(cells) if total["lists"] * 64 <= broadcast_bytes else cells
        found, levels = _grid(scan, asked, cells, n_cells, k, metric, types, schema), 2
    return merged(found, k, metric, levels).select(*names)
