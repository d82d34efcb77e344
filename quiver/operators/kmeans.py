"""k-means coarse quantiser training: C1-C7.

Each Lloyd round is one Spark job: tasks assign their rows to the broadcast
centroids (L2, ties to the lowest id), keep per-cluster partial sums in
numpy, and emit at most nlist rows each, reduced in the shuffle where there are
many tasks.  Only nlist x d tables reach the driver, so the plan never
grows across rounds and no vector is shuffled.  Training skips the vectors that
the triangle inequality holds in place (``Bounds``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.session import scratch_path, ship_package
from quiver.operators.block import (
    DEFAULT_BROADCAST_BYTES,
    arrow_vectors,
    check_block_size,
    collect_block,
    nearest_centers,
    topk_exact,
)
from quiver.operators.topk import plan_bytes

# Trainer defaults (iterations, relative-change threshold, seed, norm epsilon).
MAX_ITERATIONS = 100
CONVERGENCE_THRESHOLD = 0.001
SEED = 42
NORM_EPSILON = 1e-8
#: Least bytes of files that one task of a scan is taken to read, for the estimate of tasks.
SCAN_BYTES = 16 << 20


def centroid_frame(spark: SparkSession, ids, mat: np.ndarray) -> DataFrame:
    """A (cluster_id, centroid) table from driver-side arrays (nlist x d, bounded)."""
    rows = [(int(i), [float(v) for v in row]) for i, row in zip(ids, np.asarray(mat, dtype=np.float64))]
    return spark.createDataFrame(rows, "cluster_id long, centroid array<double>")


def seeded_order(seed: int, *parts) -> F.Column:
    """Deterministic, partition-independent pseudo-random order key."""
    pieces = [F.lit(str(seed))]
    for p in parts:
        pieces += [F.lit(":"), p.cast("string") if isinstance(p, F.Column) else F.lit(str(p))]
    return F.md5(F.concat(*pieces))


def kmeans_init(df: DataFrame, nlist: int, seed: int = SEED, id_col: str = "vec_id",
                vec_col: str = "embedding") -> DataFrame:
    """Nlist distinct rows as initial centroids: ``(cluster_id, <id_col>, centroid)``."""
    top = (df.select(id_col, vec_col)
           .orderBy(seeded_order(seed, F.col(id_col)), F.col(id_col))
           .limit(nlist))
    from pyspark.sql import Window

    w = Window.orderBy(seeded_order(seed, F.col(id_col)), F.col(id_col))
    return top.select((F.row_number().over(w) - 1).cast("long").alias("cluster_id"), F.col(id_col),
                      F.col(vec_col).cast("array<double>").alias("centroid"))


def assign_clusters(df: DataFrame, centroids: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    keep_cols: list[str] | None = None) -> DataFrame:
    """Nearest centroid by L2 whatever the index metric: ``(id, cluster_id, distance)``."""
    out = nearest_centers(df, centroids, 1, "l2", id_col=id_col, vec_col=vec_col, keep_cols=keep_cols)
    return out.select(id_col, "cluster_id", F.col("raw").alias("distance"), *(keep_cols or []))


def _lloyd_partials(bc, bprev, nlist_ids, vec_col):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, mat = bc.value
        prev = bprev.value if bprev is not None else None
        m, d = mat.shape
        sums = np.zeros((m, d))
        counts = np.zeros(m, dtype=np.int64)
        changed = False
        seen = False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            seen = True
            x = arrow_vectors(batch.column(vec_col), d)
            near = topk_exact(x, mat, cids, "l2", 1)[0][:, 0]           # ties -> lowest id
            if prev is None:
                before = np.zeros(len(near), dtype=np.int64)   # fresh assignment array is all zeros
            elif not changed:
                before = topk_exact(x, prev, cids, "l2", 1)[0][:, 0]
            else:
                before = near
            changed = changed or bool((near != before).any())
            counts += np.bincount(near, minlength=m)
            order = np.argsort(near, kind="stable")
            sn = near[order]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(sn)) + 1])
            sums[sn[starts]] += np.add.reduceat(x[order], starts, axis=0)
        if not seen:
            return
        nz = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cids[nz], pa.int64()), pa.array(counts[nz], pa.int64()),
             pa.array([r for r in sums[nz]], pa.list_(pa.float64())), pa.array([changed] * len(nz), pa.bool_())],
            names=["cluster_id", "n", "s", "changed"],
        )

    return run


def lloyd_partials(data: DataFrame, cids: np.ndarray, mat: np.ndarray, prev: np.ndarray | None = None,
                   vec_col: str = "embedding", broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """C2 + C3 from driver-side centroids: ``(cluster_id, n, centroid, changed)`` for non-empty clusters.

    ``changed`` is true when any row's nearest centroid differs from its
    nearest under ``prev`` (or from the first cluster without ``prev``).
    Tables beyond the broadcast budget are assigned block by block.
    """
    spark = data.sparkSession
    ship_package(spark)
    if check_block_size(len(cids), mat.shape[1], broadcast_bytes) > 1:
        return _lloyd_blocked(data, cids, mat, prev, vec_col, broadcast_bytes)
    bc = spark.sparkContext.broadcast((np.asarray(cids), np.asarray(mat)))
    bprev = spark.sparkContext.broadcast(np.asarray(prev)) if prev is not None else None
    parts = data.select(vec_col).where(F.col(vec_col).isNotNull()).mapInArrow(
        _lloyd_partials(bc, bprev, cids, vec_col), "cluster_id long, n long, s array<double>, changed boolean")
    return _means(parts.groupBy("cluster_id").agg(
        F.sum("n").alias("n"), Summarizer.sum(array_to_vector("s")).alias("s"), F.max("changed").alias("changed")))


def _means(sums: DataFrame) -> DataFrame:
    return sums.select(
        "cluster_id", "n",
        F.transform(vector_to_array("s"), lambda v: v / F.col("n")).alias("centroid"),
        "changed",
    )


def _lloyd_blocked(data: DataFrame, cids: np.ndarray, mat: np.ndarray, prev: np.ndarray | None, vec_col: str,
                   broadcast_bytes: int) -> DataFrame:
    spark = data.sparkSession

    def nearest(rows: DataFrame, centers: np.ndarray, id_col: str) -> DataFrame:
        return nearest_centers(rows, centroid_frame(spark, cids, centers), 1, "l2", id_col=id_col, vec_col=vec_col,
                               keep_cols=[vec_col], broadcast_bytes=broadcast_bytes)

    rows = data.select(F.lit(0).cast("long").alias("_now"), F.col(vec_col).cast("array<double>").alias(vec_col))
    near = nearest(rows, mat, "_now").select(F.col("cluster_id").alias("_now"), vec_col)
    if prev is None:
        near = near.withColumn("changed", F.col("_now") != F.lit(int(cids[0])))
    else:
        near = nearest(near, prev, "_now").withColumn("changed", F.col("cluster_id") != F.col("_now"))
    return _means(near.groupBy(F.col("_now").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.sum(array_to_vector(vec_col)).alias("s"), F.max("changed").alias("changed")))


def lloyd_step(data: DataFrame, centroids: DataFrame, vec_col: str = "embedding",
               previous: DataFrame | None = None,
               broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """C2 + C3 from a centroid table (collected after a size check)."""
    cids, mat = collect_block(centroids, "cluster_id", "centroid")
    prev = collect_block(previous, "cluster_id", "centroid")[1] if previous is not None else None
    return lloyd_partials(data, cids, mat, prev, vec_col, broadcast_bytes)


def reseed_empty(data: DataFrame, empty_ids: list[int], seed: int, iteration: int, id_col: str = "vec_id",
                 vec_col: str = "embedding") -> DataFrame:
    """C4: empty clusters take distinct rows in seeded order: ``(cluster_id, <id_col>, centroid)``."""
    if not empty_ids:
        return data.sparkSession.createDataFrame([], f"cluster_id long, {id_col} long, centroid array<double>")
    from pyspark.sql import Window

    key = seeded_order(seed, iteration, F.col(id_col))
    top = data.select(id_col, vec_col).orderBy(key, F.col(id_col)).limit(len(empty_ids))
    w = Window.orderBy(seeded_order(seed, iteration, F.col(id_col)), F.col(id_col))
    ranked = top.select(F.row_number().over(w).alias("r"), id_col, F.col(vec_col).cast("array<double>").alias("centroid"))
    slots = data.sparkSession.createDataFrame([(i + 1, int(c)) for i, c in enumerate(sorted(empty_ids))],
                                              "r int, cluster_id long")
    return F.broadcast(slots).join(ranked, "r").select("cluster_id", id_col, "centroid")


def relative_change(old: np.ndarray, new: np.ndarray) -> float:
    """sum_i |old_i - new_i| / (sum_i |new_i| + eps)."""
    change = float(np.sqrt(((old - new) ** 2).sum(axis=1)).sum())
    norm = float(np.sqrt((new ** 2).sum(axis=1)).sum())
    return change / (norm + NORM_EPSILON)


def relative_change_frame(old: DataFrame, new: DataFrame) -> DataFrame:
    """C5 as a job: ``(total_change, total_norm, relative_change, converged)``."""
    from quiver.functions.vector import dot_product, l2_distance

    j = old.alias("o").join(new.alias("n"), "cluster_id")
    t = j.agg(F.sum(l2_distance("o.centroid", "n.centroid")).alias("total_change"),
              F.sum(F.sqrt(dot_product("n.centroid", "n.centroid"))).alias("total_norm"))
    rel = F.col("total_change") / (F.col("total_norm") + F.lit(NORM_EPSILON))
    return t.select("total_change", "total_norm", rel.alias("relative_change"),
                    (rel < F.lit(CONVERGENCE_THRESHOLD)).alias("converged"))


@dataclass
class TrainResult:
    centroids: DataFrame
    iterations: int
    converged: bool
    vector_count: int


#: Relative rounding error allowed for in distances.
SLACK = 1e-9


def _gap(nearest: np.ndarray) -> np.ndarray:
    """Second smallest less smallest distance, rounded down; without a second the vector never moves."""
    if nearest.shape[1] < 2:
        return np.full(len(nearest), np.inf)
    with np.errstate(invalid="ignore"):
        gap = nearest[:, 1] - nearest[:, 0] - SLACK * (nearest[:, 1] + nearest[:, 0])
    gap[np.isnan(gap)] = -np.inf  # a vector of no distance is always scored
    return gap


class Bounds:
    """Lloyd rounds that only look at vectors which may have moved.

    An *anchor* is a pass over all vectors: each is stored, in the shared scratch
    folder, beside its nearest centroid and the *gap* between its two smallest
    distances, and the sums of the clusters are kept.  In a later round every
    centroid stands some drift away from where it stood then.  By the triangle
    inequality a vector stays where it is while its gap exceeds its own centroid's
    drift and the largest drift of the others together; so a round reads, by a
    pushed-down filter on the gap (files are sorted by it), the vectors below
    that bound, scores those exactly, and corrects the anchor's sums by the few that
    moved.  One job a round tells sums, counts, how many vectors were scored, and how many
    would be if the next round moved the centroids as this one did from a new anchor: when
    the former are over half of all vectors and the latter under a quarter, one is taken."""

    def __init__(self, data: DataFrame, ids: np.ndarray, dim: int, rows: int, vec_col: str, budget: int):
        self.data, self.ids, self.dim, self.rows, self.vec_col, self.budget = data, ids, dim, rows, vec_col, budget
        self.at = self.last = None              # centroids of the anchor, and of the round before
        self.state: DataFrame | None = None
        self.pays = True                        # whether a new anchor does
        ship_package(data.sparkSession)

    def step(self, mat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, sum of vectors) of every cluster under the centroids ``mat``."""
        if self.pays:
            self._anchor(mat)
            out = self.counts, self.sums
        else:
            n, s = self._changes(mat)
            out = self.counts + n, self.sums + s
        self.last = mat
        return out

    def _anchor(self, mat: np.ndarray) -> None:
        ids, dim, vec_col = self.ids, self.dim, self.vec_col
        spark = self.data.sparkSession
        centers = spark.sparkContext.broadcast(mat)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                place, raw = topk_exact(arrow_vectors(batch.column(vec_col), dim), centers.value, ids, "l2", 2)
                yield pa.RecordBatch.from_arrays([batch.column(vec_col), pa.array(place[:, 0]), pa.array(_gap(raw))], names=[vec_col, "near", "gap"])

        path = scratch_path(spark, "kmeans-bounds")
        self.data.select(vec_col).mapInArrow(run, f"`{vec_col}` array<double>, near long, gap double") \
            .sortWithinPartitions("gap").write.parquet(path)
        centers.destroy()
        self.at = mat
        self.state = spark.read.schema(f"`{vec_col}` array<double>, near long, gap double").parquet(path)
        self.tasks = plan_parts(self.state)
        self.counts, self.sums, *_ = self._totals(self.state, mat, None, None)
        self.pays = False

    def _bound(self, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        """For vectors of each cluster the gap up to which they may move."""
        drift = np.sqrt(((new - old) ** 2).sum(axis=1)) * (1 + SLACK)
        order = np.sort(drift)[::-1]
        others = np.where(np.arange(len(drift)) == int(np.argmax(drift)), order[1] if len(order) > 1 else 0.0, order[0])
        return drift + others

    def _changes(self, mat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bound = self._bound(self.at, mat)
        # limits of few distinct values, so that Spark compiles few scans; the tasks test the bound itself
        limit = 2.0 ** (np.ceil(2 * np.log2(bound.max())) / 2) if bound.max() > 0 else 0.0
        may_move = self.state.where(F.col("gap") <= F.lit(float(limit)))
        counts, sums, scored, recent = self._totals(may_move, mat, bound, self._bound(self.last, mat))
        self.pays = scored > self.rows / 2 and recent < self.rows / 4
        return counts, sums

    def _totals(self, state: DataFrame, mat: np.ndarray, bound: np.ndarray | None, recent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Counts and sums per cluster over ``state`` - without ``bound`` of all its vectors as they are assigned,
        else of the changes against that -, the number of vectors scored, and of those within the bound ``recent``."""
        ids, dim, vec_col, m = self.ids, self.dim, self.vec_col, len(self.ids)
        known = state.sparkSession.sparkContext.broadcast((mat, bound, recent))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mat, bound, recent = known.value
            counts, sums, scored, under = np.zeros(m, np.int64), np.zeros((m, dim)), 0, 0

            def add(cluster: np.ndarray, x: np.ndarray, sign: int) -> None:
                if not len(cluster):
                    return
                order = np.argsort(cluster, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(cluster[order]) != 0]))
                counts[:] += sign * np.bincount(cluster, minlength=m)
                sums[cluster[order[first]]] += sign * np.add.reduceat(x[order], first, axis=0)

            for batch in batches:
                if not batch.num_rows:
                    continue
                near, gap = batch.column("near").to_numpy(), batch.column("gap").to_numpy()
                x = arrow_vectors(batch.column(vec_col), dim)
                if bound is None:
                    add(near, x, 1)
                    continue
                may = np.flatnonzero(gap <= bound[near])
                place, raw = topk_exact(x[may], mat, ids, "l2", 2)
                now = place[:, 0]
                scored, under = scored + len(may), under + int((_gap(raw) <= recent[now]).sum())
                moved = now != near[may]
                add(now[moved], x[may[moved]], 1)
                add(near[may[moved]], x[may[moved]], -1)
            some = np.flatnonzero(counts.astype(bool) | sums.any(axis=1))
            if scored or len(some):  # the numbers of vectors stand in rows of their own
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*some, -1, -2], pa.int64()), pa.array([*counts[some], scored, under], pa.int64()),
                     pa.array([*sums[some], np.zeros(dim), np.zeros(dim)], pa.list_(pa.float64()))], names=["place", "n", "s"])

        parts = state.mapInArrow(run, "place long, n long, s array<double>")
        if self.tasks * m * dim * 8 > self.budget:  # too many tasks for their totals to meet in the driver
            parts = parts.groupBy("place").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
        got = parts.toArrow()  # a row per cluster (and task)
        known.destroy()
        counts, sums = np.zeros(m, np.int64), np.zeros((m, dim))
        if not got.num_rows:
            return counts, sums, 0, 0
        place, n = got.column("place").to_numpy(), got.column("n").to_numpy()
        real = place >= 0
        np.add.at(counts, place[real], n[real])
        np.add.at(sums, place[real], arrow_vectors(got.column("s"), dim)[real])
        return counts, sums, int(n[place == -1].sum()), int(n[place == -2].sum())


def plan_parts(df: DataFrame) -> int:
    """Tasks that a scan of Parquet files takes, by Spark's estimate of its size."""
    return len(df.inputFiles()) + plan_bytes(df) // SCAN_BYTES


def _steps(data: DataFrame, ids: np.ndarray, dim: int, rows: int, vec_col: str, budget: int):
    """centroids -> (counts, sums); centroids beyond the broadcast budget are assigned block by block, without bounds."""
    if check_block_size(len(ids), dim, budget) <= 1:
        return Bounds(data, ids, dim, rows, vec_col, budget).step

    def step(mat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = lloyd_partials(data, ids, mat, None, vec_col, budget).toArrow()
        place = np.searchsorted(ids, got.column("cluster_id").to_numpy())
        counts, sums = np.zeros(len(ids), np.int64), np.zeros((len(ids), dim))
        counts[place] = got.column("n").to_numpy()
        sums[place] = arrow_vectors(got.column("centroid"), dim) * counts[place][:, None]
        return counts, sums

    return step


def kmeans_train(df: DataFrame, nlist: int, max_iterations: int = MAX_ITERATIONS,
                 threshold: float = CONVERGENCE_THRESHOLD, seed: int = SEED, id_col: str = "vec_id",
                 vec_col: str = "embedding", broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> TrainResult:
    """Lloyd iterations until no row moves or the relative change < threshold.

    Returns the centroids of the stopping round.  Errors on an empty input or
    fewer rows than nlist.  The training vectors are written to the shared
    scratch folder once, so no executor's loss costs more than its tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "kmeans-train")
    df.select(id_col, F.col(vec_col).cast("array<double>").alias(vec_col)).where(F.col(vec_col).isNotNull()).write.parquet(path)
    data = spark.read.schema(f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{vec_col}` array<double>").parquet(path)
    n = data.count()
    if n == 0:
        raise ValueError("Training vectors cannot be empty")
    if n < nlist:
        raise ValueError("Number of vectors must be >= nlist")
    ids, mat = collect_block(kmeans_init(data, nlist, seed, id_col, vec_col), "cluster_id", "centroid")
    step = _steps(data, ids, mat.shape[1], n, vec_col, broadcast_bytes)
    prev = None
    for it in range(max_iterations):
        counts, sums = step(mat)
        # assignments start at the first cluster; a later round that moves no row
        # leaves the centroids as they are, which the relative change tells -
        # but for empty clusters, which are seeded anew
        moved = it > 0 or counts[0] < n
        empty = ids[counts == 0]
        if len(empty) and prev is not None:
            moved = bool(lloyd_partials(data, ids, mat, prev, vec_col, broadcast_bytes).agg(F.max("changed")).first()[0])
        new = sums / np.maximum(counts, 1)[:, None]
        if len(empty):
            for r in reseed_empty(data, [int(c) for c in empty], seed, it + 1, id_col, vec_col).collect():
                new[np.searchsorted(ids, r["cluster_id"])] = r["centroid"]
        if not moved or relative_change(mat, new) < threshold:
            return TrainResult(centroid_frame(spark, ids, new), it + 1, True, n)
        prev, mat = mat, new
    return TrainResult(centroid_frame(spark, ids, mat), max_iterations, False, n)
