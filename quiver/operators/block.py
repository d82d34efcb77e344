"""Arrow/numpy block scoring inside Spark tasks.

Scores of many (row, column) pairs, with the best ``k`` columns of every row, for
the searches of ``quiver.operators.topk`` and for nearest-centroid assignment.  The
centroid table is shipped to every task as a broadcast variable after its size is
checked; the rows are scanned where they lie, batch by batch.  No (row, column)
pair is ever materialised as a row of a table.

Scores use a left-to-right double sum over dimensions, the same order as the
``aggregate`` expressions in ``quiver.functions.vector`` and as DuckDB's list
functions, so every path yields the same bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.functions.vector import ascending, normalize_metric
from quiver.session import scratch_path, ship_package

# Largest set of queries or centroids shipped to tasks in one broadcast.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def arrow_vectors(col: pa.Array, dim: int | None = None) -> np.ndarray:
    """ARRAY<FLOAT|DOUBLE> Arrow column -> (n, d) float64 matrix (no per-row Python)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if col.null_count:
        raise ValueError("null vector in block scorer input; validate vectors first")
    lengths = np.diff(np.asarray(col.offsets))
    d = int(lengths[0]) if n else (dim or 0)
    if n and (lengths != d).any():
        raise ValueError("Vectors must have the same dimension")
    if dim is not None and n and d != dim:
        raise ValueError(f"Vector dimension mismatch: expected {dim}, got {d}")
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, d)


def score_matrix(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """(n, d) x (m, d) -> (n, m) scores, summed over dimensions in order."""
    n, d = x.shape
    m = q.shape[0]
    if q.shape[1] != d:
        raise ValueError("Vectors must have the same dimension")
    acc = np.zeros((n, m))
    if metric == "l2":
        for j in range(d):
            diff = x[:, j, None] - q[None, :, j]
            acc += diff * diff
        return np.sqrt(acc)
    for j in range(d):
        acc += x[:, j, None] * q[None, :, j]
    if metric == "dot":
        return acc
    nx = np.zeros(n)
    nq = np.zeros(m)
    for j in range(d):
        nx += x[:, j] * x[:, j]
        nq += q[:, j] * q[:, j]
    denom = np.sqrt(nx)[:, None] * np.sqrt(nq)[None, :]
    zero = (nx[:, None] == 0) | (nq[None, :] == 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = acc / denom
    out[zero] = 0.0
    return out


_U = np.finfo(np.float64).eps / 2  # unit roundoff
ROW_CHUNK = 2048
SCREEN_CELLS = 1 << 19             # rows x columns per screening matrix (4 MB of doubles; about eight at a time)
PAIR_VALUES = 1 << 20              # values per side of the candidate pairs gathered at once (8 MB)


def _seq_norms(a: np.ndarray) -> np.ndarray:
    acc = np.zeros(a.shape[0])
    for j in range(a.shape[1]):
        acc += a[:, j] * a[:, j]
    return acc


def _pair_scores(r: np.ndarray, c: np.ndarray, metric: str, rn=None, cn=None) -> np.ndarray:
    """Exact scores of aligned row pairs r[i] . c[i], summed over dimensions in order."""
    acc = np.zeros(r.shape[0])
    if metric == "l2":
        for j in range(r.shape[1]):
            diff = r[:, j] - c[:, j]
            acc += diff * diff
        return np.sqrt(acc)
    for j in range(r.shape[1]):
        acc += r[:, j] * c[:, j]
    if metric == "dot":
        return acc
    denom = np.sqrt(rn) * np.sqrt(cn)
    zero = (rn == 0) | (cn == 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = acc / denom
    out[zero] = 0.0
    return out


def _gathered_scores(x: np.ndarray, cols: np.ndarray, ri: np.ndarray, cj: np.ndarray, metric: str, rn: np.ndarray, cn: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs x[ri] . cols[cj], a bounded number gathered at a time (ties may make every pair a candidate)."""
    step = max(1, PAIR_VALUES // max(1, x.shape[1]))
    if len(ri) <= step:
        return _pair_scores(x[ri], cols[cj], metric, rn[ri], cn[cj])
    return np.concatenate([_pair_scores(x[i], cols[j], metric, rn[i], cn[j])
                           for i, j in ((ri[lo:lo + step], cj[lo:lo + step]) for lo in range(0, len(ri), step))])


def topk_exact(rows: np.ndarray, cols: np.ndarray, col_ids: np.ndarray, metric: str, k: int,
               allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For every row, the k best columns by (exact score, column id).

    A matrix product screens candidates; its rounding error is bounded
    (|fl(x.y) - x.y| <= d u sum|x_i y_i|, padded 4x), so every column that
    could belong to the exact top k stays a candidate.  Only candidates are
    re-scored with the in-order sum, which is what the SQL expressions and
    DuckDB compute.  Returns (column positions, raw scores), shape (r, k'),
    k' = min(k, columns); positions are -1 where a row has fewer allowed columns.
    """
    r, d = rows.shape
    m = cols.shape[0]
    kk = min(k, m)
    out_pos = np.full((r, kk), -1, dtype=np.int64)
    out_raw = np.full((r, kk), np.nan)
    if r == 0 or kk <= 0:
        return out_pos, out_raw
    asc = metric == "l2"
    rn_all, cn = _seq_norms(rows), _seq_norms(cols)
    c_len = np.sqrt(cn)
    step = max(1, min(ROW_CHUNK, SCREEN_CELLS // max(m, 1)))
    for s in range(0, r, step):
        e = min(r, s + step)
        x = rows[s:e]
        rn = rn_all[s:e]
        r_len = np.sqrt(rn)
        dots = x @ cols.T
        if metric == "l2":
            key = rn[:, None] + cn[None, :] - 2.0 * dots            # squared distance
            err = 4.0 * (d + 3) * _U * (r_len[:, None] + c_len[None, :]) ** 2
        elif metric == "dot":
            key = -dots
            err = 4.0 * (d + 2) * _U * (r_len[:, None] * c_len[None, :])
        else:
            with np.errstate(invalid="ignore", divide="ignore"):
                cos = dots / (r_len[:, None] * c_len[None, :])
            cos[(rn[:, None] == 0) | (cn[None, :] == 0)] = 0.0
            key = -cos
            err = np.full(key.shape, 8.0 * (3 * d + 10) * _U)
        if allowed is not None:
            ok = allowed[s:e]
            key = np.where(ok, key, np.inf)
        else:
            ok = None
        finite = np.isfinite(key) | (key == np.inf)
        bad_rows = ~finite.all(axis=1)
        kth = np.partition(key, kk - 1, axis=1)[:, kk - 1]
        emax = np.max(np.where(np.isfinite(key), err, 0.0), axis=1)
        cand = (key - err) <= (kth + emax)[:, None]
        cand &= np.isfinite(key)
        if ok is not None:
            cand &= ok
        cand[bad_rows] = True if ok is None else ok[bad_rows]
        ri, cj = np.nonzero(cand)
        if len(ri) == 0:
            continue
        raw = _gathered_scores(x, cols, ri, cj, metric, rn, cn)
        skey = _sort_key(raw, asc)
        order = np.lexsort((col_ids[cj], skey, ri))
        ri, cj, raw = ri[order], cj[order], raw[order]
        first = np.searchsorted(ri, np.arange(e - s))
        pos_in_row = np.arange(len(ri)) - first[ri]
        keep = pos_in_row < kk
        out_pos[s + ri[keep], pos_in_row[keep]] = cj[keep]
        out_raw[s + ri[keep], pos_in_row[keep]] = raw[keep]
    return out_pos, out_raw


def _sort_key(scores: np.ndarray, asc: bool) -> np.ndarray:
    """Key where smaller is better; NaN is the largest value, as in Spark."""
    key = scores if asc else -scores
    return np.where(np.isnan(scores), np.inf if asc else -np.inf, key)


def best_k(key: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows by (key, id); exact under ties."""
    n = key.shape[0]
    if k <= 0 or n == 0:
        return np.empty(0, dtype=np.int64)
    if n > k:
        kth = np.partition(key, k - 1)[k - 1]
        cand = np.nonzero(key <= kth)[0]
    else:
        cand = np.arange(n)
    order = np.lexsort((ids[cand], key[cand]))
    return cand[order[:k]]


def check_block_size(rows: int, dim: int, budget: int) -> int:
    """Number of broadcast blocks needed for rows x dim doubles."""
    need = max(rows, 1) * max(dim, 1) * 8
    return max(1, math.ceil(need / budget))


def id_array(column) -> np.ndarray:
    """Ids as a sortable numpy array: text ids as fixed-width strings (code point order, as in Spark)."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), dtype=str)
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def collect_block(df: DataFrame, id_col: str, vec_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Collect a size-checked block (ids, matrix) through Arrow."""
    tbl = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).toArrow()
    ids = id_array(tbl.column("id"))
    mat = arrow_vectors(tbl.column("v")) if tbl.num_rows else np.zeros((0, 0))
    order = np.argsort(ids, kind="stable")
    return ids[order], mat[order]


def _nearest_centers_blocked(df, centers, k, metric, id_col, vec_col, center_id_col, center_vec_col,
                             keep_cols, n_centers, per_block):
    """Centers beyond the broadcast budget: best k per block of about ``per_block`` centers
    (each block collected and broadcast in turn, one scan each), then the best k per row
    over all blocks.  Rows get a key of their own in a written copy, so rows that share an
    id stay apart; the shuffle carries keys and scores, and the rows' columns join back once."""
    spark = df.sparkSession
    keep = [c for c in (keep_cols or []) if c != id_col]
    path = scratch_path(spark, "nearest-rows")
    df.select(id_col, vec_col, *(c for c in keep if c != vec_col), F.monotonically_increasing_id().alias("_row")) \
        .where(F.col(vec_col).isNotNull()).write.parquet(path)
    rows = spark.read.parquet(path)
    blocks = math.ceil(1.25 * n_centers / per_block)
    numbered = centers.select(center_id_col, center_vec_col, F.pmod(F.xxhash64(center_id_col), F.lit(blocks)).alias("_blk"))
    parts = None
    for b in range(blocks):
        cids, cmat = collect_block(numbered.where(F.col("_blk") == b), center_id_col, center_vec_col)
        if len(cids) == 0:
            continue
        part = _nearest_arrays(rows, cids, cmat, k, metric, "_row", vec_col, center_id_col, None)
        parts = part if parts is None else parts.unionByName(part)
    order = F.col("raw").asc_nulls_last() if ascending(metric) else F.col("raw").desc_nulls_first()
    w = Window.partitionBy("_row").orderBy(order, F.col(center_id_col).asc())
    best = parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(rows.select("_row", id_col, *keep), "_row").select(id_col, "rank", center_id_col, "raw", *keep)


def nearest_centers(
    df: DataFrame,
    centers: DataFrame,
    k: int,
    metric: str,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    center_id_col: str = "cluster_id",
    center_vec_col: str = "centroid",
    broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
    keep_cols: list[str] | None = None,
) -> DataFrame:
    """For each row, the k best centers: ``(<id_col>, rank, cluster_id, raw)`` + keep_cols.

    A narrow map over ``df`` with the (size-checked) center table broadcast;
    ties go to the lowest center id.  k = 1 is assignment (C2, C7, I2); k =
    nprobe is probing (I4).
    """
    metric = normalize_metric(metric)
    spark = df.sparkSession
    stats = centers.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(center_vec_col)).alias("d")).first()
    n_centers, dim = int(stats["n"]), int(stats["d"] or 0)
    if check_block_size(n_centers, dim, broadcast_bytes) > 1:
        per_block = max(1, broadcast_bytes // (max(dim, 1) * 8))
        return _nearest_centers_blocked(df, centers, k, metric, id_col, vec_col, center_id_col, center_vec_col,
                                        keep_cols, n_centers, per_block)
    cids, cmat = collect_block(centers, center_id_col, center_vec_col)
    return _nearest_arrays(df, cids, cmat, k, metric, id_col, vec_col, center_id_col, keep_cols)


def _nearest_arrays(df, cids, cmat, k, metric, id_col, vec_col, center_id_col, keep_cols):
    spark = df.sparkSession
    ship_package(spark)
    emit = [c for c in (keep_cols or []) if c != id_col]
    keep_cols = [c for c in emit if c != vec_col]
    bc = spark.sparkContext.broadcast((cids, cmat))
    kk = max(0, min(k, len(cids)))
    src = df.select(id_col, vec_col, *keep_cols).where(F.col(vec_col).isNotNull())
    fields = {f.name: f.dataType.simpleString() for f in src.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_c, mat = bc.value
        for batch in batches:
            n = batch.num_rows
            if n == 0 or kk == 0:
                continue
            x = arrow_vectors(batch.column(vec_col), mat.shape[1])
            order, raw = topk_exact(x, mat, ids_c, metric, kk)
            take = np.repeat(np.arange(n), kk)
            arrays = [batch.column(id_col).take(pa.array(take))]
            names = [id_col]
            arrays += [pa.array(np.tile(np.arange(1, kk + 1), n), pa.int32()),
                       pa.array(ids_c[order].reshape(-1), pa.int64()),
                       pa.array(raw.reshape(-1), pa.float64())]
            names += ["rank", center_id_col, "raw"]
            for c in emit:
                arrays.append(batch.column(c).take(pa.array(take)))
                names.append(c)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = ", ".join(
        [f"`{id_col}` {fields[id_col]}", "rank int", f"`{center_id_col}` long", "raw double"]
        + [f"`{c}` {fields[c]}" for c in emit]
    )
    return src.mapInArrow(run, schema)
