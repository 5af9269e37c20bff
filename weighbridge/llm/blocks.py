"""Search of query blocks against data slices: both bounded, solved in numpy, merged by rank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICES = 64  # data slices to aim at
SLICE_ROWS = (8_192, 65_536)  # least and most rows of a slice: 64 dimensions take 4 to 32 MB
CELLS = 4_000_000  # scores computed at once (32 MB)


def usable(vector: str) -> Column:
    """Neither null nor holding a null or non-finite component."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def one_per_id(df: DataFrame, key: str, vector: Column) -> DataFrame:
    """``vec_id, vec``: one row per id; of several vectors under one id the greatest counts."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("vec_id")).agg(F.max(vector).alias("vec"))


def slices(rows: int) -> int:
    """Number of slices for so many rows."""
    each = min(max(-(-rows // SLICES), SLICE_ROWS[0]), SLICE_ROWS[1])
    return max(1, -(-rows // each))


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """List column as a double matrix; short vectors are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, at] = flat
    return out


def by_id_without_copies(ids: np.ndarray, data: np.ndarray, k: int) -> np.ndarray:
    """Rows in order of id; of equal vectors only the k + 1 smallest ids, since ties go to
    smaller ids and one of them may be the query itself. No result is lost."""
    order = np.argsort(ids, kind="stable")
    _, same = np.unique(np.ascontiguousarray(data[order]).view(f"V{data.shape[1] * 8}").ravel() if data.shape[1] else np.zeros(len(ids)), return_inverse=True)
    grouped = np.argsort(same, kind="stable")
    first = np.r_[True, np.diff(same[grouped]) != 0]
    place = np.arange(len(grouped)) - np.maximum.accumulate(np.where(first, np.arange(len(grouped)), 0))
    keep = np.sort(grouped[place <= k])
    return order[keep]


def best_rows(nearness: np.ndarray, k: int, slack: float = 0.0, lowest=-np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all entries at least as high as the k-th of their query, less a
    slack; ``lowest`` marks what can't be a result."""
    n = nearness.shape[1]
    if n > k:
        bound = np.partition(nearness, n - k, axis=1)[:, n - k]
        bound = bound - slack if slack else bound
        mask = (nearness >= bound[:, None]) & (nearness > lowest)
    else:
        mask = nearness > lowest
    return np.nonzero(mask)


def cut(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int, largest: bool) -> np.ndarray:
    """Indices of the k best per query, ties to smaller ids."""
    order = np.lexsort((vec, -score if largest else score, query))
    q = query[order]
    first = np.r_[True, q[1:] != q[:-1]]
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[place < k]


def ranked(partials: DataFrame, k: int, largest: bool) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best partial results of each query."""
    order = F.desc("score") if largest else F.asc("score")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(order, "vec_id"))
    return partials.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
