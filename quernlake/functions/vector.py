"""Distances between arrays of numbers, computed in doubles, and exact nearest neighbours for a given set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, each) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: each(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def l1_distance(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x - y))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - inner_product(a, b) / F.sqrt(inner_product(a, a) * inner_product(b, b))


def hamming_distance(a: Column, b: Column) -> Column:
    """Places at which two arrays of bits differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, v: s + v)


def jaccard_distance(a: Column, b: Column) -> Column:
    """Of two arrays of bits: 1 - common ones / all ones."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: ((x != 0) & (y != 0)).cast("int")), F.lit(0), lambda s, v: s + v)
    any_ = F.aggregate(F.zip_with(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.when(any_ > 0, 1 - both / any_).otherwise(F.lit(0.0))


def sparse(v: Column) -> Column:
    """An array as a map of the places (from 1) and values that are not 0."""
    return F.map_filter(F.map_from_arrays(F.sequence(F.lit(1), F.size(v)), v), lambda k, x: x != 0)


def sparse_inner(a: Column, b: Column) -> Column:
    """The inner product of two sparse vectors: over the places that both have."""
    both = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.aggregate(both, F.lit(0.0), lambda s, k: s + F.element_at(a, k).cast("double") * F.element_at(b, k).cast("double"))


#: Vectors of a packed row, and the most bytes that they may take.
PACK_ROWS, PACK_BYTES = 1024, 8 << 20


def packed(df: DataFrame, id_col: str, vector_col: str, prefix: str = "") -> DataFrame:
    """Rows of up to PACK_ROWS vectors each, as binary arrays: ids (bigint) and data (doubles, one vector after the other). Null vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            if not len(ids):
                continue
            data = np.asarray(vectors.flatten(), np.float64).reshape(len(ids), -1)
            step = max(1, min(PACK_ROWS, PACK_BYTES // (8 * data.shape[1])))
            starts = range(0, len(ids), step)
            yield pa.RecordBatch.from_arrays([pa.array([x[i : i + step].tobytes() for i in starts], pa.binary()) for x in (ids, data)], names=[f"{prefix}ids", f"{prefix}data"])

    rows = df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"{prefix}ids binary, {prefix}data binary")


def _exact(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows."""
    if metric == "l2":
        return np.sqrt(((x - q) ** 2).sum(axis=1))
    if metric == "l1":
        return np.abs(x - q).sum(axis=1)
    inner = (x * q).sum(axis=1)
    return -inner if metric == "inner" else 1 - inner / np.sqrt((x * x).sum(axis=1) * (q * q).sum(axis=1))


def _all_distances(metric: str, x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """A number for each query and row that grows with the distance (its square for l2), and how far off it may be."""
    if metric == "l1":
        return np.stack([np.abs(x - v).sum(axis=1) for v in q]), 1e-9 * (1 + float(np.abs(x).sum(axis=1).max() + np.abs(q).sum(axis=1).max()))
    xx, qq, inner = (x * x).sum(axis=1), (q * q).sum(axis=1), q @ x.T
    off = 1e-9 * (1 + float(xx.max()) + float(qq.max()))
    if metric == "l2":
        return xx[None, :] + qq[:, None] - 2 * inner, off
    if metric == "inner":
        return -inner, off
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - inner / np.sqrt(qq[:, None] * xx[None, :]), 1e-9


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, data, q_ids, q_data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
            yield ids, np.frombuffer(data, np.float64).reshape(len(ids), -1), q_ids, np.frombuffer(q_data, np.float64).reshape(len(q_ids), -1)


def _met(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, most_queries: int) -> DataFrame:
    """Each packed row with each packed block of queries. Up to most_queries go to every task; more are dealt out, each task taking some rows against some blocks."""
    if queries.count() <= most_queries:
        # few enough for one partition, and so for whole blocks
        return packed(rows, id_col, vector_col).join(F.broadcast(packed(queries.coalesce(1), id_col, vector_col, "q_")), how="cross")
    return packed(rows, id_col, vector_col).join(packed(queries, id_col, vector_col, "q_").hint("shuffle_replicate_nl"), how="cross")


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, metric: str = "l2", most_queries: int = 10_000) -> DataFrame:
    """For each query (its id and vector) the k nearest of all rows: query_id, the row's id, distance, rank. Exact; equal distances by id.

    Blocks of vectors meet blocks of queries, as matrix products; what they leave, k of each query and those that can't be told from them, is measured exactly.
    Null vectors are nobody's neighbours. Ids are integers.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, q_ids, q in _pairs(batches):
            about, off = _all_distances(metric, x, q)
            last = np.partition(about, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
            a, b = np.nonzero(about <= last[:, None] + off)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[a]), pa.array(ids[b]), pa.array(_exact(metric, x[b], q[a]))], names=["query_id", id_col, "distance"])

    found = _met(rows, queries, id_col, vector_col, most_queries).mapInArrow(near, f"query_id bigint, `{id_col}` bigint, distance double")
    # Spark keeps k rows of each group before the shuffle already (a window group limit).
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col)))
    return ranked.where(F.col("rank") <= k)


def count_within(rows: DataFrame, queries: DataFrame, limit: float, id_col: str, vector_col: str, metric: str = "cosine", most_queries: int = 10_000) -> DataFrame:
    """For each query how many of all rows are nearer than the limit: query_id, n; queries without any are left out. Distances beside the limit are measured exactly."""
    bound = limit * abs(limit) if metric == "l2" else limit

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, q_ids, q in _pairs(batches):
            about, off = _all_distances(metric, x, q)
            n = (about < bound - off).sum(axis=1)
            a, b = np.nonzero(np.abs(about - bound) <= off)
            n += np.bincount(a[_exact(metric, x[b], q[a]) < limit], minlength=len(q_ids))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(n.astype(np.int64))], names=["query_id", "n"])

    found = _met(rows, queries, id_col, vector_col, most_queries).mapInArrow(count, "query_id bigint, n bigint")
    return found.groupBy("query_id").agg(F.sum("n").alias("n")).where("n > 0")
