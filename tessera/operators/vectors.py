"""Nearest neighbours, local outlier factor and isolation trees over numeric rows (L1, L3, L5 of the survey)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block; blocks meet in pairs, so memory is bounded whatever the table.
BLOCK_ROWS = 4096


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.chunk(0)
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(rows), -1)


def neighbours(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, k: int, metric: str = "cosine") -> DataFrame:
    """(id, neighbour, distance, rank): exact k nearest rows of each query, itself excluded, ties by id.

    A stated query set meets all rows in blocks: both sides are cut into blocks, a block pair is one group, keeps k rows for each
    query, and the kept rows are merged. Vectors must have equal length; null vectors take no part.
    """
    kind = dict(rows.dtypes)[id_col]

    def blocked(df: DataFrame, name: str) -> DataFrame:
        n = max(1, -(-df.count() // BLOCK_ROWS))
        return df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(n)).alias(name)), n

    q, nq = blocked(queries, "bq")
    r, nr = blocked(rows, "br")
    left = q.withColumn("br", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)).cast("array<long>"))).withColumn("bq", F.col("bq"))
    right = r.withColumn("bq", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<long>")))

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"id": pa.array([], a.schema.field("id").type), "neighbour": pa.array([], a.schema.field("id").type), "distance": pa.array([], pa.float64())})
        b = b.sort_by("id")
        x, y = _matrix(a.column("v")), _matrix(b.column("v"))
        ia, ib = a.column("id").to_numpy(), b.column("id").to_numpy()
        if metric == "cosine":
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            d = 1 - x @ y.T
        else:
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))
        d = np.round(d, 12)
        d[ia[:, None] == ib[None, :]] = np.inf
        at = np.argsort(d, axis=1, kind="stable")[:, : min(k, d.shape[1])]
        best = np.take_along_axis(d, at, 1)
        keep = np.isfinite(best)
        return pa.table({"id": pa.array(np.repeat(ia, keep.sum(1))), "neighbour": pa.array(ib[at][keep]), "distance": pa.array(best[keep])})

    found = left.groupBy("bq", "br").cogroup(right.groupBy("bq", "br")).applyInArrow(nearest, f"id {kind}, neighbour {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))  # k rows for each block
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("id", id_col)


def lof_neighbours(n: int) -> int:
    """Neighbours that the local outlier factor of n rows looks at."""
    return min(25, max(8, n // 12), n - 1)


def local_outlier_factor(rows: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """L3: (id, lof) with exactly k neighbours, ties by id (Breunig et al. 2000)."""
    near = neighbours(rows, rows, id_col, vector, k, "euclidean")
    from tessera.session import cut_lineage

    near = cut_lineage(near.withColumnRenamed(id_col, "id"))
    reach_of = near.groupBy("id").agg(F.max("distance").alias("kd"))
    reach = near.join(reach_of.select(F.col("id").alias("neighbour"), "kd"), "neighbour").withColumn("rd", F.greatest("distance", "kd"))
    lrd = reach.groupBy("id").agg((1 / F.greatest(F.avg("rd"), F.lit(1e-10))).alias("lrd"))
    both = near.join(lrd.select(F.col("id").alias("neighbour"), F.col("lrd").alias("nlrd")), "neighbour")
    return both.groupBy("id").agg(F.avg("nlrd").alias("m")).join(lrd, "id").select(F.col("id").alias(id_col), (F.col("m") / F.col("lrd")).alias("lof"))


def _depth(n: np.ndarray | float) -> np.ndarray | float:
    """Mean path length of an unsuccessful search among n."""
    n = np.asarray(n, dtype=np.float64)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_trees(sample: np.ndarray, trees: int, size: int, seed: int) -> list[tuple[np.ndarray, ...]]:
    """Isolation trees as arrays (feature, threshold, left, right, path length at leaves)."""
    out = []
    for t in range(trees):
        rng = np.random.default_rng((seed, t))
        rows = sample[rng.permutation(len(sample))[:size]]
        limit = int(np.ceil(np.log2(max(2, len(rows)))))
        feature, threshold, left, right, length = [], [], [], [], []

        def build(x: np.ndarray, depth: int) -> int:
            at = len(feature)
            for a in (feature, left, right):
                a.append(-1)
            threshold.append(0.0)
            length.append(float(depth + _depth(len(x))))
            spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) else []
            if depth < limit and len(x) > 1 and len(spread):
                f = int(rng.choice(spread))
                cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
                feature[at], threshold[at] = f, cut
                left[at] = build(x[x[:, f] < cut], depth + 1)
                right[at] = build(x[x[:, f] >= cut], depth + 1)
            return at

        build(rows, 0)
        out.append(tuple(map(np.array, (feature, threshold, left, right, length))))
    return out


def isolation_score(trees: list[tuple[np.ndarray, ...]], x: np.ndarray, size: int) -> np.ndarray:
    """2 ** (-mean path length / expected path length) of each row (Liu, Ting, Zhou 2008)."""
    total = np.zeros(len(x))
    for feature, threshold, left, right, length in trees:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                break
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] < threshold[node], left[node], right[node])
        total += length[at]
    return 2.0 ** (-total / max(1, len(trees)) / max(float(_depth(size)), 1e-9))


def isolation_forest(df: DataFrame, id_col: str, features: list[str], trees: int = 300, size: int = 256, seed: int = 42, fit_rows: int = 20_000) -> DataFrame:
    """L1: (id, isolation_score) of every row; trees are fitted on a hash-chosen sample of at most ``fit_rows`` rows, medians fill gaps."""
    from tessera.operators.stats import group_quantiles

    medians = [group_quantiles(df, [], f).first() for f in features]
    filled = df.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(f).cast("double"), F.lit(float(m["q0"]) if m and m["q0"] is not None else 0.0)).alias(f"x{i}") for i, (f, m) in enumerate(zip(features, medians))])
    columns = [f"x{i}" for i in range(len(features))]
    chosen = filled.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(fit_rows).select(*columns).toArrow()
    sample = np.stack([c.to_numpy() for c in chosen.columns], axis=1) if chosen.num_rows else np.zeros((0, len(features)))
    used = min(size, len(sample))
    forest = df.sparkSession.sparkContext.broadcast(grow_trees(sample, trees, size, seed) if used else [])  # trees x 2 x size nodes

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(columns))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(isolation_score(forest.value, x, used))], names=["id", "isolation_score"])

    kind = dict(df.dtypes)[id_col]
    return filled.mapInArrow(run, f"id {kind}, isolation_score double").withColumnRenamed("id", id_col)
