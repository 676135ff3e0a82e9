"""Out-of-fold expectations of a target (L2 of the survey): every row is predicted by a model that never saw it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.stats import global_robust_z, group_quantiles
from tessera.session import cut_lineage

#: Bins of a feature, rows that a leaf holds at least, distinct values of a feature above which four digits of each tell its bin.
BINS, LEAF_ROWS, VALUES = 255, 8, 50_000


def fold_of(key: Column, folds: int) -> Column:
    """A fold from a hash of the key: the same on every run and for every order of rows."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def out_of_fold_means(df: DataFrame, id_col: str, group: list[str], target: str, folds: int = 5) -> DataFrame:
    """(id, expected): mean of the target in the row's group over the other folds; sums of a group less those of its fold.

    One grouping by (group, fold) and one join, so a group of any size is folded map-side.
    """
    marked = df.withColumn("_fold", fold_of(F.col(id_col), folds))
    sums = marked.where(F.col(target).isNotNull()).groupBy(*group, "_fold").agg(F.sum(target).alias("_s"), F.count("*").alias("_n"))
    whole = sums.groupBy(*group).agg(F.sum("_s").alias("_all_s"), F.sum("_n").alias("_all_n"))
    own = sums.withColumnsRenamed({g: f"_o_{g}" for g in group})
    joined = marked.join(whole.withColumnsRenamed({g: f"_w_{g}" for g in group}), [marked[g].eqNullSafe(F.col(f"_w_{g}")) for g in group], "left")
    joined = joined.join(own.withColumnRenamed("_fold", "_of"), [marked[g].eqNullSafe(F.col(f"_o_{g}")) for g in group] + [marked["_fold"] == F.col("_of")], "left")
    n = F.coalesce("_all_n", F.lit(0)) - F.coalesce("_n", F.lit(0))
    return joined.select(id_col, F.when(n > 0, (F.col("_all_s") - F.coalesce("_s", F.lit(0.0))) / n).alias("expected"))


def fold_count(n: int) -> int:
    """Folds for n rows with a target."""
    return min(5, max(3, n // 20))


def bin_edges(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds between the bins of ascending values: one bin for each value if they are no more than ``bins``, else bins of like many rows."""
    between = (values[:-1] + values[1:]) / 2
    if len(values) <= bins:
        return between
    upto = np.cumsum(counts)
    return between[np.unique(np.minimum(np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins), len(between) - 1))]


def _edges(rows: DataFrame, column: str) -> np.ndarray:
    """bin_edges of a column of a table; values are counted, none is left out."""
    counted = cut_lineage(rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")))
    if counted.count() > VALUES:  # bounded for the driver: so many digits leave 9,000 values for each power of ten
        unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs("v"))) - 3)
        counted = counted.groupBy(F.when(F.col("v") == 0, 0.0).otherwise(F.round(F.col("v") / unit) * unit).alias("v")).agg(F.sum("n").alias("n"))
    found = counted.orderBy("v").toArrow()
    return bin_edges(found.column("v").to_numpy(), found.column("n").to_numpy())


def grow_boosted(cells: np.ndarray, n: np.ndarray, total: np.ndarray, sizes: list[int], iterations: int, depth: int, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, value) of the nodes of boosted regression trees, each (iterations, 2 ** (depth + 1) - 1); the children of node i are 2 i + 1 and 2 i + 2.

    Rows of equal bins are one cell with their number and the sum of their targets: all that squared error needs. As in Spark ML, the
    first tree counts whole, each further one is fitted to twice the residual and scaled by ``step``; rows up to the bin go left, and leaves have feature -1.
    """
    nodes = 2 ** (depth + 1) - 1
    feature, cut, value = np.full((iterations, nodes), -1, np.int16), np.zeros((iterations, nodes), np.int16), np.zeros((iterations, nodes))
    predicted, n = np.zeros(len(n)), n.astype(np.float64)
    starts = np.cumsum([0, *sizes])
    for t in range(iterations):
        wanted = total if t == 0 else 2 * (total - n * predicted)
        at = np.zeros(len(n), np.int64)  # node of each cell
        for level in range(depth + 1):
            first, many = 2**level - 1, 2**level
            live = np.flatnonzero(at >= first)  # cells of finished leaves stay above
            if not len(live):
                break
            place, rows, sums = at[live] - first, n[live], wanted[live]
            held, whole = np.bincount(place, rows, many), np.bincount(place, sums, many)
            value[t, first : first + many] = whole / np.maximum(held, 1)
            if level == depth:
                break
            gains = np.full((many, starts[-1]), -np.inf)
            for f, size in enumerate(sizes):
                key = place * size + cells[f][live]
                left_n = np.bincount(key, rows, many * size).reshape(many, size).cumsum(1)
                left_s = np.bincount(key, sums, many * size).reshape(many, size).cumsum(1)
                right_n, right_s = held[:, None] - left_n, whole[:, None] - left_s
                fits = (left_n >= LEAF_ROWS) & (right_n >= LEAF_ROWS)
                gain = left_s**2 / np.maximum(left_n, 1) + right_s**2 / np.maximum(right_n, 1) - (whole**2 / np.maximum(held, 1))[:, None]
                gains[:, starts[f] : starts[f + 1]] = np.where(fits, gain, -np.inf)
            best = gains.argmax(1)
            splits = np.flatnonzero(gains[np.arange(many), best] > 1e-12 * np.maximum(whole**2 / np.maximum(held, 1), 1e-300))
            which = np.searchsorted(starts, best[splits], side="right") - 1
            feature[t, first + splits], cut[t, first + splits] = which, best[splits] - starts[which]
            for node, f in zip(splits, which):
                mine = live[place == node]
                at[mine] = 2 * (first + node) + 1 + (cells[f][mine] > cut[t, first + node])
        predicted += (1.0 if t == 0 else step) * value[t, at]
    value[1:] *= step
    return feature, cut, value


def boosted(trees: tuple[np.ndarray, np.ndarray, np.ndarray], cells: np.ndarray) -> np.ndarray:
    """Prediction of each column of ``cells``."""
    feature, cut, value = trees
    every, out = np.arange(cells.shape[1]), np.zeros(cells.shape[1])
    for f, c, v in zip(feature, cut, value):
        at = np.zeros(len(every), np.int64)
        while (inner := np.flatnonzero(f[at] >= 0)).size:
            node = at[inner]
            at[inner] = 2 * node + 1 + (cells[f[node], inner] > c[node])
        out += v[at]
    return out


def out_of_fold_boosting(df: DataFrame, id_col: str, features: list[str], target: str, folds: int | None = None, iterations: int = 220, depth: int = 4, step: float = 0.055, seed: int = 42) -> DataFrame:
    """(id, expected, ratio, signed_log_residual, anomaly): gradient-boosted trees on log1p of the target, medians fill gaps.

    Folds are as many as fold_count() tells unless given. Rows with a target of 0 or less, or none, get no expectation. Fewer than 40 such rows give none at all.
    Rows are summed to cells of equal bins, and one task boosts one fold over all cells: the work of an iteration grows with the cells, not with the
    rows. No step draws at random; ``seed`` is kept for callers.
    """
    medians = {f: group_quantiles(df, [], f).first() for f in features}
    filled = {f: F.coalesce(F.col(f).cast("double"), F.lit(float(m["q0"]) if m and m["q0"] is not None else 0.0)) for f, m in medians.items()}
    y = F.when(F.col(target) > 0, F.log1p(target))
    names, cells = [f"x_{i}" for i in range(len(features))], [f"c_{i}" for i in range(len(features))]
    rows = cut_lineage(df.select(F.col(id_col).alias("id"), *[filled[f].alias(x) for f, x in zip(features, names)], F.col(target).cast("double").alias("actual"), y.alias("y")).where("y is not null"))
    kind = dict(df.dtypes)[id_col]
    schema = f"id {kind}, expected double, ratio double, signed_log_residual double, anomaly double"
    n = rows.count()
    if n < 40:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    folds = folds or fold_count(n)
    edges = [_edges(rows, x) for x in names]
    sizes = [len(e) + 1 for e in edges]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array(np.searchsorted(e, batch.column(i + 1).to_numpy(zero_copy_only=False)).astype(np.int16)) for i, e in enumerate(edges)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[-3:], *columns], names=["id", "actual", "y", "fold", *cells])

    placed = rows.withColumn("fold", fold_of(F.col("id"), folds)).select("id", *names, "actual", "y", "fold")
    placed = cut_lineage(placed.mapInArrow(binned, f"id {kind}, actual double, y double, fold int, " + ", ".join(f"{c} short" for c in cells)))
    sums = placed.groupBy("fold", *cells).agg(F.count("*").alias("n"), F.sum("y").alias("total"))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))  # models that see a fold

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in cells])
        trees = grow_boosted(np.stack([table.column(c).to_numpy() for c in cells]).astype(np.int64), table.column("n").to_numpy(), table.column("total").to_numpy(), sizes, iterations, depth, step)
        return pa.table({"model": table.column("model").slice(0, 1), **{name: pa.array([x.ravel()], pa.list_(pa.from_numpy_dtype(x.dtype))) for name, x in zip(("feature", "cut", "value"), trees)}})

    seen = sums.withColumn("model", F.explode(others)).groupBy("model", *cells).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    fitted = seen.groupBy("model").applyInArrow(fit, "model int, feature array<short>, cut array<short>, value array<double>").collect()  # fixed size: folds x iterations x nodes
    models = df.sparkSession.sparkContext.broadcast({r.model: tuple(np.array(x).reshape(iterations, -1) for x in (r.feature, r.cut, r.value)) for r in fitted})

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, fold = np.zeros(batch.num_rows), batch.column(3).to_numpy()
            x = np.stack([batch.column(4 + i).to_numpy() for i in range(len(cells))]).astype(np.int64)
            for k in np.unique(fold):
                mine = np.flatnonzero(fold == k)
                distinct, which = np.unique(x[:, mine], axis=1, return_inverse=True)
                found[mine] = boosted(models.value[int(k)], distinct)[which.ravel()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], names=["id", "actual", "y", "prediction"])

    out = placed.mapInArrow(predicted, f"id {kind}, actual double, y double, prediction double")
    residual = F.col("y") - F.col("prediction")
    scored = global_robust_z(cut_lineage(out.withColumn("signed_log_residual", residual)), "signed_log_residual", "z")
    expected = F.expm1("prediction")
    return scored.select(F.col("id").alias(id_col), expected.alias("expected"), (F.col("actual") / F.greatest(expected, F.lit(1.0))).alias("ratio"), "signed_log_residual", (F.least(F.abs("z"), F.lit(5.0)) / 5).alias("anomaly"))
