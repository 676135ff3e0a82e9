"""Robust statistics: medians, absolute deviations, peer hierarchies, ranks (A1-A5, W1, W2 of the survey).

Exact quantiles of groups of any size without gathering a group in one task: cut points of all values part every group, counts
of these parts (few numbers, combined before the shuffle) tell which part holds the wanted rank, and only the rows of that part are sorted.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

MAD_SCALE = 1.4826
#: Rows that one part of all values is meant to hold, and the least number of parts.
PART_ROWS, LEAST_PARTS = 1_000_000, 16


def _parted(rows: DataFrame, value: str) -> DataFrame:
    """The rows with _b, the part of all values that theirs lies in; cut points come from one sketch and only decide who sorts what."""
    n = rows.count()
    parts = max(LEAST_PARTS, -(-n // PART_ROWS))
    sketch = rows.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    if not sketch:
        return rows.withColumn("_b", F.lit(0.0))
    splits = [-float("inf"), *sorted({float(x) for x in sketch}), float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol="_b", handleInvalid="keep").transform(rows)


def group_quantiles(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(keys, n, q0, q1, ...): count and exact interpolated quantiles of non-null values in each group; null keys form a group."""
    rows = _parted(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), "_v")
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    by = Window.partitionBy(*keys)  # of a group there are as many rows as parts
    upto = by.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("n", F.sum("_c").over(by)).withColumn("_to", F.sum("_c").over(upto)).withColumn("_from", F.col("_to") - F.col("_c"))
    places = [(F.col("n") - 1) * F.lit(float(q)) for q in at]
    ranks = F.array(*[r for p in places for r in (F.floor(p), F.ceil(p))])
    wanted = placed.withColumn("_r", ranks).where(F.exists("_r", lambda r: (r >= F.col("_from")) & (r < F.col("_to")))).select(*keys, "_b", "n", "_from", "_r")
    held = _same(rows, wanted, [*keys, "_b"], "inner")
    rank = F.col("_from") + F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_v")) - 1
    picks = [F.max(F.when(F.get("_r", F.lit(k)) == F.col("_rank"), F.col("_v"))).alias(f"_p{k}") for k in range(2 * len(at))]
    found = held.withColumn("_rank", rank).where(F.array_contains("_r", F.col("_rank"))).groupBy(*keys).agg(F.max("n").alias("n"), *picks)
    weight = [p - F.floor(p) for p in places]
    return found.select(*keys, "n", *[(F.col(f"_p{2 * i}") + (F.col(f"_p{2 * i + 1}") - F.col(f"_p{2 * i}")) * weight[i]).alias(f"q{i}") for i in range(len(at))])


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys where null equals null."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, med, mad) of each group."""
    med = cut_lineage(group_quantiles(df, keys, value).withColumnRenamed("q0", "med"))
    apart = cut_lineage(_same(df.where(F.col(value).isNotNull()).select(*keys, value), med, keys).select(*keys, F.abs(F.col(value) - F.col("med")).alias("_d")))
    mad = group_quantiles(apart, keys, "_d").select(*keys, F.col("q0").alias("mad"))
    return _same(med, mad, keys)


def _z(value: Column, med: Column, mad: Column) -> Column:
    """Robust z; 0 where the deviation vanishes, null values included."""
    return F.when(mad.isNull() | (mad <= 1e-12), 0.0).otherwise((value - med) / (MAD_SCALE * mad))


def global_robust_z(df: DataFrame, value: str, out: str) -> DataFrame:
    """A3: robust z against all rows."""
    return _same(df, median_mad(df, [], value).select("med", "mad"), []).withColumn(out, _z(F.col(value), F.col("med"), F.col("mad"))).drop("med", "mad")


def peer_robust_z(df: DataFrame, values: list[str], levels: list[list[str]], id_col: str, min_count: int = 8, clip: float = 8.0) -> DataFrame:
    """(id, peer_anomaly_<value>...): |robust z| / clip within the narrowest level that has enough values, falling back to all rows, then 0.

    All value columns and all levels are grouped together, as rows of (id, level, keys of the level, name, value): one set of shuffles.
    """
    keys = list(dict.fromkeys(k for level in levels for k in level))
    ladder = [*levels, []]
    named = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values]))
    kinds = dict(df.dtypes)
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), *[(F.col(k) if k in level else F.lit(None).cast(kinds[k])).alias(k) for k in keys]) for i, level in enumerate(ladder)]))
    long = df.select(id_col, *keys, named.alias("x")).select(id_col, *keys, "x.name", "x.value").where("value is not null")
    long = cut_lineage(long.select(id_col, "name", "value", steps.alias("s")).select(id_col, "name", "value", "s.*"))
    by = ["level", *keys, "name"]
    compared = _same(long, cut_lineage(median_mad(long, by, "value")), by)
    enough = (F.col("level") == len(ladder) - 1) | (F.col("n") >= min_count)
    z = F.when(enough, F.least(F.abs(_z(F.col("value"), F.col("med"), F.col("mad"))), F.lit(clip)) / clip)
    best = compared.where(enough).groupBy(id_col).agg(*[F.min_by(F.when(F.col("name") == v, z), F.when(F.col("name") == v, F.col("level"))).alias(f"peer_anomaly_{v}") for v in values])
    return df.select(id_col).join(best, id_col, "left").select(id_col, *[F.coalesce(f"peer_anomaly_{v}", F.lit(0.0)).alias(f"peer_anomaly_{v}") for v in values])


def quantile_rescale(df: DataFrame, value: str, out: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """A5: linear rescaling between two quantiles, clipped to [0, 1]."""
    q = group_quantiles(df, [], value, (low, high)).select(F.col("q0").alias("_lo"), F.col("q1").alias("_hi"))
    scaled = F.when(F.col("_hi") - F.col("_lo") <= 1e-12, 0.0).otherwise((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return _same(df, q, []).withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))).drop("_lo", "_hi")


def percent_rank_ties(df: DataFrame, value: str, out: str, parts: int = 64) -> DataFrame:
    """Average-tie percentile rank of non-null values, without gathering all rows in one task.

    Distinct values are counted first and ranked in ranges: the running count inside a range plus the count of all ranges before it.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranged = counts.repartitionByRange(parts, "_v").withColumn("_p", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    before = ranged.groupBy("_p").agg(F.sum("_c").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("_c").over(Window.partitionBy("_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    total = before.agg(F.sum("_s").alias("_total"))
    ranks = ranged.withColumn("_to", within).join(F.broadcast(before.select("_p", "_before")), "_p").crossJoin(F.broadcast(total))  # at most ``parts`` rows, one row
    rank = (F.col("_before") + F.col("_to") - F.col("_c") + 1 + (F.col("_c") - 1) / 2) / F.col("_total")
    return df.join(ranks.select(F.col("_v").alias(value), rank.alias(out)), value, "left").select(*df.columns, out)
