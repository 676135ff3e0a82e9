"""Relational operators of the scoring pipeline: dedupe, set operations, selection, reshaping, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The last row of each key in arrival order; a grouped maximum, so that a key of very many rows is folded map-side."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    last = df.withColumns(named).groupBy(*named).agg(F.max_by(row, F.struct(*order)).alias("r"))
    return last.select(*[F.col(f"r.{c}").alias(c) for c in df.columns])


def snapshot_key(df: DataFrame, candidates: tuple[str, ...] = ("token", "url")) -> list[Column]:
    """The key of a whole snapshot, the first candidate that any row has, else all columns; blank ones collapse into one."""
    for c in candidates:
        if c in df.columns and not df.where(F.length(c) > 0).limit(1).isEmpty():
            return [F.coalesce(F.trim(c), F.lit(""))]
    return [F.col(c) for c in df.columns]


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the left side without partner."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def top_priority(df: DataFrame, score: str, tie: str, k: int, least: float) -> DataFrame:
    """The k best rows of at least a score (the k is the feature)."""
    return df.where(F.col(score) >= least).orderBy(F.desc(score), tie).limit(k)


def exploration(df: DataFrame, score: str, tie: str, n: int, bins: int) -> DataFrame:
    """N rows drawn round-robin from score strata, in order of a hash within each stratum.

    Strata are cut at exact quantile ranks of the score, from counts of distinct scores; equal scores stay together.
    """
    from tessera.operators.stats import percent_rank_ties

    ranked = percent_rank_ties(df, score, "_rank")
    strata = ranked.withColumn("stratum", F.least(F.lit(bins - 1), F.floor(F.col("_rank") * bins)).cast("int"))
    drawn = F.md5(F.col(tie).cast("string"))
    turn = F.row_number().over(Window.partitionBy("stratum").orderBy(drawn, tie))
    # only the first n rows of a stratum can be drawn: Spark keeps those while it sorts
    return strata.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", "stratum", tie).limit(n).drop("_rank")


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """One row for each value column."""
    return df.unpivot(ids, values, name, value)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) over equal bins of [low, high]; the upper edge belongs to the last bin."""
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / ((high - low) / bins))).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """A10: mean over the parts that are not null, weights normalised again; 0 if none is."""
    total = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0.0))
    value = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts[1:]), F.coalesce(parts[0][0], F.lit(0.0)) * parts[0][1])
    return F.coalesce(value / F.nullif(total, F.lit(0.0)), F.lit(0.0))


def row_std(parts: list[Column]) -> Column:
    """Sample deviation of the non-null parts; 0 below two."""
    a = F.array_compact(F.array(*parts))
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    square = F.aggregate(F.transform(a, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x)
    return F.when(n >= 2, F.sqrt(square / (n - 1))).otherwise(0.0)


def box(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, low, q1, median, q3, high) of each group; low and high are the values farthest out within 1.5 times the box."""
    from tessera.operators.stats import _same, group_quantiles

    q = group_quantiles(df, keys, value, (0.25, 0.5, 0.75))
    reach = 1.5 * (F.col("q2") - F.col("q0"))
    joined = _same(df.where(F.col(value).isNotNull()).select(*keys, value), q, keys)
    inside = F.when(F.col(value).between(F.col("q0") - reach, F.col("q2") + reach), F.col(value))
    return joined.groupBy(*keys).agg(F.max("n").alias("n"), F.min(inside).alias("low"), F.max("q0").alias("q1"), F.max("q1").alias("median"), F.max("q2").alias("q3"), F.max(inside).alias("high"))


def one_hot(df: DataFrame, column: str, most: int = 80) -> DataFrame:
    """One 0/1 column for each value (null is one of them, named ``<column>_nan``); a column of more than ``most`` values is dropped instead."""
    values = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
    if len(values) > most:
        return df.drop(column)
    named = {f"{column}_{'nan' if v is None else v}": F.col(column).eqNullSafe(F.lit(v)).cast("int") for v in sorted(values, key=lambda v: (v is None, str(v)))}
    return df.withColumns(named).drop(column)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with ``place``, their position in an order that a hash of key and seed gives: the same on every run and for every partitioning."""
    return numbered(df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))), ["_h", key], "place").drop("_h")


def numbered(df: DataFrame, order: list[str], out: str, parts: int = 64) -> DataFrame:
    """Rows with their position from 1 in an order, without gathering them in one task: ranges are sorted apart and counted before."""
    from tessera.session import cut_lineage

    ranged = cut_lineage(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(F.broadcast(sizes.select("_p", "_before")), "_p").withColumn(out, within + F.col("_before")).drop("_p", "_before")  # at most ``parts`` rows


def candidates(priority: DataFrame, exploration_: DataFrame, key: str) -> DataFrame:
    """(key, reason) of both selections; a row chosen twice keeps the first reason."""
    both = priority.select(key, F.lit("priority").alias("reason"), F.lit(0).alias("_i")).unionByName(exploration_.select(key, F.lit("exploration").alias("reason"), F.lit(1).alias("_i")))
    return both.groupBy(key).agg(F.min_by("reason", "_i").alias("reason"))


def stable_id(tokens: Column) -> Column:
    """the first 10 hexadecimal digits of the SHA-1 of sorted tokens; tokens are an array of bounded size."""
    return F.substring(F.sha1(F.array_join(F.array_sort(tokens), "|")), 1, 10)
