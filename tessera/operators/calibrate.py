"""Calibration and evaluation of labelled answers (L7, L8, A13-A16, D22 of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-12


def grid_steps(low: float, high: float, n: int) -> list[float]:
    """Geometric grid."""
    return [low * (high / low) ** (i / (n - 1)) for i in range(n)]


def _losses(samples: DataFrame, temperatures: list[float]) -> list[float]:
    """Mean negative log-likelihood at each temperature; ``samples`` has (logits ARRAY<DOUBLE>, target INT).

    Every sample meets the grid (at most a few hundred numbers) and is folded into sums map-side.
    """
    spread = samples.select("target", "logits", F.posexplode(F.array(*map(F.lit, temperatures))).alias("i", "t"))
    scaled = spread.select("i", "target", F.transform("logits", lambda x: x / F.col("t")).alias("z")).select("i", "target", "z", F.array_max("z").alias("top"))
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    p = F.exp(F.get("z", F.col("target")) - F.col("top")) / total
    rows = scaled.groupBy("i").agg(F.avg(-F.ln(F.greatest(p, F.lit(FLOOR)))).alias("loss")).collect()  # one row for each grid point
    found = {r["i"]: r["loss"] for r in rows}
    return [found.get(i, float("inf")) for i in range(len(temperatures))]


def fit_temperature(samples: DataFrame, low: float = 0.1, high: float = 10.0, grid: int = 240, refined: int = 160, rounds: int = 2) -> tuple[float, float]:
    """(temperature, loss) of the smallest mean loss over a geometric grid, refined around the best; the first wins a tie.

    Every round is one aggregation over all samples; the driver sees one number for each grid point.
    """
    from tessera.session import cut_lineage

    samples = cut_lineage(samples)
    best, loss = 1.0, float("inf")
    a, b, n = low, high, grid
    for _ in range(rounds + 1):
        steps = grid_steps(a, b, n)
        for t, v in zip(steps, _losses(samples, steps)):
            if v < loss:
                best, loss = t, v
        a, b, n = best / 1.8, best * 1.8, refined
    return best, loss


def labelled(options: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, option_idx, option, p, logit, target): options of the rows whose label is one of them."""
    rows = options.join(labels.where("target is not null"), key)
    known = F.max((F.col("option") == F.col("target")).cast("int")).over(Window.partitionBy(key))
    return rows.withColumn("_k", known).where("_k = 1").drop("_k")


def samples(rows: DataFrame, key: str) -> DataFrame:
    """(key, logits, target): one row for each labelled case that has all logits."""
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("option_idx", "logit", (F.col("option") == F.col("target")).alias("hit")))).alias("o"), F.count("logit").alias("n"))
    whole = packed.where(F.size("o") == F.col("n"))  # a case has a handful of options
    return whole.select(key, F.transform("o", lambda x: x["logit"]).alias("logits"), (F.array_position(F.transform("o", lambda x: x["hit"]), F.lit(True)) - 1).cast("int").alias("target"))


def case_metrics(rows: DataFrame, key: str) -> DataFrame:
    """(key, winner, confidence, correct, nll, brier) of each labelled case; ties of probability go to the first option."""
    hit = (F.col("option") == F.col("target")).cast("double")
    best = F.max(F.struct("p", (-F.col("option_idx")).alias("i"), F.col("option").alias("o")))
    agg = rows.groupBy(key).agg(
        best.alias("_b"), F.max("target").alias("target"), F.sum(F.when(hit == 1, -F.ln(F.greatest("p", F.lit(FLOOR))))).alias("nll"), F.avg((F.col("p") - hit) * (F.col("p") - hit)).alias("brier")
    )
    return agg.select(key, F.col("_b.o").alias("winner"), F.col("_b.p").alias("confidence"), (F.col("_b.o") == F.col("target")).cast("int").alias("correct"), "nll", "brier")


def summary(cases: DataFrame, abstained: DataFrame | None = None, key: str = "listing_id", bins: int = 10) -> DataFrame:
    """One row with n, accuracy, nll, brier, ece, and coverage and accuracy of the cases not abstained from."""
    rows = cases if abstained is None else cases.join(abstained.select(key, F.col("abstain")), key, "left")
    kept = F.lit(True) if abstained is None else ~F.coalesce("abstain", F.lit(False))
    at = F.least(F.lit(bins - 1), F.floor(F.round("confidence", 9) * bins)).cast("int")
    by_bin = rows.withColumn("_kept", kept).groupBy(at.alias("bin")).agg(
        F.count("*").alias("n"), F.sum("correct").alias("c"), F.sum("confidence").alias("s"), F.sum("nll").alias("l"), F.sum("brier").alias("b"),
        F.sum(F.col("_kept").cast("int")).alias("k"), F.sum(F.when(F.col("_kept"), F.col("correct"))).alias("kc"),
    )
    n = F.sum("n")
    return by_bin.agg(
        n.alias("n"), (F.sum("c") / n).alias("accuracy"), (F.sum("l") / n).alias("nll"), (F.sum("b") / n).alias("brier"), (F.sum(F.abs(F.col("c") - F.col("s"))) / n).alias("ece"),
        (F.sum("k") / n).alias("coverage"), F.try_divide(F.sum("kc"), F.sum("k")).alias("selective_accuracy"),
    )


def soft_targets(labels: DataFrame, options: list[str], label: str, confidence: str) -> DataFrame:
    """A probability for each option: the label takes the stated confidence (clipped to [0.5, 1], 1 if missing), the others share the rest."""
    c = F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.coalesce(F.col(confidence).try_cast("double"), F.lit(1.0))))
    rest = (1 - c) / max(1, len(options) - 1)
    gold = F.create_map(*[x for o in options for x in (F.lit(o), F.when(F.col(label) == o, c).otherwise(rest))])
    return labels.withColumn("gold", F.when(F.col(label).isin(options), gold))
