"""Closed-option decision algebra in long form: one row for each (case, question, option) (D3, D5-D14, D16, A17, W5 of the survey).

Option keys carry their position, so that ties go to the first option. Normalisation inside a question is a window over its
options, of which there are few.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-12


def from_json(df: DataFrame, ids: list[str], json_col: str, question: str) -> DataFrame:
    """(ids, option_idx, option, p, logit) of one question from answers in JSON; broken JSON and other shapes give no rows."""
    shape = "struct<probabilities:map<string,double>,diagnostics:struct<calibration_logits:map<string,double>,raw_nli:map<string,struct<evidence_log_odds:double>>>>"
    answer = F.try_element_at(F.from_json(json_col, f"map<string,{shape}>"), F.lit(question))
    rows = df.select(*ids, answer.alias("_a")).where("_a.probabilities is not null").select(*ids, "_a", F.posexplode("_a.probabilities").alias("option_idx", "option", "p"))
    logit = F.coalesce(F.try_element_at("_a.diagnostics.calibration_logits", F.col("option")), F.try_element_at("_a.diagnostics.raw_nli", F.col("option"))["evidence_log_odds"])
    return rows.select(*ids, "option_idx", "option", "p", logit.alias("logit"))


def softmax(df: DataFrame, keys: list[str], logit: str, out: str, temperature: float = 1.0) -> DataFrame:
    """Probabilities from logits at a temperature."""
    w = Window.partitionBy(*keys)
    scaled = F.col(logit) / max(float(temperature), 1e-6)
    e = F.exp(scaled - F.max(scaled).over(w))
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def answers(df: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """(keys, winner, p_win, n_options, entropy_confidence) of each question."""
    n = F.count("*")
    entropy = -F.sum(F.col(p) * F.ln(F.greatest(F.col(p), F.lit(FLOOR))))
    confidence = F.when(n <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - entropy / F.ln(F.greatest(n, F.lit(2))))))
    best = F.max(F.struct(F.col(p).alias("p"), (-F.col("option_idx")).alias("i"), F.col("option").alias("o")))
    return df.groupBy(*keys).agg(best.alias("_b"), n.alias("n_options"), confidence.alias("entropy_confidence")).select(*keys, F.col("_b.o").alias("winner"), F.col("_b.p").alias("p_win"), "n_options", "entropy_confidence")


def pool(df: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Geometric mean over passes, floored and normalised; ``df`` has a row for each pass and option."""
    pooled = df.groupBy(*keys, "option_idx", "option").agg(F.exp(F.avg(F.ln(F.greatest(F.col(p), F.lit(FLOOR))))).alias("_g"))
    return pooled.withColumn(p, F.col("_g") / F.sum("_g").over(Window.partitionBy(*keys))).drop("_g")


def stability(df: DataFrame, keys: list[str], pass_col: str, p: str = "p") -> DataFrame:
    """(keys, stability) as 1 - Jensen-Shannon divergence between passes over its greatest value; 0 with one pass."""
    mean = F.avg(p).over(Window.partitionBy(*keys, "option_idx"))
    kl = F.col(p) * F.ln(F.greatest(F.col(p), F.lit(FLOOR)) / F.greatest(F.col("_m"), F.lit(FLOOR)))
    by_pass = df.withColumn("_m", mean).groupBy(*keys, pass_col).agg(F.sum(kl).alias("_kl"), F.count("*").alias("_k"))
    out = by_pass.groupBy(*keys).agg(F.avg("_kl").alias("_js"), F.max("_k").alias("_k"), F.count("*").alias("_passes"))
    js = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_js") / F.ln(F.greatest(F.col("_k"), F.lit(2)))))
    return out.select(*keys, F.when(F.col("_passes") > 1, 1 - js).otherwise(0.0).alias("stability"))


def fuse_evidence(df: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """(keys, log_odds, neutral, entailment, contradiction, disagreement) from scorers' (entailment, neutral, contradiction)."""
    odds = F.ln(F.greatest(F.col("entailment"), F.lit(1e-9))) - F.ln(F.greatest(F.col("contradiction"), F.lit(1e-9)))
    w = F.col(weight)
    total = F.sum(w)
    agg = df.withColumn("_o", odds).groupBy(*keys).agg(
        (F.sum(w * F.col("_o")) / total).alias("log_odds"), (F.sum(w * F.col("neutral")) / total).alias("neutral"), (F.sum(w * F.col("_o") * F.col("_o")) / total).alias("_sq")
    )
    z = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.col("log_odds")))
    entails = (1 - F.col("neutral")) / (1 + F.exp(-z))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") - F.col("log_odds") * F.col("log_odds")))
    return agg.select(*keys, "log_odds", "neutral", entails.alias("entailment"), (1 - F.col("neutral") - entails).alias("contradiction"), spread.alias("disagreement"))


def effective_confidence(answer: Column, stable: Column) -> Column:
    """Confidence damped by order sensitivity."""
    return answer * (0.65 + 0.35 * stable)


def abstention(confidence: Column, coherence: Column, stable: Column, least: tuple[float, float, float] = (0.58, 0.55, 0.80)) -> Column:
    """Comma-joined reasons to abstain; '' for none."""
    names = ("low_confidence", "low_coherence", "order_instability")
    return F.concat_ws(",", *[F.when(c < b, n) for n, c, b in zip(names, (confidence, coherence, stable), least)])


def agreement(pairs: list[tuple[Column, Column]]) -> Column:
    """Mean of 1 - |a - b| over pairs of probabilities that should agree, clipped."""
    total = sum((1 - F.abs(a - b) for a, b in pairs[1:]), 1 - F.abs(pairs[0][0] - pairs[0][1]))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / len(pairs)))


def markers(n: int) -> list[str]:
    """Opaque option names A, B, ... and O26, O27, ... beyond."""
    return [chr(65 + i) if i < 26 else f"O{i}" for i in range(n)]


def permutation(keys: list[str], question: str, pass_no: int) -> list[str]:
    """Options in order, reversed, then in the order of a hash of question, pass and key."""
    if pass_no == 0:
        return list(keys)
    if pass_no == 1:
        return list(reversed(keys))
    return sorted(keys, key=lambda k: hashlib.sha1(f"{question}|{pass_no}|{k}".encode()).hexdigest())


def transport(spark, questions: dict[str, list[str]], passes: int) -> DataFrame:
    """(question, pass, marker, option_idx, option), a dimension table of questions x options x passes (1 to 6)."""
    rows = []
    for q, options in questions.items():
        for p in range(max(1, min(6, passes))):
            for marker, option in zip(markers(len(options)), permutation(options, q, p)):
                rows.append((q, p, marker, options.index(option), option))
    return spark.createDataFrame(rows, "question string, pass int, marker string, option_idx int, option string")


def compile_requests(requests: DataFrame, table: DataFrame, state: str = "state") -> DataFrame:
    """One row for each request, question, pass and option; the option table is a dimension of at most a few hundred rows."""
    hypothesis = F.concat_ws(" ", F.col("question"), F.lit("is"), F.col("option"))
    return requests.crossJoin(F.broadcast(table)).withColumn("hypothesis", hypothesis).withColumnRenamed(state, "premise")


def score_pairs(pairs: DataFrame, scorer, keep: list[str]) -> DataFrame:
    """Probabilities of (premise, hypothesis) pairs from a scorer object with ``score(premises, hypotheses) -> [(e, n, c)]``.

    The scorer is built once per worker from ``scorer()``; batches come by Arrow.
    """
    import pyarrow as pa

    schema = pairs.select(*keep).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", entailment double, neutral double, contradiction double"

    def run(batches):
        model = scorer()
        for batch in batches:
            names = batch.schema.names
            scores = model.score(batch.column(names.index("premise")).to_pylist(), batch.column(names.index("hypothesis")).to_pylist())
            columns = [batch.column(names.index(k)) for k in keep]
            parts = [pa.array([float(s[i]) for s in scores], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns + parts, names=[*keep, "entailment", "neutral", "contradiction"])

    return pairs.mapInArrow(run, ddl)


class LexicalScorer:
    """A deterministic scorer: entailment follows the share of hypothesis words that the premise holds."""

    def score(self, premises: list[str], hypotheses: list[str]) -> list[tuple[float, float, float]]:
        out = []
        for p, h in zip(premises, hypotheses):
            said, asked = set((p or "").lower().split()), (h or "").lower().replace("_", " ").split()
            share = sum(w in said for w in asked) / max(1, len(asked))
            entails = 0.05 + 0.7 * share
            out.append((entails, 0.2, 0.8 - entails))
        return out
