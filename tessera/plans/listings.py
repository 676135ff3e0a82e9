"""Listing features, market and risk channels as DataFrame transforms (M1-M17, P1-P3, P8, A8-A11 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import listing as L
from tessera.operators import relational as R
from tessera.operators import stats
from tessera.session import cut_lineage, table, written

NUMBERS = ["area_m2", "rooms", "year_built_shamsi", "deposit_toman", "rent_monthly_toman"]
FLAGS = ["impossible_area", "impossible_rooms", "impossible_year", "negative_price", "rooms_area_ratio_bad"]
# Default bounds and weights.
AREA, MOST_ROOMS, YEARS, BUCKET, MULTIPLES = (10.0, 1000.0), 12.0, (1300.0, 1410.0), 20, (25, 30, 35)


def clean(df: DataFrame) -> DataFrame:
    """Numbers without NaN and infinities."""
    return df.withColumns({c: L.real(F.col(c)) for c in NUMBERS})


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "listing"))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def features(df: DataFrame, texts: bool = True) -> DataFrame:
    """Unit prices, contract style, buckets, quality flags and score; ``texts`` adds conflicts with the texts."""
    dep, rent = F.coalesce("deposit_toman", F.lit(0.0)), F.coalesce("rent_monthly_toman", F.lit(0.0))
    none = F.col("deposit_toman").isNull() & F.col("rent_monthly_toman").isNull()
    out = df.withColumns({f"equivalent_deposit_{m}_toman": F.when(~none, dep + m * rent) for m in MULTIPLES})
    out = out.withColumns({f"equivalent_deposit_{m}_per_m2": L.safe_div(F.col(f"equivalent_deposit_{m}_toman"), F.col("area_m2")) for m in MULTIPLES})
    d, r = F.col("deposit_toman"), F.col("rent_monthly_toman")
    style = F.when((d > 0) & (r > 0), "mixed").when((dep <= 0) & (r > 0), "rent_only").when((d > 0) & (rent <= 0), "full_deposit").otherwise("unknown")
    area, rooms, year = (F.col(c) for c in NUMBERS[:3])
    out = out.withColumns({
        "deposit_per_m2": L.safe_div(d, area), "rent_per_m2": L.safe_div(r, area), "contract_style": style,
        "contract_rent_share": L.clip(F.try_divide(30 * rent, F.nullif(dep + 30 * rent, F.lit(0.0)))),
        "area_bucket": (F.floor(area / BUCKET) * BUCKET).cast("bigint"),
        "missing_fraction": sum((F.col(c).isNull().cast("int") for c in ("rooms", "deposit_toman", "rent_monthly_toman", "description")), F.col("area_m2").isNull().cast("int")) / 5.0,
        "description_len": F.length(F.coalesce("description", F.lit(""))),
        "impossible_area": _flag((area < AREA[0]) | (area > AREA[1])), "impossible_rooms": _flag((rooms < 0) | (rooms > MOST_ROOMS)),
        "impossible_year": _flag((year < YEARS[0]) | (year > YEARS[1])), "negative_price": _flag((d < 0) | (r < 0)),
        "rooms_area_ratio_bad": _flag((rooms >= 5) & (area < 70)),
    })
    flags = [F.col(f).cast("double") for f in FLAGS]
    if texts:
        out = text_conflicts(out)
        flags += [F.col(c) for c in ("area_text_conflict", "rooms_text_conflict", "amenity_text_conflict")]
        share = sum(flags[1:], flags[0]) / 8
        most = F.greatest(*flags)
    else:  # conflicts count as absent
        share, most = sum(flags[1:], flags[0]) / 8, F.greatest(*flags)
    return out.withColumn("data_quality_score", L.clip(0.35 * most + 0.35 * share + 0.30 * F.col("missing_fraction")))


def text_conflicts(df: DataFrame) -> DataFrame:
    """Contradictions between the stored values and the texts."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    found = df.withColumn("_areas", L.area_mentions(text)).withColumn("_rooms", L.room_mentions(text))
    error = F.array_min(F.transform("_areas", lambda x: F.abs(x - F.col("area_m2")) / F.greatest(F.col("area_m2"), F.lit(1.0))))
    amenities = F.greatest(*[L.amenity_conflict(text, n, F.col(c)) for n, c in (("پارکینگ", "parking"), ("آسانسور", "elevator"), ("انباری", "storage"))])
    return found.withColumns({
        "area_text_conflict": _flag(error > 0.18).cast("double"),
        "rooms_text_conflict": _flag((F.size("_rooms") > 0) & F.col("rooms").isNotNull() & ~F.array_contains("_rooms", F.col("rooms").cast("int"))).cast("double"),
        "amenity_text_conflict": amenities,
    }).drop("_areas", "_rooms")


LABELS = ["disposition", "integrity_class", "duplicate_pattern", "market_status", "bait", "data_error", "manual_review", "consistency_level", "label_confidence", "notes"]
PRICE_COLUMNS = [f"equivalent_deposit_{m}_per_m2" for m in MULTIPLES]


def market(df: DataFrame, min_count: int = 8, clip: float = 8.0) -> DataFrame:
    """M5: peer anomalies of the price columns and the robust market score; the central column counts twice in median and spread."""
    levels = [["neighborhood", "area_bucket", "rooms"], ["neighborhood", "area_bucket"], ["neighborhood"]]
    styled = [["contract_style", *x] for x in levels] + [["contract_style"]]
    peers = stats.peer_robust_z(df, PRICE_COLUMNS, levels, "listing_id", min_count, clip)
    parts = stats.peer_robust_z(df, ["deposit_per_m2", "rent_per_m2"], styled, "listing_id", min_count, clip)
    out = df.join(peers, "listing_id").join(parts, "listing_id")
    a, b, c = (F.col(f"peer_anomaly_{x}") for x in PRICE_COLUMNS)
    four = F.array_sort(F.array(a, b, b, c))
    eq = (F.get(four, F.lit(1)) + F.get(four, F.lit(2))) / 2
    spread = R.row_std([a, b, b, c])
    part = F.greatest("peer_anomaly_deposit_per_m2", "peer_anomaly_rent_per_m2")
    out = out.withColumns({"equivalent_price_anomaly": eq, "equivalence_sensitivity": spread, "contract_component_anomaly": part})
    score = (0.78 * F.col("equivalent_price_anomaly") + 0.22 * F.col("contract_component_anomaly")) * (1 - 0.35 * L.clip(F.col("equivalence_sensitivity")))
    return out.withColumn("robust_market_anomaly", L.clip(score))


def text_links(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, classes) by text: edges (src, dst) from every copy to its class and between alike classes; classes (listing_id, rep, similarity),
    the similarity of the nearest other listing, where one is alike."""
    from tessera.operators.textsim import alike_pairs

    said = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    texts = df.select("listing_id", said.alias("text")).where(F.trim("text") != "")
    keyed = texts.select("listing_id", F.xxhash64("text").alias("k"), F.xxhash64(F.reverse("text")).alias("k2"))
    reps = keyed.groupBy("k", "k2").agg(F.min("listing_id").alias("rep"), F.count("*").alias("copies"))
    classes = cut_lineage(keyed.join(reps, ["k", "k2"]).select("listing_id", "rep", "copies"))
    differing = written(texts.join(classes.where("listing_id = rep").select("listing_id"), "listing_id", "left_semi"))
    pairs = cut_lineage(alike_pairs(differing, "listing_id", "text"))
    nearest = pairs.select(F.explode(F.array("a", "b")).alias("rep"), "similarity").groupBy("rep").agg(F.max("similarity").alias("near"))
    similarity = F.when(F.col("copies") > 1, 1.0).otherwise(F.col("near"))
    edges = classes.where("listing_id != rep").select(F.col("listing_id").alias("src"), F.col("rep").alias("dst")).unionByName(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return edges, classes.join(nearest, "rep", "left").select("listing_id", "rep", similarity.alias("similarity")).where("similarity is not null")


def duplicates(df: DataFrame) -> DataFrame:
    """(id, cluster, its size, neighbourhoods, price span and score, duplicate_similarity) of listings with a text alike to another's."""
    from tessera.operators.graph import components

    edges, near = text_links(df)
    groups = cut_lineage(components(edges))
    members = groups.join(df.select(F.col("listing_id").alias("id"), "neighborhood", "equivalent_deposit_30_toman"), "id")
    price = F.col("equivalent_deposit_30_toman")
    stats_ = members.groupBy("component").agg(
        F.count("*").alias("duplicate_cluster_size"), F.greatest(F.countDistinct(F.nullif(F.trim("neighborhood"), F.lit(""))), F.lit(1)).alias("duplicate_cluster_neighborhoods"),
        F.when((F.count(price) >= 2) & (F.min(price) > 0), F.log1p(F.max(price)) - F.log1p(F.min(price))).otherwise(0.0).alias("_span"),
    ).withColumn("duplicate_cluster_price_span", L.clip(F.col("_span") / 0.9162907318741551))  # ln 2.5
    bait = 0.45 * L.clip((F.col("duplicate_cluster_size") - 1) / 4) + 0.30 * F.col("duplicate_cluster_price_span") + 0.25 * L.clip((F.col("duplicate_cluster_neighborhoods") - 1) / 2)
    scored_ = groups.join(stats_.withColumn("duplicate_bait_score", bait).drop("_span"), "component").withColumnRenamed("component", "duplicate_cluster_id")
    return scored_.join(near.select(F.col("listing_id").alias("id"), F.col("similarity").alias("duplicate_similarity")), "id", "left")


def channels(df: DataFrame, trust: str = "bootstrap") -> DataFrame:
    """Prefilter, risk channels, uncertainty, review priority and band. Missing evidence columns count as absent."""
    multiplier = {"bootstrap": 0.25, "calibrated": 0.45, "adapted": 1.0}.get(trust, 0.25)  # fixed values

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)

    evaluated = F.coalesce(F.col("decision_evaluated"), F.lit(False)) if "decision_evaluated" in df.columns else F.lit(False)
    believed = number("decision_effective_confidence") * multiplier
    sim = L.clip((number("duplicate_similarity") - 0.88) / 0.12)
    duplicate = F.greatest(sim, number("duplicate_bait_score"))
    data_model = F.when(evaluated, L.clip(0.55 * number("decision_data_error_probability") + 0.45 * number("p_integrity_problem")) * believed)
    market_model = F.when(evaluated, L.clip(number("p_market_outlier")) * believed)
    bait_model = F.when(evaluated, F.greatest(number("decision_bait_probability"), number("p_misleading"), number("p_duplicate_conflict")) * believed)
    out = df.withColumns({
        "prefilter_score": L.clip(0.32 * number("market_anomaly_score") + 0.26 * number("data_quality_score") + 0.18 * number("price_model_anomaly_score") + 0.16 * number("duplicate_bait_score") + 0.08 * sim),
        "duplicate_risk": duplicate,
        "data_problem_score": L.clip(R.weighted_mean([(number("data_quality_score"), 0.72), (data_model, 0.28)])),
        "market_outlier_score": L.clip(R.weighted_mean([(number("market_anomaly_score"), 0.82), (market_model, 0.18)])),
        "misleading_risk_score": L.clip(R.weighted_mean([(duplicate, 0.42), (bait_model, 0.58)])),
    })
    three = [F.col(c) for c in ("data_problem_score", "market_outlier_score", "misleading_risk_score")]
    doubt = F.when(evaluated, 0.45 * (1 - number("decision_effective_confidence")) + 0.25 * (1 - number("decision_coherence_score"))).otherwise(0.0)
    out = out.withColumn("uncertainty_score", L.clip(doubt + 0.30 * L.clip(2 * R.row_std(three))))
    ordered = F.sort_array(F.array(*three), asc=False)
    abstain = F.coalesce(F.col("decision_abstain").cast("int"), F.lit(0)) if "decision_abstain" in df.columns else F.lit(0)
    priority = 0.52 * F.get(ordered, F.lit(0)) + 0.20 * F.get(ordered, F.lit(1)) + 0.16 * F.col("uncertainty_score") + 0.12 * number("decision_manual_review_probability") + 0.08 * abstain
    out = out.withColumn("review_priority_score", L.clip(priority))
    band = F.when(F.col("review_priority_score") >= 0.75, "high").when(F.col("review_priority_score") >= 0.55, "review").otherwise("normal")
    out = out.withColumn("risk_band", band)
    return out.withColumn("flag_reasons", reasons(out.columns))


def reasons(columns: list[str]) -> Column:
    """phrases of the signals that stand out, in order, once each, '; '-joined. Columns that aren't there say nothing."""
    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in columns else F.lit(0.0)

    def told(name: str) -> Column:
        return F.col(name).cast("string") if name in columns else F.lit(None).cast("string")

    def said(text: str, value: Column) -> Column:
        return F.concat(F.lit(text), L.fixed(value))

    # Phrases and bounds.
    ratio = F.col("price_model_ratio") if "price_model_ratio" in columns else F.lit(None).cast("double")
    market_ = said("market outlier=", number("market_outlier_score"))
    evaluated = F.coalesce(F.col("decision_evaluated"), F.lit(False)) if "decision_evaluated" in columns else F.lit(False)
    abstain = F.coalesce(F.col("decision_abstain"), F.lit(False)) if "decision_abstain" in columns else F.lit(False)
    disposition = F.nullif(told("decision_disposition"), F.lit(""))
    confidence = number("decision_effective_confidence")
    phrases = [
        F.when(number("data_problem_score") >= 0.55, said("data-quality risk=", number("data_problem_score"))),
        F.when(number("market_outlier_score") >= 0.55, F.when(ratio.isNotNull() & ~F.isnan(ratio), F.concat(market_, said(" (actual/expected=", ratio), F.lit(")"))).otherwise(market_)),
        F.when(number("misleading_risk_score") >= 0.50, said("misleading/bait evidence=", number("misleading_risk_score"))),
        F.when(number("duplicate_bait_score") >= 0.50, F.concat(F.lit("duplicate-cluster inconsistency (n="), number("duplicate_cluster_size").cast("int").cast("string"), F.lit(")"))),
        F.when(evaluated & ~disposition.isin("plausible", "market_outlier"), F.concat(F.lit("decision:"), disposition)),
        F.when(evaluated & abstain, F.concat(F.lit("System-One abstained:"), F.coalesce(F.nullif(told("decision_abstain_reasons"), F.lit("")), F.lit("low decision reliability")))).when(evaluated & (confidence < 0.68), said("decision confidence=", confidence)),
        F.when(number("uncertainty_score") >= 0.40, F.lit("evidence families disagree / need human review")),
    ]
    return F.coalesce(F.nullif(F.array_join(F.array_distinct(F.array_compact(F.array(*phrases))), "; "), F.lit("")), F.lit("low review priority"))


def isolation(df: DataFrame) -> DataFrame:
    """L1: (listing_id, isolation_anomaly_score), rescaled between its 5 % and 95 % quantiles; 0 below 12 rows."""
    from tessera.operators.vectors import isolation_forest

    wanted = ["area_m2", "rooms", "year_built_shamsi", "_price", "contract_rent_share", "description_len"]
    price = F.log1p(F.greatest(F.col("equivalent_deposit_30_per_m2"), F.lit(0.0)))
    raw = cut_lineage(isolation_forest(df.withColumn("_price", price), "listing_id", wanted))
    scaled = stats.quantile_rescale(raw, "isolation_score", "isolation_anomaly_score").select("listing_id", "isolation_anomaly_score")
    return scaled if raw.count() >= 12 else raw.select("listing_id", F.lit(0.0).alias("isolation_anomaly_score"))


def fused_market(columns: list[str]) -> Column:
    """M6, M7: the market score of all detectors whose columns are there; with none but the isolation score it is the early score."""
    # Weights.
    late, early = {"robust_market_anomaly": 0.36, "isolation_anomaly_score": 0.22, "price_model_anomaly_score": 0.30, "lof_anomaly_score": 0.12}, {"robust_market_anomaly": 0.72, "isolation_anomaly_score": 0.28}
    weights = late if {"price_model_anomaly_score", "lof_anomaly_score"} & {*columns} else early
    return L.clip(sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items() if c in columns), F.lit(0.0)))


def scored(df: DataFrame, detectors: DataFrame | None = None) -> DataFrame:
    """Listings with features, market score, duplicate clusters and channels, without a model of decisions.

    ``detectors`` may bring (listing_id, price_model_anomaly_score, price_model_ratio, lof_anomaly_score) for the fused market score.
    """
    whole = written(features(clean(df)))
    base = market(whole.drop("title", "description", "url", "structured_fields_json")).join(isolation(whole), "listing_id", "left")
    if detectors is not None:
        base = base.join(detectors, "listing_id", "left")
    with_groups = base.join(duplicates(whole).withColumnRenamed("id", "listing_id"), "listing_id", "left")
    ready = with_groups.withColumn("market_anomaly_score", fused_market(with_groups.columns))
    return channels(ready).join(df.select("listing_id", "title", "description"), "listing_id")


def review_queue(df: DataFrame, bands: tuple[str, ...] = ("review", "high")) -> DataFrame:
    """K3, O1: rows of the bands, most urgent first, with blank label columns."""
    queue = df.where(F.col("risk_band").isin(*bands)).withColumns({f"human_{x}": F.lit("") for x in LABELS})
    return queue.orderBy(F.desc("review_priority_score"), F.desc("misleading_risk_score"), F.desc("market_outlier_score"), "listing_id")


def annotation_sample(df: DataFrame) -> DataFrame:
    """K4: evaluated rows with blank label columns."""
    return df.where("decision_evaluated").withColumns({f"human_{x}": F.lit("") for x in LABELS})
