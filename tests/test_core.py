"""Functions, statistics, graph, relational and decision operators on literals and brute force."""

import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import listing as L
from tessera.functions.chars import plain_text
from tessera.operators import calibrate, decisions, relational, stats, textsim, vectors
from tessera.operators.graph import components
from tessera.plans import listings as P


def one(spark, column, **values):
    return spark.range(1).select(column(**{k: F.lit(v) for k, v in values.items()}).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, lambda v: L.normalize_text(v), v="  ۱۲ ك‌ي　X ") == "12 ک ی x"
    assert one(spark, lambda v: L.parse_number(v), v="۲ میلیارد و ۵۰۰ میلیون") == 2e9
    assert one(spark, lambda v: L.parse_number(v), v="توافقی 5") is None
    assert one(spark, lambda v: L.parse_int(v), v="2.5") == 2
    assert one(spark, lambda v: L.parse_bool(v), v="ندارد") is True and one(spark, lambda v: L.parse_bool(v, strict=True), v="ندارد") is False
    assert one(spark, lambda v: L.redact_phones(v), v="تماس 09۱۲۳۴۵۶۷۸۹ یا 9123456789.") == "تماس [REDACTED_PHONE] یا [REDACTED_PHONE]."
    assert one(spark, lambda v: L.area_mentions(v), v="۱۲۰ متری و 5000 متر و 80 مترمربع") == [120.0]
    assert sorted(one(spark, lambda v: L.room_mentions(v), v="۳ خوابه، دو خواب")) == [2, 3]
    assert one(spark, lambda v: plain_text(v), v="Кaj​ ﺍبٓ ①") == "Kaj ابٓ ①"
    assert one(spark, lambda v: L.url_token(v), v="https://a.example/v/-/abc_123?x") == "abc_123"


def test_money_and_labels(spark):
    assert one(spark, lambda v: L.money(v), v=1.25e9) == "1.25 B" and one(spark, lambda v: L.money(v), v=999.0) == "999"
    assert [one(spark, lambda v: L.label_bool(v), v=x) for x in (" Yes", "خیر", "1.0", "")] == ["yes", "no", None, None]
    assert [one(spark, lambda v: L.label_level(v), v=x) for x in ("4", "5", "2.9", "x")] == ["4", None, "2", None]


def test_quantiles_and_ranks(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, 3.5, None, 9.0])) for _ in range(200)]
    df = spark.createDataFrame(data, "k string, v double")
    for r in stats.group_quantiles(df, ["k"], "v", (0.5, 0.05)).collect():
        values = [v for k, v in data if k == r.k and v is not None]
        assert r.n == len(values) and r.q0 == statistics.median(values) and r.q1 == pytest.approx(np.quantile(values, 0.05))
    ranks = stats.percent_rank_ties(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double"), "v", "p").collect()
    assert sorted(r.p for r in ranks) == [0.25, 0.625, 0.625, 1.0]
    assert stats.group_quantiles(df.limit(0), ["k"], "v").count() == 0


def test_peer_hierarchy(spark):
    rows = [(i, "n", 1, float(i % 10)) for i in range(20)] + [(100, "n", 2, 50.0), (101, None, None, 5.0), (102, "z", 1, None)]
    df = spark.createDataFrame(rows, "id int, nb string, rm int, v double")
    got = {r.id: r.peer_anomaly_v for r in stats.peer_robust_z(df, ["v"], [["nb", "rm"], ["nb"]], "id", min_count=8, clip=8.0).collect()}

    def z(x, values):
        m = statistics.median(values)
        return (x - m) / (1.4826 * statistics.median(abs(y - m) for y in values))

    inner = [float(i % 10) for i in range(20)]
    assert got[3] == pytest.approx(min(8, abs(z(3.0, inner))) / 8)
    assert got[100] == pytest.approx(min(8, abs(z(50.0, inner + [50.0]))) / 8) and got[101] == pytest.approx(min(8, abs(z(5.0, inner + [50.0, 5.0]))) / 8)
    assert got[102] == 0.0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_like_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {v: find(v) for v in itertools.chain(*edges)}


def test_relational(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, " ", 1), (4, None, 5)], "id int, token string, at int")
    kept = relational.keep_last(df, relational.snapshot_key(df), ["at", "id"])
    assert sorted(r.id for r in kept.collect()) == [2, 4]
    values = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    got = values.select(relational.weighted_mean([(F.col("a"), 0.5), (F.col("b"), 0.2), (F.col("c"), 0.3)]).alias("m"), relational.row_std([F.col("a"), F.col("b"), F.col("c")]).alias("s")).collect()
    assert got[0].m == pytest.approx((0.5 + 0.9) / 0.8) and got[0].s == pytest.approx(math.sqrt(2)) and got[1].m == 0 and got[1].s == 0


def test_decisions(spark):
    assert decisions.permutation(["a", "b", "c"], "q", 1) == ["c", "b", "a"] and sorted(decisions.permutation(["a", "b", "c"], "q", 3)) == ["a", "b", "c"]
    assert decisions.markers(28)[-2:] == ["O26", "O27"]
    rows = [(1, 0, "x", 0.5, 0.0), (1, 1, "y", 0.5, 0.0), (2, 0, "x", 0.1, -1.0), (2, 1, "y", 0.9, 1.0)]
    df = spark.createDataFrame(rows, "k int, option_idx int, option string, p double, logit double")
    a = {r.k: r for r in decisions.answers(df, ["k"]).collect()}
    assert a[1].winner == "x" and a[1].entropy_confidence == pytest.approx(0) and a[2].winner == "y"
    soft = decisions.softmax(df, ["k"], "logit", "q", 2.0).where("k = 2 and option = 'y'").first().q
    assert soft == pytest.approx(1 / (1 + math.exp(-1)))
    both = df.withColumn("pass", F.lit(0)).unionByName(df.withColumn("pass", F.lit(1)))
    assert all(r.stability == pytest.approx(1) for r in decisions.stability(both, ["k"], "pass").collect())
    assert all(r.stability == 0 for r in decisions.stability(df.withColumn("pass", F.lit(0)), ["k"], "pass").collect())
    broken = spark.createDataFrame([(1, "{"), (2, None), (3, '{"q": {"probabilities": {"a": 1}}}')], "k int, j string")
    assert [r.k for r in decisions.from_json(broken, ["k"], "j", "q").collect()] == [3]
    fused = decisions.fuse_evidence(spark.createDataFrame([(1, 1.0, 0.6, 0.2, 0.2), (1, 1.0, 0.2, 0.2, 0.6)], "k int, weight double, entailment double, neutral double, contradiction double"), ["k"]).first()
    assert fused.log_odds == pytest.approx(0, abs=1e-12) and fused.entailment == pytest.approx(0.4) and fused.disagreement == pytest.approx(math.log(3))


def test_temperature_of_overconfident_answers(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        right = rng.random() < 0.7
        rows.append((i, [4.0, 0.0], 0 if right else 1))
    t, loss = calibrate.fit_temperature(spark.createDataFrame(rows, "k int, logits array<double>, target int"))
    assert t == pytest.approx(4 / math.log(sum(r[2] == 0 for r in rows) / sum(r[2] == 1 for r in rows)), rel=0.02) and loss < 0.63


def test_neighbours_and_lof(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    x[0] = [9, 9, 9]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got = {(r.id, r.rank): r.neighbour for r in vectors.neighbours(df, df, "id", "v", 4, "euclidean").collect()}
    order = np.argsort(d, axis=1, kind="stable")
    assert all(got[i, k + 1] == order[i, k] for i in range(60) for k in range(4))
    kd = np.sort(d, axis=1)[:, 3]
    lrd = np.array([1 / np.mean([max(d[i, j], kd[j]) for j in order[i, :4]]) for i in range(60)])
    lof = {r.id: r.lof for r in vectors.local_outlier_factor(df, "id", "v", 4).collect()}
    assert all(lof[i] == pytest.approx(np.mean(lrd[order[i, :4]]) / lrd[i]) for i in range(60)) and max(lof, key=lof.get) == 0


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))] + [(999, 12.0, -12.0), (1000, None, 0.0)]
    out = {r.id: r.isolation_score for r in vectors.isolation_forest(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"], trees=50).collect()}
    assert max(out, key=out.get) == 999 and len(out) == 302 and all(0 < v < 1 for v in out.values())


def test_char_ngrams_and_tfidf(spark):
    grams = textsim.char_ngrams(spark.createDataFrame([(1, "Ab c"), (2, None), (3, "")], "id int, t string"), "id", "t", 3, 4)
    assert sorted(r.term for r in grams.collect()) == sorted([" ab", "ab ", " ab ", " c "])
    w = textsim.tfidf(spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "y")], "id int, term string"), "id", "term").collect()
    assert sum(r.weight**2 for r in w if r.id == 1) == pytest.approx(1)
    best = textsim.similar(textsim.tfidf(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, term string"), "id", "term"), "id", spark.createDataFrame([(1,)], "id int"), 2).collect()
    assert [(r.id, r.neighbour, round(r.similarity, 6)) for r in best] == [(1, 2, 1.0)]


def test_fixed_work_of_models():
    import inspect

    from tessera import queries
    from tessera.operators import price_model, vectors

    given = {k: v.default for k, v in inspect.signature(price_model.out_of_fold_boosting).parameters.items()}
    assert (given["iterations"], given["step"], given["folds"]) == (220, 0.055, None) and [price_model.fold_count(n) for n in (40, 79, 80, 30_000)] == [3, 3, 4, 5]
    assert inspect.signature(vectors.isolation_forest).parameters["trees"].default == 300 and "trees=" not in inspect.getsource(queries.q27)
    assert [vectors.lof_neighbours(n) for n in (5, 60, 120, 300, 10_000)] == [4, 8, 10, 25, 25]


def test_boosting_over_cells_like_spark_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from tessera.operators.price_model import bin_edges, fold_of, out_of_fold_boosting

    rng = random.Random(7)
    rows = [(i, float(rng.randrange(20)), rng.choice([None, 1.0, 2.0, 4.0]), float(rng.randrange(12))) for i in range(600)]
    rows = [(i, a, b, c, rng.choice([0.0, 1.0, 1.0, 1.0]) * math.exp(8 + a / 6 + (b or 0) * c / 20 + rng.gauss(0, 0.3))) for i, a, b, c in rows]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, price double")
    spark.sparkContext.setJobGroup("boosting", "boosting")
    got = {r.id: r.signed_log_residual for r in out_of_fold_boosting(df, "id", ["a", "b", "c"], "price").collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("boosting")
    spark.sparkContext.setJobGroup("", "")
    assert len(got) == sum(r[4] > 0 for r in rows) and len(jobs) < 220  # no job for each iteration of each fold
    got = {r.id: r.signed_log_residual for r in out_of_fold_boosting(df, "id", ["a", "b", "c"], "price", folds=3, iterations=10).collect()}
    b = [r[2] for r in rows if r[2] is not None]
    train = VectorAssembler(inputCols=["a", "b", "c"], outputCol="v").transform(df.fillna(float(np.median(b)), "b").where("price > 0").withColumn("y", F.log1p("price")).withColumn("fold", fold_of(F.col("id"), 3))).cache()
    for k in range(3):
        model = GBTRegressor(featuresCol="v", labelCol="y", maxIter=10, maxDepth=4, stepSize=0.055, seed=42, minInstancesPerNode=8).fit(train.where(F.col("fold") != k))
        for r in model.transform(train.where(F.col("fold") == k)).collect():
            assert got[r.id] == pytest.approx(r.y - r.prediction, abs=1e-9)
    values, counts = np.arange(1000.0), np.where(np.arange(1000) < 500, 1, 9)
    assert len(bin_edges(values[:255], counts[:255])) == 254 and np.bincount(np.searchsorted(bin_edges(values, counts), values), counts).max() <= 36 and len(bin_edges(values[:1], counts[:1])) == 0


def test_alike_texts_like_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choice(["kha", "sar", "bagh", "por", "mi", "dar", "istan", "gah", "van", "zar", "lu", "pen"]) for _ in range(3)) for _ in range(500)]
    texts = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(40)]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            edited = list(base)
            for _ in range(rng.randrange(1, 6)):
                edited[rng.randrange(40)] = rng.choice(words)
            texts.append(" ".join(edited))
    texts = sorted({*texts, "", "a", "a b"})
    df = spark.createDataFrame([*enumerate(texts)], "listing_id long, text string").withColumn("terms", F.lit(1))
    terms, n = textsim.vocabulary(df, "text", 9000)
    counts = [{} for _ in texts]
    for c, t in zip(counts, texts):
        for w in t.lower().split():
            for g in textsim.word_grams(w):
                c[g] = c.get(g, 0) + 1
    total = {g: sum(c.get(g, 0) for c in counts) for g in {g for c in counts for g in c}}
    kept = sorted(total, key=lambda g: (-total[g], g))[:9000]
    assert n == len(texts) and terms == pytest.approx({g: math.log((1 + n) / (1 + sum(g in c for c in counts))) + 1 for g in kept})
    vectors_ = []
    for c in counts:
        v = {g: (1 + math.log(k)) * terms[g] for g, k in c.items() if g in terms}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vectors_.append({g: x / norm for g, x in v.items()})
    want = {(a, b): sum(x * vectors_[b].get(g, 0) for g, x in vectors_[a].items()) for a, b in itertools.combinations(range(len(texts)), 2)}
    want = {k: v for k, v in want.items() if v >= 0.88}
    got = {(r.a, r.b): r.similarity for r in textsim.alike_pairs(df, "listing_id", "text", most=9000).collect()}
    assert len(want) > 10 and got.keys() <= want.keys() and len(got) >= 0.95 * len(want) and all(got[k] == pytest.approx(want[k]) for k in got)
    monkeypatch.setattr(textsim, "BAND_TEXTS", 2)  # crowded bands keep groups together
    group = lambda pairs: {r.id: r.component for r in components(spark.createDataFrame([*pairs] or [(0, 0)], "src long, dst long")).collect()}
    crowded = group({(r.a, r.b) for r in textsim.alike_pairs(df, "listing_id", "text", most=9000).collect()})
    assert sum(crowded.get(i) == c for i, c in group(got).items()) >= 0.9 * len(group(got))
    assert textsim.alike_pairs(df.limit(0), "listing_id", "text").count() == 0 and textsim.word_grams("a") == [" a "] and len(textsim.word_grams("abc")) == 3 + 2 + 1


def test_crowded_bands_lose_no_pair(spark):
    rng = random.Random(5)
    held = {(i, k) for i in range(400) for k in rng.sample([*range(-30, 30), 0, 0, 0, 1, 1, 2], 5)}
    of = {}
    for i, k in held:
        of.setdefault(i, set()).add(k)
    want = {(a, b) for a, b in itertools.combinations(range(400), 2) if len(of[a] & of[b]) > 1}
    got = textsim.candidates(spark.createDataFrame([*held], "id long, band long").repartition(3)).collect()
    assert len(want) > 1000 and sorted(map(tuple, got)) == sorted(want)
    runs = lambda *sizes: sorted(p for i, j in textsim._pairs_of_runs(np.cumsum([0, *sizes[:-1]]), np.array(sizes)) for p in zip(i.tolist(), j.tolist()))
    assert runs(1, 3, 1200) == sorted([(1, 2), (1, 3), (2, 3), *((4 + i, 4 + j) for i, j in itertools.combinations(range(1200), 2))])


def test_every_pair_of_a_large_family_is_found(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(6)) for _ in range(400)]
    base, texts = rng.sample(words, 200), set()
    while len(texts) < 150:
        edited = list(base)
        for _ in range(2):
            edited[rng.randrange(200)] = rng.choice(words)
        texts.add(" ".join(edited))
    df = spark.createDataFrame([*enumerate(sorted(texts))], "listing_id long, text string")
    terms, _ = textsim.vocabulary(df, "text")
    number, x = {t: i for i, t in enumerate(terms)}, np.zeros((150, len(terms)))
    for i, text in enumerate(sorted(texts)):
        for w in text.split():
            for g in textsim.word_grams(w):
                x[i, number[g]] += 1
    x = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * np.array([*terms.values()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(int(i), int(j)): (x @ x.T)[i, j] for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.7, 1)))}
    got = {(r.a, r.b): r.similarity for r in textsim.alike_pairs(df, "listing_id", "text", threshold=0.7).collect()}
    assert len(want) > 5000 and got.keys() <= want.keys() and len(got) >= 0.98 * len(want) and all(got[k] == pytest.approx(want[k]) for k in got)


def test_reasons_and_keys(spark):
    row = spark.createDataFrame([(0.6, 0.7, 1.5, 0.1, 0.55, 3, 0.41, True, "reject", False, 0.5), (0.0, 0.9, float("nan"), 0.0, 0.0, 0, 0.0, True, "plausible", True, 0.9), (0.0,) * 2 + (None, 0.0, 0.0, 0, 0.0, None, None, None, None)],
        "data_problem_score double, market_outlier_score double, price_model_ratio double, misleading_risk_score double, duplicate_bait_score double, duplicate_cluster_size int, uncertainty_score double, decision_evaluated boolean, decision_disposition string, decision_abstain boolean, decision_effective_confidence double")
    got = [r.x for r in row.select(P.reasons(row.columns).alias("x")).collect()]
    assert got == [
        "data-quality risk=0.60; market outlier=0.70 (actual/expected=1.50); duplicate-cluster inconsistency (n=3); decision:reject; decision confidence=0.50; evidence families disagree / need human review",
        "market outlier=0.90; System-One abstained:low decision reliability", "low review priority",
    ]
    df = spark.createDataFrame([("", "u1", 1), ("", "u1", 2), (None, "u2", 3)], "token string, url string, n int")
    last = lambda d: sorted(r.n for r in relational.keep_last(d.withColumn("o", F.col("n")), relational.snapshot_key(d), ["o"]).collect())
    assert last(df) == [2, 3] and last(df.withColumn("token", F.when(F.col("n") == 1, "t").otherwise(F.col("token")))) == [1, 3]
    assert last(df.drop("token", "url")) == [1, 2, 3]
