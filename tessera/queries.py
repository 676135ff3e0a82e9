"""Queries of the core: name -> callable, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import listing as L
from tessera.operators import calibrate, decisions, impute, nested, relational, stats, units, vectors
from tessera.operators.graph import components
from tessera.plans import listings as P
from tessera.session import table

# ---------------------------------------------------------------- helpers


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _listing(s: SparkSession, d: str) -> DataFrame:
    return P.listings(s, d)


_CLEAN = """l AS (SELECT * REPLACE (
  CASE WHEN isnan(area_m2) OR isinf(area_m2) THEN NULL ELSE area_m2 END AS area_m2, CASE WHEN isnan(rooms) OR isinf(rooms) THEN NULL ELSE rooms END AS rooms,
  CASE WHEN isnan(year_built_shamsi) THEN NULL ELSE year_built_shamsi END AS year_built_shamsi, CASE WHEN isnan(deposit_toman) THEN NULL ELSE deposit_toman END AS deposit_toman,
  CASE WHEN isnan(rent_monthly_toman) THEN NULL ELSE rent_monthly_toman END AS rent_monthly_toman) FROM listing)"""

_NORM = r"""lower(trim(regexp_replace(regexp_replace(translate(coalesce({0}, ''), '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩يكۀ', '01234567890123456789یکه'),
  '[\x{{200c}}\x{{200f}}\x{{202a}}-\x{{202e}}]', ' ', 'g'), '[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\v]+', ' ', 'g')))"""

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# ---------------------------------------------------------------- training-data operators of the core

QUERIES |= {
    "p1_found": lambda s, d: nested.flatten(table(s, d, "raw_record"), "record_id", ("card", "detail"), attributes=False).select("record_id", "node_path", "parent_path"),
    "p1_objects": lambda s, d: nested.flatten(table(s, d, "raw_record"), "record_id", ("card", "detail")),
    "p1_records": lambda s, d: nested.flatten(table(s, d, "raw_record"), "record_id", ("card", "detail"), roots=True).where("parent_path is null"),
    "p1_section_items": lambda s, d: nested.related_tables(table(s, d, "raw_record"), "record_id", ("card", "detail"))["detail.sections[].widgets[].data.items[]"],
    "p3_found": lambda s, d: impute.matched(table(s, d, "listing"), table(s, d, "unit_ref")).select("listing_id", "field_name"),
    "p3_matched": lambda s, d: impute.matched(table(s, d, "listing"), table(s, d, "unit_ref")),
    "p3_filled": lambda s, d: impute.fill(table(s, d, "listing"), table(s, d, "unit_ref")),
    "p5_found": lambda s, d: units.convert(table(s, d, "listing"), table(s, d, "unit_ref")).where("converted").select("listing_id", "field_name"),
    "p5_converted": lambda s, d: units.convert(table(s, d, "listing"), table(s, d, "unit_ref")),
}
ORACLE["p1_found"] = r"""WITH f AS (SELECT record_id, 'card' AS field, card AS j FROM raw_record UNION ALL SELECT record_id, 'detail', detail FROM raw_record),
v AS (SELECT record_id, field, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j::JSON->>'$') THEN j::JSON->>'$' END ELSE j END AS j FROM (SELECT * FROM f WHERE j IS NOT NULL AND json_valid(j))),
t AS (SELECT v.record_id, v.field, replace(x.fullkey, '"', '') AS k FROM (SELECT * FROM v WHERE j IS NOT NULL) v, json_tree(v.j) x WHERE x.type = 'OBJECT' AND right(replace(x.fullkey, '"', ''), 1) = ']')
SELECT a.record_id, a.field || substr(a.k, 2) AS node_path, coalesce((SELECT a.field || substr(arg_max(b.k, length(b.k)), 2) FROM t b WHERE b.record_id = a.record_id AND b.field = a.field AND length(b.k) < length(a.k)
 AND (starts_with(a.k, b.k || '.') OR starts_with(a.k, b.k || '['))), a.field) AS parent_path FROM t a"""
ORACLE["p3_found"] = """SELECT listing_id, 'area_m2' AS field_name FROM listing WHERE area_m2 IS NULL OR isnan(area_m2) OR area_m2 <= 0 OR area_m2 = 9999
UNION ALL SELECT listing_id, 'rooms' FROM listing WHERE rooms IS NULL OR isnan(rooms) OR rooms < 0 OR rooms > 60
UNION ALL SELECT listing_id, 'year_built_shamsi' FROM listing WHERE year_built_shamsi IS NULL OR isnan(year_built_shamsi) OR year_built_shamsi NOT BETWEEN 1200 AND 1450"""

# ---------------------------------------------------------------- texts and numbers


@query("q01_normalize_text", f"SELECT listing_id, {_NORM.format('title')} AS norm FROM listing")
def q01(s, d):
    return table(s, d, "listing").select("listing_id", L.normalize_text(F.col("title")).alias("norm"))


@query("q02_parse_number", f"""WITH n AS (SELECT listing_id, {_NORM.format("translate(coalesce(title, ''), '٬٫', ',.')")} AS s FROM listing),
v AS (SELECT listing_id, CASE WHEN s = '' OR contains(s, 'توافقی') OR contains(s, 'مجانی') OR contains(s, 'رایگان') THEN NULL
 ELSE try_cast(nullif(regexp_extract(replace(s, ',', ''), '-?[0-9]+(\\.[0-9]+)?', 0), '') AS DOUBLE)
  * CASE WHEN contains(s, 'میلیارد') THEN 1e9 WHEN contains(s, 'میلیون') THEN 1e6 WHEN contains(s, 'هزار') THEN 1e3 ELSE 1 END END AS v FROM n)
SELECT listing_id, v AS number, CAST(round_even(v, 0) AS BIGINT) AS whole FROM v""")
def q02(s, d):
    t = table(s, d, "listing")
    return t.select("listing_id", L.parse_number(F.col("title")).alias("number"), L.parse_int(F.col("title")).alias("whole"))


@query("q03_parse_bool", f"""WITH n AS (SELECT listing_id, {_NORM.format('floor')} AS s FROM listing)
SELECT listing_id, CASE WHEN contains(s,'دارد') OR contains(s,'بلی') OR contains(s,'بله') OR contains(s,'موجود') OR contains(s,'yes') OR contains(s,'true') THEN true
 WHEN contains(s,'ندارد') OR contains(s,'خیر') OR contains(s,'نه') OR contains(s,'بدون') OR contains(s,'no') OR contains(s,'false') THEN false END AS flag FROM n""")
def q03(s, d):
    return table(s, d, "listing").select("listing_id", L.parse_bool(F.col("floor")).alias("flag"))


@query("q04_phone_redaction")
def q04(s, d):
    return table(s, d, "listing").select("listing_id", L.redact_phones(F.col("description")).alias("redacted"))


@query("q05_url_token", r"""SELECT listing_id, CASE WHEN regexp_full_match(t, '[A-Za-z0-9_-]{6,64}') THEN t END AS url_token
FROM (SELECT listing_id, regexp_extract(coalesce(url, ''), '^https://[^/?#]+/v/(?:[^/?#]+/)*([^/?#]+)/?(?:[?#].*)?$', 1) AS t FROM listing)""")
def q05(s, d):
    return table(s, d, "listing").select("listing_id", L.url_token(F.col("url")).alias("url_token"))


@query("q06_json_probability", """WITH j AS (SELECT listing_id, CASE WHEN json_valid(decision_raw_json) THEN decision_raw_json END AS j FROM human_label)
SELECT listing_id, try_cast(j->>'$.disposition.probabilities.publish' AS DOUBLE) AS p_publish FROM j""")
def q06(s, d):
    return table(s, d, "human_label").select("listing_id", F.get_json_object("decision_raw_json", "$.disposition.probabilities.publish").try_cast("double").alias("p_publish"))


@query("q07_dedupe_keep_last", """SELECT listing_id, token FROM (SELECT listing_id, token, row_number() OVER (
 PARTITION BY coalesce(trim(token), '') ORDER BY crawled_at DESC NULLS LAST, listing_id DESC) AS rn FROM listing) WHERE rn = 1""")
def q07(s, d):
    t = table(s, d, "listing").select("listing_id", "token", "url", "crawled_at")
    return relational.keep_last(t, relational.snapshot_key(t), ["crawled_at", "listing_id"]).select("listing_id", "token")


@query("q08_union_distinct", """SELECT source, crawl_transport FROM crawl_source UNION SELECT source, 'listing' FROM listing WHERE source IS NOT NULL UNION SELECT source, 'documents' FROM documents WHERE source IS NOT NULL""")
def q08(s, d):
    a = table(s, d, "crawl_source").select("source", "crawl_transport")
    b = table(s, d, "listing").where("source is not null").select("source", F.lit("listing").alias("crawl_transport"))
    c = table(s, d, "documents").where("source is not null").select("source", F.lit("documents").alias("crawl_transport"))
    return a.unionByName(b).unionByName(c).distinct()


@query("q09_difference", "SELECT listing_id, token FROM listing WHERE listing_id NOT IN (SELECT listing_id FROM human_label)")
def q09(s, d):
    return relational.difference(table(s, d, "listing").select("listing_id", "token"), table(s, d, "human_label"), ["listing_id"])


# ---------------------------------------------------------------- features


@query("q10_features", f"""WITH {_CLEAN}, f AS (SELECT *, coalesce(deposit_toman, 0) AS dep, coalesce(rent_monthly_toman, 0) AS rent,
 (area_m2 IS NULL)::INT + (rooms IS NULL)::INT + (deposit_toman IS NULL)::INT + (rent_monthly_toman IS NULL)::INT + (description IS NULL)::INT AS miss FROM l)
SELECT listing_id, round(deposit_toman / nullif(area_m2, 0), 4) AS deposit_per_m2,
 CASE WHEN deposit_toman > 0 AND rent_monthly_toman > 0 THEN 'mixed' WHEN dep <= 0 AND rent_monthly_toman > 0 THEN 'rent_only' WHEN deposit_toman > 0 AND rent <= 0 THEN 'full_deposit' ELSE 'unknown' END AS contract_style,
 CAST(floor(area_m2 / 20) * 20 AS BIGINT) AS area_bucket, miss / 5.0 AS missing_fraction, CAST(length(coalesce(description, '')) AS INT) AS description_len,
 coalesce((area_m2 < 10 OR area_m2 > 1000)::INT, 0) AS impossible_area, coalesce((rooms < 0 OR rooms > 12)::INT, 0) AS impossible_rooms,
 coalesce((year_built_shamsi < 1300 OR year_built_shamsi > 1410)::INT, 0) AS impossible_year, coalesce((rooms >= 5 AND area_m2 < 70)::INT, 0) AS rooms_area_ratio_bad FROM f""")
def q10(s, d):
    f = P.features(_listing(s, d), texts=False)
    return f.select("listing_id", _r(F.col("deposit_per_m2"), 4).alias("deposit_per_m2"), "contract_style", "area_bucket", F.col("missing_fraction").cast("double").alias("missing_fraction"), "description_len", "impossible_area", "impossible_rooms", "impossible_year", "rooms_area_ratio_bad")


@query("q11_quality_score", f"""WITH {_CLEAN}, f AS (SELECT listing_id, coalesce((area_m2 < 10 OR area_m2 > 1000)::INT, 0) AS a, coalesce((rooms < 0 OR rooms > 12)::INT, 0) AS b,
 coalesce((year_built_shamsi < 1300 OR year_built_shamsi > 1410)::INT, 0) AS c, coalesce((deposit_toman < 0 OR rent_monthly_toman < 0)::INT, 0) AS e, coalesce((rooms >= 5 AND area_m2 < 70)::INT, 0) AS g,
 ((area_m2 IS NULL)::INT + (rooms IS NULL)::INT + (deposit_toman IS NULL)::INT + (rent_monthly_toman IS NULL)::INT + (description IS NULL)::INT) / 5.0 AS m FROM l)
SELECT listing_id, round(least(1, 0.35 * greatest(a, b, c, e, g) + 0.35 * (a + b + c + e + g) / 8.0 + 0.30 * m), 6) AS data_quality_score FROM f""")
def q11(s, d):
    return P.features(_listing(s, d), texts=False).select("listing_id", _r(F.col("data_quality_score")).alias("data_quality_score"))


@query("q12_text_conflicts")
def q12(s, d):
    return P.text_conflicts(_listing(s, d)).select("listing_id", "area_text_conflict", "rooms_text_conflict", "amenity_text_conflict")


@query("q13_amenity_conflict", f"""WITH n AS (SELECT listing_id, {_NORM.format("concat_ws(' ', coalesce(title, ''), coalesce(description, ''))")} AS s, elevator AS e FROM listing)
SELECT listing_id, CASE WHEN e IS NULL THEN 0.0 WHEN (e AND (contains(s, 'بدون آسانسور') OR contains(s, 'آسانسور ندارد'))) OR (NOT e AND contains(s, 'آسانسور') AND NOT contains(s, 'بدون آسانسور')) THEN 1.0 ELSE 0.0 END::DOUBLE AS conflict FROM n""")
def q13(s, d):
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    return table(s, d, "listing").select("listing_id", L.amenity_conflict(text, "آسانسور", F.col("elevator")).cast("double").alias("conflict"))


# ---------------------------------------------------------------- robust statistics


@query("q20_global_robust_z", f"""WITH {_CLEAN}, m AS (SELECT median(rent_monthly_toman) AS med FROM l), a AS (SELECT median(abs(rent_monthly_toman - med)) AS mad FROM l, m)
SELECT listing_id, round(CASE WHEN mad IS NULL OR mad <= 1e-12 THEN 0 ELSE (rent_monthly_toman - med) / (1.4826 * mad) END, 6) AS z FROM l, m, a""")
def q20(s, d):
    return stats.global_robust_z(_listing(s, d).select("listing_id", "rent_monthly_toman"), "rent_monthly_toman", "z").select("listing_id", _r(F.col("z")).alias("z"))


_PEER_SQL = f"""WITH {_CLEAN}, b AS (SELECT listing_id, neighborhood AS nb, CAST(floor(area_m2 / 20) * 20 AS BIGINT) AS bk, rooms AS rm, deposit_toman / nullif(area_m2, 0) AS v FROM l),
m AS (SELECT *, count(v) OVER w1 AS n1, median(v) OVER w1 AS m1, count(v) OVER w2 AS n2, median(v) OVER w2 AS m2, count(v) OVER w3 AS n3, median(v) OVER w3 AS m3, median(v) OVER () AS m4 FROM b
 WINDOW w1 AS (PARTITION BY nb, bk, rm), w2 AS (PARTITION BY nb, bk), w3 AS (PARTITION BY nb)),
d AS (SELECT *, median(abs(v - m1)) OVER w1 AS d1, median(abs(v - m2)) OVER w2 AS d2, median(abs(v - m3)) OVER w3 AS d3, median(abs(v - m4)) OVER () AS d4 FROM m
 WINDOW w1 AS (PARTITION BY nb, bk, rm), w2 AS (PARTITION BY nb, bk), w3 AS (PARTITION BY nb)),
z AS (SELECT listing_id, CASE WHEN n1 >= 8 THEN CASE WHEN d1 <= 1e-12 THEN 0 ELSE (v - m1) / (1.4826 * d1) END END AS z1, CASE WHEN n2 >= 8 THEN CASE WHEN d2 <= 1e-12 THEN 0 ELSE (v - m2) / (1.4826 * d2) END END AS z2,
 CASE WHEN n3 >= 8 THEN CASE WHEN d3 <= 1e-12 THEN 0 ELSE (v - m3) / (1.4826 * d3) END END AS z3, CASE WHEN d4 IS NULL OR d4 <= 1e-12 THEN 0 ELSE (v - m4) / (1.4826 * d4) END AS z4 FROM d)
SELECT listing_id, round(least(abs(coalesce(z1, z2, z3, z4, 0)), 8) / 8, 6) AS peer FROM z"""


@query("q21_peer_z", _PEER_SQL)
def q21(s, d):
    t = _listing(s, d)
    b = t.select("listing_id", F.col("neighborhood").alias("nb"), (F.floor(F.col("area_m2") / 20) * 20).cast("bigint").alias("bk"), F.col("rooms").alias("rm"), L.safe_div(F.col("deposit_toman"), F.col("area_m2")).alias("v"))
    return stats.peer_robust_z(b, ["v"], [["nb", "bk", "rm"], ["nb", "bk"], ["nb"]], "listing_id").select("listing_id", _r(F.col("peer_anomaly_v")).alias("peer"))


@query("q22_market")
def q22(s, d):
    narrow = P.features(_listing(s, d), texts=False).drop("title", "description", "url", "structured_fields_json")
    return P.market(narrow).select("listing_id", "equivalent_price_anomaly", "equivalence_sensitivity", "contract_component_anomaly", "robust_market_anomaly")


@query("q23_quantile_rescale", f"""WITH {_CLEAN}, q AS (SELECT quantile_cont(deposit_toman, 0.05) AS lo, quantile_cont(deposit_toman, 0.95) AS hi FROM l)
SELECT listing_id, round(CASE WHEN deposit_toman IS NULL THEN NULL ELSE least(1, greatest(0, (deposit_toman - lo) / (hi - lo))) END, 6) AS scaled FROM l, q""")
def q23(s, d):
    out = stats.quantile_rescale(_listing(s, d).select("listing_id", "deposit_toman"), "deposit_toman", "scaled")
    return out.select("listing_id", _r(F.when(F.col("deposit_toman").isNotNull(), F.col("scaled"))).alias("scaled"))


@query("q24_percent_rank", f"""WITH {_CLEAN}, v AS (SELECT listing_id, deposit_toman AS v FROM l WHERE deposit_toman IS NOT NULL)
SELECT listing_id, round((rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / count(*) OVER (), 6) AS pct FROM v""")
def q24(s, d):
    t = _listing(s, d).where("deposit_toman is not null").select("listing_id", "deposit_toman")
    return stats.percent_rank_ties(t, "deposit_toman", "pct").select("listing_id", _r(F.col("pct")).alias("pct"))


@query("q25_group_quantiles", f"""WITH {_CLEAN} SELECT source, count(rent_monthly_toman) AS n, round(quantile_cont(rent_monthly_toman, 0.25), 4) AS q25, round(median(rent_monthly_toman), 4) AS q50, round(quantile_cont(rent_monthly_toman, 0.75), 4) AS q75
FROM l WHERE rent_monthly_toman IS NOT NULL GROUP BY source""")
def q25(s, d):
    q = stats.group_quantiles(_listing(s, d).select("source", "rent_monthly_toman"), ["source"], "rent_monthly_toman", (0.25, 0.5, 0.75))
    return q.select("source", "n", *[_r(F.col(f"q{i}"), 4).alias(n) for i, n in enumerate(("q25", "q50", "q75"))])


@query("q26_out_of_fold_means", f"""WITH {_CLEAN}, f AS (SELECT listing_id, source, rent_monthly_toman AS y, CAST(CAST('0x' || substr(md5(listing_id::VARCHAR), 1, 8) AS BIGINT) % 5 AS INT) AS fold FROM l),
s AS (SELECT source, fold, sum(y) AS s, count(y) AS n FROM f GROUP BY ALL), w AS (SELECT source, sum(s) AS s, sum(n) AS n FROM s GROUP BY source)
SELECT listing_id, round((w.s - coalesce(s.s, 0)) / nullif(w.n - coalesce(s.n, 0), 0), 2) AS expected FROM f LEFT JOIN w ON w.source IS NOT DISTINCT FROM f.source LEFT JOIN s ON s.source IS NOT DISTINCT FROM f.source AND s.fold = f.fold""")
def q26(s, d):
    from tessera.operators.price_model import out_of_fold_means

    t = _listing(s, d).select("listing_id", "source", "rent_monthly_toman")
    return out_of_fold_means(t, "listing_id", ["source"], "rent_monthly_toman").select("listing_id", _r(F.col("expected"), 2).alias("expected"))


@query("q29_out_of_fold_boosting")
def q29(s, d):
    from tessera.operators.price_model import out_of_fold_boosting

    return out_of_fold_boosting(_listing(s, d), "listing_id", ["area_m2", "rooms", "year_built_shamsi"], "deposit_toman")


@query("q27_isolation_forest")
def q27(s, d):
    t = P.features(_listing(s, d), texts=False).withColumn("lp", F.log1p("equivalent_deposit_30_per_m2"))
    return vectors.isolation_forest(t, "listing_id", ["area_m2", "rooms", "year_built_shamsi", "lp"])


@query("q28_lof")
def q28(s, d):
    t = table(s, d, "embeddings")
    return vectors.local_outlier_factor(t, "vec_id", "embedding", vectors.lof_neighbours(t.count()))


@query("q30_char_ngrams", r"""WITH w AS (SELECT ' ' || unnest(regexp_extract_all(lower(title), '\S+')) || ' ' AS p FROM listing WHERE title IS NOT NULL), n AS (SELECT unnest([3, 4, 5]) AS n),
g AS (SELECT substr(p, i, n) AS gram FROM (SELECT p, n, unnest(range(1, greatest(length(p) - n, 0) + 2)) AS i FROM w, n WHERE length(p) >= n OR n = 3)) SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def q30(s, d):
    from tessera.operators.textsim import char_ngrams

    return char_ngrams(table(s, d, "listing"), "listing_id", "title").groupBy(F.col("term").alias("gram")).agg(F.count("*").alias("n"))


@query("q35_alike_texts")
def q35(s, d):
    edges, _ = P.text_links(table(s, d, "listing"))
    return edges


_TFIDF_SQL = r"""WITH t AS (SELECT listing_id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS term FROM listing WHERE title IS NOT NULL),
tf AS (SELECT listing_id, term, 1 + ln(count(*)) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT listing_id) AS n FROM tf),
w AS (SELECT listing_id, term, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n)
SELECT listing_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY listing_id)), 6) AS weight FROM w"""


@query("q31_tfidf", _TFIDF_SQL)
def q31(s, d):
    from tessera.operators.textsim import tfidf

    t = table(s, d, "listing").select("listing_id", F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("term"))
    return tfidf(t, "listing_id", "term").select("listing_id", "term", _r(F.col("weight")).alias("weight"))


@query("q32_cosine_topk", """WITH p AS (SELECT a.vec_id, b.vec_id AS neighbour, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS dist FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.vec_id % 100 = 0)
SELECT vec_id, neighbour, round(dist, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour) AS rn FROM p) WHERE rn <= 6""")
def q32(s, d):
    t = table(s, d, "embeddings")
    return vectors.neighbours(t.where("vec_id % 100 = 0"), t, "vec_id", "embedding", 6).select("vec_id", "neighbour", _r(F.col("distance")).alias("distance"))


def _edges(t: DataFrame) -> DataFrame:
    out = None
    for key in ("token", "building_code"):
        rows = t.where(F.col(key).isNotNull()).select("listing_id", F.col(key).alias("k"))
        e = rows.join(rows.groupBy("k").agg(F.min("listing_id").alias("dst")), "k").select(F.col("listing_id").alias("src"), "dst")
        out = e if out is None else out.unionByName(e)
    return out


@query("q33_components", """WITH RECURSIVE k AS (SELECT listing_id AS v, 't' || token AS k FROM listing WHERE token IS NOT NULL UNION ALL SELECT listing_id, 'b' || building_code FROM listing WHERE building_code IS NOT NULL),
e AS (SELECT DISTINCT a.v AS a, m.v AS b FROM k a JOIN (SELECT k, min(v) AS v FROM k GROUP BY k) m USING (k)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id) SELECT id, min(c) AS component FROM r GROUP BY id""")
def q33(s, d):
    return components(_edges(table(s, d, "listing").select("listing_id", "token", "building_code")))


@query("q34_cluster_rollup")
def q34(s, d):
    return P.duplicates(P.features(_listing(s, d), texts=False))


# ---------------------------------------------------------------- selection


@query("q40_priority_topk", f"""WITH {_CLEAN} SELECT listing_id, rent_monthly_toman FROM l WHERE rent_monthly_toman >= 1000000 ORDER BY rent_monthly_toman DESC, listing_id LIMIT 60""")
def q40(s, d):
    return relational.top_priority(_listing(s, d).select("listing_id", "rent_monthly_toman"), "rent_monthly_toman", "listing_id", 60, 1e6)


@query("q41_exploration", f"""WITH {_CLEAN}, v AS (SELECT listing_id, deposit_toman AS v FROM l WHERE deposit_toman IS NOT NULL),
p AS (SELECT listing_id, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / count(*) OVER () AS pct FROM v), s AS (SELECT listing_id, CAST(least(5, floor(pct * 6)) AS INT) AS stratum FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(listing_id::VARCHAR), listing_id) AS turn FROM s) SELECT listing_id, stratum, CAST(turn AS INT) AS turn FROM t ORDER BY turn, stratum, listing_id LIMIT 24""")
def q41(s, d):
    t = _listing(s, d).where("deposit_toman is not null").select("listing_id", "deposit_toman")
    return relational.exploration(t, "deposit_toman", "listing_id", 24, 6).select("listing_id", "stratum", "turn")


@query("q53_candidates", f"""WITH {_CLEAN}, a AS (SELECT listing_id FROM l WHERE rent_monthly_toman >= 1000000 ORDER BY rent_monthly_toman DESC, listing_id LIMIT 60), v AS (SELECT listing_id, deposit_toman AS v FROM l WHERE deposit_toman IS NOT NULL),
p AS (SELECT listing_id, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / count(*) OVER () AS pct FROM v), s AS (SELECT listing_id, CAST(least(5, floor(pct * 6)) AS INT) AS stratum FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(listing_id::VARCHAR), listing_id) AS turn FROM s), b AS (SELECT listing_id FROM t ORDER BY turn, stratum, listing_id LIMIT 24)
SELECT listing_id, 'priority' AS reason FROM a UNION ALL SELECT listing_id, 'exploration' FROM b WHERE listing_id NOT IN (SELECT listing_id FROM a)""")
def q53(s, d):
    return relational.candidates(q40(s, d), q41(s, d), "listing_id")


@query("q54_scattered_answers", """SELECT l.listing_id, h.listing_id IS NOT NULL AS evaluated, coalesce(h.decision_abstain, false) AS abstain, coalesce(nullif(trim(h.human_disposition), ''), 'none') AS disposition FROM listing l LEFT JOIN human_label h USING (listing_id)""")
def q54(s, d):
    answers = table(s, d, "human_label").select("listing_id", F.lit(True).alias("evaluated"), F.col("decision_abstain").alias("abstain"), L.label_choice(F.col("human_disposition")).alias("disposition"))
    joined = table(s, d, "listing").select("listing_id").join(answers, "listing_id", "left")
    return joined.select("listing_id", F.coalesce("evaluated", F.lit(False)).alias("evaluated"), F.coalesce("abstain", F.lit(False)).alias("abstain"), F.coalesce("disposition", F.lit("none")).alias("disposition"))


@query("q55_annotation_sample", """SELECT listing_id, token, '' AS human_disposition, '' AS human_notes FROM human_label WHERE decision_evaluated""")
def q55(s, d):
    return P.annotation_sample(table(s, d, "human_label").select("listing_id", "token", "decision_evaluated")).select("listing_id", "token", "human_disposition", "human_notes")


@query("q56_one_hot", """SELECT doc_id, (doc_kind IS NOT DISTINCT FROM 'ad_text')::INT AS doc_kind_ad_text, (doc_kind IS NOT DISTINCT FROM 'agent_note')::INT AS doc_kind_agent_note, (doc_kind IS NOT DISTINCT FROM 'area_guide')::INT AS doc_kind_area_guide,
 (doc_kind IS NOT DISTINCT FROM 'inventory')::INT AS doc_kind_inventory, (doc_kind IS NOT DISTINCT FROM 'review_note')::INT AS doc_kind_review_note FROM documents""")
def q56(s, d):
    return relational.one_hot(table(s, d, "documents").select("doc_id", "doc_kind"), "doc_kind")


@query("q57_shuffled", """SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS place FROM documents""")
def q57(s, d):
    return relational.shuffled(table(s, d, "documents").select("doc_id"), "doc_id", 42)


@query("q58_intersect", """SELECT token FROM listing INTERSECT SELECT token FROM human_label""")
def q58(s, d):
    return table(s, d, "listing").select("token").intersect(table(s, d, "human_label").select("token"))


@query("q59_except_all", """SELECT token FROM listing EXCEPT ALL SELECT token FROM human_label""")
def q59(s, d):
    return table(s, d, "listing").select("token").exceptAll(table(s, d, "human_label").select("token"))


@query("q67_counts_by_answer", """SELECT coalesce(nullif(trim(human_disposition), ''), 'none') AS answer, decision_evaluated, count(*) AS n FROM human_label GROUP BY ALL""")
def q67(s, d):
    return table(s, d, "human_label").groupBy(F.coalesce(L.label_choice(F.col("human_disposition")), F.lit("none")).alias("answer"), "decision_evaluated").agg(F.count("*").alias("n"))


@query("q68_box", f"""WITH {_CLEAN}, q AS (SELECT source, count(rent_monthly_toman) AS n, quantile_cont(rent_monthly_toman, 0.25) AS q1, median(rent_monthly_toman) AS med, quantile_cont(rent_monthly_toman, 0.75) AS q3 FROM l WHERE rent_monthly_toman IS NOT NULL GROUP BY source)
SELECT q.source, any_value(n) AS n, min(rent_monthly_toman) FILTER (WHERE rent_monthly_toman BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, round(any_value(q1), 4) AS q1, round(any_value(med), 4) AS median, round(any_value(q3), 4) AS q3,
 max(rent_monthly_toman) FILTER (WHERE rent_monthly_toman BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high FROM q JOIN l ON l.source IS NOT DISTINCT FROM q.source WHERE rent_monthly_toman IS NOT NULL GROUP BY q.source""")
def q68(s, d):
    b = relational.box(_listing(s, d).select("source", "rent_monthly_toman"), ["source"], "rent_monthly_toman")
    return b.select("source", "n", "low", *[_r(F.col(c), 4).alias(c) for c in ("q1", "median", "q3")], "high")


@query("q69_number_text", f"""WITH {_CLEAN} SELECT listing_id, replace(printf('%.2f', area_m2), ',', '') AS said FROM l WHERE area_m2 IS NOT NULL""")
def q69(s, d):
    return _listing(s, d).where("area_m2 is not null").select("listing_id", L.fixed(F.col("area_m2")).alias("said"))


@query("q74_stable_ids", """SELECT listing_id, substr(sha1(array_to_string(list_sort([coalesce(token, ''), coalesce(building_code, ''), coalesce(source, '')]), '|')), 1, 10) AS stable FROM listing""")
def q74(s, d):
    parts = F.array(*[F.coalesce(c, F.lit("")) for c in ("token", "building_code", "source")])
    return table(s, d, "listing").select("listing_id", relational.stable_id(parts).alias("stable"))


# ---------------------------------------------------------------- decisions, calibration, evaluation

_OPTIONS = """o AS (SELECT listing_id, decision_abstain, human_disposition, x.o AS option, x.i AS option_idx, try_cast(json_extract_string(decision_raw_json, '$.disposition.probabilities.' || x.o) AS DOUBLE) AS p,
 try_cast(json_extract_string(decision_raw_json, '$.disposition.diagnostics.calibration_logits.' || x.o) AS DOUBLE) AS logit FROM human_label, (VALUES ('publish', 0), ('review', 1), ('reject', 2)) x(o, i) WHERE json_valid(decision_raw_json))"""


def _answers(s: SparkSession, d: str) -> DataFrame:
    return decisions.from_json(table(s, d, "human_label"), ["listing_id"], "decision_raw_json", "disposition")


def _labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "human_label").select("listing_id", L.label_choice(F.col("human_disposition")).alias("target"))


@query("q42_softmax_answers", f"""WITH {_OPTIONS}, e AS (SELECT *, exp(logit - max(logit) OVER w) / sum(exp(logit - mx)) OVER w AS q FROM (SELECT *, max(logit) OVER (PARTITION BY listing_id) AS mx FROM o) WINDOW w AS (PARTITION BY listing_id))
SELECT listing_id, arg_max(option, q) AS winner, round(max(q), 6) AS p_win, round(1 + sum(q * ln(greatest(q, 1e-12))) / ln(count(*)), 6) AS entropy_confidence FROM e GROUP BY listing_id""")
def q42(s, d):
    a = decisions.answers(decisions.softmax(_answers(s, d), ["listing_id"], "logit", "q"), ["listing_id"], "q")
    return a.select("listing_id", "winner", _r(F.col("p_win")).alias("p_win"), _r(F.col("entropy_confidence")).alias("entropy_confidence"))


def _passes(s, d):
    """Two passes for each case: the stated probabilities and those of the logits."""
    a = decisions.softmax(_answers(s, d), ["listing_id"], "logit", "q")
    first = a.select("listing_id", "option_idx", "option", F.lit(0).alias("pass"), "p")
    return first.unionByName(a.select("listing_id", "option_idx", "option", F.lit(1).alias("pass"), F.col("q").alias("p")))


_PASSES = """e AS (SELECT *, exp(logit - mx) / sum(exp(logit - mx)) OVER (PARTITION BY listing_id) AS q FROM (SELECT *, max(logit) OVER (PARTITION BY listing_id) AS mx FROM o)),
p AS (SELECT listing_id, option_idx, option, 0 AS pass, p FROM e UNION ALL SELECT listing_id, option_idx, option, 1, q FROM e)"""


@query("q43_log_pool", f"""WITH {_OPTIONS}, {_PASSES}, g AS (SELECT listing_id, option, exp(avg(ln(greatest(p, 1e-12)))) AS g FROM p GROUP BY ALL)
SELECT listing_id, option, round(g / sum(g) OVER (PARTITION BY listing_id), 6) AS p FROM g""")
def q43(s, d):
    return decisions.pool(_passes(s, d), ["listing_id"]).select("listing_id", "option", _r(F.col("p")).alias("p"))


@query("q44_order_stability", f"""WITH {_OPTIONS}, {_PASSES}, m AS (SELECT *, avg(p) OVER (PARTITION BY listing_id, option_idx) AS m FROM p),
k AS (SELECT listing_id, pass, sum(p * ln(greatest(p, 1e-12) / greatest(m, 1e-12))) AS kl, count(*) AS k FROM m GROUP BY ALL)
SELECT listing_id, round(1 - least(1, greatest(0, avg(kl) / ln(max(k)))), 6) AS stability FROM k GROUP BY listing_id""")
def q44(s, d):
    return decisions.stability(_passes(s, d), ["listing_id"], "pass").select("listing_id", _r(F.col("stability")).alias("stability"))


@query("q45_fused_evidence", f"""WITH {_OPTIONS}, {_PASSES}, s AS (SELECT listing_id, option, CASE WHEN pass = 0 THEN 0.55 ELSE 0.45 END AS w, 0.8 * p AS en, 0.2 AS ne, 0.8 * (1 - p) AS co FROM p),
a AS (SELECT *, ln(greatest(en, 1e-9)) - ln(greatest(co, 1e-9)) AS o FROM s) SELECT listing_id, option, round(sum(w * o) / sum(w), 6) AS log_odds, round(0.8 / (1 + exp(-least(30, greatest(-30, sum(w * o) / sum(w))))), 6) AS entailment FROM a GROUP BY listing_id, option""")
def q45(s, d):
    p = _passes(s, d)
    e = p.select("listing_id", "option", F.when(F.col("pass") == 0, 0.55).otherwise(0.45).alias("weight"), (0.8 * F.col("p")).alias("entailment"), F.lit(0.2).alias("neutral"), (0.8 * (1 - F.col("p"))).alias("contradiction"))
    f = decisions.fuse_evidence(e, ["listing_id", "option"])
    return f.select("listing_id", "option", _r(F.col("log_odds")).alias("log_odds"), _r(F.col("entailment")).alias("entailment"))


@query("q46_label_parsing", """SELECT listing_id, CASE WHEN lower(trim(human_bait)) IN ('1','true','yes','y','بله','بلی','آره') THEN 'yes' WHEN lower(trim(human_bait)) IN ('0','false','no','n','خیر','نه') THEN 'no' END AS bait,
 nullif(trim(human_disposition), '') AS disposition, CASE WHEN CAST(trunc(try_cast(trim(human_consistency_level) AS DOUBLE)) AS INT) BETWEEN 0 AND 4 THEN CAST(CAST(trunc(try_cast(trim(human_consistency_level) AS DOUBLE)) AS INT) AS VARCHAR) END AS level FROM human_label""")
def q46(s, d):
    return table(s, d, "human_label").select("listing_id", L.label_bool(F.col("human_bait")).alias("bait"), L.label_choice(F.col("human_disposition")).alias("disposition"), L.label_level(F.col("human_consistency_level")).alias("level"))


@query("q47_scored_requests")
def q47(s, d):
    requests = table(s, d, "human_label").select("listing_id", F.coalesce("human_notes", F.lit("")).alias("state"))
    dimension = decisions.transport(s, {"disposition": ["publish", "review", "reject"], "consistency": ["0", "1", "2", "3", "4"]}, 2)
    pairs = decisions.compile_requests(requests, dimension)
    return decisions.score_pairs(pairs, decisions.LexicalScorer, ["listing_id", "question", "pass", "option"])


@query("q50_temperature_fit")
def q50(s, d):
    samples = calibrate.samples(calibrate.labelled(_answers(s, d), _labels(s, d), "listing_id"), "listing_id")
    t, loss = calibrate.fit_temperature(samples)
    return s.createDataFrame([("disposition", t, loss)], "question string, temperature double, loss double")


_CASES = f"""{_OPTIONS}, g AS (SELECT *, nullif(trim(human_disposition), '') AS target FROM o), k AS (SELECT * FROM g WHERE target IN ('publish', 'review', 'reject') AND p IS NOT NULL),
c AS (SELECT listing_id, any_value(decision_abstain) AS ab, arg_max(option, p - option_idx * 1e-13) AS winner, max(p) AS conf, any_value(target) AS target,
 sum(CASE WHEN option = target THEN -ln(greatest(p, 1e-12)) END) AS nll, avg((p - (option = target)::INT) ** 2) AS brier FROM k GROUP BY listing_id), h AS (SELECT *, (winner = target)::INT AS ok FROM c)"""


@query("q51_evaluation", f"""WITH {_CASES}, b AS (SELECT least(9, floor(round(conf, 9) * 10)) AS bin, sum(ok) AS c, sum(conf) AS s FROM h GROUP BY 1)
SELECT count(*) AS n, round(avg(ok), 6) AS accuracy, round(avg(nll), 6) AS nll, round(avg(brier), 6) AS brier, round((SELECT sum(abs(c - s)) FROM b) / count(*), 6) AS ece,
 round(avg((NOT coalesce(ab, false))::INT), 6) AS coverage, round(avg(CASE WHEN NOT coalesce(ab, false) THEN ok END), 6) AS selective_accuracy FROM h""")
def q51(s, d):
    cases = calibrate.case_metrics(calibrate.labelled(_answers(s, d), _labels(s, d), "listing_id"), "listing_id")
    out = calibrate.summary(cases, table(s, d, "human_label").select("listing_id", F.col("decision_abstain").alias("abstain")))
    return out.select("n", *[_r(F.col(c)).alias(c) for c in ("accuracy", "nll", "brier", "ece", "coverage", "selective_accuracy")])


@query("q52_soft_targets", """WITH b AS (SELECT listing_id, nullif(trim(human_disposition), '') AS d, greatest(0.5, least(1.0, coalesce(try_cast(human_label_confidence AS DOUBLE), 1.0))) AS c FROM human_label)
SELECT listing_id, x.o AS option, round(CASE WHEN x.o = d THEN c ELSE (1 - c) / 2 END, 6) AS p FROM b, (VALUES ('publish'), ('review'), ('reject')) x(o) WHERE d IN ('publish', 'review', 'reject')""")
def q52(s, d):
    t = table(s, d, "human_label").withColumn("label", L.label_choice(F.col("human_disposition")))
    g = calibrate.soft_targets(t, ["publish", "review", "reject"], "label", "human_label_confidence").where("gold is not null")
    return g.select("listing_id", F.explode("gold").alias("option", "p")).select("listing_id", "option", _r(F.col("p")).alias("p"))


# ---------------------------------------------------------------- fusion and reports


@query("q60_channels")
def q60(s, d):
    keep = ["listing_id", "prefilter_score", "data_problem_score", "market_outlier_score", "misleading_risk_score", "uncertainty_score", "review_priority_score", "risk_band", "flag_reasons"]
    return P.scored(table(s, d, "listing")).select(*keep)


@query("q61_review_queue")
def q61(s, d):
    return P.review_queue(P.scored(table(s, d, "listing")))


@query("q62_histogram", f"""WITH {_CLEAN} SELECT CAST(least(24, floor(area_m2 / 20)) AS INT) AS bin, count(*) AS n FROM l WHERE area_m2 BETWEEN 0 AND 500 GROUP BY 1""")
def q62(s, d):
    return relational.histogram(_listing(s, d), "area_m2", 0.0, 500.0, 25)


@query("q63_unpivot", f"""WITH {_CLEAN} SELECT listing_id, 'area_m2' AS field_name, area_m2 AS number FROM l UNION ALL SELECT listing_id, 'rooms', rooms FROM l UNION ALL SELECT listing_id, 'year_built_shamsi', year_built_shamsi FROM l""")
def q63(s, d):
    return relational.unpivot(_listing(s, d).select("listing_id", *impute.FIELDS), ["listing_id"], list(impute.FIELDS), "field_name", "number")


@query("q64_source_counts", f"""WITH {_CLEAN} SELECT source, count(*) AS n, CAST(sum((deposit_toman IS NULL)::INT) AS BIGINT) AS no_deposit, count(DISTINCT nullif(trim(neighborhood), '')) AS neighborhoods FROM l GROUP BY source""")
def q64(s, d):
    return _listing(s, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("deposit_toman").isNull()).alias("no_deposit"), F.countDistinct(F.nullif(F.trim("neighborhood"), F.lit(""))).alias("neighborhoods"))


@query("q65_money_text", f"""WITH {_CLEAN} SELECT listing_id, CASE WHEN deposit_toman IS NULL THEN '—' WHEN abs(deposit_toman) >= 1e9 THEN printf('%.2f', deposit_toman / 1e9) || ' B' WHEN abs(deposit_toman) >= 1e6 THEN printf('%.1f', deposit_toman / 1e6) || ' M' ELSE '' END AS said FROM l""")
def q65(s, d):
    x = F.col("deposit_toman")
    return _listing(s, d).select("listing_id", F.when(x.isNull() | (F.abs(x) >= 1e6), L.money(x)).otherwise("").alias("said"))


@query("q70_event_windows", """SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def q70(s, d):
    from tessera.streaming.events import windowed

    return windowed(table(s, d, "events"), "1 day").select("event_type", F.col("window.start").alias("day"), "n", _r(F.col("total"), 4).alias("total"))


@query("q66_district_matches")
def q66(s, d):
    from tessera.sources.districts import resolve

    return resolve(table(s, d, "listing"), "neighborhood", table(s, d, "district"))


@query("q71_normalized_records")
def q71(s, d):
    from tessera.sources import raw

    return raw.normalize(table(s, d, "raw_record"), "record_id")


@query("q72_blank_hints", """SELECT record_id, CASE WHEN json_valid(card) THEN card->>'$.token' END AS token, CASE WHEN json_valid(card) THEN card->>'$.district' END AS district FROM raw_record""")
def q72(s, d):
    t = table(s, d, "raw_record")
    return t.select("record_id", F.get_json_object("card", "$.token").alias("token"), F.get_json_object("card", "$.district").alias("district"))


@query("q73_clean_rooms_pivot", f"""WITH {_CLEAN} SELECT source, count(*) FILTER (WHERE rooms = 1) AS r1, count(*) FILTER (WHERE rooms = 2) AS r2, count(*) FILTER (WHERE rooms = 3) AS r3 FROM l WHERE source IS NOT NULL GROUP BY source""")
def q73(s, d):
    return _listing(s, d).where("source is not null").groupBy("source").agg(*[F.count_if(F.col("rooms") == n).alias(f"r{n}") for n in (1, 2, 3)])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review queue's scores of every listing."""
    return q60(spark, sf_dir)
