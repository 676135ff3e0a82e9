"""Filling missing values from similar records by predictive mean matching (p3).

A predictor for each field takes the mean of the record's group (building, shrunk towards its neighbourhood, shrunk towards all)
and adds the within-group effect of the other fields, fitted over all complete records. Every cell without a real value then takes
the observed value of a donor of its group whose prediction lies nearest; the donor's id comes with it.

Groups may hold any share of the rows: their statistics are sums combined before the shuffle, and large groups are searched in
parts of bounded size, cut by prediction. The nearest donors of the other parts are carried across their borders, so that every cell
gets the nearest donor of its whole group. All records are donors.

Real values are positive and finite, areas aren't numbers of nines only (stand-ins for unknown), and years lie in YEARS; 0 rooms is real. A field nobody reports stays
unfilled (null value and donor) but its cells are still listed. Equally near donors: the smaller id wins. Repeated ids fill alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.chars import plain_text
from tessera.operators.units import conversion_table, source_units
from tessera.session import cut_lineage, small_or_shuffled

FIELDS = ("area_m2", "rooms", "year_built_shamsi")
# Bounds of real values, and digits from which a number of nines only is a stand-in.
YEARS = (1200, 1450)
LEAST_NINES = 4
MOST_ROOMS = 60
#: Other fields that the prediction of a field uses.
PREDICTORS = {"area_m2": ("rooms", "price"), "rooms": ("area_m2", "price"), "year_built_shamsi": ("price", "area_m2")}
VARIABLES = (*FIELDS, "price")
#: Observed values from which a building or neighbourhood gives its own donors, and weights of the wider group's mean.
DONORS = {"building": 3, "neighbourhood": 10}
SHRINK = {"building": 3.0, "neighbourhood": 5.0}
#: Rows that one part of a group holds when donors are searched, and rows of the sample that cuts the parts from which one part is told.
PART_ROWS = 20_000
PART_SAMPLE = 16
#: What donors are searched in.
GROUP = ["field", "level", "group"]


def real_value(field: str, value: Column) -> Column:
    """The value of a field where it can be real, else null."""
    v = value.cast("double")
    if field == "area_m2":
        ok = (v > 0) & ~(v + 1).isin([10.0**k for k in range(LEAST_NINES, 16)])
    elif field == "rooms":
        ok = (v >= 0) & (v <= MOST_ROOMS)
    else:
        ok = v.between(*YEARS)
    return F.when(~F.isnan(v) & (F.abs(v) < 1e18) & ok, v)


def _base(listings: DataFrame, unit_ref: DataFrame, id_col: str) -> DataFrame:
    """Fields and predictors of each record in common units, its groups, and the stored fields."""
    edges = conversion_table(listings.sparkSession, unit_ref)
    scale = F.create_map(*[F.lit(x) for e in edges for x in (e.source, F.struct(F.lit(e.scale).alias("scale"), F.lit(e.offset).alias("offset")))])
    kept = {"_building": F.col("building_code"), "_near": plain_text(F.col("neighborhood"))} | {f"_raw_{f}": F.col(f).cast("double") for f in FIELDS}
    cells = source_units(listings, edges, id_col, kept)

    def common(i: int) -> Column:
        cell = F.get("cells", F.lit(i))
        way = F.try_element_at(scale, cell["unit"])
        return cell["value"] * way["scale"] + way["offset"]

    area = F.when(real_value("area_m2", F.col("_raw_area_m2")).isNotNull(), common(2))
    paid = F.coalesce(common(0), F.lit(0.0)) + 30 * F.coalesce(common(1), F.lit(0.0))
    alone = F.concat(F.lit("~"), F.col(id_col).cast("string"))  # records without a group stand alone: no null group gathers them
    return cells.select(
        F.col(id_col).alias("id"), F.coalesce(F.nullif("_building", F.lit("")), alone).alias("building"), F.coalesce(F.nullif(F.trim("_near"), F.lit("")), alone).alias("neighbourhood"),
        *[F.col(f"_raw_{f}") for f in FIELDS], F.ln(area).alias("area_m2"), area.alias("_area"), *[real_value(f, F.col(f"_raw_{f}")).alias(f) for f in FIELDS[1:]],
        F.when(paid > 0, F.ln(paid)).alias("price"),
    )


def _group_sums(base: DataFrame, level: str) -> DataFrame:
    """Counts and sums of every variable in each group of two records or more."""
    sums = [x for v in VARIABLES for x in (F.count(v).alias(f"_n_{level}_{v}"), F.sum(v).alias(f"_s_{level}_{v}"))]
    return base.where(~F.col(level).startswith("~")).groupBy(level).agg(*sums)


def predictions(base: DataFrame) -> DataFrame:
    """Adds p_<field>, the prediction of each field, and n_<level>_<field>, the observed values of its groups."""
    overall = base.agg(*[F.avg(v).alias(v) for v in VARIABLES]).first()
    joined = base.join(_group_sums(base, "building"), "building", "left").join(_group_sums(base, "neighbourhood"), "neighbourhood", "left")
    means = {}
    for v in VARIABLES:
        mean = F.lit(float(overall[v] or 0.0))
        for level in ("neighbourhood", "building"):
            n, s = F.coalesce(f"_n_{level}_{v}", F.lit(0)), F.coalesce(f"_s_{level}_{v}", F.lit(0.0))
            mean = (s + SHRINK[level] * mean) / (n + SHRINK[level])
        means[v] = mean
    counts = [F.coalesce(f"_n_{level}_{f}", F.lit(0)).alias(f"n_{level}_{f}") for level in DONORS for f in FIELDS]
    centred = cut_lineage(joined.select(*base.columns, *counts, *[m.alias(f"_m_{v}") for v, m in means.items()]))
    # within-group effects: two predictors for each field, normal equations summed over all complete records
    sums = []
    for y, (u, w) in PREDICTORS.items():
        dy, du, dw = (F.col(v) - F.col(f"_m_{v}") for v in (y, u, w))
        whole = dy.isNotNull() & du.isNotNull() & dw.isNotNull()
        sums += [F.sum(F.when(whole, e)).alias(f"{y}_{k}") for k, e in (("uu", du * du), ("uw", du * dw), ("ww", dw * dw), ("uy", du * dy), ("wy", dw * dy))]
    total = centred.agg(*sums).first()
    out = []
    for y, (u, w) in PREDICTORS.items():
        uu, uw, ww, uy, wy = (float(total[f"{y}_{k}"] or 0.0) for k in ("uu", "uw", "ww", "uy", "wy"))
        uu, ww = uu * 1.001 + 1e-9, ww * 1.001 + 1e-9
        det = uu * ww - uw * uw
        bu, bw = (uy * ww - wy * uw) / det, (wy * uu - uy * uw) / det
        du, dw = (F.coalesce(F.col(v) - F.col(f"_m_{v}"), F.lit(0.0)) for v in (u, w))
        out.append((F.col(f"_m_{y}") + bu * du + bw * dw).alias(f"p_{y}"))
    return centred.select("*", *out)


def _parts(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The rows with code (of groups of more than PART_ROWS rows, else null) and part: no prediction of a part lies above one of a
    later part; and whether any group has several.

    Borders are taken from a sample by id. Rows that share their prediction with several borders are spread over the parts between.
    """
    sizes = rows.groupBy(*GROUP).agg(F.count("*").alias("n")).where(F.col("n") > PART_ROWS).select(*GROUP)
    codes = cut_lineage(sizes.withColumn("code", F.monotonically_increasing_id()))  # fewer than one for PART_ROWS rows
    every = max(1, PART_ROWS // PART_SAMPLE)
    sampled = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(every)) == 0).join(F.broadcast(codes), GROUP).select("code", "p", "id")
    numbered = sampled.withColumn("i", F.row_number().over(Window.partitionBy("code").orderBy("p", "id")))
    borders: dict[int, list[float]] = {}
    for r in numbered.where(F.col("i") % PART_SAMPLE == 0).orderBy("code", "i").select("code", "p").collect():  # one for each part
        borders.setdefault(r.code, []).append(r.p)

    @F.arrow_udf("int")
    def part(code: pa.Array, p: pa.Array, mixed: pa.Array) -> pa.Array:
        at, x, h = code.to_numpy(zero_copy_only=False), p.to_numpy(zero_copy_only=False), mixed.to_numpy(zero_copy_only=False)
        out = np.zeros(len(at), np.int32)
        for c in np.unique(at):
            if c in borders:
                mine = np.flatnonzero(at == c)
                first, last = (np.searchsorted(borders[c], x[mine], side) for side in ("left", "right"))
                out[mine] = first + h[mine] % (last - first + 1)
        return pa.array(out)

    if not borders:
        return rows.withColumn("part", F.lit(0)), False
    mixed = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30))
    return rows.join(F.broadcast(codes), GROUP, "left").withColumn("part", part(F.coalesce("code", F.lit(-1)), "p", mixed)), True


def _neighbours(rows: DataFrame) -> DataFrame:
    """The wanting rows with below and above: (p, id, value) of the nearest donors of their group on either side, the smaller id of equally near ones."""
    parted, several = _parts(rows)
    donor = F.when(~F.col("wanting"), F.struct("p", "id", "value"))
    parts = Window.partitionBy(*GROUP, "part")
    below = F.last(donor, ignorenulls=True).over(parts.orderBy("p", "wanting", F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0))
    above = F.last(donor, ignorenulls=True).over(parts.orderBy(F.col("p").desc(), "wanting", F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0))
    near = parted.withColumn("below", below).withColumn("above", above).where("wanting")
    if not several:
        return near
    # lowest and highest donor of each part (smallest id), then the nearest ones of all parts before and after
    ids = parted.where("code is not null").groupBy("code", "part", "p").agg(F.min(F.when(~F.col("wanting"), F.struct("id", "value"))).alias("d"))
    whole = F.when(F.col("d").isNotNull(), F.struct("p", F.col("d.id").alias("id"), F.col("d.value").alias("value")))
    ends = cut_lineage(ids.groupBy("code", "part").agg(F.min(whole).alias("low"), F.max(whole).alias("high")))  # one row for each part of large groups
    before = Window.partitionBy("code").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("code").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("high.p").over(before)
    ends = ends.withColumn("top", top).withColumn("next", F.min("low").over(after))
    # equal predictions may end several parts
    others = ends.select("code", F.col("high.p").alias("top"), F.col("part").alias("_part"), F.col("high").alias("_high"))
    lasts = ends.join(others, ["code", "top"]).where("_part < part").groupBy("code", "part").agg(F.min("_high").alias("previous"))
    carried = ends.select("code", "part", "next").join(lasts, ["code", "part"], "left")
    joined = near.join(small_or_shuffled(cut_lineage(carried)), ["code", "part"], "left")
    own, other = F.col("below"), F.col("previous")
    nearer = own.isNotNull() & (other.isNull() | (own["p"] > other["p"]) | ((own["p"] == other["p"]) & (own["id"] <= other["id"])))
    return joined.withColumn("below", F.when(nearer, own).otherwise(other)).withColumn("above", F.least("above", "next"))


def matched(listings: DataFrame, unit_ref: DataFrame, id_col: str = "listing_id") -> DataFrame:
    """(id, field_name, stored, filled_value, donor_id, donor_group, filled) of every cell that holds no real value."""
    return _matched(cut_lineage(_base(listings, unit_ref, id_col)), id_col)


def _matched(base: DataFrame, id_col: str) -> DataFrame:
    predicted = predictions(base)
    cells = F.explode(F.array(*[
        F.struct(
            F.lit(f).alias("field"), F.col(f"_raw_{f}").alias("stored"), F.col(f"p_{f}").alias("p"), (F.col("_area") if f == "area_m2" else F.col(f)).alias("value"),
            F.col(f"n_building_{f}").alias("nb"), F.col(f"n_neighbourhood_{f}").alias("nn"),
        )
        for f in FIELDS
    ]))
    long = predicted.select("id", "building", "neighbourhood", cells.alias("c")).select("id", "building", "neighbourhood", "c.*")
    level = F.when(F.col("nb") >= DONORS["building"], "building").when(F.col("nn") >= DONORS["neighbourhood"], "neighbourhood").otherwise("all")
    group = F.when(F.col("level") == "building", F.col("building")).when(F.col("level") == "neighbourhood", F.col("neighbourhood")).otherwise(F.lit(""))
    long = cut_lineage(long.withColumn("level", level).withColumn("group", group))
    missing = long.where("value is null").select("field", "level", "group", "id", "p", "stored", F.lit(None).cast("double").alias("value"), F.lit(True).alias("wanting"))
    asked = missing.groupBy("field", "level", "group").agg(F.count("*").alias("n_wanting"))
    as_donor = F.explode(F.array(F.struct(F.lit("building").alias("level"), F.col("building").alias("group")), F.struct(F.lit("neighbourhood").alias("level"), F.col("neighbourhood").alias("group")), F.struct(F.lit("all").alias("level"), F.lit("").alias("group"))))
    donors = long.where("value is not null").select("field", "id", "p", "value", as_donor.alias("g")).select("field", "g.level", "g.group", "id", "p", "value")
    useful = donors.join(asked, ["field", "level", "group"], "left_semi")
    rows = missing.unionByName(useful.select(*GROUP, "id", "p", F.lit(None).cast("double").alias("stored"), "value", F.lit(False).alias("wanting")))
    near = _neighbours(rows)
    down, up = F.abs(F.col("p") - F.col("below.p")), F.abs(F.col("above.p") - F.col("p"))
    best = F.when(F.col("above").isNull() | (down < up) | ((down == up) & (F.col("below.id") <= F.col("above.id"))), F.col("below")).otherwise(F.col("above"))
    chosen = near.withColumn("best", best)
    return chosen.select(F.col("id").alias(id_col), F.col("field").alias("field_name"), "stored", F.col("best.value").alias("filled_value"), F.col("best.id").alias("donor_id"), F.col("level").alias("donor_group"), F.col("best").isNotNull().alias("filled"))


def fill(listings: DataFrame, unit_ref: DataFrame, id_col: str = "listing_id") -> DataFrame:
    """The records' id and fields with gaps filled, <field>_filled flags and donor ids; every area in square metres, observed or filled."""
    base = cut_lineage(_base(listings, unit_ref, id_col))
    found = _matched(base, id_col)
    wide = found.groupBy(id_col).agg(*[F.max(F.when(F.col("field_name") == f, F.struct("filled_value", "donor_id"))).alias(f"_{f}") for f in FIELDS])
    observed = base.select(F.col("id").alias(id_col), F.col("_area").alias("area_m2"), *FIELDS[1:])
    joined = observed.join(wide, id_col, "left")
    out = [F.col(id_col)]
    for f in FIELDS:
        out += [F.coalesce(f, f"_{f}.filled_value").alias(f), F.col(f"_{f}").isNotNull().alias(f"{f}_filled"), F.col(f"_{f}.donor_id").alias(f"{f}_donor")]
    return joined.select(*out)
