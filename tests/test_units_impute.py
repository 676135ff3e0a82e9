"""Unit graph, source units, and filling of gaps."""

import random

import pytest

from tessera.operators import impute, units

UNITS = [("toman", "price", 1.0), ("rial", "price", 0.1), ("thousand_toman", "price", 1e3), ("million_toman", "price", 1e6), ("billion_toman", "price", 1e9), ("m2", "area", 1.0), ("sqft", "area", 0.09290304), ("sqyd", "area", 0.83612736), ("are", "area", 100.0)]
SCHEMA = "listing_id long, title string, description string, neighborhood string, area_m2 double, rooms double, year_built_shamsi double, deposit_toman double, rent_monthly_toman double, structured_fields_json string, price_unit string, area_unit string, building_code string"


@pytest.fixture(scope="module")
def unit_ref(spark):
    return spark.createDataFrame(UNITS, "unit_code string, measure string, to_common double")


def rows(spark, *changes):
    base = dict(listing_id=0, title=None, description=None, neighborhood="n", area_m2=None, rooms=2.0, year_built_shamsi=1390.0, deposit_toman=None, rent_monthly_toman=None, structured_fields_json=None, price_unit=None, area_unit=None, building_code=None)
    names = list(base)
    return spark.createDataFrame([tuple((base | {"listing_id": i} | c)[n] for n in names) for i, c in enumerate(changes)], SCHEMA)


def test_compositions_and_cycles():
    edges = [units.Edge("c", "k", 1.0, 273.15), units.Edge("f", "c", 5 / 9, -160 / 9)]
    table = {e.source: e for e in units.compositions(edges, {"k"})}
    assert table["f"].scale * 212 + table["f"].offset == pytest.approx(373.15)
    units.compositions([*edges, units.Edge("f", "k", 5 / 9, 273.15 - 160 / 9)], {"k"})
    with pytest.raises(ValueError):
        units.compositions([*edges, units.Edge("f", "k", 0.5, 250.0)], {"k"})
    with pytest.raises(ValueError):
        units.compositions([units.Edge("a", "b", 0.0, 0.0)], {"b"})


def test_source_units(spark, unit_ref):
    df = rows(
        spark,
        {"deposit_toman": 15_900_000_000.0, "description": "پول پيش ١٥.٩ ميليارد ريال و اجاره ٥٠٠ ميليون ريال است.", "rent_monthly_toman": 50_000_000.0},
        {"deposit_toman": 690.0, "structured_fields_json": '{"ودیعه": "۶۹۰ میلیون تومن"}', "area_m2": 1152.0, "area_unit": "ft²"},
        {"deposit_toman": 1_510_000_000.0, "description": "ودیعه ۱ میلیارد و ۵۱۰ میلیون تو​مان است", "area_m2": 0.58},
        {"deposit_toman": 0.0, "rent_monthly_toman": float("nan"), "area_m2": 9999.0},
        {"deposit_toman": 735_000.0, "rent_monthly_toman": 17.0, "area_m2": 107.0, "price_unit": "kT"},
        {"deposit_toman": 7.4e9, "price_unit": "IRR", "structured_fields_json": "{broken", "description": ""},
        {"deposit_toman": 7.4e9, "area_m2": 12.0, "rooms": 0.0},
        {"deposit_toman": 13.2e9, "rent_monthly_toman": 4.1e8, "description": "deposit 13.2 billion rials and monthly rent IRR 410,000,000", "area_m2": 850.0, "title": "x"},
    )
    got = {(r.listing_id, r.field_name): (r.unit, r.common_value) for r in units.convert(df, unit_ref).collect()}
    want = {
        (0, "deposit_toman"): ("rial", 1.59e9), (0, "rent_monthly_toman"): ("toman", 5e7), (1, "deposit_toman"): ("million_toman", 6.9e8), (1, "area_m2"): ("sqft", 1152 * 0.09290304),
        (2, "deposit_toman"): ("toman", 1.51e9), (2, "area_m2"): ("are", 58.0), (3, "deposit_toman"): (None, None), (3, "rent_monthly_toman"): (None, None), (3, "area_m2"): (None, None),
        (4, "deposit_toman"): ("thousand_toman", 7.35e8), (4, "rent_monthly_toman"): ("million_toman", 1.7e7), (4, "area_m2"): ("m2", 107.0), (5, "deposit_toman"): ("rial", 7.4e8),
        (6, "deposit_toman"): ("toman", 7.4e9), (6, "area_m2"): ("m2", 12.0), (7, "deposit_toman"): ("rial", 1.32e9), (7, "rent_monthly_toman"): ("rial", 4.1e7), (7, "area_m2"): ("sqft", 850 * 0.09290304),
    }
    for key, (unit, value) in want.items():
        assert got[key][0] == unit and (value is None or got[key][1] == pytest.approx(value)), (key, got[key])
    assert len(got) == 24 and units.convert(df.limit(0), unit_ref).count() == 0


def test_filling(spark, unit_ref):
    rng = random.Random(3)
    made, truth = [], {}
    for i in range(600):
        b = i // 6
        area = 50.0 + b + rng.random()
        row = {"listing_id": i, "building_code": f"B{b}" if b % 5 else None, "neighborhood": f"n{b % 7}", "area_m2": round(area, 1), "rooms": float(int(area // 40)), "year_built_shamsi": 1360.0 + b % 40, "deposit_toman": area * 1e7}
        if i % 10 == 3:
            truth[i] = row["year_built_shamsi"]
            row["year_built_shamsi"] = [None, -1.0, 0.0, 1111.0, 9999.0, float("nan")][i % 6]
        if i % 10 == 7:
            row["rooms"] = [None, 99.0, -1.0][i % 3]
        made.append(row)
    out = {(r.listing_id, r.field_name): r for r in impute.matched(rows(spark, *made), unit_ref).collect()}
    assert {k for k in out} == {(i, "year_built_shamsi") for i in truth} | {(i, "rooms") for i in range(600) if i % 10 == 7}
    by_id = {r["listing_id"]: r for r in made}
    for (i, field), r in out.items():
        assert r.filled and r.donor_id != i and by_id[r.donor_id][field] == r.filled_value
    same_building = [i for i in truth if by_id[i]["building_code"]]
    assert all(out[i, "year_built_shamsi"].filled_value == truth[i] for i in same_building)
    wide = impute.fill(rows(spark, *made), unit_ref)
    assert wide.where("year_built_shamsi is null or rooms is null").count() == 0 and wide.where("rooms_filled").count() == 60


def test_nearest_donor_of_large_groups(spark, unit_ref, monkeypatch):
    monkeypatch.setattr(impute, "PART_ROWS", 48)  # groups of 900 rows have many parts
    rng = random.Random(5)
    made = []
    for i in range(900):
        area = 40.0 + 100 * rng.random()
        # every fourth row has nothing to tell it from others: equal predictions
        row = {"listing_id": i, "neighborhood": f"n{i % 2}" if i % 3 else None, "area_m2": area if i % 4 else None, "rooms": float(int(area // 25)), "year_built_shamsi": float(1350 + i % 50), "deposit_toman": area * 1e7 if i % 4 else None}
        if i % 7 == 3:
            row["year_built_shamsi"] = None
        if i % 9 == 4:
            row["rooms"] = None
        made.append(row)
    df = rows(spark, *made)
    predicted = {r.id: r for r in impute.predictions(impute._base(df, unit_ref, "listing_id")).collect()}
    out = {(r.listing_id, r.field_name): r for r in impute.matched(df, unit_ref).collect()}
    checked = 0
    for (i, field), r in out.items():
        me = predicted[i]
        group = [p for p in predicted.values() if p[field] is not None and (r.donor_group == "all" or p[r.donor_group] == me[r.donor_group])]
        near = min(group, key=lambda p: (abs(p[f"p_{field}"] - me[f"p_{field}"]), p.id))
        assert r.donor_id == near.id, (i, field, r.donor_group)
        checked += 1
    assert checked > 400 and {r.donor_group for r in out.values()} == {"all", "neighbourhood"}


def test_filling_without_donors(spark, unit_ref):
    out = impute.matched(rows(spark, {"rooms": None, "year_built_shamsi": None}, {"rooms": None, "neighborhood": None}), unit_ref).collect()
    assert len(out) == 5 and {r.field_name for r in out if not r.filled} == {"area_m2", "rooms"}
    assert impute.matched(rows(spark, {}).limit(0), unit_ref).count() == 0


def test_filled_tables_have_one_unit(spark, unit_ref):
    made = [{"listing_id": i, "neighborhood": "n", "area_m2": a, "area_unit": u, "rooms": 2.0, "year_built_shamsi": 1390.0} for i, (a, u) in enumerate([(1076.391, "sqft"), (100.0, "m2"), (1.0, "are"), (None, None), (9999.0, None), (99999.0, None)])]
    got = {r.listing_id: r for r in impute.fill(rows(spark, *made), unit_ref).collect()}
    assert all(r.area_m2 == pytest.approx(100.0, rel=1e-4) for r in got.values()) and [i for i, r in sorted(got.items()) if r.area_m2_filled] == [3, 4, 5]


def test_units_added_and_left_out(spark, unit_ref):
    more = unit_ref.where("unit_code != 'sqyd'").unionByName(spark.createDataFrame([("hectare", "area", 10_000.0)], "unit_code string, measure string, to_common double"))
    made = [{"listing_id": 1, "area_m2": 0.5, "area_unit": "Hectare"}, {"listing_id": 2, "area_m2": 90.0, "area_unit": "sq yd"}]
    got = {r.listing_id: (r.unit, r.common_value) for r in units.convert(rows(spark, *made), more).where("field_name = 'area_m2'").collect()}
    assert got == {1: ("hectare", 5000.0), 2: ("m2", 90.0)}
