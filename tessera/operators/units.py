"""Quantities recorded in different units (p5): conversions as a graph, source units from labels, texts and magnitudes.

Units are nodes, conversions are edges with an affine function; shortest compositions to the canonical unit of each measure are
computed once, and every cycle is checked to give back what it was given. The table has one row for each unit, so the equi-join
on (unit, canonical unit) is a broadcast of fixed size.

The source unit of a stored number comes from the first of these that speaks: a quantity with unit in the shown fields or
the description (the ratio to the stored number names its unit; ratio 1 clears it), the label beside the number, the same
evidence for the sibling price, the bounds of real homes. A plausible number that nothing contradicts is canonical.
Null, NaN, zero, negative and stand-in values stay as they are and are never converted; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections import deque
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.chars import plain_text

CANONICAL = {"price": "toman", "area": "m2"}
# Spellings of unit labels.
LABELS = {
    "toman": ["toman", "tmn", "irt", "تومان", "تومن"],
    "rial": ["rial", "rials", "irr", "rls", "ریال", "ریال ایران"],
    "thousand_toman": ["k toman", "kt", "thousand toman", "هزار تومان", "هزار تومن", "هزارتومان", "هزارتومن"],
    "million_toman": ["mio toman", "mt", "m toman", "million toman", "م ت", "میلیون", "میلیون تومان", "میلیون تومن"],
    "billion_toman": ["bn toman", "billion toman", "میلیارد", "میلیارد تومان", "میلیارد تومن"],
    "m2": ["m2", "m²", "sqm", "sq m", "متر", "متر مربع", "مترمربع"],
    "sqft": ["sq ft", "sqft", "sf", "ft²", "ft2", "فوت مربع", "فوت"],
    "sqyd": ["sq yd", "yd²", "yd2", "sqyd", "یارد مربع", "یارد"],
    "are": ["a", "are", "ares", "آر"],
}
# Multiples that texts use, as edges to a unit of the reference table.
TEXT_EDGES = [("thousand_rial", "rial", 1e3, 0.0), ("million_rial", "rial", 1e6, 0.0), ("billion_rial", "rial", 1e9, 0.0)]
# Bounds of real homes, and stand-ins for a missing area.
LEAST = {"deposit_toman": 20e6, "rent_monthly_toman": 1e6}
STAND_IN_AREAS = (9999.0,)


class Edge(NamedTuple):
    """target = scale * source + offset."""

    source: str
    target: str
    scale: float
    offset: float


def compositions(edges: list[Edge], targets: set[str], tolerance: float = 1e-9) -> list[Edge]:
    """Shortest composition from every unit that reaches a target; raises if two ways around a cycle disagree."""
    ways: dict[str, list[Edge]] = {}
    for e in edges:
        if e.scale == 0:
            raise ValueError(f"conversion from {e.source} to {e.target} can't be undone")
        ways.setdefault(e.target, []).append(e)
        ways.setdefault(e.source, []).append(Edge(e.target, e.source, 1 / e.scale, -e.offset / e.scale))
    out = []
    for target in sorted(targets):
        done = {target: (1.0, 0.0)}
        queue = deque([target])
        while queue:
            at = queue.popleft()
            a, b = done[at]
            for e in ways.get(at, []):  # e.source -> at
                composed = (a * e.scale, a * e.offset + b)
                if e.source not in done:
                    done[e.source] = composed
                    queue.append(e.source)
                elif any(abs(x - y) > tolerance * max(1.0, abs(x), abs(y)) for x, y in zip(done[e.source], composed)):
                    raise ValueError(f"conversions from {e.source} to {target} disagree: {done[e.source]} and {composed}")
        out += [Edge(unit, target, a, b) for unit, (a, b) in sorted(done.items())]
    return out


def conversion_table(spark: SparkSession, unit_ref: DataFrame) -> list[Edge]:
    """Compositions of the reference table (one row for each unit, fixed) and the multiples used in texts."""
    rows = unit_ref.select("unit_code", "measure", "to_common").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a unit table holds at most 1000 units")
    edges = [Edge(r.unit_code, CANONICAL[r.measure], float(r.to_common), 0.0) for r in rows]
    return compositions(edges + [Edge(*e) for e in TEXT_EDGES], set(CANONICAL.values()))


_NUMBER = r"[0-9۰-۹٠-٩０-９][0-9۰-۹٠-٩０-９.,٫٬]*"
_GAP = r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}]*"
_SCALE = r"(?:م[یي]ل[یي]ارد|م[یي]ل[یي]ون|هزار|million|billion|thousand|bn|m|k)?"
_MONEY = rf"{_GAP}(?:IRR)?{_GAP}{_NUMBER}{_GAP}{_SCALE}{_GAP}(?:و{_GAP}{_NUMBER}{_GAP}(?:م[یي]ل[یي]ون|هزار){_GAP})?(?:تومان|تومن|ر[یي]ال|toman|rials?)?"
_ASKED = {
    "deposit_toman": rf"(?:ود[یي]عه|رهن|پول{_GAP}پ[یي]ش|[Dd]eposit:?){_MONEY}",
    "rent_monthly_toman": rf"(?:اجاره|[کك]را[یي]ه|rent:?)(?:{_GAP}ماهانه)?{_MONEY}",
}
_AREA_UNIT = r"(?:فوت(?:[\s\x{a0}\x{200c}]*مربع)?|[یي]ارد(?:[\s\x{a0}\x{200c}]*مربع)?|آر|متر(?:[\s\x{a0}\x{200c}]*مربع)?|sq ?ft|sq ?yd|sqm|ares?|m2|m²)"
_AREA_SAID = rf"(?:متراژ[^0-9۰-۹.،؛]{{0,20}}|[Aa]rea is ){_NUMBER}{_GAP}{_AREA_UNIT}"
_AREA_TITLE = rf"{_NUMBER}{_GAP}(?:متر[یي]|sqm)"
#: Characters that may stand inside the words of a quantity; only texts with one of them are brought to plain form as a whole.
_BROKEN = r"[\x{ad}\x{400}-\x{4ff}\x{200b}\x{200e}\x{200f}\x{2060}\x{fe70}-\x{feff}\x{653}\x{ff41}-\x{ff5a}]"
_SHOWN = {"deposit_toman": "ودیعه", "rent_monthly_toman": "اجاره ماهانه", "area_m2": "متراژ"}


def _numbers(phrase: Column) -> tuple[Column, Column]:
    found = F.regexp_extract_all(F.translate(phrase, ",٬٫", ""), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.try_element_at(found, F.lit(1)).try_cast("double"), F.try_element_at(found, F.lit(2)).try_cast("double")


def _factor(edges: list[Edge], unit: str) -> Column:
    """Scale of a unit to the canonical one of its measure; null for a unit that the reference table doesn't have."""
    return F.lit(next((e.scale for e in edges if e.source == unit), None)).cast("double")


def _units(edges: list[Edge], measure: str) -> list[str]:
    """Units of a measure that numbers may be stored in: those with known spellings first, then further ones of the reference table."""
    held = [e.source for e in edges if e.target == CANONICAL[measure] and e.source not in {t[0] for t in TEXT_EDGES}]
    return [u for u in LABELS if u in held] + [u for u in held if u not in LABELS]


def money(phrase: Column, edges: list[Edge]) -> Column:
    """Amount in toman of a plain phrase such as '1 میلیارد و 510 میلیون تومان'; null without number or currency."""
    p = phrase
    first, second = _numbers(p)
    scale = F.when(p.rlike("میلیارد|billion|bn"), 1e9).when(p.rlike(r"میلیون|million|\dm\b|\d m\b"), 1e6).when(p.rlike(r"هزار|thousand|\dk\b|\d k\b"), 1e3).otherwise(1.0)
    rest = F.when(second.isNull(), 0.0).when(p.rlike("میلیون"), second * 1e6).when(p.rlike("هزار"), second * 1e3).otherwise(0.0)
    currency = F.when(p.rlike("ریال|rial|IRR"), _factor(edges, "rial")).when(p.rlike("تومان|تومن|toman"), 1.0)
    return (first * scale + rest) * currency


def _unit_of(label: Column, units: list[str]) -> Column:
    spelled = F.lower(F.trim(label))
    out = F.lit(None).cast("string")
    for unit in units:
        out = F.when(spelled.isin(LABELS.get(unit, [unit, unit.replace("_", " ")])), unit).otherwise(out)
    return out


def area(phrase: Column, edges: list[Edge], default: str | None = None) -> Column:
    """Square metres of a plain phrase such as '1410 فوت مربع'; without a unit in the default unit, or null."""
    p = phrase
    first, _ = _numbers(p)
    unit = F.when(p.rlike("فوت|sq ?ft"), _factor(edges, "sqft")).when(p.rlike("یارد|sq ?yd"), _factor(edges, "sqyd")).when(p.rlike(r"آر\s*$|ares?\s*$"), _factor(edges, "are")).when(p.rlike("متر|sqm|m2|m²"), 1.0)
    return first * F.coalesce(unit, _factor(edges, default or ""))


def _near(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance * b


def _by_ratio(value: Column, said: Column, units: list[str], edges: list[Edge], tolerance: float) -> Column:
    """The unit in which the stored value equals the said canonical quantity."""
    out = F.lit(None).cast("string")
    for unit in reversed(units):
        out = F.when(_near(value * _factor(edges, unit), said, tolerance), unit).otherwise(out)
    return out


def _real(value: Column, stand_ins: tuple[float, ...] = ()) -> Column:
    """The value where it is a positive number, else null."""
    return F.when((value > 0) & ~F.isnan(value) & ~value.isin([*stand_ins, float("inf")]), value)


def source_units(listings: DataFrame, edges: list[Edge], id_col: str = "listing_id", kept: dict[str, Column] | None = None) -> DataFrame:
    """(id, kept columns, cells ARRAY<STRUCT<field_name, value, unit, evidence>>): price, rent and area of each listing."""
    kept = kept or {}
    text = F.col("description")
    whole = F.when(text.rlike(_BROKEN), plain_text(text)).otherwise(text)
    said = {f: F.nullif(F.regexp_extract("_text", pattern, 0), F.lit("")) for f, pattern in _ASKED.items()}
    base = listings.select(
        F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(f"_{c}") for c in (*LEAST, "area_m2", "rooms")],
        plain_text(F.col("price_unit")).alias("_price_unit"), plain_text(F.col("area_unit")).alias("_area_unit"), F.col("title").alias("_title"),
        *[c.alias(n) for n, c in kept.items()], whole.alias("_text"), F.from_json(F.col("structured_fields_json"), "map<string,string>").alias("_shown"),
    )
    shown = {f: F.try_element_at(F.col("_shown"), F.lit(k)) for f, k in _SHOWN.items()}
    # phrases are short; all further parsing sees only them
    phrases = base.select(
        "*", *[plain_text(said[f]).alias(f"_said_{f}") for f in LEAST], *[plain_text(shown[f]).alias(f"_shown_{f}") for f in _SHOWN],
        plain_text(F.nullif(F.regexp_extract("_text", _AREA_SAID, 0), F.lit(""))).alias("_said_area"), plain_text(F.nullif(F.regexp_extract("_title", _AREA_TITLE, 0), F.lit(""))).alias("_title_area"),
    ).drop("_text", "_shown", "_title")
    prices, areas = _units(edges, "price"), _units(edges, "area")
    known = phrases.select(
        "_id", "_rooms", *kept, *[_real(F.col(f"_{f}")).alias(f"_{f}") for f in LEAST], _real(F.col("_area_m2"), STAND_IN_AREAS).alias("_area_m2"),
        _unit_of(F.col("_price_unit"), prices).alias("_price_label"), _unit_of(F.col("_area_unit"), areas).alias("_area_label"),
        *[F.array_compact(F.array(money(F.col(f"_shown_{f}"), edges), money(F.col(f"_said_{f}"), edges))).alias(f"_quantities_{f}") for f in LEAST],
        F.array_compact(F.array(area(F.col("_said_area"), edges), area(F.col("_shown_area_m2"), edges, "m2"), area(F.col("_title_area"), edges, "m2"))).alias("_quantities_area_m2"),
    )

    def from_texts(field: str, units: list[str], tolerance: float) -> Column:
        value = F.col(f"_{field}")
        matched = F.transform(F.col(f"_quantities_{field}"), lambda q: _by_ratio(value, q, units, edges, tolerance))
        return F.try_element_at(F.array_compact(matched), F.lit(1))

    texts = known.select(
        "*", *[from_texts(f, prices, 0.006).alias(f"_text_{f}") for f in LEAST], from_texts("area_m2", areas, 0.015).alias("_text_area_m2")
    )

    def price_cell(field: str, sibling: str) -> Column:
        value, label, least = F.col(f"_{field}"), F.col("_price_label"), F.lit(LEAST[field])
        factor = F.lit(None).cast("double")
        for unit in prices:
            factor = F.when(label == unit, _factor(edges, unit)).otherwise(factor)
        by_label = F.when((value * factor >= least) & (value * factor < 1e6 * least), label)
        by_sibling = F.when((F.col(f"_text_{sibling}") == "rial") & label.isNull() & (value * _factor(edges, "rial") >= least), "rial")
        # no home costs so little: the largest unit below which the number stays real
        by_size = F.when(value >= least, "toman").when(value * 1e3 >= least, "thousand_toman").when(value * 1e6 >= least, "million_toman").otherwise("billion_toman")
        return _cell(field, value, F.col(f"_text_{field}"), by_label, by_sibling, by_size)

    def area_cell() -> Column:
        value, label = F.col("_area_m2"), F.col("_area_label")
        small = (value < 10) | ((value < 25) & (value != F.floor(value)))
        # hundreds of square metres to a room are square feet
        wide = (value >= 250) & F.col("_rooms").between(0, 5) & (value / (F.col("_rooms") + 1) > 150)
        by_label = F.when((label == "m2") & (small | wide), F.lit(None)).otherwise(label)
        by_size = F.when(small, "are").when(wide, "sqft").otherwise("m2")
        return _cell("area_m2", value, F.col("_text_area_m2"), by_label, F.lit(None).cast("string"), by_size)

    cells = F.array(price_cell("deposit_toman", "rent_monthly_toman"), price_cell("rent_monthly_toman", "deposit_toman"), area_cell())
    return texts.select(F.col("_id").alias(id_col), *kept, cells.alias("cells"))


def _cell(field: str, value: Column, by_text: Column, by_label: Column, by_sibling: Column, by_size: Column) -> Column:
    ways = {"text": by_text, "label": by_label, "sibling": by_sibling, "size": by_size}
    unit = F.when(value.isNotNull(), F.coalesce(*ways.values()))
    evidence = F.when(value.isNotNull(), F.coalesce(*[F.when(c.isNotNull(), name) for name, c in ways.items()]))
    return F.struct(F.lit(field).alias("field_name"), value.alias("value"), unit.alias("unit"), evidence.alias("evidence"))


def convert(listings: DataFrame, unit_ref: DataFrame, id_col: str = "listing_id") -> DataFrame:
    """(id, field_name, value, unit, evidence, target, common_value, converted) of every cell; cells without a real value keep nulls."""
    spark = listings.sparkSession
    edges = conversion_table(spark, unit_ref)
    targets = spark.createDataFrame([(e.source, e.target, e.scale, e.offset) for e in edges], "unit string, target string, scale double, offset double")
    # the outer form: for the plain one the optimizer infers a filter and repeats all expressions below it
    cells = source_units(listings, edges, id_col).select(id_col, F.explode_outer("cells").alias("c")).select(id_col, "c.*")
    canonical = F.when(F.col("field_name") == "area_m2", CANONICAL["area"]).otherwise(CANONICAL["price"])
    ways = targets.withColumnsRenamed({"unit": "_unit"})
    joined = cells.join(F.broadcast(ways), (F.col("unit") == F.col("_unit")) & (canonical == F.col("target")), "left")  # one row for each unit, at most 1000
    return joined.select(
        id_col, "field_name", "value", "unit", "evidence", "target",
        (F.col("value") * F.col("scale") + F.col("offset")).alias("common_value"), F.coalesce(F.col("unit") != F.col("target"), F.lit(False)).alias("converted"),
    )
