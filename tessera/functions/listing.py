"""Column functions over listing texts and numbers (F1-F6, F14-F19, F23, F28-F31 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits, letters, words and patterns that decide results.
DIGITS_FROM, DIGITS_TO = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789"
LETTERS_FROM, LETTERS_TO = "يكۀ", "یکه"
NO_PRICE_WORDS = ["توافقی", "مجانی", "رایگان"]
SCALES = [("میلیارد", 1e9), ("میلیون", 1e6), ("هزار", 1e3)]
YES_WORDS = ["دارد", "بلی", "بله", "موجود", "yes", "true"]
NO_WORDS = ["ندارد", "خیر", "نه", "بدون", "no", "false"]
YES_LABELS = ["1", "true", "yes", "y", "بله", "بلی", "آره"]
NO_LABELS = ["0", "false", "no", "n", "خیر", "نه"]
ROOM_WORDS = {"یک": 1, "دو": 2, "سه": 3, "چهار": 4, "پنج": 5, "شش": 6, "هفت": 7, "هشت": 8, "نه": 9, "ده": 10, "یازده": 11, "دوازده": 12}
TOKEN_PATTERN = "^[A-Za-z0-9_-]{6,64}$"
PHONE_MARK = "[REDACTED_PHONE]"


def let(value: Column, body) -> Column:
    """``body`` over ``value``, evaluated once; a plain reuse would be repeated in every branch of a condition."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_text(value: Column) -> Column:
    """ASCII digits, Persian letters, joiners and direction marks to spaces, white space collapsed, trimmed, lower case; null gives ''."""
    s = F.translate(F.coalesce(value.cast("string"), F.lit("")), DIGITS_FROM + LETTERS_FROM, DIGITS_TO + LETTERS_TO)
    s = F.regexp_replace(s, r"[\x{200c}\x{200f}\x{202a}-\x{202e}]", " ")
    return F.lower(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))


def strip(value: Column) -> Column:
    """A text without white space around it."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def fa_to_en(value: Column) -> Column:
    """digits and the Persian thousands and decimal marks in ASCII."""
    return F.translate(F.coalesce(value.cast("string"), F.lit("")), DIGITS_FROM + "٬٫", DIGITS_TO + ",.")


def _contains_any(s: Column, words: list[str]) -> Column:
    found = F.contains(s, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(s, F.lit(w))
    return found


def parse_number(value: Column) -> Column:
    """first number times the first scale word found; null for blank or negotiable."""

    def of(s: Column) -> Column:
        scale = F.lit(1.0)
        for word, by in reversed(SCALES):
            scale = F.when(F.contains(s, F.lit(word)), by).otherwise(scale)
        number = F.nullif(F.regexp_extract(F.replace(s, F.lit(","), F.lit("")), r"-?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double")
        return F.when((s == "") | _contains_any(s, NO_PRICE_WORDS), F.lit(None)).otherwise(number * scale)

    return let(normalize_text(fa_to_en(value)), of)


def parse_int(value: Column) -> Column:
    """F3 rounded half to even."""
    return F.rint(parse_number(value)).try_cast("bigint")


def parse_bool(value: Column, strict: bool = False) -> Column:
    """yes words, then no words, else null; ``strict`` asks for no words first, since some contain a yes word."""

    def of(s: Column) -> Column:
        yes, no = _contains_any(s, YES_WORDS), _contains_any(s, NO_WORDS)
        return F.when(no, False).when(yes, True) if strict else F.when(yes, True).when(no, False)

    return let(normalize_text(value), of)


def redact_phones(text: Column) -> Column:
    """mobile numbers of ten digits after an optional prefix, in any script of digits."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)(?<!\d)(?:\+?98|0)?9\d{9}(?!\d)", PHONE_MARK)


def url_token(url: Column) -> Column:
    """Last path segment of a listing address if it is a valid token, else null."""
    last = F.regexp_extract(F.coalesce(url, F.lit("")), r"^https://[^/?#]+/v/(?:[^/?#]+/)*([^/?#]+)/?(?:[?#].*)?$", 1)
    return F.when(last.rlike(TOKEN_PATTERN), last)


def area_mentions(text: Column) -> Column:
    """numbers of two to four digits before a metre word, between 10 and 2000."""
    found = F.regexp_extract_all(normalize_text(text), F.lit(r"(?U)(?<!\d)(\d{2,4})\s*(?:متری|متر)(?!\w)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda v: v.between(10, 2000))


def room_mentions(text: Column) -> Column:
    """counts before a room noun, in digits or words."""
    return let(normalize_text(text), _room_mentions)


def _room_mentions(s: Column) -> Column:
    digits = [F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in (r"(?U)(?<!\d)(\d{1,2})\s*خواب", r"(?U)(?<!\d)(\d{1,2})\s*اتاق")]
    counted = F.filter(F.transform(F.concat(*digits), lambda x: x.try_cast("int")), lambda v: v.between(0, 20))
    words = [F.when(s.rlike(rf"(?:^|\s){w}\s*(?:خوابه|خواب|اتاق)(?:\s|$)"), F.lit(n)) for w, n in ROOM_WORDS.items()]
    return F.concat(counted, F.array_compact(F.array(*words)))


def amenity_conflict(text: Column, name: str, flag: Column) -> Column:
    """F16: 1.0 where the flag and the text contradict each other, by plain containment; 0.0 for a null flag."""
    s = normalize_text(text)
    without = F.contains(s, F.lit(f"بدون {name}"))
    positive = F.contains(s, F.lit(name)) & ~without
    negative = without | F.contains(s, F.lit(f"{name} ندارد"))
    return F.when(flag.isNull(), 0.0).when((flag & negative) | (~flag & positive), 1.0).otherwise(0.0)


def safe_div(a: Column, b: Column) -> Column:
    """null for a zero denominator."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """F19; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x)))


def real(x: Column) -> Column:
    """NaN and infinities to null, so that no NaN reaches a comparison."""
    return F.when(~F.isnan(x) & ~x.isin(float("inf"), float("-inf")), x)


def money(x: Column) -> Column:
    """billions as B, millions as M, else with thousands separators; a dash for null."""
    return (
        F.when(x.isNull(), "—").when(F.abs(x) >= 1e9, F.concat(F.call_function("format_number", x / 1e9, F.lit("0.00")), F.lit(" B")))
        .when(F.abs(x) >= 1e6, F.concat(F.call_function("format_number", x / 1e6, F.lit("0.0")), F.lit(" M"))).otherwise(F.call_function("format_number", x, F.lit("#,##0")))
    )


def label_bool(value: Column) -> Column:
    """yes or no of a label, else null; '1.0' is neither."""
    s = F.lower(F.trim(value.cast("string")))
    return F.when(s.isin(YES_LABELS), "yes").when(s.isin(NO_LABELS), "no")


def label_choice(value: Column) -> Column:
    """a trimmed choice, null if blank."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def label_level(value: Column) -> Column:
    """a level from 0 to 4 as text, else null."""
    n = F.trim(value.cast("string")).try_cast("double").try_cast("int")
    return F.when(n.between(0, 4), n.cast("string"))


def blocked_page(status: Column, body: Column, hints: list[str]) -> Column:
    """refused requests and pages with a hint of it."""
    return F.coalesce(status.isin(401, 403, 429), F.lit(False)) | F.coalesce(_contains_any(F.lower(body), hints), F.lit(False))


def fixed(value: Column, pattern: str = "0.00") -> Column:
    """a number with fixed decimals, half to even on its binary value, without grouping."""
    return F.call_function("format_number", value, F.lit(pattern))
