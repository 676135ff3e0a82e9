"""Personal information in free text (p4): proposals by pattern, confirmation by checksum, scores from nearby words.

Regular expressions propose spans for phone numbers, e-mail addresses, identity numbers, payment cards, IBANs, street addresses and
names; which of them run on a text is told by one pass of a keyword automaton. Check digits confirm numbers (mod 11 for identity
numbers, Luhn for cards, mod 97 for IBANs): without a right one they are none. Each type has a base score for its pattern, words
before and after a span raise or lower it, and spans that reach the threshold become mentions. A name is told by a known given
name, a title or a word before it that speaks of a person, together with the shape of the family name; no one of these is enough.
Where mentions overlap, the earlier type in TYPES keeps its span. The text is compared in ordinary form, but offsets are those of the
original, so that all else stays as it was.

Null and empty texts have no mentions; mentions of a repeated row are repeated with it; a mention cut off by the end of the
text is none, since it cannot be confirmed.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.chars import INVISIBLE, PERSIAN_DIGITS, one_to_one

TYPES = ("email", "iban", "card", "phone", "national_id", "address", "person")
PLACEHOLDERS = {"iban": "<IBAN>", "card": "<CARD>", "email": "<EMAIL>", "phone": "<PHONE>", "national_id": "<NATIONAL_ID>", "address": "<ADDRESS>", "person": "<PERSON>"}
THRESHOLD = 0.7

_FLAT = str.maketrans({k: (str(PERSIAN_DIGITS.index(v)) if v in PERSIAN_DIGITS else v) for k, v in one_to_one().items()} | {d: str(i) for i, d in enumerate(PERSIAN_DIGITS)})
_FLAT_LETTERS = [*one_to_one()]
_DIGITS = [*zip(PERSIAN_DIGITS, "0123456789")]
_GONE = re.compile("[" + re.escape(INVISIBLE) + "]")
_MAY_NUMBER = re.compile(r"\d{3}[- ]?\d{4}|[A-Z]{2}\d{2} ?\w{4}")

# Given names.
GIVEN_FA = "نگار علی رضا سارا مریم حسین مینا لیلا شیرین کامران امیر بابک پیمان پریسا الهه جواد فرزانه سهراب مهدی آرزو ثریا نسرین بهنام یاشار محمد احمد حسن فاطمه زهرا محمود اکبر اصغر ناصر سعید مجید حمید وحید نوید فرهاد بهرام کاوه آرش سیاوش بهمن شهرام مهرداد فرشته ناهید مهناز شهلا پروین زینب سمیرا الناز نرگس".split()
GIVEN_EN = "Negar Ali Reza Sara Maryam Hossein Hosein Mina Leila Leyla Shirin Kamran Amir Babak Peyman Peiman Parisa Elaheh Elahe Javad Farzaneh Sohrab Mehdi Mahdi Arezu Arezoo Arezou Sorayya Soraya Nasrin Behnam Yashar Mohammad Ahmad Hassan Fatemeh Zahra Saeed Majid Hamid Vahid Farhad Bahram Kaveh Arash Shahram".split()
# Endings of family names, and titles.
FAMILY_FA = "نیا خواه منش تباری وندی زاده پور فر راد یانی نژاد یان".split()
FAMILY_EN = "nia khah manesh tabari vandi zadeh zade pour poor pur far rad yani nejad yan".split()
TITLES_FA = "آقای خانم مهندس دکتر جناب سرکار حاج".split()
TITLES_EN = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Eng", "Engineer"]
# Digits written as words.
NUMBER_WORDS = "صفر یک دو سه چهار پنج شش هفت هشت نه zero one two three four five six seven eight nine".split()

_W = r"[^\W\d_]+(?:‌[^\W\d_]+)*"
_SEP = r"[-. /]?"
PHONE = re.compile(
    rf"(?<![\w+])(?:(?:\+|00)98{_SEP}|0)9\d{{2}}(?:{_SEP}\d){{7}}(?!\d)"
    rf"|(?<![\w+])\(?0[1-8]\d\)?{_SEP}\d{{4}}{_SEP}\d{{4}}(?!\d)"
    rf"|(?<![\w+])(?:\+|00)98{_SEP}[1-8]\d{_SEP}\d{{4}}{_SEP}\d{{4}}(?!\d)"
)
SPOKEN = re.compile(r"(?<!\w)(?:صفر|zero)(?:[ ,-]+(?:" + "|".join(NUMBER_WORDS) + r")){9,11}(?!\w)", re.IGNORECASE)
NATIONAL_ID = re.compile(r"(?<![\w+/.-])\d{3}[- ]?\d{6}[- ]?\d(?![\w/]|[.-]\d)")
_LOCAL, _LABEL = r"[A-Za-z0-9](?:[\w.+%-]*[A-Za-z0-9])?", r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(
    rf"(?<![\w.@-]){_LOCAL}(?:@{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}}"
    rf"| ?@ ?{_LABEL}(?: ?\. ?{_LABEL})* ?\. ?[A-Za-z]{{2,}}"
    rf"| ?[\[(](?:at|ات)[\])] ?{_LABEL}(?: ?(?:[\[(](?:dot|نقطه)[\])]|\.) ?{_LABEL})+"
    rf"| (?:at|ات) {_LABEL}(?: (?:dot|نقطه) {_LABEL})+)"
)
CARD = re.compile(r"(?<![\w+/.-])\d{4}(?:[- ]?\d{4}){3}(?![\w/]|[.-]\d)")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_STREET_FA = r"(?:خیابان|خ|بلوار|کوچه|ک|بن[‌ ]?بست|کوی|گذر|محله|ساختمان|برج|مجتمع)\.?"
ADDRESS_FA = re.compile(
    rf"(?<!\w){_STREET_FA}\s+{_W}(?:\s+\d{{1,3}})?(?:[،,]?\s+(?:{_STREET_FA}\s+)?{_W}(?:\s+\d{{1,3}})?){{0,5}}?[،,]?\s*"
    rf"(?:پلاک|پ|شماره|ش)\.?\s*\d{{1,4}}(?!\d)(?:[،,]?\s*(?:زنگ|واحد|طبقه|ط)\s*\d{{1,3}}(?!\d))*"
)
_STREET_EN = r"(?:Alley|St\b\.?|Street|Lane|Blvd|Boulevard|Avenue|Ave\b\.?|Road|Rd\b\.?|Building|Tower)"
ADDRESS_EN = re.compile(
    rf"(?<!\w)(?:Unit\s+\d+,\s+)?(?:No\.?\s*)?\d{{1,4}},?\s+[A-Z]\w+(?:\s+[A-Z]\w+)?\s+{_STREET_EN}(?:,\s+[A-Z]\w+\s+{_STREET_EN})*(?:,\s+(?:Apt|Unit|Floor|floor)\.?\s+\d+)*"
    rf"|(?<!\w)[A-Z]\w+\s+{_STREET_EN},\s+(?:plate|No\.?)\s+\d{{1,4}}(?:,\s+(?:floor|unit|Apt)\s+\d+)*"
)
_MAY_ADDRESS_FA = re.compile(r"(?<!\w)(?:پلاک|پ|شماره|ش)\.?\s*\d{1,4}(?!\d)")
PERSON_FA = re.compile(
    rf"(?<!\w)(?P<title>(?:(?:{'|'.join(TITLES_FA)})\s+)+)?(?P<given>{'|'.join(GIVEN_FA)})\s+(?P<family>{_W})"
    rf"|(?<!\w)(?P<title2>(?:(?:{'|'.join(TITLES_FA)})\s+)+)(?P<other>{_W})\s+(?P<family2>{_W})"
)
_TITLE_EN = rf"(?:(?:{'|'.join(TITLES_EN)})\.?\s+)"
PERSON_EN = re.compile(
    rf"(?<!\w)(?P<title>{_TITLE_EN}+)?(?P<given>{'|'.join(GIVEN_EN)})\s+(?P<family>[A-Z]\w+)"
    rf"|(?<!\w)(?P<title2>{_TITLE_EN}+)(?P<other>[A-Z]\w+)\s+(?P<family2>[A-Z]\w+)"
)
_FAMILY_FA = re.compile(rf"^\w+‌?(?:{'|'.join(FAMILY_FA)})$")
_FAMILY_EN = re.compile(rf"^\w+(?:{'|'.join(FAMILY_EN)})$")
PERSON_CUE_FA = re.compile(rf"(?<!\w)(?:پیش|به نام|مالک|مکاتبه با|تماس با)\s+(?P<given>{_W})\s+(?P<family>{_W})")
PERSON_CUE_EN = re.compile(r"(?<!\w)(?:Landlord|owner|name of|write to|Write to|ask for|call)\s+(?P<given>[A-Z][a-z]+)\s+(?P<family>[A-Z]\w+)")
# Words before or after a span that speak for or against it.
_FOR_EMAIL = re.compile(r"(?:ایمیل|رایانامه|نشانی|مکاتبه|[Ee]-?mail|[Ww]rite|contact|address)\D{0,30}$")
_FOR_PHONE = re.compile(r"(?:تماس|تلفن|موبایل|همراه|شماره|زنگ|[Cc]all|[Rr]ing|[Pp]hone|[Tt]el|number|WhatsApp)\D{0,30}$")
_FOR_ADDRESS = re.compile(r"(?:نشانی|آدرس|واقع در|address|located|place is|at|in)\W{0,3}$")
_FOR_CARD = re.compile(r"(?:کارت|شبا|حساب|card|account|IBAN)\D{0,30}$")
_FOR_PERSON = re.compile(r"(?:پیش|فقط|به نام|مالک|مکاتبه با|تماس با|for|to|Landlord|owner|name of)\s*$")
_AFTER_PERSON = re.compile(r"^\s*(?:پاسخگوی|را بخواهید|با کد ملی|\(|از راه|holds|on\b|at\b|انجام)")
_PLACE = re.compile(r"(?:میدان|فروشگاه|بنگاه|املاک|دفتر|شرکت|برند|تعمیرکار|سرایدار|پارک|مسجد|کوچه|خیابان|بلوار|square|store|agency|park|near)\s*$")
_FOR_ID = re.compile(r"(?:ملی|شناسنامه|مدارک|به نام [^\d(]{3,40}\(|ID(?: number)?|national|identity)[^\d]{0,12}$")
_FILE_CODE = re.compile(r"(?:فایل|پرونده|کد پستی|کدپستی|[Ff]ile|code)\D{0,8}$")


# Base scores of the patterns, and what a word before a span adds or takes.
BASE = {"email": 0.8, "spelled_email": 0.7, "phone": 0.8, "spoken_phone": 0.7, "address": 0.8, "card": 0.7, "iban": 0.8}
CUE, AGAINST = 0.2, 0.6


class Mention(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Check digit of payment cards."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Check digits of IBANs."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def national_id(digits: str) -> bool:
    """Check digit of ten-digit identity numbers; one digit ten times is none."""
    if len(digits) != 10 or len(set(digits)) == 1:
        return False
    rest = sum(int(d) * (10 - i) for i, d in enumerate(digits[:9])) % 11
    return int(digits[9]) == (rest if rest < 2 else 11 - rest)


_ODD = re.compile(f"[{''.join(map(re.escape, sorted(c for c in _FLAT_LETTERS if c < chr(0x10000))))}{re.escape(INVISIBLE)}\U0001d400-\U0001d7ff]")


def _flatten(text: str) -> tuple[str, list[int] | None]:
    """The text in ordinary letters with ASCII digits, and the original offset of each character if any was left out."""
    if not _ODD.search(text):
        for persian, ascii_digit in _DIGITS:  # few characters differ: ten replacements beat one lookup a character
            text = text.replace(persian, ascii_digit)
        return text, None
    if _GONE.search(text):
        kept = [i for i, c in enumerate(text) if not _GONE.match(c)]
        return "".join(text[i] for i in kept).translate(_FLAT), [*kept, len(text)]
    return text.translate(_FLAT), None


def _keywords() -> ahocorasick.Automaton:
    """One automaton over the words without which a pattern can't match; its values are sets of patterns, as bits."""
    bits: dict[str, int] = {}
    streets = ["Alley", "St", "Lane", "Blvd", "Boulevard", "Avenue", "Ave", "Road", "Rd", "Building", "Tower"]
    cues_fa, cues_en = ["پیش", "به نام", "مالک", "مکاتبه با", "تماس با"], ["Landlord", "owner", "name of", "rite to", "ask for", "call"]
    kinds = [("email", ["@", " at ", " ات ", "[at]", "(at)", "[ات]", "(ات)"]), ("spoken", ["صفر", "zero", "Zero", "ZERO"]), ("address_en", streets), ("person_fa", [*GIVEN_FA, *TITLES_FA]), ("person_en", [*GIVEN_EN, *TITLES_EN]), ("cue_fa", cues_fa), ("cue_en", cues_en)]
    for i, (kind, words) in enumerate(kinds):
        _BITS[kind] = 1 << i
        for w in words:
            bits[w] = bits.get(w, 0) | 1 << i
    # a word found inside a longer one speaks for both: the automaton reports every one
    out = ahocorasick.Automaton()
    for w, b in bits.items():
        out.add_word(w, b)
    out.make_automaton()
    return out


_BITS: dict[str, int] = {}
_KEYWORDS = _keywords()


def _context(kind: str, flat: str, start: int, cue: re.Pattern) -> float:
    before = flat[max(0, start - 40) : start]
    return min(1.0, BASE[kind] + CUE * bool(cue.search(before)) - AGAINST * bool(_FILE_CODE.search(before)))


def _id_score(flat: str, m: re.Match) -> float:
    if not national_id(re.sub(r"\D", "", m.group())):
        return 0.0
    before = flat[max(0, m.start() - 60) : m.start()]
    return 0.6 + 0.4 * bool(_FOR_ID.search(before)) + 0.1 - 0.6 * bool(_FILE_CODE.search(before))


def _person_score(flat: str, m: re.Match, endings: re.Pattern) -> float:
    known = m["given"] is not None
    family = m["family"] if known else m["family2"]
    before, after = flat[max(0, m.start() - 20) : m.start()], flat[m.end() : m.end() + 20]
    score = 0.45 * known + 0.4 * bool(endings.match(family)) + 0.2 * bool(m["title"] or m["title2"])
    return score + 0.2 * bool(_FOR_PERSON.search(before)) + 0.2 * bool(_AFTER_PERSON.match(after)) - 0.6 * bool(_PLACE.search(before))


def propose(flat: str) -> list[Mention]:
    """All spans with their scores."""
    found, may = [], 0
    for _, bits in _KEYWORDS.iter(flat):
        may |= bits
    if may & _BITS["email"]:
        found += [Mention("email", *m.span(), _context("email" if "@" in m.group() else "spelled_email", flat, m.start(), _FOR_EMAIL)) for m in EMAIL.finditer(flat)]
    found += [Mention("phone", *m.span(), _context("phone", flat, m.start(), _FOR_PHONE)) for m in PHONE.finditer(flat)]
    if may & _BITS["spoken"]:
        found += [Mention("phone", *m.span(), _context("spoken_phone", flat, m.start(), _FOR_PHONE)) for m in SPOKEN.finditer(flat)]
    if _MAY_NUMBER.search(flat):
        found += [Mention("national_id", *m.span(), _id_score(flat, m)) for m in NATIONAL_ID.finditer(flat)]
        found += [Mention("card", *m.span(), _context("card", flat, m.start(), _FOR_CARD)) for m in CARD.finditer(flat) if luhn(re.sub(r"\D", "", m.group()))]
        found += [Mention("iban", *m.span(), _context("iban", flat, m.start(), _FOR_CARD)) for m in IBAN.finditer(flat) if mod97(m.group().replace(" ", ""))]
    if not flat.isascii() and _MAY_ADDRESS_FA.search(flat):
        found += [Mention("address", *m.span(), _context("address", flat, m.start(), _FOR_ADDRESS)) for m in ADDRESS_FA.finditer(flat)]
    if may & _BITS["address_en"]:
        found += [Mention("address", *m.span(), _context("address", flat, m.start(), _FOR_ADDRESS)) for m in ADDRESS_EN.finditer(flat)]
    if may & _BITS["person_fa"]:
        found += [Mention("person", *m.span(), _person_score(flat, m, _FAMILY_FA)) for m in PERSON_FA.finditer(flat)]
    if may & _BITS["person_en"]:
        found += [Mention("person", *m.span(), _person_score(flat, m, _FAMILY_EN)) for m in PERSON_EN.finditer(flat)]
    if may & _BITS["cue_fa"]:
        found += _by_cue(flat, PERSON_CUE_FA, _FAMILY_FA)
    if may & _BITS["cue_en"]:
        found += _by_cue(flat, PERSON_CUE_EN, _FAMILY_EN)
    return found


def _by_cue(flat: str, pattern: re.Pattern, endings: re.Pattern) -> list[Mention]:
    """Names whose given name is in no list: the word before and the shape of the family name tell them together."""
    found = []
    for m in pattern.finditer(flat):
        if endings.match(m["family"]) and not _PLACE.search(m["given"] + " "):
            found.append(Mention("person", m.start("given"), m.end("family"), THRESHOLD + CUE * bool(_AFTER_PERSON.match(flat[m.end() : m.end() + 20]))))
    return found


def mentions(text: str | None, threshold: float = THRESHOLD) -> list[Mention]:
    """Mentions in order of place, with offsets into the original text."""
    if not text:
        return []
    flat, places = _flatten(text)
    taken: list[Mention] = []
    for m in sorted((m for m in propose(flat) if m.score >= threshold), key=lambda m: (TYPES.index(m.kind), m.start)):
        if all(m.end <= t.start or m.start >= t.end for t in taken):
            taken.append(m)
    taken.sort(key=lambda m: m.start)
    if places is not None:
        taken = [m._replace(start=places[m.start], end=places[m.end - 1] + 1) for m in taken]
    return taken


def redact(text: str | None) -> str | None:
    """The text with each mention replaced by the placeholder of its type."""
    if not text:
        return text
    out, at = [], 0
    for m in mentions(text):
        out += [text[at : m.start], PLACEHOLDERS[m.kind]]
        at = m.end
    return "".join([*out, text[at:]])


def find(df: DataFrame, id_col: str = "listing_id", text_col: str = "description") -> DataFrame:
    """(id, pii_type, mention_no, start, length, score): one row for each mention, numbered from 1 within its type; offsets in code points."""
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("length(text) > 0")

    def run(batches):
        for batch in batches:
            at, kinds, numbers, starts, lengths, scores = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                seen: dict[str, int] = {}
                for m in mentions(text):
                    seen[m.kind] = seen.get(m.kind, 0) + 1
                    at.append(i)
                    kinds.append(m.kind)
                    numbers.append(seen[m.kind])
                    starts.append(m.start)
                    lengths.append(m.end - m.start)
                    scores.append(float(m.score))
            ids = batch.column(0).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(kinds, pa.string()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()), pa.array(scores, pa.float64())], names=["id", "pii_type", "mention_no", "start", "length", "score"])

    kind = dict(df.dtypes)[id_col]
    return narrow.mapInArrow(run, f"id {kind}, pii_type string, mention_no int, start int, length int, score double").withColumnRenamed("id", id_col)


def redacted(df: DataFrame, id_col: str = "listing_id", text_col: str = "description") -> DataFrame:
    """(id, text) of every row with mentions replaced by placeholders; null stays null, empty stays empty."""
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            fixed = [redact(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fixed, pa.string())], names=["id", "text"])

    kind = dict(df.dtypes)[id_col]
    return narrow.mapInArrow(run, f"id {kind}, text string").withColumnsRenamed({"id": id_col, "text": text_col})
