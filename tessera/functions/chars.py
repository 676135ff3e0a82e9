"""Character tables shared by text functions: digits, look-alike letters, invisible characters and odd spaces."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters drawn like ASCII letters, by script.
CYRILLIC_LATIN = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ѵ": "V", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԛ": "q", "ԝ": "w", "ԁ": "d", "ѵ": "v", "ӏ": "l",
}
GREEK_LATIN = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
}
ARMENIAN_LATIN = {"Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "զ": "q", "ց": "g"}
CHEROKEE_LATIN = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
LISU_LATIN = {
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
LATIN_LATIN = {"ɑ": "a", "ɡ": "g", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s"}
SCRIPTS = (CYRILLIC_LATIN, GREEK_LATIN, ARMENIAN_LATIN, CHEROKEE_LATIN, LISU_LATIN)
# Arabic-script letters that stand for a Persian letter.
ARABIC_PERSIAN = {"ي": "ی", "ى": "ی", "ې": "ی", "ك": "ک", "ڪ": "ک", "ہ": "ه", "ھ": "ه", "ە": "ه", "ۀ": "ه"}
# Marks without own width, and joiners other than the zero-width non-joiner.
INVISIBLE = "­͏؜ᅟᅠ᠎​‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
# Spaces other than the plain one.
SPACES = "               　"
ZWNJ = "‌"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"


def same_look(ch: str) -> bool:
    """Whether the compatibility form of a character looks the same: fonts, widths, joining forms, and ligatures or numerals of letters."""
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if tag in ("<font>", "<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>"):
        return not rest.startswith("0020 ") and unicodedata.category(ch) != "Sc"
    return tag == "<compat>" and unicodedata.category(ch)[0] in "LN"


def compatible() -> dict[str, str]:
    """Characters whose compatibility form looks the same, with that form; by rule from the Unicode data."""
    blocks = ((0x100, 0x250), (0x3D0, 0x400), (0x2100, 0x2190), (0xFB00, 0xFB07), (0xFB50, 0xFDFE), (0xFE70, 0xFEFD), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x1EE00, 0x1EEF2))
    return {chr(c): unicodedata.normalize("NFKC", chr(c)) for low, high in blocks for c in range(low, high) if same_look(chr(c))}


def prototypes() -> dict[str, str]:
    """Look-alike table: character -> ordinary character. Compatibility forms come from Unicode by rule, the rest from the fixed tables."""
    fixed = {k: v for script in (*SCRIPTS, LATIN_LATIN, ARABIC_PERSIAN) for k, v in script.items()} | dict(zip(ARABIC_DIGITS, PERSIAN_DIGITS))
    return {k: "".join(fixed.get(c, c) for c in v) for k, v in compatible().items()} | fixed


def one_to_one() -> dict[str, str]:
    """The entries of prototypes() that keep the length, with odd spaces; usable by SQL translate."""
    return {k: v for k, v in prototypes().items() if len(v) == 1} | dict.fromkeys(SPACES, " ")


#: Java character class of what is ordinary as it stands, the non-joiner aside: texts of nothing else need no letter replaced.
PLAIN_CLASS = (
    r"\x{0}-\x{7f}\x{a1}-\x{ac}\x{ae}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{60c}\x{61b}\x{61f}\x{621}-\x{642}\x{644}-\x{648}\x{64b}-\x{652}\x{66a}-\x{66c}\x{67e}\x{686}\x{698}\x{6a9}\x{6af}\x{6cc}\x{6f0}-\x{6f9}"
    r"\x{200c}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20bf}\x{2190}-\x{2328}\x{232b}-\x{2adb}\x{2add}-\x{2bff}\x{fe0f}\x{fffd}\x{1f000}-\x{1faff}"
)
# Base letter, combining mark, composed letter.
COMPOSED = [("ا", "ٓ", "آ"), ("ی", "ٔ", "ئ"), ("و", "ٔ", "ؤ"), ("ا", "ٔ", "أ"), ("e", "́", "é"), ("E", "́", "É"), ("c", "̧", "ç"), ("C", "̧", "Ç")]


def plain_text(text: Column, ascii_digits: bool = True) -> Column:
    """Ordinary letters, plain spaces, no invisible characters but the non-joiner, optionally ASCII digits; all in the JVM.

    Compatibility forms and combining marks that occur with Persian and French letters are composed. Null stays null.
    One lookup a character does all but the composing; regular expressions with as many ranges cost several times that.
    """
    pairs = one_to_one()
    if ascii_digits:
        pairs = {k: (chr(48 + PERSIAN_DIGITS.index(v)) if v in PERSIAN_DIGITS else v) for k, v in pairs.items()}
        pairs |= {d: str(i) for i, d in enumerate(PERSIAN_DIGITS)}
    composed = F.translate(text, "".join(pairs) + INVISIBLE, "".join(pairs.values()))
    for base, mark, whole in COMPOSED:
        composed = F.replace(composed, F.lit(base + mark), F.lit(whole))
    return composed
