"""One form for texts that look alike (p6): confusables skeleton, ordinary form, groups of equal skeleton.

The skeleton decomposes a text, replaces every character by its prototype from the look-alike table and decomposes again;
two texts look alike if their skeletons are equal. The ordinary form is the recomposed skeleton and nothing else, so texts of
equal skeleton have one ordinary form. Digits of different look stay apart (Persian and ASCII ones), emoji and U+FFFD stay as
they are; circled, raised or squared letters don't look like plain ones and stay too.

Letters of other scripts stand for Latin ones word by word: in words with a Latin letter, and in words of look-alikes only,
unless the text has words that can only be of such a script (it is then written in it). The zero-width non-joiner stays inside
words of the Persian script, also where such a word was cut off behind it.

Null stays null, an empty text stays empty; both are never reported as changed.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.chars import INVISIBLE, PLAIN_CLASS, SCRIPTS, SPACES, ZWNJ, prototypes

FIELDS = ("title", "description", "neighborhood")

_LETTERS = {k: v for script in SCRIPTS for k, v in script.items()}
_TABLE = {k: v for k, v in prototypes().items() if k not in _LETTERS and k != "ۀ"} | dict.fromkeys(SPACES, " ") | dict.fromkeys(INVISIBLE, "")
_PROTOTYPE, _LATIN = str.maketrans({k: unicodedata.normalize("NFD", v) for k, v in _TABLE.items()}), str.maketrans(_LETTERS)
_FOREIGN_CLASS, _BEYOND = "\u0370-\u058f\u13a0-\u13ff\u1f00-\u1fff\ua4d0-\ua4ff", "\U0001d400-\U0001d7ff\U0001ee00-\U0001eef1"
#: A text without any of these is in ordinary form if it is composed: what the tables map, letters of other scripts, and combining marks that compose.
_ODD = re.compile("[" + "".join(map(re.escape, sorted(c for c in {*_TABLE, "ۀ", "ۂ", *map(chr, (*range(0x300, 0x370), *range(0x653, 0x660), 0x670))} if c < "\U00010000"))) + _FOREIGN_CLASS + _BEYOND + "]")
_FOREIGN = re.compile(f"[{_FOREIGN_CLASS}]")
_RUN = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")
_ASCII = re.compile("[A-Za-z]")
_PERSIAN = frozenset(map(chr, (*range(0x620, 0x64B), *range(0x671, 0x6D4))))
# Composed Persian letters whose parts Unicode doesn't compose.
_COMPOSED = {"یٔ": "ئ", "هٔ": "ۀ"}


def _latin_words(text: str) -> str:
    """Look-alikes of other scripts replaced word by word."""
    runs = _RUN.findall(text)
    foreign = [r for r in runs if _FOREIGN.search(r)]
    told = any(not _ASCII.search(r) and any(_FOREIGN.match(c) and c not in _LETTERS for c in r) for r in foreign)
    taken = {r for r in foreign if _ASCII.search(r) or (not told and all(c in _LETTERS for c in r if _FOREIGN.match(c)))}
    return _RUN.sub(lambda m: m.group().translate(_LATIN) if m.group() in taken else m.group(), text) if taken else text


def skeleton(text: str) -> str:
    """Decomposed prototypes: equal for texts that look the same."""
    once = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_PROTOTYPE).translate(_PROTOTYPE))
    if ZWNJ in once:
        once = unicodedata.normalize("NFD", _within_words(once))
    return unicodedata.normalize("NFD", _latin_words(once)) if _FOREIGN.search(once) else once


def recomposed(skeleton: str) -> str:
    """The readable text of a skeleton."""
    text = unicodedata.normalize("NFC", skeleton)
    for parts, whole in _COMPOSED.items():
        text = text.replace(parts, whole)
    return text


def ordinary(text: str) -> str:
    """The readable form with ordinary letters, plain spaces and no stray invisible characters."""
    if _ODD.search(text) or not unicodedata.is_normalized("NFC", text):
        return recomposed(skeleton(text))
    return _within_words(text) if ZWNJ in text else text


def _within_words(text: str) -> str:
    """Non-joiners only behind a letter of the Persian script, before one or where the word was cut off, one at a time."""
    first, *rest = text.split(ZWNJ)
    out = [first]
    for i, part in enumerate(rest):
        last = i == len(rest) - 1
        if part or last:
            before = out[-1].rstrip(_MARKS)[-1:]
            if before in _PERSIAN and (part[:1] in _PERSIAN or (last and part.rstrip() in _CUT)):
                out.append(ZWNJ)
            out.append(part)
    return "".join(out)


_MARKS = "".join(map(chr, range(0x64B, 0x660)))
# What may stand behind a word that was cut off.
_CUT = frozenset(["", "...", "…", "�"])


def _mapped(function, values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else function(v) for v in values.to_pylist()], type=pa.string())


@F.arrow_udf(StringType())
def ordinary_form(values: pa.Array) -> pa.Array:
    """Arrow function: ordinary form of each text."""
    return _mapped(ordinary, values)


@F.arrow_udf(StringType())
def skeleton_of(values: pa.Array) -> pa.Array:
    """Arrow function: skeleton of each text."""
    return _mapped(skeleton, values)


def unify(df: DataFrame, id_col: str = "listing_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field_name, original, ordinary, changed) of each non-null field; one pass of Python over all fields of a batch."""
    rows = df.select(F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, name in enumerate(fields):
                column = batch.column(i + 1)
                texts = column.to_pylist()
                fixed = [None if t is None else ordinary(t) for t in texts]
                keep = pa.array([t is not None for t in texts])
                changed = pa.array([t != o for t, o in zip(texts, fixed)])
                out = pa.RecordBatch.from_arrays([ids, pa.array([name] * len(texts), pa.string()), column, pa.array(fixed, pa.string()), changed], names=["id", "field_name", "original", "ordinary", "changed"])
                yield out.filter(keep)

    kind = dict(df.dtypes)[id_col]
    return rows.mapInArrow(run, f"id {kind}, field_name string, original string, ordinary string, changed boolean").withColumnRenamed("id", id_col)


def changed_fields(df: DataFrame, id_col: str = "listing_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field_name) of the fields that change when brought to ordinary form; texts of ordinary characters only never leave the JVM."""
    letter = r"[\x{620}-\x{64a}\x{671}-\x{6d3}]"
    odd = rf"[^{PLAIN_CLASS}]|(?<!{letter})\x{{200c}}|\x{{200c}}(?!{letter})"
    only = [F.when(F.col(f).cast("string").rlike(odd), F.col(f).cast("string")).alias(f) for f in fields]
    return unify(df.select(F.col(id_col), *only), id_col, fields).filter("changed").select(id_col, "field_name")


def groups(df: DataFrame, field: str, id_col: str = "listing_id") -> DataFrame:
    """(skeleton, rows, forms, ordinary) of the texts of one field, one row for each group of equal skeleton.

    Distinct originals are counted before Python sees them, so a text that fills a third of the rows is folded map-side.
    """
    counted = df.filter(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("original")).agg(F.count("*").alias("n"))
    keyed = counted.select("n", skeleton_of("original").alias("skeleton"), ordinary_form("original").alias("ordinary"))
    return keyed.groupBy("skeleton").agg(F.sum("n").alias("rows"), F.count("*").alias("forms"), F.min("ordinary").alias("ordinary"))
