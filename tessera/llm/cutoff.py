"""Texts cut off by field limits or broken transfers (p2).

Two kinds of evidence. Near copies of a text that does not end like a finished one are found by min-hash banding of text beginnings:
a copy cut early has little in common with the whole text, but all with its beginning, so each text is banded at several lengths
and an open end is looked up at its own. Pairs are verified by the share of the open end's five-word sequences that the copy
holds, then aligned: from the last common sequence the remaining words are matched with edits. If the copy goes on where the open
end stops, the text was cut, while a sentence end at that place clears it. Texts without such a copy are scored by the
terminality of their closing words: how often the corpus has a sentence end after them, seen with the word before, and all words
folded to their kind where they are rare. The number of texts of a source that are exactly as long as this one tells a field limit
from chance and sets how much terminality is asked for.

Every text is read once: its end, its bands and the counts of all its contexts come from one pass. Null, empty and blank texts
are never cut; texts that close with a full stop, an exclamation or question mark, a closing quote or bracket or an emoji are
finished; texts that close with a comma, colon, slash, dash or open bracket are cut, since no ad ends there; rows of equal text get
equal verdicts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import sketch
from tessera.llm.confusables import ordinary
from tessera.session import cut_lineage, small_or_shuffled, written

BANDS, ROWS, WIDTH = 8, 4, 5
#: Words of the shortest beginning that is banded; every further one has twice as many.
BEGINNING = 8
#: Share of the open end's word sequences that a copy holds.
SHARED = 0.8
#: Differing texts of a band up to which its pairs are joined with their texts; the texts of larger ones meet in blocks of about
#: CELL_TEXTS by CELL_TEXTS instead. Either way every pair is judged, so results don't depend on these.
BAND_TEXTS = 100
CELL_TEXTS = 300
#: Words that an alignment looks beyond the end, and words of what it extends for each edit; two words may hold one.
SLACK, EDITS = 6, 3
#: Occurrences from which a context counts as known.
KNOWN = 12
#: Closing contexts that end sentences less often than this are no ends; at a field limit of the source the second bound holds.
LOW, LOW_AT_LIMIT = 0.12, 0.5
#: Characters by which a cut may lie before the field limit.
MOVED = 2

# what may stand after a cut: ellipses, replacement characters, blanks, invisible marks
_AFTER = " \t\r\n.…�‌"
_TOKEN = re.compile(r"[^\W_]++(?:[‌'’.,/@_-]++[^\W_]++)*+|[.!؟?؛;:،,\n]| - |[^\w\s]")
_END = frozenset([".", "!", "؟", "?", "؛", ";", "\n", " - ", "،"])
# marks behind which a text goes on, besides dashes and opening brackets and quotes
_ON = frozenset(",،:;؛/\\")
_SEEDS = sketch.seeds(BANDS * ROWS, 91)
_PERSIAN = re.compile("[؀-ۿ]")


def parted(text: str) -> tuple[str, str]:
    """The text up to what may stand after a cut, and that; a lone full stop stays with the text."""
    body = text.rstrip(_AFTER)
    mark = text[len(body) :]
    return (text, "") if mark.strip() == "." else (body, mark)


def fold(word: str) -> tuple[str, str]:
    """A word without what varies freely (digits become 0, capitalised Latin words, names mostly, become A), and its kind."""
    if not word:
        return "", "a"
    if any(c.isdigit() for c in word):
        return "0", "0"
    if word[0].isascii() and word[0].isupper():
        return "A", "A"
    return word, "ف" if _PERSIAN.match(word) else "a"


KINDS = ("0", "A", "ف", "a")
_PERSIAN_KIND = KINDS.index("ف")


class Vocabulary:
    """Attributes of words and marks as arrays, by the number that each gets when it is first seen."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self._rows: list[tuple[int, int, bool, bool, int, int]] = []  # folded hash, kind (-1 for marks), sentence end, Persian comma, place and number of plain words
        self._words: list[int] = []
        self._arrays: tuple[np.ndarray, ...] = ()

    def _add(self, part: str) -> int:
        if _is_word(part):
            folded, kind = fold(part)
            plain = (part,) if part.isalnum() else sketch.split_ordinary(part)
            self._rows.append((xxhash.xxh64_intdigest(folded), KINDS.index(kind), False, False, len(self._words), len(plain)))
            self._words += [xxhash.xxh64_intdigest(sketch.normal(w)) for w in plain]
        else:
            self._rows.append((0, -1, part in _END, part == "،", 0, 0))
        self.numbers[part] = len(self._rows) - 1
        return len(self._rows) - 1

    def of(self, parts: list[str]) -> list[int]:
        known = self.numbers
        try:
            return [known[p] for p in parts]
        except KeyError:
            return [known[p] if p in known else self._add(p) for p in parts]

    def arrays(self) -> tuple[np.ndarray, ...]:
        """(folded hash, kind, end, comma, place, number) of all parts, and the hashes of all plain words."""
        if not self._arrays or len(self._arrays[0]) != len(self._rows):
            kinds = (np.uint64, np.int8, bool, bool, np.int64, np.int64)
            self._arrays = (*(np.array(c, dtype=k) for c, k in zip(zip(*self._rows), kinds)), np.array(self._words, dtype=np.uint64)) if self._rows else (*(np.zeros(0, k) for k in kinds), np.zeros(0, np.uint64))
        return self._arrays


_vocabulary = Vocabulary()


def _is_word(t: str) -> bool:
    return t[0].isalnum()


def closing(mark: str) -> int:
    """Style of a text whose last token is no word: 0 finished, 3 a mark behind which texts go on."""
    last = mark.strip()[-1:]
    return 3 if last and (last in _ON or unicodedata.category(last) in ("Pd", "Ps", "Pi")) else 0


def kind_key(kind: int) -> int:
    """Key of a kind of words."""
    return int(sketch.combine([np.array([kind], np.uint64)], 77).view(np.int64)[0])


class Read(NamedTuple):
    """What one pass over a slice of texts finds out about their words."""

    keys: np.ndarray  # contexts, narrow ones first, then words alone
    kinds: np.ndarray  # of words alone; -1 for narrow contexts
    ends: np.ndarray  # whether a sentence ends there
    last: np.ndarray  # (narrow, alone, kind) of each text's last word
    spoken: np.ndarray  # whether the text has words
    hashes: np.ndarray  # plain words one after another
    sizes: np.ndarray  # their number in each text


def read(listed: list[list[int]], vocabulary: Vocabulary) -> Read:
    """Contexts of all words of texts given by numbers of their parts. A word's context is the word before it (two for other than
    Persian words) and the word alone; nothing is known of a text's last word if nothing follows it."""
    folded, kind_of, end_of, comma_of, place_of, number_of, words = vocabulary.arrays()
    n = len(listed)
    part_sizes = np.array([len(x) for x in listed], dtype=np.int64)
    ids = np.fromiter(chain.from_iterable(listed), dtype=np.int64, count=int(part_sizes.sum()))
    text = np.repeat(np.arange(n), part_sizes)
    at = np.flatnonzero(kind_of[ids] >= 0) if len(ids) else np.zeros(0, np.int64)
    of, kind, h = text[at], kind_of[ids[at]], folded[ids[at]]
    before = np.zeros_like(h)
    before[1:] = np.where(of[1:] == of[:-1], h[:-1], np.uint64(0))
    before_that = np.zeros_like(h)
    before_that[2:] = np.where(of[2:] == of[:-2], h[:-2], np.uint64(0))
    persian_word = kind == _PERSIAN_KIND
    narrow = sketch.combine([np.where(persian_word, np.uint64(0), before_that), before, h], 2)
    alone = sketch.combine([h], 1)
    persian = np.zeros(n, dtype=bool)
    persian[of[persian_word]] = True
    followed = at + 1 < np.cumsum(part_sizes)[of]
    following = ids[np.minimum(at + 1, len(ids) - 1)] if len(ids) else ids
    ending = followed & end_of[following] & (persian[of] | ~comma_of[following])
    known = np.flatnonzero(followed)
    last = np.zeros((3, n), dtype=np.int64)
    last[0, of], last[1, of], last[2, of] = narrow.view(np.int64), alone.view(np.int64), kind  # the last word of a text is written last
    spoken = np.zeros(n, dtype=bool)
    spoken[of] = True
    number = number_of[ids]
    upto = np.cumsum(number)
    inside = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - number, number)
    hashes = words[np.repeat(place_of[ids], number) + inside]
    sizes = np.bincount(text, weights=number, minlength=n).astype(np.int64)
    keys = np.concatenate([narrow[known], alone[known]])
    kinds = np.concatenate([np.full(len(known), -1, np.int8), kind[known]])
    return Read(keys, kinds, np.tile(ending[known], 2), last, spoken, hashes, sizes)


def beginnings(values: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """(lengths in words, texts that have so many, their bands): min-hash bands of the beginnings of texts, each minimum carried on to the next length."""
    lengths, held, bands = [], [], []
    length, before = BEGINNING, 0
    low = np.full((len(sizes), BANDS * ROWS), np.iinfo(np.uint64).max, dtype=np.uint64)
    places = [sketch.ordered(values, seed) for seed in _SEEDS]
    while (texts := np.flatnonzero(sizes >= length)).size:
        upto = length - WIDTH + 1  # sequences of the beginning
        span = np.stack([offsets[texts] + before, offsets[texts] + upto], axis=1).reshape(-1)
        for j, h in enumerate(places):
            part = np.minimum.reduceat(np.append(h, np.uint64(0)), span)[::2]
            low[texts, j] = np.minimum(low[texts, j], part)
        m = low[texts]
        lengths.append(length)
        held.append(texts)
        bands.append(np.stack([sketch.combine([m[:, ROWS * b + r] for r in range(ROWS)], 100 * length + b) for b in range(BANDS)], axis=1))
        before, length = upto, 2 * length
    return lengths, held, bands


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if ends[-1] else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


_ROW = "text_id long, source string, n_chars int, style int, k2 long, k1 long, kind int, n_words int, bands array<long>, probes array<long>, key long, n long, ends long"
_TYPES = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
_ARROW = {name: _TYPES[kind] for name, kind in (c.split(" ") for c in _ROW.split(", "))}


def _rows(ids: pa.Array, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of _ROW; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([ids, *[columns.get(c, pa.nulls(len(ids), t)) for c, t in _ARROW.items()]], names=["id", *_ARROW])


def _counted(found: list[Read], id_type: pa.DataType) -> pa.RecordBatch:
    """Contexts of a batch with their counts."""
    keys, kinds, ends = (np.concatenate([getattr(r, c) for r in found]) for c in ("keys", "kinds", "ends"))
    unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    columns = {"key": pa.array(unique.view(np.int64)), "kind": pa.array(kinds[first].astype(np.int32)), "n": pa.array(np.bincount(inverse, minlength=len(unique)).astype(np.int64)), "ends": pa.array(np.bincount(inverse, weights=ends, minlength=len(unique)).astype(np.int64))}
    return _rows(pa.nulls(len(unique), id_type), columns)


def survey(df: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(ends, counts) of all non-blank texts in one pass over them.

    ends: (id, text_id, source, n_chars, style, k2, k1, kind, n_words, bands, probes), rows of equal text have one text_id;
    style: 0 finished, 1 open end, 2 broken inside a character, 3 ends in a comma or the like; ``bands`` those of all beginnings, ``probes``
    those of the longest beginning before the last word of an open end; k2, k1 and kind tell the last word with those before it, alone and by kind.
    counts: (key, kind, n, ends), how often each context occurs in all texts, and how often a sentence ends after it; counted per batch before the shuffle.
    """
    narrow = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")).where("length(trim(text)) > 0")
    narrow = narrow.withColumn("text_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            seen = []
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                vocabulary = _vocabulary
                if len(vocabulary.numbers) > sketch.MEMO:
                    vocabulary.__init__()
                texts = batch.column(2).to_pylist()
                style, listed = [], []
                for text in texts:
                    body, mark = parted(ordinary(text))
                    parts = _TOKEN.findall(body)
                    listed.append(vocabulary.of(parts))
                    kind = 2 if "�" in mark else 1
                    if kind == 1 and (not parts or not _is_word(parts[-1])):
                        kind = closing(parts[-1]) if parts else 0
                    style.append(kind)
                found = read(listed, vocabulary)
                seen.append(found)
                values, offsets = sketch.shingles(found.hashes, np.cumsum(found.sizes) - found.sizes, found.sizes, WIDTH)
                bands, probes = [[] for _ in texts], [np.zeros(0, np.uint64)] * len(texts)
                for length, at, b in zip(*beginnings(values, offsets, found.sizes)):
                    for i, row in zip(at.tolist(), b):
                        bands[i].append(row)
                        if style[i] and found.sizes[i] > length:
                            probes[i] = row
                styles = np.array(style, dtype=np.int32)
                untold = ~(found.spoken & (styles > 0))
                columns = {"text_id": batch.column(3), "source": batch.column(1), "n_chars": pa.array([len(t) for t in texts], pa.int32()), "style": pa.array(styles)}
                columns |= {c: pa.array(x.astype(t), mask=untold) for c, x, t in zip(("k2", "k1", "kind"), found.last, (np.int64, np.int64, np.int32))}
                columns |= {"n_words": pa.array(found.sizes.astype(np.int32)), "bands": _lists([np.concatenate(b) if b else np.zeros(0, np.uint64) for b in bands]), "probes": _lists(probes)}
                yield _rows(batch.column(0), columns)
            if seen:
                yield _counted(seen, whole.schema.field(0).type)

    every = written(narrow.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, {_ROW}"))
    counts = every.where("key is not null").groupBy("key").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    return every.where("key is null").drop("key", "n", "ends"), counts


def wanted_counts(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, n, ends) of the asked keys. Kinds are counted from the words that the whole corpus knows too rarely: they stand for words cut inside."""
    rare = (F.col("kind") >= 0) & (F.col("n") < KNOWN)
    kept = cut_lineage(counts.join(small_or_shuffled(keys.withColumn("asked", F.lit(True))), "key", "left").where(F.col("asked").isNotNull() | rare))
    key = F.element_at(F.array(*[F.lit(kind_key(k)) for k in range(len(KINDS))]), F.col("kind") + 1)
    kinds = kept.where(rare).groupBy(key.alias("key")).agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    return kept.where("asked").select("key", "n", "ends").unionByName(kinds)


def _banded(ends: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, n_words, band) of open ends at their own length; the same of all texts in these bands; (band, parts) of bands of more than
    BAND_TEXTS texts, with the number of blocks they are dealt to. Equal texts count once."""
    copies = ends.groupBy("text_id").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = cut_lineage(ends.select("id", "text_id").join(small_or_shuffled(cut_lineage(copies)), "text_id").where("id != first").select("id"))
    firsts = ends.join(small_or_shuffled(again), "id", "left_anti")
    probes = cut_lineage(firsts.where("style > 0").select("id", "n_words", F.explode("probes").alias("band")))
    # of the very many keys only those of open ends are kept; they are hashed, so that the others needn't be sorted
    asked = probes.select("band").distinct()
    keys = firsts.select("id", F.explode("bands").alias("band"))
    few = cut_lineage(keys.join(asked.hint("shuffle_hash"), "band", "left_semi"))
    met = cut_lineage(few.join(ends.select("id", "n_words"), "id"))
    parts = F.ceil(F.col("n") / CELL_TEXTS).cast("int")
    return probes, met, cut_lineage(met.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > BAND_TEXTS).select("band", parts.alias("parts")))


def copies(probes: DataFrame, met: DataFrame) -> DataFrame:
    """(a, b): an open end and a text of at least as many words that shares a band with it."""
    a = probes.select(F.col("id").alias("a"), F.col("n_words").alias("na"), "band")
    b = met.select(F.col("id").alias("b"), F.col("n_words").alias("nb"), "band")
    return a.join(b, "band").where("a != b and nb >= na").select("a", "b").distinct()


def _spans(text: str) -> tuple[str, list[tuple[int, int]], list[str]]:
    plain = ordinary(text)
    spans = [m.span() for m in sketch._WORD.finditer(plain)]
    return plain, spans, [sketch.normal(plain[a:b]) for a, b in spans]


def _extended(tail: list[str], copy: list[str]) -> int | None:
    """Place in ``copy`` where the last word of ``tail`` lands when all words before it are matched with few edits; None if it doesn't.

    Edit distance with a free end in the copy; the last word may be the beginning of the copy's.
    """
    cost = list(range(len(copy) + 1))
    for i, word in enumerate(tail[:-1]):
        above, cost = cost, [i + 1]
        for j, other in enumerate(copy):
            cost.append(min(above[j] + (word != other), above[j + 1] + 1, cost[j] + 1))
    places = [(cost[j], other != tail[-1], j) for j, other in enumerate(copy) if other.startswith(tail[-1])]
    best = min(places, default=None)
    return best[2] if best and best[0] <= max(len(tail) > 1, len(tail) // EDITS) else None


def _said(text: str) -> list[str]:
    """Words of an open end."""
    return _spans(parted(ordinary(text))[0])[2]


def _placed(copy: str) -> tuple[str, list[tuple[int, int]], list[str], dict[tuple, list[int]]]:
    """A copy's ordinary form, spans, words and the places of its word sequences."""
    plain, spans, other = _spans(copy)
    places: dict[tuple, list[int]] = {}
    for j in range(len(other) - WIDTH + 1):
        places.setdefault(tuple(other[j : j + WIDTH]), []).append(j)
    return plain, spans, other, places


def align(text: str, copy: str) -> int:
    """1: the copy goes on where the text ends; -1: the copy has a sentence end there; 0: no near copy, or its end can't be placed.

    The copy must hold SHARED of the text's word sequences. The last common sequence is the seed, the words after it are extended to the end.
    """
    return _aligned(_said(text), *_placed(copy))


def _aligned(said: list[str], plain: str, spans: list[tuple[int, int]], other: list[str], places: dict[tuple, list[int]]) -> int:
    whole = len(said) - WIDTH  # sequences without the last word, which may be cut inside
    if whole <= 0:
        return 0
    common = [(i, places[g]) for i in range(whole) if (g := tuple(said[i : i + WIDTH])) in places]
    if len({tuple(said[i : i + WIDTH]) for i, _ in common}) < SHARED * len({tuple(said[i : i + WIDTH]) for i in range(whole)}):
        return 0
    i, found = common[-1]
    j = min(found, key=lambda at: abs(at - i))  # of repeats the one nearest to the diagonal
    tail = said[i + WIDTH :]
    at = _extended(tail, other[j + WIDTH : j + WIDTH + len(tail) + SLACK])
    if at is None:
        return 0
    at += j + WIDTH
    if other[at] != said[-1]:
        return 1  # inside a word
    if at + 1 == len(other):
        return 0  # cut at the same place, or finished: no telling
    return -1 if _sentence_ends(plain[spans[at][1] : spans[at + 1][0]], plain[spans[at + 1][0]]) else 1


def _sentence_ends(between: str, after: str) -> bool:
    """Whether a sentence ends between two words; sentences strung together by commas begin with a capital."""
    return ("," in between and after.isascii() and after.isupper()) or " - " in between or any(c in _END for c in between)


def _cell(opened: pa.Table, met: pa.Table) -> pa.Table:
    """(id, verdict) of the open ends of one block of a band that texts of another block of it settle.

    A copy must hold SHARED of an end's sequences, so of any more than the others one at least: only texts that hold one of its last
    are aligned. A pair that shares several crowded bands is judged in the first. What goes on once is cut, so the first such copy settles it.
    """
    if not opened.num_rows or not met.num_rows:
        return pa.table([(opened if opened.num_rows else met).column("id").slice(0, 0), pa.array([], pa.int32())], names=["id", "verdict"])
    band = opened.column("band")[0].as_py()
    ids, sizes, texts, shared = (met.column(c).to_pylist() for c in ("id", "n_words", "text", "shared"))
    asked = []
    values, offsets = sketch.Batch([sketch.raw_words(parted(ordinary(t))[0]) for t in opened.column("text").to_pylist()]).shingles(WIDTH)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        grams = list(dict.fromkeys(values[start : max(end - 1, start)][::-1].tolist()))  # the last one holds the last word
        asked.append(grams[: int(len(grams) * (1 - SHARED) + 1e-6) + 1])
    values, offsets = sketch.Batch([sketch.raw_words(t) for t in texts]).shingles(WIDTH)
    hits = np.flatnonzero(np.isin(values, np.array(list({g for grams in asked for g in grams}), dtype=np.uint64)))
    holders: dict[int, dict[int, None]] = {}
    for gram, k in zip(values[hits].tolist(), (np.searchsorted(offsets, hits, "right") - 1).tolist()):
        holders.setdefault(gram, {})[k] = None
    placed: dict[int, tuple] = {}
    told, verdicts = [], []
    for at, (own, size, text, bands) in enumerate(zip(*(opened.column(c).to_pylist() for c in ("id", "n_words", "text", "shared")))):
        said, verdict = None, 0
        for k in dict.fromkeys(k for g in asked[at] for k in holders.get(g, ())):
            if ids[k] == own or sizes[k] < size or min(set(bands).intersection(shared[k])) != band:
                continue
            said = said or _said(text)
            if k not in placed:
                placed[k] = _placed(texts[k])
            if found := _aligned(said, *placed[k]):
                verdict = found
                if found == 1:
                    break
        if verdict:
            told.append(at)
            verdicts.append(verdict)
    return pa.table([opened.column("id").take(pa.array(told, pa.int32())), pa.array(verdicts, pa.int32())], names=["id", "verdict"])


def crowd_verdicts(probes: DataFrame, met: DataFrame, crowds: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, verdict) of open ends in bands of very many texts: what align() tells of all their pairs, judged by blocks of a band, so that
    a text is sent once for each block it meets and read once there."""

    def dealt(of: DataFrame, own: str, other: str) -> DataFrame:
        """Texts of crowded bands, each in a block of its side, repeated for all blocks of the other side."""
        inside = cut_lineage(of.join(small_or_shuffled(crowds), "band"))
        by_id = inside.groupBy("id").agg(F.first("n_words").alias("n_words"), F.collect_list(F.struct("band", "parts")).alias("tables"))
        rows = texts.join(small_or_shuffled(by_id, inside.count()), "id").select("id", "n_words", "text", F.col("tables.band").alias("shared"), F.explode("tables").alias("t"))
        rows = rows.select("id", "n_words", "text", "shared", "t.band", "t.parts", F.expr("cast(pmod(xxhash64(id), t.parts) as int)").alias(own))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return rows.select(*[F.col(c).alias(c) for c in ("id", "n_words", "text", "shared", "band", "i", "j")])  # aliases: both sides read one table

    cell = ("band", "i", "j")
    kind = dict(probes.dtypes)["id"]
    return dealt(probes, "i", "j").groupBy(*cell).cogroup(dealt(met, "j", "i").groupBy(*cell)).applyInArrow(_cell, f"id {kind}, verdict int")


def aligned(df: DataFrame, ends: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text_id, goes_on, ends_there): whether a copy goes on where an open end stops, else whether one has a sentence end there."""
    probes, met, crowds = _banded(ends)
    few = small_or_shuffled(crowds)
    found = cut_lineage(copies(probes.join(few, "band", "left_anti"), met.join(few, "band", "left_anti")))
    asked = small_or_shuffled(cut_lineage(found.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    every = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = cut_lineage(every.join(asked, "id", "left_semi"))
    pairs = found.join(texts.select(F.col("id").alias("a"), F.col("text").alias("open")), "a").join(texts.select(F.col("id").alias("b"), "text"), "b").select("a", "open", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [align(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(verdicts, pa.int32())], names=["id", "verdict"])

    judged = pairs.mapInArrow(run, f"id {dict(ends.dtypes)['id']}, verdict int")
    if not crowds.isEmpty():
        judged = judged.unionByName(crowd_verdicts(probes, met, crowds, every))
    of_text = judged.join(ends.where("style > 0").select("id", "text_id"), "id").groupBy("text_id").agg(F.max("verdict").alias("most"), F.min("verdict").alias("least"))
    return of_text.select("text_id", (F.col("most") == 1).cast("int").alias("goes_on"), ((F.col("most") < 1) & (F.col("least") == -1)).cast("int").alias("ends_there"))


def field_limits(ends: DataFrame) -> DataFrame:
    """(source, n_chars): lengths at which the differing open ends of a source pile up far above the lengths around them.

    A limit is the length of most open ends within MOVED, since cuts may be moved back to a word's end; the lengths below it belong to
    it as far as they stand out too.
    """
    differing = ends.where("style > 0").select("source", "n_chars", "text_id").distinct()
    sizes = differing.groupBy("source", "n_chars").agg(F.count("*").alias("open"))
    # lengths are few: one row for each of a source, so the windows below are small whatever the corpus
    lengths = Window.partitionBy("source").orderBy("n_chars")
    total = lambda low, high: F.coalesce(F.sum("open").over(lengths.rangeBetween(low, high)), F.lit(0))
    near = (total(-12 - MOVED, -1 - MOVED) + total(1, 12)) / 24.0
    marked = sizes.select("*", near.alias("near"), total(-MOVED, 0).alias("run"), F.max("open").over(lengths.rangeBetween(-MOVED, MOVED)).alias("most"))
    peaks = marked.where((F.col("open") == F.col("most")) & (F.col("run") >= 8) & (F.col("run") > 6 * (MOVED + 1) * F.col("near") + 6))
    below = peaks.select("source", F.explode(F.sequence(F.col("n_chars") - MOVED, F.col("n_chars"))).alias("n_chars"), "near", F.col("n_chars").alias("limit"))
    joined = below.join(sizes.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")) & (below["n_chars"] == sizes["n_chars"]))
    return joined.where((below["n_chars"] == F.col("limit")) | (F.col("open") > 2 * F.col("near"))).select("source", below["n_chars"].alias("n_chars")).distinct()


def verdicts(df: DataFrame, id_col: str = "listing_id", text_col: str = "description", source_col: str = "source") -> DataFrame:
    """(id, source, truncated, evidence, terminality) of every non-blank text."""
    ends, counts = survey(df, id_col, text_col, source_col)
    judged = aligned(df, ends, id_col, text_col)
    open_ends = ends.where("style > 0").select("id", "text_id", "source", "n_chars", "style", "k2", "k1", F.element_at(F.array(*[F.lit(kind_key(k)) for k in range(len(KINDS))]), F.col("kind") + 1).alias("k0"))
    keys = open_ends.select(F.explode(F.array("k2", "k1")).alias("key")).where("key is not null").distinct()
    wanted = cut_lineage(wanted_counts(counts, cut_lineage(keys)).withColumn("rate", F.col("ends") / F.col("n")))
    scored = open_ends
    for k in ("k2", "k1", "k0"):
        scored = scored.join(wanted.select(F.col("key").alias(k), F.when((F.col("n") >= KNOWN) | (F.lit(k) == "k0"), F.col("rate")).alias(f"r_{k}")), k, "left")
    # a word the corpus knows as no sentence end settles it even in an unknown context
    rate = F.coalesce("r_k2", "r_k1", "r_k0", F.lit(0.0))
    # one row for each limit of a source: fewer than there are lengths; a text cut there is cut wherever else it stands
    limits = F.broadcast(field_limits(ends).withColumnsRenamed({"source": "_source", "n_chars": "_n_chars"}))
    limited = open_ends.join(limits, F.col("source").eqNullSafe(F.col("_source")) & (F.col("n_chars") == F.col("_n_chars"))).select("text_id").distinct()
    scored = scored.join(limited.withColumn("at_limit", F.lit(True)), "text_id", "left").join(judged, "text_id", "left")
    bound = F.when(F.coalesce("at_limit", F.lit(False)), F.lit(LOW_AT_LIMIT)).otherwise(F.lit(LOW))
    by_words = rate < bound
    decided = scored.select(
        "id",
        "source",
        rate.alias("terminality"),
        F.when(F.col("style") >= 2, True).when(F.coalesce("goes_on", F.lit(0)) > 0, True).when(F.coalesce("ends_there", F.lit(0)) > 0, False).otherwise(by_words).alias("truncated"),
        F.when(F.col("style") == 2, "character").when(F.col("style") == 3, "mark").when(F.coalesce("goes_on", F.lit(0)) + F.coalesce("ends_there", F.lit(0)) > 0, "copy").otherwise("words").alias("evidence"),
    )
    finished = ends.where("style = 0").select("id", "source", F.lit(None).cast("double").alias("terminality"), F.lit(False).alias("truncated"), F.lit("finished").alias("evidence"))
    return decided.unionByName(finished).withColumnRenamed("id", id_col)


def truncated(df: DataFrame, id_col: str = "listing_id", text_col: str = "description", source_col: str = "source") -> DataFrame:
    """(id) of the texts that were cut off."""
    return verdicts(df, id_col, text_col, source_col).where("truncated").select(id_col)


def source_report(df: DataFrame, id_col: str = "listing_id", text_col: str = "description", source_col: str = "source") -> DataFrame:
    """(source, texts, truncated, share) of each source; the null source is one of them."""
    judged = verdicts(df, id_col, text_col, source_col)
    return judged.groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("truncated").cast("long")).alias("truncated")).withColumn("share", F.col("truncated") / F.col("texts"))
