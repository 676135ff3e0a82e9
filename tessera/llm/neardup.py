"""Near-duplicate texts by tensored min-hash banding with exact verification (p7).

Two small collections of sketches are computed for each text: A of single minima and B of pairs of minima. Every pair of an
A and a B sketch keys one table, so |A| x |B| tables of three minima each cost only |A| + 2|B| minima. Texts that meet in
at least two tables, or in one and in two of a dozen further sketches (marks), become candidates; their distinct three-word
sequences are then compared exactly.

Exact copies are folded before anything is banded: a class is one text with its members. Tables that hold very many classes
(a shared boilerplate, say) aren't paired as they stand, since most of their pairs meet nowhere else: each text carries the list of
its crowded tables, which is compared where a pair meets in a small table; all but the most crowded of each text are paired in
blocks, and all of them split by marks. That finds every pair that meets often enough, so candidates don't depend on what counts as
crowded. Nothing is collected to the driver but counts.

Texts that are null or shorter than ``min_chars`` in ordinary form have no partners; ties do not exist, since every pair above the
threshold is kept; repeated rows with equal text are copies, provided their ids differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import sketch
from tessera.llm.confusables import ordinary
from tessera.operators.graph import components
from tessera.session import cut_lineage, small_or_shuffled

WIDTH = 3  # words of a compared sequence
BAND_WIDTH = 4  # words of a banded sequence: longer ones set chance apart from copying, shorter ones survive more edits
A, B = 5, 12
THRESHOLD = 0.5
MIN_CHARS = 300
#: Classes that one table may hold before it counts as crowded, and those of a block of crowded ones; candidates don't depend on them.
TABLE_ROWS = 64
BLOCK_ROWS = 512
#: One in so many texts is looked at to foresee tables of very many texts.
SAMPLE = 256
#: Copies of one text up to which p7_found writes every pair of listings; above it copies are linked to their class only.
EXPANDED_COPIES = 200
_SEED_A, _SEED_B, _SEED_C = sketch.seeds(A, 11), sketch.seeds(2 * B, 23), sketch.seeds(24, 37)


def _texts(batch: pa.RecordBatch, min_chars: int) -> tuple[np.ndarray, sketch.Batch]:
    """Positions of the texts that are long enough, and their words."""
    at, listed = [], []
    for i, t in enumerate(batch.column(1).to_pylist()):
        if t is not None and len(t) >= min_chars and len(plain := ordinary(t)) >= min_chars:
            at.append(i)
            listed.append(sketch.split_ordinary(plain))
    return np.array(at, dtype=np.int64), sketch.Batch(listed)


def _long_lists(x: np.ndarray, held: np.ndarray) -> pa.Array:
    """Rows of x as lists; rows that aren't held are empty lists."""
    ends = np.concatenate([[0], np.cumsum(held * x.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(x[held]).reshape(-1).view(np.int64)))


def _class_hashes(texts: sketch.Batch) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word list, order included."""
    n = len(texts.sizes)
    place = np.arange(len(texts.hashes), dtype=np.uint64) - np.repeat(texts.starts, texts.sizes).astype(np.uint64) + np.uint64(1)
    both = np.zeros((2, n), np.uint64)
    full = np.flatnonzero(texts.sizes > 0)
    if len(full):
        for k, salt in enumerate((np.uint64(0), np.uint64(0x5851F42D4C957F2D))):
            both[k, full] = np.add.reduceat(sketch.mix(sketch.mix(texts.hashes ^ salt) * place), texts.starts[full])
    return both[0], both[1]


def _table_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    a = sketch.minima(values, offsets, _SEED_A)
    b = sketch.minima(values, offsets, _SEED_B)
    pairs = [sketch.combine([b[:, 2 * j], b[:, 2 * j + 1]], 1000 + j) for j in range(B)]
    return np.stack([sketch.combine([a[:, i], pairs[j]], i * B + j) for i in range(A) for j in range(B)], axis=1)


def _marks(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte of each of twelve further sketches, eight of them in a long and four in an int."""
    c = sketch.minima(values, offsets, _SEED_C)
    marks = [sketch.combine([c[:, 2 * j], c[:, 2 * j + 1]], 5000 + j) & np.uint64(255) for j in range(len(_SEED_C) // 2)]
    eight, four = (sum((m << np.uint64(8 * k) for k, m in enumerate(part)), np.zeros(len(c), np.uint64)) for part in (marks[:8], marks[8:]))
    return eight.view(np.int64), four.astype(np.uint32).view(np.int32)


def _mark_places() -> list[tuple[str, int]]:
    """(column, mask) of each mark."""
    return [("m8", int(np.uint64(255 << 8 * k).astype(np.int64))) for k in range(8)] + [("m4", int(np.uint32(255 << 8 * k).astype(np.int32))) for k in range(4)]


def _alike_marks(left: str, right: str) -> Column:
    """1 if two texts share two marks or more, which counts as one further meeting, else 0."""
    count = " + ".join(f"int(({left}{c} ^ {right}{c}) & {'bigint' if c == 'm8' else 'int'}({mask}) = 0)" for c, mask in _mark_places())
    return F.expr(f"int({count} >= 2)")


def fingerprints(df: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, c1, c2, m8, m4, keys ARRAY<LONG>) of each long enough text: class hashes of 128 bits, marks and keys of its tables."""
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") >= min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                at, texts = _texts(batch, min_chars)
                if not len(at):
                    continue
                c1, c2 = _class_hashes(texts)
                sequences = texts.shingles(BAND_WIDTH)
                columns = [batch.column(0).take(pa.array(at)), *(pa.array(c) for c in (c1.view(np.int64), c2.view(np.int64), *_marks(*sequences))), _long_lists(_table_keys(*sequences), texts.sizes >= BAND_WIDTH)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "c1", "c2", "m8", "m4", "keys"])

    kind = dict(df.dtypes)[id_col]
    return narrow.mapInArrow(run, f"id {kind}, c1 long, c2 long, m8 long, m4 int, keys array<long>")


def shingle_sets(df: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, grams ARRAY<LONG>, bits ARRAY<LONG>): distinct hashes of the word sequences of each text, and for each value of their first
    byte whether it is that of an odd number of them."""
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4000):
                batch = whole.slice(start, 4000)
                texts = sketch.Batch([sketch.raw_words(t) if t else [] for t in batch.column(1).to_pylist()])
                values, offsets = texts.shingles(width)
                sets = [np.unique(values[offsets[i] : offsets[i + 1]]) for i in range(batch.num_rows)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                first = np.repeat(np.arange(batch.num_rows) * 256, np.diff(ends)) + (flat >> np.uint64(56)).astype(np.int64)
                odd = (np.bincount(first, minlength=256 * batch.num_rows) & 1).astype(np.uint8).reshape(-1, 256)
                bits = _long_lists(np.packbits(odd, axis=1).view(np.uint64), np.ones(batch.num_rows, dtype=bool))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))), bits], names=["id", "grams", "bits"])

    kind = dict(df.dtypes)[id_col]
    return narrow.mapInArrow(run, f"id {kind}, grams array<long>, bits array<long>")


def classes(prints: DataFrame) -> DataFrame:
    """(id, rep, copies): each text with the smallest id of its exact copies and their number."""
    reps = prints.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    return prints.join(reps, ["c1", "c2"]).select("id", "rep", "copies")


def _met(keyed: DataFrame) -> DataFrame:
    """(id, key, n) of the tables that hold two texts or more."""
    return keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")


def _crowd_pairs(sets: DataFrame, meetings: int) -> DataFrame:
    """(a, b, small, others) of texts, a < b, that share crowded tables, ``meetings`` of them or one less and two marks; ``sets`` holds (id, m8, m4,
    crowds ARRAY<STRUCT<n, key>>), the emptier tables first. The emptiest of ``meetings`` shared tables is not among the last ``meetings`` - 1 of
    either text, so those are paired only where a mark is shared too."""
    texts = sets.select("id", "m8", "m4", F.col("crowds.key").alias("crowds"))
    some = texts.withColumn("key", F.explode(F.slice("crowds", 1, F.greatest(F.size("crowds") - (meetings - 1), F.lit(0))))).withColumn("part", F.col("key"))
    marks = F.array(*[F.xxhash64("key", F.lit(k), F.expr(f"{c} & {'bigint' if c == 'm8' else 'int'}({mask})")) for k, (c, mask) in enumerate(_mark_places())])
    rows = cut_lineage(some.unionByName(texts.withColumn("key", F.explode("crowds")).withColumn("part", F.explode(marks))))
    parts = rows.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = rows.join(small_or_shuffled(cut_lineage(parts)), "part").withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    # a block meets itself and those after it
    left = dealt.select("part", "key", *[F.col(c).alias(f"x_{c}") for c in ("id", "crowds", "m8", "m4")], F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = dealt.select("part", *[F.col(c).alias(f"y_{c}") for c in ("id", "crowds", "m8", "m4")], F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), "block")).alias("i"))
    shared = F.array_intersect("x_crowds", "y_crowds")
    pairs = left.join(right, ["part", "i", "j"]).where("x_id != y_id and (i < j or x_id < y_id)")
    others = F.size(shared) + _alike_marks("x_", "y_")
    pairs = pairs.where((F.try_element_at(shared, F.lit(1)) == F.col("key")) & (others >= meetings))
    return pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), F.lit(0).alias("small"), others.alias("others"))


def candidates(prints: DataFrame, members: DataFrame, meetings: int = 2) -> DataFrame:
    """(a, b) of different texts, a < b, that meet in at least ``meetings`` tables, or in one less and in two marks.

    Tables of very many texts are foreseen from one in SAMPLE texts, so that their rows are never sorted into one task; the sample
    decides only the route.
    """
    copies = cut_lineage(members.where("id != rep").select("id"))
    apart = small_or_shuffled(copies)
    keyed = prints.select("id", "keys").join(apart, "id", "left_anti").select("id", F.explode("keys").alias("key"))
    sampled = keyed.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    heavy = cut_lineage(sampled.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= 8).select("key"))
    n_heavy = heavy.count()
    light = keyed.join(small_or_shuffled(heavy, n_heavy), "key", "left_anti") if n_heavy else keyed
    met = cut_lineage(_met(light))
    crowded = met.where(F.col("n") > TABLE_ROWS).select("id", "key", "n")
    if n_heavy:
        inside = cut_lineage(keyed.join(small_or_shuffled(heavy, n_heavy), "key", "left_semi").select("id", "key"))
        crowded = crowded.unionByName(inside.join(small_or_shuffled(cut_lineage(inside.groupBy("key").agg(F.count("*").alias("n"))), n_heavy), "key"))
    tables = met.where(F.col("n") <= TABLE_ROWS).select("id", "key")
    crowded = cut_lineage(crowded)
    n_crowded = crowded.count()
    marks = prints.select("id", "m8", "m4")
    tables = tables.join(marks, "id")
    if n_crowded:
        sets = cut_lineage(crowded.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("crowds")).join(marks, "id"))
        tables = tables.join(small_or_shuffled(sets.select("id", F.col("crowds.key").alias("crowds")), n_crowded), "id", "left")
    else:
        tables = tables.withColumn("crowds", F.lit(None).cast("array<long>"))
    left, right = (tables.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "crowds", "m8", "m4")]) for side in "xy")
    shared = F.coalesce(F.size(F.array_intersect("x_crowds", "y_crowds")), F.lit(0)) if n_crowded else F.lit(0)
    others = shared + _alike_marks("x_", "y_")
    pairs = left.join(right, "key").where("x_id < y_id").select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), F.lit(1).alias("small"), others.alias("others"))
    if n_crowded:
        pairs = pairs.unionByName(_crowd_pairs(sets, meetings))
    return pairs.groupBy("a", "b").agg((F.sum("small") + F.max("others")).alias("n")).where(F.col("n") >= meetings).select("a", "b")


def similar_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives with their similarity, membership of every long enough text)."""
    prints = cut_lineage(fingerprints(df, id_col, text_col, min_chars))
    members = cut_lineage(classes(prints.select("id", "c1", "c2")))
    found = cut_lineage(candidates(prints, members))
    ids = found.select(F.col("a").alias("id")).union(found.select(F.col("b").alias("id"))).distinct()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small_or_shuffled(cut_lineage(ids)), "id", "left_semi")
    grams = cut_lineage(shingle_sets(texts, "id", "text"))
    # two sets differ in at least as many sequences as their bits do: most candidates that are too different are known by that without their sequences
    sides = [grams.select(F.col("id").alias(c), F.size("grams").alias(f"n{c}"), F.col("bits").alias(f"b{c}")) for c in "ab"]
    differing = F.expr(" + ".join(f"bit_count(ba[{k}] ^ bb[{k}])" for k in range(4)))
    possible = (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    found = cut_lineage(found.join(sides[0], "a").join(sides[1], "b").where(differing <= possible).select("a", "b"))
    joined = found.join(grams.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    similarity = both / (F.size("ga") + F.size("gb") - both)
    return joined.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold), members


def listing_pairs(df: DataFrame, id_col: str = "listing_id", text_col: str = "description", threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id_a, id_b) of all rows whose texts are similar enough, smaller id first.

    Rows of equal text are partners too. Up to EXPANDED_COPIES rows of one text every pair is written; a text with more rows stands by
    its representative, to which its other rows are linked, so that the result stays in proportion to rows and differing texts.
    """
    pairs, members = similar_pairs(df, id_col, text_col, threshold, min_chars)
    spread = members.where(F.col("copies") <= EXPANDED_COPIES).select("id", "rep")
    crowds = members.where(F.col("copies") > EXPANDED_COPIES)
    stand = spread.union(crowds.where("id = rep").select("id", "rep"))
    across = pairs.join(stand.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a").join(stand.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b")
    several = spread.join(members.where((F.col("copies") > 1) & (F.col("copies") <= EXPANDED_COPIES)).select("id"), "id", "left_semi")
    within = several.select("rep", F.col("id").alias("ia")).join(several.select("rep", F.col("id").alias("ib")), "rep").where("ia < ib")
    linked = crowds.where("id != rep").select(F.col("rep").alias("ia"), F.col("id").alias("ib"))
    every = across.select("ia", "ib").union(within.select("ia", "ib")).union(linked)
    return every.select(F.least("ia", "ib").alias(f"{id_col}_a"), F.greatest("ia", "ib").alias(f"{id_col}_b"))


def groups(df: DataFrame, id_col: str = "listing_id", text_col: str = "description", threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, class_id, group_id, links) of every long enough text: its exact copies, its connected group, links of its class to other texts."""
    pairs, members = similar_pairs(df, id_col, text_col, threshold, min_chars)
    if not min_chars:
        pairs = pairs.unionByName(few_word_pairs(df, members, id_col, text_col, threshold)).distinct()
    pairs = cut_lineage(pairs)
    grouped = components(pairs, "a", "b")
    links = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    out = members.join(grouped.select(F.col("id").alias("rep"), "component"), "rep", "left").join(links, "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def few_word_pairs(df: DataFrame, members: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of class representatives of which one has a single word sequence, which bands can't tell; an equi-join on it."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(members.where("id = rep").select("id"), "id", "left_semi")
    most = int(1 / threshold)
    grams = cut_lineage(shingle_sets(texts, "id", "text").where(F.size("grams").between(1, most)).select("id", F.size("grams").alias("n"), F.explode("grams").alias("gram")))
    joined = grams.where("n = 1").select(F.col("id").alias("x"), "gram").join(grams.select(F.col("id").alias("y"), "n", "gram"), "gram").where("x != y")
    return joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.lit(1.0) / F.col("n")).alias("similarity")).distinct()


def listing_groups(df: DataFrame, id_col: str = "listing_id", text_cols: tuple[str, ...] = ("description", "title"), threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, group_id, links, and these with the column's name before them for further columns) of every row, short texts included.

    Rows whose text is null or has no word are classes of their own.
    """
    out = df.select(id_col)
    for k, column in enumerate(text_cols):
        worded = df.select(id_col, column).where(F.col(column).rlike(r"[\p{L}\p{N}]"))
        found = groups(worded, id_col, column, threshold, 0)
        before = f"{column}_" if k else ""
        out = out.join(found.withColumnsRenamed({c: f"_{c}" for c in ("class_id", "group_id", "links")}), id_col, "left")
        own = {f"{before}class_id": F.coalesce("_class_id", id_col), f"{before}group_id": F.coalesce("_group_id", id_col), f"{before}links": F.coalesce("_links", F.lit(0))}
        out = out.withColumns(own).drop("_class_id", "_group_id", "_links")
    return out
