"""Term weights and sparse similarity (L4-L6 of the survey)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage, written

# Lengths of character n-grams, terms of the vocabulary, similarity of an edge.
LOW, HIGH, MOST_TERMS, ALIKE = 3, 5, 12_000, 0.88
#: Bands of minima of two-word sequences, of which two texts share two or more before they are compared, however many texts a band holds.
BANDS, ROWS, WIDTH = 32, 3, 2
#: Texts of a band above which its pairs are dealt out by blocks, pairs dealt out at once, words and vectors that a worker remembers; none of them decides a result.
BAND_TEXTS, PAIRS, MEMO, VECTORS = 1_000, 1_000_000, 200_000, 4_000


def char_ngrams(df: DataFrame, id_col: str, text_col: str, low: int = 3, high: int = 5) -> DataFrame:
    """(id, term): character n-grams of words padded by a space, as many times as they occur; a padded word shorter than n gives itself once."""
    words = df.select(F.col(id_col), F.explode(F.split(F.lower(F.col(text_col)), r"\s+")).alias("_w")).where("_w <> ''").select(id_col, F.concat(F.lit(" "), "_w", F.lit(" ")).alias("_p"))

    def of_length(n: int):
        whole = F.transform(F.sequence(F.lit(1), F.length("_p") - (n - 1)), lambda i: F.substr("_p", i, F.lit(n)))
        return F.when(F.length("_p") >= n, whole).otherwise(F.array("_p") if n == low else F.array().cast("array<string>"))

    grams = [of_length(n) for n in range(low, high + 1)]
    return words.select(id_col, F.explode(F.concat(*grams)).alias("term"))


def tfidf(terms: DataFrame, id_col: str, term: str) -> DataFrame:
    """(id, term, weight): 1 + ln tf, times ln((1 + N) / (1 + df)) + 1, each text scaled to length 1.

    Document frequencies are joined on the term; the join is the only shuffle besides the grouping, and frequent terms are folded
    before it.
    """
    tf = terms.groupBy(id_col, F.col(term).alias("term")).agg((1 + F.ln(F.count("*"))).alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = tf.agg(F.countDistinct(id_col).alias("_n"))
    w = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.ln((1.0 + F.col("_n")) / (1 + F.col("df"))) + 1))  # one row
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.withColumn("weight", F.col("w") / norm).select(id_col, "term", "weight")


def similar(weights: DataFrame, id_col: str, queries: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, similarity, rank): the k most alike texts of each text of a stated query set, ties by id.

    Texts meet on shared terms only; products are summed map-side before the shuffle.
    """
    left = weights.join(queries.select(id_col), id_col, "left_semi").select(F.col(id_col).alias("a"), "term", F.col("weight").alias("wa"))
    right = weights.select(F.col(id_col).alias("b"), "term", F.col("weight").alias("wb"))
    dots = left.join(right, "term").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("similarity", 9)), "b"))
    return dots.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("a").alias(id_col), F.col("b").alias("neighbour"), "similarity", "rank")


def word_grams(word: str, low: int = LOW, high: int = HIGH) -> list[str]:
    """n-grams of one padded word; a padded word no longer than n gives itself once."""
    padded = f" {word} "
    return [padded[i : i + n] for n in range(low, high + 1) if n <= len(padded) or n == low for i in range(max(1, len(padded) - n + 1))]


def vocabulary(texts: DataFrame, text_col: str, most: int = MOST_TERMS) -> tuple[dict[str, float], int]:
    """({n-gram: inverse document frequency} of the ``most`` frequent n-grams of the corpus, number of texts); ties go to the smaller n-gram.

    Words are counted first, and n-grams over the differing words; a second pass counts the texts of the n-grams that are kept.
    """
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                n.update((text or "").lower().split())
            yield pa.RecordBatch.from_arrays([pa.array([*n], pa.string()), pa.array([*n.values()], pa.int64())], names=["word", "n"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, int] = {}
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for g in word_grams(word):
                    total[g] = total.get(g, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array([*total], pa.string()), pa.array([*total.values()], pa.int64())], names=["term", "total"])

    narrow = texts.select(F.col(text_col).cast("string"))
    counted = narrow.mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    kept = [r.term for r in counted.mapInArrow(grams, "term string, total long").groupBy("term").agg(F.sum("total").alias("total")).orderBy(F.desc("total"), "term").limit(most).collect()]  # the size of the vocabulary is its parameter
    shared = texts.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(kept)})

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(shared.value, np.zeros(len(shared.value)))
        docs, held, n = np.zeros(len(shared.value), np.int64), np.zeros(len(shared.value), bool), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0).to_pylist():
                found = vectors.terms(text)
                held[found] = True
                docs += held
                held[found] = False
        at = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(docs[at], n))], names=["term", "docs"])

    docs = {r.term: r.docs for r in narrow.mapInArrow(holding, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect()}  # as many rows as the vocabulary has
    n = docs.get(-1, 0)
    return {t: float(np.log((1.0 + n) / (1 + docs[i])) + 1) for i, t in enumerate(kept)}, n


class Vectors:
    """Weights of texts over a vocabulary: 1 + ln tf times inverse document frequency, scaled to length 1."""

    def __init__(self, number: dict[str, int], idf: np.ndarray) -> None:
        self.number, self.idf = number, idf
        self.words: dict[str, np.ndarray] = {}

    def terms(self, text: str | None) -> np.ndarray:
        """Numbers of the n-grams of a text, as often as they occur."""
        if len(self.words) > MEMO:
            self.words = {}
        found = []
        for word in (text or "").lower().split():
            if (known := self.words.get(word)) is None:
                known = self.words[word] = np.array([self.number[g] for g in word_grams(word) if g in self.number], dtype=np.int64)
            found.append(known)
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(terms in ascending order, weights) of a text."""
        n = np.bincount(self.terms(text), minlength=len(self.idf))
        at = np.flatnonzero(n)
        w = (1 + np.log(n[at])) * self.idf[at]
        return at, w / max(float(np.sqrt(w @ w)), 1e-12)


def _bands(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, band) of every text: minima of its word sequences under fixed pseudo-random orders; texts of fewer words band by themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.random.default_rng(29).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            keys = []
            for text in batch.column(1).to_pylist():
                words = (text or "").lower().split()
                runs = np.array([hash_of(" ".join(words[i : i + WIDTH])) for i in range(max(1, len(words) - WIDTH + 1))], dtype=np.uint64)
                mixed = runs[None, :] * seeds[:, None]
                low = (mixed ^ (mixed >> np.uint64(31))).min(axis=1).reshape(BANDS, ROWS)
                keys.append((low[:, 0] * seeds[:BANDS] ^ (low[:, 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (low[:, 2] * np.uint64(0xC2B2AE3D27D4EB4F))) + np.arange(BANDS, dtype=np.uint64))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS))), pa.array(flat)], names=["id", "band"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, band long")


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal values."""
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(keys)))


def _pairs_of_runs(start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within each run, about PAIRS at once."""
    for size in np.unique(length[length > 1]):
        first = start[length == size]
        if size > BAND_TEXTS:
            step = max(1, PAIRS // int(size))
            for s in first:
                for low in range(0, int(size), step):
                    i, j = np.meshgrid(np.arange(low, min(low + step, size)), np.arange(low, size), indexing="ij")
                    yield s + i[i < j], s + j[i < j]
        else:
            i, j = np.triu_indices(size, 1)
            step = max(1, PAIRS // len(i))
            for low in range(0, len(first), step):
                s = first[low : low + step, None]
                yield (s + i).ravel(), (s + j).ravel()


def _meeting(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (key, id, later) of whole keys whose lists share a value; rows are in order of key and id."""
    group = np.repeat(np.arange(len(lengths := _runs(rows.column("key").to_numpy())[1])), lengths)
    later = rows.column("later").combine_chunks()
    later = later.chunk(0) if isinstance(later, pa.ChunkedArray) else later
    held = np.diff(later.offsets.to_numpy())
    member = np.repeat(np.arange(len(rows)), held)
    both = group[member] << 16 | (later.flatten().to_numpy().astype(np.int64) & 0xFFFF)
    order = np.argsort(both, kind="stable")
    member = member[order]
    ids = rows.column("id").combine_chunks()
    for i, j in _pairs_of_runs(*_runs(both[order])):
        pair = np.unique(member[i] * len(rows) + member[j])
        x, y = pair // len(rows), pair % len(rows)
        x, y = x[x != y], y[x != y]
        yield pa.RecordBatch.from_arrays([y_.chunk(0) if isinstance(y_ := ids.take(pa.array(z)), pa.ChunkedArray) else y_ for z in (x, y)], names=["a", "b"])


def candidates(bands: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of ids that share two bands or more, each once, from rows (id, band).

    The bands of an id are put in one order for all, those of few ids first. Two ids that share two bands meet in a band that is the last of
    neither, and share a later one: so the most crowded band of each id sends nothing, and in the others only ids with a later band in
    common are paired. Later bands are compared by 16 bits; what these let through too much is told by the similarity.
    """
    kind = dict(bands.dtypes)["id"]
    met = bands.withColumn("n", F.count("*").over(Window.partitionBy("band"))).where("n > 1")
    lists = met.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "band"))).alias("x")).where(F.size("x") > 1).select("id", F.col("x.band").alias("x"))
    short = lambda i: F.transform(F.slice("x", i + 2, F.size("x")), lambda k: (F.pmod(k, F.lit(1 << 16)) - (1 << 15)).cast("short"))
    rows = lists.select("id", "x", F.explode(F.sequence(F.lit(0), F.size("x") - 2)).alias("i")).select(F.get("x", F.col("i")).alias("key"), "id", short(F.col("i")).alias("later"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
            whole = [*pending, batch.slice(0, last)] if last else pending
            if pending and len(key) and (last or pending[-1].column(0)[-1].as_py() != key[0]):
                yield from _meeting(pa.Table.from_batches(whole))
                pending = []
            elif last:
                yield from _meeting(pa.Table.from_batches(whole))
            if len(key):
                pending.append(batch.slice(last))
        if pending:
            yield from _meeting(pa.Table.from_batches(pending))

    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def alike_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = ALIKE, most: int = MOST_TERMS) -> DataFrame:
    """(a, b, similarity) of differing texts, a < b, whose n-gram vectors have at least a cosine of ``threshold``.

    ``df`` has one row for each differing text. Texts meet in min-hash bands; every pair that shares two of them is verified exactly on the vectors, however
    many texts a band holds. Texts are sent to their pairs, not vectors, which are ten times as large.
    """
    kind = dict(df.dtypes)[id_col]
    found = written(candidates(_bands(df, id_col, text_col)))
    terms, _ = vocabulary(df, text_col, most)
    shared = df.sparkSession.sparkContext.broadcast(({t: i for i, t in enumerate(terms)}, np.array([*terms.values()], dtype=np.float64)))  # as many entries as the vocabulary has

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, known, dense, last = Vectors(*shared.value), {}, np.zeros(len(shared.value[1])), None
        for batch in batches:
            out = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if last is None or last != b:  # rows come in order of b
                    dense[:] = 0
                    at, w = vectors.of(y)
                    dense[at] = w
                    last = b
                if (v := known.get(x)) is None:
                    if len(known) >= VECTORS:
                        known.clear()
                    v = known[x] = vectors.of(x)
                out.append(float(dense[v[0]] @ v[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    side = lambda k: df.select(F.col(id_col).alias(k), F.col(text_col).cast("string").alias(f"t{k}"))
    joined = found.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(cosine, f"a {kind}, b {kind}, similarity double").where(F.col("similarity") >= threshold)
