"""Packing texts into containers of fixed token capacity (p9): bound-certified repacking.

Texts are spread over partitions of bounded size; each packs its own by best-fit decreasing and computes lower bounds on its
container count from dual-feasible functions. A partition whose count meets its bound is certified. Containers that stay loose,
and at least the loosest one of every partition, are opened again: their texts are exchanged, spread anew over far fewer
partitions and packed again, until the opened texts fit one partition or a round opens no fewer texts than the one before. What is then above the bound is told by ``summary``. The driver sees counts only.

A text is split only if it is longer than the capacity: into full containers and one rest. Null and empty texts have no tokens
and ride along in any container. Ties of size are packed in order of id; repeated rows are items of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.session import cut_lineage

CAPACITY = 4096
#: Items that one partition packs.
PART_ITEMS = 50_000
#: Containers filled less than this are opened again.
TIGHT = 0.995


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Containers that any packing of these sizes needs."""
    return histogram_bound(np.bincount(sizes, minlength=capacity + 1).astype(np.int64), capacity)


def histogram_bound(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """Containers that any packing needs, by two families of dual-feasible functions; ``count`` holds the items of each size from 0."""
    x = np.arange(capacity + 1, dtype=np.int64)
    total = int((count * x).sum())
    best = -(-total // capacity)
    # large items count as full where only items below a threshold fit beside them, and those count as nothing
    weight, number = np.cumsum(count * x), np.cumsum(count)
    small = np.arange(0, capacity // 2 + 1)
    below = np.where(small > 0, weight[np.maximum(small - 1, 0)], 0)
    large = number[capacity] - number[capacity - small]
    middle = weight[capacity - small] - below
    best = max(best, int((-(-(middle + large * capacity) // capacity)).max()))
    # stretched roundings
    for k in range(1, 33):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, (scaled // capacity) * capacity)  # in units of 1/k
        best = max(best, int(-(-int((count * value).sum()) // (capacity * k))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, fill of each container); items must come in descending order."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    residuals = 0  # bit r is set while a container with r free tokens is open
    place = np.zeros(len(sizes), dtype=np.int64)
    fill: list[int] = []
    for i, size in enumerate(sizes.tolist()):
        fitting = residuals >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            at = open_bins[free].pop()
            if not open_bins[free]:
                residuals &= ~(1 << free)
            fill[at] += size
        else:
            at, free = len(fill), capacity
            fill.append(size)
        place[i] = at
        open_bins[free - size].append(at)
        residuals |= 1 << (free - size)
    return place, np.array(fill, dtype=np.int64)


def pieces(tokens: DataFrame, id_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, tokens): texts longer than the capacity in full pieces and a rest, all others as they are."""
    n = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)).cast("int")
    split = tokens.select(F.col(id_col).alias("id"), "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return split.select("id", "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("int").alias("tokens"))


def _packed(items: DataFrame, round_no: int, parts: int, capacity: int) -> DataFrame:
    """(id, piece, tokens, container, fill, loosest, bins, bound) with containers numbered by round, partition and place."""
    kind = dict(items.dtypes)["id"]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("tokens", "descending"), ("id", "ascending"), ("piece", "ascending")])
        sizes = group.column("tokens").to_numpy()
        place, fill = best_fit_decreasing(sizes, capacity)
        part = group.column("part")[0].as_py()
        base = (round_no << 58) + (part << 26)
        n = len(sizes)
        return pa.table(
            {
                "id": group.column("id"), "piece": group.column("piece"), "tokens": group.column("tokens"), "container": pa.array(place + base),
                "fill": pa.array(fill[place].astype(np.int32)), "loosest": pa.array(fill[place] == fill.min()),
                "bins": pa.array(np.full(n, len(fill), np.int64)), "bound": pa.array(np.full(n, lower_bound(sizes, capacity), np.int64)),
            }
        )

    spread = items.withColumn("part", F.pmod(F.xxhash64("id", "piece", F.lit(round_no)), F.lit(parts)))
    return spread.groupBy("part").applyInArrow(run, f"id {kind}, piece int, tokens int, container long, fill int, loosest boolean, bins long, bound long")


def pack(tokens: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, part_items: int = PART_ITEMS) -> DataFrame:
    """(id, piece, tokens, container_id) of every text; ``tokens`` has (id, tokens)."""
    items = cut_lineage(pieces(tokens, id_col, capacity))
    done: DataFrame | None = None
    round_no, before = 0, None
    while True:
        n = items.count()
        parts = max(1, -(-n // part_items))
        packed = cut_lineage(_packed(items, round_no, parts, capacity))
        last = parts == 1 or (before is not None and n >= before)
        # a certified partition keeps all but its loosest container, which others may still complete
        loose = F.col("loosest") | ((F.col("bins") > F.col("bound")) & (F.col("fill") < TIGHT * capacity))
        kept = packed if last else packed.where(~loose)
        closed = kept.select("id", "piece", "tokens", "container")
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        items, before, round_no = packed.where(loose).select("id", "piece", "tokens"), n, round_no + 1
    return done.select(F.col("id").alias(id_col), "piece", "tokens", F.col("container").alias("container_id"))


def summary(packed: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row: items, tokens, containers, the bound that no packing can beat, and the share of used space."""
    sizes = packed.groupBy("tokens").agg(F.count("*").alias("n"))  # at most capacity + 1 rows
    totals = packed.agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.countDistinct("container_id").alias("containers"))

    def bound(table: pa.Table) -> pa.Table:
        count = np.zeros(capacity + 1, dtype=np.int64)
        np.add.at(count, table.column("tokens").to_numpy(), table.column("n").to_numpy())
        return pa.table({"bound": pa.array([histogram_bound(count, capacity)], pa.int64())})

    bounds = sizes.groupBy(F.lit(0).alias("one")).applyInArrow(bound, "bound long")
    return totals.crossJoin(bounds).withColumn("used", F.col("tokens") / (F.col("containers") * capacity))  # one row beside one row


def containers(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(id, piece, tokens, container_id) of every document, sizes in tokens of a public vocabulary."""
    return pack(bpe.count_tokens(documents, id_col, text_col, vocabulary), id_col, capacity)
