"""Matching place names to a fixed list of districts (S19 of the survey)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.chars import plain_text

#: Names that a district list may hold to be sent to the workers.
MOST_NAMES = 10_000
# Least score of a match, score of a contained name, and what is kept beside a good match or without one.
LEAST, CONTAINED, GOOD, BESIDE, WITHIN, FEW = 0.72, 0.92, 0.90, 0.86, 0.06, 5


class Gazetteer:
    """Scores of names against known ones, in tiers: the same name, names one of which holds the other, and the matching ratio of the
    rest, worked out only where its cheap upper bounds leave room."""

    def __init__(self, known: list[tuple[str, int]]) -> None:
        self.ids: dict[str, set[int]] = {}
        for name, district in known:
            self.ids.setdefault(name, set()).add(district)
        self.matchers = {name: SequenceMatcher(None, b=name) for name in self.ids}  # what they learn of known names serves all others

    def scores(self, name: str) -> dict[int, float]:
        """Best score of each district that reaches LEAST."""
        best: dict[int, float] = {}

        def credit(known: str, score: float) -> None:
            for district in self.ids[known]:
                best[district] = max(score, best.get(district, 0.0))

        for known, matcher in self.matchers.items():
            if known == name or known in name or name in known:
                credit(known, 1.0 if known == name else CONTAINED)
            else:
                matcher.set_seq1(name)
                if matcher.real_quick_ratio() >= LEAST and matcher.quick_ratio() >= LEAST and (ratio := matcher.ratio()) >= LEAST:
                    credit(known, ratio)
        return best

    def matches(self, name: str) -> list[tuple[int, float]]:
        """(district, score) by falling score, ties by id: near the best one if that is good, else a few."""
        ranked = sorted(self.scores(name).items(), key=lambda x: (-x[1], x[0]))
        if ranked and ranked[0][1] >= GOOD:
            return [x for x in ranked if x[1] >= max(BESIDE, ranked[0][1] - WITHIN)]
        return ranked[:FEW]


def resolve(df: DataFrame, name_col: str, districts: DataFrame) -> DataFrame:
    """(name, rows, district_id, score, rank): the districts that each distinct name may mean, best first; a name without any has one row of nulls.

    Names are counted before they are compared, so a name of very many rows is compared once.
    """
    known = districts.select("district_id", F.lower(plain_text(F.col("name"))), F.lower(F.col("name_en"))).limit(MOST_NAMES + 1).collect()
    if len(known) > MOST_NAMES:
        raise ValueError(f"a district list holds at most {MOST_NAMES} names")
    gazetteer = Gazetteer(sorted((n, i) for i, *both in known for n in both if n))
    counted = df.where(F.length(F.trim(name_col)) > 0).groupBy(F.lower(F.trim(plain_text(F.col(name_col)))).alias("name")).agg(F.count("*").alias("rows"))

    def run(batches):
        for batch in batches:
            at, ids, scores, ranks = [], [], [], []
            for i, name in enumerate(batch.column(0).to_pylist()):
                for rank, (district, score) in enumerate(gazetteer.matches(name) or [(None, None)], 1):
                    at.append(i)
                    ids.append(district)
                    scores.append(score)
                    ranks.append(rank if district is not None else None)
            taken = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(ids, pa.int32()), pa.array(scores, pa.float64()), pa.array(ranks, pa.int32())], names=["name", "rows", "district_id", "score", "rank"])

    return counted.mapInArrow(run, "name string, rows long, district_id int, score double, rank int")
