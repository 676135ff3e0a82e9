"""Packing: bounds hold, capacity is kept, nothing is lost."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=40))
def test_bound_and_fit(sizes):
    sizes = np.array(sorted(sizes, reverse=True), dtype=np.int64)
    place, fill = packing.best_fit_decreasing(sizes, 20)
    assert np.bincount(place, sizes, minlength=len(fill)).astype(int).tolist() == fill.tolist() and (not len(fill) or fill.max() <= 20)
    assert packing.lower_bound(sizes, 20) <= len(fill)


def test_bound_of_items_that_do_not_share():
    assert packing.lower_bound(np.array([11] * 7), 20) == 7 and packing.lower_bound(np.array([7] * 6), 20) == 3


def test_rows_keep_whole(spark):
    sizes = [0, None, 1, 4096, 4097, 10_000, *[700 + i for i in range(300)]]
    df = spark.createDataFrame([(i, s or 0) for i, s in enumerate(sizes)], "doc_id long, tokens int")
    got = packing.pack(df, part_items=80).collect()  # several partitions and rounds
    total, filled = {}, {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
        filled[r.container_id] = filled.get(r.container_id, 0) + r.tokens
    assert total == {i: s or 0 for i, s in enumerate(sizes)} and max(filled.values()) <= 4096
    assert sorted(r.piece for r in got if r.doc_id == 5) == [0, 1, 2] and len([r for r in got if r.doc_id == 4]) == 2
    assert len(filled) <= -(-sum(filled.values()) // 4096) + 8
    one = packing.summary(packing.pack(df)).first()
    assert one.containers >= one.bound and one.items == len(got) and one.used == pytest.approx(one.tokens / one.containers / 4096)
    assert packing.pack(df.limit(0)).count() == 0


def test_rounds_end_without_progress(spark):
    tokens = spark.createDataFrame([(i, 0) for i in range(40)] + [(100 + i, 60) for i in range(40)], "doc_id long, tokens int")
    got = packing.pack(tokens, capacity=100, part_items=5).collect()
    assert len(got) == 80 and len({r.container_id for r in got if r.tokens}) == 40
