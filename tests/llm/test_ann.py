"""Nearest neighbours where codes fit badly, and the memory of a cell."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from quillspark.llm import ann


@pytest.mark.parametrize("measure", ["inner", "l2"])
def test_none_of_the_nearest_is_missed_on_rows_without_structure(spark, measure):
    """Directions at random, lengths over orders of magnitude and forty rows far from the rest: codes tell little of them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64)) * np.exp((2 if measure == "l2" else 0) * rng.normal(size=(3000, 1)))
    x[::75] *= 1e6 if measure == "inner" else 5
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict[int, list[int]] = {}
    for r in sorted(ann.search(table, table.where("vec_id % 60 = 0"), k=20, rerank=32, measure=measure).collect()):
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, 3000, 60):
        score = (x * x[q]).sum(1) if measure == "inner" else -((x - x[q]) ** 2).sum(1)
        assert got[q] == [i for i in np.lexsort((np.arange(3000), -score)).tolist() if i != q][:20]


def test_memory_of_a_cell_follows_its_rows_and_results():
    """6,000 queries over 4,096 codes: before, each query held 256 rows as Python objects (371 MB)."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4096, 16))
    books = ann.fit(ann.directions(x), codebooks=4, codewords=16, rounds=2)
    codes, norms, spreads = books.encode(x)
    block = ann.Block(codes, norms, spreads, x, np.arange(4096), np.arange(4096))
    q = rng.normal(size=(6000, 16))
    tracemalloc.start()
    query, place, score = block.nearest(q, books, 21, 256, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(query) == len(place) == len(score) == 6000 * 21
    assert peak < 64 << 20


def test_every_length_of_vectors_is_searched(spark, monkeypatch):
    """Three lengths with a third of the rows each, and one with three rows: before, only the most frequent length took part."""
    rng = np.random.default_rng(9)
    size = lambda i: 5 if i in (0, 41, 80) else (64, 32, 48)[i % 3]
    x = [rng.normal(size=size(i)) * np.exp(rng.normal()) for i in range(2400)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")

    def check():
        got: dict[int, list[int]] = {}
        for r in sorted(ann.search(table, table.where("vec_id % 40 = 0"), k=20, rerank=32).collect()):
            got.setdefault(r.query_id, []).append(r.vec_id)
        for q in range(0, 2400, 40):
            others = [i for i in range(2400) if i != q and len(x[i]) == len(x[q])]
            assert got[q] == sorted(others, key=lambda i: (-(x[i] * x[q]).sum(), i))[:20]

    check()
    monkeypatch.setattr(ann, "CODED_LENGTHS", 1)
    check()
